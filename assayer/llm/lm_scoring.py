"""Masked pseudo-likelihood of documents by a bidirectional window network, trained in numpy.

A token is predicted from the REACH tokens on either side of it: their embeddings, weighed by
place, are summed and squashed, and a three-level softmax gives the token's group, its class in
the group and its place in the class. A document's score is the sum of the conditional
log-probabilities of all its tokens.

Words are counted over the whole corpus. The network's vocabulary grows with it: about twice
the square root of its number of words, from LEAST to MOST. The most frequent words are tokens of
their own. Others share tokens by hash, and an exact way tells them apart: such a word has the
probability of its token times its share of the token's words, by counts of all words of all
*other* documents, as a masked word is told from the rest of the corpus. So a word that no other
document has is worth less than one that a single other document has, however large the corpus is.

Training passes over every window once. Documents are dealt by a hash of their tokens to ROUNDS
rounds, and within a round to learners of about LEARNER tokens each. All learners of a round start
from the same model, and what they learn is averaged, each row of weights by the windows that
trained it, block by block in a shuffle. Which learner sees what, and in which order, depends on
the texts alone: how a table is cut into files or partitions changes no score, but for the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import blobs, lean, mixed, written
from assayer.llm.token_store import SPACE, word_keys

REACH = 2
WIDTH = 16
#: Weights of an output and its bias.
OUT = WIDTH + 1
GROUPS = 32
CLASSES = GROUPS * GROUPS
#: Tokens of the vocabulary, between which it follows the corpus; the bounds are powers of two.
LEAST, MOST = CLASSES, 2**17
#: One token of so many is shared by words outside the vocabulary; the last stands for what lies outside the text.
SHARED_PART = 32
#: Rounds of training; each window is in one of them.
ROUNDS = 4
#: Tokens of a learner, up to MOST_LEARNERS of a round; beyond, learners grow.
LEARNER = 2**24
MOST_LEARNERS = 4096
#: Windows of a step: a 256th of a learner's, within these bounds.
LEAST_BATCH, MOST_BATCH = 1024, 65536
RATE = 0.15
#: Added to the count of every word, as in the rest of the corpus it may not occur at all.
UNSEEN = 0.5
#: Weights of a block that is averaged by itself.
BLOCK = 65536
#: Inputs of a softmax within this bound need no shift: their exponentials and the sums of these are ordinary numbers.
UNSHIFTED = 70.0
#: Where the tokens around a token stand, from it.
SHIFTS = [*range(-REACH, 0), *range(1, REACH + 1)]
#: Logarithms of counts are summed as whole numbers of this part, in any order the same.
SCALE = 10**9


def hashed_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, A-Z lower-cased, one text after the other, and the number of words of each."""
    low = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n" + bytes(8), np.uint8)
    space = SPACE[low[:-8]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(starts, begins + 1)
    return (word_keys(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)), np.diff(at)


def hashed(blob: bytes) -> np.ndarray:
    """Hashes of the words of one text."""
    return hashed_texts([blob])[0]


def grouped(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a batch, cut where texts together exceed size bytes."""
    held, bytes_held, first = [], 0, 0
    for k, blob in enumerate(blobs(batch.column(column))):
        held.append(blob)
        bytes_held += len(blob)
        if bytes_held > size or k == batch.num_rows - 1:
            yield first, held
            held, bytes_held, first = [], 0, k + 1


# --- counts and vocabulary -----------------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a partition, given out whenever some four million words are held."""

    def out() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    held, size = [], 0
    for batch in batches:
        for _, texts in grouped(batch, 0, 1 << 20):
            held.append(hashed_texts(texts)[0])
            size += len(held[-1])
            if size > 1 << 22:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often each word of docs (text) occurs, stored."""
    return written(docs.select("text").mapInArrow(lean(_counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-counts")


class Vocabulary:
    """Words with tokens of their own, by hash; what the others share; what their words count."""

    def __init__(self, size: int, tokens: int):
        self.size, self.tokens = size, tokens
        self.shared = max(1, size // SHARED_PART - 1)
        self.own = size - self.shared - 1
        self.outside = size - 1
        self.known, self.token = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        #: Of each shared token: occurrences of its words, and how many there are.
        self.total, self.distinct = np.zeros(self.shared, np.int64), np.zeros(self.shared, np.int64)

    def code(self, h: np.ndarray) -> np.ndarray:
        """The tokens of words by their hashes."""
        out = (self.own + (h % np.uint64(self.shared))).astype(np.uint32)
        if len(self.known) and len(h):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[at] == h
            out[hit] = self.token[at[hit]]
        return out


def size_for(tokens: int) -> int:
    """The power of two from twice the root of the corpus's words on, within the bounds."""
    wanted = 2 * int(np.sqrt(tokens))
    return min(MOST, max(LEAST, 1 << max(0, wanted - 1).bit_length()))


def _level(n: Column) -> Column:
    """A number that grows with a count: the count itself, then a step for each 2 %."""
    return F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n) * 32)).cast("int")


def vocabulary(counts: DataFrame, size: int | None = None) -> Vocabulary:
    """The most frequent words of counts (h, n) get tokens of their own, by falling count.

    The levels of counts, some three thousand, tell from which one on words are taken. Of the words
    of the last level, which need not fit whole, those with small hashes are: so what comes to the
    driver is bounded by the vocabulary.
    """
    level = _level(F.col("n"))
    levels = sorted(((r[0], r[1], r[2]) for r in counts.groupBy(level.alias("level")).agg(F.count("*"), F.sum("n")).collect()), reverse=True)
    tokens = sum(r[2] for r in levels)
    out = Vocabulary(size or size_for(tokens), tokens)
    left, last = out.own, None
    for at, words, _ in levels:
        if words > left:
            last = at
            break
        left -= words
    # a little less than what is left, so that it never is exceeded
    share = 0.0 if last is None else max(0.0, left - 8 * np.sqrt(left)) / next(r[1] for r in levels if r[0] == last)
    draw = F.shiftrightunsigned("h", 11) / F.lit(float(2**53))
    mine = F.lit(True) if last is None else (level > last) | ((level == last) & (draw < share))
    top = counts.filter(mine).toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((h, -n))[: out.own]
    h = h[order]
    by = np.argsort(h)
    out.known, out.token = h[by], by.astype(np.uint32)
    # what the driver must not hold is summed by token; the remainder of an unsigned hash in two parts
    high, m = F.shiftrightunsigned("h", 32) % out.shared, out.shared
    rest = (high * (2**32 % m) + F.col("h").bitwiseAND(2**32 - 1) % m) % m
    for token, n_words, total in counts.filter(~mine).groupBy(rest.alias("t")).agg(F.count("*"), F.sum("n")).collect():
        out.distinct[token], out.total[token] = n_words, total
    return out


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, doc_id, ids, rare) of docs (doc_id, text), stored, as training and scoring read it.

    row is a number of its own for each row; rare are the hashes of the words that share a token.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in grouped(batch, 1, 1 << 21):
                h, lengths = hashed_texts(texts)
                token = sent.value.code(h)
                cuts, n = np.cumsum(lengths)[:-1], len(texts)
                ids = [x.tobytes() for x in np.split(token, cuts)]
                shared = token >= sent.value.own
                upto = np.concatenate([[0], np.cumsum(shared)])
                rare = [x.tobytes() for x in np.split(h[shared], upto[cuts])]
                columns = [pa.array(range(row, row + n), pa.int64()), batch.column(0).slice(first, n).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "ids", "rare"])
                row += n

    return written(docs.select("doc_id", "text").mapInArrow(lean(run), "row long, doc_id long, ids binary, rare binary"), "lm-tokens", "zstd")


# --- the network -----------------------------------------------------------------------------------


def shapes(size: int) -> dict[str, tuple[int, int]]:
    """Rows and columns of the weights: embeddings, their weights by place, bias, and the softmaxes of the three levels, each output's weights and bias."""
    inside = size // CLASSES
    return {"e": (size, WIDTH), "c": (2 * REACH, WIDTH), "b": (1, WIDTH), "g": (GROUPS, OUT), "t": (GROUPS, GROUPS * OUT), "u": (CLASSES, inside * OUT)}


def fresh(size: int) -> dict[str, np.ndarray]:
    """The weights at the start: small embeddings and outputs, places alike, no biases."""
    rng, out = np.random.default_rng(9), {}
    for k, shape in shapes(size).items():
        out[k] = np.ones(shape, np.float32) if k == "c" else np.zeros(shape, np.float32) if k == "b" else rng.normal(0, 0.1, shape).astype(np.float32)
        if k in "gtu":
            out[k].reshape(-1, OUT)[:, WIDTH] = 0
    return out


def laid(seqs: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, at): sequences one after the other with ``outside`` around each, and where their tokens stand."""
    gap = np.full(REACH, outside, np.uint32)
    line = np.concatenate([x for s in seqs for x in (gap, s)] + [gap])
    lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
    return line, np.arange(int(lengths.sum())) + np.repeat(REACH * np.arange(1, len(seqs) + 1), lengths)


def windows(seqs: list[np.ndarray], outside: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, contexts) of all tokens of sequences; what lies outside a sequence is ``outside``."""
    line, at = laid(seqs, outside)
    return line[at], np.stack([line[at + d] for d in SHIFTS])


def apart(target: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, at) of windows that share no place."""
    line = np.vstack([context[:REACH], target[None], context[REACH:]]).T.astype(np.uint32)
    return line.ravel(), np.arange(len(target)) * (2 * REACH + 1) + REACH


def _seen(w: dict[str, np.ndarray], line: np.ndarray) -> np.ndarray:
    """The embeddings along a line, a column for each place: each is looked up once, not once for each window that it is in."""
    return np.take(np.ascontiguousarray(w["e"].T), line, axis=1)


def _hidden(w: dict[str, np.ndarray], seen: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hidden layer, a column for each place in ``at``, and a row of ones below, for biases."""
    inner = seen.shape[1] - 2 * REACH
    total = np.repeat(w["b"].T, inner, axis=1)
    for j, d in enumerate(SHIFTS):
        total += seen[:, REACH + d : REACH + d + inner] * w["c"][j][:, None]
    np.tanh(total, out=total)
    h = np.ones((OUT, len(at)), np.float32)
    np.take(total, at - REACH, axis=1, out=h[:WIDTH], mode="clip")
    return h


def _bounds(w: dict[str, np.ndarray], name: str, outputs: int) -> np.ndarray:
    """How far from 0 each softmax's inputs can be; no number of the hidden layer is beyond 1."""
    return np.abs(w[name]).reshape(-1, outputs, OUT).sum(axis=2).max(axis=1)


def _log_chosen(here: np.ndarray, h: np.ndarray, place: np.ndarray, every: np.ndarray, bound: float) -> np.ndarray:
    """The logarithm of a softmax at the chosen places."""
    x = here @ h
    if not bound < UNSHIFTED:
        x -= x.max(axis=0)
    chosen = x[place, every]
    np.exp(x, out=x)
    return chosen - np.log(x.sum(axis=0))


def _ordered(target: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """An order of targets by class, their classes in it, the classes there are, and where each begins and the last ends."""
    cls = (target // np.uint32(inside)).astype(np.uint16)
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    starts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    return order, cls, cls[starts], [*starts.tolist(), len(cls)]


def log_probabilities(w: dict[str, np.ndarray], target: np.ndarray, context: np.ndarray, batch: int = MOST_BATCH) -> np.ndarray:
    """The log-probability of each target in its context."""
    return log_probabilities_along(w, *apart(target, context), batch)


def log_probabilities_along(w: dict[str, np.ndarray], line: np.ndarray, at: np.ndarray, batch: int = MOST_BATCH) -> np.ndarray:
    """The log-probability of each token at a place of a line, between those around it."""
    inside = w["u"].shape[1] // OUT
    bounds = {name: _bounds(w, name, n).tolist() for name, n in (("g", GROUPS), ("t", GROUPS), ("u", inside))}
    out = np.empty(len(at), np.float32)
    for a in range(0, len(at), batch):
        here, some = _stretch(line, at[a : a + batch])
        target = here[some]
        order, cls, classes, edges = _ordered(target, inside)
        n, every = len(order), np.arange(len(order))
        h = _hidden(w, _seen(w, here), some[order])
        group, second = cls // GROUPS, cls % GROUPS
        logs = _log_chosen(w["g"], h, group, every, bounds["g"][0])
        upto = np.searchsorted(group, np.arange(GROUPS + 1, dtype=np.uint16)).tolist()
        for g in range(GROUPS):
            x, z = upto[g], upto[g + 1]
            if x < z:
                logs[x:z] += _log_chosen(w["t"][g].reshape(GROUPS, OUT), h[:, x:z], second[x:z], every[: z - x], bounds["t"][g])
        if inside > 1:
            place = target[order] % np.uint32(inside)
            for k, x, z in zip(classes.tolist(), edges, edges[1:], strict=False):
                logs[x:z] += _log_chosen(w["u"][k].reshape(inside, OUT), h[:, x:z], place[x:z], every[: z - x], bounds["u"][k])
        out[a : a + n][order] = logs
    return out


def _stretch(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a line that the windows at rising places are in, and the places in it."""
    first = at[0] - REACH
    return line[first : at[-1] + REACH + 1], at - first


class Trainer:
    """Adagrad on the mean negative log-probability of batches of windows; only rows that a batch touches are changed."""

    def __init__(self, w: dict[str, np.ndarray], rate: float = RATE):
        self.w, self.rate = {k: v.copy() for k, v in w.items()}, np.float32(rate)
        self.squares = {k: np.full_like(v, 1e-6) for k, v in w.items()}
        #: How often each row was trained, where rows differ.
        self.seen = {"e": np.zeros(len(w["e"]), np.int64), "t": np.zeros(GROUPS, np.int64), "u": np.zeros(CLASSES, np.int64)}
        self.tokens = 0

    def weights(self, name: str) -> np.ndarray:
        """What each row counts in an average: the windows that trained it."""
        held = self.seen.get(name)
        return np.full(len(self.w[name]), self.tokens, np.int64) if held is None else held

    def step(self, target: np.ndarray, context: np.ndarray) -> None:
        self.learn(*apart(target, context))

    def learn(self, line: np.ndarray, at: np.ndarray) -> None:
        """A step over the windows at places of a line, which rise."""
        line, at = _stretch(line, at)
        w, n, inside = self.w, len(at), self.w["u"].shape[1] // OUT
        scale = np.float32(1 / np.sqrt(n))  # steps of batches of any size are alike
        target = line[at]
        order, cls, classes, edges = _ordered(target, inside)
        places, every = at[order], np.arange(n)
        seen = _seen(w, line)
        h = _hidden(w, seen, places)
        dh = np.zeros_like(h)
        group, second = cls // GROUPS, cls % GROUPS
        self._softmax(w["g"], self.squares["g"], h, group, every, scale, dh, _bounds(w, "g", GROUPS)[0])
        upto = np.searchsorted(group, np.arange(GROUPS + 1, dtype=np.uint16)).tolist()
        bounds = _bounds(w, "t", GROUPS).tolist()
        for g in range(GROUPS):
            x, z = upto[g], upto[g + 1]
            if x < z:
                self._softmax(w["t"][g].reshape(GROUPS, OUT), self.squares["t"][g].reshape(GROUPS, OUT), h[:, x:z], second[x:z], every[: z - x], scale, dh[:, x:z], bounds[g])
        if inside > 1:
            place = target[order] % np.uint32(inside)
            u, squares, bounds = w["u"].reshape(CLASSES, inside, OUT), self.squares["u"].reshape(CLASSES, inside, OUT), _bounds(w, "u", inside).tolist()
            for k, x, z in zip(classes.tolist(), edges, edges[1:], strict=False):
                self._softmax(u[k], squares[k], h[:, x:z], place[x:z], every[: z - x], scale, dh[:, x:z], bounds[k])
        h, dh = h[:WIDTH], dh[:WIDTH]
        dh *= 1 - h * h
        # a window's gradient goes to the places around it; what a place gets is summed before tokens are
        inner = len(line) - 2 * REACH
        middle, around, count = np.zeros((WIDTH, inner), np.float32), np.zeros((WIDTH, len(line)), np.float32), np.zeros(len(line), np.int64)
        middle[:, places - REACH] = dh
        by_place = np.empty((2 * REACH, WIDTH), np.float32)
        for j, d in enumerate(SHIFTS):
            part = slice(REACH + d, REACH + d + inner)
            around[:, part] += middle * w["c"][j][:, None]
            by_place[j] = np.einsum("ij,ij->i", middle, seen[:, part])
            count[at + d] += 1
        self._change(w["b"], self.squares["b"], dh.sum(axis=1)[None])
        self._change(w["c"], self.squares["c"], by_place)
        used = np.flatnonzero(count)
        ids = line[used]
        by = np.argsort(ids.astype(np.uint16) if len(w["e"]) <= 65536 else ids, kind="stable")
        ids, used = ids[by], used[by]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows = ids[starts]
        grad = np.add.reduceat(np.take(around, used, axis=1), starts, axis=1).T
        squares = self.squares["e"][rows] + grad * grad
        self.squares["e"][rows] = squares
        w["e"][rows] -= self.rate * grad / np.sqrt(squares)
        self.seen["e"][rows] += np.add.reduceat(count[used], starts)
        self.seen["t"] += np.diff(upto)
        self.seen["u"][classes] += np.diff(edges)
        self.tokens += n

    def _change(self, here: np.ndarray, squares: np.ndarray, grad: np.ndarray) -> None:
        squares += grad * grad
        grad *= self.rate
        grad /= np.sqrt(squares)
        here -= grad

    def _softmax(self, here: np.ndarray, squares: np.ndarray, h: np.ndarray, place: np.ndarray, every: np.ndarray, scale: np.float32, dh: np.ndarray, bound: float) -> None:
        """One softmax: adds to dh, and changes its own weights, both by the weights before."""
        x = here @ h
        if not bound < UNSHIFTED:
            x -= x.max(axis=0)
        np.exp(x, out=x)
        x *= scale / x.sum(axis=0)
        x[place, every] -= scale
        dh += here.T @ x
        self._change(here, squares, x @ h.T)


# --- training over the cluster ----------------------------------------------------------------------


def _blocks(size: int) -> list[tuple[str, int, int]]:
    """(name, first row, end) of the blocks of weights that are averaged by themselves."""
    out = []
    for name, (rows, columns) in shapes(size).items():
        step = max(1, BLOCK // columns)
        out += [(name, a, min(rows, a + step)) for a in range(0, rows, step)]
    return out


def _train(start, size: int, batch: int):
    def given(trainer: Trainer) -> Iterator[pa.RecordBatch]:
        for i, (name, a, z) in enumerate(_blocks(size)):
            weights = trainer.weights(name)[a:z]
            if weights.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([trainer.w[name][a:z].tobytes()], pa.binary())], ["block", "weights", "model"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, learner, held, count = None, None, [], 0

        def learn() -> None:
            nonlocal held, count
            if held:
                line, at = laid(held, size - 1)
                for a in range(0, len(at), batch):
                    trainer.learn(line, at[a : a + batch])
            held, count = [], 0

        for some in batches:
            for name, raw in zip(some.column(0).to_pylist(), blobs(some.column(1)), strict=True):
                if name != learner:
                    learn()
                    if trainer:
                        yield from given(trainer)
                    trainer, learner = Trainer(start.value), name
                held.append(np.frombuffer(raw, np.uint32))
                count += len(held[-1])
                if count >= 8 * batch:
                    learn()
        if trainer:
            learn()
            yield from given(trainer)

    return run


def _average(size: int):
    """The average of the models of each block, row by row; rows that nobody trained have weight 0."""
    blocks = _blocks(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, raw_weights, raw in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), blobs(batch.column(2)), strict=True):
                _, a, z = blocks[block]
                weights = np.frombuffer(raw_weights, np.int64)
                model = np.frombuffer(raw, np.float32).reshape(z - a, -1) * weights[:, None].astype(np.float64)
                held = sums.get(block)
                sums[block] = (weights, model) if held is None else (held[0] + weights, held[1] + model)
        for block, (weights, model) in sums.items():
            mean = np.divide(model, weights[:, None], out=np.zeros_like(model), where=weights[:, None] > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["block", "weights", "model"])

    return run


def train(coded: DataFrame, size: int, tokens: int, rounds: int = ROUNDS, learner: int = LEARNER) -> dict[str, np.ndarray]:
    """Weights trained on every window of coded (ids) once. Without words they stay as at the start."""
    spark, w = coded.sparkSession, fresh(size)
    learners = min(MOST_LEARNERS, max(1, -(-tokens // (rounds * learner))))
    own = max(1, tokens // (rounds * learners))
    batch = min(MOST_BATCH, max(LEAST_BATCH, 1 << max(0, own // 256 - 1).bit_length()))
    draw = F.xxhash64("ids")
    rows = coded.filter(F.octet_length("ids") > 0).select("ids", F.pmod(draw, F.lit(rounds * learners)).alias("learner"), F.xxhash64(draw).alias("place"))
    kind, blocks = "block int, weights binary, model binary", _blocks(size)
    parts = min(len(blocks), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for r in range(rounds):
        start = spark.sparkContext.broadcast(w)
        mine = rows.filter((F.col("learner") >= r * learners) & (F.col("learner") < (r + 1) * learners))
        dealt = mine.repartitionById(learners, (F.col("learner") - r * learners).cast("int")).sortWithinPartitions("learner", "place")
        models = dealt.select("learner", "ids").mapInArrow(lean(_train(start, size, batch)), kind)
        w = {k: v.copy() for k, v in w.items()}
        for got in models.repartition(parts, "block").mapInArrow(lean(_average(size)), kind).collect():
            name, a, z = blocks[got["block"]]
            touched = np.frombuffer(bytes(got["weights"]), np.int64) > 0
            w[name][a:z][touched] = np.frombuffer(bytes(got["model"]), np.float32).reshape(z - a, -1)[touched]
        start.unpersist()
    return w


# --- scores ------------------------------------------------------------------------------------------


def score(coded: DataFrame, counts: DataFrame, vocab: Vocabulary, w: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, n_novel, log_probability) of the rows of encoded(); without words 0, 0 and 0.0.

    A row for each document and one for each word of it that shares a token meet the word's count,
    and then each other by document; counts, a row for each word, are hashed, which spares both sides a sort. A document's own row goes by a hash of its number, so that no
    key gathers them.
    """
    sent = coded.sparkSession.sparkContext.broadcast((vocab, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab_here, model = sent.value

        def given(rows, ids, held, rare, lengths) -> pa.RecordBatch:
            line, at = laid(held, vocab_here.outside)
            target, logs = line[at], log_probabilities_along(model, line, at).astype(np.float64)
            low = np.log(vocab_here.total + UNSEEN * vocab_here.distinct, where=vocab_here.distinct > 0, out=np.zeros(vocab_here.shared))
            shared = np.flatnonzero(target >= vocab_here.own)
            logs[shared] -= low[target[shared] - vocab_here.own]
            ends = np.concatenate([[0], np.cumsum(logs)])
            edges = np.concatenate([[0], np.cumsum(lengths)])
            found = [np.unique(x, return_counts=True) for x in rare]
            words, n = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            word_rows = np.repeat(np.array(rows, np.int64), [len(f[0]) for f in found])
            own = np.array(rows, np.int64)
            nulls, some = len(words), len(own)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, word_rows])),
                    pa.array(np.concatenate([mixed(own.view(np.uint64)), words]).view(np.int64)),
                    pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(nulls, pa.int64())]),
                    pa.concat_arrays([pa.array(lengths, pa.int64()), pa.nulls(nulls, pa.int64())]),
                    pa.concat_arrays([pa.array(ends[edges[1:]] - ends[edges[:-1]]), pa.nulls(nulls, pa.float64())]),
                    pa.concat_arrays([pa.nulls(some, pa.int64()), pa.array(n, pa.int64())]),
                ],
                ["row", "h", "doc_id", "n_tokens", "part", "n"],
            )

        for batch in batches:
            rows, ids, held, rare, lengths, size = [], [], [], [], [], 0
            for k, (row, doc, raw, raw_rare) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), blobs(batch.column(3)), strict=True)):
                seq = np.frombuffer(raw, np.uint32)
                for x, y in ((rows, row), (ids, doc), (held, seq), (rare, np.frombuffer(raw_rare, np.uint64)), (lengths, len(seq))):
                    x.append(y)
                size += len(seq)
                if size > 1 << 17 or k == batch.num_rows - 1:
                    yield given(rows, ids, held, rare, lengths)
                    rows, ids, held, rare, lengths, size = [], [], [], [], [], 0

    kind = "row long, h long, doc_id long, n_tokens long, part double, n long"
    rows = coded.mapInArrow(lean(run), kind).join(counts.select("h", F.col("n").alias("everywhere")).hint("shuffle_hash"), "h", "left")
    elsewhere = F.col("everywhere") - F.col("n")
    share = F.col("n") * F.round(F.log(elsewhere + UNSEEN) * SCALE).cast("long")
    novel = F.when(elsewhere == 0, F.col("n"))
    told = rows.select("row", "doc_id", "n_tokens", "part", share.alias("share"), novel.alias("novel"))
    # a document's words rarely meet before the shuffle, so sums wait for it
    whole = told.repartition("row").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.coalesce(F.sum("novel"), F.lit(0)).alias("n_novel"), F.max("part").alias("part"), F.coalesce(F.sum("share"), F.lit(0)).alias("share"))
    return whole.select("doc_id", "n_tokens", "n_novel", (F.col("part") + F.col("share") / SCALE).alias("log_probability"))


def score_corpus(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Counts, trains and scores over the whole of docs: doc_id, n_tokens, n_novel, log_probability, mean_log_probability.

    n_novel counts tokens outside the vocabulary whose word no other row has. A null text counts as
    empty; the mean of a text without words is null. Rows that repeat are trained on and scored
    each, and count as other rows of each other.
    """
    counts = word_counts(docs)
    vocab = vocabulary(counts)
    coded = encoded(docs, vocab)
    out = score(coded, counts, vocab, train(coded, vocab.size, vocab.tokens, rounds))
    return out.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")))


def digest(docs: DataFrame) -> DataFrame:
    """The scores of score_corpus() with novel_share: n_novel by n_tokens, null for a text without words."""
    out = score_corpus(docs.select("doc_id", "text"))
    return out.withColumn("novel_share", F.when(F.col("n_tokens") > 0, F.col("n_novel") / F.col("n_tokens")))
