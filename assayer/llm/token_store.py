"""Token ids in a compact binary format.

Texts are encoded with a public tokenizer, one end id closes each document. Ids are replaced by
their rank in the corpus, most frequent first, so that most take one byte, and coded byte-aligned:
blocks hold control bytes (four 2-bit lengths each) apart from data bytes (1 to 4 little-endian
bytes an id). numpy decodes a block by table lookup: a control byte gives four lengths, a length a
mask, a rank its id.

The store is a folder of Parquet files whose rows are blocks, in ascending document order by part
and block, beside a table of ids by rank. Every reader that Spark has can read it, in any store.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import blobs, forget, lean, MIX1, mixed, scratch, written

END_ID = 1
#: Ids in a block at most, besides those of its last document.
BLOCK_IDS = 1 << 18
#: Units held by an encoder, about 40 bytes each, besides those of the texts at hand.
LIMIT = 600_000
#: Bytes of texts encoded together, besides those of the last.
GROUP_BYTES = 1 << 20
LENGTHS = np.stack([(np.arange(256) >> (2 * j)) & 3 for j in range(4)], axis=1).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def compress(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of 32-bit values."""
    v = values.astype(np.uint32)
    lengths = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros((len(v) + 3) // 4 * 4, np.uint8)
    codes[: len(v)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(lengths, dtype=np.int64)
    data = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    starts = ends - lengths
    data[starts] = v & 0xFF
    for j in (1, 2, 3):
        long = lengths > j
        if not long.any():
            break
        data[starts[long] + j] = v[long] >> np.uint32(8 * j) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def expand(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of compress()."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    quads = np.lib.stride_tricks.sliding_window_view(raw, 4)[starts]
    return np.ascontiguousarray(quads).view("<u4").reshape(-1) & MASKS[lengths]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them, then those of the next."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Known:
    """Ids by 64-bit key: a large sorted table and a small recent one, in numpy."""

    def __init__(self, dtype: np.dtype):
        self.empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype))
        self.tables = [self.empty, self.empty]

    def absent(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for known, *_ in self.tables:
            if len(known):
                out &= known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] != keys
        return out

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, lengths, ids) of keys that are all there."""
        lengths, found = np.zeros(len(keys), np.int64), []
        for known, at, n, flat in self.tables:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = np.flatnonzero(known[i] == keys)
                lengths[hit] = n[i[hit]]
                found.append((hit, at[i[hit]], flat))
        offsets = np.cumsum(lengths) - lengths
        ids = np.zeros(int(lengths.sum()), self.empty[3].dtype)
        for hit, at, flat in found:
            ids[_spread(offsets[hit], lengths[hit])] = flat[_spread(at, lengths[hit])]
        return offsets, lengths, ids

    def make_room(self) -> None:
        """Forgets the large table once there are LIMIT keys."""
        if sum(len(t[0]) for t in self.tables) > LIMIT:
            self.tables = [self.tables[1], self.empty]

    def add(self, keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Adds keys that are absent."""
        fresh = (keys, np.cumsum(lengths) - lengths, lengths, flat)
        self.tables[1] = self._merged(self.tables[1], fresh)
        if 4 * len(self.tables[1][0]) > len(self.tables[0][0]):
            self.tables = [self._merged(*self.tables), self.empty]

    @staticmethod
    def _merged(x: tuple, y: tuple) -> tuple:
        keys = np.concatenate([x[0], y[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([x[1], y[1] + len(x[3])])[order], np.concatenate([x[2], y[2]])[order], np.concatenate([x[3], y[3]])


#: How word_bpe_49k.json cleans a text and cuts it into pieces; WordEncoder is right for these alone.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CLEANING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTTING = [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def is_word_bpe(definition: dict) -> bool:
    """Whether a tokenizer file lower-cases, cuts and marks word ends as WordEncoder takes for granted."""
    cleaning, cutting = definition.get("normalizer") or {}, definition.get("pre_tokenizer") or {}
    ends = (definition.get("model") or {}).get("end_of_word_suffix") == "</w>" and not definition.get("post_processor")
    return ends and cleaning.get("normalizers") == CLEANING and cutting.get("pretokenizers") == CUTTING


class PlainEncoder:
    """Ids of texts by any tokenizer file of the tokenizers library, text by text."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each UTF-8 text."""
        found = self.tokenizer.encode_batch_fast([str(t, "utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]


class WordEncoder:
    """Ids of texts by a tokenizer whose pieces never cross ASCII white space.

    Texts are cut in numpy into units: a word of Latin letters, lower-cased, and its closing
    punctuation, or any other word as a whole. Equal units have equal ids wherever they stand, so
    the library encodes each new unit once; all others are gathered by their key. Units are encoded
    in one call, joined by spaces, and told apart by the ids that end a piece; where the counts of
    pieces don't agree, one by one.
    """

    def __init__(self, path: str, dtype: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.pieces = regex.compile(PIECES)
        self.known = Known(self.dtype)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, keys: np.ndarray, units: list[bytes], simple: np.ndarray) -> None:
        """simple: units known to be one piece."""
        lengths, made = np.zeros(len(units), np.int64), [None] * len(units)
        texts = [str(u, "utf-8") for u in units]
        together = [i for i, t in enumerate(texts) if "<" not in t]  # others may hold a special token
        for a in range(0, len(together), 512):
            part = together[a : a + 512]
            counts = np.array([1 if simple[i] else len(self.pieces.findall(texts[i])) for i in part])
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == counts.sum() and len(ids) and cuts[-1] == len(ids):
                at = np.concatenate([[0], cuts])[np.cumsum(counts)]  # a unit without pieces ends where the one before it does
                lengths[part] = np.diff(at, prepend=0)
                made[part[0]] = ids.astype(self.dtype)  # the ids of all of part, which stand together
                for i in part[1:]:
                    made[i] = self.known.empty[3]
            else:
                for i in part:
                    made[i] = self._plain(texts[i])
                    lengths[i] = len(made[i])
        order = together + [i for i, t in enumerate(texts) if "<" in t]
        for i in order[len(together) :]:
            made[i] = self._plain(texts[i])
            lengths[i] = len(made[i])
        self.known.add(keys[order], lengths[order], np.concatenate([made[i] for i in order]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each UTF-8 text."""
        joined = b"\n".join(texts)
        raw = np.frombuffer(b"\n" + joined + b"\n" + bytes(8), np.uint8)
        low, starts, ends, simple = _units(raw)
        if not len(starts):
            return [b""] * len(texts)
        self.known.make_room()
        keys, first, at = np.unique(word_keys(low, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(self.known.absent(keys))
        if len(new):
            place = first[new]
            units = [low[s:e].tobytes() for s, e in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
            self._learn(keys[new], units, simple[place])
        offsets, lengths, flat = self.known.get(keys)
        n = lengths[at]
        upto = np.cumsum(n)
        ids = flat[_spread(offsets[at], n)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.cumsum(sizes) - sizes + 1
        cuts = np.concatenate([[0], upto])[np.searchsorted(starts, np.append(begins, len(raw)))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    space, closing, letter = (np.zeros(256, bool) for _ in range(3))
    space[[9, 10, 11, 12, 13, 32]] = True
    closing[list(b".,!?;:$*&%#")] = True
    letter[list(range(65, 91)) + list(range(97, 123))] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, closing, letter, lower


SPACE, CLOSING, LETTER, LOWER = _tables()
#: Closing marks of a word that are looked at; a word that ends in more is one unit.
MOST_CLOSING = 6


def _units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, simple) of the units of a text between white space."""
    space = SPACE[raw[:-8]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    s, e = edge[::2], edge[1::2]
    low = LOWER[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3  # U+00C0 to U+00FF: letters but for two signs
    latin = after & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)
    low[latin & (raw <= 0x9E)] += 32
    plain = LETTER[raw] | latin
    plain[:-1] |= (raw[:-1] == 0xC3) & latin[1:]
    strange = np.concatenate([[0], np.cumsum(~plain, dtype=np.int32)])
    core = e.copy()
    for _ in range(MOST_CLOSING):
        shrink = CLOSING[raw[core - 1]] & (core > s)
        if not shrink.any():
            break
        core -= shrink
    simple = strange[core] == strange[s]
    core[~simple] = e[~simple]
    angle = np.flatnonzero(raw == 60)
    if len(angle):  # a special token is matched as it is written
        for i in np.unique(np.searchsorted(e, angle, side="right")).tolist():
            low[s[i] : e[i]] = raw[s[i] : e[i]]
    starts, ends = np.stack([s, core], axis=1).reshape(-1), np.stack([core, e], axis=1).reshape(-1)
    real = ends > starts
    return low, starts[real], ends[real], np.repeat(simple, 2)[real]


def word_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of the bytes of each unit, eight at a time."""
    eights = np.lib.stride_tricks.sliding_window_view(low, 8)
    n = ends - starts
    masks = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
    key = n.astype(np.uint64) * MIX1
    left, at = np.arange(len(n)), 0
    while len(left):
        eight = np.ascontiguousarray(eights[starts[left] + at]).view("<u8").reshape(-1) & masks[np.minimum(n[left] - at, 8)]
        key[left] = mixed(key[left] ^ eight) + MIX1
        at += 8
        left = left[n[left] > at]
    return mixed(key)


def encoded(docs: DataFrame, tokenizer: str, dtype: str = "<u2", end: int = END_ID) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): ids and the end id. A null text has the end id alone."""

    fast = fits(tokenizer, dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids in groups_of_ids(batches, tokenizer, dtype, fast, end):
            yield pa.RecordBatch.from_arrays([names, pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids binary")


def counted(docs: DataFrame, tokenizer: str, dtype: str = "<u2") -> DataFrame:
    """(doc_id, n) of docs (doc_id, text): how many ids encoded() gives, without handing them on."""
    fast = fits(tokenizer, dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counts_of_ids(batches, tokenizer, dtype, fast)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n long")


def counts_of_ids(batches: Iterator[pa.RecordBatch], tokenizer: str, dtype: str, fast: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, n) of rows (doc_id, text), in order. fast: what fits() says."""
    item = np.dtype(dtype).itemsize
    for names, ids in groups_of_ids(batches, tokenizer, dtype, fast, END_ID):
        yield pa.RecordBatch.from_arrays([names, pa.array([len(b) // item for b in ids], pa.int64())], ["doc_id", "n"])


def groups_of_ids(batches: Iterator[pa.RecordBatch], tokenizer: str, dtype: str, fast: bool, end: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids of documents, their token ids with the end id) of groups of rows (doc_id, text), in order. fast: what fits() says."""
    encoder = _encoder(tokenizer, dtype, fast)
    last = np.array([end], dtype).tobytes()
    for batch in batches:
        group, size, first = [], 0, 0
        for k, text in enumerate(blobs(batch.column(1))):
            group.append(text)
            size += len(text)
            if size >= GROUP_BYTES or k == batch.num_rows - 1:
                yield batch.column(0).slice(first, len(group)), [ids + last for ids in encoder.encode(group)]
                group, size, first = [], 0, k + 1


def fits(tokenizer: str, dtype: str) -> bool:
    """Whether WordEncoder is right for a tokenizer file; ids that dtype can't hold are an error."""
    definition = json.loads(Path(tokenizer).read_text("utf-8"))
    largest = max([*definition["model"].get("vocab", {}).values(), *(t["id"] for t in definition.get("added_tokens") or [])], default=0)
    if largest > np.iinfo(np.dtype(dtype)).max:
        raise ValueError(f"ids up to {largest} don't fit {dtype}; use <u4")
    return is_word_bpe(definition)


_ENCODERS: dict[tuple[str, str, bool], WordEncoder | PlainEncoder] = {}


def _encoder(path: str, dtype: str, fast: bool) -> WordEncoder | PlainEncoder:
    """One encoder for each worker process, kept from task to task."""
    if (path, dtype, fast) not in _ENCODERS:
        _ENCODERS[path, dtype, fast] = (WordEncoder if fast else PlainEncoder)(path, dtype)
    return _ENCODERS[path, dtype, fast]


def ranked(rows: DataFrame, dtype: str = "<u2") -> np.ndarray:
    """Ids by falling count over all rows of encoded(), then by id. As many as the vocabulary used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(blobs(batch.column(0))), dtype), minlength=len(counts))
            got[: len(counts)] += counts
            counts = got
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    counts = rows.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def write_store(docs: DataFrame, path: str, tokenizer: str, dtype: str = "<u2") -> None:
    """Encodes docs (doc_id, text) and writes the store at path: blocks below blocks/, ids below ids/.

    Documents stand by doc_id, null ids first; of an equal id by length, then by ids. Rows that
    repeat are written each; an empty table makes a store without blocks' rows.
    """
    spark = docs.sparkSession
    rows = written(encoded(docs, tokenizer, dtype), "token-ids", "zstd")
    ids = ranked(rows, dtype)
    spark.createDataFrame([(ids.astype("<u4").tobytes(),)], "ids binary").write.parquet(f"{path}/ids")
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held_ids: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held_ids, held, size
            item = np.dtype(dtype).itemsize
            lengths = np.array([len(b) // item for b in held], "<i8")
            control, data = compress(sent.value[np.frombuffer(b"".join(held), dtype)])
            names = pa.array(held_ids, pa.int64())
            n = int(lengths.sum())
            out = [part, block, before, n, [names.to_pylist()], [lengths.tobytes()], [control], [data]]
            block, before, held_ids, held, size = block + 1, before + n, [], [], 0
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x if isinstance(x, list) else [x], k) for x, k in zip(out, kinds, strict=True)], ["part", "block", "before", "n", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                held_ids.append(name)
                held.append(blob)
                size += len(blob) // np.dtype(dtype).itemsize
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.octet_length("ids")
    ordered = rows.repartitionByRange(parts, "doc_id", length).sortWithinPartitions("doc_id", length, "ids")
    ordered.mapInArrow(lean(run), "part int, block long, before long, n long, doc_ids array<long>, lengths binary, control binary, data binary").write.parquet(f"{path}/blocks")
    forget(rows)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a store: ids as little-endian unsigned 32-bit integers.

    start counts the ids of all documents before: a block knows those of its part, and the sums of
    the parts, a row for each file, come to the driver.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    table = np.frombuffer(spark.read.parquet(f"{path}/ids").head()[0], "<u4")
    sums = dict(blocks.groupBy("part").agg(F.sum("n")).collect())
    starts, total = {}, 0
    for part in sorted(sums):
        starts[part], total = total, total + sums[part]
    sent = spark.sparkContext.broadcast((table, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part_starts = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_of[expand(row["control"], row["data"], row["n"])]
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                at = part_starts[row["part"]] + row["before"] + ends - lengths
                made = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(at, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.select("part", "before", "n", "doc_ids", "lengths", "control", "data").mapInArrow(lean(run), "doc_id long, start long, ids binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(blobs(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(b) // 4 for b in found], pa.int64()), pa.array([zlib.crc32(b) for b in found], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from a store written and read back."""
    path = scratch(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer)
    return read_store(docs.sparkSession, path).mapInArrow(lean(_digests), "doc_id long, start long, n_tokens long, ids_crc32 long")
