"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct word shingles (A-Z lower-cased). Two permutations of DIM
positions make all signature coordinates: sigma places each shingle, and coordinate k is the least
value of pi, shifted by k around the circle, over the places. BANDS bands of ROWS coordinates
propose pairs; every link is confirmed on full sets. A pair at the threshold of 0.8 shares no band
with probability (1 - 0.8**5)**40 < 2e-7.

Documents with equal sets are one class from the start. Large buckets are never expanded into
all pairs: each member is compared with the least and greatest class of its buckets, the likeliest
first. Buckets that those links leave in several components go, as sets, through an exact prefix
filter, which finds every pair among them that can reach the threshold. Classes in one component
need no more links. Sets travel only for pairs whose sizes and count sketches allow the threshold;
the sketch gives an upper bound of the intersection, so it drops no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import blobs, forget, lean, meet, MIX1, mixed, written
from assayer.llm.connected import components

DIM, ROWS, BANDS = 2**18, 5, 40
COORDS = ROWS * BANDS
SKETCH = 256
#: Cells that count how frequent shingles are where an order from rare to frequent is needed.
CELLS = 2**22
#: 2 MB: the most that tells the scan which documents' sets are needed.
BITS = 2**24
BROADCAST_GROUPS = 200_000
#: Classes whose rows go into one file of a table between steps, where there are more than so few files.
PART_CLASSES, LEAST_PARTS = 5_000, 8


def _circle() -> np.ndarray:
    """pi, continued around the circle by as many places as there are shifts."""
    pi = np.random.default_rng(20).permutation(DIM).astype(np.uint32)
    return np.concatenate([pi, pi[:COORDS]])


def _sigma(h: np.ndarray) -> np.ndarray:
    """Places of hashes: their low bits through a bijection of the positions."""
    low = h & np.uint64(DIM - 1)
    low = (low * np.uint64(0x2545F491) + np.uint64(0x1F123)) & np.uint64(DIM - 1)
    return (low ^ (low >> np.uint64(9))).astype(np.int64)


def shingles(blob: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    bytes.lower() changes A-Z alone and bytes.split() cuts at space and 9 to 13. A text with
    1 to k - 1 words has its whole sequence as its one shingle; without words it has none.
    """
    found = blob.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if len(h) < k:
        h = np.concatenate([h, np.full(k - len(h), int(MIX1) * len(h) % 2**64, np.uint64)])
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = mixed(out + MIX1) + h[j : j + n]
    return np.unique(mixed(out))


def signature(s: np.ndarray, circle: np.ndarray) -> np.ndarray:
    """COORDS coordinates of a set that isn't empty."""
    rows = np.lib.stride_tricks.sliding_window_view(circle, COORDS)
    places = np.unique(_sigma(s))
    least = None
    for a in range(0, len(places), 1024):
        part = rows[places[a : a + 1024]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band, its number included. Band b takes every BANDS-th coordinate."""
    out = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX1)
    for row in sig.reshape(ROWS, BANDS).astype(np.uint64):
        out = mixed(out + row * MIX1 + MIX1)
    return out.view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of SKETCH cells; 255 stands for that many or more."""
    cells = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=SKETCH)
    return np.minimum(cells, 255).astype(np.uint8)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = _circle()
        for batch in batches:
            n, cls, sig, cells = [], [], [], []
            for blob in blobs(batch.column(1)):
                s = shingles(blob, k)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(bands(signature(s, circle)) if len(s) else None)
                cells.append(sketch(s).tobytes() if len(s) else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "cls", "sig", "cells"])

    return run


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * 80


def _sketches_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose sketches allow 100 * intersection >= 80 * union; columns a, b, shared, na, nb, ca, cb."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = {c: i for i, c in enumerate(batch.schema.names)}
        x, y = (np.frombuffer(b"".join(batch.column(at[c]).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("ca", "cb"))
        na, nb = (batch.column(at[c]).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        most = np.minimum(x, y).astype(np.int64).sum(axis=1)
        full = (x == 255).any(axis=1) | (y == 255).any(axis=1)
        ok = full | (100 * most >= 80 * (na + nb - most))
        yield batch.select(["a", "b", "shared"]).filter(pa.array(ok))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, last, ok = None, None, []
        for a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if a != last:
                last, held = a, np.frombuffer(x, np.uint64)
            other = np.frombuffer(y, np.uint64)
            both = len(held) + len(other) - len(np.unique(np.concatenate([held, other])))
            ok.append(100 * both >= 80 * (len(held) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


class _Links:
    """Finds links among pairs of classes, and keeps the components so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, parts: int):
        self.docs, self.classes, self.k, self.parts, self.labels = docs, classes, k, parts, None

    def allowed(self, pairs: DataFrame, label: str) -> DataFrame:
        """Pairs (a, b, shared) that sizes and sketches allow."""
        c = self.classes
        x = c.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
        y = c.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
        return written(pairs.join(x, "a").join(y, "b").mapInArrow(lean(_sketches_allow), "a binary, b binary, shared long"), label, parts=self.parts)

    def _place(self, name: str) -> Column:
        """A number of an id: itself, or a text's hash."""
        text = self.docs.schema["doc_id"].dataType.typeName() == "string"
        return F.when(F.col(name).isNotNull(), F.xxhash64(name)) if text else F.col(name)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cls, hashes) of the classes in wanted, made anew from the texts of their documents."""
        need = wanted.join(self.classes.select("cls", "rep"), "cls")
        at = F.pmod(self._place("rep"), F.lit(BITS)) + 1
        found = need.filter("rep is not null").select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
        bits = np.zeros(BITS // 8, np.uint8)
        for n, m in found:
            bits[(n - 1) * 4096 : n * 4096] = np.frombuffer(bytes(m), np.uint8)
        sent, k = self.docs.sparkSession.sparkContext.broadcast(bits), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                bit = np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False), BITS)
                hit = ((sent.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
                made = [s for b in blobs(batch.column(1).filter(pa.array(hit))) if len(s := shingles(b, k))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())], ["cls", "hashes"])

        made = self.docs.select(self._place("doc_id"), "text").mapInArrow(lean(run), "cls binary, hashes binary")
        return written(made.join(need.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "near-sets", parts=self.parts)

    def link(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Confirms pairs on full sets and joins the components they connect."""
        x = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x"))
        y = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
        full = pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y")
        edges = full.mapInArrow(lean(_verify), "a binary, b binary")
        if self.labels is not None:
            edges = self.labeled(edges).select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a != b")
        edges = written(edges.distinct(), "near-edges", parts=self.parts)
        more = components(edges, "a", "b")
        if self.labels is None:
            self.labels = more
        else:
            old = self.labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            new = more.join(self.labels.select("node"), "node", "left_anti")
            self.labels = written(old.unionByName(new), "near-labels", parts=self.parts)

    def labeled(self, pairs: DataFrame) -> DataFrame:
        """pairs with la and lb, the components of a and b so far."""
        for c in ("a", "b"):
            names = self.labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}_"))
            pairs = pairs.join(names, c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}_", c)).drop(f"l{c}_")
        return pairs


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for blob in blobs(batch.column(0)):
            np.add.at(counts, _cells(np.frombuffer(blob, np.uint64)), 1)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["cell", "n"])


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """(a, b, shared) of sets (cls, hashes, label): every pair of other labels that can reach the threshold.

    Exact prefix filtering. Shingles are ordered from rare to frequent; of two sets with 80 %
    similarity, the first 1/9 of the smaller and the first 1/5 of the larger share a shingle, and
    enough of both stands behind it. A passage that many documents share stands at the end of the order, so it proposes no pairs. How
    frequent a shingle is, is counted in CELLS cells; any order is right, that one is fast. The
    driver gets a row for each cell that many sets share.
    """
    frequent = sets.select("hashes").mapInArrow(lean(_cell_counts), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 8").toArrow()
    counts = np.zeros(CELLS, np.int32)
    counts[frequent["cell"].to_numpy()] = np.minimum(frequent["n"].to_numpy(), 2**31 - 1)
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, lengths, sizes, places = [], [], [], []
            for blob in blobs(batch.column(1)):
                h = np.frombuffer(blob, np.uint64)
                n = len(h)
                h = h[np.lexsort((h, sent.value[_cells(h)]))[: n - -(-8 * n // 10) + 1]]
                first.append(h)
                places.append(np.arange(len(h)))
                lengths.append(len(h))
                sizes.append(n)
            if first:
                rows = pa.array(np.repeat(np.arange(len(first)), lengths))
                arrays = [pa.array(np.concatenate(first).view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(np.repeat(np.array(sizes, np.int64), lengths)), pa.array(np.concatenate(places))]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "cls", "label", "n", "at"])

    rows = written(sets.select("cls", "hashes", "label").mapInArrow(lean(run), "h long, cls binary, label binary, n long, at long"), "near-prefixes")
    shared = rows.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1").select("h")
    rows = rows.join(shared, "h", "left_semi")
    x = rows.filter("at <= n - ceil(8 * n / 9)").select("h", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("at").alias("ia"))
    y = rows.select("h", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("at").alias("ib"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    # at the first shingle that two sets share, all that they share is still to come
    ahead = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * 180 >= (F.col("na") + F.col("nb")) * 80
    met = x.join(y, "h").filter(smaller & (F.col("la") != F.col("lb")) & (100 * F.col("na") >= 80 * F.col("nb")) & ahead)
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _open(members: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """members (key, cls, ...) with label, of the buckets that hold several components."""
    named = written(members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "near-named", parts=parts)
    keys = written(named.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("c")).filter("l0 != l1").select("key", "c"), "near-keys", parts=parts)
    return meet(named, keys, "key", "c", named.count())


def near_classes(docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): rows (doc_id, n, cls), and (node, label): components of linked classes.

    cls is null for a text without words. The rows are written once and read again.
    """
    rows = written(docs.mapInArrow(lean(_features(k)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, cls binary, sig array<long>, cells binary"), "near-features")
    shared = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("sig").alias("sig"))
    classes = written(shared, "near-classes")
    held = classes.count()
    parts = max(LEAST_PARTS, -(-held // PART_CLASSES))
    placed = classes.select(F.explode("sig").alias("key"), F.struct("cls", "n").alias("m"))
    lows = written(placed.groupBy("key").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count("*").alias("c")).filter("lo.cls != hi.cls"), "near-lows", parts=parts)
    buckets = written(meet(placed, lows, "key", "c", held * BANDS), "near-buckets", parts=parts)
    links = _Links(docs, classes.select("cls", "rep", "n", "cells"), k, parts)

    # first, each class against the class that ends most of its buckets
    ends = buckets.select(F.explode(F.array("lo", "hi")).alias("p"), "m").filter((F.col("p.cls") != F.col("m.cls")) & _sizes_allow(F.col("p.n"), F.col("m.n")))
    counts = ends.groupBy(F.col("p.cls").alias("a"), F.col("m.cls").alias("b")).agg(F.count("*").alias("shared"))
    best = links.allowed(counts.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"), F.max("shared").alias("shared")), "near-best")
    links.link(best, links.sets(_both(best)))

    # then against both ends of the buckets that hold several components
    rows_open = written(_open(buckets.select("key", "m.cls", "m.n"), links.labels, parts), "near-open", parts=parts)
    end = written(rows_open.groupBy("key").agg(F.min(F.struct("cls", "n", "label")).alias("lo"), F.max(F.struct("cls", "n", "label")).alias("hi"), F.count("*").alias("m")), "near-ends", parts=parts)
    met = meet(rows_open, end, "key", "m", rows_open.count()).select("cls", "n", "label", F.explode(F.array("lo", "hi")).alias("p"))
    met = met.filter((F.col("p.label") != F.col("label")) & _sizes_allow(F.col("p.n"), F.col("n")))
    pairs = links.allowed(met.groupBy(F.col("p.cls").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("shared")), "near-pairs")
    links.link(pairs, links.sets(_both(pairs)))

    # in a bucket of three, all pairs have met; larger ones that are still apart go through the filter
    more = rows_open.filter("c > 3").drop("label", "c")
    still = written(_open(more, links.labels, parts).select("cls", "label").distinct(), "near-apart", parts=parts)
    open_sets = links.sets(still)
    left = links.allowed(prefix_pairs(open_sets.join(still, "cls")), "near-left")
    links.link(left, open_sets)
    for used in (lows, buckets, best, rows_open, end, pairs, still, open_sets, left, classes):
        forget(used)
    return rows.select("doc_id", "n", "cls"), links.labels


def _sortable(docs: DataFrame, id_col: str) -> Column:
    """A whole number as a long; a text, which is compared as it is."""
    return F.col(id_col) if docs.schema[id_col].dataType.typeName() == "string" else F.col(id_col).cast("long")


def near_dup(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    component_id is the smallest id among the rows that links of 80 % or more reach; kept: the
    row's id is component_id. A text without words is linked with nothing. Rows that repeat are
    one class; a null id counts for nothing in component_id and is kept only where no row of the
    component has an id.
    """
    rows, labels = near_classes(docs.select(_sortable(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), k)
    named = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "n", F.coalesce("label", "cls").alias("group"))
    least = written(named.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).filter("c > 1").select(F.col("group").alias("g"), "least"), "near-least")
    small = least.count() <= BROADCAST_GROUPS
    out = named.join(F.broadcast(least) if small else least, F.col("group") == F.col("g"), "left")
    component = F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    return near_dup(docs, k=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  WHERE least(na.n, nb.n) * 100 >= greatest(na.n, nb.n) * 80
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) AS c ON c.x = w.doc_id
"""
