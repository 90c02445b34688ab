import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from assayer.llm import sharding as sh
from assayer.llm.common import uniform


def test_digest_against_brute_force(documents):
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    rows = sh.digest(documents).collect()
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_growth_moves_into_the_new_shard(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    for n in (40, 41, 57):
        rows = sh.assign_shards(ids, n_shards=n).collect()
        counts = Counter(r.shard for r in rows)
        assert len(counts) == n and max(abs(c * n / 40_000 - 1) for c in counts.values()) < 0.2
        moved = Counter(r.grown_shard for r in rows if r.grown_shard != r.shard)
        assert set(moved) == {n} and abs(moved[n] * (n + 1) / 40_000 - 1) < 0.2


def test_movement_stays_in_the_changed_subtree(spark):
    leaves = [sh.Node(i, 1.0, shard=i) for i in range(8)]
    tree = lambda heavy: sh.Node(-1, 8.0, tuple(sh.Node(10 + r, 4.0, tuple(sh.Node(20 + r * 2 + k, 2.0 * (heavy if (r, k) == (1, 0) else 1), tuple(leaves[r * 4 + k * 2 : r * 4 + k * 2 + 2])) for k in range(2))) for r in range(2)))
    ids = spark.range(5000)
    both = ids.select(sh.shard_of(F.col("id"), tree(1)).alias("a"), sh.shard_of(F.col("id"), tree(3)).alias("b")).filter("a != b").collect()
    assert both and all(r.a in (6, 7) and r.b in (4, 5) for r in both)  # only into the heavier rack of the same region


def descend(node, draw):
    """The shard of a key, by every child's draw at every level."""
    level = 0
    while node.shard is None:
        node = min((c for c in node.children if c.weight > 0), key=lambda c: -math.log(draw(level, c.name)) / c.weight)
        level += 1
    return node.shard


def test_shards_against_brute_force(spark):
    """Each draw is taken from Spark's hash alone; the descent is made anew."""
    root = sh.tree(40)
    heavy = sh.Node(-1, 40.0, (*root.children[:-1], sh.Node(root.children[-1].name, 24.0, root.children[-1].children)))
    ids = [*range(300), None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    names = [sorted({c.name for family in level for c in family}) for level in sh._levels(sh.tree(41))]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))
    draws = {}
    for level, some in enumerate(names):
        for r in rows.select("doc_id", *[uniform(key, F.lit(level), F.lit(n)).alias(str(n)) for n in some]).collect():
            draws.update({(r.doc_id, level, n): r[str(n)] for n in some})
    for n_root, got in ((None, sh.assign_shards(rows)), (heavy, sh.assign_shards(rows, root=heavy))):
        for r in got.collect():
            draw = lambda level, name, i=r.doc_id: draws[i, level, name]
            assert r.shard == descend(n_root or root, draw)
            assert r.grown_shard == (None if n_root else descend(sh.tree(41), draw))


def test_levels_draw_independently(spark):
    rows = spark.range(40_000).select(sh.shard_of(F.col("id"), sh.tree(40)).alias("s")).collect()
    racks = Counter((r.s // 8, r.s % 8 // 2) for r in rows)
    assert max(racks.values()) < 1.2 * min(racks.values())


def test_odd_rows(odd, empty):
    rows = sh.digest(odd).collect()
    assert len(rows) == odd.count() and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sh.digest(empty).count() == 0
    placed = sh.with_slots(sh.assign_shards(odd.select("doc_id", "kept").withColumn("shard", F.lit("clash"))), ["doc_id"])
    assert placed.count() == odd.count() and placed.agg(F.countDistinct("shard", "slot")).head()[0] == odd.count()
