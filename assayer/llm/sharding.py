"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws -ln(u)/weight, where u is
a hash of key, level and child, and the least draw wins. A child's weight is the sum of the shards
below it, so shards fill evenly; when weights change, keys move only into or out of the subtrees
whose weights changed.

Growth keeps the tree as it is: a shard beyond the first ``base`` ones opens a region of its own.
No other weight changes, so a larger shard count takes rows only into the new shards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import uniform


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: its own name for draws, its weight, its children or shard number."""

    name: int
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def tree(n_shards: int, base: int = 40, racks: int = 4, per_rack: int = 2) -> Node:
    """Regions of racks * per_rack shards for the first base shards; each later one is a region.

    The last region of the base may be partly filled. Weights are numbers of shards.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    regions, size = [], racks * per_rack
    first = min(n_shards, base)
    for start in range(0, first, size):
        inside = range(start, min(start + size, first))
        groups = [inside[i : i + per_rack] for i in range(0, len(inside), per_rack)]
        made = tuple(Node(g[0], float(len(g)), tuple(Node(s, 1.0, shard=s) for s in g)) for g in groups)
        regions.append(Node(start, float(len(inside)), made))
    regions += [Node(s, 1.0, (Node(s, 1.0, (Node(s, 1.0, shard=s),)),)) for s in range(first, n_shards)]
    return Node(-1, float(n_shards), tuple(regions))


def _levels(root: Node) -> list[list[list[Node]]]:
    """For each level, the children of each node of the level above, in order."""
    out, nodes = [], [root]
    while nodes[0].shard is None:
        out.append([[c for c in n.children if c.weight > 0] for n in nodes])
        nodes = [c for n in nodes for c in n.children if c.weight > 0]
    return out


def _draws(key: Column, level: int) -> Callable[[Column], Column]:
    def draw(child: Column) -> Column:
        score = -F.log(uniform(key, F.lit(level), child["name"])) / child["weight"]
        return F.struct(score.alias("score"), child["at"].alias("at"), child["shard"].alias("shard"))

    return draw


def shard_of(key: Column, root: Node) -> Column:
    """The shard number that a key descends to; a null key counts as a key of its own.

    One draw for each child of the three nodes on the way, not for each shard.
    """
    filled = F.coalesce(key.cast("string"), F.lit("\0null"))
    at = F.lit(0)  # place of the node in its level
    for level, families in enumerate(_levels(root)):
        place, rows = 0, []
        for family in families:
            rows.append(F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.weight).alias("weight"), F.lit(place + i).alias("at"), F.lit(-1 if c.shard is None else c.shard).alias("shard")) for i, c in enumerate(family)]))
            place += len(family)

        won = F.array_min(F.transform(F.element_at(F.array(*rows), at + 1), _draws(filled, level)))
        at = won["at"]
    return won["shard"].cast("int")


def assign_shards(rows: DataFrame, key: str = "doc_id", n_shards: int = 40, base: int = 40, grown: bool = True, root: Node | None = None) -> DataFrame:
    """rows with shard, and grown_shard: the shard if there were one more.

    root is a tree with weights of its own instead of that of n_shards; it has no grown_shard. Every
    row gets a shard; rows of equal key share it, a null key is one more key. Columns of these names
    that rows have already are replaced. No shuffle.
    """
    out = rows.withColumn("shard", shard_of(F.col(key), root or tree(n_shards, base)))
    return out.withColumn("grown_shard", shard_of(F.col(key), tree(n_shards + 1, base)) if grown and not root else F.lit(None).cast("int"))


def with_slots(rows: DataFrame, order: list[str], shard: str = "shard", parts: int = 256) -> DataFrame:
    """rows with slot: 0, 1, ... without gaps in each shard.

    A shard's rows are dealt to ``parts`` parts by a hash of all order columns; each part is counted,
    and a row's slot is the count of the parts before its own plus its place there. So no task
    holds a shard. The table of counts has at most shards * parts rows, whatever the input. Rows
    equal in every order column share a part, as rows that repeat do.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(parts)).cast("int")
    dealt = rows.withColumn("_llm_part", part)
    counts = dealt.groupBy(shard, "_llm_part").count()
    before = Window.partitionBy(shard).orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_llm_s"), F.col("_llm_part").alias("_llm_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_llm_start"))
    placed = dealt.join(F.broadcast(starts), (F.col(shard) == F.col("_llm_s")) & (F.col("_llm_part") == F.col("_llm_p")))
    place = F.row_number().over(Window.partitionBy(shard, "_llm_part").orderBy(*order)) - 1
    return placed.withColumn("slot", (F.col("_llm_start") + place).cast("long")).drop("_llm_part", "_llm_s", "_llm_p", "_llm_start")


def write_shards(rows: DataFrame, path: str, n_shards: int = 40, key: str = "doc_id", root: Node | None = None) -> None:
    """Writes rows as one folder of Parquet files for each shard."""
    assign_shards(rows, key, n_shards, grown=False, root=root).drop("grown_shard").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """For each document: size, text_crc32, law, shard, slot, grown_shard. A null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    slotted = with_slots(assign_shards(narrow, "doc_id", n_shards), ["doc_id", "text_crc32", "size"])
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
