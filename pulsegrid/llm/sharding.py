"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level a row draws one number per child, -ln(u) / weight with u hashed from (row key, node), and takes the child
with the smallest. A child is taken in proportion to its weight, and when a weight changes, rows move only to or from
that child: trees that differ in one subtree place all other rows alike. A node's weight is the sum of its shards'.

Law ``key``: the key and the tree alone decide a row's shard. A new shard joins as a region of its own, so that only
the root's weights change and rows move into the new shard only (in an old rack, its rack and region would gain weight
too, and rows drawn to that region could land on its other shards).

Defined results: a null key hashes like the other null keys (one shard holds them); a null text has size 1 and the
checksum of no bytes; repeated rows share a shard and get slots of their own; an empty table gives an empty result;
other columns of the input are left behind.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import running_total


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> tuple[Shard, ...]:
    return tuple(Shard(i // (per_rack * racks_per_region), i // per_rack, i) for i in range(shards))


def grow(tree: Sequence[Shard], weight: float = 1.0) -> tuple[Shard, ...]:
    """The tree with one more shard, in a region and a rack of its own."""
    top = lambda f: max(map(f, tree), default=-1) + 1
    return (*tree, Shard(top(lambda s: s.region), top(lambda s: s.rack), top(lambda s: s.shard), weight))


def _draw(key: Column, level: str, children: Sequence[tuple[int, float]]) -> Column:
    """The child with the smallest draw; u lies in (0, 1)."""
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = []
    for node, weight in children:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11).cast("double") + 0.5) * 2.0**-53
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(node).alias("node")))
    return F.least(*draws).getField("node")


def place(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard of a key: three draws, each among the children of the node reached."""
    tree = [s for s in tree if s.weight > 0]
    total = lambda rows: sum(s.weight for s in rows)
    regions = sorted({s.region for s in tree})
    region = _draw(key, "region", [(r, total([s for s in tree if s.region == r])) for r in regions])

    def below(of: Column, nodes: Sequence[int], then) -> Column:
        cases = [(n, then(n)) for n in nodes]
        return reduce(lambda c, nt: c.when(of == nt[0], nt[1]), cases[1:], F.when(of == cases[0][0], cases[0][1]))

    def rack_in(r: int) -> Column:
        racks = sorted({s.rack for s in tree if s.region == r})
        rack = _draw(key, "rack", [(k, total([s for s in tree if s.region == r and s.rack == k])) for k in racks])
        return below(rack, racks, lambda k: _draw(key, "shard", [(s.shard, s.weight) for s in tree if s.region == r and s.rack == k]))

    return below(region, regions, rack_in)


def shard(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard and its slot there, gapless from 0 in hash order."""
    grown = grown or grow(tree)
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(k, tree).cast("int").alias("shard"),
        place(k, grown).cast("int").alias("grown_shard"),
    )
    rows = rows.withColumn("_h", F.xxhash64(F.lit("slot"), key, "text_crc32"))
    out = running_total(rows, ["shard"], "_h", [key, "size", "text_crc32"], F.lit(1).cast("long"), "slot")
    return out.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
