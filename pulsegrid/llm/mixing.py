"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hash order, offered a bounded number of times (epochs). A document of an
epoch ends at a virtual finish time: the tokens of its source up to and with it, divided by the source's weight. All
offers are range-sorted by that time and the mix is the prefix that reaches the budget. A queue that has run out no
longer competes, so the others share what it leaves by their weights, and no target exceeds epochs x size.

The cut needs no global sort: the offers lie in ranges of time, the ranges' totals say in which range the budget is
reached, and only the rows of that range are sorted and summed one by one. Offers of earlier ranges are taken whole, those of later
ones not at all. The offer that crosses the budget is taken in part.

Defined results: null texts have size 0 and are never taken; sources sort by code point with null last; documents of
size 0 take no time; repeated rows are separate offers; ties in time go by source, hash, key and epoch; an empty
table gives an empty mix; other columns of the input are left behind by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import WORD, materialize, null_safe, running_total, small

WEIGHTS = (3.0, 1.0, 2.0)
#: Ranges of the virtual time up to the targets' end: one to so many rows, between these bounds.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 4096, 4096, 1 << 17


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_plan(sizes: DataFrame, weights: Sequence[float], budget_share: float, epochs: int) -> DataFrame:
    """Per source (_s, source_size): weight, target and virtual end, by filling the smallest sources first.

    A source's offers last until V = epochs x size / weight. In order of that V, a source is filled whole if all that
    last longer, at its V, still fit the budget; the rest share what is left by weight. One row a source.
    """
    by_name = Window.orderBy("_s").partitionBy(F.lit(0))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("weight", F.get(w, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("_cap", F.lit(float(epochs)) * F.col("source_size"))
    s = s.withColumn("_end", F.col("_cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    sooner = everything.orderBy("_end", "_s")
    upto = sooner.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_budget", F.lit(float(budget_share)) * F.sum("source_size").over(everything))
    s = s.withColumn("_filled", F.sum("_cap").over(upto) + F.col("_end") * (F.sum("weight").over(everything) - F.sum("weight").over(upto)))
    s = s.withColumn("_full", F.col("_filled") <= F.col("_budget"))
    spare = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))
    share = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything), F.lit(1.0))
    s = s.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), spare / share * F.col("weight"))))
    s = s.withColumn("_until", F.max(F.col("target") / F.col("weight")).over(everything))
    return s.select("_s", "source_size", "weight", "target", "_budget", "_until")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = 1.5, epochs: int = 2, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document: key, size, source_size, target of its source, and ``taken`` words of the mix."""
    rows = docs.select(F.col(key).alias("_key"), words(text).alias("size"), F.col(source).alias("_source"))
    # null sorts last: '0' before a name, '1' for null, is a key in code point order
    rows = rows.withColumn("_s", F.when(F.col("_source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("_source")))).drop("_source")
    rows = rows.withColumn("_h", F.xxhash64(F.lit("mix"), null_safe("_key"), "size"))
    rows = materialize(rows, "mix-sizes")
    plan = source_plan(rows.groupBy("_s").agg(F.sum("size").alias("source_size")), weights, budget_share, epochs)
    plan = materialize(plan, "mix-sources")
    queued = running_total(rows, ["_s"], "_h", ["_key"], F.col("size"), "_before")
    queued = materialize(queued.join(small(plan), "_s").withColumn("_row", F.monotonically_increasing_id()), "mix-queues")
    offers = queued.where("size > 0").withColumn("_epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    # ranges up to the time the targets end, as many after it for offers under way then, one for the rest
    ranges = min(max(-(-queued.count() // RANGE_ROWS), LEAST_RANGES), MOST_RANGES)
    until = F.when(F.col("_until") > 0, F.col("_until")).otherwise(1.0)
    time_of = lambda epoch: (epoch * F.col("source_size") + F.col("_before") + F.col("size")) / F.col("weight")
    range_of = lambda epoch: F.least(F.floor(time_of(epoch) / until * ranges), F.lit(2 * ranges)).cast("int")
    epoch = F.col("_epoch")
    offers = offers.select("_row", "_s", "_h", "_key", "size", "_epoch", "_budget", time_of(epoch).alias("_time"), range_of(epoch).alias("_range"))
    totals = offers.groupBy("_range").agg(F.sum("size").alias("_sum"), F.first("_budget").alias("_budget"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    # one row: the range in which the budget is reached, and what is taken before it
    cut = totals.withColumn("_end", F.sum("_sum").over(upto)).where(F.col("_end") >= F.floor("_budget")).orderBy("_range").first()
    at, before = (cut["_range"], cut["_end"] - cut["_sum"]) if cut else (2 * ranges + 1, 0)
    marked = offers.where(F.col("_range") == at)
    inside = Window.partitionBy("_range").orderBy("_time", "_s", "_h", "_key", "_epoch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.lit(before) + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("_budget") - ahead)).cast("long")
    last = marked.withColumn("_take", part).groupBy("_row").agg(F.sum("_take").alias("_last"))
    # a row's offers of earlier ranges are counted in the row
    early = sum(F.when(range_of(F.lit(e)) < at, 1).otherwise(0) for e in range(epochs))
    out = queued.join(small(materialize(last, "mix-last")), "_row", "left")
    taken = (F.when(F.col("size") > 0, F.col("size") * early).otherwise(0) + F.coalesce("_last", F.lit(0))).cast("long").alias("taken")
    return out.select(F.col("_key").alias(key), "size", "source_size", "target", taken)


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = 1.5, epochs: int = 2, text: str = "text", source: str = "source", copy: str | None = None) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, once for each epoch that takes them (in part, too).

    copy: the name of a column for the number of the epoch, from 0; by default the copies of a row are equal.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").alias("_text"), F.col(f"`{source}`").alias("_source"))
    rows = materialize(whole.withColumn("_id", F.monotonically_increasing_id()), "mix-documents")
    taken = mix(rows, weights, budget_share, epochs, "_id", "_text", "_source").where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_times")
    # always a sort-merge join: a broadcast below some size would make the shuffle grow faster than the input
    out = rows.select("_id", "_doc").hint("merge").join(taken.select("_id", times), "_id")
    out = out.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return out.select("_doc.*", *([F.col("_epoch").alias(copy)] if copy else []))
