"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.shared import WORD, broadcast_up_to, cut

#: Sources that a broadcast may hold; with more, the sources' table is joined by a shuffle.
SMALL = 50_000


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """sources: one row (skey, source_size) per source. Adds target: share times all sizes, dealt by weight, no source above epochs times its size.

    The excess of capped sources is dealt again by weight until none is above. That has a
    closed form: sources in the order of cap over weight; the first whose own share of what
    the earlier caps leave lies under its cap ends the capped ones. The only windows over a
    single partition hold one row for each source.
    """
    w = Window.orderBy("skey")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("ratio", "skey")
    d = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", d).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("left_over", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_over") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(every)["level"])
    return s.select("skey", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs (doc_id, text, source), and the columns of docs that `keep` names.

    A row's key is the MD5 of its doc_id, or of its text if it has none: random, yet the same in every run. Within a source
    the rows stand in key order. Key ranges (the first four hex digits: 65,536 ranges of nearly
    equal share) are summed with partial aggregation, prefix sums run over 256 ranges of ranges
    and over the 256 ranges inside each, and only the one range that a source's budget cuts is
    opened: its rows are summed by key and size, and of the one key and size at the cut the rows are counted
    and numbered by the partition that they were read in. Neither a hot source nor a hot doc_id is thus ever in one task. The row at the cut gives only
    the words that are missing. Budget: the target, rounded down; whole epochs first.

    Null text: size 0. Null source: a source of its own, the last. Rows that repeat a doc_id share its key; the smaller size stands first, and rows equal in
    doc_id and size are interchangeable. Sources without words: target 0. Empty table: empty result.
    Other columns are ignored; one that `keep` names may have any name that the result doesn't.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce("text", F.lit("")))).cast("binary"))
    skey = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))
    kept = [f"_keep{i}" for i in range(len(keep))]
    rows = cut(docs.select("doc_id", word_count(F.col("text")).alias("size"), skey.alias("skey"), key.alias("key"), F.spark_partition_id().alias("pid"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)]), "sizes")
    r4 = F.substring("key", 1, 4)
    ranges = cut(rows.groupBy("skey", r4.alias("r4")).agg(F.sum("size").alias("n")), "ranges")
    r2 = ranges.groupBy("skey", F.substring("r4", 1, 2).alias("r2")).agg(F.sum("n").alias("n2"))
    before = Window.unboundedPreceding, -1
    r2 = r2.withColumn("before2", F.coalesce(F.sum("n2").over(Window.partitionBy("skey").orderBy("r2").rowsBetween(*before)), F.lit(0)))
    goal = cut(targets(ranges.groupBy("skey").agg(F.sum("n").alias("source_size")), weights, share, epochs), "targets")
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    goal = goal.withColumn("full", full).withColumn("rest", budget - F.col("full") * F.col("source_size"))
    # the range of ranges, then the range, in which the rest runs out
    hit = r2.join(goal, "skey").where("before2 <= rest and before2 + n2 > rest").select("skey", "r2", "before2", "rest")
    inner = ranges.withColumn("r2", F.substring("r4", 1, 2)).join(hit, ["skey", "r2"])
    inner = inner.withColumn("before4", F.col("before2") + F.coalesce(F.sum("n").over(Window.partitionBy("skey", "r2").orderBy("r4").rowsBetween(*before)), F.lit(0)))
    hit = inner.where("before4 <= rest and before4 + n > rest").select("skey", F.col("r4").alias("cut4"), "before4")
    goal = cut(goal.join(hit, "skey", "left"), "goals")
    # the key and size in that range, and how many words its rows may give together
    opened = broadcast_up_to(goal.where("cut4 is not null").select("skey", F.col("cut4").alias("r4"), "before4", "rest"), SMALL)
    keys = rows.withColumn("r4", r4).join(opened, ["skey", "r4"]).groupBy("skey", "before4", "rest", "key", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("n"))
    keys = keys.withColumn("at", F.col("before4") + F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("key", "size").rowsBetween(*before)), F.lit(0)))
    edge = keys.where("at <= rest and at + n > rest").select("skey", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), (F.col("rest") - F.col("at")).alias("room"))
    goal = broadcast_up_to(cut(goal.select("skey", "source_size", "target", "full").join(edge, "skey", "left"), "edges"), SMALL)
    all_rows = rows.join(goal, "skey")
    out = "doc_id", "size", "source_size", "target", *kept
    whole = F.col("full") * F.col("size")
    # without a cut the rest is used up by no row (a source of size 0) or is 0
    plain = all_rows.where("cut_key is null or key <> cut_key or size <> cut_size")
    plain = plain.select(*out, (whole + F.when(F.expr("key < cut_key or key = cut_key and size < cut_size"), F.col("size")).otherwise(0)).alias("taken"))
    equal = all_rows.where("key = cut_key and size = cut_size")
    parts = equal.groupBy("skey", "pid").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("skey", "pid", F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("pid").rowsBetween(*before)), F.lit(0)).alias("earlier"))
    number = F.col("earlier") + F.row_number().over(Window.partitionBy("skey", "pid").orderBy("key")) - 1
    equal = equal.join(parts, ["skey", "pid"]).withColumn("i", number)
    equal = equal.select(*out, (whole + F.greatest(F.lit(0), F.least("size", F.col("room") - F.col("i") * F.col("size")))).alias("taken"))
    names = ["doc_id", *keep, "size", "source_size", "target", "taken"]
    return plain.unionByName(equal).select("doc_id", *kept, "size", "source_size", "target", "taken").toDF(*names)
