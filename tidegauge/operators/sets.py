"""Top-N entries, and sets as bitmaps and Bloom filters, per slot of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.rollup import Rollup

#: Bits of one bitmap of Spark's, of a Bloom filter, and its hash functions.
BITS, BLOOM_BITS, BLOOM_HASHES = 32_768, 65_536, 6
#: Slots are numbered in so many parts; words of 64 slots each, side by side in a row.
PARTS, WORDS = 8, 4


def top_n(rollup: Rollup, n: int, start: int, end: int, descending: bool = True, by: str = "value", truncate_per_slot: str | None = None) -> DataFrame:
    """(rank, key, fields, value) of the n keys with the highest (lowest) value in a range, ties by key. Exact: partials of all keys are combined over the range.

    truncate_per_slot: a level; then only the n best keys of each of its slots are combined, as if each slot kept n entries.
    """
    spec, key = rollup.spec, rollup.keys
    order = lambda: [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), *key]
    if truncate_per_slot:
        rows = rollup._rows(truncate_per_slot, start, end).withColumn("value", spec.lowered())
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("slot").orderBy(*order()))).where(F.col("_r") <= n)
        rows = rows.groupBy(*key).agg(*spec.combined()).withColumn("value", spec.lowered())
    else:
        rows = rollup.combine_range(start, end, keyed=True)
    best = rows.orderBy(*order()).limit(n)  # a heap in each task, then one of heaps
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order()))).select("rank", *key, *spec.fields, "value")


def bitmaps(rows: DataFrame, slot: Column, value: str) -> DataFrame:
    """(slot, bucket, bitmap): the set of whole numbers of each slot, 32,768 to a bitmap; all 64-bit numbers can be in one (unsigned ones above 2^63 as the negative of the same bits). Nulls are in no set."""
    v = F.col(value).cast("long")
    return rows.where(v.isNotNull()).groupBy(slot.alias("slot"), _bucket(v).alias("bucket")).agg(F.bitmap_construct_agg(_position(v)).alias("bitmap"))


def _bucket(value: Column) -> Column:
    return F.shiftright(value, 15)


def _position(value: Column) -> Column:
    return value.bitwiseAND(F.lit(BITS - 1).cast("long"))


def united(maps: DataFrame, slot: Column | None = None) -> DataFrame:
    """Bitmaps of coarser slots, or of all."""
    by = [slot.alias("slot")] if slot is not None else []
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counted(maps: DataFrame) -> DataFrame:
    """(slot, n_distinct) of each slot's set."""
    return maps.groupBy("slot").agg(F.sum(F.bitmap_count("bitmap")).alias("n_distinct"))


def elements(maps: DataFrame) -> DataFrame:
    """(slot, bucket, position) of every bit that is set: a row for each byte that isn't zero, then for each of its bits, counted from the lowest."""
    bytes_ = F.filter(F.sequence(F.lit(1), F.lit(BITS // 8)), lambda i: F.substring(F.col("bitmap"), i, F.lit(1)) != F.lit(b"\0"))
    rows = maps.select("slot", "bucket", "bitmap", F.explode(bytes_).alias("_i"))
    byte = F.conv(F.hex(F.substring("bitmap", F.col("_i"), F.lit(1))), 16, 10).cast("int")
    rows = rows.select("slot", "bucket", "_i", byte.alias("_b"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.getbit(F.col("_b"), j) == 1)
    return rows.select("slot", "bucket", "_i", F.explode(bits).alias("_j")).select("slot", "bucket", ((F.col("_i") - 1) * 8 + F.col("_j")).cast("long").alias("position"))


def members(maps: DataFrame, candidates: DataFrame, value: str) -> DataFrame:
    """(slot, value): which of the candidates each slot's set has. Elements and candidates meet in the whole number itself, so the work is the elements and the hits."""
    c = candidates.select(F.col(value).cast("long").alias("value")).where("value is not null").distinct()
    c = c.select("value", _bucket(F.col("value")).alias("bucket"), _position(F.col("value")).alias("position"))
    return elements(maps).join(c, ["bucket", "position"]).select("slot", "value")


def _positions(value: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(BLOOM_BITS)) for i in range(BLOOM_HASHES)])


def blooms(rows: DataFrame, slot: Column, value: str) -> DataFrame:
    """(slot, bucket, bitmap): a Bloom filter of each slot's values of any type, as two bitmaps; united() merges them. Nulls are in no set."""
    bits = rows.where(F.col(value).isNotNull()).select(slot.alias("slot"), F.explode(_positions(F.col(value))).alias("_p"))
    return bits.groupBy("slot", F.floor(F.col("_p") / BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("_p") % BITS).alias("bitmap"))


def _numbered(maps: DataFrame) -> DataFrame:
    """With _block, _word and _bit of each slot: whole numbers that depend on the set of slots only, dense in a part, WORDS words of 64 bits to a block."""
    part = F.pmod(F.xxhash64("slot"), F.lit(PARTS))
    n = F.dense_rank().over(Window.partitionBy("_part").orderBy("slot")) - 1
    rows = maps.withColumn("_part", part).withColumn("_n", n)
    return rows.withColumns({"_block": F.floor(F.col("_n") / (64 * WORDS)) * PARTS + F.col("_part"), "_word": F.floor(F.col("_n") / 64) % WORDS, "_bit": F.col("_n") % 64}).drop("_part", "_n")


def may_contain(filters: DataFrame, candidates: DataFrame, value: str) -> DataFrame:
    """(slot, value): the candidates that each slot's filter may have; none that it has is missing.

    The filters are turned over: a row for each position and block of slots says in which of the block's slots the position is set. A candidate meets the rows of its positions,
    and what is set in all of them are its slots, so no row is made for a slot and a candidate before it is a hit. Spark takes exploded rows for as few as their source has, so this join never broadcasts.
    """
    numbered = _numbered(filters)
    at = numbered.select(F.struct("_block", "_word", "_bit").alias("slot"), "bucket", "bitmap")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot._bit"))
    words = [F.bit_or(F.when(F.col("slot._word") == i, mask).otherwise(F.lit(0).cast("long"))).alias(f"_w{i}") for i in range(WORDS)]
    turned = elements(at).groupBy("bucket", "position", F.col("slot._block").alias("_block")).agg(*words)
    c = candidates.select(F.col(value).alias("value")).where("value is not null").distinct()
    bits = c.select("value", F.explode(F.array_distinct(_positions(F.col("value")))).alias("_p"))
    bits = bits.select("value", F.floor(F.col("_p") / BITS).alias("bucket"), (F.col("_p") % BITS).alias("position"))
    met = bits.join(turned.hint("merge"), ["bucket", "position"]).groupBy("value", "_block").agg(F.count(F.lit(1)).alias("_n"), *[F.bit_and(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])
    met = met.where(F.col("_n") == F.size(F.array_distinct(_positions(F.col("value")))))
    met = met.select("value", "_block", F.posexplode(F.array(*[f"_w{i}" for i in range(WORDS)])).alias("_word", "_w")).where("_w != 0").withColumn("_word", F.col("_word").cast("long"))
    slots = numbered.groupBy("_block", "_word").agg(F.sort_array(F.collect_set(F.struct("_bit", "slot"))).alias("_slots"))
    hit = F.filter("_slots", lambda s: F.getbit(F.col("_w"), s["_bit"]) == 1)
    return met.join(slots, ["_block", "_word"]).select(F.explode(hit).alias("_hit"), "value").select("_hit.slot", "value")
