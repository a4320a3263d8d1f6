"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import SPACE, broadcast_up_to, cut, fresh, lower_az

WIDTH, THRESHOLD = 5, 0.8
#: Rows of the benchmark's sketches (16 to 24 bytes each), or of its shingles with their bytes counted, that may be broadcast; beyond, the join is shuffled.
SMALL = 500_000


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z), without the punctuation at their ends; what is nothing but punctuation is no word."""
    bare = F.regexp_replace(lower_az(F.coalesce(text, F.lit(""))), r"(?<![^\x20\x09-\x0D])[\p{Punct}]+|[\p{Punct}]+(?![^\x20\x09-\x0D])", "")
    return F.filter(F.split(bare, SPACE), lambda w: w != "")


def _per_run(words: Column, width: int, run: Callable[[Column, Column], Column], whole: Callable[[Column], Column], kind: str) -> Column:
    """run(words, i) for each run of `width` words, whole(words) for a shorter text that has any.

    words is bound to a lambda's variable, so that it is computed once, whatever the optimizer merges; as a plain expression it would be computed again in each step of the inner transform.
    """
    def each(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: run(w, i))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(whole(w))).otherwise(F.array().cast(f"array<{kind}>"))

    return F.flatten(F.transform(F.array(words), each))


def hashes_of(words: Column, width: int) -> Column:
    """A long for each run of `width` words; a shorter text is one run."""
    return _per_run(words, width, lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]), F.xxhash64, "bigint")


def shingles_of(words: Column, width: int) -> Column:
    """As hashes_of, but the words themselves, joined by a space."""
    return _per_run(words, width, lambda w, i: F.array_join(F.slice(w, i + 1, width), " "), lambda w: F.array_join(w, " "), "string")


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every row of docs (doc_id, text) and item (item_id, text) of which the document holds at least `threshold` of the distinct word shingles.

    Items are partitioned by size, in powers of two. The MinHash sketch of an item is the smallest k of its
    shingles' hashes, under a seed of its partition, those that fewer items share first: a document that lacks at most n - ceil(threshold * n) of an item's n shingles
    holds one of any set of one more, so with k = n - ceil(threshold * n) + 1 the search misses nothing, however long the
    document is. Only items' sketches are compared with the documents' hashes; the pairs that meet are verified on the shingles' words.

    Items with fewer than `width` words can only be found in texts that have the same words. Null and empty texts, on either side, are
    in no pair. A null doc_id is a document like others. Repeated rows: rows that share a doc_id are one
    document of all their shingles; so are items. An item without item_id is in no pair. Empty tables give an empty result. Other columns are ignored.
    """
    item = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    pairs = item.select("item_id", F.explode(F.arrays_zip(shingles_of(F.col("w"), width).alias("s"), hashes_of(F.col("w"), width).alias("h"))).alias("x"))
    pairs = cut(pairs.select("item_id", "x.s", "x.h").distinct(), "items")
    sizes = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    part = F.floor(F.log2("n_item")).cast("int")
    sized = pairs.join(sizes, "item_id").withColumn("part", part)
    k = F.col("n_item") - F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9) + 1
    # a phrase that many items share would pair each of them with every document that has it: it comes last
    often = pairs.groupBy("h").agg(F.count_distinct("item_id").alias("items"))
    sized = sized.join(often, "h")
    low = sized.groupBy("item_id", "n_item", "part").agg(F.sort_array(F.collect_set(F.struct("items", F.xxhash64("part", "h").alias("rank"), "h"))).alias("low"))
    sketch = cut(low.select("item_id", "n_item", F.explode(F.slice("low", F.lit(1), k.cast("int"))).alias("x")).select("item_id", "n_item", "x.h"), "sketches")
    probe = broadcast_up_to(sketch.select("h").distinct(), SMALL)
    words = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    met = words.select("doc_id", F.explode(hashes_of(F.col("w"), width)).alias("h")).join(probe, "h").distinct()
    met = cut(met, "met")
    found = cut(met.join(broadcast_up_to(sketch, SMALL), "h").select("doc_id", "item_id", "n_item").distinct(), "candidates")
    return verified(docs, pairs, found, width, threshold)


def verified(docs: DataFrame, pairs: DataFrame, found: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of the candidates found, those whose shared distinct shingles, as words, reach the threshold."""
    ids = found.select(F.col("doc_id").alias("id")).distinct()
    some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    held = some.select("doc_id", F.explode(shingles_of(words_of(F.col("text")), width)).alias("s"))
    shared = held.join(broadcast_up_to(pairs.select("item_id", "s"), SMALL, "s"), "s").groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n_shared"))
    f = found.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"), "n_item")
    out = shared.join(f, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")))
    return out.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9).select("doc_id", "item_id", "n_item", "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that hold a benchmark item."""
    leak = fresh(docs, "_leak")
    bad = leaks(docs.select("doc_id", "text"), items, width, threshold).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(cut(bad, "leaks"), F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
