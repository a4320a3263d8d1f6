"""A corpus pipeline of five stages: toxic documents go, repeated lines go, one document of each near-copy group stays, documents with benchmark items go, and the sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontam, jaccard, lines, mixing, toxicity
from tidegauge.llm.shared import cut, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Null and empty texts stay; of repeated rows all stay or all go; without labels of both classes all stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one go; n_chars follows. Documents left without a line that had one stay, with an empty text; null texts stay null. A null doc_id stands before all others."""
    out = lines.without_repeated_lines(docs, counts=False)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at a similarity of 0.8 connect, the one with the smallest doc_id stays. Null, empty and wordless texts, and rows without a doc_id, stay; of rows that share a doc_id all stay or all go."""
    return jaccard.one_of_each(docs, 5, 80)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go. Null and empty texts stay; rows that share a doc_id are one document. Without items all stay."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how many words of each the mix takes (0: none of it; beyond size: some of them twice): doc_id, text, lang, source, n_chars, size, source_size, target, taken. Null sources are the last source; null texts have size 0. See mixing.mix."""
    new = {"doc_id", "size", "source_size", "target", "taken"}
    return mixing.mix(docs, keep=tuple(c for c in docs.columns if c.lower() not in new))


STAGES = [("toxicity", remove_toxic), ("line dedup", remove_repeated_lines), ("near copies", remove_near_copies), ("decontamination", remove_leaks), ("mixing", mix_sources)]

#: SQL expresses neither the trained network nor, in reasonable time, the edit join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of sf_dir, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
