"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import chat, decontam, jaccard, lines, lm, mixing, oracles, repeats, topk, toxicity, urls
from tidegauge.llm.shared import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 10 by inner product, for every vector whose vec_id is divisible by 100; see topk.top_k."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document's whole text by a network learnt from the labels that aren't held out; see toxicity.fit and toxicity.score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    s = F.col("toxicity_score")
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), F.when(s >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingles agree to 90 %; see jaccard.jaccard_groups."""
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), 3, 90)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document once repeated windows of 20 words are gone, as a digest; see repeats.without_repeats."""
    kept = repeats.without_repeats(table(spark, sf_dir, "documents"), 20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under a maximum-entropy model and under single tokens' counts; see lm.score."""
    return lm.score(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles; see decontam.leaks."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url and its aliases; see urls.url_filter."""
    return urls.url_filter(table(spark, sf_dir, "pages")).drop("component")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document once lines that nearly repeat an earlier one are gone, as a digest; see lines.without_repeated_lines."""
    out = lines.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the output as digests; see chat.format_conversations."""
    text = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_conversations(rows)

    def read(batches):
        import pyarrow as pa

        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                turns = chat.read_chatml(r["formatted"])
                loss = "".join(chat.unescape(r["formatted"][a:b]) for a, b in chat.loss_spans(r["formatted"], r["roles"], r["starts"], r["ends"]))
                out.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": sha("".join(f"{role}\n{t}\n" for role, t, _, _ in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(r["formatted"])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of the sources to weights 5, 2, 1 takes; see mixing.mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_toxicity, op3_jaccard, op4_substring_dedup, op5_lm_scoring, op6_decontamination, op7_url_filter, op8_line_dedup, op9_chat, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": oracles.OP1, "op3_jaccard": oracles.OP3, "op4_substring_dedup": oracles.OP4, "op6_decontamination": oracles.OP6, "op7_url_filter": oracles.OP7, "op9_chat": oracles.OP9, "op10_mixing": oracles.OP10}
