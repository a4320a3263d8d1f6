import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.common import DOCS, LOWER, WORD, clashing, frame, texts
from tidegauge.llm import repeats
from tidegauge.llm.textops import Words, runs, utf8


def brute(rows, window):
    first, out = {}, Counter()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    words = [(i, WORD.findall(t or "")) for i, t in order]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key, at = tuple(w[k : k + window]), (i is not None, i or 0, k)
            first[key] = min(first.get(key, at), at)
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i is not None, i or 0, k):
                gone |= set(range(k, k + window))
        out[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def test_windows(spark):
    rows = texts()
    for window in (20, 5):
        assert Counter(map(tuple, repeats.without_repeats(frame(spark, rows), window).collect())) == brute(rows, window)


def test_clashing_names_null_id_and_repeats(spark):
    rows = [*texts()[:25], (None, texts()[3][1]), texts()[7], (7, "other words " * 30)]
    assert Counter(map(tuple, repeats.without_repeats(clashing(spark, rows), 8).collect())) == brute(rows, 8)


def test_small_batches_and_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = texts(9)
        assert Counter(map(tuple, repeats.without_repeats(frame(spark, rows), 10).collect())) == brute(rows, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert repeats.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def common_phrase(n, seed=4):
    """Texts that begin with the same words and go on as they like, some of them as another does."""
    r = random.Random(seed)
    phrase = " ".join(f"p{i}" for i in range(9))
    tails = [" ".join(f"w{r.randrange(10**6)}" for _ in range(14)) for _ in range(n // 2)]
    return [(i, f"{phrase} {r.choice(tails)}") for i in range(n)]


def test_windows_under_one_phrase(spark, monkeypatch):
    """Many different windows under one key are dealt out by their own hashes."""
    monkeypatch.setattr(repeats, "SAMPLED", 1)
    monkeypatch.setattr(repeats, "HOT", 4)
    rows = [*common_phrase(400), *texts(3)]
    df = frame(spark, rows)
    base = df.selectExpr("doc_id AS doc", "coalesce(text, '') AS text")
    hot = repeats.hot_keys(base, 20)
    assert len(hot)
    most = lambda hot: repeats.anchored(base, 20, hot).groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0]
    assert most(None) > 100 > 20 > most(hot)
    assert Counter(map(tuple, repeats.without_repeats(df, 20).collect())) == brute(rows, 20)


def test_copies_send_no_rows_to_the_first_ones_key(spark):
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u v w") for i in range(500)]
    base = spark.createDataFrame(rows, "doc long, text string").coalesce(1)
    kept = repeats.anchored(base, 20).where("pos >= 0").selectExpr("sum(octet_length(hashes))").collect()[0][0]
    assert kept == 4 * repeats.OWN
    got = repeats.without_repeats(base.withColumnRenamed("doc", "doc_id"), 20).groupBy("n_removed").count().collect()
    assert {(r.n_removed, r["count"]) for r in got} == {(0, 1), (23, 499)}


def test_hashes_of_words_that_only_polynomials_confuse():
    """Thue-Morse words and their complements collide under every polynomial modulo 2^64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (16, 64, 1024, 2048, 4096):
        x, y = word[:n], word[:n].translate(str.maketrans("ab", "ba"))
        h = Words(*utf8(pa.array([f"{x} {y} {x} {y[:-1]}c"])), lower=False).hash
        assert h[0] == h[2] and len(set(h.tolist())) == 3
    tokens = Words(*utf8(pa.array([" ".join(word), " ".join(word.translate(str.maketrans("ab", "ba")))])), lower=False).hash
    for n in (8, 64, 1024, 4096):
        assert runs(tokens[: len(word)], n)[0] != runs(tokens[len(word) :], n)[0]


def test_words_and_runs_are_those_of_the_texts():
    r = random.Random(2)
    some = ["".join(r.choice("aBé \n\t\x0b.") for _ in range(r.randint(0, 200))) for _ in range(300)] + [None, "x" * 63, "X" * 64, "x" * 65, "x" * 300, " x", "y "]
    for lower in (False, True):
        words = Words(*utf8(pa.array(some)), lower=lower)
        want = [[w.translate(LOWER) if lower else w for w in WORD.findall(t or "")] for t in some]
        assert np.diff(words.first).tolist() == [len(w) for w in want]
        flat = [w for x in want for w in x]
        of = {}
        assert all(of.setdefault(w, h) == h for w, h in zip(flat, words.hash.tolist(), strict=True)) and len(set(of.values())) == len(of)
        for width in (1, 2, 3, 5, 20):
            h, of = runs(words.hash, width).tolist(), {}
            keys = [tuple(flat[i : i + width]) for i in range(len(flat) - width + 1)]
            assert all(of.setdefault(k, x) == x for k, x in zip(keys, h, strict=True)) and len(set(of.values())) == len(of)
