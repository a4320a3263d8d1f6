"""The pipeline's stages one by one, each against brute force on its own input."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from tests.llm import test_jaccard, test_lines, test_others
from tests.llm.common import DOCS, LOWER, WORD, texts
from tidegauge.llm import toxicity


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """(stage name, input rows, output rows) of each stage."""
    d = tmp_path_factory.mktemp("sf")
    docs = texts(11, 40)
    item = "one benchmark item with more than enough words to be found again"
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    for i in range(200):
        w = [word() for _ in range(r.randint(5, 60))]
        docs.append((400 + i, " ".join([*w, "grumpf", "zzark", word()] if i % 2 else w)))
    docs += [(300, "before " + item.upper() + ", after"), (301, "item with more than enough words"), (302, None)]
    spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{i % 3}", len(t or "")) for i, t in docs], DOCS).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(400 + i, i % 2) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out, now = [], spark.read.parquet(f"{d}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(d)).write.parquet(f"{d}/{i}")
        new = spark.read.parquet(f"{d}/{i}")
        out.append((name, now, new))
        now = new
    return out


def test_columns(run):
    assert [n for n, _, _ in run] == ["toxicity", "line dedup", "near copies", "decontamination", "mixing"]
    for _, before, after in run[:-1]:
        assert after.columns == before.columns


def test_toxic_go(run):
    _, before, after = run[0]
    left = {r.doc_id for r in after.collect()}
    toxic = {r.doc_id for r in before.collect() if "grumpf" in (r.text or "")}
    assert not left & toxic
    clean = {r.doc_id for r in before.collect()} - toxic
    assert {i for i in clean if i >= 400} <= left
    # texts unlike all that the network has seen may fall either way, but few do
    assert len(clean - left) <= 3


def test_lines_go(run):
    _, before, after = run[1]
    want = test_lines.brute([(r.doc_id, r.text) for r in before.collect()])
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter((i, t) for (i, t, _, _), n in want.items() for _ in range(n))
    assert all(r.n_chars == len(r.text) for r in after.where("text is not null").collect())


def test_one_of_each_group_stays(run):
    _, before, after = run[2]
    want = {i for i, _, c in test_jaccard.brute([(r.doc_id, r.text) for r in before.collect()], 5, 80) if i == c}
    assert {r.doc_id for r in after.collect()} == want


def test_leaks_go(run):
    _, before, after = run[3]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {300}


def test_mix(run):
    """Against brute force: targets by pouring out the excess, rows in the order of their keys until the budget is used up."""
    _, before, after = run[4]
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in before.collect()]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    target = dict(zip(sources, test_others.water([size[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))], Fraction(3, 2), 2), strict=True))
    want = {}
    for s in sources:
        budget = math.floor(target[s])
        epochs, rest = divmod(budget, size[s]) if size[s] else (0, 0)
        for _, i, n in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, x, n in rows if x == s):
            want[i] = epochs * n + min(n, rest)
            rest -= min(n, rest)
    got = after.collect()
    assert {r.doc_id: r.taken for r in got} == want
    # the corpus comes out with it
    assert set(before.columns) <= set(after.columns)
    assert {(r.doc_id, r.text, r.lang, r.source) for r in got} == {(r.doc_id, r.text, r.lang, r.source) for r in before.collect()}


def test_toxic_as_the_network_says(run, spark):
    """The stage against a plain-loop forward pass over all windows of each text."""
    _, before, after = run[0]
    docs = before.select("doc_id", "text")
    net = toxicity.fit(docs, spark.createDataFrame([(400 + i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    rows = [r for r in docs.collect() if len(r.text or "") < 2000][:60]
    kept = {r.doc_id for r in after.collect()}
    assert {r.doc_id: r.doc_id in kept for r in rows} == {r.doc_id: test_others.plain_toxicity(net, r.text) < 0.7 for r in rows}


ODD = [(None, "one two three four five six"), (None, None), (1, ""), (1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, " \n"), (4, "x" * 100_000 + " y" * 50_000)]


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_rows(spark, tmp_path, k):
    """Nulls, repeated rows, very long texts, columns whose names stages use inside, and empty tables."""
    more = "toxicity_score double, N_LINES long, n_removed long, _score string, size long, target string, _keep0 int, component string, _copy int, _leak int"
    docs = spark.createDataFrame([(i, t, "en", None if i == 2 else "s", 7, 9.0, 5, 6, "a", 1, "b", 2, "c", 3, 4) for i, t in ODD], f"{DOCS}, {more}")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    for df, n in ((docs, None), (docs.limit(0), 0)):
        got = stage(spark, df, str(tmp_path))
        rows = got.collect()
        if k < 4:
            assert got.columns == df.columns
            assert all((r.toxicity_score, r.N_LINES, r.n_removed, r._score, r._keep0) == (9.0, 5, 6, "a", 2) for r in rows)
        if n is not None:
            assert len(rows) == n
            continue
        kept = Counter((r.doc_id, r.text) for r in rows)
        if k in (0, 3):
            assert kept == Counter(ODD)
        elif k == 1:
            assert len(rows) == len(ODD) and kept[None, None] == 1 and kept[2, ""] == 2
        elif k == 2:
            assert kept == Counter(x for x in ODD if x[0] != 2)
        else:
            assert len(rows) == len(ODD) and sum(r.taken for r in rows) > 0


def test_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_score_column_that_is_there_already(spark):
    df = spark.createDataFrame([(1, "a", 9.0)], "doc_id long, text string, Toxicity_Score double")
    assert toxicity.score(df, None).collect()[0].toxicity_score == 0.5
    assert toxicity.without_toxic(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()[0].Toxicity_Score == 9.0
