import itertools
import random

import numpy as np
import pytest

from tests.llm.common import DOCS, LOWER, WORD, clashing, frame, texts
from tidegauge.llm import jaccard
from tidegauge.llm.graph import connected_components


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_groups(spark, width, percent):
    rows = texts()
    got = jaccard.jaccard_groups(frame(spark, rows), width, percent).collect()
    assert {tuple(r) for r in got} == brute(rows, width, percent)
    assert len(got) == len(rows)


def test_clashing_names_null_id_and_repeats(spark):
    rows = [*texts()[:20], (None, texts()[0][1]), texts()[0]]
    got = [tuple(r) for r in jaccard.jaccard_groups(clashing(spark, rows)).collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted([*brute(rows[:20], 3, 90), next(x for x in brute(rows[:20], 3, 90) if x[0] == 0)])
    assert [x[2] for x in got if x[0] is None] == [None]
    left = jaccard.one_of_each(clashing(spark, rows), 3, 90)
    assert left.columns == clashing(spark, rows).columns
    want = [i for i, _, c in brute(rows[:20], 3, 90) if i == c]
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted([*want, 0])


def test_empty(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_large_family_in_blocks(spark, monkeypatch):
    """Blocks of 8 sets must connect what one block connects."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    r = random.Random(1)
    base = [str(r.random()) for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(80)] = str(r.random())
        rows.append((i, " ".join(w)))
    assert {tuple(x) for x in jaccard.jaccard_groups(frame(spark, rows)).collect()} == brute(rows, 3, 90)


def test_linked_sets_share_a_part():
    r = np.random.default_rng(2)
    for percent in (60, 80, 90):
        for _ in range(200):
            n = int(r.integers(1, 300))
            common = r.integers(1, 2**63, n).astype(np.uint64)
            x, y = common, np.concatenate([common, r.integers(1, 2**63, int(n * (100 - percent) / percent)).astype(np.uint64)])
            x = np.unique(np.concatenate([x, r.integers(1, 2**63, int(r.integers(0, n // 8 + 1))).astype(np.uint64)]))
            y = np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both) and len(x) + len(y) != 2 * both:
                for common in (None, np.sort(r.choice(np.union1d(x, y), len(x) // 2)), np.union1d(x, y)):
                    assert len(np.intersect1d(jaccard.part_hashes(x, percent, common), jaccard.part_hashes(y, percent, common)))


def test_components_of_paths_stars_and_noise(spark):
    r = random.Random(4)
    ids = list(range(200))
    r.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(80)] + [(500, 500 + i) for i in range(1, 40)] + [(r.randrange(600, 700), r.randrange(600, 700)) for _ in range(60)] + [(7, 7), (None, 3)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a in up and b in up:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(x.node, x.component) for x in got} == {(i, find(i)) for i in up}
    assert len(got) == len(up)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_a_doc_id_are_one_document(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "e f g h"), (9, "e f g h"), (9, ""), (4, "i j k l"), (11, "i j k l"), (11, None), (12, "one two"), (12, "three")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame(spark, rows)).collect()}
    assert got == {(1, 2, 1), (5, 2, 1), (9, 2, 1), (9, 0, 1), (4, 2, 4), (11, 2, 4), (11, 0, 4), (12, 1, 12)}


def test_texts_without_a_common_word_never_link(spark):
    """Words whose hashes are equal under any polynomial."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_groups(frame(spark, rows)).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_passes_and_rounds_hold_a_share_of_the_rows(spark, monkeypatch):
    """No shuffled table of parts or of blocks is as large as all parts, or all sets in all their blocks; what they link is as before."""
    monkeypatch.setattr(jaccard, "PASS", 1)
    monkeypatch.setattr(jaccard, "ROUND", 1)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "SMALL", 20)
    names, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name="cut", rows=None: names.append(name) or cut(df, name, rows))
    r = random.Random(1)
    base = [str(r.random()) for _ in range(80)]
    rows = [x for x in texts(n=30) if len(x[1] or "") < 2000]
    for i in range(100, 130):
        w = list(base)
        w[r.randrange(80)] = str(r.random())
        rows.append((i, " ".join(w)))
    assert {tuple(x) for x in jaccard.jaccard_groups(frame(spark, rows)).collect()} == brute(rows, 3, 90)
    assert names.count("parts") == jaccard.SLICES
    assert names.count("sets") > 1
    assert names.count("links") > 2


def test_passes_over_the_parts_share_one_join_with_the_copies(spark, monkeypatch):
    """However many passes there are, a row meets the list of copies once."""
    monkeypatch.setattr(jaccard, "PASS", 1)
    joins, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name="cut", rows=None: joins.extend([name] * (name in ("own", "parts", "edges")) * df._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti")) or cut(df, name, rows))
    rows = [x for x in texts(n=30) if len(x[1] or "") < 2000]
    rows += [(100 + i, t) for i, t in rows[:20]]
    assert {tuple(x) for x in jaccard.jaccard_groups(frame(spark, rows)).collect()} == brute(rows, 3, 90)
    assert joins == ["own"]
    # and where slices of rows meet theirs one after another
    monkeypatch.setattr(jaccard, "SMALL", 5)
    assert {tuple(x) for x in jaccard.jaccard_groups(frame(spark, rows)).collect()} == brute(rows, 3, 90)
    assert 1 < len(joins) - 1 <= jaccard.SLICES
