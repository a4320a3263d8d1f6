import random
from collections import Counter

from tests.llm.common import DOCS, clashing, frame
from tidegauge.llm import lines


def distance(a, b, band=2):
    """Edits between a and b, or more than band if there are more."""
    far = band + 1
    p = {j: j for j in range(min(len(b), band) + 1)}
    for i, x in enumerate(a):
        c = {}
        for j in range(max(0, i + 1 - band), min(len(b), i + 1 + band) + 1):
            c[j] = min(p.get(j, far) + 1, c.get(j - 1, far) + 1, p.get(j - 1, far) + (x != b[j - 1]) if j else far)
        p = c
    return p.get(len(b), far)


def near(a, b):
    return a == b or abs(len(a) - len(b)) <= 2 and (t := min(2, min(len(a), len(b)) // 10)) > 0 and distance(a, b) <= t


def brute(rows):
    all_lines = [((i is not None, i or 0, k), x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
    out = Counter()
    for i, t in rows:
        kept, gone = [], 0
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\v\f\r") and any(p < (i is not None, i or 0, k) and near(x, y) for p, y in all_lines):
                gone += 1
            else:
                kept.append(x)
        out[(i, "\n".join(kept) if t is not None else None, len((t or "").split("\n")) if t is not None else 0, gone)] += 1
    return out


def documents(seed, n=25):
    r = random.Random(seed)
    base = ["".join(r.choice("ab cdé") for _ in range(r.randint(1, 50))) for _ in range(18)]
    out = []
    for i in range(n):
        text = []
        for _ in range(r.randint(0, 6)):
            x = list(r.choice(base))
            for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
                k = r.randrange(len(x) + 1)
                x[k : k + r.randint(0, 1)] = r.choice(("", "z", "y"))
            text.append("".join(x))
        out.append((i, "\n".join(text)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "\n \n\n"), (n + 3, "w" * 20_000), (n + 4, "w" * 20_001 + "\nq")]


def got(df):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect())


def test_lines(spark):
    rows = documents(1)
    assert got(lines.without_repeated_lines(frame(spark, rows))) == brute(rows)


def test_clashing_names_null_id_and_repeats(spark):
    rows = [*documents(2), (None, documents(2)[3][1]), documents(2)[5], (6, "one other line of text here\n" + (documents(2)[1][1] or ""))]
    df = lines.without_repeated_lines(clashing(spark, rows))
    assert got(df) == brute(rows)
    assert df.columns == [*clashing(spark, rows).columns, "n_lines", "n_removed"]


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_LINES", 4)
    r = random.Random(3)
    rows = [(i, "".join(r.choice("xyz") if r.random() < 0.03 else c for c in "the same long line of text, nearly, in all of these")) for i in range(40)]
    assert got(lines.without_repeated_lines(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert lines.without_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def zipf_lines(n, seed=8):
    """Short lines of words by Zipf's law, of which many share a segment with some other."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(3000)]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(i, " ".join(r.choices(words, weights, k=r.randint(3, 5)))[: r.randint(10, 25)].strip()) for i in range(n)]


def test_short_lines_of_common_words(spark):
    rows = zipf_lines(300)
    assert got(lines.without_repeated_lines(frame(spark, rows))) == brute(rows)


def test_work_on_short_lines_grows_with_them(spark):
    """Lines are sent about as often whatever the corpus: no chain of shared segments joins them into ever larger groups."""
    sent = {n: lines.met_lines(frame(spark, zipf_lines(n)), 2, 10)[2].count() for n in (4000, 16_000)}
    assert sent[16_000] < 8 * sent[4000]
