"""Top-k, decontamination, URL filter, chat, mixing, toxicity and language-model scoring against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import DOCS, LOWER, WORD, clashing, frame, texts
from tidegauge.llm import chat, decontam, lm, mixing, topk, toxicity, urls
from tidegauge.llm.shared import cut


def test_top_k(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # many equal vectors: ties
    rows += [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [0.5, 0.5]), (1005, []), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, shard int, tree string").repartition(3)
    ok = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and i not in (1000, 1001, 1002, 1003)}
    want = set()
    for q in (i for i in ok if i % 20 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, per_shard=64).collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_keeps_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0]), (5, [3.0]), (5, [2.0]), (7, [1.0]), (0, [4.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3)
    m = 1024**2
    want = [(0, 1, 0, 4 * m), (0, 2, 5, 3 * m), (0, 3, 5, 2 * m), (0, 1, 5, 12 * m), (0, 2, 5, 8 * m), (0, 3, 0, 4 * m)]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_top_k_ties_over_many_shards(spark):
    r = random.Random(9)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(3)]) for i in range(400)]
    want = {(q, i) for q, v in rows if q % 40 == 0 for _, i in sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:5]}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 40 == 0, k=5, per_shard=8)
    assert {(x.query_id, x.vec_id) for x in got.collect()} == want


def test_top_k_in_query_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 20)
    r = random.Random(2)
    rows = [(i, [r.choice((1e6, -3e5, 2.5)) * r.random() for _ in range(4)]) for i in range(60)]
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = {(q, i) for q in ok if q % 2 == 0 for _, i in sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q)[:3]}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, k=3, per_shard=16)
    assert {(x.query_id, x.vec_id) for x in got.collect()} == want


def test_leaks(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randint(5, 40)))) for i in range(25)] + [(25, None), (26, ""), (27, "two words"), (None, "a b c d e f")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 400))]
        x = (r.choice(items[:25])[1]).split()
        cut = r.choice((0, 0, 1, 2, 8))
        w[len(w) // 2 : len(w) // 2] = [y.upper() if r.random() < 0.3 else f"({y}," if r.random() < 0.2 else y for y in x[: len(x) - cut]]
        docs.append((i, " ".join(w)))
    docs += [(60, None), (61, ""), (62, "Two  WORDS!"), (63, "..."), (None, items[3][1]), docs[3], docs[3]]

    def grams(t):
        punct = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
        w = [y for x in WORD.findall((t or "").translate(LOWER)) if (y := x.strip(punct))]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    held = {}
    for i, t in docs:
        held.setdefault(i, set()).update(grams(t))
    want = {(d, i, len(g), len(g & s)) for d, s in held.items() for i, t in items if (g := grams(t)) and 10 * len(g & s) >= 8 * len(g)}
    df, it = clashing(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x)[:4] for x in decontam.leaks(df, it).collect()} == want
    left = decontam.without_leaks(df, it)
    assert left.columns == df.columns
    assert Counter(x.doc_id for x in left.collect()) == Counter(i for i, _ in docs if i not in {d for d, *_ in want})
    assert decontam.leaks(df.limit(0), it).count() == decontam.leaks(df, it.limit(0)).count() == 0


def test_urls(spark):
    canonical = '<html><link href="{}" rel="canonical"></html>'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.org/x", canonical.format("https://B.net/q")), (2, "https://b.net/q", None), (3, "http://c.org/fr/1", canonical.format("http://a.org/x#top")),
        (4, "http://lonely.org/", "<p>no links</p>"), (5, "x", ""), (6, None, canonical.format("/y")), (7, "http://EXAMPLE.net/en/7", None), (8, "http://sub.example.com/de/", None),
        (9, "http://net.org/z", refresh.format("http://a.org/x")), (10, "http://notnet/", None), (11, "http://example.net", None), (12, "ftp://net?x", None), (4, "http://lonely.org/", "<p>no links</p>"),
        (13, "http://d.org/a", canonical.format("/b")), (14, "http://d.org/b?c", None), (15, "http://example.net/en#f", None),
    ]
    df = spark.createDataFrame([(*x, "r", 1) for x in rows], "page_id long, url string, html string, address string, component int")
    got = Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in urls.url_filter(df).collect())
    want = [
        (1, "a.org", "/x", None, "block"), (2, "b.net", "/q", "net/", "block"), (3, "c.org", "/fr/1", "org/fr/", "allow"), (4, "lonely.org", "/", None, "allow"), (5, "", "", None, "allow"),
        (6, "", "", None, "allow"), (7, "example.net", "/en/7", "example.net/en/", "allow"), (8, "sub.example.com", "/de/", "example.com/de/", "block"), (9, "net.org", "/z", None, "block"),
        (10, "notnet", "/", None, "allow"), (11, "example.net", "", None, "allow"), (12, "net", "", None, "allow"), (4, "lonely.org", "/", None, "allow"), (13, "d.org", "/a", None, "allow"),
        (14, "d.org", "/b", None, "allow"), (15, "example.net", "/en", "net/", "block"),
    ]
    assert got == Counter(want)
    more = urls.url_filter(df, edges=spark.createDataFrame([("http://lonely.org/", "http://d.org/a"), ("http://d.org/a", "http://far.net/")], "a string, b string"))
    assert {x.page_id: x.verdict for x in more.collect()}[4] == "block"
    assert urls.url_filter(df.limit(0)).count() == 0


def test_urls_random_graphs(spark):
    """Components with stars and long chains of canonical links, refreshes and redirects, against a search from each page."""
    r = random.Random(12)
    hosts = ["a.org", "b.com", "c.net", "example.net", "example.com", "x.example.com", "d.io", "net", "sub.org"]
    url = lambda i: f"http://{hosts[i % len(hosts)]}{('/en/', '/de/', '/fr/', '/')[i // 9 % 4]}p{i}"
    n = 240
    links = [(i, i + 1) for i in range(40)] + [(60 + i, 50) for i in range(1, 50)] + [(r.randrange(120, n), r.randrange(120, n)) for _ in range(70)]
    tag = lambda i, j: f'<link rel="canonical" href="{url(j)}">' if (i + j) % 2 else f'<meta http-equiv="refresh" content="1; url={url(j)}">'
    given = [x for k, x in enumerate(links) if k % 5 == 0]
    rows = [(i, url(i), "".join(tag(a, b) for k, (a, b) in enumerate(links) if a == i and k % 5)) for i in range(n) if i % 7]  # some are only linked to
    edges = spark.createDataFrame([(url(a), url(b)) for a, b in given], "a string, b string")
    there = {i for i, *_ in rows}
    near = {}
    for k, (a, b) in enumerate(links):
        if a != b and (k % 5 == 0 or a in there):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def judge(i):
        host, path, best = hosts[i % len(hosts)], url(i).split("/", 3)[3], None
        for verdict, rule in urls.RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
                best = verdict, rule
        return best

    want = {}
    for i in there:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        own = judge(i)
        want[i] = (own[1], own[0]) if own else (None, "block" if any((judge(j) or ("",))[0] == "block" for j in seen) else "allow")
    got = {x.page_id: (x.rule, x.verdict) for x in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"), edges=edges).collect()}
    assert got == want and {v for _, v in want.values()} == {"block", "allow"}


def test_urls_second_tags_and_relative_targets(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.org/x", link.format("/y") + link.format("http://b.net/q")), (2, "http://c.org/x", refresh.format("/y") + refresh.format("http://b.net/q")),
        (3, "http://d.org/s/x?k", link.format("page.html")), (4, "http://e.org/s/x", link.format("?id=2")), (5, "http://f.org/s/x", link.format("../t/./p")), (6, "http://g.org", link.format("p")), (7, "http://h.org/x", link.format("mailto:x@y.net")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(x.a, x.b) for x in urls.links_of(pages).collect()}
    want = {("a.org/x", "a.org/y"), ("a.org/x", "b.net/q"), ("c.org/x", "c.org/y"), ("c.org/x", "b.net/q"), ("d.org/s/x?k", "d.org/s/page.html"), ("e.org/s/x", "e.org/s/x?id=2"), ("f.org/s/x", "f.org/t/p"), ("g.org", "g.org/p")}
    assert got == want
    assert {x.page_id: x.verdict for x in urls.url_filter(pages).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|im_start|>", "a<", "<\\\\|x", "\n<|\n|>", "<<||>>", "퟿ é \U0001f600"])
def test_chat_round_trip(text):
    turns = [("user", text), ("as\n\\ns<|im_end|>t", text), ("assistant", text)]
    whole, at = chat.spans(turns, chat.chatml)
    assert [(r, t) for r, t, _, _ in chat.read_chatml(whole)] == turns
    assert [whole[a:b] for a, b in at] == [chat.chatml([t]) for t in turns]
    (a, b), = chat.loss_spans(whole, [r for r, _ in turns], *zip(*at, strict=True))
    assert chat.unescape(whole[a:b]) == text


def test_chat_templates():
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    header = lambda t: "BEGIN " + chat.chatml(t)
    whole, at = chat.spans(turns, header)
    assert whole == header(turns) and [whole[a:b] for a, b in at] == [chat.chatml([t]) for t in turns]
    counted = lambda t: "".join(f"[{i}]{x}" for i, (_, x) in enumerate(t))  # noqa: E731  depends on what stands before
    whole, at = chat.spans(turns, counted)
    assert [whole[a:b] for a, b in at] == [f"[{i}]t{i}" for i in range(300)]
    last_only = lambda t: "".join(f"<{x}>" if i < len(t) - 1 else f"<{x}!>" for i, (_, x) in enumerate(t))
    assert chat.spans(turns, last_only) == (last_only(turns), None)
    assert chat.spans([], header) == ("BEGIN ", [])


@pytest.mark.parametrize("n", [1, 64, 100, 131, 192, 299])
def test_chat_finds_one_rewriting_prefix(n):
    turns = [("user", f"t{i}") for i in range(300)]
    once = lambda t: chat.chatml(t) + ("(cont)" if len(t) == n else "")
    assert chat.spans(turns, once) == (once(turns), None)


def test_chat_very_long_conversation_and_turn():
    turns = [("user", "x<|" * 100_000), *(("assistant", f"t{i}") for i in range(3000))]
    whole, at = chat.spans(turns[1:], chat.chatml)
    assert [whole[a:b] for a, b in at] == [chat.chatml([t]) for t in turns[1:]]
    assert [(r, t) for r, t, _, _ in chat.read_chatml(chat.spans(turns[:3], chat.chatml)[0])] == turns[:3]


def test_chat_frame(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "n"), (None, 1, "assistant", "<|im_end|>"), (1, 0, "user", "a"), *((7, i, "assistant", f"x{i}") for i in range(500))]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    alone = [x for x in chat.format_conversations(df).collect() if x.conv_id is None]
    assert sorted((t, x.roles) for x in alone for _, t, _, _ in chat.read_chatml(x.formatted)) == [("<|im_end|>", ["assistant"]), ("n", ["user"])] and len(alone) == 2
    got = {x.conv_id: x for x in chat.format_conversations(df).collect()}
    assert [t for _, t, _, _ in chat.read_chatml(got[1].formatted)] == ["a", "a", "b"]
    assert [t for _, t, _, _ in chat.read_chatml(got[7].formatted)] == [f"x{i}" for i in range(500)]
    assert got[2].roles == [""] and not got[7].rewrites
    assert hashlib.sha256(got[7].formatted.encode()).hexdigest() == hashlib.sha256(chat.chatml([("assistant", f"x{i}") for i in range(500)]).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def water(sizes, weights, share, epochs):
    left, target, open_ = Fraction(share) * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while open_ and left > 0:
        level, total = left, sum(weights[i] for i in open_)
        for i in sorted(open_):
            target[i] += level * Fraction(weights[i], total)
        left = Fraction(0)
        for i in sorted(open_):
            if target[i] >= epochs * sizes[i]:
                left += target[i] - epochs * sizes[i]
                target[i] = Fraction(epochs * sizes[i])
                open_.discard(i)
    return target


def test_mixing(spark):
    rows = [*texts(), (None, "a b c"), (3, "again the same id"), (3, "again the same id")]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    src = {}
    for i, t in rows:
        s = f"s{(i or 0) % 3}" if i != 4 else "￿"
        size[s] += len(WORD.findall(t or ""))
        src[i] = s
    names = sorted(size)
    target = dict(zip(names, water([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], Fraction(3, 2), 2), strict=True))
    taken = Counter()
    for x in got:
        assert 0 <= x.taken <= 2 * x.size and x.source_size == size[src[x.doc_id]] and abs(x.target - float(target[src[x.doc_id]])) < 1e-6
        taken[src[x.doc_id]] += x.taken
    assert {s: math.floor(t) for s, t in target.items()} == dict(taken)
    assert Counter(map(tuple, mixing.mix(df.repartition(5)).collect())) == Counter(map(tuple, got))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [x.taken for x in mixing.mix(spark.createDataFrame([(1, None, "e", None, 0), (2, "", "e", "s", 0)], DOCS)).collect()] == [0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_mixing_row_by_row_with_hot_ids(spark, seed):
    r = random.Random(seed)
    some = [r.choice((None, 7, 7, 7, 8, i)) for i in range(400)]
    rows = [(i, r.choice(("a", "b", None)), " ".join("x" * r.choice((0, 2, 2, 2, 9)))) for i in some]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in rows], DOCS).repartition(7)
    got = mixing.mix(df, weights=(3, 1), share=r.choice((0.3, 0.9, 1.6)), epochs=2).collect()
    target = {x.source_size: x.target for x in got}
    assert len(target) == 3  # the sources differ in size here
    want = Counter()
    for source in ("a", "b", None):
        own = [(i, t, len(t.split())) for i, s, t in rows if s == source]
        size = sum(n for _, _, n in own)
        full, rest = divmod(math.floor(target[size]), size)
        digest = lambda i, t: hashlib.md5((str(i) if i is not None else "null" + t).encode()).hexdigest()
        for i, _, n in sorted(own, key=lambda x: (digest(x[0], x[1]), x[2])):
            want[i, n, size, full * n + min(n, rest)] += 1
            rest -= min(n, rest)
    assert Counter((x.doc_id, x["size"], x.source_size, x.taken) for x in got) == want


def test_toxicity(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice(("on", "er", "th", "ea", "in", "st")) for _ in range(r.randint(1, 4)))
    rows, marks = [], []
    for i in range(500):
        w, bad = [word() for _ in range(r.randint(5, 120))], i % 4 == 0
        for _ in range(r.randint(2, 5) if bad else 0):
            w[r.randrange(len(w))] = r.choice(("grumpf", "Zzark" + word()))  # the second only by its characters
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "one two"), rows[0]]
    df = clashing(spark, rows)
    labels = spark.createDataFrame([*marks, (None, 1), (2, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    scored = toxicity.score(df, net)
    assert scored.columns == [*df.columns, "toxicity_score"]
    got = {x.doc_id: x.toxicity_score for x in scored.collect()}
    out = [(i, t) for i, t in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == t for i, t in out]) > 0.95
    assert got[1000] == got[1001] == got[1002] == 0 and 0 <= got[None] <= 1
    assert {x.toxicity_score for x in toxicity.score(df, toxicity.fit(df, labels.limit(0))).collect()} == {0.0, 0.5}
    assert toxicity.score(df.limit(0), net).count() == 0


def plain_toxicity(net, text):
    """The highest window's probability by loops over Python numbers; hashed rows as Vocabulary gives them for one word."""
    import pyarrow as pa

    words = WORD.findall(text or "")
    if not words:
        return 0.0
    p, sig, n = {k: np.asarray(x, np.float64) for k, x in net.p.items()}, lambda x: 1 / (1 + math.exp(-x)), toxicity.STATE
    vectors = {}
    for w in set(words):
        v = toxicity.Vocabulary(pa.array([w]))
        grams = sum((p["gram"][g] for g in v.grams), np.zeros(toxicity.WIDTH)) / math.sqrt(max(1, len(v.grams)))
        vectors[w] = [*p["word"][v.word[0]], *grams]
    best = -math.inf
    for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        some = words[start : start + toxicity.WINDOW]
        states = []
        for d, order in ((0, range(len(some))), (1, reversed(range(len(some))))):
            h, out = [0.0] * n, {}
            for t in order:
                gate = [sum(x * p["W"][i][3 * n * d + j] for i, x in enumerate(vectors[some[t]])) + p["bias"][3 * n * d + j] for j in range(3 * n)]
                back = [sum(h[i] * p["U"][d][i][j] for i in range(n)) for j in range(3 * n)]
                z, r = ([sig(gate[k * n + j] + back[k * n + j]) for j in range(n)] for k in (0, 1))
                c = [math.tanh(gate[2 * n + j] + r[j] * back[2 * n + j]) for j in range(n)]
                h = out[t] = [(1 - z[j]) * h[j] + z[j] * c[j] for j in range(n)]
            states.append(out)
        both = [states[0][t] + states[1][t] for t in range(len(some))]
        e = [math.exp(sum(a * b for a, b in zip(s, p["a"], strict=True))) for s in both]
        pooled = [sum(x * s[j] for x, s in zip(e, both, strict=True)) / sum(e) for j in range(2 * n)]
        best = max(best, sum(a * b for a, b in zip(pooled, p["w"], strict=True)) + p["b"][0])
    return sig(best)


def test_toxicity_scores_as_plain_loops_do(spark):
    r = random.Random(7)
    some = [" ".join("".join(r.choice("abCé.") for _ in range(r.randint(1, 9))) for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 70)]
    net = toxicity.Network.new(3)
    rows = toxicity.score(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), net).collect()
    assert all(abs(x.toxicity_score - plain_toxicity(net, x.text)) < 1e-4 for x in rows)


def test_toxicity_slopes():
    """backward() against differences of forward(), in doubles."""
    r = np.random.default_rng(2)
    net = toxicity.Network({k: x.astype(np.float64) for k, x in toxicity.Network.new(1).p.items()})
    gates, mask = r.normal(size=(6, 3, 6 * toxicity.STATE)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0], [1, 0, 0]], np.float64)
    d = r.normal(size=3)
    _, held = net.forward(gates, mask, keep=True)
    grad, dg = net.backward(d, held)
    for name, x, g in (*((k, net.p[k], grad[k]) for k in ("w", "b", "a", "U")), ("gates", gates, dg)):
        for i in r.integers(0, x.size, 20):
            at = np.unravel_index(i, x.shape)
            y = x[at]
            both = []
            for step in (1e-5, -1e-5):
                x[at] = y + step
                both.append((net.forward(gates, mask)[0] * d).sum())
            x[at] = y
            assert abs((both[0] - both[1]) / 2e-5 - g[at]) < 2e-3, name


def test_windows_cover_whole_texts():
    import pyarrow as pa

    v = toxicity.Vocabulary(pa.array([" ".join(map(str, range(n))) for n in (0, 1, 31, 32, 33, 48, 49, 200)]))
    start, size, text = v.windows()
    for i in range(8):
        covered = {k for s, n in zip(start[text == i], size[text == i], strict=True) for k in range(s, s + n)}
        assert covered == set(range(v.first[i], v.first[i + 1]))


def test_vocabulary_takes_texts_in_pieces(monkeypatch):
    """Room on the way in is some times the texts' size, not dozens; pieces of any size give the same."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(3)
    many = pa.array([" ".join(f"w{r.randrange(200_000)}" for _ in range(300)) for _ in range(2000)], pa.large_string())
    tracemalloc.start()
    toxicity.Vocabulary(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * many.nbytes
    for some in ([t for _, t in texts()], [], [None], ["", None, " "], ["x"], ["", "a b", "ab"], [None, "x y", None, "z"]):
        column, seen = pa.array(some, pa.large_string()), []
        for size in ((1_000_000, 20_000), (100, 7), (1, 1)):
            for name, n in zip(("PIECE_BYTES", "PIECE_WORDS"), size, strict=True):
                monkeypatch.setattr(toxicity, name, n)
            v = toxicity.Vocabulary(column)
            seen.append([x.tolist() for x in (v.first, v.ids, v.word, v.grams, v.gram_first)] + [x.tolist() for x in v.windows()])
        assert seen[0] == seen[1] == seen[2]


def test_lm(spark):
    r = random.Random(8)
    chain = {w: r.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}

    def text(n):
        w = ["a"]
        for _ in range(n):
            w.append(r.choice(chain[w[-1]]) if r.random() < 0.9 else f"rare{r.randrange(2000)}" and r.choice("abcdefghijklmnop"))
        return " ".join(w)

    rows = [(i, text(r.randint(0, 200))) for i in range(300)] + [(300, None), (301, ""), (302, "only UNSEEN words"), (None, "a b"), (3, "a repeated id")]
    got = lm.score(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    out = [x for x in got if x.held_out]
    assert sum(x.score for x in out) > 0.8 * sum(x.base_score for x in out)
    assert lm.score(clashing(spark, rows).limit(0)).count() == 0


def small_model(spark):
    """Training rows of which the words in slice k are its own, and what is learnt from them."""
    r = random.Random(3)
    rows = [(k, " ".join(f"left{k} right{k} " + r.choice((f"Rare{i}x{k}ung", f"rare{i % 7}.", "the")) for i in range(200)), False) for k in range(3 * lm.SLICES)]
    docs = spark.createDataFrame([*rows, (99, "left0 never seen, RARE3.", True)], "doc_id long, text string, held_out boolean").repartitionById(lm.SLICES, F.col("doc_id").cast("int"))
    base = cut(lm.tokenised(docs))
    cluster = lm.clusters_of(base)
    words = lm.vocabulary(base, cluster, lm.SLICES)
    return rows, words, lm.fit(base, words, cluster)


@pytest.fixture(scope="module")
def small(spark):
    return small_model(spark)


def test_lm_learns_words_of_every_slice(small):
    import pyarrow as pa

    model = small[2][0]
    for k in range(lm.SLICES):
        t = lm.Tokens.of(pa.array([f"left{k} right{k}"]))
        kind, place = (x[t.ids] for x in model.place(t.keys))
        assert place[1] >= 0
        assert model.words[model.in_features(t, np.array([1]), kind[1:2])[0, 0]].any(), k


def plain_mix(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain_log(m, tables, keys, counts):
    """log p of the tokens `keys` of one text, one after another; counts: {(key, cluster before): n}."""
    m64, bits, in_bits = (1 << 64) - 1, (len(m.classes) - lm.SUFFIXES).bit_length() - 1, len(m.words).bit_length() - 1
    rank, out = {int(k): i for i, k in enumerate(m.head)}, []
    word = Counter()
    for (k, _), n in counts.items():
        word[k] += n
    for i, k in enumerate(keys):
        a, b = keys[i - 1] if i > 0 else 1, keys[i - 2] if i > 1 else 1
        rows = [plain_mix(a + 11 & m64) >> 64 - bits, plain_mix(plain_mix(a + 11 & m64) + 3 * b & m64) >> 64 - bits, plain_mix(b + 13 & m64) >> 64 - bits, len(m.classes) - lm.SUFFIXES + a % lm.SUFFIXES]
        logits = [float(m.bias[c]) + sum(float(m.classes[r][c]) for r in rows) for c in range(lm.CLASSES)]
        c = rank[k] // lm.IN_CLASS if k in rank else lm.HEAD_CLASSES + int(m.cluster[k % lm.SUFFIXES])
        lp = logits[c] - math.log(sum(math.exp(x) for x in logits))
        if k in rank:
            s = plain_mix(c + 71)
            rows = [plain_mix((x ^ s) & m64) >> 64 - in_bits for x in (a + 1, b + 2, a % lm.SUFFIXES + 3)]
            logits = [float(m.in_bias[c][j]) + sum(float(m.words[r][j]) for r in rows) for j in range(lm.IN_CLASS)]
            lp += logits[rank[k] % lm.IN_CLASS] - math.log(sum(math.exp(x) for x in logits))
        else:
            after, kind = int(m.cluster[a % lm.SUFFIXES]), c - lm.HEAD_CLASSES
            lp += math.log(word[k] + 0.5) + plain_tail(m, tables, kind, after, word[k], counts.get((k, after), 0)) - math.log(tables[-1][kind][after])
        out.append(lp)
    return out


def plain_tail(m, tables, kind, after, n, both):
    w = 0.0
    for z in tables[:-1] if both else []:
        e = m.seen[kind][after] * (n + 0.5) * math.exp(w) / z[kind][after]
        w += min(2.0, max(-2.0, (both - e - lm.SHRINK * w) / (e + lm.SHRINK)))
    return w


def test_lm_scores_as_plain_loops_do(small):
    """Counts, the tail classes' tables and every token's log p, against loops over Python numbers."""
    import pyarrow as pa

    rows, words, (m, total, kinds) = small
    keys_of = lambda t: [int(t.keys[i]) for i in t.ids]
    counts, head = Counter(), set(m.head.tolist())
    for row in rows:
        k = keys_of(lm.Tokens.of(pa.array([row[1]])))
        counts.update((x, int(m.cluster[(k[i - 1] if i else 1) % lm.SUFFIXES])) for i, x in enumerate(k))
    word = Counter()
    for (k, _), n in counts.items():
        word[k] += n
    assert (total, kinds) == (sum(word.values()), len(word))
    tail = [k for k in word if k not in head]
    assert len(tail) > 50 and len(head) == lm.HEAD_CLASSES * lm.IN_CLASS
    kind = lambda k: int(m.cluster[k % lm.SUFFIXES])
    tables = [[[0.5 + sum(word[k] + 0.5 for k in tail if kind(k) == g)] * lm.TAIL_CLASSES for g in range(lm.TAIL_CLASSES)]]
    for _ in range(lm.TAIL_STEPS):
        now = [list(x) for x in tables[0]]
        for (k, after), n in counts.items():
            if k not in head:
                now[kind(k)][after] += (word[k] + 0.5) * math.expm1(plain_tail(m, [*tables, None], kind(k), after, word[k], n))
        tables.append(now)
    assert np.allclose(m.tables, tables)
    parts = [lm._unpacked(b) for b in pa.Table.from_pylist([r.asDict() for r in words.where("shard = 1").collect()]).to_batches()]
    text = lm.Tokens.of(pa.array([" ".join(rows[1][1].split()[5:40] + rows[1 + lm.SLICES][1].split()[-20:])]))
    c, inside = lm.Counts(parts, m).of(text)
    assert c.tolist() == [word[k] for k in keys_of(text)]
    assert np.allclose(m.log(text, inside), plain_log(m, tables, keys_of(text), counts), atol=1e-4)


def test_lm_slope_is_that_of_the_log_probability():
    import pyarrow as pa

    r = np.random.default_rng(4)
    t = lm.Tokens.of(pa.array(["a b c a b d", "b a. c"]))
    m = lm.Model(t.keys[:4], r.integers(0, lm.TAIL_CLASSES, lm.SUFFIXES), r.normal(size=(8 + lm.SUFFIXES, lm.CLASSES)), r.normal(size=(8, lm.IN_CLASS)), r.normal(size=lm.CLASSES), r.normal(size=(lm.HEAD_CLASSES, lm.IN_CLASS)), None)
    c, w = np.zeros(m.classes.shape[::-1]), np.zeros(m.words.shape[::-1])
    lm.slope(m, t, np.arange(len(t.ids)), c, w)
    whole = lambda: m.log(t, np.zeros(len(t.ids))).sum()
    for x, g in ((m.classes, c), (m.words, w)):
        for _ in range(25):
            i, j = r.integers(0, 8), r.integers(0, x.shape[1])
            x[i, j] += 1e-4
            up = whole()
            x[i, j] -= 2e-4
            down = whole()
            x[i, j] += 1e-4
            assert abs((up - down) / 2e-4 - g[j, i]) < 1e-3


def test_lm_is_a_distribution(spark):
    """Over all known tokens and an unseen one of each tail class the probabilities of any context add up to 1."""
    import pyarrow as pa

    r = random.Random(5)
    rows = [(i, " ".join(f"w{min(int(r.expovariate(0.004)), 1500)}{r.choice(('a', 'ing', 'ed'))}" for _ in range(400)), False) for i in range(20)]
    base = cut(lm.tokenised(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)))
    cluster = lm.clusters_of(base)
    words = lm.vocabulary(base, cluster, 1)
    m, _, kinds = lm.fit(base, words, cluster)
    assert kinds > lm.HEAD_CLASSES * lm.IN_CLASS
    counts = lm.Counts([lm._unpacked(b) for b in pa.Table.from_pylist([x.asDict() for x in words.where("shard = 0").collect()]).to_batches()], m)
    known = sorted({w for x in rows for w in x[1].split()})
    t = lm.Tokens.of(pa.array([f"{known[3]} {known[9]} {w}".strip() for w in [*known, ""]]))
    third = t.first[:-1] + 2
    total = np.exp(m.log(t, counts.of(t)[1]))[third].sum()
    unseen = lm.Tokens.of(pa.array([f"{known[3]} {known[9]}"]))
    kind, rows_of, some, _, inner = m.known(unseen, np.arange(len(unseen.ids)))
    _, _, p, _ = next(m.blocks(kind, rows_of, some, inner))
    after = m.cluster[lm._suffix(unseen.keys)][unseen.before(1)[2]]
    total += sum(p[lm.HEAD_CLASSES + g, 2] / p[:, 2].sum() * 0.5 / m.tables[-1][g, after] for g in range(lm.TAIL_CLASSES))
    assert abs(total - 1) < 1e-3
