"""Rows that every text operator must bear: nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, source string, h long, sig string, family int, node string, n long, kind int, key int, w string, shard int, component string, _id int, part int, a int, b int, size int, target string"


def texts(seed: int = 5, n: int = 60) -> list:
    """(doc_id, text) with copies, near copies, shared passages and odd cases."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    base = [[word() for _ in range(r.randint(1, 120))] for _ in range(n // 3)]
    passage = [word() for _ in range(45)]
    out = []
    for i in range(n):
        w = list(base[i % len(base)])
        for _ in range(r.choice((0, 0, 1, 2, 6))):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        out.append((i, " ".join(x.upper() if r.random() < 0.05 else x for x in w).replace(" ", "\n", r.randint(0, 9))))
    long = " ".join(word() for _ in range(30_000))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "x"), (n + 4, "a " * 100), (n + 5, long), (n + 6, long[len(long) // 2 :]), (n + 7, "Nur ein Wort"), (n + 8, out[0][1])]


def frame(spark, rows):
    """documents of (doc_id, text), two files wide."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, len(t or "")) for i, t in rows], DOCS).repartition(3)


def clashing(spark, rows):
    """The same with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "s", 1, "x", 2, "y", 3, 4, 5, "z", 6, "c", 7, 8, 9, 10, 11, "t") for i, t in rows], CLASH)
