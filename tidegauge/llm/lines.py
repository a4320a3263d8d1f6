"""Line dedup: a segment-partition edit join of the distinct lines, verified with banded bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.jaccard import by_block
from tidegauge.llm.shared import broadcast_up_to, cut, fresh, trim
from tidegauge.llm.textops import mix64, powers, slices

#: Rows (16 to 24 bytes each) that may be broadcast; beyond, joins are shuffled.
SMALL = 200_000
BLOCK_LINES, BLOCK_CHARS = 1024, 1_000_000
#: Most edits between near lines, and code points of the shorter line for each.
EDITS, PER_EDIT = 2, 10


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, and n + 1 offsets."""
    data = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(lines) + 1, np.int64)
    np.cumsum([len(x) for x in lines], out=offsets[1:])
    return data, offsets


def signatures(lines: list[str], edits: int = EDITS, per_edit: int = PER_EDIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, line, indexed): the substring index of the lines' segments, and the probes into it.

    A line of n code points has t = min(edits, n // per_edit) edits to give and is cut into t + 1 segments of nearly equal length; these
    are indexed under n and their number. A line at most t longer, and t edits away, holds one of them unchanged, not far from its place:
    at most i - 1 edits lie before segment i or at most t + 1 - i after it, which bounds how far it has moved. So a line probes, for
    each such length, the few substrings of its own that lie in these bounds.
    """
    codes, offsets = _codes(lines)
    p, q = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], out=sums[1:])
    size, out = np.diff(offsets), []
    for longer in range(edits + 1):
        for t in range(1, edits + 1):
            n = size - longer  # the shorter, indexed length
            who = np.flatnonzero((np.minimum(edits, n // per_edit) == t) & (longer <= t))
            if not len(who):
                continue
            m = n[who]
            for i in range(1, t + 2):
                a, b = (i - 1) * m // (t + 1), i * m // (t + 1)
                for shift in range(max(-(i - 1), longer - (t + 1 - i)), min(i - 1, longer + (t + 1 - i)) + 1):
                    ok = (a + shift >= 0) & (b + shift <= size[who])
                    s, e = (offsets[who] + a + shift)[ok], (offsets[who] + b + shift)[ok]
                    sig = mix64((sums[e] - sums[s]) * q[s] + mix64((m[ok] * 8 + i).astype(np.uint64)))
                    out.append((sig, who[ok], np.full(len(s), longer == 0 and shift == 0)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def within(codes: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether lines x[i] and y[i] are at most edits[i] edits apart, for many pairs at once.

    Bit-parallel over a band of diagonals: bit d + k of level e says that a prefix of x and the prefix of y that is d longer are at most
    e edits apart. A code point of x moves all diagonals of a level on in a few operations on one byte: an equal code point keeps the level;
    a substitution, a deletion (a diagonal less) or an insertion (a diagonal more) comes from the level before.
    """
    k = int(edits.max(initial=0))
    m, n = offsets[x + 1] - offsets[x], offsets[y + 1] - offsets[y]
    good = np.zeros(len(x), bool)
    near = np.abs(m - n) <= edits
    for at in np.array_split(order := np.flatnonzero(near)[np.argsort(m[near], kind="stable")], max(1, len(order) // 4096)):
        if not len(at):
            continue
        mm, nn, ox, oy = m[at], n[at], offsets[x[at]], offsets[y[at]]
        level = [np.full(len(at), sum(1 << (d + k) for d in range(e + 1)), np.uint8) for e in range(k + 1)]
        for i in range(int(mm.max(initial=0))):
            own = codes[np.minimum(ox + i, len(codes) - 1)]
            same = np.zeros(len(at), np.uint8)
            for d in range(-k, k + 1):
                j = i + d
                if j >= 0:
                    same |= ((own == codes[np.minimum(oy + j, len(codes) - 1)]) & (j < nn)).astype(np.uint8) << np.uint8(d + k)
            before, now, on = None, [], i < mm
            for e in range(k + 1):
                step = level[e] & same
                if e:
                    step |= level[e - 1] | (level[e - 1] >> np.uint8(1)) | (before << np.uint8(1))
                before = step & np.uint8((1 << (2 * k + 1)) - 1)
                now.append(np.where(on, before, level[e]))
            level = now
        good[at] = np.choose(edits[at], level) >> (nn - mm + k).astype(np.uint8) & 1
    return good


def near_pairs(lines: list[str], run: np.ndarray, side: np.ndarray, indexed: np.ndarray, edits: int = EDITS, per_edit: int = PER_EDIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of near lines of the same run, which are the lines that share an entry of the index; one of the pair stands in it, the other may only probe it. Runs follow one another. side: negative, or of lines with the same side no pairs are wanted."""
    codes, offsets = _codes(lines)
    size = np.diff(offsets)
    bag = np.zeros((len(lines), 64), np.int16)  # an edit changes at most two counts by one
    np.add.at(bag, (np.repeat(np.arange(len(lines)), size), codes & 63), 1)
    first = np.r_[np.flatnonzero(np.r_[True, run[1:] != run[:-1]]), len(run)] if len(run) else np.zeros(1, np.int64)
    kept, held = [], 0

    def verify() -> tuple[np.ndarray, np.ndarray]:
        new = np.unique(np.concatenate(kept))
        a, b = new // len(lines), new % len(lines)
        yes = within(codes, offsets, a, b, np.minimum(edits, np.minimum(size[a], size[b]) // per_edit))
        return a[yes], b[yes]

    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        w = np.arange(s, e)
        for i in np.flatnonzero(indexed[s:e]).tolist():
            # of two lines that both stand in the index the earlier one here finds the other
            rest = w[(~indexed[s:e]) | (w > s + i)]
            rest = rest[(np.abs(size[rest] - size[s + i]) <= edits) & ((side[rest] < 0) | (side[rest] != side[s + i]))]
            if len(rest):
                rest = rest[np.abs(bag[rest] - bag[s + i]).sum(1) <= 2 * edits]
            if len(rest):
                kept.append((s + i) * len(lines) + rest)
                held += len(rest)
        if held > 100_000:
            yield verify()
            kept, held = [], 0
    if kept:
        yield verify()


def met_lines(docs: DataFrame, edits: int, per_edit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(firsts, lines, dealt): where each distinct line stands first; all lines; and the distinct lines that share an entry of the index with another, by entry."""
    base = docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    lines = base.select("doc", F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.where(~F.col("line").rlike(r"^[\x20\x09-\x0D]*$")).withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("line"), "line"))
    where = F.struct("doc", "no")
    firsts = cut(lines.groupBy("h", "h2").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")), "lines")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1_000_000):
                all_lines = list({x for t in batch.column("text").to_pylist() for x in t.split("\n") if len(x) >= per_edit and x.strip(" \t\n\v\f\r")})
                sig, who, indexed = signatures(all_lines, edits, per_edit)
                ids = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in all_lines], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[who]), pa.array(indexed)], ["sig", "h", "indexed"])
        trim()

    signed = base.select("text").mapInArrow(sign, "sig long, h long, indexed boolean")
    shared = signed.groupBy("sig").agg(F.min("h").alias("a"), F.max("h").alias("z"), F.max("indexed").alias("indexed"))
    shared = cut(shared.where("indexed and a < z").select("sig"), "signatures")
    hits = cut(signed.join(broadcast_up_to(shared, SMALL), "sig").groupBy("sig", "h").agg(F.max("indexed").alias("indexed")), "hits")
    some = lines.join(broadcast_up_to(cut(hits.select("h").distinct(), "hit-lines"), SMALL), "h")
    held = cut(some.groupBy("h", "h2").agg(F.min(F.struct("doc", "no", "line")).alias("f")).select("h", "h2", F.col("f.doc").alias("doc"), F.col("f.no").alias("no"), F.col("f.line").alias("line")), "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_LINES, F.sum("length") / BLOCK_CHARS)).cast("int")
    lengths = broadcast_up_to(held.select("h", F.length("line").alias("length")), SMALL)
    sizes = broadcast_up_to(cut(hits.join(lengths, "h").groupBy("sig").agg(blocks.alias("blocks")).where("blocks > 1"), "blocks"), SMALL)
    return firsts, lines, _dealt(hits, held, sizes)


def _dealt(hits: DataFrame, held: DataFrame, sizes: DataFrame) -> DataFrame:
    """The lines of each entry of the index, in blocks of bounded size: a line goes to every pair (i, j) of blocks that its own is one of."""
    dealt = hits.join(held, "h").join(sizes, "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("h2"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.col("sig").alias("family"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "indexed", "h", "h2", "doc", "no", "line")


def near_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """(doc, text_id, no): the lines of docs (doc_id, text) that repeat, or nearly repeat, an earlier one.

    See without_repeated_lines. doc is doc_id, text_id a hash of the text, so that rows that share a doc_id keep their own lines.
    """
    firsts, lines, dealt = met_lines(docs, edits, per_edit)
    where = F.struct("doc", "no")

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        family, i, j, side, indexed = (t.column(c).to_numpy() for c in ("family", "i", "j", "side", "indexed"))
        run = np.cumsum(np.r_[0, (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        h, h2, doc, no, text = (t.column(c).to_pylist() for c in ("h", "h2", "doc", "no", "line"))
        place = [(d is not None, d or 0, x) for d, x in zip(doc, no, strict=True)]
        best: dict[int, int] = {}
        for a, b in near_pairs(text, run, np.where(i == j, -1, side), indexed, edits, per_edit):
            for early, late in zip(a.tolist(), b.tolist(), strict=True):
                if place[early] > place[late]:
                    early, late = late, early
                if place[early] < place[late] and (late not in best or place[early] < place[best[late]]):
                    best[late] = early
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in ix], k) for v, ix, k in ((h, best, pa.int64()), (h2, best, pa.int64()), (doc, best.values(), pa.int64()), (no, best.values(), pa.int32()))], ["h", "h2", "doc", "no"])

    near = by_block(dealt, work, "h long, h2 long, doc long, no int", 2 * BLOCK_LINES).groupBy("h", "h2").agg(F.min(where).alias("near"))
    again = firsts.join(cut(near, "near"), ["h", "h2"], "left").where("n > 1 or near is not null")
    again = cut(again.select("h", "h2", F.coalesce(F.least("first", "near"), "first").alias("earliest")), "repeated")
    return lines.select("doc", "text_id", "no", "h", "h2").join(broadcast_up_to(again, SMALL), ["h", "h2"]).where(where > F.col("earliest")).select("doc", "text_id", "no")


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, counts: bool = True) -> DataFrame:
    """docs, all columns, with the lines taken out of text that repeat or nearly repeat an earlier one; counts: adds n_lines and n_removed, for which columns of these names, in any case, give way.

    Lines end at line feeds. A line goes if a line that stands earlier (in a smaller doc_id, or before it in the same document), itself
    removed or not, is at most t edits (insertions, deletions, substitutions of code points) away: t = min(edits, n // per_edit), n the length of
    the shorter one, so lines under per_edit code points go only if they are equal. Lines of nothing but white space stay.

    Distinct lines meet in the substring index (see signatures): entries that two lines share are found by a minimum and a maximum with partial aggregation, and the lines of
    each such entry are compared in blocks of bounded size (see near_pairs and within), an entry at a time: lines that only a chain of entries joins never meet.

    Null text stays null and has no line. Empty text: one empty line. A null doc_id stands before all others. Rows that share a doc_id stand
    side by side: line 3 of one isn't earlier than line 3 of the other. A document all of whose lines go stays, with an empty text. An empty table gives an empty result.
    """
    gone = near_lines(docs.select("doc_id", "text"), edits, per_edit).groupBy("doc", "text_id").agg(F.collect_set("no").alias("gone"))
    ident, drop, new = fresh(docs, "_id"), fresh(docs, "_gone"), fresh(docs, "_new")
    gone = cut(gone.select(F.struct(F.col("doc").alias("d"), F.col("text_id").alias("t")).alias(ident), F.col("gone").alias(drop)), "gone")
    own = F.struct(F.col("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    joined = docs.withColumn(ident, own).join(gone, ident, "left")
    joined = joined.withColumn(new, F.pandas_udf(_kept, "text string, n_lines long, n_removed long")(F.col("text"), F.col(drop)))
    added = ["n_lines", "n_removed"] if counts else []
    rest = [F.col(f"{new}.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    return joined.select(*rest, *[F.col(f"{new}.{c}").alias(c) for c in added])


def _kept(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    out = []
    for t, g in zip(text, gone, strict=True):
        lines = t.split("\n") if t is not None else []
        drop = set() if g is None else set(g)
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in drop) if t is not None else None, len(lines), len(drop)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])
