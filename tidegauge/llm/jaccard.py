"""N-gram Jaccard join of a corpus with itself: similar documents in groups, a token-group matrix that bounds, exact sets for what it opens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.graph import connected_components
from tidegauge.llm.shared import broadcast_up_to, cut, drop_cut, fresh, trim
from tidegauge.llm.textops import Words, mix64, runs, slices, utf8

#: Rows (16 to 24 bytes each) that may be broadcast; beyond, joins are shuffled.
SMALL = 200_000
#: Sets and tokens of them that a task compares at once, and sets in a group of the matrix.
BLOCK_SETS, BLOCK_TOKENS, GROUP = 1024, 1_000_000, 32
#: Frequent shingles that are told apart from the others, half a megabyte.
COMMON = 65_536
#: Slices of the parts, by hash. Passes over the parts send one after another what they hold of slices, of this many parts at least; rounds over the blocks send this many tokens at least.
SLICES, PASS, ROUND = 8, 4_000_000, 16_000_000


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted hashes: runs of `width` words, A-Z in lower case; fewer words are one shingle, no words none."""
    words = Words(*utf8(column), lower=True)
    all_runs = runs(words.hash, width)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(all_runs[a : b - width + 1])
        elif b > a:
            yield runs(words.hash[a:b], b - a)
        else:
            yield words.hash[:0]


def size_classes(percent: int, most: int) -> list[tuple[int, int, int]]:
    """(largest size, differing tokens at most, parts) of each class of set sizes, a factor of about 1.4 wide."""
    out, low = [], 1.0
    while low <= most:
        low *= 2**0.5
        top = int(np.ceil(low)) - 1
        if top >= 1 and (not out or top > out[-1][0]):
            d = top * (100 - percent) // percent
            out.append((top, d, 1 + d + -(-3 * (d > 0) * (d + 1) // 10)))
    return out


_CLASSES: dict[int, list[tuple[int, int, int]]] = {}


def part_hashes(s: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of a set's parts, such that two different sets whose Jaccard similarity reaches percent / 100 share one.

    Of sets up to u tokens and their partners, of up to u / threshold, no two linked ones differ in more than
    d = u * (1 / threshold - 1) tokens. Tokens are dealt by hash into somewhat more than d + 1 parts, and of any d + 1 of them one is the same in both.
    A part is as strong as it has tokens that aren't in `common` (sorted; any tokens that are frequent, so that a shared passage joins no families; weaker are parts of common tokens, weakest empty ones).
    A set leaves out its weak parts as long as d + 1 stay: the highest strength counts that so many reach. Equal parts are equally strong, so
    a part that is the same in both, and that the set with the higher bar keeps, is kept by the other too.
    A set has parts for its own size class and for each lower class that its smaller partners can be in. Classes without differences are left out: only equal sets link there.
    """
    n = len(s)
    if percent not in _CLASSES or _CLASSES[percent][-1][0] < n:
        _CLASSES[percent] = size_classes(percent, 2 * n)
    classes, out = _CLASSES[percent], []
    rare = np.ones(n, np.int64)
    if common is not None and len(common):
        rare[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s] = 0
    own = next(i for i, c in enumerate(classes) if n <= c[0])
    for i in range(own, -1, -1):
        top, d, k = classes[i]
        if percent * n > 100 * top:  # larger than any partner of the class
            break
        if not d:
            continue
        m = mix64(s + np.uint64(i + 1))
        part = (((m >> np.uint64(33)) * np.uint64(k)) >> np.uint64(31)).astype(np.int64)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, part, m)
        strength = 2 * np.minimum(np.bincount(part, rare, k), 4) + (np.bincount(part, minlength=k) > 0)
        bar = np.sort(strength)[k - d - 1]
        out.append(mix64(sums ^ mix64(np.arange(k, dtype=np.uint64) + np.uint64((i + 1) << 32)))[strength >= bar])
    return np.concatenate(out) if out else s[:0]


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """At most COMMON shingles, sorted: those that the most documents of a sixteenth of the corpus hold, three at least. Which they are changes the work, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x = list(sets_of(batch.column("text"), width))
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64))], ["s"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).select("text").mapInArrow(run, "s long")
    top = sample.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "s").limit(COMMON).select("s").collect()
    return np.sort(np.array([r.s for r in top], np.int64).view(np.uint64))


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, m, parts0, parts1, ...) of every row: set size, 128 bits that name the set, how many part_hashes it has, and these in SLICES columns, so that a slice is read alone."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))  # at most COMMON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                n, k1, k2, parts = [], [], [], []
                for s in sets_of(batch.column("text"), width):
                    n.append(len(s))
                    k1.append(mix64(s).sum(dtype=np.uint64))
                    k2.append(np.bitwise_xor.reduce(mix64(s + np.uint64(0x51)), initial=np.uint64(0)))
                    parts.append(part_hashes(s, percent, common.value) if len(s) else s)
                m = np.array([len(p) for p in parts], np.int64)
                row, values = np.repeat(np.arange(len(n)), m), np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                at, columns = values % np.uint64(SLICES), []
                for i in range(SLICES):
                    offsets = np.zeros(len(n) + 1, np.int32)
                    np.cumsum(np.bincount(row[at == i], minlength=len(n)), out=offsets[1:])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[at == i].view(np.int64))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)), pa.array(m), *columns], ["doc_id", "n", "k1", "k2", "m", *(f"parts{i}" for i in range(SLICES))])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, m long" + "".join(f", parts{i} array<long>" for i in range(SLICES)))


class Union:
    """Union-find; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def link(sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Edges between positions that connect exactly what the links among sets connect; side: with two values, links within one side don't count.

    The token-group matrix: sets stand in order of their smallest hashes, so that similar ones are neighbours, and GROUP
    of them are a group with the union of its tokens. A set can only link into a group whose union holds percent of its tokens. The
    groups that qualify are opened: exact intersections with each member, save for sets that are already connected.
    """
    order = sorted(range(len(sets)), key=lambda i: (sets[i][:3].tolist(), len(sets[i]), i))
    own = [sets[i] for i in order]
    n = np.array([len(s) for s in own])
    first = np.zeros(len(own) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    vocabulary, flat = np.unique(np.concatenate(own), return_inverse=True)
    sides = np.array([side[i] for i in order])
    two = len(set(side)) > 1
    groups = Union(len(own))
    for g in range(0, len(own), GROUP):
        e = min(len(own), g + GROUP)
        mask = np.zeros(len(vocabulary), bool)
        mask[flat[first[g] : first[e]]] = True
        # each pair once: a group's members against sets that stand at or after the group
        later = np.arange(g, len(own))
        bound = np.add.reduceat(mask[flat[first[g] :]], first[g:-1] - first[g], dtype=np.int64)
        least = int(n[g:e].min())
        opened = later[100 * bound >= percent * np.maximum(n[g:], n[g:] + least - bound)]
        if not len(opened):
            continue
        tokens = np.concatenate([flat[first[i] : first[i + 1]] for i in opened])
        starts = np.zeros(len(opened), np.int64)
        np.cumsum(n[opened][:-1], out=starts[1:])
        for m in range(g, e):
            root = groups.find(m)
            rest = [x for x, q in enumerate(opened.tolist()) if q > m and groups.find(q) != root]
            if not rest:
                continue
            rest = np.array(rest)
            if two:
                rest = rest[sides[opened[rest]] != sides[m]]
            if not len(rest):
                continue
            has = np.zeros(len(vocabulary), bool)
            has[flat[first[m] : first[m + 1]]] = True
            both = np.add.reduceat(has[tokens], starts, dtype=np.int64)[rest]
            for q in opened[rest[100 * both >= percent * (n[m] + n[opened[rest]] - both)]].tolist():
                groups.join(m, q)
    return [(order[groups.find(i)], order[i]) for i in range(len(own)) if groups.find(i) != i]


def jaccard_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Two documents link when the Jaccard similarity of their sets of distinct word shingles reaches percent / 100;
    component_id is the smallest doc_id that links reach, the document's own included.

    Equal sets are one from the start, so exact copies cost nothing. Different sets that share a part (see part_hashes) are
    joined to the smallest document that has it, by a minimum with partial aggregation: the components of these edges
    are families, and no link leaves its family. Passes take the parts one slice after another, so that only a slice's rows are
    on disk beside the sketches. A family is compared in blocks of bounded size, by
    link(); each pair of a large family's blocks is a task's work of its own. Rounds take the pairs of blocks, which may send more than the corpus holds.

    Null and empty texts, and texts of white space, have empty sets and link with nothing. Rows with a null
    doc_id are returned with a null component_id and link with nothing. Rows that share a doc_id are one document for component_id: what one links with, all do, those without words too.
    An empty table gives an empty result; other columns are ignored.
    """
    made = cut(sketches(docs, width, percent), "sketches")
    named = made.where("n > 0 and doc_id is not null")
    firsts = cut(named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first")), "firsts")
    # a set's node is the smallest document that has it; rows without words have their own
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")))
    nodes = made.select("doc_id", "n", "k1", "k2").join(firsts.withColumnRenamed("n", "_n"), ["k1", "k2"], "left")
    nodes = cut(nodes.select("doc_id", F.col("n").alias("n_shingles"), own.alias("node"), "k1", "k2"), "nodes")
    tokens = made.agg(F.sum("n")).head()[0] or 0
    parts = _parts(named, nodes)
    drop_cut(made, firsts)
    families = cut(connected_components(_shared_parts(parts)), "families")
    drop_cut(parts)
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    same = nodes.join(cut(several, "several"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    links = cut(_links(docs, families, width, percent, tokens).unionByName(same), "links")
    drop_cut(families)
    names = broadcast_up_to(cut(connected_components(links), "components"), SMALL)
    return nodes.join(names, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def _parts(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, m, parts0, parts1, ...) of the rows of `named` whose set no smaller document has. One join, however many passes read what it leaves; where the copies can't be broadcast, slices of rows can meet theirs one after another, or else are sent alone."""
    copies = cut(nodes.where("n_shingles > 0 and doc_id <> node").select("doc_id", "k1", "k2").distinct(), "copies")
    several = min(SLICES, copies.count() * 8 // (SMALL * 7) + 1)
    held = []
    for i in range(several):
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(several)) == i
        left = named.where(mine).join(broadcast_up_to(copies.where(mine), SMALL), ["doc_id", "k1", "k2"], "left_anti")
        held.append(cut(left.select("doc_id", "m", *(f"parts{j}" for j in range(SLICES))), "own"))
    drop_cut(copies)
    return reduce(DataFrame.unionByName, held)


def _shared_parts(sets: DataFrame) -> DataFrame:
    """(a, b) for every set b with a part that a smaller document a has, the smallest of all; sets stand for their first documents."""
    passes = min(SLICES, max(1, -(-(sets.agg(F.sum("m")).head()[0] or 0) // PASS)))
    edges = []
    for p in range(passes):
        parts = sets.select("doc_id", F.explode(F.concat(*(f"parts{i}" for i in range(p, SLICES, passes)))).alias("part"))
        shared = cut(parts.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("part", "a"), "parts")
        edges.append(cut(parts.join(broadcast_up_to(shared, SMALL), "part").select("a", F.col("doc_id").alias("b")).where("a <> b").distinct(), "edges"))
        drop_cut(shared)
    return reduce(DataFrame.unionByName, edges)


def _sets(docs: DataFrame, families: DataFrame, width: int) -> DataFrame:
    """(family, doc_id, n, tokens) of every row with words whose document is in a family. Where the families can't be broadcast, slices of documents can meet theirs one after another, or else are sent alone."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                s = list(sets_of(batch.column("text"), width))
                yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], ["family", "doc_id", "n", "tokens"])

    several = min(SLICES, families.count() * 8 // (SMALL * 7) + 1)
    held = []
    for i in range(several):
        mine = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(several)) == i
        some = docs.select("doc_id", "text").where(mine).join(broadcast_up_to(families.withColumnRenamed("node", "doc_id").where(mine), SMALL), "doc_id")
        held.append(cut(some.mapInArrow(sets, "family long, doc_id long, n long, tokens binary").where("n > 0"), "sets"))
    return reduce(DataFrame.unionByName, held)


def _links(docs: DataFrame, families: DataFrame, width: int, percent: int, tokens: int) -> DataFrame:
    """(a, b) that connect what the links inside families connect. tokens: of all documents; a round over the blocks sends a quarter of them or ROUND."""
    held = _sets(docs, families, width)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("int")
    sizes = cut(held.groupBy("family").agg(blocks.alias("blocks"), F.sum("n").alias("n")), "blocks")
    rounds = max(1, -(-(sizes.agg(F.sum(F.col("n") * F.col("blocks"))).head()[0] or 0) // max(tokens // 4, ROUND)))
    dealt = held.join(broadcast_up_to(sizes.select("family", "blocks"), SMALL), "family").withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc_id", "tokens")
    links = []
    for r in range(rounds):
        mine = dealt.where(F.pmod(F.xxhash64("family", "i", "j"), F.lit(rounds)) == r) if rounds > 1 else dealt
        links.append(cut(by_block(mine, lambda rows: _compare(rows, percent), "a long, b long"), "links"))
    drop_cut(held, sizes)
    return reduce(DataFrame.unionByName, links)


def by_block(dealt: DataFrame, work: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, least: int = 1) -> DataFrame:
    """work(rows) for all rows that agree in family, i and j, or for several such runs that have `least` rows together; a run is of bounded size, so a task holds that much."""
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held = None, [], 0
        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True))
            start = 0
            for x in range(len(at) + 1):
                if x == len(at) or (x > start and at[x] != at[x - 1]):
                    if key is not None and at[start] != key and held >= least:
                        yield from work(rows)
                        rows, held = [], 0
                    key = at[start]
                    rows.append(batch.slice(start, x - start))
                    held += x - start
                    start = x
        if rows:
            yield from work(rows)

    return dealt.mapInArrow(run, schema)


def _compare(rows: list[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(rows)
    ids, side = t.column("doc_id").to_pylist(), t.column("side").to_pylist()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("tokens")]
    if rows[0].column("i")[0].as_py() != rows[0].column("j")[0].as_py() and len(set(side)) < 2:
        return
    edges = link(sets, side, percent)
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in edges], pa.int64()), pa.array([ids[b] for _, b in edges], pa.int64())], ["a", "b"])


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row (the smallest doc_id) of each group that links connect. Rows without words or doc_id stay; of rows that share a doc_id all stay or go."""
    groups = jaccard_groups(docs.select("doc_id", "text"), width, percent)
    copy = fresh(docs, "_copy")
    gone = cut(groups.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct(), "copies")
    return docs.join(gone, F.col("doc_id") == F.col(copy), "left_anti")
