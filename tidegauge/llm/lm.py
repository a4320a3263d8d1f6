"""LM scoring: a hashed maximum-entropy model over n-gram and skip features with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import cut, drop_cut, freeing, trim
from tidegauge.llm.textops import Words, mix64, slices, utf8

#: Words in a class that has a softmax of its own, classes of either kind, and suffixes of words.
IN_CLASS, HEAD_CLASSES, TAIL_CLASSES, SUFFIXES = 32, 16, 16, 1 << 12
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Training tokens for each weight row that n-gram and skip features are hashed to, and the fewest and most such rows: for classes, and for the words of head classes. The most bound what is broadcast, 7 MB, and the vectors of slopes that each task adds up.
TOKENS_A_ROW, ROWS, IN_ROWS = 512, (1 << 12, 1 << 15), (1 << 11, 1 << 14)
#: Gradient rounds, each over another one of SLICES equal parts of the training documents; as many of both, so that each document is in one.
ROUNDS = SLICES = 4
#: Gradient steps for the weights of the words in tail classes, each over the whole counted vocabulary, and what holds these weights near 0.
TAIL_STEPS, SHRINK = 2, 1.0
#: Bytes of text whose tokens are a packed row, and tokens that are scored at once: few enough for a processor's own memory.
TEXT, BLOCK = 2_000_000, 1 << 13
#: Packed rows, of a megabyte or so each, and documents that go to Python at once.
FEW, MANY = 8, 4000
_END = np.uint64(0xE0D << 12)
_START = np.uint64(1)


class Tokens:
    """The tokens of a batch of texts, each of which ends in END: keys: the distinct ones (52 bits of the word's hash above 12 of its suffix's), sorted, and START; ids: each token's place in keys; first: where texts begin."""

    def __init__(self, first: np.ndarray, keys: np.ndarray, ids: np.ndarray):
        self.first, self.keys, self.ids = first, np.append(keys, _START), ids
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        words = Words(*utf8(column), lower=True, suffix=True)
        keys = (words.hash & ~np.uint64(SUFFIXES - 1)) | words.suffix
        n = np.diff(words.first)
        every = np.full(len(keys) + len(n), _END)
        every[np.arange(len(keys)) + np.repeat(np.arange(len(n)), n)] = keys
        return cls(words.first + np.arange(len(words.first)), *np.unique(every, return_inverse=True))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        gaps = np.diff(self.keys[:-1], prepend=np.uint64(0))  # smaller numbers than the keys
        return self.first.astype(np.int64).tobytes(), *(pa.compress(x, "zstd", asbytes=True) for x in (gaps, self.ids.astype(np.uint32)))

    @classmethod
    def unpacked(cls, first: bytes, keys: bytes, ids: bytes, distinct: int) -> Tokens:
        first = np.frombuffer(first, np.int64)
        back = lambda x, n, kind: np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd"), kind)
        return cls(first, np.cumsum(back(keys, distinct, np.uint64)), back(ids, int(first[-1]), np.uint32).astype(np.int64))

    def before(self, i: int) -> np.ndarray:
        """The id i places before each token; that of START before its text's beginning."""
        out = np.full(len(self.ids), len(self.keys) - 1)
        out[i:] = np.where(self.doc[i:] == self.doc[:-i], self.ids[:-i], out[i:])
        return out


def _suffix(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(SUFFIXES - 1)).astype(np.int64)


def _few(df: DataFrame) -> DataFrame:
    """df in about two tasks a core at most: each task makes a vector of fixed length, so more tasks only make more vectors."""
    return df.coalesce(max(1, 2 * df.sparkSession.sparkContext.defaultParallelism))


def summed(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: type = np.float64, slots: int = 16) -> np.ndarray:
    """The sum of a vector of fixed length that each task makes of its rows.

    Vectors are cut into `slots` pieces. Pieces are summed in groups, about as many as each has members, and then over the groups; so the largest task reads in proportion to the
    root of the number of tasks, and the driver gets one vector. kind: what numbers travel as; counts stay exact as doubles.
    """
    df = _few(df)
    groups = max(1, round(df.rdd.getNumPartitions() ** 0.5 / 4))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.array_split(part(batches).astype(kind), slots)
        group = TaskContext.get().partitionId() % groups
        yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array([group] * slots, pa.int32()), pa.array([p.tobytes() for p in x], pa.binary())], ["slot", "group", "piece"])
        del x
        trim()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for s, g, p in zip(*(batch.column(c).to_pylist() for c in ("slot", "group", "piece")), strict=True):
                x = np.frombuffer(p, kind).astype(np.float64)
                sums[s, g] = sums[s, g] + x if (s, g) in sums else x
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sums], pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.astype(kind).tobytes() for x in sums.values()], pa.binary())], ["slot", "group", "piece"])

    schema = "slot int, group int, piece binary"
    rows = df.mapInArrow(pieces, schema).repartition(slots * groups, "slot", "group").mapInArrow(total, schema)
    with freeing(df.sparkSession, FEW):
        rows = rows.repartition(slots, "slot").mapInArrow(total, schema).collect()
    return np.concatenate([np.frombuffer(r.piece, kind).astype(np.float64) for r in sorted(rows, key=lambda r: r.slot)]) if rows else np.zeros(0)


def _add(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each line of values to the line of out, at the rows given."""
    for o, v in zip(out, values, strict=True):
        o += np.bincount(rows, v, len(o))


def _by_row(x: np.ndarray) -> np.ndarray:
    """Floats with each row's side by side, since rows are what is taken."""
    return np.ascontiguousarray(x, np.float32)


def _rows(tokens: int, bounds: tuple[int, int], each: int) -> int:
    """A power of two that grows with the tokens between the bounds."""
    return int(min(max(bounds[0], 1 << max(0, int(tokens // each) - 1).bit_length()), bounds[1]))


@dataclass
class Model:
    """head: keys of the words with weights of their own, most frequent first; END is the first. cluster: the tail class of each suffix.

    p(token) = p(class | features) * p(token | class, features). The features of a class, and of a word in its head class, are the word before, the two before, the one before that alone
    (a skip), and the suffix before, each a hashed row of weights. In a tail class there are a weight for each word's count and one for each word with the cluster of the word
    before, if they were seen together: as many as the corpus has such pairs. These aren't here; they follow from a word's counts and the tables (see tail()). What was never seen is one word of each tail class, with a count of half a token.
    """

    head: np.ndarray
    cluster: np.ndarray
    classes: np.ndarray  # [rows + SUFFIXES, CLASSES]
    words: np.ndarray  # [rows, IN_CLASS]
    bias: np.ndarray  # [CLASSES]
    in_bias: np.ndarray  # [HEAD_CLASSES, IN_CLASS]
    seen: np.ndarray  # [TAIL_CLASSES, TAIL_CLASSES]: training tokens of a tail class after a word of a cluster
    tables: list[np.ndarray] = field(default_factory=list)  # sums over a tail class's words after a word of a cluster, before each step and after the last

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each key, and its place in a head class, or -1."""
        order = np.argsort(self.head)
        at = np.minimum(np.searchsorted(self.head[order], keys), len(order) - 1)
        rank = np.where(self.head[order][at] == keys, order[at], -1)
        return np.where(rank >= 0, rank // IN_CLASS, HEAD_CLASSES + self.cluster[_suffix(keys)]), np.where(rank >= 0, rank % IN_CLASS, -1)

    def tail(self, kind: np.ndarray, after: np.ndarray, count: np.ndarray, together: np.ndarray) -> np.ndarray:
        """The weight of words of the tail classes `kind` with the cluster `after`: gradient steps from 0 for what is observed less what is expected, by the tables of all steps; 0 if they weren't seen together."""
        w = np.zeros(len(kind))
        for z in self.tables[:TAIL_STEPS]:
            expected = self.seen[kind, after] * (count + 0.5) * np.exp(w) / z[kind, after]
            w += np.clip((together - expected - SHRINK * w) / (expected + SHRINK), -2, 2)
        return np.where(together > 0, w, 0.0)

    def features(self, t: Tokens, of: np.ndarray) -> np.ndarray:
        """Rows of `classes` of some tokens."""
        shift, a, b = np.uint64(64 - (len(self.classes) - SUFFIXES).bit_length() + 1), t.before(1)[of], t.before(2)[of]
        row = lambda x: (x >> shift).astype(np.int64)
        one = mix64(t.keys + np.uint64(11))
        return np.stack([row(one)[a], row(mix64(one[a] + t.keys[b] * np.uint64(3))), row(mix64(t.keys + np.uint64(13)))[b], (len(self.classes) - SUFFIXES + _suffix(t.keys))[a]])

    def in_features(self, t: Tokens, of: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Rows of `words` of some tokens, which are of the head classes kind."""
        shift, a, b = np.uint64(64 - len(self.words).bit_length() + 1), t.before(1)[of], t.before(2)[of]
        k = mix64(kind.astype(np.uint64) + np.uint64(71))
        return np.stack([(mix64(x ^ k) >> shift).astype(np.int64) for x in (t.keys[a] + np.uint64(1), t.keys[b] + np.uint64(2), (t.keys[a] & np.uint64(SUFFIXES - 1)) + np.uint64(3))])

    def known(self, t: Tokens, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some tokens: classes and rows of features; which of them are of a head class, their places and rows there."""
        kind, place = (x[t.ids[of]] for x in self.place(t.keys))
        some = np.flatnonzero(place >= 0)
        return kind, self.features(t, of), some, place[some], self.in_features(t, of[some], kind[some])

    def blocks(self, kind: np.ndarray, rows: np.ndarray, some: np.ndarray, inner: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
        """For blocks of what known() gives: which tokens, which of `some`, and exp of the logits of all classes, and of all places in the token's class, a column for a token. Logits are small: no weight passes 20."""
        for s in range(0, len(kind), BLOCK):
            e = min(len(kind), s + BLOCK)
            u, v = np.searchsorted(some, (s, e))
            x, y = self.bias, np.take(self.in_bias, kind[some[u:v]], axis=0)
            for f in rows[:, s:e]:
                x = x + np.take(self.classes, f, axis=0)
            for f in inner[:, u:v]:
                y += np.take(self.words, f, axis=0)
            yield slice(s, e), slice(u, v), np.exp(np.ascontiguousarray(x.T)), np.exp(np.ascontiguousarray(y.T))

    def log(self, t: Tokens, inside: np.ndarray) -> np.ndarray:
        """log p of each token; inside: log p(token | tail class, cluster before) for those of tail classes."""
        out = inside.astype(np.float64)
        kind, rows, some, place, inner = self.known(t, np.arange(len(t.ids)))
        for at, of, p, q in self.blocks(kind, rows, some, inner):
            out[some[of]] = np.log(q[place[of], np.arange(q.shape[1])] / q.sum(0))
            out[at] += np.log(p[kind[at], np.arange(p.shape[1])] / p.sum(0))
        return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


#: A row of tokenised(): the documents of a slice of text and their packed tokens.
_TOKENS = "shard int, slice int, doc_ids array<long>, held_out array<boolean>, first binary, keys binary, ids binary, distinct int"


def tokenised(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) as packed rows of about TEXT bytes of text, or of one text; shard: the task that reads them. Texts are taken apart once, later passes read the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, TEXT):
                t = Tokens.of(batch.column("text"))
                lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(c).cast(k)])) for c, k in (("doc_id", pa.int64()), ("held_out", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([(shard + number) % SLICES], pa.int32()), *lists, *(pa.array([x], pa.binary()) for x in t.packed()), pa.array([len(t.keys) - 1], pa.int32())], [c.split()[0] for c in _TOKENS.split(", ")])
                number += 1
        trim()

    return docs.mapInArrow(run, _TOKENS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Tokens, np.ndarray]]:
    """(row, tokens, which tokens are learnt from) of each row of tokenised()."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            t = Tokens.unpacked(*(row[c].as_py() for c in ("first", "keys", "ids", "distinct")))
            yield row, t, ~row["held_out"].values.to_numpy(zero_copy_only=False)[t.doc]
            del row, t
        del batch
        pa.default_memory_pool().release_unused()


#: Of each entry of a packed row: token, cluster of the word before, the token's count in all training documents, and how many of them come after that cluster.
_PACKED = {"keys": np.uint64, "after": np.uint8, "counts": np.int64, "together": np.int64}


def _squeezed(x: dict[str, np.ndarray]) -> dict[str, bytes]:
    """Arrays of _PACKED as bytes; keys as they are, the others, which are mostly small numbers, compressed."""
    return {c: x[c].astype(k).tobytes() if c == "keys" else pa.compress(x[c].astype(k), "zstd", asbytes=True) for c, k in _PACKED.items()}


def _unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    sizes = [len(x) // 8 for x in batch.column("keys").to_pylist()]
    out = {"keys": np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64)}
    for c in ("after", "counts", "together"):
        width = np.dtype(_PACKED[c]).itemsize
        out[c] = np.concatenate([np.frombuffer(pa.decompress(x.as_buffer(), n * width, "zstd"), _PACKED[c]) for x, n in zip(batch.column(c), sizes, strict=True)] or [np.zeros(0, _PACKED[c])])
    return out


def vocabulary(base: DataFrame, cluster: np.ndarray, shards: int) -> DataFrame:
    """Packed rows (shard, keys, after, counts, together): for each shard its distinct pairs of a token and the cluster of the word before, with counts in all training documents; rows of shard -1 have each pair of the corpus once.

    Tokens are dealt by hash into as many buckets as there are shards, and go there packed: a task adds up a bucket, so about as many rows as a shard has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed() -> Iterator[pa.RecordBatch]:
            for shard, parts in held.items():
                keys, after, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                bucket = (mix64(keys) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((after, keys, bucket))
                keys, after, n, bucket = keys[order], after[order], n[order], bucket[order]
                first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (after[1:] != after[:-1])])
                n, keys, after, bucket = np.add.reduceat(n, first).astype(np.int32), keys[first], after[first], bucket[first]
                cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
                pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(pairs), shard, np.int32)), *(pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (keys, after, n))], ["bucket", "shard", "keys", "after", "n"])

        size = 0
        for row, t, learnt in _read(batches):
            pair = t.ids * TAIL_CLASSES + cluster[_suffix(t.keys)][t.before(1)]
            there = np.zeros(len(t.keys) * TAIL_CLASSES, bool)
            there[pair] = True
            which = np.flatnonzero(there)
            n = np.bincount(pair[learnt], minlength=len(there))[which]
            held.setdefault(row["shard"].as_py(), []).append((t.keys[which // TAIL_CLASSES], (which % TAIL_CLASSES).astype(np.uint8), n.astype(np.int32)))
            size += len(which)
            if size > 2_000_000:
                yield from packed()
                held, size = {}, 0
        yield from packed()
        held.clear()
        trim()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[], [], [], []]
        for batch in batches:
            for s, k, a, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "after", "n")), strict=True):
                keys = np.frombuffer(k, np.uint64)
                for x, y in zip(got, (np.full(len(keys), s, np.int32), keys, np.frombuffer(a, np.uint8), np.frombuffer(n, np.int32)), strict=True):
                    x.append(y)
        if not got[0]:
            return
        shard, keys, after, n = (np.concatenate(x) for x in got)
        order = np.lexsort((after, keys))
        shard, keys, after, n = shard[order], keys[order], after[order], n[order].astype(np.int64)
        word = np.r_[True, keys[1:] != keys[:-1]]
        pair = word | np.r_[True, after[1:] != after[:-1]]
        together = np.add.reduceat(n, np.flatnonzero(pair))[np.cumsum(pair) - 1]
        counts = np.add.reduceat(n, np.flatnonzero(word))[np.cumsum(word) - 1]
        for some, names in ((np.flatnonzero(pair), np.full(int(pair.sum()), -1, np.int32)), (np.argsort(shard, kind="stable"), None)):
            of = np.sort(shard) if names is None else names
            cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x = some[a:b]
                if names is None:  # a shard's pair once, though several of its rows may have it
                    x = x[np.r_[True, (keys[x][1:] != keys[x][:-1]) | (after[x][1:] != after[x][:-1])]]
                row = _squeezed({"keys": keys[x], "after": after[x], "counts": counts[x], "together": together[x]})
                yield pa.RecordBatch.from_arrays([pa.array([int(of[a])], pa.int32()), *(pa.array([row[c]], pa.binary()) for c in _PACKED)], ["shard", *_PACKED])

    rows = base.mapInArrow(count, "bucket int, shard int, keys binary, after binary, n binary").repartitionById(shards, "bucket")
    return cut(rows.mapInArrow(join, "shard int, keys binary, after binary, counts binary, together binary"), "vocabulary", FEW)


def _clusters(pairs: np.ndarray, k: int) -> np.ndarray:
    """k clusters of the rows of pairs by the root of their shares: centres far from each other first, then Lloyd's steps, rows weighing their sums."""
    weight = pairs.sum(1)
    x = np.sqrt(pairs / np.maximum(weight, 1)[:, None])
    centres = [x[weight.argmax()]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[(far * np.sqrt(weight)).argmax()])
    centres = np.array(centres)
    for _ in range(20):
        of = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in range(k):
            if weight[of == c].sum() > 0:
                centres[c] = np.average(x[of == c], axis=0, weights=weight[of == c])
    return of


def clusters_of(base: DataFrame) -> np.ndarray:
    """A cluster for each suffix, by how often it follows each of 64 groups of suffixes."""

    def follows(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(SUFFIXES * 64)
        for _, t, learnt in _read(batches):
            s = _suffix(t.keys)
            out += np.bincount(((s * 64)[t.ids] + (s // 64)[t.before(1)])[learnt], minlength=len(out))
        return out

    pairs = summed(base, follows)
    return _clusters(pairs.reshape(SUFFIXES, 64), TAIL_CLASSES) if pairs.any() else np.zeros(SUFFIXES, np.int64)


def fit(base: DataFrame, words: DataFrame, cluster: np.ndarray) -> tuple[Model, int, int]:
    """(model, training tokens, distinct training tokens), from tokenised() documents and their vocabulary().

    1. The vocabulary gives the head words and each tail class's counts. Its gradient steps for the words' weights in tail classes run over the whole of it: a task adds up the exponentials of its words, a table of fixed size goes round, and
       the weights themselves follow from the counts and the tables, wherever a word's counts are.
    2. All training tokens give the counts of each feature with each class, and with each word of a head class. They set the first weights, and how long a weight's steps are. The rows that features are hashed to grow with the tokens.
    3. Gradient rounds: tasks sum observed minus expected counts over a slice of the documents, the driver takes the step. The slices of all rounds together are all training documents.
    """
    spark, whole = base.sparkSession, words.where("shard = -1")

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            x = _unpacked(batch)
            keys, first = np.unique(np.r_[keys, x["keys"]], return_index=True)
            n = np.r_[n, x["counts"]][first]
            best = np.lexsort((keys, -n))[: HEAD_CLASSES * IN_CLASS]
            keys, n = keys[best], n[best]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    top = whole.mapInArrow(most, "key long, n long").where("n > 0").orderBy(F.desc("n"), "key").limit(HEAD_CLASSES * IN_CLASS).collect()
    head = np.array([int(_END), *(r.key % 2**64 for r in top if r.key % 2**64 != int(_END))][: HEAD_CLASSES * IN_CLASS], np.uint64)
    n_head = np.array([{r.key % 2**64: r.n for r in top}.get(int(k), 0) for k in head], np.float64)
    square = (TAIL_CLASSES, TAIL_CLASSES)
    model = Model(head, cluster, np.zeros((1 + SUFFIXES, CLASSES), np.float32), np.zeros((1, IN_CLASS), np.float32), np.zeros(CLASSES, np.float32), np.full((HEAD_CLASSES, IN_CLASS), -30, np.float32), np.zeros(square))
    model.in_bias.ravel()[: len(head)] = np.log(n_head + 0.5)

    def tails(x: dict) -> tuple[np.ndarray, np.ndarray]:
        """Which entries are of tail classes, and of which."""
        kind, place = model.place(x["keys"])
        some = np.flatnonzero((place < 0) & (x["counts"] > 0))
        return some, kind[some] - HEAD_CLASSES

    def by_class(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        size, seen, total = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES**2), np.zeros(2)
        for batch in batches:
            x = _unpacked(batch)
            if not len(x["keys"]):
                continue
            first = np.r_[True, x["keys"][1:] != x["keys"][:-1]] & (x["counts"] > 0)
            total += x["counts"][first].sum(), first.sum()
            some, kind = tails(x)
            size += np.bincount(kind, np.where(first[some], x["counts"][some] + 0.5, 0), TAIL_CLASSES)
            seen += np.bincount(kind * TAIL_CLASSES + x["after"][some], x["together"][some], len(seen))
        return np.concatenate([size, seen, total])

    sums = summed(whole, by_class)
    if not top:
        model.tables = [np.full(square, 0.5)] * (TAIL_STEPS + 1)
        return model, 0, 0
    total, kinds = int(round(sums[-2])), int(round(sums[-1]))
    flat = np.repeat(sums[:TAIL_CLASSES, None] + 0.5, TAIL_CLASSES, 1)
    model.seen, model.tables = sums[TAIL_CLASSES:-2].reshape(square), [flat]
    for _ in range(TAIL_STEPS):

        def more(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(TAIL_CLASSES**2)
            for batch in batches:
                x = _unpacked(batch)
                some, kind = tails(x)
                after, n, both = (x[c][some] for c in ("after", "counts", "together"))
                out += np.bincount(kind * TAIL_CLASSES + after, (n + 0.5) * np.expm1(model.tail(kind, after, n, both)), len(out))
            return out

        model.tables = [*model.tables, flat + summed(whole, more).reshape(square)]

    rows, in_rows = _rows(total, ROWS, TOKENS_A_ROW), _rows(total, IN_ROWS, 2 * TOKENS_A_ROW)
    model.classes, model.words = np.zeros((rows + SUFFIXES, CLASSES), np.float32), np.zeros((in_rows, IN_CLASS), np.float32)

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, w = model.classes, model.words
        return x[: c.size].reshape(c.shape[::-1]).T, x[c.size :].reshape(w.shape[::-1]).T

    def over(docs: DataFrame, add: Callable[[Model, Tokens, np.ndarray, np.ndarray, np.ndarray], None]) -> tuple[np.ndarray, np.ndarray]:
        """What add() adds up to, over the documents, in arrays like `classes` and `words` on their sides."""
        sent = spark.sparkContext.broadcast(model)  # of bounded size, as are the sums

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            m = sent.value
            c, w = np.zeros(m.classes.shape[::-1]), np.zeros(m.words.shape[::-1])
            for _, t, learnt in _read(batches):
                add(m, t, np.flatnonzero(learnt), c, w)
            return np.concatenate([c.ravel(), w.ravel()])

        out = summed(docs, part, np.float32)
        sent.destroy()
        return halves(out if len(out) else np.zeros(model.classes.size + model.words.size))

    c, w = over(base, observed)
    prior = c[:rows].sum(0) + 1
    prior /= prior.sum()
    model.bias = np.log(prior).astype(np.float32)
    model.classes = _by_row(0.35 * np.log((c + 20 * prior) / ((c.sum(1, keepdims=True) + 20) * prior)))
    # a first guess of an in-class weight needs the class's own shares, which rows mix: they start at 0
    reach = 1 / SLICES
    bound_c = reach * (c + c.sum(1, keepdims=True) * prior) / 2 + 2
    bound_w = reach * (w + w.sum(1, keepdims=True) / IN_CLASS) / 2 + 2
    for i in range(ROUNDS):
        g, h = over(base.where(F.col("slice") == i % SLICES), slope)
        rate = 0.5 / (1 + 0.3 * i)
        model.classes = _by_row(model.classes + rate * np.clip(g / bound_c, -2, 2))
        model.words = _by_row(model.words + rate * np.clip(h / bound_w, -2, 2))
    return model, total, kinds


def observed(m: Model, t: Tokens, learnt: np.ndarray, c: np.ndarray, w: np.ndarray) -> None:
    """Add how often each row's feature meets each class, and each place of a head class, over the tokens learnt."""
    kind, rows, some, place, inner = m.known(t, learnt)
    for r in rows:
        c += np.bincount(kind * c.shape[1] + r, minlength=c.size).reshape(c.shape)
    for r in inner:
        w += np.bincount(place * w.shape[1] + r, minlength=w.size).reshape(w.shape)


def slope(m: Model, t: Tokens, learnt: np.ndarray, c: np.ndarray, w: np.ndarray) -> None:
    """Add the slope of the learnt tokens' log p in each weight: observed less expected counts."""
    kind, rows, some, place, inner = m.known(t, learnt)
    P, Q = np.empty((CLASSES, len(kind)), np.float32), np.empty((IN_CLASS, len(some)), np.float32)
    for at, of, p, q in m.blocks(kind, rows, some, inner):
        P[:, at], Q[:, of] = p / -p.sum(0), q / -q.sum(0)
    P[kind, np.arange(len(kind))] += 1
    Q[place, np.arange(len(some))] += 1
    for r in rows:
        _add(c, r, P)
    for r in inner:
        _add(w, r, Q)


class Counts:
    """A shard's counted pairs, in the order of tokens, and log p of each in its tail class."""

    def __init__(self, parts: list[dict[str, np.ndarray]], m: Model):
        x = {c: np.concatenate([p[c] for p in parts] or [np.zeros(0, k)]) for c, k in _PACKED.items()}
        order = np.argsort(x["keys"], kind="stable")
        self.keys, self.after, self.n, together = (v[order] for v in x.values())
        self.cluster, self.norm = m.cluster, np.log(m.tables[-1])
        self.log = np.empty(len(self.keys))
        for s in range(0, len(self.keys), BLOCK):
            at = slice(s, s + BLOCK)
            kind, after, n = m.cluster[_suffix(self.keys[at])], self.after[at], self.n[at]
            self.log[at] = np.log(n + 0.5) + m.tail(kind, after, n, together[at]) - self.norm[kind, after]

    def of(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(count, log p in its tail class) of each token."""
        at = np.searchsorted(self.keys, t.keys)
        n = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == t.keys, self.n[np.minimum(at, len(self.keys) - 1)], 0)
        kind = self.cluster[_suffix(t.keys)]
        table = np.log(n + 0.5)[:, None] - self.norm[kind]  # [distinct tokens, clusters]; pairs that were seen together stand in the shard's rows
        for j in range(TAIL_CLASSES):
            i = np.minimum(at + j, len(self.keys) - 1)
            has = np.flatnonzero((self.keys[i] == t.keys) & (at + j < len(self.keys)))
            if not len(has):
                break
            table[has, self.after[i[has]]] = self.log[i[has]]
        return n[t.ids], table[t.ids, kind[t.before(1)]]


def score(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text), by a model of the rows that aren't held out.

    Tokens: words with A-Z in lower case, then one end. A word is known by 64 bits: of its hash and its suffix's. base_score: log10 of the text's probability under single tokens' counts raised by 0.5; score: under the model.

    The documents' tokens are written to the shared folder with the number of the task that reads them: its shard. Tokens are counted by shard, a shard gets the counts of its own tokens only, and its documents meet these in one task, the
    counts first. So no task and no broadcast holds the whole vocabulary, nor the weights of its words.

    Null or empty text: the end alone. A null doc_id isn't held out. Repeated rows are counted and scored each. An empty table gives an empty result; with nothing to learn from, train_tokens is 0 and base_score 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = is_held_out(F.col("doc_id")) if held_out is None else held_out
    dealt = docs.select("doc_id", "text", out.alias("held_out"))
    shards = max(1, dealt.rdd.getNumPartitions())
    base = cut(tokenised(dealt), "tokens", MANY)
    cluster = clusters_of(base)
    words = vocabulary(base, cluster, shards)
    model, total, kinds = fit(base, words, cluster)
    sent = spark.sparkContext.broadcast(model)  # of bounded size
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    both = words.where("shard >= 0").select("shard", F.lit(0).alias("kind"), *_PACKED, *[F.lit(None).cast(c.split()[1]).alias(f"t_{c.split()[0]}") for c in _TOKENS.split(", ")])
    both = both.unionByName(base.select("shard", F.lit(1).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in _PACKED], *[F.col(c).alias(f"t_{c}") for c in names]))
    both = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packs, counts = None, [], None
        for whole in batches:
            of, kind = whole.column("shard").to_numpy(), whole.column("kind").to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1])]), len(of)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = whole.slice(a, b - a)
                if of[a] != shard:
                    shard, packs, counts = of[a], [], None
                if kind[a] == 0:
                    packs.append(_unpacked(part))
                    continue
                if counts is None:
                    counts, packs = Counts(packs, sent.value), []
                rows = pa.RecordBatch.from_arrays([part.column(f"t_{c}") for c in names], names)
                for row, t, _ in _read([rows]):
                    c, inside = counts.of(t)
                    one = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
                    base_score, s = (np.add.reduceat(x, t.first[:-1]) for x in (one, sent.value.log(t, inside) / np.log(10)))
                    known = np.add.reduceat((c > 0).astype(np.int64), t.first[:-1])
                    yield pa.RecordBatch.from_arrays([row["doc_ids"].values, row["held_out"].values, pa.array(np.diff(t.first)), pa.array(known), pa.array(base_score), pa.array(s)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        trim()

    scored = cut(both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores", FEW)
    sent.destroy()
    drop_cut(base, words)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
