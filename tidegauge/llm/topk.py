"""Exact top-k search by inner product: a KD-tree for each shard of the vectors."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.shared import cut, drop_cut, new_path

LEAF = 128
#: Numbers that a block of queries holds at most; it is the one thing that is broadcast.
BLOCK = 1 << 20
#: One shard in so many goes first, for its kth scores.
FIRST = 8
#: Less than any vec_id's negative.
_NOBODY = -(2**63) - 1
#: Up to here sums of products of doubles are exact.
EXACT = 1 << 53


class Tree:
    """Median splits along the widest side; each node has its points' bounding box and smallest id. Points are integers; rows: a number for each point, which is its own even where ids repeat."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        lo, hi, least, ends, kids = [], [], [], [], []

        def build(a: int, b: int) -> int:
            k, own = len(lo), points[order[a:b]]
            lo.append(own.min(0)), hi.append(own.max(0)), least.append(ids[order[a:b]].min()), ends.append((a, b)), kids.append((-1, -1))
            wide = hi[k] - lo[k]
            if b - a > leaf and wide.size and wide.max() > 0:  # equal points can't be split; their box is the point
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide.argmax()], m)]
                left = build(a, a + m)
                kids[k] = (left, build(a + m, b))
            return k

        build(0, len(ids))
        self.ids, self.points, self.rows = ids[order], points[order], rows[order]
        self.lo, self.hi, self.least, self.ends, self.kids = np.array(lo), np.array(hi), np.array(least), ends, kids

    def search(self, queries: np.ndarray, own: np.ndarray, best: list[list[tuple[int, int]]], k: int) -> None:
        """best[i]: heap of (score, -id), the k best so far of query i, which is row own[i]; from it comes the bound to beat, and the tree's better points go into it.

        The frontier holds nodes by the most that a point of their box can score, then by their smallest id.
        """
        # a box's bound: sum over components of the larger of q * lo and q * hi
        bound = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        for i, q in enumerate(queries):
            top, ub = best[i], bound[i]
            frontier = [(-ub[0], self.least[0], 0)]
            while frontier:
                b, least, n = heapq.heappop(frontier)
                if len(top) == k and (-b, -least) <= top[0]:
                    break
                left, right = self.kids[n]
                if left >= 0:
                    for c in (left, right):
                        heapq.heappush(frontier, (-ub[c], self.least[c], c))
                    continue
                s, e = self.ends[n]
                score, ids = self.points[s:e] @ q, self.ids[s:e]
                keep = self.rows[s:e] != own[i]
                if len(top) == k:
                    keep &= score >= top[0][0]
                score, ids = score[keep], ids[keep]
                if len(score) > k:
                    first = np.lexsort((ids, -score))[:k]
                    score, ids = score[first], ids[first]
                for x in zip(score.tolist(), (-ids).tolist(), strict=True):
                    if len(top) < k:
                        heapq.heappush(top, x)
                    elif x > top[0]:
                        heapq.heapreplace(top, x)


def _numbers(points: np.ndarray) -> np.ndarray:
    """Doubles where all sums of products are exact in them, else Python's integers."""
    most = np.abs(points).max(initial=0)
    return points.astype(np.float64) if int(most) ** 2 * max(1, points.shape[1]) < EXACT else points.astype(object)


def scaled(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, per_shard: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) for which `queries` holds, the k other rows with the highest score.

    Score: inner product of the components, each turned into floor(scale * x). Ties go to the smaller vec_id.
    Vectors that are null or hold null, NaN or an infinity, and rows without a vec_id, take no part. Rows that repeat a vec_id are each a candidate, of each other too, and
    each a query of its own if `queries` holds. Only vectors of a query's own
    length are its candidates; vectors of length 0 score 0. With fewer than k candidates all are returned; an empty table gives an
    empty result. Components of over 2^53 / scale aren't whole after scaling in doubles; a score beyond a long
    saturates. Other columns are ignored.

    Vectors are dealt by a hash of their row into shards of about per_shard rows, whatever their values, so
    copies of one vector spread. The trees are written once to the shared folder. Queries come to the driver as a stream and
    go out in blocks of at most BLOCK numbers. A block is first run through one in FIRST of the shards; the kth scores found there go out with it to the others, and
    a task that runs it through several shards takes its kth score along: the bound to beat.
    """
    spark = vectors.sparkSession
    base = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding"), scale).alias("v"), queries.alias("is_query"))
    base = cut(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, -(-base.count() // per_shard))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).withColumn("length", F.size("v"))
    dealt = dealt.select("shard", "length", "vec_id", "row", "v").repartition(shards, "shard").sortWithinPartitions("shard", "length")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(key: tuple, ids: list, rows: list, vectors: list) -> pa.RecordBatch:
            points = np.array([x for v in vectors for x in v], dtype=np.int64).reshape(len(ids), key[1])
            blob = pickle.dumps(Tree(np.array(ids, dtype=np.int64), _numbers(points), np.array(rows, dtype=np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([blob], pa.binary())], ["shard", "length", "tree"])

        key, held = None, ([], [], [])
        for batch in batches:
            for s, n, i, r, v in zip(*(batch.column(c) for c in ("shard", "length", "vec_id", "row", "v")), strict=True):
                if key != (now := (s.as_py(), n.as_py())):
                    if held[0]:
                        yield tree(key, *held)
                    key, held = now, ([], [], [])
                for x, y in zip(held, (i.as_py(), r.as_py(), v.values.to_numpy(zero_copy_only=False)), strict=True):
                    x.append(y)
        if held[0]:
            yield tree(key, *held)

    index = cut(dealt.mapInArrow(build, "shard long, length int, tree binary"), "trees")
    out = new_path(spark, "hits")
    schema = "query_row long, query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)

    def run(block: list, bounds: dict[int, int], trees: DataFrame, to: str) -> None:
        sent = spark.sparkContext.broadcast(([(q.row, q.vec_id, np.array(q.v, dtype=np.int64)) for q in block], bounds))  # a block's numbers, and one a query

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_length: dict[int, list] = {}
            for q in sent.value[0]:
                by_length.setdefault(len(q[2]), []).append(q)
            # a bound stands for k rows that any other of that score beats
            held = {n: (np.array([q[0] for q in some]), np.stack([q[2] for q in some]), [[(sent.value[1][q[0]], _NOBODY)] * k if q[0] in sent.value[1] else [] for q in some]) for n, some in by_length.items()}
            for batch in batches:
                for n, blob in zip(batch.column("length").to_pylist(), batch.column("tree"), strict=True):
                    if n in held:
                        own, q, best = held[n]
                        tree = pickle.loads(blob.as_py())
                        q = _numbers(q)
                        if q.dtype != tree.points.dtype or np.abs(q).max(initial=0) * np.abs(tree.points).max(initial=0) * max(n, 1) >= EXACT:
                            q, tree.points, tree.lo, tree.hi = (x.astype(np.int64).astype(object) for x in (q, tree.points, tree.lo, tree.hi))
                        tree.search(q, own, best, k)
            ids = {q[0]: q[1] for q in sent.value[0]}
            rows = [(int(i), ids[int(i)], -x, max(-(2**63), min(2**63 - 1, int(s)))) for own, _, best in held.values() for i, top in zip(own, best, strict=True) for s, x in top if x != _NOBODY]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(c, pa.int64()) for c in names]))

        trees.mapInArrow(search, schema).write.mode("append").parquet(to)
        sent.destroy()

    first = F.col("shard") % FIRST == 0

    def send(block: list) -> None:
        part = new_path(spark, "first")
        run(block, {}, index.where(first), part)
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        hits = spark.read.schema(schema).parquet(part).withColumn("_rank", rank).where(F.col("_rank") <= k)
        hits.drop("_rank").write.mode("append").parquet(out)
        kth = {r.query_row: r.score for r in hits.where(F.col("_rank") == k).select("query_row", "score").collect()}  # one row a query of the block
        drop_cut(spark.read.schema(schema).parquet(part))
        run(block, kth, index.where(~first), out)

    block, numbers = [], 0
    for q in base.where("is_query").select("row", "vec_id", "v").toLocalIterator():
        if block and numbers + len(q.v) > BLOCK:
            send(block)
            block, numbers = [], 0
        block.append(q)
        numbers += len(q.v) + 1
    if block:
        send(block)
    hits = spark.read.schema(schema).parquet(out)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
