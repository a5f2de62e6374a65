"""Exact top-k by inner product over norm-sorted, SVD-rotated vectors.

Vectors become integers floor(scale * x). They are ordered by falling length and cut into blocks;
a rotation by the singular vectors of all of them puts most of an inner product into the first
coordinates. For a query, the blocks are taken in order of length until |query| * |longest vector
left| is below its k-th best score; inside a block, the inner product over the first coordinates
plus the product of the lengths of what is left (Cauchy-Schwarz) bounds each score, and only
vectors whose bound reaches the k-th best are scored, in exact integers.

Two passes spread the work: the first scores each block of queries against the block of longest
vectors, which every task gets, to give each query a k-th best to begin with; the second sends a query only to the blocks
that its bound reaches, so what is shuffled is a block of queries for each such block. Neither
queries nor candidates are collected; only the d x d sum of outer products, the list of blocks and
their lengths are (both far smaller than the vectors).

Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no
part. Vectors of different sizes meet over the components that both have. Rows with the query's own
id aren't candidates; rows that repeat an id are candidates each, and as queries share one ranking.
Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied, written

K = 5
BLOCK_ROWS = 4096
HEAD_BLOCKS = 1
SCHEMA = "query_id long, rank int, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: float) -> DataFrame:
    """id, v (array of long, as floats in double) and the squared length, of the vectors that take part."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.filter(ok).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def matrix(column, d: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to d."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = flat
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Singular vectors of all rows, from the sum of their outer products (d x d)."""

    def outer(batches):
        total = np.zeros((d, d))
        for batch in batches:
            m = matrix(batch.column(0), d)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total))], names=["i", "row"])

    sums = vectors.select("v").mapInArrow(tidied(outer), "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((d, d))
    for r in sums.collect():
        total[r.i, r.j] = r.x
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers: exact in doubles below 2**53, by Python integers beyond."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1] < 2**53:
        return np.rint((a * b).sum(axis=-1)).astype(object)
    return (a.astype(object) * b.astype(object)).sum(axis=-1)


class Search:
    """Queries against blocks in order of length; keeps each query's k best so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.floor, self.k = ids, queries, floor, k
        self.head = max(1, queries.shape[1] // 4)
        self.r = queries @ turn
        self.lengths = np.sqrt((queries**2).sum(axis=1))
        self.tails = np.sqrt(np.maximum(self.r[:, self.head :] ** 2, 0).sum(axis=1))
        self.turn = turn

    def block(self, ids: np.ndarray, vectors: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, -id) of the block among those that may reach its floor."""
        lengths = np.sqrt((vectors**2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        ids, vectors, lengths = ids[order], vectors[order], lengths[order]
        r = vectors @ self.turn
        tails = np.sqrt((r[:, self.head :] ** 2).sum(axis=1))
        best: list[list[tuple[int, int]]] = []
        slack = 1e-9 * (1 + self.lengths.max(initial=0) * lengths.max(initial=0))
        for i in range(len(self.ids)):
            found: list[tuple[int, int]] = []
            floor, at = self.floor[i], 0
            while at < len(ids) and self.lengths[i] * lengths[at] + slack >= floor:
                part = slice(at, at + 512)
                bound = r[part, : self.head] @ self.r[i, : self.head] + self.tails[i] * tails[part] + slack
                near = at + np.flatnonzero((bound >= floor) & (ids[part] != self.ids[i]))
                if len(near):
                    scores = exact_dot(vectors[near], self.q[i][None, :])
                    found = sorted([*found, *zip(map(int, scores), (-ids[near]).tolist())], reverse=True)[: self.k]
                    if len(found) == self.k:
                        floor = max(floor, found[-1][0])
                at += 512
            best.append(found)
        return best


def top_k(embeddings: DataFrame, query: str = "id % 50 = 0", k: int = K, scale: float = 256.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; query: a condition on id that picks the queries among all rows."""
    spark = embeddings.sparkSession
    vectors = written(quantised(embeddings, scale), "vectors")
    facts = vectors.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    if not facts.n:
        return spark.createDataFrame([], SCHEMA)
    d, turn = facts.d, rotation(vectors, facts.d)

    def blocks(rows: DataFrame, n: int) -> DataFrame:
        """Rows of (block, ids, vectors) in falling order of length."""
        parts = max(1, -(-n // block_rows))
        ordered = rows.repartitionByRange(parts, F.desc("norm2"), F.col("id")).sortWithinPartitions(F.desc("norm2"), "id")

        def gather(batches):
            from pyspark import TaskContext

            part, made = TaskContext.get().partitionId(), 0
            ids, found, norms = [], [], []

            def out(ids, found, norms):
                return pa.RecordBatch.from_arrays(
                    [pa.array([(part << 24) + made]), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(found).astype("<f8").tobytes()]), pa.array([max(norms)]), pa.array([sum(map(len, ids))])],
                    names=["block", "ids", "vectors", "norm2", "n"],
                )

            for batch in batches:
                for a in range(0, batch.num_rows, block_rows):
                    piece = batch.slice(a, block_rows)
                    ids.append(piece.column(0).to_numpy().astype("<i8"))
                    found.append(matrix(piece.column(1), d))
                    norms.append(float(piece.column(2).to_numpy().max()))
                    if sum(map(len, ids)) >= block_rows:
                        yield out(ids, found, norms)
                        made += 1
                        ids, found, norms = [], [], []
            if ids:
                yield out(ids, found, norms)

        return ordered.select("id", "v", "norm2").mapInArrow(tidied(gather), "block long, ids binary, vectors binary, norm2 double, n long")

    def unpack(ids, found):
        return np.frombuffer(ids, "<i8"), np.frombuffer(found, "<f8").reshape(-1, d)

    candidates = written(blocks(vectors, facts.n), "blocks")
    asked = vectors.filter(query)
    queries = written(blocks(asked, asked.count()), "queries")
    lengths = sorted(((r.norm2, r.block, r.n) for r in candidates.select("block", "norm2", "n").collect()), key=lambda x: (-x[0], x[1]))
    reach = spark.sparkContext.broadcast((np.sqrt([x[0] for x in lengths]), [x[1] for x in lengths]))
    turned = spark.sparkContext.broadcast(turn)
    pairs_schema = "target long, ids binary, vectors binary, floors binary"

    def search(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                q_ids, q = unpack(r["ids"], r["vectors"])
                c_ids, c = unpack(r["c_ids"], r["c_vectors"])
                best = Search(q_ids, q, np.frombuffer(r["floors"], "<f8"), turned.value, k).block(c_ids, c)
                flat = [(int(i), -b, s) for i, found in zip(q_ids, best) for s, b in found]
                if flat:
                    i, b, s = zip(*flat)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    def run(pairs: DataFrame) -> DataFrame:
        right = candidates.select(F.col("block").alias("target"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
        return pairs.join(right, "target").select("ids", "vectors", "floors", "c_ids", "c_vectors").mapInArrow(tidied(search), "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    # the head, HEAD_BLOCKS blocks of block_rows vectors at most, goes to every task of queries
    top = spark.sparkContext.broadcast([(r["ids"], r["vectors"]) for r in candidates.filter(F.col("block").isin([x[1] for x in lengths[:HEAD_BLOCKS]])).collect()])

    def first(batches):
        for batch in batches:
            for r in batch.to_pylist():
                low = np.full(len(r["ids"]) // 8, -np.inf).tobytes()
                for ids, found in top.value:
                    yield from search([pa.RecordBatch.from_pylist([r | {"floors": low, "c_ids": ids, "c_vectors": found}])])

    head = written(best(queries.select("ids", "vectors").mapInArrow(tidied(first), "query_id long, vec_id long, score long")), "head")
    floors = head.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    known = asked.join(floors.groupBy("id").agg(F.min("floor").alias("floor")), "id", "left").select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).cast("double").alias("floor"), "norm2")

    def more_pairs(batches):
        """A block of queries for each block of candidates that a query of it may reach."""
        bounds, blocks_ = reach.value
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                piece = batch.slice(a, block_rows)
                ids, q, floor = piece.column(0).to_numpy().astype("<i8"), matrix(piece.column(1), d), piece.column(2).to_numpy()
                size = np.sqrt((q**2).sum(axis=1))
                for bound, b in list(zip(bounds, blocks_))[HEAD_BLOCKS:]:
                    ok = size * bound * (1 + 1e-9) + 1e-6 >= floor
                    if ok.any():
                        yield pa.RecordBatch.from_pylist([{"target": b, "ids": ids[ok].tobytes(), "vectors": q[ok].astype("<f8").tobytes(), "floors": floor[ok].astype("<f8").tobytes()}], pa.schema([("target", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("floors", pa.binary())]))

    rest = run(known.select("id", "v", "floor").mapInArrow(tidied(more_pairs), pairs_schema))
    return best(head.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same rows by SQL; sums of products of integers are exact in doubles at these sizes.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
