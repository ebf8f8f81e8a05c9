"""Exact search for the largest inner products, over vectors in order of their length.

Vectors become integers and are packed into blocks from the longest down. All are rotated by the
right singular vectors of the whole table, so that the first dimensions carry most of every
product. A tile of a block is multiplied by its queries over those dimensions only; by
Cauchy-Schwarz the rest of a product is at most the product of the lengths of the rests. Pairs
whose bound stays below the query's ``k``-th score so far are pruned, the others are multiplied in
integers. A query leaves a block when its length times that of the next vector cannot reach the
score either, and a block never meets queries it is too short for. Queries start from their
scores against the block of longest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sizing import shared_table
from . import textarrays as ta

SCALE = 1024
TOP = 10
QUERY_MODULUS = 100
BLOCK_BYTES = 4 << 20
QUERY_ROWS = 1024
TILE_ROWS = 1024
ENERGY = 0.8
"""Share of the squared lengths that the dimensions of a partial sum carry."""
MAX_SLOTS = 2000
MAX_COMPONENT = 2**31 - 1
EXACT = float(2**52)
GATHER_VALUES = 4 << 20

_VECTORS = pa.schema([("id", pa.int64()), ("norm", pa.float64()), ("vec", pa.binary())])
_BLOCKS = pa.schema([("block", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("vecs", pa.binary())])
_SCORES = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
RESULT = "query_id long, rank int, vec_id long, score long"


# --- vectors and blocks ----------------------------------------------------------------


def vector_rows(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(id, norm, vec): floor(scale * component) as packed 32-bit integers, of vectors with finite components only."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vec").cast(pa.list_(pa.float64()))
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False) * scale
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            x = np.clip(np.floor(np.where(np.isfinite(x), x, 0)), -MAX_COMPONENT, MAX_COMPONENT)
            squares = np.concatenate([[0.0], np.cumsum(x * x)])
            packed = pa.Array.from_buffers(
                pa.binary(), len(size),
                [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32)), pa.py_buffer(x.astype("<i4"))],
            )
            norm = np.array([np.linalg.norm(x[a:b]) for a, b in zip(ends - size, ends)]) if np.any(squares[-1:] > EXACT) else (
                np.sqrt(squares[ends] - squares[ends - size]))
            whole = pc.and_(pc.is_valid(lists), pa.array(bad[ends] == bad[ends - size]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(norm, pa.float64()), packed], schema=_VECTORS).filter(whole)

    return vectors.mapInArrow(run, "id long, norm double, vec binary")


def blocks_of(vectors: DataFrame, rows: int, block_rows: int, dims: int) -> DataFrame:
    """Vectors from the longest down in packed blocks of at most ``block_rows``; equal rows once, short ones padded with 0."""
    width = 4 * dims

    def run(batches):
        part, number, held, last = TaskContext.get().partitionId(), 0, [], None

        def block():
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) | number, "longest": held[0][1],
                "ids": np.array([h[0] for h in held], "<i8").tobytes(), "vecs": b"".join(h[2].ljust(width, b"\0") for h in held),
            }], schema=_BLOCKS)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "norm", "vec"))):
                if row == last:
                    continue
                held.append(row)
                last = row
                if len(held) == block_rows:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    order = [F.col("norm").desc(), F.col("id"), F.col("vec")]
    placed = vectors.repartitionByRange(max(1, -(-rows // block_rows)), *order).sortWithinPartitions(*order)
    return shared_table(placed.mapInArrow(run, "block long, longest double, ids binary, vecs binary"))


def gram_matrix(vectors: DataFrame, dims: int) -> np.ndarray:
    """Sum of the outer products of all vectors; tasks add up their own, rows of the matrix are added in two steps."""

    def own(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                cells = batch.column("vec").slice(at, 4096).to_pylist()
                x = np.frombuffer(b"".join(c.ljust(4 * dims, b"\0") for c in cells), "<i4").reshape(-1, dims).astype(float)
                total += x.T @ x
        shard = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pylist([{"line": i, "shard": shard, "sums": total[i].tobytes()} for i in range(dims)],
                                         schema=pa.schema([("line", pa.int32()), ("shard", pa.int32()), ("sums", pa.binary())]))

    def add(key, table):
        total = sum(np.frombuffer(c.as_buffer()) for c in table.column("sums"))
        return pa.table({"line": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    lines = vectors.select("vec").mapInArrow(own, "line int, shard int, sums binary")
    summed = lines.groupBy("line", "shard").applyInArrow(add, "line int, sums binary").groupBy("line").applyInArrow(add, "line int, sums binary")
    out = np.zeros((dims, dims))
    for row in summed.collect():  # one row for each dimension
        out[row["line"]] = np.frombuffer(row["sums"])
    return out


def rotation_of(gram: np.ndarray, energy: float = ENERGY) -> tuple[np.ndarray, int]:
    """Right singular vectors, the strongest first, and how many of them carry ``energy``."""
    values, vectors = np.linalg.eigh(gram)
    carried = np.cumsum(np.maximum(values[::-1], 0))
    head = int(np.searchsorted(carried, energy * carried[-1])) + 1 if carried[-1] > 0 else 1
    return np.ascontiguousarray(vectors[:, ::-1]), min(head, len(values))


# --- scoring ---------------------------------------------------------------------------


class Side:
    """Vectors of a block: ids, integers, and rotated values split into head and rest."""

    def __init__(self, ids: bytes, vecs: bytes, rotation: np.ndarray, head: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(vecs, "<i4").reshape(len(self.ids), -1).astype(float)
        self.norm = np.linalg.norm(self.x, axis=1)
        rotated = self.x @ rotation
        self.head, self.rest = np.ascontiguousarray(rotated[:, :head]), np.linalg.norm(rotated[:, head:], axis=1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; those beyond a long count as its limit."""
    if len(x) == 0 or float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < EXACT:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(p, q)) for p, q in zip(x.tolist(), y.tolist())]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in whole], np.int64)


def best_in_block(q: Side, c: Side, least: np.ndarray, k: int, tile_rows: int = TILE_ROWS):
    """(query row, candidate id, score) of the ``k`` best of a block for each query, and each query's ``k``-th score.

    ``least`` has scores that ``k`` candidates of a query are known to reach (or minus infinity);
    candidates below are left out. Candidates come in descending length.
    """
    least = least.astype(float).copy()
    rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(c.ids), tile_rows):
        tile = slice(lo, lo + tile_rows)
        slack = 1e-3 + 1e-9 * q.norm * c.norm[lo]
        live = np.flatnonzero(q.norm * c.norm[lo] + slack >= least)
        if len(live) == 0:
            break
        bound = q.head[live] @ c.head[tile].T
        bound += q.rest[live, None] * c.rest[None, tile]
        bound += slack[live, None]
        own = q.ids[live, None] == c.ids[None, tile]
        bound[own] = -np.inf
        floor = least[live]
        if not np.isfinite(floor).all() and bound.shape[1] > k:
            # Without a score to reach, the k best by their lower bounds give one.
            lower = np.where(own, -np.inf, bound - 2 * (q.rest[live, None] * c.rest[None, tile] + slack[live, None]))
            floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
        i, j = np.nonzero((bound >= floor[:, None]) & ~own)
        i, j = live[i], j + lo
        step = max(1, GATHER_VALUES // q.x.shape[1])
        found = [products(q.x[i[a:a + step]], c.x[j[a:a + step]]) for a in range(0, len(i), step)]
        found = np.concatenate([np.zeros(0, np.int64), *found])
        kept = found >= least[i]
        rows, ids, scores = (np.concatenate(p) for p in ((rows, i[kept]), (ids, c.ids[j[kept]]), (scores, found[kept])))
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        full = rows[place == k - 1]
        least[full] = np.maximum(least[full], scores[place == k - 1])
        rows, ids, scores = rows[place < k], ids[place < k], scores[place < k]
    return rows, ids, scores, least


def scored(pairs: DataFrame, rotation, k: int) -> DataFrame:
    """Best candidates for each pair of a block of queries and a block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, head = rotation.value
        for batch in batches:
            for row in batch.to_pylist():
                q, c = Side(row["q_ids"], row["q_vecs"], turn, head), Side(row["ids"], row["vecs"], turn, head)
                rows, ids, scores, _ = best_in_block(q, c, np.frombuffer(row["least"]), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((row["q_block"] << 10) + rows), pa.array(q.ids[rows]), pa.array(ids), pa.array(scores)], schema=_SCORES)

    return pairs.mapInArrow(run, "query long, query_id long, id long, score long")


def started(queries: DataFrame, first, rotation, k: int) -> DataFrame:
    """Blocks of queries with the scores they reach in one block, and the length a vector needs at least."""

    def run(batches):
        turn, head = rotation.value
        ids, vecs = first.value
        c = Side(ids, vecs, turn, head)
        for batch in batches:
            for row in batch.to_pylist():
                q = Side(row["ids"], row["vecs"], turn, head)
                least = best_in_block(q, c, np.full(len(q.ids), -np.inf), k)[3]
                with np.errstate(divide="ignore", invalid="ignore"):
                    needed = np.where(least > 0, (least - 1e-3) / np.maximum(q.norm, 1e-9), -np.inf)
                yield pa.RecordBatch.from_pylist(
                    [{"q_block": row["block"], "q_ids": row["ids"], "q_vecs": row["vecs"], "least": least.tobytes(),
                      "needed": float(needed.min()) * (1 - 1e-9)}],
                    schema=pa.schema([("q_block", pa.int64()), ("q_ids", pa.binary()), ("q_vecs", pa.binary()),
                                      ("least", pa.binary()), ("needed", pa.float64())]))

    return queries.mapInArrow(run, "q_block long, q_ids binary, q_vecs binary, least binary, needed double")


def top_products(vectors: DataFrame, k: int = TOP, modulus: int = QUERY_MODULUS, block_bytes: int = BLOCK_BYTES,
                 query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` candidates of highest inner product for each vector whose ``vec_id`` is divisible by ``modulus``.

    ``vectors`` has vec_id and embedding. A vector that is null or holds a null or a component that is
    not finite takes no part; an empty one has product 0 with all, and a shorter one counts as padded
    with 0. Components beyond 32 bits after scaling count as the limit, and scores beyond a long as its
    limit. A vector without an id is a candidate, sorts before other ids in ties, and asks nothing.
    Equal rows are one row; different vectors of one id are rows of their own, none a candidate of the
    others, each with its own ranks. Fewer than ``k`` candidates give all. Empty tables give no rows.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = shared_table(vector_rows(vectors.select(ta.order_id("vec_id").alias("id"), F.col("embedding").alias("vec"))))
    asking = (F.col("id") % modulus == 0) & (F.col("id") != ta.NULL_ID)
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if(asking), F.max(F.octet_length("vec"))).first()
    if not asked:
        return spark.createDataFrame([], RESULT)
    dims = max(1, width // 4)
    block_rows = max(1, block_bytes // (4 * dims))
    query_rows = min(query_rows, 1 << 10, block_rows)
    rotation = spark.sparkContext.broadcast(rotation_of(gram_matrix(rows, dims)))
    blocks = blocks_of(rows, n, block_rows, dims)
    queries = blocks_of(rows.filter(asking), asked, query_rows, dims)
    top = blocks.agg(F.max_by("block", F.struct("longest", "block"))).first()[0]
    longest = blocks.filter(F.col("block") == top).select("ids", "vecs").first()
    begun = shared_table(started(queries, spark.sparkContext.broadcast((bytes(longest["ids"]), bytes(longest["vecs"]))), rotation, k))
    # Every block of queries goes once to each slot; a slot holds some of the blocks.
    slots = min(MAX_SLOTS, blocks.count())
    pairs = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).join(
        begun.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))), "slot"
    ).filter(F.col("longest") >= F.col("needed"))
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return scored(pairs.drop("slot", "longest", "needed", "block"), rotation, k).withColumn("rank", F.row_number().over(ranked)).filter(
        F.col("rank") <= k
    ).select("query_id", "rank", F.when(F.col("id") != ta.NULL_ID, F.col("id")).alias("vec_id"), "score")


def op13_norm_sorted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest scores of every vector whose id is divisible by 100."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS f FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.f, c.vec_id, list_inner_product(q.f, c.f)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % {QUERY_MODULUS} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id, f ORDER BY score DESC, vec_id NULLS FIRST)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {TOP}
"""
