"""Exact inner-product search against SQL and brute force."""

import math
import random

import numpy as np
import pytest

from fleetframe.llm import innerproducts, registry
from tests.compare import compare, connect

NAME = "op13_norm_sorted_products"
KIND = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k=10, modulus=100, scale=1024):
    vectors = set()
    for i, v in ((r[0], r[1]) for r in rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.add((i, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    out = []
    for i, v in vectors:
        if i is None or i % modulus:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j is not None, j or 0) for j, w in vectors if j != i)
        out += [(i, r + 1, j if known else None, -s) for r, (s, known, j) in enumerate(scores[:k])]
    return sorted(map(str, out))


def listed(df):
    return sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in df.collect())


def odd_vectors(seed=2, n=700, dims=12):
    """Lengths over three orders, a third equal, ties, repeated rows, ragged, null and infinite vectors, negative ids."""
    rng = random.Random(seed)
    base = [rng.gauss(0, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        size = 10 ** rng.uniform(-2, 1)
        v = base if i % 3 == 0 else [rng.choice([-1.0, 0.0, 1.0]) for _ in range(dims)] if i % 7 == 0 else [
            rng.gauss(0, 1) * size * 2.0 ** -d for d in range(dims)]
        rows.append((i * 10 - 500, [float(x) for x in v], i))
    rows += [(None, base, 1), (100000, None, 1), (100100, [None] * dims, 1), (100200, [1.0, float("nan")], 1), (100300, [float("inf")], 1),
             (100400, [], 1), (100500, [1.5, -2.5], 1), (100600, [-x for x in base], 1), (100700, base + [3.0, 4.0], 1)]
    return rows + rows[40:60] + [(0, [2.0] * dims, 5)]


@pytest.mark.parametrize("block_bytes, query_rows", [(innerproducts.BLOCK_BYTES, 1024), (56 * 16, 5), (56 * 200, 3)])
def test_same_as_brute_force(spark, block_bytes, query_rows):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS id", "2 AS score", "3 AS rank", "4 AS norm").repartition(5)
    assert listed(innerproducts.top_products(df, block_bytes=block_bytes, query_rows=query_rows)) == brute_force(rows)


def test_few_and_large(spark):
    rows = [(0, [1.0, 2.0], 0), (100, [3.0, -4.0], 0), (7, [0.5, 0.0], 0)]
    assert listed(innerproducts.top_products(spark.createDataFrame(rows, KIND))) == brute_force(rows)
    rows = [(i, [float(2 ** 18 + i), float(-i) * 1000, float(2 ** (i % 19))], 0) for i in range(0, 400, 4)]
    assert listed(innerproducts.top_products(spark.createDataFrame(rows, KIND))) == brute_force(rows)
    assert innerproducts.top_products(spark.createDataFrame([(1, [1.0], 0), (100, None, 0)], KIND)).isEmpty()


def test_pruning():
    """Most pairs are pruned by length or by the partial sums, and none of the best."""
    rng = np.random.default_rng(4)
    x = np.floor(1024 * rng.normal(size=(6000, 32)) * 0.7 ** np.arange(32) * rng.uniform(0.2, 2, (6000, 1))).astype("<i4")
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    turn, head = innerproducts.rotation_of(x.T.astype(float) @ x)
    assert head < 8 and np.allclose(turn.T @ turn, np.eye(32))
    c = innerproducts.Side(np.arange(6000).tobytes(), x.tobytes(), turn, head)
    q = innerproducts.Side(np.arange(10000, 10050).tobytes(), x[::120].tobytes(), turn, head)
    seen, whole = [], innerproducts.products
    innerproducts.products = lambda a, b: seen.append(len(a)) or whole(a, b)
    try:
        rows, ids, scores, _ = innerproducts.best_in_block(q, c, np.full(50, -np.inf), 10)
    finally:
        innerproducts.products = whole
    assert sum(seen) < 0.15 * 50 * 6000
    full = x[::120].astype(np.int64) @ x.T.astype(np.int64)
    for r in range(50):
        assert sorted(scores[rows == r], reverse=True) == sorted(full[r], reverse=True)[:10]


def test_query(spark, sf_dir, tmp_path):
    difference, _ = compare(spark, connect(sf_dir), NAME, registry.QUERIES[NAME], registry.ORACLE[NAME], sf_dir)
    assert difference is None
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES[NAME](spark, str(tmp_path))
    assert got.isEmpty() and dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
