"""Exact top-k search against brute force in whole numbers."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import max_score, queries

SCHEMA = "vec_id long, embedding array<float>, score string, number int"


def brute_force(rows, k=10, every=100):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j is None, j or 0, j) for b, (j, v) in enumerate(kept) if a != b)
            out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k])]
    return Counter(out)


def found(df):
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vector = lambda n=6: [rng.choice([-0.5, 0.25, rng.gauss(0, 0.3)]) for _ in range(n)]
    out = [(i, vector()) for i in range(400)]
    out += [(400 + i, out[7][1]) for i in range(60)]  # a hot vector: ties beyond k
    out += [out[100]] * 3 + [out[5]] * 2 + [(200, vector()), (100, [*out[100][1], 0.0])]
    out += [(500, None), (600, [0.1, None]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (900, []), (1000, vector(2)), (1001, vector(9)), (None, vector()), (None, [9.0] * 6), (-100, vector())]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("shard", "block"), [(16384, 1 << 24), (16, 64), (50, 1 << 24)])
def test_equals_brute_force(spark, rows, shard, block):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    assert found(max_score.top_k(df, shard_rows=shard, block_bytes=block)) == brute_force(rows)


def test_few_and_no_candidates(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (100, [0.5, 0.5])]
    for part in (few, few[:1], few[1:2], []):
        assert found(max_score.top_k(spark.createDataFrame([(i, v, "x", 1) for i, v in part], SCHEMA))) == brute_force(part)


def test_too_large_scores_are_errors():
    with pytest.raises(OverflowError):
        max_score.Shard(np.array([[1 << 40]]), [1]).search(np.array([1 << 40]), 0, 10, None)


def test_terms_are_left_out():
    """Vectors near the query: few terms are traversed whole, and few vectors are probed to the end."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (5000, 64))
    query = vectors[0]
    shard = max_score.Shard(vectors, list(range(5000)))
    want = np.sort(vectors[1:] @ query)[-10:]
    at, scores = shard.search(query, 0, 10, int(want[0]))
    assert sorted(scores) == sorted(want) and 0 not in at


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = found(queries.op12_max_score(spark, sf))
    assert got == Counter(con.sql(max_score.SQL).select("query_id, rank, vec_id, score").fetchall())
    assert got == brute_force(con.sql("SELECT vec_id, embedding FROM embeddings").fetchall())
