"""Block vector search against a plain ranking of all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessella.functions.vectors import quantize
from tessella.operators import vector_search as S
from pyspark.sql import functions as F


def test_int8_products_are_exact():
    rng = np.random.default_rng(1)
    for d in (1, 63, 1024, 1025, 5000):
        a, b = (rng.integers(-127, 128, (7, d)).astype(np.int8) for _ in range(2))
        a[0], b[0] = 127, -127
        assert (S.int8_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    rows = [(m, f"d{i % 5}", i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300) for m in (["a", "b"] if i % 3 else ["a"])]
    rows += [("a", "x", 1000, None), ("a", "x", 1001, []), ("a", "x", 1002, [0.0] * 6), ("a", "x", 1003, [math.nan] * 6), ("a", "x", 1004, [1.0, 2.0]), ("a", "d0", 0, rows[0][3])]
    asked = [(i, "ab"[i % 2], [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(23)]
    return rows, [*asked, (50, "a", None), (51, "a", [3.0, 4.0]), (52, "none", [1.0] * 6), (53, "a", [0.0] * 6)]


def ranking(rows, asked, k, score):
    out = []
    for i, model, q in asked:
        own = []
        for m, doc, idx, v in rows:
            if m == model and q and v and len(q) == len(v):
                s = score(q, v)
                if math.isfinite(s):
                    own.append((-math.floor(s * 1e6 + 0.5) / 1e6, doc, idx))
        out += [(i, d, x, -s, n + 1) for n, (s, d, x) in enumerate(sorted(own)[:k])]
    return sorted(out)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float((a / (np.linalg.norm(a) or 1)) @ (b / (np.linalg.norm(b) or 1)))


@pytest.mark.parametrize("per_block, per_ask", [(8192, 4096), (40, 6), (1, 1000)])
def test_cosine(spark, made, per_block, per_ask):
    rows, asked = made
    vectors = spark.createDataFrame(rows, "model string, doc_id string, idx int, vector array<double>")
    queries = spark.createDataFrame(asked, "query_id long, model string, qvec array<double>")
    found = S.cosine_candidates(vectors, queries, 7, per_block=per_block, per_ask=per_ask).select("query_id", "doc_id", "idx", "score", "rank").collect()
    want = ranking(rows, asked, 7, cosine)
    assert [tuple(r)[:3] + (r.rank,) for r in sorted(found)] == [w[:3] + w[4:] for w in want]
    assert np.allclose([r.score for r in sorted(found)], [w[3] for w in want], atol=2e-6)


def test_int8(spark, made):
    rows, asked = ([(m, d, i, v) for m, d, i, v in made[0] if v and not math.isnan(v[0])], made[1])
    z = quantize(F.col("vector"))
    vectors = spark.createDataFrame(rows, "model string, doc_id string, idx int, vector array<double>").withColumn("z", z).select("model", "doc_id", "idx", "z.q", "z.scale")
    queries = spark.createDataFrame([a for a in asked if a[2]], "query_id long, model string, vector array<double>").withColumn("z", z).select("query_id", "model", "z.q", "z.scale")
    found = S.int8_candidates(vectors, queries, 5, per_block=50, per_ask=7).select("query_id", "doc_id", "idx", "score", "rank").collect()

    def small(v):
        s = max(map(abs, v)) / 127 or 1
        return np.array([math.floor(x / s + 0.5) for x in v]), float(np.float32(s))

    def score(a, b):
        (qa, sa), (qb, sb) = small(a), small(b)
        return int(qa @ qb) * sa * sb

    assert [tuple(r) for r in sorted(found)] == ranking(rows, [a for a in asked if a[2]], 5, score)


def test_empty(spark):
    vectors = spark.createDataFrame([], "model string, doc_id string, idx int, vector array<double>")
    queries = spark.createDataFrame([(1, "a", [1.0])], "query_id long, model string, qvec array<double>")
    assert S.cosine_candidates(vectors, queries, 3).collect() == []
