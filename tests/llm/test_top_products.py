"""Top-k integer products against the full product matrix."""

import math

import numpy as np
import pytest
from tests.conftest import SMALL

from tabloom.llm import queries as Q
from tabloom.llm import top_products as T


def brute(rows, k, every, scale):
    """rows: (id, vector) -> sorted (query, rank, id, score)."""
    ok = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q % every == 0:
            s = sorted((-sum(p * r for p, r in zip(x, y)), i) for b, (i, y) in enumerate(ok) if a != b)
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert got(Q.op6_norm_buckets(spark, SMALL)) == brute(rows, 20, 20, 64)


@pytest.mark.parametrize("from_", [0.0, 0.5, 2.0])
def test_pruning_keeps_the_best(spark, monkeypatch, from_):
    """Vectors of many lengths in small buckets, with coordinate pruning always, sometimes and never."""
    monkeypatch.setattr(T, "COORDINATE_FROM", from_)
    monkeypatch.setattr(T, "BUCKET", 40)
    monkeypatch.setattr(T, "BLOCK", 9)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (centre[rng.integers(6)] * rng.uniform(0.02, 3) + rng.normal(size=8) * 0.05).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(T.top_products(df, 7, 5, 64)) == brute(rows, 7, 5, 64)


def test_candidates_prune():
    rng = np.random.default_rng(8)
    q, p = rng.normal(size=(20, 6)) * 100, rng.normal(size=(500, 6)) * 100
    q[:3] *= 0.01
    s = q @ p.T
    for share in (1, 5, 50):
        low = np.sort(s, axis=1)[:, -share]
        keep = T.candidates(q, p, low)
        assert (keep | (s < low[:, None])).all()
    assert T.candidates(q, p, np.sort(s, axis=1)[:, -1]).mean() < 0.6


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (20, [0.5, -1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (40, []), (7, [0.0, 0.0]),
            (8, [1.0, 2.0, 3.0]), (60, [3e6, -2e6])]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, score double, rank string")
    assert got(T.top_products(df, 4, 20, 64)) == brute(rows, 4, 20, 64)
    assert T.top_products(df.limit(0)).count() == 0
    assert T.top_products(df.where("vec_id = 0")).count() == 0
