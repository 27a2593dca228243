"""Repeated-passage removal against a search over every string."""

import hashlib
import random

import numpy as np
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts

from tabloom.llm import queries as Q
from tabloom.llm import suffix_dedup as S


def brute(docs, width):
    """docs: (order, bytes) -> removed byte positions of each."""
    seen, out = set(), []
    for _, raw in sorted(docs, key=lambda d: d[0]):
        gone = set()
        for s in range(len(raw) - width + 1):
            w = raw[s:s + width]
            if w in seen:
                gone.update(range(s, s + width))
            seen.add(w)
        out.append(gone)
    return out


def runs(gone):
    return sum(1 for p in gone if p - 1 not in gone)


def test_multikey_sort():
    rng = np.random.default_rng(1)
    for _ in range(30):
        w = rng.integers(0, 3, (rng.integers(1, 60), 3)).astype(np.uint64) << np.uint64(rng.integers(0, 60))
        order, lcp = S.multikey_sort(w)
        rows = [w[i].astype(">u8").tobytes() for i in order]
        assert rows == sorted(rows)
        for k in range(1, len(rows)):
            same = next((j for j in range(24) if rows[k][j] != rows[k - 1][j]), 24)
            assert lcp[k] == same


def test_anchors_depend_on_content():
    rng = random.Random(2)
    body = bytes(rng.choice(b"abc d") for _ in range(400))
    a, b = b"x" * 37 + body, bytes(rng.choice(b"pqr") for _ in range(211)) + body + b"tail" * 30

    def of(t):
        raw = np.frombuffer(t, np.uint8)
        at, first, last = S.anchors(raw, np.array([len(t)]), 100, S.Rolling(raw))
        assert (np.sort(np.concatenate([np.arange(f, z + 1) for f, z in zip(first, last)])) == np.arange(len(t) - 99)).all()
        return {s: p for p, f, z in zip(at, first, last) for s in range(f, z + 1)}
    x, y = of(a), of(b)
    for s in range(301):
        assert x[37 + s] - 37 == y[211 + s] - 211


def test_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want = brute(docs, 100)
    assert any(want)
    got = {r.doc_id: r for r in Q.op8_suffix_array(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for (i, raw), gone in zip(docs, want):
        rest = bytes(c for k, c in enumerate(raw) if k not in gone)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), len(gone), runs(gone)), i
        assert r.kept_sha256 == hashlib.sha256(rest).hexdigest()


def small_docs(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))) for i in range(60)]


def test_small_alphabet(spark, monkeypatch):
    for seed, bucket in ((1, 100_000), (2, 40)):
        monkeypatch.setattr(S, "BUCKET_SUFFIXES", bucket)     # 40: many buckets, and heavy leading strings
        rows = small_docs(seed)
        out = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()}
        want = brute([(i, t.encode()) for i, t in rows], 40)
        for (i, t), gone in zip(rows, want):
            assert bytes(out[i].kept) == bytes(c for k, c in enumerate(t.encode()) if k not in gone)
            assert out[i].n_spans == runs(gone)


def test_heavy_strings_are_split():
    sample = np.frombuffer(b"0123456789abcdef" * 50 + bytes(range(160)), np.uint8).reshape(-1, S.GRAM)
    plan = S.Plan(sample, 5_000_000, 8)
    assert plan.heavy.tolist() == [b"0123456789abcdef"] and plan.parts[0] > 40 and plan.buckets == plan.n + plan.parts[0]


def test_odd_rows(spark):
    t = odd_texts()
    docs = odd_docs(spark).withColumnRenamed("score", "kept")
    out = S.remove_repeats(docs, 100).collect()
    assert len(out) == len(t) + 2 and out[0].asDict().keys() == {"doc_id", "text", "lang", "n_tokens", "kept", "n_bytes", "n_removed", "n_spans"}
    four = [r for r in out if r.doc_id == 4]
    assert sorted(r.n_removed for r in four) == [0, len(t[4])]          # a repeated row is a later copy
    by = {r.doc_id: r for r in out}
    assert by[5].n_removed == len(t[5]) and by[12].n_removed == len(t[4])
    assert by[0].n_bytes == 0 and by[0].kept == b"" and by[6].n_removed == 0
    assert by[10].n_removed == len(t[10]) - 4 and by[10].n_spans == 1     # period of four bytes
    assert S.remove_repeats(empty_docs(spark)).count() == 0
