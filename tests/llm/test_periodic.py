"""Baier grouping and periodic runs against plain definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts

from tabloom.llm import periodic as P
from tabloom.llm import queries as Q


def brute_lyndon(s):
    """Distance to the next lower suffix."""
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(s, least=24, times=3):
    n, out = len(s), []
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and s[j] == s[j + p]:
                j += 1
            long, own = j - i + p, s[i:j + p]
            if long >= max(least, times * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                out.append((i, long, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_grouping_yields_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 40))]
        ranks = np.unique(s, return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            assert P.lyndon_array(order.tolist()) == brute_lyndon(order.tolist())
    assert P.lyndon_array([]) == []


def rich(rng, letters):
    w = []
    while len(w) < rng.randrange(1, 90):
        w += [rng.choice(letters) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 10)
        if rng.random() < 0.3:
            w.append(f"z{rng.randrange(99)}")
    return w


@pytest.mark.parametrize("least,times", [(2, 2), (6, 3), (24, 3), (1, 4)])
def test_runs_equal_brute_force(least, times, monkeypatch):
    rng = random.Random(least)
    for k in range(500):
        docs = [rich(rng, "abcdef"[:rng.choice([1, 2, 3, 6])]) for _ in range(rng.randrange(1, 5))]
        monkeypatch.setattr(P, "PART_WORDS", rng.choice([1, 60, 100_000]))
        monkeypatch.setattr(P, "PASSES", rng.choice([1, 8]))
        runs, collapsed = P.find_runs([" ".join(w).encode() for w in docs], least, times)
        for w, r, c in zip(docs, runs, collapsed):
            want = brute_runs(w, least, times)
            assert [tuple(x) for x in r.tolist()] == want
            gone = {x for s, n, p in want for x in range(s + p, s + n)}
            assert c.decode() == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_fibonacci_and_long_repeats():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    for s in (b, "ab" * 4000, "x" * 5000, "abc" * 50 + "abd" * 50):
        got = P.runs_of(np.frombuffer(s.encode(), np.uint8).astype(np.int64), len(s), 10, 3)
        assert {tuple(r) for r in got.tolist()} == set(brute_runs(list(s), 10, 3) if len(s) < 2000 else [(0, len(s), len(set(s)))])


def expected(doc_id, text):
    """The contract's row, straight from its definition."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {x for s, m, p in runs for x in range(s + p, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
            hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_definition(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = Q.op13_periodic_runs(spark, SMALL).collect()
    assert len(rows) == len(text) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        if len((text[r.doc_id] or "").split()) < 1500:
            assert tuple(r)[1:] == expected(r.doc_id, text[r.doc_id]), r.doc_id


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("score", "runs")
    out = P.periodic_runs(docs)
    assert out.columns == ["doc_id", "lang", "n_tokens", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == len(odd_texts()) + 2
    for r in rows:
        if r.doc_id is not None and r.doc_id != 7:
            w = re.findall(r"[^\x20\x09-\x0D]+", odd_texts()[r.doc_id] or "")
            assert [tuple(x) for x in r.runs] == brute_runs(w)
    assert [r.collapsed for r in rows if r.doc_id in (0, 1, 2, 10)] == ["", "", "", "the"]
    got = {r.doc_id: tuple(r)[1:] for r in P.digest(P.periodic_runs(P.with_repeats(docs))).collect()}
    for i, t in [*enumerate(odd_texts()), (None, "null id")]:
        if i != 7:
            assert got[i] == expected(i, t), i
    assert P.digest(P.periodic_runs(P.with_repeats(empty_docs(spark)))).count() == 0
    assert P.periodic_runs(docs.select("text")).columns == ["runs", "collapsed"]
