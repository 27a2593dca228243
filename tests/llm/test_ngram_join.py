"""Shingle sets and Jaccard components against brute force."""

import random
import re
import sys
from collections import defaultdict

import numpy as np
import pytest
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts

from tabloom.llm import ngram_join as N
from tabloom.llm import queries as Q
from tabloom.llm.components import components


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=75, k=5):
    """rows: (id, text) -> sorted (id, n, component)."""
    sets = [shingles(t, k) for _, t in rows]
    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(seed, docs, words, vocabulary):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(3, words))] for _ in range(5)]
    rows = []
    for i in range(docs):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(w) // 15)):
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(0, 2)] = [f"w{rng.randrange(vocabulary)}"] * rng.randrange(0, 2)
        rows.append((i, " ".join(w)))
    return rows


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute(rows)
    assert any(d != c for d, _, c in want)
    assert got(Q.op2_token_combinations(spark, SMALL)) == want


@pytest.mark.parametrize("frequent", [1, 4])
def test_classes_and_blocks(spark, monkeypatch, frequent):
    """Class 1 as the frequent one: every candidate comes through combinations; small units and blocks."""
    monkeypatch.setattr(N, "FREQUENT", frequent)
    monkeypatch.setattr(N, "UNIT_BYTES", 4000)
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = near_copies(3 + frequent, 150, 120, 60)
    assert got(N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_combinations_cover_all_links():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(3000):
        n = int(rng.integers(4, 120))
        x = rng.integers(1, 1 << 62, n).astype(np.uint64)
        cut, add = rng.integers(0, n // 4 + 1), rng.integers(0, n // 4 + 1)
        y = np.concatenate([x[cut:], rng.integers(1, 1 << 62, add).astype(np.uint64)])
        if 100 * (n - cut) < 75 * (n + add):
            continue
        a, ok_a = N.class_keys(x, 75)
        b, ok_b = N.class_keys(y, 75)
        if ok_a or ok_b:
            assert set(a.tolist()) & set(b.tolist())
        missed += not (ok_a or ok_b)
    assert missed < 1000


def test_bitmaps_never_reject_a_link():
    rng = np.random.default_rng(6)
    for _ in range(800):
        n = int(rng.integers(1, 300))
        x = rng.integers(1, 1 << 62, n).astype(np.uint64)
        cut, add = int(rng.integers(0, n // 3 + 1)), int(rng.integers(0, n // 3 + 1))
        y = np.concatenate([x[cut:], rng.integers(1, 1 << 62, add).astype(np.uint64)])
        if 100 * (n - cut) >= 75 * (n + add):
            assert N.can_link(N.bitmap(x), N.bitmap(y), n, len(y), 75)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    out = N.jaccard_components(odd_docs(spark).withColumnRenamed("score", "n_shingles"))
    assert out.columns == ["doc_id", "lang", "n_tokens", "n_shingles", "component_id"]
    assert got(out) == brute(rows)
    assert N.jaccard_components(empty_docs(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 200)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, 200: 200}


def test_thue_morse_words_are_not_linked(spark):
    """Words on which every polynomial hash modulo a power of two collides: a Thue-Morse string and its complement."""
    rows = []
    for n in (512, 1024, 4096, 8192):
        a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        rows += [(len(rows), a), (len(rows) + 1, a.translate(str.maketrans("ab", "ba")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(docs, 5, 75).collect()}
    assert got == {i: (1, i) for i, _ in rows}


def test_words_are_hashed_together():
    """A text of more distinct words takes no more calls."""
    def calls(n):
        seen = []
        texts = [" ".join(f"word{i}x{j}" for j in range(n)).encode() for i in range(3)]
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            N.shingle_sets(texts, 5)
        finally:
            sys.setprofile(None)
        return len(seen)
    calls(10)
    assert calls(5000) < 2 * calls(50) + 50


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingles_of_odd_words_equal_brute_force(k):
    """Words of every length, on both sides of the chunks of eight bytes and of LONG_WORD; texts without words between others."""
    rng = random.Random(k)
    texts = []
    for _ in range(150):
        words = ["".join(rng.choice("aAbB\0é") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 40, 63, 64, 65, 66, 130))))
                 for _ in range(rng.choice((0, 1, 2, 4, 5, 6, 30)))]
        words += words[:rng.randrange(10)]
        texts.append(rng.choice((" ", "\n", "\x0b", "\x0c", " \t", "\x1c ", "\x85 ")).join(words) + rng.choice(("", " ", "\r")))
    doc, h = N.shingle_sets([t.encode() for t in texts], k)
    sets = [shingles(t, k) for t in texts]
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(h[doc == i], h[doc == j])) == len(sets[i] & sets[j])
