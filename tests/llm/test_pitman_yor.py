"""The Pitman-Yor model: exact counts and base scores, normalisation, gain over the base, awkward rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts

from tabloom.llm import pitman_yor as P
from tabloom.llm import queries as Q


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def check_counts(rows, docs, trained):
    c = Counter(w for i, t in docs if trained(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    texts = dict(docs)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0


def test_query_counts_and_gain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = Q.op5_pitman_yor(spark, SMALL).collect()
    assert len(rows) == len(docs)
    check_counts(rows, docs, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in rows if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in held)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_split_contexts(spark, monkeypatch):
    """Contexts with a large share are split, and the counts stay exact."""
    monkeypatch.setattr(P, "BUCKET_TOKENS", 200)
    docs = [(i, "the " * (i % 7 + 1) + f"the cat{i % 5} sat on the mat of the dog{i % 11}") for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(P.layout_of(frame, "text", 120, 40).contexts)
    rows = P.score_documents(frame, F.col("doc_id") % 3 != 0).collect()
    check_counts(rows, docs, lambda i: i % 3 != 0)


def test_splits_and_partitions_change_no_score(spark, monkeypatch):
    """A split context scores as a whole one does, whatever the session's number of partitions."""
    monkeypatch.setattr(P, "BUCKET_TOKENS", 200)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(x for w in rng.zipf(1.3, 12) for x in ("the", words[w % 60]))) for i in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")

    def scores():
        return {r.doc_id: r.score for r in P.score_documents(frame, F.col("doc_id") % 3 != 0).collect()}

    split = scores()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    other = scores()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    shuffled = {r.doc_id: r.score for r in P.score_documents(frame.repartition(5), F.col("doc_id") % 3 != 0).collect()}
    assert len(P.layout_of(frame, "text", 150, 40).contexts)
    monkeypatch.setattr(P, "layout_of", lambda docs, text, total, buckets: P.Layout(buckets, {}))
    whole = scores()
    assert split.keys() == whole.keys() == other.keys() == shuffled.keys()
    for i in whole:
        assert math.isclose(split[i], whole[i], abs_tol=1e-4) and math.isclose(other[i], whole[i], abs_tol=1e-4)
        assert math.isclose(shuffled[i], whole[i], abs_tol=1e-4)


def test_predictions_sum_to_one():
    """Over all words of the vocabulary and one unseen word, in every context."""
    rng = np.random.default_rng(3)
    v = 30
    token = rng.zipf(1.5, 4000) % v
    ctx, word = token[:-1], token[1:]
    pair, count = np.unique(np.stack([ctx, word], 1), axis=0, return_counts=True)
    all_pairs = np.array([(u, w) for u in range(v + 1) for w in range(v + 1)])       # word and context v are unseen
    c = np.zeros(len(all_pairs), np.int64)
    c[pair[:, 0] * (v + 1) + pair[:, 1]] = count
    overall = np.bincount(word, minlength=v + 1)
    seen = overall > 0
    assert seen[:v].all()
    model = P.Restaurants(all_pairs[:, 0], all_pairs[:, 1], c, overall[all_pairs[:, 1]], np.full(len(c), -1.0),
                          (len(word), v, int((overall == 1).sum()), int((overall == 2).sum())))
    p = model.predict(np.random.default_rng(0))
    assert np.allclose(np.bincount(all_pairs[:, 0], p), 1, atol=1e-9)
    often = c > 20
    assert np.abs(p[often] / (c / model.in_context.clip(1))[often] - 1).max() < 0.25


def test_seating():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 50, 5000, 1])
    t = P.seat(c.astype(float), np.full(6, 0.5), 0.5, rng)
    assert t[0] == 0 and t[1] == t[5] == 1 and (t[1:] >= 1).all() and (t <= c).all() and t[4] > t[3]
    assert (P.seat(np.full(50, 300.0), np.full(50, 1e-12), 0.5, rng) == 1).all()


def test_odd_rows(spark):
    frame = odd_docs(spark)
    out = P.corpus_scores(frame).collect()
    t = odd_texts()
    assert len(out) == len(t) + 2 and "lang" in out[0].asDict() and "text" not in out[0].asDict()
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    c = Counter(w for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(x))
    by = {r.doc_id: r for r in out}
    assert by[0].n_tokens == by[1].n_tokens == by[2].n_tokens == 1 and by[0].score == by[1].score
    assert by[4].train_tokens == sum(c.values())
    assert P.corpus_scores(empty_docs(spark)).count() == 0
    untrained = P.score_documents(frame, F.lit(None).cast("boolean")).collect()
    assert {r.train_tokens for r in untrained} == {0} and {r.n_known for r in untrained} == {0}
