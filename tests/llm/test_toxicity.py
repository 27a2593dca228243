"""Positive-unlabelled toxicity scores: held-out accuracy, the risk estimator, awkward rows."""

import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts

from tabloom.llm import queries as Q
from tabloom.llm import toxicity as T
from tabloom.llm.toxicity import Features, fit, score, toxicity


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    y = np.array(labels) == 1
    return (order[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


def test_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in Q.op1_pu_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    own = [(rows[i].score, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    assert auc(*zip(*own)) > 0.85


def test_fit_finds_the_toxic_word_among_unlabelled():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]

    def text(toxic):
        w = list(rng.choice(words, 30))
        return " ".join(w + ["vile"] * toxic).encode()
    p = [text(1) for _ in range(60)]
    u = [text(rng.random() < 0.2) for _ in range(400)]
    f, w, b = fit(p, u, 0.2)
    z = {x: b + sum(dict(zip(f.tolist(), w)).get(k, 0) for k in Features().of(x)) for x in (text(0), text(1))}
    assert sorted(z.values())[1] > 0 > sorted(z.values())[0]


def test_pipeline_stage_keeps_clean_documents(spark, tmp_path, monkeypatch):
    """Clean documents that score above 0.5 stay, if a higher threshold parts them from the toxic ones."""
    docs = [(i, "vile words" if i % 10 == 0 else "odd words" if i % 10 == 1 else "words") for i in range(400)]
    spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in docs], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    weights = sorted({**{f: 5.0 for f in T.word_features(b"vile")}, T.hashed(b"=odd"): 2.0}.items())
    member = (np.array([f for f, _ in weights]), np.array([w for _, w in weights]), -1.0)
    monkeypatch.setattr(T, "train", lambda *a, **k: ([member], 0.1))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, frame, str(tmp_path)).collect()}
    assert left == {i for i, _ in docs if i % 10}


def test_reject_threshold_counts_every_clean_document(spark, tmp_path, monkeypatch):
    """30 of 30,000 clean documents score high: the whole table allows their rejection, a draw that meets all 30 does not."""
    n = 30_000
    at = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))).alias("at")
    ids = spark.range(5 * n).select(F.col("id").alias("doc_id")).where(~T.held_out()).orderBy("doc_id").limit(n)
    vile = {r.doc_id for r in ids.select("doc_id", at).orderBy("at").limit(30).collect()}
    docs = ids.select("doc_id", F.when(F.col("doc_id").isin(list(vile)), "vile words").otherwise("words").alias("text"))
    docs.select("doc_id", F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    weights = sorted({f: 5.0 for f in T.word_features(b"vile")}.items())
    member = (np.array([f for f, _ in weights]), np.array([w for _, w in weights]), -1.0)
    monkeypatch.setattr(T, "train", lambda *a, **k: ([member], 0.1))
    left = corpus_pipeline.drop_toxic(spark, docs.unionByName(docs.limit(50)), str(tmp_path))
    assert left.select("doc_id").distinct().count() == n - 30 and left.where("text like 'vile%'").count() == 0


def test_reject_threshold_of_few_or_no_clean_documents(spark):
    scored = spark.createDataFrame([(1, 0.2), (1, 0.7), (2, 0.1), (None, 0.9), (3, 0.95)], "doc_id long, score double")
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, None), (3, 0), (3, 1), (None, 0), (9, 0)], "doc_id long, toxic int")
    assert T.reject_threshold(scored, labels) == np.nextafter(0.7, 2)
    assert T.reject_threshold(scored, labels.where("doc_id = 2")) == 0.5
    assert T.reject_threshold(scored, labels.where("doc_id = 9")) == 0.5


def test_held_out_rates_of_the_stage(spark):
    """Clean documents rejected and toxic ones found, with the committed model on documents it has not learnt from."""
    sf = SMALL.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = spark.read.parquet(f"{sf}/labels.parquet").where(T.held_out()).join(docs.select("doc_id"), "doc_id").collect()
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    clean, toxic = ([r.doc_id not in left for r in own if r.toxic == y] for y in (0, 1))
    assert np.mean(clean) <= 0.005 and np.mean(toxic) >= 0.5


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 0), (8, 1), (2, 0), (99, 1)], "doc_id long, toxic int")
    out = toxicity(odd_docs(spark), labels).collect()
    assert len(out) == len(odd_texts()) + 2 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[0] == by[1] == by[2]                       # null, empty and blank texts: the bias alone
    assert len({r.score for r in out if r.doc_id in (4, 5)}) == 1
    assert not [r for r in out if r.doc_id is None][0].held_out
    assert toxicity(empty_docs(spark), labels).count() == 0
    assert {r.score for r in score(odd_docs(spark), [], 0.25).collect()} == {0.25}
    assert toxicity(odd_docs(spark), labels.limit(0)).where("score != 0").count() == 0
