"""The pipeline's stages one after another against brute force on the small tables."""

import corpus_pipeline as C
from tests.conftest import SMALL
from tests.llm.cases import empty_docs, odd_docs, odd_texts
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_suffix_dedup import brute as brute_repeats
from tests.llm.test_tokens import check_pack, library  # noqa: F401

import __spark_entry__
from tabloom.llm.queries import op1_pu_toxicity


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_equal_brute_force(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    toxic = {r.doc_id for r in op1_pu_toxicity(spark, SMALL).collect() if r.predicted}
    want = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    out = []
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        docs = C.materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 1:
            want = [(d, t) for (d, t), (_, _, c) in zip(sorted(want), sorted(brute_groups(want), key=lambda r: r[0])) if d == c]
        if k == 2:
            want = sorted(want)
            gone = brute_repeats([(i, t.encode()) for i, t in want], 100)
            want = [(i, bytes(c for p, c in enumerate(t.encode()) if p not in g).decode("utf-8", "ignore")) for (i, t), g in zip(want, gone)]
        if k == 3:
            want = [w for w, (_, hit, _) in zip(want, brute_hits([t for _, t in want], items, 10)) if not hit]
        assert rows_of(docs) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        out.append(len(want))
    assert out[0] > out[1] >= out[3] > 0
    check_pack(C.STAGES[-1][1](spark, docs, SMALL).collect(), dict(want), library, 2048)


def test_registered_query_runs(spark, library):  # noqa: F811
    rows = __spark_entry__.queries()["pipeline"](spark, SMALL).collect()
    assert rows and "pipeline" not in __spark_entry__.oracle_sql()


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("score", "n_chars")
    n = len(odd_texts()) + 2
    for name, stage in C.STAGES:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "repeated_passages":
            assert len(rows) == n and {r.text for r in rows if r.doc_id == 0} == {None} and {r.text for r in rows if r.doc_id == 5} == {""}
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]
        assert stage(spark, empty_docs(spark).withColumnRenamed("lang", "n_chars"), SMALL).count() == 0


def test_stages_leave_no_copies_of_the_texts(spark, tmp_path, monkeypatch):
    """What a stage keeps with texts is a checkpoint, which Spark can delete; index and links go at once."""
    from tabloom import session
    old, folder = session.checkpoint_dir(spark), f"{tmp_path}/kept"
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: folder)
    spark.sparkContext.setCheckpointDir(folder)
    try:
        base = [" ".join(f"w{(7 * i + j) % 997}x{i % 40}" for j in range(60)) for i in range(200)]
        docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(base)], "doc_id long, text string, n_chars long")
        clean = C.drop_toxic(spark, docs, SMALL)
        once = C.drop_near_copies(spark, clean, SMALL)
        rows = rows_of(once)
    finally:
        spark.sparkContext.setCheckpointDir(old)
    assert 0 < len(rows) <= 200 and rows == rows_of(once)
    tables = {p.name.rpartition("-")[0] for p in (tmp_path / "kept" / "tables").iterdir()}
    assert not tables & {"scored", "units", "index", "links", "placed"} and "members" in tables


def workers_at_once(plan):
    """The most Python nodes that one task of a plan runs: of the whole plan, and above its highest exchanges."""
    parts = [workers_at_once(plan.children().apply(i)) for i in range(plan.children().size())]
    most = max([p[0] for p in parts], default=0)
    name = plan.nodeName()
    if "Exchange" in name:
        return most, 0
    here = [p[1] for p in parts]
    here = (max if name == "Union" else sum)(here or [0]) + ("InArrow" in name)
    return max(most, here), here


def test_a_task_needs_one_python_worker(spark):
    """Executors keep every worker that a task ever needed beside the heap, so steps of one task add up."""
    from pyspark.sql import functions as F
    from tabloom.llm.decontaminate import benchmark_hits
    from tabloom.llm.ngram_join import linked, residual_pairs
    from tabloom.llm.suffix_dedup import remove_repeats, without_repeats
    docs = spark.createDataFrame([(1, "a b c " * 50, 300), (2, None, None)], "doc_id long, text string, n_chars int")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    sets = spark.createDataFrame([(1, 1, b"", b"")], "node long, n long, bits binary, shingles binary")
    pairs = spark.createDataFrame([(1, 1)], "a long, b long")
    keys, labels = sets.select("node", F.col("n").alias("key")), sets.select("node", F.col("node").alias("label"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frames = {"without": without_repeats(docs), "remove": remove_repeats(docs), "search": benchmark_hits(docs, items),
                  "count": benchmark_hits(docs, items.limit(0)), "star": linked(pairs, sets, 75),
                  "residual": linked(residual_pairs(keys, sets, labels, 75, []), sets, 75)}
        found = {k: workers_at_once(df._jdf.queryExecution().executedPlan())[0] for k, df in frames.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert set(found.values()) == {1}, found
