"""Registered queries do the whole job: every row, and results that don't follow the layout."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from tabloom.operators import modeling as M
from tabloom.plans import queries_keys as K
from tabloom.plans import queries_model as Q


def test_every_customer_goes_round(spark, monkeypatch):
    written = []
    create, insert = K.S.create_table, K.S.insert_rows
    monkeypatch.setattr(K.S, "create_table", lambda s, name, df: (written.append(df), create(s, name, df)))
    monkeypatch.setattr(K.S, "insert_rows", lambda df, name: (written.append(df), insert(df, name)))
    K.catalog_round_trip(spark, SMALL).collect()
    keys = [r[0] for df in written for r in df.select("c_custkey").collect()]
    assert sorted(keys) == sorted(r[0] for r in spark.read.parquet(f"{SMALL}/customer.parquet").select("c_custkey").collect())


def test_trees_do_not_follow_the_partitions(spark):
    df = spark.range(600).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * F.col("b") + F.col("id") % 3)

    def sums(n):
        model = M.train_gbt(M.training_input(df.repartition(n)), ["a", "b"], "y", {"n_estimators": 5, "subsample": 0.5})
        return [round(r.prediction, 6) for r in M.predict(model, df).orderBy("id").collect()]

    assert sums(1) == sums(7)


def test_registered_sizes_are_the_reference_s(monkeypatch):
    """100 rounds, 5 folds, 50 trials on 3 folds, and 5 x 3 nested folds; nothing is trained here."""
    calls = {}

    def stand_in(name):
        def call(*args, **kwargs):
            calls[name] = (args, kwargs)
            raise StopIteration
        return call

    monkeypatch.setattr(Q, "_prepared", lambda spark, sf: (None, []))
    monkeypatch.setattr(Q.M, "add_folds", lambda data, key, k, seed: k)
    for name in ("cross_validate", "simple_tuning"):
        monkeypatch.setattr(Q.M, name, stand_in(name))
    monkeypatch.setattr(Q.M, "nested_cv", stand_in("nested_cv_tuning"))
    for name in ("cross_validate", "simple_tuning", "nested_cv_tuning"):
        with pytest.raises(StopIteration):
            getattr(Q, name)(None, SMALL)
    assert Q._TRAIN_PARAMS["n_estimators"] == 100 and Q._SPACE["n_estimators"] == (50, 200)
    assert calls["cross_validate"][0][0] == calls["cross_validate"][0][-1] == 5
    assert calls["simple_tuning"][1]["n_trials"] == 50 and calls["simple_tuning"][1]["k"] == 3
    assert [calls["nested_cv_tuning"][1][k] for k in ("outer", "inner", "n_trials")] == [5, 3, 50]


def test_train_and_test_rows_are_predicted_once(spark, monkeypatch):
    """Metrics and verdict come from one pass over the predictions."""
    rows = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def guess(x):
        rows.add(1)
        return x + 1.0

    data = spark.range(40).select(F.col("id").cast("double").alias("l_extendedprice"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    monkeypatch.setattr(Q, "_prepared", lambda spark, sf: (data, ["l_extendedprice"]))
    monkeypatch.setattr(Q.M, "train_gbt", lambda *a: None)
    monkeypatch.setattr(Q.M, "predict", lambda model, df: df.withColumn("prediction", guess("l_extendedprice")))
    got = Q.train_test_metrics(spark, SMALL).collect()
    assert sorted((r.split, r.n, r.mae) for r in got) == [("test", 10, 1.0), ("train", 30, 1.0)] and rows.value == 40
