"""Modelling (M) and run-record (R) queries.

Split, fold, metric and run-record queries have DuckDB twins.  Training,
cross-validation, tuning and selection depend on Spark's tree learner and
get the rows-only check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import modeling as M
from tabloom.operators import params as PR
from tabloom.operators import runs as R
from tabloom.plans import views as V
from tabloom.plans.registry import query, rnd, rounded
from tabloom.session import scratch_table_path

_SEED = 42
_U = M.uniform_sql("l_orderkey", _SEED)
_U_FOLD = M.uniform_sql("l_orderkey", _SEED, "fold")


@query("split_counts", f"""
SELECT CASE WHEN {_U} < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows,
       count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1""")
def split_counts(spark, sf):
    li = M.add_split(V.table(spark, sf, "lineitem"), "l_orderkey", 0.2, _SEED)
    return li.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("fold_counts", f"""
SELECT CAST(least(floor({_U_FOLD} * 5), 4) AS INTEGER) AS fold, count(*) AS n_rows FROM lineitem GROUP BY 1""")
def fold_counts(spark, sf):
    li = M.add_folds(V.table(spark, sf, "lineitem"), "l_orderkey", 5, _SEED)
    return li.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("time_split_counts", """
WITH c AS (SELECT quantile_cont(epoch(o_orderdate), 0.8) AS cut FROM orders)
SELECT CASE WHEN epoch(o_orderdate) > cut THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows,
       strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
FROM orders, c GROUP BY 1""")
def time_split_counts(spark, sf):
    o = M.add_time_split(V.table(spark, sf, "orders"), "o_orderdate", 0.2)
    return rounded(o.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.to_date(F.min("o_orderdate")).alias("first_day"),
                                          F.to_date(F.max("o_orderdate")).alias("last_day")))


_METRICS_SQL = f"""
SELECT CASE WHEN {_U} < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) AS r2,
       avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse
FROM preds GROUP BY 1"""


@query("regression_metrics", "SELECT split, n, round(r2, 6) AS r2, round(mae, 4) AS mae, round(mse, 2) AS mse, "
       "round(rmse, 4) AS rmse FROM (" + _METRICS_SQL + ")", ("preds",))
def regression_metrics(spark, sf):
    p = M.add_split(V.preds(spark, sf), "l_orderkey", 0.2, _SEED)
    m = M.regression_metrics(p, "y", "yhat", group_by=["split"])
    return m.select("split", "n", rnd("r2", 6).alias("r2"), rnd("mae", 4).alias("mae"),
                    rnd("mse", 2).alias("mse"), rnd("rmse", 4).alias("rmse"))


@query("overfit_flags", """
WITH m AS (""" + _METRICS_SQL + """),
     w AS (SELECT max(r2) FILTER (WHERE split = 'train') AS train_r2, max(r2) FILTER (WHERE split = 'test') AS test_r2,
                  max(rmse) FILTER (WHERE split = 'train') AS train_rmse, max(rmse) FILTER (WHERE split = 'test') AS test_rmse
           FROM m)
SELECT round(train_r2, 6) AS train_r2, round(test_r2, 6) AS test_r2, round(train_r2 - test_r2, 6) AS r2_difference,
       round(test_rmse - train_rmse, 4) AS rmse_difference,
       (train_r2 - test_r2 > 0.1) OR (test_r2 < 0.5 AND train_r2 > 0.7) AS is_overfitting,
       array_to_string(list_filter([CASE WHEN train_r2 - test_r2 > 0.1 THEN 'r2_gap' END,
                                    CASE WHEN test_rmse - train_rmse > 0 THEN 'test_rmse_higher' END,
                                    CASE WHEN test_r2 < 0.5 AND train_r2 > 0.7 THEN 'high_train_low_test' END],
                                   lambda x: x IS NOT NULL), ',') AS reasons
FROM w""", ("preds",))
def overfit_flags(spark, sf):
    p = M.add_split(V.preds(spark, sf), "l_orderkey", 0.2, _SEED)
    f = M.overfit_flags_df(M.regression_metrics(p, "y", "yhat", group_by=["split"]))
    return f.select(rnd("train_r2", 6).alias("train_r2"), rnd("test_r2", 6).alias("test_r2"),
                    rnd("r2_difference", 6).alias("r2_difference"),
                    rnd("rmse_difference", 4).alias("rmse_difference"), "is_overfitting", "reasons")


# --- the modelling table: lineitem with part attributes --------------------------------

def model_table(spark, sf):
    li = V.table(spark, sf, "lineitem")
    p = V.table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return li.join(p, li.l_partkey == p.p_partkey, "left").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate", "p_type", "p_size", "p_retailprice", "l_extendedprice")


_FEATURE_SQL = """
WITH t AS (SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
                  l.l_shipdate, p.p_type, p.p_size, p.p_retailprice, l.l_extendedprice
           FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
     rf AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT l_returnflag AS v FROM t WHERE l_returnflag IS NOT NULL)),
     ls AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT l_linestatus AS v FROM t WHERE l_linestatus IS NOT NULL)),
     pt AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT p_type AS v FROM t WHERE p_type IS NOT NULL))
SELECT t.l_orderkey, t.l_linenumber, t.l_quantity, t.l_discount, t.l_tax, rf.code AS l_returnflag, ls.code AS l_linestatus,
       pt.code AS p_type, t.p_size, round(t.p_retailprice, 4) AS p_retailprice, round(t.l_extendedprice, 4) AS l_extendedprice,
       CAST(year(t.l_shipdate) AS INTEGER) AS l_shipdate_year, CAST(month(t.l_shipdate) AS INTEGER) AS l_shipdate_month,
       CAST(day(t.l_shipdate) AS INTEGER) AS l_shipdate_day, CAST(isodow(t.l_shipdate) - 1 AS INTEGER) AS l_shipdate_dayofweek
FROM t LEFT JOIN rf ON t.l_returnflag = rf.v LEFT JOIN ls ON t.l_linestatus = ls.v LEFT JOIN pt ON t.p_type = pt.v"""


@query("feature_pipeline", _FEATURE_SQL)
def feature_pipeline(spark, sf):
    t = model_table(spark, sf)
    fp = M.fit_feature_pipeline(t, target="l_extendedprice")
    return rounded(fp.apply(t))


def _prepared(spark, sf):
    t = model_table(spark, sf)
    train = M.add_split(t, "l_orderkey", 0.2, _SEED).where(F.col("split") == "train").drop("split")
    fp = M.fit_feature_pipeline(train, target="l_extendedprice")      # the test rows are not looked at
    data = M.add_split(fp.apply(t), "l_orderkey", 0.2, _SEED)
    feats = [c for c in data.columns if c not in ("l_orderkey", "l_linenumber", "l_extendedprice", "split")]
    return data, feats


# The reference's sizes; num_leaves and the regularisation weights have no equivalent.
_TRAIN_PARAMS = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5, "subsample": 0.8}
_SPACE = {"n_estimators": (50, 200), "max_depth": (3, 10), "learning_rate": (0.01, 0.3), "min_child_samples": (5, 20),
          "subsample": (0.7, 1.0), "colsample": (0.7, 1.0)}


@query("gbt_train_predict")
def gbt_train_predict(spark, sf):
    """M4-M7 + M15 + M16: fit the feature pipeline and the model on the train
    split, save both, reload them and score the raw test rows (no refit)."""
    raw = M.add_split(model_table(spark, sf), "l_orderkey", 0.2, _SEED)
    raw_test = raw.where(F.col("split") == "test")
    # the training rows are joined once and checkpointed; the pipeline fit and
    # every boosting round read the checkpoint
    raw_train = M.training_input(raw.where(F.col("split") == "train").drop("split"))
    fp = M.fit_feature_pipeline(raw_train, target="l_extendedprice")
    train = M.training_input(fp.apply(raw_train))      # the codes' join may have moved rows
    feats = [c for c in train.columns if c not in ("l_orderkey", "l_linenumber", "l_extendedprice")]
    model = M.train_gbt(train, feats, "l_extendedprice", _TRAIN_PARAMS)
    path = scratch_table_path(spark, "gbt")
    M.save_model(model, path, {"features": feats, "target": "l_extendedprice", "params": _TRAIN_PARAMS})
    PR.save_params(fp, f"{path}/feature_pipeline")
    loaded, meta = M.load_model(path)
    fp2 = PR.load_params(spark, f"{path}/feature_pipeline")
    pred = M.predict(loaded, fp2.apply(raw_test.drop("split")))
    return rounded(pred.select("l_orderkey", "l_linenumber", "l_extendedprice", "prediction"))


@query("model_reload_same", f"""
SELECT l_orderkey, l_linenumber, true AS same, true AS within_labels FROM lineitem WHERE {_U} < 0.2""")
def model_reload_same(spark, sf):
    """Every test row's prediction by the reloaded model equals that of the model in memory and lies in the labels' range."""
    data, feats = _prepared(spark, sf)
    train = M.training_input(data.where(F.col("split") == "train"))
    model = M.train_gbt(train, feats, "l_extendedprice", _TRAIN_PARAMS)
    path = scratch_table_path(spark, "gbt")
    M.save_model(model, path, {"features": feats})
    loaded, _ = M.load_model(path)
    lo, hi = train.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    test = M.predict(loaded, M.predict(model, data.where(F.col("split") == "test"), "in_memory"), "reloaded")
    slack = (hi - lo) / 2
    return test.select("l_orderkey", "l_linenumber", (F.col("in_memory") == F.col("reloaded")).alias("same"),
                       F.col("in_memory").between(lo - slack, hi + slack).alias("within_labels"))


@query("run_records", "SELECT split, CAST(n AS DOUBLE) AS n, round(r2, 6) AS r2, round(rmse, 4) AS rmse FROM (" + _METRICS_SQL + ")", ("preds",))
def run_records(spark, sf):
    """The metrics of both splits written as runs and read back."""
    m = M.regression_metrics(M.add_split(V.preds(spark, sf), "l_orderkey", 0.2, _SEED), "y", "yhat", group_by=["split"])
    path = scratch_table_path(spark, "runs")
    for r in m.collect():                              # one row a split
        R.write_run(spark, path, "metrics", r["split"], {"seed": _SEED}, {k: r[k] for k in ("n", "r2", "rmse")}, {"split": r["split"]}, ["note"])
    back = spark.read.parquet(path).where((F.col("experiment") == "metrics") & (F.col("tags")["split"] == F.col("run_id")))
    return back.select(F.col("run_id").alias("split"), F.col("metrics")["n"].alias("n"), rnd(F.col("metrics")["r2"], 6).alias("r2"),
                       rnd(F.col("metrics")["rmse"], 4).alias("rmse"))


@query("tuning_summaries", """
SELECT experiment, round(max(score), 6) AS best_score, round(min(score), 6) AS worst_score, count(*) AS n_scores
FROM (SELECT experiment, k, avg(r2) AS score FROM runs GROUP BY 1, 2) GROUP BY 1""", ("runs",))
def tuning_summaries(spark, sf):
    """Each experiment's mean score by setting k written as a summary file, read back with best and worst."""
    scores = V.runs(spark, sf).groupBy("experiment", F.col("params")["k"].alias("k")).agg(F.avg(F.col("metrics")["r2"]).alias("score"))
    path = scratch_table_path(spark, "tuning_summary")
    # one file an experiment, as tuning jobs write them
    (scores.groupBy("experiment").agg(F.collect_list("score").alias("all_scores"))
     .repartition("experiment").write.partitionBy("experiment").json(path))
    out = R.read_tuning_summaries(spark, path)
    return out.select(F.col("experiment").cast("string").alias("experiment"), rnd("best_score", 6).alias("best_score"),
                      rnd("worst_score", 6).alias("worst_score"), F.size("all_scores").cast("bigint").alias("n_scores"))


@query("train_test_metrics")
def train_test_metrics(spark, sf):
    """M5-M8: metrics of train and test predictions and the overfitting verdict."""
    data, feats = _prepared(spark, sf)
    data = M.training_input(data)
    model = M.train_gbt(data.where(F.col("split") == "train"), feats, "l_extendedprice", _TRAIN_PARAMS)
    # two rows, read twice below: all rows are predicted once
    m = M.training_input(M.regression_metrics(M.predict(model, data), "l_extendedprice", group_by=["split"]))
    flags = M.overfit_flags_df(m)
    return rounded(m.crossJoin(flags.select("is_overfitting", "reasons")))


@query("feature_importance")
def feature_importance(spark, sf):
    data, feats = _prepared(spark, sf)
    model = M.train_gbt(M.training_input(data.where(F.col("split") == "train")), feats, "l_extendedprice",
                        _TRAIN_PARAMS)
    return rounded(M.feature_importance(model, feats, 10))


@query("cross_validate")
def cross_validate(spark, sf):
    data, feats = _prepared(spark, sf)
    folded = M.add_folds(data, "l_orderkey", 5, _SEED)
    return rounded(M.cross_validate(folded, feats, "l_extendedprice", _TRAIN_PARAMS, "fold", 5))


@query("staged_selection")
def staged_selection(spark, sf):
    data, feats = _prepared(spark, sf)
    return rounded(M.staged_selection(data.where(F.col("split") == "train"), data.where(F.col("split") == "test"),
                                      feats, "l_extendedprice", _TRAIN_PARAMS))


@query("simple_tuning")
def simple_tuning(spark, sf):
    data, feats = _prepared(spark, sf)
    return rounded(M.simple_tuning(data, feats, "l_extendedprice", _SPACE, n_trials=50, key="l_orderkey", k=3))


@query("nested_cv_tuning")
def nested_cv_tuning(spark, sf):
    """M10 + R6: nested CV; the summary is written as JSON and read back with best/worst scores."""
    data, feats = _prepared(spark, sf)
    res = M.nested_cv(data, feats, "l_extendedprice", _SPACE, key="l_orderkey", outer=5, inner=3, n_trials=50)
    path = scratch_table_path(spark, "tuning_summary")
    res.summary(spark).coalesce(1).write.mode("overwrite").json(path)
    out = R.read_tuning_summaries(spark, path)
    return rounded(out.select("best_params", "avg_score", "std_score", "best_score", "worst_score"))


# --- run records -----------------------------------------------------------------------------

@query("list_experiments", """
SELECT experiment, count(*) AS n_runs, strftime(max(start_time), '%Y-%m-%d %H:%M:%S') AS latest_start
FROM runs GROUP BY 1""", ("runs",))
def list_experiments(spark, sf):
    return rounded(R.list_experiments(V.runs(spark, sf)))


@query("latest_runs_per_experiment", """
SELECT experiment, run_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, rank FROM (
  SELECT experiment, run_id, start_time,
         row_number() OVER (PARTITION BY experiment ORDER BY start_time DESC, run_id DESC) AS rank FROM runs)
WHERE rank <= 5""", ("runs",))
def latest_runs_per_experiment(spark, sf):
    out = R.latest_runs(V.runs(spark, sf), 5)
    return rounded(out.select("experiment", "run_id", "start_time", F.col("rank").cast("bigint")))


@query("compare_runs", """
SELECT experiment, round(avg(r2), 6) AS r2, round(avg(rmse), 4) AS rmse FROM runs GROUP BY 1""", ("runs",))
def compare_runs(spark, sf):
    out = R.compare_runs(V.runs(spark, sf), ["r2", "rmse"])
    return out.select("experiment", rnd("r2", 6).alias("r2"), rnd("rmse", 4).alias("rmse"))


@query("importance_from_json", """
SELECT run_id, feature, round(importance, 4) AS importance, rank FROM (
  SELECT run_id, feature, importance,
         row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS rank
  FROM (SELECT run_id, key AS feature, CAST(json_extract_string(importance_json, '$.' || key) AS DOUBLE) AS importance
        FROM (SELECT run_id, importance_json, unnest(json_keys(importance_json)) AS key FROM runs)))
WHERE rank <= 10""", ("runs",))
def importance_from_json(spark, sf):
    r = V.runs(spark, sf)
    out = R.importance_from_json(r, F.col("importance_json"), 10)
    return rounded(out.select("run_id", "feature", "importance", F.col("rank").cast("bigint")))


@query("comment_kinds", """
SELECT experiment, CASE WHEN regexp_matches(c, '""" + "|".join(R.AUTO_COMMENT_PREFIXES) + """') THEN 'auto' ELSE 'manual' END AS kind,
       count(*) AS n_comments
FROM (SELECT experiment, c1 AS c FROM runs UNION ALL SELECT experiment, c2 FROM runs) GROUP BY 1, 2""", ("runs",))
def comment_kinds(spark, sf):
    c = R.comment_kinds(V.runs(spark, sf))
    return c.groupBy("experiment", "kind").agg(F.count(F.lit(1)).alias("n_comments"))


@query("hide_internal_tags", """
SELECT run_id, 'event_type' AS tag_key, event_type AS tag_value FROM runs
UNION ALL SELECT run_id, 'k_bucket', CAST(CAST(floor(CAST(k AS INTEGER) / 10) AS BIGINT) AS VARCHAR) FROM runs""", ("runs",))
def hide_internal_tags(spark, sf):
    v = R.visible_tags(V.runs(spark, sf))
    return v.select("run_id", F.explode("tags").alias("tag_key", "tag_value"))
