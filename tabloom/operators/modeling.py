"""Splits, folds, boosted-tree training, metrics, tuning and selection.

Training uses the histogram booster of :mod:`tabloom.operators.boosting`: rows
are binned and packed once, and all models of a call (folds, candidates, outer
and inner splits) grow together over the same packed rows.  Metrics are one
aggregation each.
"""

from __future__ import annotations

import json
import math
import random
import warnings
from dataclasses import dataclass, field
from typing import Any, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import date_columns, inf_to_null, nan_to_null
from tabloom.operators import boosting as B
from tabloom.operators.dates import parse_datetime
from tabloom.operators.encode import LabelCodes, Lookup, code_table, small_category_sets
from tabloom.session import cut_lineage

# --- M1-M3: splits and folds -----------------------------------------------------

def uniform_from_key(key: str | Sequence[str], seed: int = 42, purpose: str = "split") -> Column:
    """A repeatable U[0, 1) value per row derived from its key.

    The first 13 hexadecimal digits of ``md5(key # purpose # seed)`` over 2^52:
    independent for every purpose and seed, fine enough for any key, and
    repeatable in any SQL engine.  The value depends on the row only, never on
    partitioning, so a recomputed task draws the same value.
    """
    cols = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("#", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], F.lit(purpose), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(key: str, seed: int = 42, purpose: str = "split") -> str:
    """The same draw as DuckDB SQL, for one key column."""
    return (f"(CAST('0x' || substr(md5(concat_ws('#', coalesce(CAST({key} AS VARCHAR), ''), '{purpose}', '{seed}')), 1, 13) AS BIGINT)"
            f" / {float(1 << 52)!r})")


def add_split(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42,
              name: str = "split") -> DataFrame:
    """M1: ``split`` = 'test' for a ``test_size`` share of keys, else 'train'."""
    u = uniform_from_key(key, seed, "split")
    return df.withColumn(name, F.when(u < F.lit(test_size), "test").otherwise("train"))


def time_split_cutoff(df: DataFrame, time_col: str, test_size: float = 0.2, exact: bool = True) -> float:
    """M2: epoch-second cut-off so that the last ``test_size`` share by time is test."""
    t = {f.name: f.dataType for f in df.schema.fields}[time_col]
    e = F.unix_micros(parse_datetime(time_col, t).cast("timestamp")).cast("double") / 1e6
    from tabloom.operators.order import quantiles
    return quantiles(df.select(e.alias("__e")), ["__e"], [1.0 - test_size], exact)["__e"][0]


def add_time_split(df: DataFrame, time_col: str, test_size: float = 0.2, name: str = "split",
                   exact: bool = True) -> DataFrame:
    """M2: rows after the cut-off are 'test'; equal timestamps stay together."""
    cut = time_split_cutoff(df, time_col, test_size, exact)
    t = {f.name: f.dataType for f in df.schema.fields}[time_col]
    e = F.unix_micros(parse_datetime(time_col, t).cast("timestamp")).cast("double") / 1e6
    return df.withColumn(name, F.when(e > F.lit(cut), "test").otherwise("train"))


def add_folds(df: DataFrame, key, k: int = 5, seed: int = 42, name: str = "fold", purpose: str = "fold") -> DataFrame:
    """M3: fold number 0..k-1 from the key's uniform draw for ``purpose`` (independent of the split's)."""
    return df.withColumn(name, F.least(F.floor(uniform_from_key(key, seed, purpose) * k).cast("int"), F.lit(k - 1)))


# --- M7 / M8: metrics ----------------------------------------------------------

def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction",
                       group_by: Sequence[str] = ()) -> DataFrame:
    """M7: n, r2 (1 - SSres/SStot), mae, mse, rmse in one aggregation (per group).

    Only rows that have both values (neither missing nor NaN) are scored; ``n`` counts them.
    """
    y0, p0 = nan_to_null(F.col(label).cast("double")), nan_to_null(F.col(prediction).cast("double"))
    y = F.when(p0.isNotNull(), y0)
    e = y - p0
    aggs = [F.count(e).alias("n"), F.sum(e * e).alias("__ssr"), (F.var_pop(y) * F.count(y)).alias("__sst"),
            F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse")]
    g = df.groupBy(*group_by).agg(*aggs) if group_by else df.agg(*aggs)
    return g.select(*group_by, "n", (1 - F.try_divide(F.col("__ssr"), F.col("__sst"))).alias("r2"),
                    "mae", "mse", F.sqrt("mse").alias("rmse"))


def overfit_flags(train: dict, test: dict, r2_gap: float = 0.1) -> dict[str, Any]:
    """M8: overfitting verdict from train and test metrics."""
    d_r2 = train["r2"] - test["r2"]
    d_rmse = test["rmse"] - train["rmse"]
    reasons = []
    over = False
    if d_r2 > r2_gap:
        over = True
        reasons.append("r2_gap")
    if d_rmse > 0:
        reasons.append("test_rmse_higher")
    if test["r2"] < 0.5 and train["r2"] > 0.7:
        over = True
        reasons.append("high_train_low_test")
    return {"r2_difference": d_r2, "rmse_difference": d_rmse, "is_overfitting": over, "reasons": reasons}


def overfit_flags_df(metrics: DataFrame, split_col: str = "split", r2_gap: float = 0.1) -> DataFrame:
    """M8 as a query over a metrics table with 'train' and 'test' rows."""
    m = metrics.groupBy().pivot(split_col, ["train", "test"]).agg(F.first("r2").alias("r2"), F.first("rmse").alias("rmse"))
    d_r2 = F.col("train_r2") - F.col("test_r2")
    d_rmse = F.col("test_rmse") - F.col("train_rmse")
    hl = (F.col("test_r2") < 0.5) & (F.col("train_r2") > 0.7)
    reasons = F.filter(F.array(F.when(d_r2 > r2_gap, F.lit("r2_gap")), F.when(d_rmse > 0, F.lit("test_rmse_higher")),
                               F.when(hl, F.lit("high_train_low_test"))), lambda x: x.isNotNull())
    return m.select("train_r2", "test_r2", d_r2.alias("r2_difference"), d_rmse.alias("rmse_difference"),
                    ((d_r2 > r2_gap) | hl).alias("is_overfitting"), F.array_join(reasons, ",").alias("reasons"))


# --- M4 / M5 / M6 / M13: train, predict, importance -----------------------------------

DEFAULT_PARAMS = B.DEFAULTS


def known_params(params: dict[str, Any] | None) -> dict[str, Any]:
    """The parameters that the booster knows; others are left out with a warning, so a search over them does not go unnoticed."""
    unknown = sorted(set(params or {}) - set(DEFAULT_PARAMS) - {"max_bins"})
    if unknown:
        warnings.warn(f"parameters without an equivalent are ignored: {unknown}", stacklevel=2)
    return {k: v for k, v in (params or {}).items() if k not in unknown}


def assemble(features: Sequence[str], handle_invalid: str = "keep") -> VectorAssembler:
    """M4: feature vector (NULL/NaN kept as NaN by default; 'skip' drops the row)."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid=handle_invalid)


def training_input(df: DataFrame) -> DataFrame:
    """The input of one or more fits, written once into the shared checkpoint folder."""
    return cut_lineage(df)


def train_gbt(df: DataFrame, features: Sequence[str], label: str, params: dict[str, Any] | None = None,
              seed: int = 42, key: Sequence[str] | None = None) -> B.BoostedModel:
    """M5: boosted regression trees fitted on ``df``.

    The same rows give the same model, however they are partitioned.  Missing
    features are a bin of their own below the others; rows without a label are left out.
    """
    p = known_params(params)
    return B.fit_models(df, features, label, [B.Fit(p)], key=key, seed=seed)[0].model


def predict(model: B.BoostedModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """M6: all input columns plus the prediction."""
    return model.predict(df, name)


def feature_importance(model: B.BoostedModel, features: Sequence[str], top_k: int | None = 10) -> DataFrame:
    """(rank, feature, importance) sorted by importance (share of the splits' gain)."""
    rows = sorted(zip(features, model.importance()), key=lambda t: (-t[1], t[0]))
    if top_k:
        rows = rows[:top_k]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(rows)],
                                 "rank int, feature string, importance double")


# --- M9 / M10 / M11 / M12: cross-validation and tuning ---------------------------------

def cross_validate(df: DataFrame, features: Sequence[str], label: str, params: dict[str, Any] | None = None,
                   fold_col: str = "fold", k: int | None = None, seed: int = 42,
                   key: Sequence[str] | None = None) -> DataFrame:
    """M9: per-fold test metrics of models trained on the other folds, all in one fit."""
    k = k or df.select(F.max(fold_col)).first()[0] + 1
    p = known_params(params)
    fits = [B.Fit(p, test=(0, f)) for f in range(k)]
    found = B.fit_models(df, features, label, fits, [fold_col], key, seed, keep=False)
    rows = [(f, *[x.metrics[m] for m in ("n", "r2", "mae", "mse", "rmse")]) for f, x in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "fold int, n bigint, r2 double, mae double, mse double, rmse double")


def sample_params(space: dict[str, Any], n: int, seed: int = 42, log_scale: Sequence[str] = ()) -> list[dict]:
    """``n`` draws; list -> choice, (int, int) -> integer, (float, float) -> uniform
    (log-uniform for names in ``log_scale``)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for name, spec in space.items():
            if isinstance(spec, list):
                p[name] = rng.choice(spec)
            elif isinstance(spec, tuple) and all(isinstance(v, int) for v in spec):
                p[name] = rng.randint(spec[0], spec[1])
            elif isinstance(spec, tuple):
                lo, hi = float(spec[0]), float(spec[1])
                p[name] = (math.exp(rng.uniform(math.log(lo), math.log(hi))) if name in log_scale
                           else rng.uniform(lo, hi))
            else:
                p[name] = spec
        out.append(p)
    return out


def mean_score(found: Sequence[B.Fitted], scoring: str) -> float:
    """Mean of the folds' scores; a fold without test rows, or with equal labels, has none."""
    own = [x.metrics[scoring] for x in found if x.metrics[scoring] is not None]
    return sum(own) / len(own) if own else float("nan")


def is_better(a: float, b: float | None, scoring: str) -> bool:
    """Whether score ``a`` beats ``b`` (None or missing is beaten by any)."""
    if math.isnan(a):
        return False
    return b is None or math.isnan(b) or (a > b if scoring == "r2" else a < b)


def simple_tuning(df: DataFrame, features: Sequence[str], label: str, space: dict[str, Any], n_trials: int = 10,
                  key: str = "row_key", k: int = 3, seed: int = 42, scoring: str = "rmse") -> DataFrame:
    """Every trial scored by k-fold CV (all trials and folds in one fit); trials ranked (min rmse / max r2)."""
    cands = [known_params(p) for p in sample_params(space, n_trials, seed)]
    fits = [B.Fit(c, test=(0, f)) for c in cands for f in range(k)]
    found = B.fit_models(add_folds(df, key, k, seed, "__fold"), features, label, fits, ["__fold"], seed=seed, keep=False)
    rows = [(i, json.dumps(p, sort_keys=True), mean_score(found[i * k:(i + 1) * k], scoring)) for i, p in enumerate(cands)]
    t = df.sparkSession.createDataFrame(rows, "trial int, params string, score double")
    order = F.asc("score") if scoring in ("rmse", "mse", "mae") else F.desc("score")
    from tabloom.operators.order import rank_small
    return rank_small(t, [F.isnan("score"), order, F.col("trial")], "rank")


@dataclass
class TuningResult:
    best_params: dict
    avg_score: float
    std_score: float
    all_scores: list
    all_params: list
    final_model: B.BoostedModel | None = None

    def summary(self, spark) -> DataFrame:
        """R6-shaped summary row (the tuning-summary file as a table)."""
        return spark.createDataFrame(
            [(json.dumps(self.best_params, sort_keys=True), self.avg_score, self.std_score, self.all_scores,
              [json.dumps(p, sort_keys=True) for p in self.all_params])],
            "best_params string, avg_score double, std_score double, all_scores array<double>, all_params array<string>")


def nested_cv(df: DataFrame, features: Sequence[str], label: str, space: dict[str, Any], key: str,
              outer: int = 5, inner: int = 3, n_trials: int = 10, seed: int = 42, scoring: str = "r2",
              select: str = "best_fold", refit: bool = True) -> TuningResult:
    """Nested cross-validation with a seeded random search.

    For each outer fold: candidates are scored by inner CV on the outer
    training part, the best is refitted and scored on the outer test part.
    Reports mean, sample std and all outer scores.  ``select="best_fold"``
    (reference behaviour) takes the parameters of the best-scoring outer fold;
    ``"best_mean"`` the most frequent winner.  A final model is fitted on all
    data.  All inner fits of all outer folds are one fit over the rows, which
    are binned and packed once.
    """
    data = add_folds(add_folds(df, key, outer, seed, "__outer", "outer fold"), key, inner, seed, "__inner", "inner fold")
    cands = [known_params(p) for p in sample_params(space, n_trials, seed)]
    rows = B.prepare(data, features, label, ["__outer", "__inner"], bins=max((int(c.get("max_bins", B.BINS)) for c in cands), default=B.BINS))
    inner_fits = [B.Fit(c, test=(1, i), out=(0, o)) for o in range(outer) for c in cands for i in range(inner)]
    found = rows.fit(inner_fits, seed, keep=False)
    winners = []
    for o in range(outer):
        best, best_s = cands[0], None
        for c, p in enumerate(cands):
            at = (o * len(cands) + c) * inner
            sc = mean_score(found[at:at + inner], scoring)
            if is_better(sc, best_s, scoring):
                best, best_s = p, sc
        winners.append(best)
    refits = rows.fit([B.Fit(w, test=(0, o)) for o, w in enumerate(winners)], seed, keep=False)
    scores = [float("nan") if x.metrics[scoring] is None else x.metrics[scoring] for x in refits]
    mean = sum(scores) / len(scores)
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / (len(scores) - 1)) if len(scores) > 1 else float("nan")
    if select == "best_fold":
        chosen, top = winners[0], None
        for w, s in zip(winners, scores):
            if is_better(s, top, scoring):
                chosen, top = w, s
    else:
        keyed = [json.dumps(w, sort_keys=True) for w in winners]
        chosen = json.loads(max(sorted(set(keyed)), key=keyed.count))
    final = rows.fit([B.Fit(chosen)], seed)[0].model if refit else None
    return TuningResult(chosen, mean, std, scores, winners, final)


# --- M14: staged selection -------------------------------------------------------------

def staged_selection(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                     params: dict[str, Any] | None = None, seed: int = 42) -> DataFrame:
    """Train on all features, keep the max(1, n//2) most important, retrain, compare."""
    train = training_input(train)
    m1 = train_gbt(train, features, label, params, seed)
    r1 = regression_metrics(predict(m1, test), label).first()
    keep_n = max(1, len(features) // 2)
    keep = [f for f, _ in sorted(zip(features, m1.importance()), key=lambda t: (-t[1], t[0]))[:keep_n]]
    m2 = train_gbt(train, keep, label, params, seed)
    r2 = regression_metrics(predict(m2, test), label).first()
    spark = train.sparkSession
    return spark.createDataFrame([
        ("all", len(features), ",".join(features), r1["r2"], r1["mse"]),
        ("selected", len(keep), ",".join(keep), r2["r2"], r2["mse"])],
        "stage string, n_features int, features string, r2 double, mse double")


# --- M15: feature pipeline (fit once, apply everywhere) ---------------------------------------

@dataclass
class FeaturePipeline:
    """Dates -> parts (D5), text with <= 50 values -> codes (E3), other text dropped
    (F12), +-inf -> NULL (F13).  Fitted once; ``apply`` never refits."""
    date_cols: list = field(default_factory=list)
    codes: LabelCodes | None = None
    dropped: list = field(default_factory=list)
    target: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        from tabloom.operators.dates import expand_date_features
        out = expand_date_features(df, self.date_cols) if self.date_cols else df
        if self.codes is not None:
            out = self.codes.apply(out)
        out = out.drop(*[c for c in self.dropped if c in out.columns])
        t = {f.name: f.dataType for f in out.schema.fields}
        return out.select(*[nan_to_null(inf_to_null(c)).alias(c) if isinstance(t[c], (T.FloatType, T.DoubleType))
                            else F.col(c) for c in out.columns])

    def feature_names(self, df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
        out = self.apply(df.limit(0))
        return [c for c in out.columns if c not in set(exclude) | {self.target}]


def fit_feature_pipeline(df: DataFrame, target: str | None = None, max_categories: int = 50,
                         keep: Sequence[str] = ()) -> FeaturePipeline:
    dcols = [c for c in date_columns(df) if c != target and c not in keep]
    text = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in dcols and f.name != target and f.name not in keep]
    sets = small_category_sets(df, text, max_categories)  # two jobs for all text columns
    coded = [c for c in text if sets[c] is not None]
    dropped = [c for c in text if sets[c] is None]
    codes = None
    if coded:
        codes = LabelCodes(missing="null")
        for c in coded:
            codes.lookups[c] = Lookup(c, code_table(df, sets[c]))
            codes.sizes[c] = len(sets[c])
    return FeaturePipeline(dcols, codes, dropped, target)


# --- M16: persistence -------------------------------------------------------------------------

def save_model(model: B.BoostedModel, path: str, metadata: dict[str, Any]) -> None:
    """The model as a one-row table, plus a one-row metadata table next to it."""
    B.save(model, f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "metadata string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> tuple[B.BoostedModel, dict[str, Any]]:
    spark = SparkSession.getActiveSession()
    meta = spark.read.json(f"{path}/metadata").first()["metadata"]
    return B.load(spark, f"{path}/model"), json.loads(meta)
