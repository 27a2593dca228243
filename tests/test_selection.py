"""Bracketed selection: exact ranks of many columns without moving their values."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL

from tabloom.operators import order as O
from tabloom.operators import selection as S


def test_keys_keep_the_order_of_doubles():
    v = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1, 2), 1e308, np.inf])
    k = S.ordered(v)
    assert (np.diff(k) >= 0).all() and k[4] == k[5] and len(set(k.tolist())) == len(v) - 1
    assert [S.restored(int(x)) for x in k] == v.tolist()


@pytest.mark.parametrize("parts,keep", [(16, 1), (7, 10), (1000, 2000)])
def test_equal_to_numpy(spark, monkeypatch, parts, keep):
    monkeypatch.setattr(S, "KEEP", keep)
    rng = np.random.default_rng(parts)
    n = 3000
    cols = {"equal": np.full(n, 7.25), "two": rng.choice([-1.0, 3.0], n), "normal": rng.normal(0, 1, n), "wide": np.exp(rng.normal(0, 60, n)),
            "int": rng.integers(-5, 6, n).astype(float), "near": 1.0 + rng.integers(0, 40, n) * 2.0 ** -52, "one": np.full(n, np.nan)}
    cols["one"][17] = 4.0
    cols["nan"] = np.where(rng.random(n) < 0.3, np.nan, cols["normal"])
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in cols.values()])), ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = O.quantiles(df, list(cols), probs, nblocks=parts)
    for c, v in cols.items():
        want = np.quantile(v[~np.isnan(v)], probs)
        np.testing.assert_allclose(got[c], want, rtol=1e-12, err_msg=c)


def test_no_values_and_other_types(spark):
    df = spark.createDataFrame([(None, float("nan"), 1, None)], "a double, b double, c int, d int")
    assert O.quantiles(df, ["a", "b", "c", "d"], [0.5]) == {"a": [None], "b": [None], "c": [1.0], "d": [None]}
    assert O.quantiles(df.limit(0), ["c"], [0.5]) == {"c": [None]}
    dec = spark.range(101).select((F.col("id") / 10).cast("decimal(10,1)").alias("x"), F.lit(float("-inf")).alias("y"))
    assert O.quantiles(dec, ["x", "y"], [0.5]) == {"x": [5.0], "y": [float("-inf")]}


def test_only_counts_are_shuffled(spark, monkeypatch):
    """One exchange a scan, of part counts, whatever the number of columns."""
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    cols = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_partkey"]
    plans, made = [], S.count_parts

    def seen(*args):
        out = made(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(S, "count_parts", seen)
    O.quantiles(li, cols, [0.25, 0.5, 0.75])
    assert 2 <= len(plans) <= 4
    for p in plans:
        assert p.count("Exchange hashpartitioning(c#") == p.count("Exchange") == 1 and "Expand" not in p and "Sort " not in p


def test_hot_value_and_rows_that_change(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.5).alias("x")).repartition(7)
    want = np.quantile([5.0 if i % 3 == 0 else i * 1.5 for i in range(20_000)], [0.1, 0.3, 0.5])
    np.testing.assert_allclose(O.exact_quantiles(df, "x", [0.1, 0.3, 0.5]), want)
    calls = []

    def ranks(c, n):
        calls.append(n)
        return [n + 5]
    with pytest.raises(ValueError):
        S.select_ranks(df, ["x"], ranks)
    assert calls == [20_000]
