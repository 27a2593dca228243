"""Property tests of the block-scheme operators against pandas / numpy."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabloom.operators import order as O

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.one_of(st.none(), st.floats(-100, 100, allow_nan=False).map(lambda v: round(v, 2))),
                  min_size=1, max_size=60)


@SETTINGS
@given(vals=values, nblocks=st.integers(1, 9))
def test_ffill_bfill_match_pandas(spark, vals, nblocks):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    s = pd.Series(vals, dtype="float64")
    ff = [r[0] for r in O.forward_fill(df, ["v"], ["i"], nblocks=nblocks).orderBy("i").select("v").collect()]
    bf = [r[0] for r in O.backward_fill(df, ["v"], ["i"], nblocks=nblocks).orderBy("i").select("v").collect()]
    assert ff == [None if pd.isna(x) else x for x in s.ffill()]
    assert bf == [None if pd.isna(x) else x for x in s.bfill()]


@SETTINGS
@given(keys=st.lists(st.integers(0, 20), min_size=1, max_size=80), nblocks=st.integers(1, 7))
def test_row_index_is_a_dense_sorted_numbering(spark, keys, nblocks):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, id long")
    got = O.global_row_index(df, ["k", "id"], nblocks=nblocks).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(len(keys)))
    assert [(r["k"], r["id"]) for r in got] == sorted((k, i) for i, k in enumerate(keys))


@SETTINGS
@given(vals=st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=80),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=5), nblocks=st.integers(1, 6))
def test_exact_quantiles_match_numpy(spark, vals, probs, nblocks):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = O.exact_quantiles(df, "x", probs, nblocks=nblocks)
    assert np.allclose(got, np.percentile(np.array(vals), [p * 100 for p in probs]), rtol=1e-9, atol=1e-9)


@SETTINGS
@given(groups=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 50)), min_size=1, max_size=60),
       k=st.integers(1, 4))
def test_top_k_per_group_matches_sort(spark, groups, k):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(groups)], "g string, v long, id long")
    from pyspark.sql import functions as F
    got = sorted((r["g"], r["id"]) for r in O.top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], k,
                                                             salt_buckets=4).collect())
    pdf = pd.DataFrame([(g, v, i) for i, (g, v) in enumerate(groups)], columns=["g", "v", "id"])
    want = sorted((g, i) for g, sub in pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g")
                  for i in sub["id"].head(k))
    assert got == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["2024-01-01", "2024-01-02", "bad", None]),
                               st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=40))
def test_group_sum_attach_matches_pandas(spark, rows):
    from tabloom.operators import merge as J
    df = spark.createDataFrame([(i, d, None if v is None else float(v)) for i, (d, v) in enumerate(rows)],
                               "i long, d string, v double")
    got = {r["i"]: r["v_daily_sum"] for r in J.group_sum_attach(df, "d", ["v"], fmt="%Y-%m-%d").collect()}
    pdf = pd.DataFrame(rows, columns=["d", "v"])
    pdf["ts"] = pd.to_datetime(pdf["d"], format="%Y-%m-%d", errors="coerce")
    sums = pdf.groupby("ts")["v"].sum()
    for i, ts in enumerate(pdf["ts"]):
        want = None if pd.isna(ts) else float(sums[ts])
        assert got[i] == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=50))
def test_drop_duplicates_keep_first_matches_pandas(spark, rows):
    from tabloom.operators import clean as C
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = sorted(tuple(r) for r in C.drop_duplicates(df, ["k"], order_by=["o", "v"]).collect())
    pdf = pd.DataFrame(rows, columns=["k", "o", "v"]).sort_values(["o", "v"]).drop_duplicates(["k"], keep="first")
    assert got == sorted(map(tuple, pdf.itertuples(index=False)))


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 9))), min_size=1,
                     max_size=50), nblocks=st.integers(1, 7))
def test_partitioned_ffill_matches_pandas(spark, rows, nblocks):
    df = spark.createDataFrame([(g, i, None if v is None else float(v)) for i, (g, v) in enumerate(rows)],
                               "g string, i long, v double")
    got = {r["i"]: r["v"] for r in O.forward_fill(df, ["v"], ["i"], ["g"], nblocks=nblocks).collect()}
    pdf = pd.DataFrame([(g, i, v) for i, (g, v) in enumerate(rows)], columns=["g", "i", "v"], dtype=object)
    pdf["v"] = pdf["v"].astype("float64")
    pdf["f"] = pdf.groupby("g")["v"].ffill()
    for i, f in zip(pdf["i"], pdf["f"]):
        assert got[i] == (None if pd.isna(f) else f)
