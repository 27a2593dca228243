"""Fitted transforms applied to a Structured Streaming source."""

from pyspark.sql import functions as F

from conftest import SMALL
from tabloom.operators import impute as I
from tabloom.operators import scale as H
from tabloom.streaming.apply import apply_fitted, read_parquet_stream, write_table_stream


def test_fitted_chain_on_stream_matches_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    imp = I.fit_imputer(ev, {"value": "median"})
    sc = H.fit_scaler(imp.apply(ev), {"value": "standard"})
    src = str(tmp_path / "in")
    ev.write.parquet(src)
    stream = read_parquet_stream(spark, src, ev.schema)
    out = apply_fitted(stream, [imp.apply, sc.apply])
    q = write_table_stream(out, str(tmp_path / "out"), "scored_test", checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()
    want = sc.apply(imp.apply(ev)).orderBy("event_id").collect()
    assert len(got) == len(want) == ev.count()
    assert all(abs(a["value"] - b["value"]) < 1e-12 for a, b in zip(got, want))
