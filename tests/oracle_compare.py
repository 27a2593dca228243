"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math

import pandas as pd


def _norm(v, nd=6):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, nd) + 0.0
        return str(int(r)) if r == int(r) and abs(r) < 1e15 else r
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False)), key=repr)


def duck_con(sf_dir):
    import duckdb
    from tabloom.plans.views import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_pdf, duck_pdf):
    c1, r1 = rows_of(spark_pdf)
    c2, r2 = rows_of(duck_pdf)
    assert c1 == c2, f"columns differ: {c1} vs {c2}"
    assert len(r1) == len(r2), f"row counts differ: {len(r1)} vs {len(r2)}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    assert not bad, f"values differ, e.g. {bad[:3]}"
