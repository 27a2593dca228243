"""Saving and loading fitted objects (imputer, scaler, encoders, feature pipeline).

A fitted object holds plain values (statistics, category lists), written as one
small JSON document next to the model, and fitted tables (codes, frequencies,
means), written as parquet beside that document.  Nothing refers to the
checkpoint folder, so the saved object outlives it.  The scoring job reads it
back: the prediction batch is transformed with the training statistics, never
refitted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, fields, is_dataclass
from typing import Any

from pyspark.sql import SparkSession

from tabloom.operators.encode import LabelCodes, Lookup, MapEncoder, OneHot
from tabloom.operators.impute import Imputer
from tabloom.operators.modeling import FeaturePipeline
from tabloom.operators.scale import Scaler

_KINDS = {"Imputer": Imputer, "Scaler": Scaler, "OneHot": OneHot, "LabelCodes": LabelCodes,
          "MapEncoder": MapEncoder, "FeaturePipeline": FeaturePipeline}


def _lookup_to_json(lk: Lookup, tables: str) -> dict:
    name = uuid.uuid4().hex
    lk.table.write.parquet(f"{tables}/{name}")
    return {"column": lk.column, "table": name, "default": lk.default}


def _lookup_from_json(spark: SparkSession, d: dict, tables: str) -> Lookup:
    return Lookup(d["column"], spark.read.parquet(f"{tables}/{d['table']}"), d["default"])


def to_json(obj: Any, tables: str) -> str:
    """Serialise a fitted object to JSON text; its fitted tables go to the folder ``tables``."""
    kind = type(obj).__name__
    if kind not in _KINDS:
        raise TypeError(f"not a fitted object: {kind}")
    body: dict[str, Any] = {}
    for f in fields(obj):
        v = getattr(obj, f.name)
        if isinstance(v, set):
            v = sorted(v)
        elif f.name == "lookups":
            v = {c: _lookup_to_json(lk, tables) for c, lk in v.items()}
        elif isinstance(v, LabelCodes):
            v = json.loads(to_json(v, tables))
        elif is_dataclass(v):
            v = asdict(v)
        body[f.name] = v
    return json.dumps({"kind": kind, "body": body}, default=str, sort_keys=True)


def from_json(spark: SparkSession, text: str, tables: str) -> Any:
    """Rebuild a fitted object written by :func:`to_json`."""
    doc = json.loads(text)
    cls = _KINDS[doc["kind"]]
    body = dict(doc["body"])
    if cls is Imputer:
        body["as_double"] = set(body.get("as_double", []))
    if cls is Scaler:
        body["plan"] = {c: (m, p) for c, (m, p) in body["plan"].items()}
    if "lookups" in body:
        body["lookups"] = {c: _lookup_from_json(spark, d, tables) for c, d in body["lookups"].items()}
    if cls is FeaturePipeline and body.get("codes"):
        body["codes"] = from_json(spark, json.dumps(body["codes"]), tables)
    return cls(**body)


def save_params(obj: Any, path: str) -> None:
    """Write a fitted object at ``path``: a one-row JSON table, and its fitted tables under ``tables``."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(to_json(obj, f"{path}/tables"),)], "params string").coalesce(1).write.mode("overwrite").json(f"{path}/json")


def load_params(spark: SparkSession, path: str) -> Any:
    return from_json(spark, spark.read.json(f"{path}/json").first()["params"], f"{path}/tables")
