"""Flattening and comparing configurations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


def flatten(value, prefix: str = "") -> dict[str, str]:
    """Dotted keys of nested maps; lists stay whole and empty maps vanish."""
    out: dict[str, str] = {}
    for k, v in value.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        elif v is not None:
            out[f"{prefix}{k}"] = json.dumps(v, sort_keys=True)
    return out


@F.pandas_udf(MapType(StringType(), StringType()))
def flat_config(text: pd.Series) -> pd.Series:
    return text.map(lambda t: flatten(json.loads(t)) if t else {})


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def differing(a: Column, b: Column) -> Column:
    """Keys whose values differ, sorted; a missing key equals null."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, v: ~v["x"].eqNullSafe(v["y"]))))


def change_kind(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNotNull(), "added").when(b.isNull() & a.isNotNull(), "removed").when(a != b, "changed")
