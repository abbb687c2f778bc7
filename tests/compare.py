"""Rows of two frames in an order-free, type-light form."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd


def _cell(x: object) -> object:
    if isinstance(x, list | tuple) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return tuple(_cell(v) for v in x)
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return bool(x)
    if isinstance(x, int | float) or type(x).__name__ in ("Decimal", "int64", "int32", "float64", "float32"):
        return round(float(x), 6)
    return str(x).removesuffix(" 00:00:00")


def rows(df: pd.DataFrame) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(_cell(v) for v in r) for r in df[columns].itertuples(index=False, name=None))
