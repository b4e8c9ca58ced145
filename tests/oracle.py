"""Rows of a Spark and of a DuckDB result in one comparable form."""

import math

import pandas as pd

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v if isinstance(v, bool) else float(v) if isinstance(v, (int, float)) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))
