"""Similarity of names by matching blocks, the one scalar that has no built-in form."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all characters; not symmetric."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of normalised names; gold first."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
