"""Spectral indices as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..registry import INDICES, QueryError
from .numeric import finite


def index_value(name: str) -> Column:
    """The index over columns named like its bands; undefined results are NULL."""
    if name not in INDICES:
        raise QueryError(f"Unknown index {name!r}")
    return finite(F.expr(INDICES[name]["sql"]).cast("double"))


def with_indices(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: index_value(n) for n in names})
