"""Missing values: NaN counts as missing wherever a rule does not say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(value: Column) -> Column:
    """A floating value with NaN as null."""
    return F.nanvl(value, F.lit(None))


def known_of(df: DataFrame, name: str) -> Column:
    """A column of ``df`` with NaN as null; columns that cannot hold NaN stay as they are."""
    column = F.col(f"`{name}`")
    return known(column) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else column


def with_known(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with NaN as null in the columns (all floating ones)."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (columns is None or f.name in columns)]
    return df.withColumns({c: known(F.col(f"`{c}`")) for c in names}) if names else df
