"""Small driver-made tables (parameters, vocabularies) as local relations."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table from a handful of tuples; built through Arrow, so no Python worker reads it."""
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrow = pa.table({name: pa.array(list(col), type=_TYPES[kind]) for (name, kind), col in zip(fields, columns)})
    return spark.createDataFrame(arrow)
