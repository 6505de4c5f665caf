"""Named queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy access to the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        # NTZ timestamps become instants in the session zone; results are defined in UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def timed(self) -> DataFrame:
        """``events`` with ``us``, its microseconds since 1970."""
        return self.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None
    family: str = ""

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def _plain_counts(sql: str) -> str:
    """``count_if(x)`` as ``count(*) FILTER (WHERE x)``, whose type is BIGINT."""
    while (start := sql.find("count_if(")) >= 0:
        depth, end = 1, start + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:start] + "count(*) FILTER (WHERE " + sql[start + len("count_if("):end] + sql[end:]
    return sql


def query(name: str, covers: str, sql: str | None = None, *, nullable: str = ""):
    """Register a plan under ``name``; ``covers`` lists the inventory ids it exercises.

    ``nullable`` names integer columns that hold nulls; both sides return them
    as doubles, so that no reader turns one side into floats on its own.
    """
    loose = nullable.split()

    def wrap(build: Callable[[Tables], DataFrame]):
        nonlocal sql
        family = build.__module__.rsplit(".", 1)[-1]
        if loose:
            inner = build
            build = lambda t: inner(t).withColumns({c: F.col(c).cast("double") for c in loose})
            if sql:
                swaps = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in loose)
                sql = f"SELECT * REPLACE ({swaps}) FROM (\n{sql.strip()}\n)"
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, _plain_counts(sql.strip()) if sql else None, family)
        return build

    return wrap
