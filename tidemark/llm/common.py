"""Helpers of the text operators: the shared folder, stored intermediate tables and stable row ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it.
SPACES = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session, which has no other machine, may run without one; it gets a temporary folder for
    the life of the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and no step runs twice.

    ``codec`` compresses the files otherwise than the session does, for tables that are large. A lost executor costs the running tasks only. The files stay until the folder is emptied.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_REMEMBERED: dict[str, Any] = {}


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """In a Python worker: what ``make`` returned for ``name``, kept from task to task.

    A worker serves many operators; it remembers for one at a time, and taking another name forgets what was held.
    """
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def as_scan(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain scan of files, else ``docs`` stored and scanned."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return stored(docs, "rows")
    return docs


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_file`` and ``_at``, which name each stored row the same way in every read of one scan."""
    return as_scan(docs).withColumns({"_file": F.xxhash64("_metadata.file_path"), "_at": F.col("_metadata.row_index")})


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of ``doc_id`` as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
