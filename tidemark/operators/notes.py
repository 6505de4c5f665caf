"""Tagged notes: clean-up, paging, keyword and vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_-]", "_")


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def page(df: DataFrame, order: Sequence[Column], *, offset: int, limit: int) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def _holds(word: str):
    return lambda tag: F.contains(F.lower(tag), F.lit(word))


def search(df: DataFrame, words: Sequence[str], text: str, tags: str) -> DataFrame:
    """Notes whose text or any tag contains any of the words, letter case ignored."""
    hit = F.lit(False)
    for w in words:
        low = w.lower()
        tagged = F.size(F.filter(tags, _holds(low))) > 0
        hit = hit | F.contains(F.lower(text), F.lit(low)) | tagged
    return df.filter(hit)


def with_tag_like(df: DataFrame, tags: str, fragment: str) -> DataFrame:
    return df.filter(F.exists(tags, lambda tag: F.contains(tag, F.lit(fragment))))


def terms(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """Word counts per note over the whole text."""
    words = F.explode(F.split(F.lower(text), "[^\\p{L}\\p{N}]+")).alias("term")
    return df.select(*ids, words).filter("term <> ''").groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def keyword_search(index: DataFrame, ids: Sequence[str], words: Sequence[str], k: int) -> DataFrame:
    """The ``k`` notes with the most query words, then the most occurrences."""
    hits = index.filter(F.col("term").isin([w.lower() for w in words])).groupBy(*ids).agg(F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("occurrences"))
    return hits.orderBy(F.desc("matched"), F.desc("occurrences"), *ids).limit(k)


def retrieve_notes(df: DataFrame, text: str, words: Sequence[str], tags: str, tag: str, order: Sequence[str]) -> DataFrame:
    """Notes with a tag and any of the words, sorted (by day, say)."""
    found = F.arrays_overlap(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), F.array(*[F.lit(w.lower()) for w in words]))
    return df.filter(F.array_contains(tags, tag) & found).orderBy(*order)


def nearest_vectors(df: DataFrame, ident: str, vector: str, queries: dict[str, Sequence[float]], k: int) -> DataFrame:
    """The ``k`` vectors of largest dot product per query vector.

    Each batch is one matrix product and hands on only its own best ``k`` per
    query, which contain the overall best.  ``queries`` is a handful of vectors.
    """
    names = list(queries)
    matrix = np.array([queries[n] for n in names], dtype=float).T

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            scores = np.stack(b[vector].to_numpy()).astype(float) @ matrix
            ids = b[ident].to_numpy()
            out = []
            for j, name in enumerate(names):
                s = np.round(scores[:, j], 9)
                top = np.lexsort((ids, -s))[:k]
                out.append(pd.DataFrame({"query": name, ident: ids[top], "score": s[top]}))
            yield pd.concat(out)

    kind = df.schema[ident].dataType.simpleString()
    partial = df.select(ident, vector).mapInPandas(best, f"query string, `{ident}` {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), ident))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k)
