"""Quality classifier from positive and unlabelled texts: non-negative unbiased risk, with an estimated class prior.

Texts become a short vector of shape measures (case, runs of symbols, repetition, words, lines) that owes nothing to a
vocabulary, so it holds for words never seen; digits and single symbols, which clean texts have too, are no measure. A
logistic model on these measures and their squares minimises ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``:
positives are the trusted labels, all other text is unlabelled, and where the bracket turns negative the step pushes it
back up. The prior comes from the same two samples: the share of unlabelled texts above a threshold, divided by that of
positives, is least where only positives are left.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, remembered, text_of

#: Most positives and most unlabelled texts that a fit reads; scores always cover every row.
FIT_ROWS = 12_000
MEASURES = 16
_RUN = re.compile(r"([^\w\s])\1+(?=\s|$)")
_BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_STOP = re.compile(r"[.?!](?=\s|$)")


def measures(text: str) -> list[float]:
    """Shape of a whole text; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES
    chars = sum(map(len, words))
    upper = sum(map(str.isupper, words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    distinct = len(set(words))
    again = sum(map(eq, words, words[1:]))
    twice = sum(map(eq, words, words[2:]))
    share = lambda k, of=n: k / max(of, 1)
    runs = len(_RUN.findall(text))
    bare = len(_BARE.findall(text))
    stops = len(_STOP.findall(text))
    return [
        share(upper), share(runs), share(bare), share(again), share(twice),
        distinct / n ** 0.8, share(distinct), share(chars), share(stops), share(text.count(","), n),
        1 - share(len(set(lines)), len(lines)), share(sum(map(str.istitle, words))), np.log1p(n), np.log1p(n / max(len(lines), 1)),
        share(text.count("!"), chars), float(n < 5),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Everything a task needs to score: scales, weights and the prior they were fitted with."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = expand((rows - self.centre) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -5, 5)
    return np.hstack([x, x * x / 5])


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, ridge: float = 1e-4):
    """Adam on the non-negative risk with the logistic loss."""
    size = positive.shape[1]
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    one = lambda a: np.hstack([a, np.ones((len(a), 1))])
    p, u = one(positive), one(unlabelled)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        g_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = prior * (p.T @ (sp - 1)) / len(p) + g_negative if negative >= 0 else -g_negative
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], w[-1]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from scores of both samples: the least upper bound over thresholds, with its sampling error added."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.7, 60))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    p, u = above(positive), above(unlabelled)
    error = np.sqrt(u * (1 - u) / len(unlabelled)) + np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(np.min((u + error) / p), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """The model of two samples of measures; without positives every score is the prior 0.5."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(MEASURES), np.ones(MEASURES), np.zeros(2 * MEASURES), 0.0, 0.5)
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = expand((positive - centre) / scale), expand((unlabelled - centre) / scale)
    w, b = _descend(p, u, 0.5, steps=600)
    prior = estimate_prior(p @ w + b, u @ w + b)
    w, b = _descend(p, u, prior)
    return QualityModel(centre, scale, w, float(b), prior)


def _rows(texts: list) -> np.ndarray:
    return np.array([measures(t or "") for t in texts], dtype=float).reshape(len(texts), MEASURES)


def _measured(docs: DataFrame, kept: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[kept].copy()
            out["x"] = list(_rows(pdf["text"].tolist()))
            yield out

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, text_of().alias("text")).mapInPandas(run, f"{kinds}, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fits on at most ``fit_rows`` trusted positives and ``fit_rows`` unlabelled texts.

    Positives are rows with quality 1 for which ``learn`` holds; unlabelled rows are texts of any document. Both
    samples go by hash of doc_id, so reruns read the same rows. Rows of a null doc_id teach nothing.
    """
    draw = F.xxhash64("doc_id", F.lit("quality"))
    named = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    trusted = labels.select("doc_id", "quality").filter((F.col("quality") == 1) & learn).select("doc_id").distinct()
    trusted = trusted.orderBy(draw, "doc_id").limit(fit_rows)
    web = named.select("doc_id").orderBy(draw, "doc_id").limit(fit_rows)
    chosen = trusted.withColumn("kind", F.lit(1)).unionByName(web.withColumn("kind", F.lit(0)))
    rows = _measured(named.join(F.broadcast(chosen), "doc_id"), ["doc_id", "kind"])
    rows = rows.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).collect()
    sample = lambda kind: np.array([r["x"] for r in rows if r["kind"] == kind], dtype=float).reshape(-1, MEASURES)
    return fit(sample(1), sample(0))


def score_quality(docs: DataFrame, model: QualityModel, column: str = "quality_score") -> DataFrame:
    """``docs`` with ``column`` between 0 and 1; every other column of ``docs`` stays, null text counts as empty."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), f"quality {uuid.uuid4().hex}"

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = remembered(name, lambda: shared.value)
        for text in texts:
            yield pd.Series(own.scores(_rows(text.tolist())))

    return docs.withColumn(column, score(text_of()))


def learnable() -> Column:
    """Rows whose labels may be learned from."""
    return ~held_out(3, 1)


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Empty and null texts are scored as texts without words; equal texts score alike; rows that repeat are scored each;
    an empty table gives no rows, and without labels all scores are 0.5. Other columns are left out.
    """
    model = fit_quality(docs, labels, learnable())
    rows = score_quality(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), F.col("quality_score").alias("score"),
                       (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns, whatever these are called.

    Null and empty texts are judged as texts without words; of rows that repeat all go or stay.
    """
    model, column = fit_quality(docs, labels, learnable()), f"quality_{uuid.uuid4().hex}"
    return score_quality(docs, model, column).filter(F.col(column) >= threshold).drop(column)
