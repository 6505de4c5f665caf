"""Toxicity classifier with a counterfactual penalty: swapping identity terms should not change a score.

A text counts as its lower-case words and their beginnings. Those whose presence goes with the label beyond chance
become features, as do all identity terms. The logistic loss gets a penalty on the squared change of the score between each labelled text
and its counterfactual, in which every identity term is swapped for another of its kind, so the terms themselves
carry no blame and a neutral mention of a group isn't a sign.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, text_of

#: Most labelled rows that a fit reads, and most words it weighs; scores always cover every row.
FIT_ROWS, FIT_WORDS = 8_000, 400
#: Terms for groups of people, by kind; each is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("he", "she"), ("him", "her"),
    ("immigrant", "refugee", "foreigner", "citizen"), ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic"), ("young", "old", "elderly"), ("poor", "rich"),
    ("german", "french", "spanish", "english", "american", "mexican", "chinese", "indian", "russian", "turkish"),
)
_SWAP = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
#: Letters of the word beginnings that are features beside whole words: invective is inflected and compounded.
STEMS = range(4, 10)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def counterfactual(words: Counter) -> Counter:
    """The words of a text after every identity term is swapped."""
    swapped = Counter()
    for w, n in words.items():
        swapped[_SWAP.get(w, w)] += n
    return swapped


def features_of(word: str) -> list[str]:
    """A word and its beginnings; identity terms stand for themselves only."""
    return [word] if word in _SWAP else [f"{word[:k]}*" for k in STEMS if k <= len(word)] + [word]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float


class Scorer:
    """Scores texts in a task; remembers which features a word has."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}

    def _hits(self, word: str) -> tuple:
        if len(self.known) > 400_000:
            self.known.clear()
        hits = self.known[word] = tuple(f for f in features_of(word) if f in self.model.weights)
        return hits

    def score(self, text: str) -> float:
        known, seen = self.known, Counter()
        for word in words_of(text):
            hits = known.get(word)
            if hits is None:
                hits = self._hits(word)
            if hits:
                seen.update(hits)
        z = self.model.bias + sum(self.model.weights[f] * np.log2(1 + n) for f, n in sorted(seen.items()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def telling_features(texts: list[Counter], toxic: np.ndarray, most: int = FIT_WORDS) -> list[str]:
    """Features whose likelihood ratio against independence exceeds what the best of so many words would reach by chance.

    The strongest come first, and a feature that continues a chosen one, or is hardly more common than its chosen continuation, adds nothing new.
    """
    every, bad, words = Counter(), Counter(), set()
    for text, y in zip(texts, toxic):
        words.update(text)
        found = {f for w in text for f in features_of(w)}
        every.update(found)
        if y:
            bad.update(found)
    names = [f for f, c in every.items() if c >= 3 and f not in _SWAP]
    if not names or not 0 < toxic.sum() < len(toxic):
        return []
    n, k = np.array([every[f] for f in names], float), np.array([bad[f] for f in names], float)
    n1, n0 = float(toxic.sum()), float(len(toxic) - toxic.sum())

    def term(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0)

    total = n1 + n0
    ratio = 2 * (term(k, n * n1 / total) + term(n - k, n * n0 / total)
                 + term(n1 - k, (total - n) * n1 / total + 1e-9) + term(n0 - n + k, (total - n) * n0 / total + 1e-9))
    # only signs of toxicity: what is merely rarer in toxic texts tells the kind of text
    good = np.flatnonzero((ratio > 2 * np.log(len(words))) & (k / n > n1 / total))
    chosen, beginnings, stems = [], {}, set()
    for i in sorted(good, key=lambda i: (-ratio[i], -len(names[i]), names[i])):
        stem = names[i].rstrip("*")
        if n[i] <= 1.2 * beginnings.get(stem, 0) or any(stem[:j] in stems for j in range(1, len(stem) + 1)):
            continue
        chosen.append(names[i])
        stems.add(stem)
        beginnings.update({stem[:j]: max(n[i], beginnings.get(stem[:j], 0)) for j in range(1, len(stem) + 1)})
    return chosen[:most]


def fit(texts: list[Counter], toxic: np.ndarray, *, penalty: float = 1.0, ridge: float = 2e-5, steps: int = 1200, rate: float = 0.05) -> ToxicityModel:
    """The model of labelled texts given as word counts; without labels every score is 0.5.

    Identity terms are also drawn to 0 on their own, a thousand times as hard as other features.
    """
    if not len(texts):
        return ToxicityModel({}, 0.0)
    toxic = np.asarray(toxic, dtype=float)
    names = telling_features(texts, toxic) + sorted(_SWAP)
    place = {w: i for i, w in enumerate(names)}

    def table(rows: list[Counter]) -> np.ndarray:
        x = np.zeros((len(rows), len(names)), np.float32)
        for i, words in enumerate(rows):
            for w, n in words.items():
                for f in features_of(w):
                    if f in place:
                        x[i, place[f]] += n
        return np.log2(1 + x)

    x = table(texts)
    hold = np.array([1000 * ridge if f in _SWAP else ridge for f in names])
    other = [counterfactual(t) for t in texts]
    pairs = [i for i, (a, b) in enumerate(zip(texts, other)) if a != b]
    change = x[pairs] - table([other[i] for i in pairs])
    w, b = np.zeros(len(names)), float(np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = x.T @ (p - toxic) / len(toxic) + hold * w
        if pairs:
            g = g + penalty * (change.T @ (change @ w)) / len(pairs)
        g = np.append(g, (p - toxic).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return ToxicityModel({n: float(c) for n, c in zip(names, w) if abs(c) > 1e-4}, float(b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, *, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fits on at most ``fit_rows`` labelled rows for which ``learn`` holds, the same ones each time.

    A doc_id with both labels counts as toxic; rows of a null doc_id or label teach nothing.
    """
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = labels.select("doc_id", "toxic").filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(draw, "doc_id").limit(fit_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": [" ".join(sorted(words_of(t))) for t in pdf["text"]]})

    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    rows = found.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, words string") \
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("words").alias("words")).orderBy("doc_id").collect()
    return fit([Counter(r["words"].split()) for r in rows], np.array([r["toxic"] for r in rows], dtype=float))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity_score`` between 0 and 1; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for text in texts:
            yield pd.Series([scorer.score(t) for t in text], dtype=float)

    return docs.withColumn("toxicity_score", score(text_of()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Empty and null texts get the score of a text without telling words; equal texts score alike; rows that repeat are
    scored each; an empty table gives no rows, and without labels all scores are 0.5. Other columns are left out.
    """
    model = fit_toxicity(docs, labels, ~held_out(4, 2))
    rows = score_toxicity(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(4, 2).alias("held_out"), F.col("toxicity_score").alias("score"),
                       (F.col("toxicity_score") >= threshold).cast("int").alias("predicted"))
