"""Token counts, importance resampling and whitening beside plain versions: nulls, long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling, tokencounts, whitening

DOC = "doc_id long, text string, lang string, source string, n_chars long, steps binary, rank long, line string, h long, one int"


def documents(spark, rows):
    """(doc_id, text) rows, with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "web", 1, b"x", 5, "line", 6, 7) for i, t in rows], DOC)


# ---- token counts

@pytest.fixture(scope="module")
def model():
    pytest.importorskip("sentencepiece")
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def _encoder(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_every_prefix_has_the_encoders_count(model):
    encoder, counter = _encoder(model), tokencounts.PrefixCounter(tokencounts.Pieces(model))
    rng = random.Random(5)
    bits = ["a", "e", "t", "ing", " the", " ", "  ", "\n", "\t", "é", "▁", "<s>", "<0x0A>", "0", "17", "\U0001f600", "的", "Ж", ".", "==", "----", "\x00", "ﬁ", "́"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(400)] + [" " * 70, "a" * 70, "=" * 90, "▁ ▁", "\U0001f600" * 9]
    for text in texts:
        want = [len(encoder.encode(text[:i])) for i in range(len(text) + 1)]
        assert tokencounts.counts_at_prefixes(*counter.steps(text)).tolist() == want, text


def test_bounded_stores_change_nothing(model, monkeypatch):
    for name in ("PARTS", "PAIRS", "HEADS"):
        monkeypatch.setattr(tokencounts, name, 3)
    encoder, counter = _encoder(model), tokencounts.PrefixCounter(tokencounts.Pieces(model))
    rng = random.Random(6)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdeéß.,-") for _ in range(rng.randrange(1, 14))) for _ in range(12))
        assert tokencounts.counts_at_prefixes(*counter.steps(text))[-1] == len(encoder.encode(text))
        assert len(counter.steps_of) <= 3 and len(counter.older) <= 3


def test_steps_that_fit_no_byte_are_kept_apart():
    class Far(tokencounts.PrefixCounter):
        def table(self, part):
            return [], [0] + [1 if i % 2 == 0 else 301 for i in range(len(part))]

    class Letters:
        joins, parts = {"aa", " a"}, re.compile(" +a*")

    steps, wide = Far(Letters()).steps("aaaa")
    assert len(steps) == 4 and wide and tokencounts.counts_at_prefixes(steps, wide).tolist() == [0, 301, 1, 301, 1]


def test_counts_and_budgets_of_rows(spark, model):
    encoder = _encoder(model)
    long = " ".join(f"word{i} wörd" for i in range(9000))
    rows = [(1, "plain text"), (2, None), (3, ""), (4, long), (4, long), (None, "no id <s> here"), (7, "x" * 30_000), (8, "\n" * 500)]
    table = tokencounts.prefix_counts(documents(spark, rows), model)
    got = tokencounts.budgeted(table, 100).withColumn("first5", tokencounts.tokens_before("steps", "wide", F.lit(5))).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text in rows:
        text, r = text or "", by_id[doc_id]
        n = len(encoder.encode(text))
        assert (r["n_bytes"], r["n_chars"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(text), n, n > 100)
        assert r["first5"] == len(encoder.encode(text[:5]))
        fits = r["fits_chars"]
        assert len(encoder.encode(text[:fits])) <= 100 and (n > 100 or fits == len(text))
        assert all(len(encoder.encode(text[:i])) > 100 for i in range(fits + 1, min(len(text), fits + 40) + 1))
    assert tokencounts.budgeted(tokencounts.prefix_counts(documents(spark, []), model), 9).count() == 0


# ---- importance resampling

def _words(text):
    return re.findall(resampling.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _plain_sample(rows, target, longest, buckets, fewest, percent, seed):
    def runs(text):
        w = _words(text)
        return [zlib.crc32(" ".join(w[i: i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in rows for b in runs(x)), Counter(b for x in target for b in runs(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, x in rows:
        f = runs(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(_words(x))])
    able = sorted((r for r in out if r[5] >= fewest), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def _corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in ("Wort", "été", "x", "Ünder") for i in range(15)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 9))) for _ in range(40)] + ["", "same line"] * 20
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 12)))) for i in range(n)], [rng.choice(lines) for _ in range(30)]


@pytest.mark.parametrize("longest", [1, 3])
def test_sample_equals_the_plain_rule(spark, longest):
    rows, target = _corpus(longest, 150)
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "lone"), (None, "no id " * 12), (504, "very long " * 20_000), (505, "a-b_c\x00d\r\ne9"), (20, rows[20][1])]
    want = _plain_sample(rows, target, longest, 500, 5, 30, "7")
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target + [None])], "item_id long, text string")
    got = resampling.importance_sample(documents(spark, rows), wanted, longest=longest, buckets=500, fewest_words=5, percent=30, seed="7")
    found = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str)
    # which of the two repeated rows ranks first is open
    assert Counter(f[:4] for f in found) == Counter(w[:4] for w in want)
    assert {(f[0], f[4]) for f in found} == {(w[0], w[4]) for w in want}


def test_lines_that_fill_tables_reach_documents_by_broadcast_or_join_alike(spark, monkeypatch):
    rows, target = _corpus(9, 60)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    results = []
    for hot in (1, 1 << 40):
        monkeypatch.setattr(resampling, "HOT_LINES", hot)
        results.append(sorted(map(tuple, resampling.importance_sample(documents(spark, rows), wanted).collect()), key=str))
    assert results[0] == results[1]


def test_sample_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.importance_sample(documents(spark, []), none).count() == 0
    rows = [(i, "one two three " * 10) for i in range(30)]
    got = resampling.importance_sample(documents(spark, rows), none)
    assert got.filter("drawn").count() == 3 and got.select("weight").distinct().count() == 1


# ---- whitening

def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2.0, "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, whitened double, x string")


def _numbers(rows):
    width = max(len(v) for _, v in rows)
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v))) for i, v in rows]


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6))
    rows = [(i, list(rng.normal(size=6) @ mix)) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(100)] + [(7, rows[3][1]), (None, rows[5][1]), (500, rows[9][1][:4])]
    spoilt = [(900, None), (901, [None] * 6), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5), (904, [1e30] + [0.0] * 5)]
    whole = _numbers(rows)
    fit = np.array(sorted({tuple(x) for _, x in whole}), float)
    n, sums = len(fit), [sum(int(v) for v in col) for col in fit.T]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitening.whitened(_vectors(spark, rows + spoilt)).collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by_key = {}
    for r in got:
        by_key.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k in range(4):
        direction = vectors[:, k] / math.sqrt(values[k])
        pairs = [(by_key[i, k + 1][0], (np.array(x) - np.array(sums) / n) @ direction) for i, x in whole if i != 7]
        sign = np.sign(sum(r["whitened"] * w for r, w in pairs))
        assert max(abs(r["whitened"] * sign - w) for r, w in pairs) < 1e-9
        assert all(abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-12 for r, _ in pairs)
    for i, x in whole:
        if i != 7:
            assert by_key[i, 1][0]["deviation"] == sum((n * v - s) ** 2 for v, s in zip(x, sums))
    assert len(by_key[7, 1]) == 2


def test_components_of_awkward_matrices():
    rng = np.random.default_rng(8)
    turn, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    spectra = [[3.0] * 5 + [1.0] * 25, [1 + 1e-12 * i for i in range(30)], [1e6, 1e-6] + [0.0] * 28, [4, 4, 3.999999999] + [1.0] * 27, list(range(30))]
    matrices = [(turn * np.array(s)) @ turn.T for s in spectra] + [np.eye(9), np.diag([5.0, 5, 5, 1, 0]), np.kron(np.eye(2), np.ones((4, 4))), np.array([[2.0]]), np.array([[0.0, 1], [1, 0]])]
    for a in matrices:
        a = (a + a.T) / 2
        k = min(4, len(a))
        values, vectors = whitening.leading_components(a, k)
        size = np.abs(a).max()
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * size * len(a)
        assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-13 * size * len(a)
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-14
    d, e, _ = whitening.tridiagonal((turn * np.arange(30)) @ turn.T)
    assert whitening.sturm_count(d, e, np.array([-0.5, 0.5, 14.5, 29.5])).tolist() == [0, 1, 15, 30]


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whitened(_vectors(spark, [])).count() == 0
    assert whitening.whitened(_vectors(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.whitened(_vectors(spark, [(1, [])])).count() == 0
    assert whitening.whitened(_vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    flat = whitening.whitened(_vectors(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(6)])).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_deviations_beyond_64_bits_are_null():
    x = np.array([[1 << 40, 0], [3, 4]], np.int64)
    assert whitening._deviations(x, 2, [10, 20]) == [None, (6 - 10) ** 2 + (8 - 20) ** 2]
    assert whitening._deviations(x[1:], 2, [10, 20]) == [160]


def test_sums_of_large_numbers_stay_exact(spark):
    big = 3.0e16
    rows = [(1, [big, 1.0]), (2, [-big, 2.0]), (3, [big / 2, 3.0])]
    got = whitening.whitened(_vectors(spark, rows)).collect()
    assert {r["n"] for r in got} == {3} and got[0]["identity_error"] < 1e-9
