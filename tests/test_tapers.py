"""Tapers and spectra against dense eigenvectors, sums and loops."""

import numpy as np
import pandas as pd

from tidemark.operators import features as fe
from tidemark.operators import tapers as tp


def test_tapers_equal_the_dense_eigenvectors():
    for n in (16, 64, 129):
        lag = np.arange(n)[:, None] - np.arange(n)
        kernel = np.where(lag == 0, 8 / n, np.sin(2 * np.pi * 4 / n * lag) / np.where(lag == 0, 1, np.pi * lag))
        want, vectors = np.linalg.eigh(kernel)
        shape, share = tp.tapers(n)
        assert len(shape) == (want > 0.9).sum()
        assert np.allclose(share, want[::-1][:len(share)], atol=1e-9)
        assert np.allclose(shape @ shape.T, np.eye(len(shape)), atol=1e-9)
        # eigenvalues near 1 are too close to tell single vectors apart in the dense form, the space they span isn't
        assert np.allclose(kernel @ shape.T, shape.T * share, atol=1e-9)


def test_long_tapers_are_orthonormal():
    shape, share = tp.tapers(3000)
    assert len(shape) == 7 and np.allclose(shape @ shape.T, np.eye(7), atol=1e-8) and (share > 0.9).all()


def test_white_noise_sums_to_its_variance():
    x = np.random.default_rng(1).normal(scale=3, size=(200, 512))
    for spectrum, points in ((tp.adaptive_spectrum(x, 64.0), 512), (tp.median_spectrum(x, 64.0, 1.0), 64)):
        power = spectrum.sum(1) * 64 / points
        assert abs(power.mean() / 9 - 1) < 0.05


def test_tone_and_loop():
    t = np.arange(640) / 64
    x = np.array([np.sin(2 * np.pi * 10 * t), np.random.default_rng(2).normal(size=640).cumsum()])
    assert tp.adaptive_spectrum(x, 64.0)[0].argmax() == 100
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(64) / 64)
    for row, got in zip(x, tp.median_spectrum(x, 64.0, 1.0)):
        parts = []
        for at in range(0, 640 - 63, 32):
            part = row[at:at + 64]
            p = np.abs(np.fft.rfft((part - part.mean()) * window)) ** 2 / (64 * (window ** 2).sum())
            p[1:-1] *= 2
            parts.append(p)
        n = len(parts)
        bias = 1 + sum(1 / (2 * i + 1) - 1 / (2 * i) for i in range(1, (n - 1) // 2 + 1))
        assert np.allclose(got, np.median(parts, axis=0) / bias)
    # weights that no longer change give the spectrum back
    share, power = tp.tapers(640)[1][:, None], np.abs(np.fft.rfft((x[1] - x[1].mean()) * tp.tapers(640)[0])) ** 2
    spectrum = tp.adaptive_spectrum(x, 64.0)[1] * 64
    spectrum[1:-1] /= 2
    weight = share * (spectrum / (share * spectrum + (1 - share) * x[1].var())) ** 2
    assert np.allclose((weight * power).sum(0) / weight.sum(0), spectrum, rtol=1e-5)


def test_missing_short_and_flat_epochs(spark):
    rows = pd.DataFrame({"e": [1, 2, 3, 4, 5], "samples": [list(np.sin(np.arange(128.0))), [1.0, 2.0, 4.0], None, [], [5.0] * 16]})
    df = spark.createDataFrame([(int(e), None if s is None else [float(v) for v in s]) for e, s in zip(rows["e"], rows["samples"])], "e long, samples array<double>")
    out = df.withColumns({"m": tp.multitaper(64.0)("samples"), "w": tp.welch_median(64.0, 0.5)("samples")}).toPandas().set_index("e")
    assert len(out.loc[1, "m"]) == 65 and len(out.loc[1, "w"]) == 17 and len(out.loc[2, "m"]) == 2
    assert out.loc[3, "m"] is None and out.loc[4, "w"] is None and max(out.loc[5, "m"]) == 0
    bands = fe.band_features(df.filter("e = 1").withColumn("psd", tp.welch_median(64.0, 0.5)("samples")), "psd", "samples", 64.0, points=32).first()
    assert bands["rel_alpha"] + bands["rel_sigma"] > 0.5  # one radian a sample is 10.2 Hz
