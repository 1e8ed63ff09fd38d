"""Resampling: levels, aliases, pieces, frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import signal


def level(f, rate, to):
    """Decibels of a sine of that frequency after resampling, away from the ends."""
    y = signal.resampled(np.sin(2 * np.pi * f * np.arange(rate) / rate), rate, to)
    y = y[len(y) // 4 : -len(y) // 4]
    return 10 * np.log10(2 * np.mean(y**2) + 1e-20)


@pytest.mark.parametrize(("rate", "to"), [(44_100, 16_000), (48_000, 16_000), (22_050, 16_000), (8_000, 16_000), (16_000, 44_100)])
def test_levels(rate, to):
    half = min(rate, to) / 2
    assert all(abs(level(f, rate, to)) < 0.1 for f in (50, 0.1 * half, 0.5 * half, 0.87 * half))
    assert all(level(f, rate, to) < -60 for f in (1.005 * half, 1.1 * half, 1.5 * half, 2.2 * half) if f < rate / 2)


def test_levels_of_speech_audio():
    """44.1 to 16 kHz: within a tenth of a decibel below 7 kHz, 60 decibels down above 8 kHz."""
    assert all(abs(level(f, 44_100, 16_000)) < 0.1 for f in range(200, 7_000, 400))
    assert all(level(f, 44_100, 16_000) < -60 for f in range(8_010, 22_000, 700))


@pytest.mark.parametrize(("rate", "to"), [(44_100, 16_000), (3, 2), (2, 3), (5, 5)])
def test_pieces_equal_the_whole(rate, to):
    x = np.random.default_rng(1).normal(size=2000)
    whole = signal.resampled(x, rate, to)
    assert len(whole) == -(-2000 * to // rate)
    for size in (1, 7, 333, 1999):
        r = signal.Resampler(rate, to)
        parts = [r.push(x[at : at + size]) for at in range(0, 2000, size)]
        assert np.allclose(np.concatenate([*parts, r.finish()]), whole)
    assert len(r.tail) < 4 * r.reach + size
    assert np.allclose(signal.resampled(np.full(30, 0.5), rate, to), 0.5) and len(signal.resampled(np.zeros(0), rate, to)) == 0


def test_frames_of_recordings(spark):
    rng = np.random.default_rng(2)
    x = {k: rng.normal(size=n) for k, n in ((1, 1000), (2, 37), (3, 1))}
    rows = [(k, i, v[i * 100 : i * 100 + 100].tolist()) for k, v in x.items() for i in range(-(-len(v) // 100))] + [(1, 50, []), (4, 0, None)]
    df = spark.createDataFrame(rows, "k long, frame long, samples array<double>").repartition(4)
    got = signal.resampled_frames(df, ["k"], ["frame"], "samples", 441, 160).orderBy("k", "frame").collect()
    for k, v in x.items():
        assert np.allclose(np.concatenate([r.resampled for r in got if r.k == k]), signal.resampled(v, 441, 160))
    assert [r.resampled for r in got if r.k == 4] == [[]]
    assert df.select(signal.resample_udf(2, 1)("samples").alias("s")).where(F.col("s").isNull()).count() == 1
