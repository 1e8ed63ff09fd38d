"""Audio samples as arrays: PCM bytes, resampling by block means, levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16_000


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Means of the samples that fall on each new sample; at least one each, so a lower rate repeats samples."""
    n = len(samples) * to // rate
    begin = np.arange(n) * rate // to
    end = np.minimum(len(samples), np.maximum(begin + 1, (np.arange(n) + 1) * rate // to))
    total = np.concatenate(([0.0], np.cumsum(samples, dtype=float)))
    return (total[end] - total[begin]) / np.maximum(end - begin, 1)


def to_pcm(samples: np.ndarray) -> bytes:
    """16-bit little-endian samples; values are clipped to -1..1 and halves round up."""
    x = np.clip(samples, -1, 1)
    return np.floor(x * np.where(x < 0, 32768, 32767) + 0.5).astype("<i2").tobytes()


def _encode(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([to_pcm(resample(np.asarray(s, float), int(r))) for s, r in zip(samples, rate, strict=True)])


def pcm_base64(samples: Column, rate: Column) -> Column:
    """Samples at a rate as base64 of 16-bit samples at 16 kHz."""
    return F.base64(F.pandas_udf(_encode, "binary")(samples, rate))


def _decode(pcm: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else (np.frombuffer(p[: len(p) // 2 * 2], "<i2") / 32768).tolist() for p in pcm])


def pcm_samples(encoded: Column) -> Column:
    """The samples, from -1 to 1, of base64 of 16-bit samples; an odd last byte is left out."""
    return F.pandas_udf(_decode, "array<double>")(F.unbase64(encoded))


def mono(channels: Column) -> Column:
    """An array of channels (arrays of one length) as their mean."""
    first = F.get(channels, F.lit(0))
    return F.transform(first, lambda _, i: F.aggregate(channels, F.lit(0.0), lambda acc, c: acc + F.get(c, i)) / F.size(channels))


# resampling without aliases

#: Length of the filter to either side, in samples of the lower rate, and the middle of its edge as a share of half that rate.
HALF, EDGE = 52, 0.9375
#: Fixed values of the four-term Blackman-Harris window.
WINDOW = (0.35875, 0.48829, 0.14128, 0.01168)


def filter_bank(rate: int, to: int) -> np.ndarray:
    """Weights of a windowed sinc, a row for each phase that new samples have between old ones; each row's sum is one.

    Row r, column k weigh the old sample k - reach + 1 places from the one at or before a new sample, which is r / (to / gcd) behind it.
    """
    phases = to // np.gcd(rate, to)
    reach = int(np.ceil(HALF * max(1.0, rate / to)))
    cutoff = EDGE * min(1.0, to / rate)
    place = np.arange(-reach + 1, reach + 1)[None, :] - (np.arange(phases) / phases)[:, None]
    window = sum((-1) ** k * w * np.cos(np.pi * k * (place / reach + 1)) for k, w in enumerate(WINDOW))
    bank = np.where(np.abs(place) < reach, np.sinc(cutoff * place) * window, 0.0)
    return bank / bank.sum(axis=1, keepdims=True)


class Resampler:
    """New samples as old ones come in pieces; the taps that the next ones need are carried. What lies before the first and behind the last sample is taken as they are."""

    def __init__(self, rate: int, to: int = RATE) -> None:
        common = int(np.gcd(rate, to))
        self.up, self.down, self.bank = to // common, rate // common, filter_bank(rate, to)
        self.reach = self.bank.shape[1] // 2
        self.given = self.made = 0
        self.tail = np.zeros(0)

    def _ready(self, stop: int) -> np.ndarray:
        """All new samples whose taps end before the old sample stop; tail holds those from given - len(tail) on."""
        base = self.given - len(self.tail)
        # sample n is at n * down / up, and needs old ones up to reach places from there
        last = ((stop - self.reach) * self.up - 1) // self.down if stop > self.reach else -1
        out = []
        for at in range(self.made, last + 1, 1 << 14):
            n = np.arange(at, min(last + 1, at + (1 << 14)))
            whole, phase = np.divmod(n * self.down, self.up)
            taps = self.tail[(whole - base)[:, None] + np.arange(-self.reach + 1, self.reach + 1)[None, :]]
            out.append((taps * self.bank[phase]).sum(axis=1))
        self.made = max(self.made, last + 1)
        keep = self.made * self.down // self.up - self.reach + 1
        self.tail = self.tail[max(0, keep - base) :]
        return np.concatenate(out) if out else np.zeros(0)

    def push(self, samples: np.ndarray) -> np.ndarray:
        samples = np.asarray(samples, float)
        if not len(samples):
            return np.zeros(0)
        if not self.given:
            self.tail = np.full(self.reach, samples[0])
        self.tail = np.concatenate([self.tail, samples])
        self.given += len(samples)
        return self._ready(self.given)

    def finish(self) -> np.ndarray:
        """The samples left, as many in all as the length at the new rate, rounded up."""
        if not self.given:
            return np.zeros(0)
        total = -(-self.given * self.up // self.down)
        end = self.given
        self.tail = np.concatenate([self.tail, np.full(2 * self.reach + 1, self.tail[-1])])
        self.given += 2 * self.reach + 1
        return self._ready(self.given)[: max(0, total - (self.made_before(end)))]

    def made_before(self, end: int) -> int:
        """How many samples pushes up to end old ones have given."""
        return max(0, ((end - self.reach) * self.up - 1) // self.down + 1) if end > self.reach else 0


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """All samples at another rate; frequencies that the new rate can't hold are gone."""
    r = Resampler(rate, to)
    return np.concatenate([r.push(samples), r.finish()])


def resample_udf(rate: int, to: int):
    """A function of columns of samples (arrays) at a rate."""
    return F.pandas_udf(lambda x: x.map(lambda s: None if s is None else resampled(np.asarray(s, float), rate, to).tolist()), "array<double>")


def resampled_frames(df, keys: list[str], order: list[str], samples: str, rate: int, to: int, name: str = "resampled"):
    """df (rows are frames, in order) with each frame's new samples: a key's frames stream through one task, which carries the taps from frame to frame; the last frame has the rest."""
    from pyspark.sql.window import Window

    from textloom.operators.ordered import folded

    at = df.columns.index(samples)

    def step(state, row):
        state = state or Resampler(rate, to)
        found = state.push(row[at] or ())
        if row.final_frame:
            found = np.concatenate([found, state.finish()])
        return state, (found.tolist(),)

    last = F.lead(F.lit(True)).over(Window.partitionBy(*keys).orderBy(*order)).isNull()
    return folded(df.withColumn("final_frame", last), keys, order, step, None, f"{name} array<double>").drop("final_frame")
