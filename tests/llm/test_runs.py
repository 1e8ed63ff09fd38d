"""Periodic runs against a plain search, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import runs, words


def plain_runs(w, least=runs.LEAST):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(w[i : i + size - d] == w[i + d : i + size] for d in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, kinds = rng.randrange(0, 100), rng.choice([1, 2, 3, 9])
    w = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 2))
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("frequent", [0.001, 2.0, 100.0])
def test_runs(monkeypatch, frequent):
    """Whether frequent words go by FFT, by differences, or both ways."""
    monkeypatch.setattr(runs, "FREQUENT", frequent)
    rng = random.Random(5)
    for _ in range(1200):
        w = periodic_words(rng)
        number = np.unique(np.array(w, np.int64), return_inverse=True)[1] if w else np.zeros(0, np.int64)
        assert runs.periodic_runs(number) == plain_runs(w), w


def test_matches_of_every_lag():
    rng = np.random.default_rng(1)
    w = np.minimum(rng.zipf(1.2, 3000), 40)
    w = np.unique(w, return_inverse=True)[1]
    want = [0] + [int((w[:-q] == w[q:]).sum()) for q in range(1, 1501)]
    assert runs.lag_matches(w).tolist() == want


def test_word_numbers_and_codes():
    rng = random.Random(2)
    some = [bytes(rng.choices(b"ab", k=rng.randrange(1, 12))) for _ in range(400)] + [b"x" * k + b"y" * (300 - k) for k in range(0, 300, 7)] + [b"q" * 140, b"q" * 64 + b"r" + b"q" * 75]
    raw = np.frombuffer(b" ".join(some), np.uint8)
    first, length, doc = words.spans(raw, np.array([0, len(raw)]))
    assert length.tolist() == [len(s) for s in some] and not doc.any()
    for found in (words.numbers(raw, first, length).tolist(), words.codes(raw, first, length).tolist()):
        assert len(set(zip(found, some, strict=True))) == len(set(some)) == len(set(found))


def test_words_of_one_code_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(words, "codes", lambda raw, first, length: np.zeros(len(first), np.uint64))
    raw = np.frombuffer(b"ab cd ab e cd", np.uint8)
    first, length, _ = words.spans(raw, np.array([0, len(raw)]))
    assert words.numbers(raw, first, length).tolist() == [0, 1, 0, 2, 1]


def test_rows(spark):
    """The change by id, nulls, repeats, blanks and long texts, against the rule as it is told."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 400))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(90, None), (91, ""), (92, "\t \n"), (93, "été\x00x " * 3000), (None, "a b " * 20), (94, "Same word. " * 50), (94, "Same word. " * 50)]
    rows += [(i, t) for i, t in ((k, "One\x0btwo\x0cthree four five " * 9) for k in range(100, 160))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_runs long").repartition(3)
    got = sorted((tuple(r) for r in runs.with_runs(docs, change=runs.repeated_words).collect()), key=repr)
    want = []
    for i, t in rows:
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in t or "").split(" ") if x]
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        found = plain_runs(w)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 5
    assert runs.with_runs(docs.where(F.lit(False))).count() == 0
