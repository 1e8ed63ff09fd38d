"""Document statistics of blocks against plain Python, a text at a time."""

import math
import random

import numpy as np
import pytest

from textloom.llm import docstats
from textloom.llm.common import text_blocks

import pyarrow as pa  # isort: skip

SPACE = {c for c in range(33)} | {127}


def words_of(b):
    out, word = [], b""
    for c in b:
        if c in SPACE:
            out, word = (out + [word] if word else out), b""
        else:
            word += bytes([c])
    return out + [word] if word else out


def slow(text):
    b = text.encode()
    chars = len(text)
    words = words_of(b)
    got = {"log_chars": math.log1p(chars), "log_words": math.log1p(len(words)), "log_lines": math.log1p(b.count(b"\n"))}
    if words:
        got["log_longest_word"] = math.log1p(max(map(len, words)))
        got["log_distinct"] = math.log1p(len(set(words))) - math.log1p(len(words))
        got["repeat_1"] = math.sqrt(sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words))
        got["repeat_2"] = math.sqrt(sum(x == y for x, y in zip(words, words[2:], strict=False)) / len(words))
        lines = [tuple(words_of(line)) for line in b.split(b"\n")]
        lines = [line for line in lines if line]
        got["distinct_line"] = len(set(lines)) / len(lines)
        got["ends_with_stop"] = sum(line[-1][-1:] in (b".", b"!", b"?") for line in lines) / len(lines)
        got["line_words"] = math.log1p(len(words) / len(lines))
        got["shout"] = math.sqrt(sum(w.count(b"!") >= 2 for w in words) / len(words))
    for name, low, high in (("upper", "A", "Z"), ("digit", "0", "9")):
        got[name] = math.sqrt(sum(low <= c <= high for c in text) / max(chars, 1))
    return got


@pytest.mark.parametrize("block", [1 << 19, 64])
def test_statistics(block):
    rnd = random.Random(2)
    pieces = ["one", "Two", "THREE", "4", "été", "漢字", "stop.", "why?!!", "###", "\n", "\n\n", "\t", "  ", "end", "end"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice([" ", " ", "\n", ""]) for _ in range(rnd.randrange(40))) for _ in range(150)]
    texts += ["", " ", "\n", "x", "a a a a", "é" * 5000, None]
    found = np.vstack([docstats.document_stats(raw, off) for _, _, raw, off in text_blocks(pa.array(texts), block)])
    assert found.shape == (len(texts), len(docstats.NAMES)) and np.isfinite(found).all()
    for text, row in zip(texts, found, strict=True):
        own = dict(zip(docstats.NAMES, row, strict=True))
        for name, value in slow(text or "").items():
            assert own[name] == pytest.approx(value, abs=1e-9), (name, text)


def test_words_are_told_apart():
    raw = np.frombuffer(b"ab ba ab\x0bab abab", np.uint8)
    first, length, doc, code = docstats.word_table(raw, np.array([0, 5, len(raw)]))
    assert first.tolist() == [0, 3, 6, 9, 12] and length.tolist() == [2, 2, 2, 2, 4] and doc.tolist() == [0, 0, 1, 1, 1]
    assert code[0] == code[2] == code[3] and len(set(code.tolist())) == 3
