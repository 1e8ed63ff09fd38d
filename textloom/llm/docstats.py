"""Statistics of whole documents, computed over blocks of UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

from textloom.llm.words import codes, mix, spans

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _PUNCT, _SYMBOL, _WIDE, _TAIL = range(9)


def _classes() -> np.ndarray:
    """Class of each byte; letters beyond ASCII count by their first byte, later bytes are _TAIL."""
    kind = np.full(256, _SYMBOL, np.uint8)
    kind[:33] = _SPACE
    kind[127] = _SPACE
    for chars, k in ((b".!?", _STOP), (b",;:'\"()-", _PUNCT)):
        kind[list(chars)] = k
    kind[ord("a") : ord("z") + 1] = _LOWER
    kind[ord("A") : ord("Z") + 1] = _UPPER
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[128:192] = _TAIL
    kind[192:] = _WIDE
    return kind


KIND = _classes()
_SEPARATES = KIND == _SPACE
_PLACE = np.uint64(0x9E3779B97F4A7C15)

NAMES = (
    "log_chars", "log_words", "log_lines", "mean_word", "log_longest_word", "upper", "digit", "stop", "punct", "symbol", "wide",
    "space", "caps_words", "shout", "symbol_words", "repeat_1", "repeat_2", "log_distinct", "distinct_line", "ends_with_stop", "line_words", "vowel_like",
)


def starts_of(flag: np.ndarray) -> np.ndarray:
    """Places where flag turns true."""
    if not len(flag):
        return np.zeros(0, np.int64)
    return np.flatnonzero(flag & np.concatenate(([True], ~flag[:-1])))


def word_table(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document, hash) of the words between ASCII white space; documents never share a word."""
    first, length, doc = spans(raw, off, _SEPARATES)
    return first, length, doc, codes(raw, first, length)


def document_stats(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document of the block; all finite, empty documents included."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    if not n:
        return out
    kind = KIND[raw]
    cells = np.zeros((n, 9))
    doc_of = np.repeat(np.arange(n), np.diff(off))
    cells += np.bincount(doc_of * 9 + kind, minlength=9 * n)[: 9 * n].reshape(n, 9) if len(raw) else 0
    chars = cells.sum(1) - cells[:, _TAIL]
    letters = cells[:, _LOWER] + cells[:, _UPPER] + cells[:, _WIDE]
    first, length, doc, code = word_table(raw, off)
    count = lambda mask_docs, weights=None: np.bincount(mask_docs, weights, minlength=n)[:n].astype(float)
    words = count(doc)
    per = lambda x, y: x / np.maximum(y, 1)
    newline = count(doc_of[raw == 10]) if len(raw) else np.zeros(n)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(chars), np.log1p(words), np.log1p(newline)
    out[:, 3] = per(letters, words)
    if len(first):
        longest = np.zeros(n)
        np.maximum.at(longest, doc, length)
        out[:, 4] = np.log1p(longest)
        lower_in = np.add.reduceat((kind == _LOWER).astype(np.int64), first)
        upper_in = np.add.reduceat((kind == _UPPER).astype(np.int64), first)
        symbol_in = np.add.reduceat((kind == _SYMBOL).astype(np.int64), first)
        exclaim = np.add.reduceat((raw == ord("!")).astype(np.int64), first)
        out[:, 12] = per(count(doc[(upper_in >= 2) & (lower_in == 0)]), words)
        out[:, 13] = per(count(doc[exclaim >= 2]), words)
        out[:, 14] = per(count(doc[symbol_in >= 1]), words)
        for k, j in ((1, 15), (2, 16)):
            if len(code) > k:
                same = (code[k:] == code[:-k]) & (doc[k:] == doc[:-k])
                out[:, j] = per(count(doc[k:][same]), words)
        mixed = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (code >> np.uint64(24)))
        new = np.concatenate(([True], mixed[1:] != mixed[:-1]))
        distinct = count((mixed[new] >> np.uint64(40)).astype(np.int64))
        out[:, 17] = np.log1p(distinct) - np.log1p(words)
        # lines: a sum of hashes of their words, each mixed with its place
        line_break = np.cumsum(raw == 10)
        line = line_break[first] + doc  # never the same for two documents, as doc grows
        begin = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))))
        place = np.arange(len(first)) - np.repeat(begin, np.diff(np.append(begin, len(first))))
        text_line = np.add.reduceat(mix(code + place.astype(np.uint64) * _PLACE), begin)
        line_doc = doc[begin]
        mixed = np.sort((line_doc.astype(np.uint64) << np.uint64(40)) | (text_line >> np.uint64(24)))
        new = np.concatenate(([True], mixed[1:] != mixed[:-1]))
        lines = count(line_doc)
        out[:, 18] = per(count((mixed[new] >> np.uint64(40)).astype(np.int64)), lines)
        last_byte = raw[first + length - 1]
        stop_end = KIND[last_byte] == _STOP
        final = np.append(begin[1:], len(first)) - 1
        out[:, 19] = per(count(line_doc, stop_end[final].astype(float)), lines)
        out[:, 20] = np.log1p(per(words, lines))
        vowels = np.isin(raw, np.frombuffer(b"aeiouAEIOU", np.uint8))
        out[:, 21] = per(count(doc_of[vowels]), letters)
    for k, j in ((_UPPER, 5), (_DIGIT, 6), (_STOP, 7), (_PUNCT, 8), (_SYMBOL, 9), (_WIDE, 10), (_SPACE, 11)):
        out[:, j] = np.sqrt(per(cells[:, k], chars))
    for j in (12, 13, 14, 15, 16):
        out[:, j] = np.sqrt(out[:, j])
    return out
