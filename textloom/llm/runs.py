"""Periodic runs of words within documents, by counting matches at each lag.

A run is a stretch of consecutive words with smallest period q, of max(LEAST, 2 q) words at least, that no
neighbouring word extends keeping that period. In a run of length m, m - q neighbouring places in a
row match the word q further on, so only lags with as many matches can have one.

1. Matches of every lag are counted, exactly: the differences between places of each rare word one by
   one, and for frequent words, whose pairs would be many, the autocorrelation of the places by
   FFT (all frequent words' spectra added up, one way back, rounded: counts are whole numbers).
2. Lags go from short to long. A lag with enough matches is probed at every third of the
   shortest island's length, and scanned for islands of matches where three probes in a row match.
   An island whose stretch has no shorter period is a run.
3. A run of period d matches at all multiples of d too. Those matches are subtracted from their lags' counts, once:
   by the periodicity lemma, no two runs share a matched place of a lag that both periods divide, and no run of a longer smallest
   period does. So a document of one word over and over gets one scan, not one for each lag.

Every document is on its own: no shuffle, and a worker holds the places of one document.

Defined cases: null text counts as empty; without words there are no runs, nulls for the longest
one and the hash of the empty text for both hashes; a null id changes no word; of runs
equally long the first, then that of the shorter period is told; repeated rows get the same result each; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import small_batches, table, text_blocks
from textloom.llm.words import numbers, spans

LEAST = 12
#: A word is frequent with over FREQUENT times the square root of a document's words.
FREQUENT = 2.0
SCHEMA = "doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lag_matches(words: np.ndarray) -> np.ndarray:
    """For each lag from 0 to half the words (0 itself counts none), how many words equal the one that far on."""
    n = len(words)
    top = n // 2
    order = np.argsort(words, kind="stable")
    sizes = np.bincount(words)
    many = np.flatnonzero(sizes > max(8.0, FREQUENT * np.sqrt(n)))
    out = np.zeros(top + 1, np.int64)
    if len(many):
        width = 1 << int(n + top).bit_length()
        power = np.zeros(width // 2 + 1)
        for w in many:
            spectrum = np.fft.rfft((words == w).astype(float), width)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, width)[: top + 1]).astype(np.int64)
        order = order[~np.isin(words[order], many)]
    own = words[order]
    for step in range(1, int(sizes[own].max()) if len(own) else 0):
        same = own[step:] == own[:-step]
        lag = (order[step:] - order[:-step])[same]
        out += np.bincount(lag[lag <= top], minlength=top + 1)
    out[0] = 0
    return out


def _may_have_island(words: np.ndarray, lag: int, need: int) -> bool:
    """False only if no need places in a row match at the lag: of those, three at least are probed."""
    step = need // 3
    if step < 2:
        return True
    hit = words[: len(words) - lag : step] == words[lag::step]
    return bool((hit[:-2] & hit[1:-1] & hit[2:]).any())


def _islands(words: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """(first, number) of need or more places in a row that match at the lag."""
    match = np.concatenate(([False], words[:-lag] == words[lag:], [False]))
    turn = np.flatnonzero(match[1:] != match[:-1])
    begin, end = turn[::2], turn[1::2]
    long = end - begin >= need
    return list(zip(begin[long].tolist(), (end - begin)[long].tolist(), strict=True))


def _is_power(root: np.ndarray) -> bool:
    """Whether a root is a shorter one repeated."""
    q, rest, p = len(root), len(root), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if (root[q // p :] == root[: q - q // p]).all():
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def periodic_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of numbered words, by start, then period."""
    n = len(words)
    if n < least:
        return []
    left = lag_matches(words)
    lags = np.arange(len(left))
    need = np.maximum(lags, least - lags)
    found = []
    for q in np.flatnonzero((left >= need) & (lags > 0)).tolist():
        least_island = int(need[q])
        if left[q] < least_island or not _may_have_island(words, q, least_island):
            continue
        for start, matched in _islands(words, q, least_island):
            if q > 1 and _is_power(words[start : start + q]):
                continue
            length = matched + q
            found.append((start, length, q))
            multiples = np.arange(2 * q, min(length, len(left)), q)
            left[multiples] -= length - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_words(doc_id: object, n: int) -> np.ndarray | None:
    """The original place of each word of a document that the rule makes periodic; None for all others."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _told(raw: np.ndarray, first: np.ndarray, length: np.ndarray, number: np.ndarray, least: int) -> tuple:
    """A document's result, from its words' spans and numbers."""
    found = periodic_runs(number, least)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    drop = np.zeros(len(number) + 1, np.int64)
    for s, m, q in found:
        drop[s + q] += 1
        drop[s + m] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    data = raw.tobytes()
    collapsed = b" ".join(data[i:j] for i, j in zip(first[kept].tolist(), (first + length)[kept].tolist(), strict=True))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def with_runs(docs: DataFrame, least: int = LEAST, change=None) -> DataFrame:
    """A row for each row of docs: doc_id, n_runs, the longest run, hashes of all runs and of the text without repeats.

    change: from a document's id and number of words to the original places of its words, or None.
    """
    small_batches(docs.sparkSession)
    schema = SCHEMA.format(id=dict(docs.dtypes)["doc_id"])
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [None, *[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            for at, end, raw, off in text_blocks(b.column("text")):
                first, length, doc = spans(raw, off)
                number = numbers(raw, first, length)
                border = np.searchsorted(doc, np.arange(end - at + 1))
                for k in range(end - at):
                    i, j = border[k], border[k + 1]
                    own, word = slice(i, j), number[i:j]
                    place = change(ids[at + k], j - i) if change else None
                    begin, size = first[own] - off[k], length[own]
                    if place is not None:
                        begin, size, word = begin[place], size[place], word[place]
                    if j > i:
                        word = np.unique(word, return_inverse=True)[1]
                    out.append(_told(raw[off[k] : off[k + 1]], begin, size, word, least))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            arrays = [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=repeated_words)


#: The CRC of a decimal number, a byte at a time; the table of its 256 steps follows from the polynomial.
CRC32_SQL = """crc_table AS MATERIALIZED (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) r(i))"""
CRC32_OF = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({}, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)"

ORACLE_SQL = f"""
WITH {CRC32_SQL},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32_OF.format("doc_id::VARCHAR")} AS h FROM documents, crc_table),
p AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM d),
c AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // k) ELSE i END]) ELSE w END AS w FROM p),
t AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM c),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
isle AS MATERIALIZED (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
         FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m) GROUP BY doc_id, q, g HAVING count(*) >= greatest(q, {LEAST} - q)),
r AS MATERIALIZED (SELECT * FROM isle a WHERE NOT EXISTS (
        SELECT 1 FROM isle b WHERE a.doc_id = b.doc_id AND b.q < a.q AND a.q % b.q = 0 AND b.start <= a.start AND b.start + b.length >= a.start + a.length)),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS s,
                  arg_min(struct_pack(start := start, length := length, q := q), struct_pack(l := -length, s := start, q := q)) AS top FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT t.doc_id, t.i FROM t JOIN r ON t.doc_id = r.doc_id AND t.i >= r.start + r.q AND t.i < r.start + r.length),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.q AS period, 1000 * top.length // top.q AS exponent_milli,
       sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
