"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of LEAST or more.

The vantage-point search of ``simhash`` names the candidates. A text has SPACES fingerprints of its
words, each counted by the logarithm of its frequency and hashed anew for each space; two
texts are candidates where the fingerprints of some space differ in RADIUS bits at most and those of their
five-word shingles in CHECK_BITS at most. Candidates make groups. Every link
of a group's forest is decided on the shingles (64-bit hashes) of the whole texts; groups that are
then still in several components are compared as a whole, in parts of PART_ROWS rows that
meet pair by pair. Components follow from ``graph``.

Defined cases: shingles are those of ``simhash`` (fewer words than a shingle make one); texts that are null
or without words are near nothing; rows with a null id are left out; rows of one id are
linked by any of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_saved, saved, small_batches, text_blocks
from textloom.llm.docstats import word_table
from textloom.llm.graph import components
from textloom.llm.simhash import grouped_links, majority, shingle_hashes

WORDS = 5
#: The least similarity, as a fraction: compared in whole numbers.
LEAST = (4, 5)
#: Fingerprints of a text, bits in which those of candidates differ at most, and the same for the fingerprints of shingles.
#: On near copies (similarity from 0.8 on) of the check tables 8 spaces name 97 % of the pairs, 95 % of those under 0.85.
SPACES, RADIUS, CHECK_BITS = 12, 2, 18
#: Rows of a group's part.
PART_ROWS = 256

_LOWER = np.array([c | 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (SPACES + 1, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(codes: np.ndarray, space: int) -> np.ndarray:
    """The codes hashed anew for a space."""
    h = (codes ^ _MIX[space, 0]) * _MIX[space, 1]
    h ^= h >> np.uint64(32)
    h *= _MIX[0, 1]
    return h ^ (h >> np.uint64(29))


def block_prints(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents with words, their SPACES fingerprints, the fingerprint of their shingles) of a block of texts."""
    _, _, doc, code = word_table(_LOWER[raw], off)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros((0, SPACES), np.uint64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    docs, size = doc[first], np.diff(np.append(first, len(doc)))
    order = np.lexsort((code, doc))
    d, c = doc[order], code[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]))))
    count = np.diff(np.append(new, len(d)))
    weights = np.minimum(57, np.rint(4 * np.log2(1 + count))).astype(np.uint8)
    begin = np.searchsorted(d[new], docs)
    prints = np.column_stack([majority(mixed(c[new], k + 1), weights, begin) for k in range(SPACES)])
    shingle = code.copy()
    for k in range(1, WORDS):
        # words behind the end of a text count as none
        ahead = np.append(code[k:], np.zeros(k, np.uint64))
        same = np.append(doc[k:] == doc[:-k], np.zeros(min(k, len(doc)), bool))
        shingle = mixed(shingle, 0) + np.where(same, ahead, np.uint64(0))
    # shingles that run over the end aren't any, but for texts shorter than one
    place = np.arange(len(doc)) - np.repeat(first, size)
    whole = (place + WORDS <= np.repeat(size, size)) | (place == 0)
    at = np.searchsorted(doc[whole], docs)
    return docs, prints, majority(mixed(shingle[whole], 0), np.ones(int(whole.sum()), np.uint8), at)


def _hashes(column: pa.Array):
    """Lists of shingle hashes, for the texts of one block after another."""
    for _, _, raw, off in text_blocks(column):
        data = raw.tobytes()
        yield [shingle_hashes(data[i:j], WORDS) for i, j in zip(off[:-1], off[1:], strict=True)]


def with_prints(docs: DataFrame) -> DataFrame:
    """doc_id, space, fp and check, for each space of each text with words."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at, _, raw, off in text_blocks(b.column("text")):
                found, prints, check = block_prints(raw, off)
                ids = b.column("doc_id").take(pa.array(np.repeat(at + found, SPACES)))
                spaces = np.tile(np.arange(SPACES, dtype=np.int32), len(found))
                yield pa.RecordBatch.from_arrays([ids, pa.array(spaces), pa.array(prints.view(np.int64).ravel()), pa.array(np.repeat(check.view(np.int64), SPACES))], ["doc_id", "space", "fp", "check"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, space int, fp long, check long")


def with_shingles(docs: DataFrame) -> DataFrame:
    """doc_id and shingles (the bytes of the sorted distinct hashes) of whole texts."""

    def run(batches):
        for b in batches:
            at = 0
            for found in _hashes(b.column("text")):
                sets = pa.array([np.unique(h).tobytes() for h in found], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(found)), sets], ["doc_id", "shingles"])
                at += len(found)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, shingles binary")


def _near(both, either):
    return both * LEAST[1] >= either * LEAST[0]


def near_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near copies."""
    kind = dict(pairs.dtypes)["a"]
    x, y = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"{k}_shingles")) for k in "ab")
    each = pairs.join(x, "a").join(y, "b")
    short, long = (f(F.length("a_shingles"), F.length("b_shingles")) for f in (F.least, F.greatest))
    each = each.where(short * LEAST[1] >= long * LEAST[0])

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("a_shingles"), b.column("b_shingles"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(_near(both, len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return each.select("a", "b", "a_shingles", "b_shingles").mapInArrow(run, f"a {kind}, b {kind}")


def part_links(sets: list[np.ndarray], label: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Places of near copies, one of rows and one of cols, that join all labels which near copies join; label is changed."""
    values, sizes = np.concatenate([sets[j] for j in cols]), np.array([len(sets[j]) for j in cols])
    order = np.argsort(values)
    values, owner = values[order], np.repeat(np.arange(len(cols)), sizes)[order]
    found = []
    for i in rows:
        if (label[cols] == label[i]).all():
            continue
        low, high = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(cols))
        for j in cols[_near(both, len(sets[i]) + sizes - both)]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                found.append((i, j))
    return found


def group_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of the rows (key, part, other, side, doc_id, root, shingles): a part's rows with each other, or with another part's."""

    def run(batches):
        held, key = [], None

        def flush():
            ids = pa.concat_arrays([h[0] for h in held])
            side, label = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for h in held for v in h[3]]
            mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            theirs = mine if key[1] == key[2] else theirs
            found = np.array(part_links(sets, label, mine, theirs) if len(mine) and len(theirs) else [], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(found[:, k])) for k in (0, 1)], ["a", "b"])

        for b in batches:
            names = [b.column(c).to_numpy() for c in ("key", "part", "other")]
            side, root = b.column("side").to_numpy(), b.column("root").to_numpy()
            if not len(side):
                continue
            new = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in names], axis=0))))
            for i, j in zip(new, np.append(new[1:], len(side)), strict=True):
                this = tuple(x[i] for x in names)
                if held and this != key:
                    yield flush()
                    held = []
                key = this
                held.append((b.column("doc_id").slice(i, j - i), side[i:j], root[i:j], b.column("shingles").slice(i, j - i)))
        if held:
            yield flush()

    keys, kind = ["key", "part", "other"], dict(rows.dtypes)["doc_id"]
    rows = rows.select(*keys, "side", "doc_id", "root", "shingles")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {kind}, b {kind}")


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that join the same ids: each b keeps its least a, to which its other a's are tied instead.

    Many shards tell of one group, each with the least id that it holds; the ties between those few ids repeat and vanish.
    """

    def run(batches):
        last, least = None, None
        for batch in batches:
            a, b = (batch.column(c).to_pandas().reset_index(drop=True) for c in "ab")
            if not len(b):
                continue
            first = (b != b.shift()).to_numpy()
            first[0] = last is None or b.iloc[0] != last
            least_of = a.where(first)
            if not first[0]:
                least_of.iloc[0] = least
            least_of = least_of.ffill().astype(a.dtype)
            last, least = b.iloc[-1], least_of.iloc[-1]
            out = pd.DataFrame({"a": least_of, "b": b.where(first, a)})
            out = out[out["a"] != out["b"]].drop_duplicates()
            yield pa.RecordBatch.from_pandas(out, pa.schema([("a", batch.schema.field("a").type), ("b", batch.schema.field("b").type)]), preserve_index=False)

    kind = dict(links.dtypes)["a"]
    return links.repartition("b").sortWithinPartitions("b", "a").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def candidates(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids: a forest of all candidates, at least."""
    prints = saved(with_prints(docs), "near-prints")
    keys = ["space", "fp", "check"]
    distinct = saved(prints.groupBy(*keys).agg(F.min("doc_id").alias("v")), "near-distinct")
    alike = prints.join(distinct, keys).where("doc_id <> v").select(F.col("v").alias("a"), F.col("doc_id").alias("b"))
    pairs = saved(contracted(alike.unionByName(grouped_links(distinct, RADIUS, CHECK_BITS))), "near-candidates")
    drop_saved(prints)
    drop_saved(distinct)
    return pairs


def near_components(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(v, root) for every id of docs with near copies; root is the smallest id reachable by pairs of near copies."""
    docs = docs.where("doc_id IS NOT NULL")
    pairs = candidates(docs)
    groups = components(pairs)
    sets = saved(with_shingles(docs.join(groups.select(F.col("v").alias("doc_id")), "doc_id", "left_semi")), "near-shingles")
    links = saved(near_pairs(pairs, sets).distinct(), "near-links")
    # groups of three ids or more that these links leave apart
    roots = components(links)
    named = groups.select(F.col("root").alias("key"), F.col("v").alias("doc_id")).join(roots, F.col("doc_id") == F.col("v"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    apart = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 AND low < high").select("key", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    named = saved(named.join(apart, "key"), "near-apart")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    grid = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = named.withColumn("mine", mine)
    as_row = F.transform(F.filter(grid, lambda j: j >= F.col("mine")), lambda j: F.struct(F.col("mine").alias("part"), j.alias("other"), F.lit(0).alias("side")))
    as_col = F.transform(F.filter(grid, lambda i: i < F.col("mine")), lambda i: F.struct(i.alias("part"), F.col("mine").alias("other"), F.lit(1).alias("side")))
    dealt = dealt.select(F.xxhash64("key").alias("key"), "doc_id", F.xxhash64("root").alias("root"), F.explode(F.concat(as_row, as_col)).alias("g")).select("key", "g.part", "g.other", "g.side", "doc_id", "root")
    more = saved(group_links(dealt.join(sets, "doc_id")), "near-links")
    return roots if more.isEmpty() else components(links.unionByName(more))
