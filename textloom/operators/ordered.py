"""Operators over ordered rows: gaps, overlaps, sessions, folds, coverage."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from textloom.operators import scans

#: Rows of a key that ``folded`` streams through one task; larger keys are chained (``scans``), whose tasks share a key.
KEY_ROWS = 1 << 20


def neighbours_flagged(df: DataFrame, keys: list[str], order: list[str], against_previous, name: str) -> DataFrame:
    """Flag a row and its predecessor where ``against_previous(previous: name -> Column)`` holds for the row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = df.withColumn("__hit", F.coalesce(against_previous(lambda c: F.lag(c).over(w)), F.lit(False)))
    return own.withColumn(name, F.col("__hit") | F.coalesce(F.lead("__hit").over(w), F.lit(False))).drop("__hit")


def overlapping(df: DataFrame, keys: list[str], start: str, end: str, tie: str, name: str = "overlaps") -> DataFrame:
    """Flag rows whose half-open interval meets another of the same key: two running extremes, no join."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(start).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(before > F.col(start), F.lit(False)) | F.coalesce(after < F.col(end), F.lit(False)))


def uncovered(df: DataFrame, keys: list[str], start: str, end: str, whole: str, first: int = 0) -> DataFrame:
    """Intervals that leave a gap, overlap, don't begin at ``first`` or don't end at ``whole``: with a reason."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    prev, nxt = F.lag(end).over(w), F.lead(start).over(w)
    reason = (
        F.when(F.col(end) <= F.col(start), "empty")
        .when(prev.isNull() & (F.col(start) != first), "starts_late")
        .when(prev.isNotNull() & (F.col(start) > prev), "gap_before")
        .when(prev.isNotNull() & (F.col(start) < prev), "overlap_before")
        .when(nxt.isNull() & (F.col(end) != F.col(whole)), "ends_short")
    )
    return df.withColumn("reason", reason).where("reason IS NOT NULL")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], tie: str) -> DataFrame:
    """left with the values of the latest right row before it (as-of): a union and one running window, no range join."""
    tagged = left.withColumn("__right", F.lit(None).cast(right.select(F.struct(time, tie, *values).alias("s")).schema["s"].dataType))
    other = right.select(*keys, time, tie, F.struct(time, tie, *values).alias("__right"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    # of rows at one time, right ones come after left ones, so that a match is strictly earlier
    w = Window.partitionBy(*keys).orderBy(time, F.col("__right").isNotNull(), tie).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("__right", ignorenulls=True).over(w)
    return both.withColumn("__last", last).where("__right IS NULL").select(*left.columns, *(F.col(f"__last.{v}").alias(f"previous_{v}") for v in values))


def folded(df: DataFrame, keys: list[str], order: list[str], step: Callable, start: object, emits: str) -> DataFrame:
    """df with the columns emits, from a fold over the rows of each key in order: step(state, row) gives the next state and a tuple of those columns.

    For rules in which a row depends on what became of the rows before it. The rows of a key stream through one task in Arrow
    batches; no key is gathered.
    """
    names = df.columns
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(emits).fields])
    new = schema.names[len(names) :]
    kinds = to_arrow_schema(T.StructType(schema.fields[len(names) :]))

    def run(batches):
        key, state = None, start
        for b in batches:
            row = namedtuple("Row", names)
            out = []
            for values in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                r = row(*values)
                own = tuple(getattr(r, k) for k in keys)
                if own != key:
                    key, state = own, start
                state, found = step(state, r)
                out.append(found)
            columns = list(zip(*out, strict=True)) or [()] * len(new)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True))], schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def block_of(cost: int, most: int, span: float) -> Callable:
    """A step for ``folded`` over rows with seconds and size: the number of the row's block (start from None).

    A block takes rows while their sizes plus ``cost`` each stay within ``most`` and the row starts less than ``span`` after the block's first.
    """

    def step(state, row):
        need = row.size + cost
        if state is not None and state[1] + need <= most and row.seconds - state[2] < span:
            state = (state[0], state[1] + need, state[2])
        else:
            state = (0 if state is None else state[0] + 1, need, row.seconds)
        return state, (state[0],)

    return step


def kept_disjoint(until, row):
    """A step for ``folded`` over rows with start and end: whether the row is kept, as it starts no earlier than the last kept one ends (start from None)."""
    ok = until is None or row.start >= until
    return (row.end if ok else until), (ok,)


def greedy_blocks(df: DataFrame, keys: list[str], order: list[str], cost: int, most: int, span: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """df (at and size: whole numbers) with block: see ``block_of``; at doesn't fall in order."""
    step = block_of(cost, most, span)

    def small(rows: DataFrame) -> DataFrame:
        return folded(rows.withColumn("seconds", F.col("at")), keys, order, step, None, "block int").drop("seconds")

    return scans.by_size_of_key(df, keys, key_rows, small, lambda rows: scans.chained_blocks(rows, keys, order, cost, most, span))


def disjoint(df: DataFrame, keys: list[str], order: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """df (start, by which order begins, and end) with kept: see ``kept_disjoint``."""
    small = lambda rows: folded(rows, keys, order, kept_disjoint, None, "kept boolean")
    return scans.by_size_of_key(df, keys, key_rows, small, lambda rows: scans.chained_disjoint(rows, keys, order))


def equal_runs(codes: Column, copies: int, most: int) -> Column:
    """Array of (size, first, n): for each size up to most the stretches of n places at which a code equals the one ``size`` further on,
    those long enough for so many copies. In Arrow batches, a few vector steps for each size and array."""

    def runs(series: pd.Series) -> pd.Series:
        out = []
        for row in series:
            c, found = np.asarray(row if row is not None else (), np.int64), []
            for size in range(1, min(most, len(c) // copies) + 1):
                same = np.zeros(len(c) - size + 2, np.int8)
                same[1:-1] = c[:-size] == c[size:]
                edge = np.diff(same)
                first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                long = stop - first >= (copies - 1) * size
                found += [{"size": size, "first": int(i), "n": int(j - i)} for i, j in zip(first[long], stop[long], strict=True)]
            out.append(found)
        return pd.Series(out)

    return F.pandas_udf(runs, "array<struct<size:int,first:int,n:int>>")(codes)


def repeated_grams(tokens: DataFrame, key: str, copies: int = 10, most_words: int = 8) -> DataFrame:
    """The longest run of one repeated word sequence in each token array: key, ngram, copies, ngram_words, start_word, repeated_words.

    tokens has key and words (an array). For each size, a sequence that stands k times in a
    row matches itself ``size`` words further on over (k - 1) * size places, so runs of such
    matches (gaps and islands) give all repeats without listing sequences. Words are compared by 64-bit hashes, those of the run that is told by themselves
    (an error, should a hash ever stand for two words). Of equal lengths the
    smaller size, then the earlier offset (the start modulo the size), then the earlier start wins.
    """
    codes = F.transform("words", lambda w: F.xxhash64(w))
    spread = tokens.select(key, F.explode(equal_runs(codes, copies, most_words)).alias("r"))
    # n matches from place f: at each of the first starts f .. f + rest there are floor(n / size) + 1 copies
    full = spread.select(key, F.col("r.size").alias("size"), F.col("r.first").alias("first"), (F.floor(F.col("r.n") / F.col("size")) + 1).alias("copies"), (F.col("r.n") % F.col("size")).alias("rest")).where(F.col("copies") >= copies)
    starts = full.select(key, "size", "copies", F.explode(F.sequence(F.col("first"), F.col("first") + F.least("rest", F.col("size") - 1))).alias("start"))
    best = F.min(F.struct((-F.col("copies") * F.col("size")).alias("less"), "size", (F.col("start") % F.col("size")).alias("offset"), "start", "copies"))
    found = starts.groupBy(key).agg(best.alias("b"))
    places = F.sequence(F.lit(0), F.col("b.copies").cast("int") * F.col("b.size") - 1)
    same = F.forall(places, lambda i: F.get("words", F.col("b.start") + i) == F.get("words", F.col("b.start") + i % F.col("b.size")))
    ngram = F.when(same, F.slice("words", F.col("b.start") + 1, F.col("b.size"))).otherwise(F.raise_error(F.lit("two words have one hash")))
    return found.join(tokens, key).select(
        key, ngram.alias("ngram"), F.col("b.copies").cast("long").alias("copies"), F.col("b.size").cast("int").alias("ngram_words"),
        F.col("b.start").cast("int").alias("start_word"), (-F.col("b.less")).cast("long").alias("repeated_words"),
    )


def bisected(df: DataFrame, start: str, end: str, fails, depth: int, least: int) -> DataFrame:
    """Halve intervals for which ``fails(start, end)`` holds, depth times at most, while both halves keep ``least``: the leaves.

    depth is a constant, so the plan is that many unions of filters over one scan, without shuffles.
    """
    rest = [c for c in df.columns if c not in (start, end)]
    live, leaves = df.withColumn("depth", F.lit(0)), []
    for level in range(depth + 1):
        mid = F.floor((F.col(start) + F.col(end)) / 2).cast("long")
        bad = fails(F.col(start), F.col(end))
        split = bad & F.lit(level < depth) & (mid - F.col(start) >= least) & (F.col(end) - mid >= least)
        leaves.append(live.where(~split).withColumn("unresolved", bad))
        if level == depth:
            break
        halves = F.array(F.struct(F.col(start).alias("s"), mid.alias("e")), F.struct(mid.alias("s"), F.col(end).alias("e")))
        live = live.where(split).select(*rest, F.explode(halves).alias("h"), (F.lit(level) + 1).alias("depth")).select(*rest, F.col("h.s").alias(start), F.col("h.e").alias(end), "depth")
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out
