"""Joins that Spark has no equality for, made equal on something that both sides must share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.scans import stored

#: Characters of a run that items and texts meet by.
RUN = 12
#: Bytes of items, about, that an automaton is made of.
PART_BYTES = 16 << 20


def word_runs(c: str, run: int) -> Column:
    """The run of characters behind each blank that a word follows."""
    return F.regexp_extract_all(c, F.lit(f"(?s)\\s(?=(\\S.{{{run - 1}}}))"), F.lit(1))


def containing(texts: DataFrame, items: DataFrame, text: str, item: str, run: int = RUN, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs of texts and items, all columns of both, where the text holds the whole item as a substring. Nulls hold nothing; empty items are in every text.

    An item is looked for by one run of characters in it that follows a blank, the rarest of its runs among the texts: a text that holds the item has that run behind a blank too. The texts'
    runs and the items' runs meet in an equi-join, and ``contains`` decides its hits. An item one of whose runs is nowhere is nowhere. Items without a run go through
    automata (``with_automata``).
    """
    # rows are numbered once: what a second reading of the texts would number may be other rows
    texts = stored(texts.where(F.col(text).isNotNull()).withColumn("__row", F.monotonically_increasing_id()), "texts")
    items = stored(items.where(F.col(item).isNotNull()).withColumn("__item", F.monotonically_increasing_id()), "items")
    runs = items.select("__item", F.explode(F.array_distinct(word_runs(item, run))).alias("__run"))
    offers = texts.select("__row", F.explode(F.array_distinct(word_runs(text, run))).alias("__run"))
    wanted = offers.join(runs.select("__run").distinct(), "__run")
    counts = runs.join(wanted.groupBy("__run").agg(F.count(F.lit(1)).alias("__n")), "__run", "left")
    rarest = counts.groupBy("__item").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__run")).alias("r")).where("r.n > 0").select("__item", F.col("r.__run").alias("__run"))
    hits = wanted.join(rarest, "__run").select("__row", "__item")
    found = texts.join(hits, "__row").join(items, "__item").where(F.contains(text, item)).drop("__row", "__item")
    rest = items.join(runs, "__item", "left_anti")
    return found if rest.isEmpty() else found.unionByName(with_automata(texts, rest, text, item, part_bytes).select(*found.columns))


def with_automata(texts: DataFrame, items: DataFrame, text: str, item: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs of texts (numbered by __row) and items (numbered by __item) where the text holds the item, by Aho-Corasick automata.

    The items are dealt out to parts of about part_bytes bytes, an automaton each; every text goes through each automaton once, and hits are as many as there are
    pairs. Only a part's items are ever in the driver, or in a task, together.
    """
    spark = texts.sparkSession
    size = items.agg(F.sum(F.octet_length(item) + F.lit(8))).first()[0] or 0
    parts = max(1, -(-int(size) // part_bytes))
    dealt = items.select("__item", F.col(item).alias("__text"), F.pmod(F.xxhash64("__item"), F.lit(parts)).alias("__part"))
    found = None
    for k in range(parts):
        words: dict[str, list[int]] = {}
        for number, word in dealt.where(F.col("__part") == k).select("__item", "__text").toLocalIterator():
            words.setdefault(word, []).append(number)
        hits = _through(texts.select("__row", F.col(text).alias("__text")), spark.sparkContext.broadcast(words))
        found = hits if found is None else found.unionByName(hits)
    return texts.join(found, "__row").join(items, "__item").drop("__row", "__item")


def _through(texts: DataFrame, words) -> DataFrame:
    """(__row, __item) of the words (a broadcast map of words to items) that each text holds."""

    def run(batches):
        import ahocorasick

        machine, everywhere = ahocorasick.Automaton(), words.value.get("", [])
        for word, numbers in words.value.items():
            if word:
                machine.add_word(word, numbers)
        machine.make_automaton()
        for b in batches:
            rows, items = [], []
            for row, text in zip(b.column("__row").to_pylist(), b.column("__text").to_pylist(), strict=True):
                # a list stands for a word, however often the word is met
                met = {id(numbers): numbers for _, numbers in machine.iter(text)} if len(machine) else {}
                for numbers in (everywhere, *met.values()):
                    rows += [row] * len(numbers)
                    items += numbers
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(items, pa.int64())], ["__row", "__item"])

    return texts.mapInArrow(run, "__row long, __item long")


#: Steps of the least level that a middling interval spans: fewer give fewer rows, more give fewer hits to discard.
STEPS = 4


def _shift(c: Column, bits: Column) -> Column:
    return F.call_function("shiftright", c, bits)


def dyadic_cover(start: Column, end: Column, grain: Column) -> Column:
    """The nodes (level, node) of the least set of aligned intervals of 2 ** level that cover [start, end), no shorter than 2 ** grain and disjoint.

    At each level a node stands at an end of the interval where its neighbour of twice the size would reach beyond it: two at most, so
    their number is logarithmic in the interval's length.
    """
    low, high = _shift(start, grain), _shift(end - 1, grain) + 1
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(high - low, F.lit(1)))).cast("int"))

    def nodes(level: Column) -> Column:
        # the aligned part at this level; ceiling of low, floor of high
        a = -_shift(-low, level)
        b = _shift(high, level)
        left = F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), F.struct((level + grain).alias("level"), a.alias("node")))
        right = F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), F.struct((level + grain).alias("level"), (b - 1).alias("node")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(levels, nodes)), lambda x: x.isNotNull())


def grain_of(intervals: DataFrame, start: str, end: str) -> int:
    """The level at which a middling interval spans STEPS nodes."""
    middle = intervals.select(F.percentile_approx(F.col(end) - F.col(start), 0.5, 100)).first()[0]
    return max(0, int(middle or 1).bit_length() - STEPS.bit_length())


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, grain: int | None = None) -> DataFrame:
    """Pairs of points and half-open intervals of the same keys that hold them, all columns of both; times are whole numbers.

    Intervals of any length: each goes to the nodes of its dyadic cover, each point to its one node at every level that covers have (62 numbers
    at most, collected), and they meet in an equi-join. The nodes of a cover are disjoint, so each pair meets once. A key's rows are spread
    over its nodes, which adaptive execution splits where one is hot. Nulls and intervals without length hold nothing.
    """
    intervals = intervals.where(F.col(start) < F.col(end))
    grain = grain_of(intervals, start, end) if grain is None else grain
    covered = intervals.withColumn("__d", F.explode(dyadic_cover(F.col(start), F.col(end), F.lit(grain)))).select(*intervals.columns, F.col("__d.level").alias("__level"), F.col("__d.node").alias("__node"))
    levels = sorted(r[0] for r in covered.select("__level").distinct().collect())
    places = F.transform(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: F.struct(x.alias("level"), _shift(F.col(at), x).alias("node")))
    spread = points.withColumn("__d", F.explode(places)).select(*points.columns, F.col("__d.level").alias("__level"), F.col("__d.node").alias("__node"))
    found = spread.join(covered, [*keys, "__level", "__node"])
    return found.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__level", "__node")


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """Pairs of intervals of the same keys that share a point: of two, one holds the other's start; those that start together meet on the right one's side."""
    (a, b), (c, d) = left_bounds, right_bounds
    proper = lambda df, s, e: df.where(F.col(s) < F.col(e))
    left, right = proper(left, a, b), proper(right, c, d)
    within = points_in_intervals(left, right, keys, a, c, d)
    around = points_in_intervals(right, left, keys, c, a, b).where(F.col(c) > F.col(a))
    return within.unionByName(around)
