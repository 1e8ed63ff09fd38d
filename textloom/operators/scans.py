"""Running values and greedy chains over the rows of a key, however many: no key is one task.

``scanned`` sorts rows by ranges of key and order, runs along each range, and carries each range's totals into the next ones.
``first_from`` is a search by such a scan. ``chain_starts`` follows a chain of rows, each naming the next, by pointer doubling: jumps of 1, 2, 4,
... rows by joins, then all rows of the chain by halving the jumps again, so rounds grow with the logarithm of a chain.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from textloom.sources.shared import shared_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(keys: list[str], other: str = "__k_") -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(other + k)) for k in keys))


def scanned(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """df with running values of each key's rows in order: sums (new name -> column of whole numbers, null counts none), and lasts (new name -> column), the last value that isn't null.

    A row's own value counts. Order has to tell the rows of a key apart where results depend on it.
    """
    sums, lasts = sums or {}, lasts or {}
    names = [*sums, *lasts]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [T.StructField(c, T.LongType()) for c in sums] + [T.StructField(c, df.schema[lasts[c]].dataType) for c in lasts]
    schema = T.StructType([*df.schema.fields, *kinds, T.StructField("__place", T.LongType())])
    arrow = to_arrow_schema(T.StructType(kinds))

    def run(batches):
        key, total, last, place = object(), [], [], 0
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in (*sums.values(), *lasts.values())]
            heads = zip(*(b.column(k).to_pylist() for k in keys), strict=True)
            for own, *values in zip(heads, *columns, strict=True):
                if own != key:
                    key, total, last = own, [0] * len(sums), [None] * len(lasts)
                total = [t + (v or 0) for t, v in zip(total, values, strict=False)]
                last = [x if v is None else v for x, v in zip(last, values[len(sums) :], strict=True)]
                place += 1
                out.append((*total, *last, place))
            cols = list(zip(*out, strict=True)) or [()] * (len(names) + 1)
            new = [pa.array(c, t) for c, t in zip(cols, [*arrow.types, pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema.names)

    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    local = stored(dealt.mapInArrow(run, schema).withColumn("__range", F.spark_partition_id()), "scan")
    ends = local.groupBy(*keys, "__range").agg(F.max_by(F.struct(*names), "__place").alias("e"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"e.{c}").over(before), F.lit(0)).alias(f"__c_{c}") for c in sums] + [F.last(f"e.{c}", ignorenulls=True).over(before).alias(f"__c_{c}") for c in lasts]
    carry = ends.select(*(F.col(k).alias("__k_" + k) for k in keys), F.col("__range").alias("__r"), *carried)
    joined = local.join(carry, _same(keys) & (F.col("__range") == F.col("__r")))
    return joined.select(*df.columns, *((F.col(c) + F.col(f"__c_{c}")).alias(c) for c in sums), *(F.coalesce(c, f"__c_{c}").alias(c) for c in lasts))


def first_from(rows: DataFrame, keys: list[str], number: str, value: str, wanted: str, name: str) -> DataFrame:
    """keys, number and name: for each row the smallest number of a row of its key whose value is at least the row's wanted; null if there is none. Values don't fall as numbers grow."""
    offer = rows.select(*keys, F.col(value).alias("__v"), F.lit(0).alias("__asks"), F.col(number).alias("__n"), F.col(number).alias("__offer"))
    ask = rows.select(*keys, F.col(wanted).alias("__v"), F.lit(1).alias("__asks"), F.col(number).alias("__n"), F.lit(None).cast("long").alias("__offer"))
    order = [F.col("__v").desc(), F.col("__asks"), F.col("__n").desc()]
    found = scanned(offer.unionByName(ask), keys, order, lasts={name: "__offer"})
    return found.where("__asks = 1").select(*keys, F.col("__n").alias(number), name)


def chain_starts(links: DataFrame, keys: list[str], number: str, then: str) -> DataFrame:
    """keys and number of the rows that each key's first row leads to, itself included; links: number and the larger number of the row that follows, or null."""
    names = [*keys, number]
    first = links.groupBy(*keys).agg(F.min(number).alias(number))
    jumps = [links.where(F.col(then).isNotNull()).select(*names, then)]
    while True:
        last = jumps[-1] = stored(jumps[-1], "jumps")
        if last.isEmpty():
            jumps.pop()
            break
        ahead = last.select(*(F.col(k).alias("__k_" + k) for k in keys), F.col(number).alias("__from"), F.col(then).alias("__to"))
        jumps.append(last.join(ahead, _same(keys) & (F.col(then) == F.col("__from"))).select(*names, F.col("__to").alias(then)))
    marked = first
    for jump in reversed(jumps):
        to = jump.select(*(F.col(k).alias("__k_" + k) for k in keys), F.col(number).alias("__from"), F.col(then).alias("__to"))
        reached = marked.join(to, _same(keys) & (F.col(number) == F.col("__from"))).select(*keys, F.col("__to").alias(number))
        marked = stored(marked.unionByName(reached), "marked")
    return marked


def _in_chain(rows: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """rows with __start: whether the chain of links (__n to __then) comes to them."""
    marks = chain_starts(links, keys, "__n", "__then").select(*(F.col(k).alias("__k_" + k) for k in keys), F.col("__n").alias("__m"))
    return rows.join(marks, _same(keys) & (F.col("__n") == F.col("__m")), "left").withColumn("__start", F.col("__m").isNotNull().cast("long")).select(*rows.columns, "__start")


def _numbered(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    return stored(scanned(df.withColumn("__one", F.lit(1).cast("long")), keys, list(order), sums={"__n": "__one", **sums}).drop("__one"), "numbered")


def _next(rows: DataFrame, keys: list[str], searches: list[tuple[str, str]]) -> DataFrame:
    """keys, __n and __then: the first row behind each row at which one of the values reaches what the row wants of it."""
    found = None
    for k, (value, wanted) in enumerate(searches):
        one = first_from(rows, keys, "__n", value, wanted, f"__f{k}")
        one = one if found is None else one.select(*(F.col(x).alias("__k_" + x) for x in keys), F.col("__n").alias("__m"), f"__f{k}")
        found = one if found is None else found.join(one, _same(keys) & (F.col("__n") == F.col("__m"))).drop(*("__k_" + x for x in keys), "__m")
    least = F.least(*(F.col(f"__f{k}") for k in range(len(searches)))) if len(searches) > 1 else F.col("__f0")
    # a row that reaches by itself what it wants is followed by the next one, if there is one
    return _last_open(found.select(*keys, "__n", F.when(least.isNotNull(), F.greatest(least, F.col("__n") + 1)).alias("__then")), keys)


def chained_blocks(df: DataFrame, keys: list[str], order: list[str], cost: int, most: int, span: int) -> DataFrame:
    """df (at and size: whole numbers) with block: blocks take rows while their sizes and cost each stay within most and rows come less than span after a block's first."""
    rows = _numbered(df.withColumn("__need", F.col("size") + F.lit(cost)), keys, order, {"__used": "__need"})
    rows = rows.withColumns({"__full": F.col("__used") - F.col("__need") + F.lit(most + 1), "__late": F.col("at") + F.lit(span)})
    found = _in_chain(rows, _next(rows, keys, [("__used", "__full"), ("at", "__late")]), keys)
    return scanned(found, keys, ["__n"], sums={"__block": "__start"}).select(*df.columns, (F.col("__block") - 1).cast("int").alias("block"))


def chained_disjoint(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df (start, by which order begins, and end) with kept: each row that starts no earlier than the last kept one ends."""
    rows = _numbered(df, keys, order, {})
    return _in_chain(rows, _next(rows, keys, [("start", "end")]), keys).select(*df.columns, (F.col("__start") > 0).alias("kept"))


def _last_open(links: DataFrame, keys: list[str]) -> DataFrame:
    """links without those behind a key's last row."""
    top = links.groupBy(*keys).agg(F.max("__n").alias("__top")).select(*(F.col(k).alias("__k_" + k) for k in keys), "__top")
    return links.join(top, _same(keys)).select(*keys, "__n", F.when(F.col("__then") <= F.col("__top"), F.col("__then")).alias("__then"))


def by_size_of_key(df: DataFrame, keys: list[str], most_rows: int, small, large) -> DataFrame:
    """small(rows) for the rows of keys with most_rows rows at most, large(rows) for those of larger keys, in one table."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > most_rows).select(*(F.col(k).alias("__k_" + k) for k in keys))
    big = stored(big, "large-keys")
    if big.isEmpty():
        return small(df)
    return small(df.join(big, _same(keys), "left_anti")).unionByName(large(df.join(big, _same(keys), "left_semi")))
