"""Issue codes as array columns, quarantine, and checks that gather violations before anything is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue_codes(rules: list[tuple[str, Column]]) -> Column:
    """The codes whose condition holds, once each, in the order of the rules; a null condition doesn't hold."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules)))


def status(issues: Column, review: Column | None = None) -> Column:
    """pass without issues; review_required where the exception holds; else quarantined."""
    out = F.when(F.size(issues) == 0, "pass")
    if review is not None:
        out = out.when(review, "review_required")
    return out.otherwise("quarantined")


def exactly(issues: Column, codes: list[str]) -> Column:
    """Whether the codes are these, in any order and number."""
    return F.array_sort(F.array_distinct(issues)) == F.array(*(F.lit(c) for c in sorted(codes)))


def violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The rows that break a rule, with the names of the rules that they break."""
    return df.withColumn("violations", issue_codes([(name, ~F.coalesce(cond, F.lit(False))) for name, cond in rules])).where(F.size("violations") > 0)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, whose evaluation fails with message at the first row where the condition doesn't hold."""
    checked = F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(checked)


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their counts; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def crossing_groups(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that stand in more than one group: (key, n_groups, first_group, last_group)."""
    return df.groupBy(key).agg(F.size(F.collect_set(group)).cast("long").alias("n_groups"), F.min(group).alias("first_group"), F.max(group).alias("last_group")).where("n_groups > 1")


def flag_duplicates(df: DataFrame, key: str, order: str, group: str) -> DataFrame:
    """df with n_alike, is_first (by order) and crosses (on the first one: a later one is of another group).

    By two combined aggregates and a join that Spark can split, so no group of copies is gathered.
    """
    first = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_alike"), F.min(order).alias("__first"), F.min(group).alias("__low"), F.max(group).alias("__high"))
    joined = df.join(first.where("n_alike > 1"), key, "left")
    is_first = F.col("__first").isNull() | (F.col(order) == F.col("__first"))
    return joined.select(*df.columns, F.coalesce("n_alike", F.lit(1)).cast("long").alias("n_alike"), is_first.alias("is_first"), (is_first & F.coalesce(F.col("__low") != F.col("__high"), F.lit(False))).alias("crosses"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one of the two as bags, with the side; empty where they are equal."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def held_out_leaks(held: DataFrame, other: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """(row_id, leaked_key) for each key whose value also stands in the other rows; one semi join for each key."""
    parts = [held.join(other.select(k).distinct(), k, "left_semi").select(row_id, F.lit(k).alias("leaked_key")) for k in keys]
    return reduce(DataFrame.unionByName, parts)


def stale_columns(current: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose stored row is missing or differs, null-safely, and in which columns."""
    s = stored.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__there"))
    j = current.join(s, key, "left")
    changed = issue_codes([(c, ~F.col(c).eqNullSafe(F.col(f"__{c}"))) for c in columns])
    return j.select(key, F.when(F.col("__there").isNull(), F.array(F.lit("missing"))).otherwise(changed).alias("changed")).where(F.size("changed") > 0)
