"""Quantiles that merge: sketches of groups, stored, merged across micro-batches and runs, and asked later.

A KLL sketch keeps a sample of a size that depends on its accuracy, not on its input. A quantile's rank is off by ``RANK_ERROR`` of the
values at most, at 99 % confidence, however many sketches were merged; of values that are few the answers are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, and the error of a single rank that it has.
SIZE, RANK_ERROR = 800, 0.0035


def sketched(df: DataFrame, groups: list[str], value: str, size: int = SIZE) -> DataFrame:
    """groups and sketch of the values of each group; nulls don't count, a group of nulls has a sketch of none."""
    return df.groupBy(*groups).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of equal groups as one."""
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """groups, n and a column for each share; null where there are no values."""
    n = F.kll_sketch_get_n_double("sketch")
    each = [F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(k) for k, p in shares.items()]
    return sketches.select(*groups, n.alias("n"), *each)
