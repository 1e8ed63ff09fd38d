"""Substrings by runs and automata, quantiles by counts and by sketches, leaks in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import joins, rules, sketches
from textloom.plans.reports import percentiles


def strings(rng, n, longest):
    return ["".join(rng.choices("ab \n", k=rng.randrange(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("run", "part_bytes"), [(3, 1 << 20), (3, 40), (50, 60)])
def test_containing_equals_contains(spark, run, part_bytes):
    """With items that have runs, items that have none in automata of a few bytes, copies of both, nulls and empty texts."""
    rng = random.Random(run)
    texts = [*strings(rng, 60, 60), None, "", "é日 日本 x", "the common run of words"] * 2
    items = [*strings(rng, 40, 9), None, "", "", "日", "common run of", "a b", "nowhere in any text at all"]
    t = spark.createDataFrame(list(enumerate(texts)), "t long, text string").repartition(3)
    i = spark.createDataFrame(list(enumerate(items)), "i long, item string").repartition(2)
    got = joins.containing(t, i, "text", "item", run, part_bytes)
    want = sorted((a, b) for a, x in enumerate(texts) for b, y in enumerate(items) if x is not None and y is not None and y in x)
    assert sorted((r.t, r.i) for r in got.collect()) == want and got.columns == ["t", "text", "i", "item"]
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.containing(t.limit(0), i, "text", "item", run).count() == 0 and joins.containing(t, i.limit(0), "text", "item", run).count() == 0


def exact(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low = values[int(at)]
    return low + (values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at)) if values else None


def test_percentiles_with_ties(spark):
    rng = random.Random(1)
    groups = {"all alike": [7.0] * 3000, "few": [1.0, 2.0], "one": [5.0], "mixed": [rng.choice([0.0, 1.0, rng.random()]) for _ in range(2000)], "spread": [rng.gauss(0, 9) for _ in range(1500)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("mixed", None), ("empty", None)], "g string, v double").repartition(4)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in percentiles(df, "g", "v", shares, "longest").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].longest == max(vs) and all(abs(got[g][k] - exact(vs, p)) < 1e-9 for k, p in shares.items())


def test_values_that_are_alike_are_ranked_as_one(spark):
    """Rows of one value meet as counts: what is put in order grows with the values, not the rows."""
    df = spark.range(50_000).select(F.lit("g").alias("g"), (F.col("id") % 3).cast("double").alias("v")).repartition(4)
    out = percentiles(df, "g", "v", {"p50": 0.5}, "longest")
    assert out.first().p50 == 1.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") > 0 and "row_number" not in plan


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) ** 3 for _ in range(40_000)]
    df = spark.createDataFrame([(k % 20, "g", v) for k, v in enumerate(values)] + [(0, "n", None)], "batch long, g string, v double").repartition(8)
    parts = sketches.sketched(df, ["batch", "g"], "v")
    shares = {f"q{k}": k / 20 for k in range(1, 20)}
    got = {r.g: r for r in sketches.quantiles(sketches.merged(parts, ["g"]), ["g"], shares).collect()}
    assert got["g"].n == len(values) and got["n"].n == 0 and got["n"].q10 is None
    for k, p in shares.items():
        below, up_to = (sum(f(v, got["g"][k]) for v in values) / len(values) for f in (float.__lt__, float.__le__))
        assert below - sketches.RANK_ERROR <= p <= up_to + sketches.RANK_ERROR
    few = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", 2.0)], "g string, v double")
    assert sketches.quantiles(sketches.sketched(few, ["g"], "v"), ["g"], {"m": 0.5}).first().m == 2.0


def test_leaks_in_one_pass(spark):
    held = spark.createDataFrame([(1, "h1", 5), (2, "h2", None), (3, None, 7), (3, None, 7)], "id int, hash string, source int")
    others = {"train": spark.createDataFrame([("h1", 7), ("h1", 7), (None, None)], "hash string, source int"), "validation": spark.createDataFrame([("h1", 5), ("h2", 9)], "hash string, source int")}
    found = rules.leaks(held, others, ["hash", "source"], "id")
    want = [(1, "train", "hash"), (1, "validation", "hash"), (1, "validation", "source"), (2, "validation", "hash"), (3, "train", "source"), (3, "train", "source")]
    assert sorted(map(tuple, found.collect())) == want
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1
