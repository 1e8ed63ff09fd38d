"""Scans, searches, greedy chains and interval joins whose keys no single task holds, against plain walks."""

import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from textloom.operators import joins, scans
from textloom.operators import ordered as O  # noqa: E741


def test_scan_runs_on_across_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None, "b"]), i, rng.choice([None, rng.randrange(9)]), rng.choice([None, f"v{i}"])) for i in range(300)]
    rows += [("hot", i, 1, None if i % 50 else f"h{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i long, x long, s string").repartition(5)
    got = scans.scanned(df, ["k"], ["i"], sums={"total": "x"}, lasts={"seen": "s"}, ranges=7)
    want, state = [], {}
    for k, i, x, s in sorted(rows, key=lambda r: r[1]):
        total, seen = state.get(k, (0, None))
        state[k] = (total + (x or 0), s or seen)
        want.append((k, i, x, s, *state[k]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    # the hot key lies in several ranges, none of which has much more than its share
    shares = [r[0] for r in df.repartitionByRange(7, "k", "i").where("k = 'hot'").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(shares) >= 4 and max(shares) < 400
    assert scans.scanned(df.limit(0), ["k"], ["i"], sums={"total": "x"}).count() == 0


def test_search(spark):
    rng = random.Random(2)
    rows, want = [], []
    for k in range(4):
        values = sorted(rng.randrange(50) for _ in range(60))
        for n, v in enumerate(values):
            w = rng.randrange(-3, 55)
            rows.append((k, n, v, w))
            first = bisect_left(values, w)
            want.append((k, n, first if first < len(values) else None))
    df = spark.createDataFrame(rows, "k long, n long, v long, w long").repartition(4)
    assert sorted(map(tuple, scans.first_from(df, ["k"], "n", "v", "w", "found").collect())) == sorted(want)


def test_chain_of_a_thousand_links_takes_logarithmic_rounds(spark, monkeypatch):
    links = [("k", n, n + 1 if n % 3 else n + 2) for n in range(1000)] + [("k", 1000, None), ("k", 1001, None), ("j", 5, None), (None, 1, 4), (None, 4, None)]
    reached, n, follow = set(), 0, {n: t for k, n, t in links if k == "k"}
    while n is not None:
        reached.add(n)
        n = follow[n]
    written, real = [], scans.stored
    monkeypatch.setattr(scans, "stored", lambda df, name: written.append(name) or real(df, name))
    got = {(r[0], r[1]) for r in scans.chain_starts(spark.createDataFrame(links, "k string, n long, t long"), ["k"], "n", "t").collect()}
    assert got == {("k", n) for n in reached} | {("j", 5), (None, 1), (None, 4)}
    assert written.count("jumps") <= 11 and written.count("marked") <= 11


@pytest.mark.parametrize("key_rows", [0, 120, 1 << 20])
def test_greedy_blocks_of_one_key(spark, key_rows):
    """All keys chained, the large ones, none: as folded says."""
    rng = random.Random(3)
    rows = []
    for k, n in (("hot", 400), ("b", 100), (None, 40)):
        at = 0
        for i in range(n):
            at += rng.choice([0, 1, 3, 30])
            rows.append((k, at, i, rng.choice([0, 5, 40, 300])))
    df = spark.createDataFrame(rows, "k string, at long, i long, size long").repartition(4)
    got = O.greedy_blocks(df, ["k"], ["at", "i"], 20, 200, 60, key_rows=key_rows)
    step, want = O.block_of(20, 200, 60), []
    folded = O.folded(df.withColumn("seconds", F.col("at")), ["k"], ["at", "i"], step, None, "block int").drop("seconds")
    want = sorted(map(tuple, folded.collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and max(r[-1] for r in want) > 50
    assert O.greedy_blocks(df.limit(0), ["k"], ["at", "i"], 20, 200, 60, key_rows=key_rows).count() == 0


@pytest.mark.parametrize("key_rows", [0, 120])
def test_disjoint_intervals_of_one_key(spark, key_rows):
    rng = random.Random(4)
    rows = [(k, s, s + rng.choice([0, 1, 5, 40, -2]), i) for k, n in (("hot", 300), ("b", 60)) for i, s in enumerate(sorted(rng.randrange(500) for _ in range(n)))]
    df = spark.createDataFrame(rows, "k string, start long, end long, i long").repartition(4)
    got = sorted(map(tuple, O.disjoint(df, ["k"], ["start", "i"], key_rows=key_rows).collect()))
    assert got == sorted(map(tuple, O.folded(df, ["k"], ["start", "i"], O.kept_disjoint, None, "kept boolean").collect()))


def test_dyadic_covers(spark):
    """Covers are disjoint, exact at grain 0 and just beyond the ends at others, and logarithmic."""
    rng = random.Random(5)
    spans = [(s, s + n) for s, n in ((rng.randrange(-(10**6), 10**15), rng.choice([1, 2, 3, 17, 1000, 10**6, 10**12])) for _ in range(150))]
    spans += [(0, 1), (-1, 1), (-8, 8), (7, 8), (3, 5), (-(10**9), 10**9)]
    df = spark.createDataFrame(spans, "s long, e long")
    for grain in (0, 3, 20):
        for s, e, nodes in df.select("s", "e", joins.dyadic_cover(F.col("s"), F.col("e"), F.lit(grain))).collect():
            parts = sorted((n.node << n.level, (n.node + 1) << n.level) for n in nodes)
            assert all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
            low, high = parts[0][0], parts[-1][1]
            assert low <= s and e <= high and s - low < 1 << grain and high - e < 1 << grain
            assert len(parts) <= 2 * ((e - s) >> grain).bit_length() + 2


@pytest.mark.parametrize("grain", [None, 0, 6])
def test_interval_joins(spark, grain):
    rng = random.Random(6)
    key = lambda: rng.choice(["hot", "hot", "a", None])
    points = [(key(), rng.choice([None, rng.randrange(-500, 10_000)]), i) for i in range(200)]
    spans = [(key(), s, s + rng.choice([0, 1, 7, 100, 5000, -4]), i) for i, s in enumerate(rng.randrange(-500, 10_000) for _ in range(150))] + [("hot", None, 5, 900), ("a", 5, None, 901)]
    p, iv = spark.createDataFrame(points, "k string, at long, i long"), spark.createDataFrame(spans, "k string, s long, e long, j long")
    got = joins.points_in_intervals(p, iv, ["k"], "at", "s", "e", grain)
    want = sorted((i, j) for k, at, i in points for q, s, e, j in spans if k is not None and k == q and None not in (at, s, e) and s <= at < e)
    assert sorted((r.i, r.j) for r in got.collect()) == want and len(want) > 300
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    if grain is None:
        other = iv.select("k", F.col("s").alias("t"), F.col("e").alias("f"), F.col("j").alias("m"))
        pairs = joins.overlapping_pairs(iv, other, ["k"], ("s", "e"), ("t", "f"))
        real = [x for x in spans if None not in x and x[1] < x[2]]
        assert sorted((r.j, r.m) for r in pairs.collect()) == sorted((x[3], y[3]) for x in real for y in real if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
        assert joins.points_in_intervals(p, iv.limit(0), ["k"], "at", "s", "e").count() == 0
