"""Near copies against the Jaccard similarity of all pairs."""

import glob
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import graph, near_copies, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in pairs:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}, pairs


def brute_by_shingle(texts):
    """The same as brute, over the pairs that share a shingle."""
    sets, holders = {i: shingles(t) for i, t in texts.items()}, {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}, pairs


def made(seed=1):
    """Groups of copies with words replaced, from well above 0.8 to well below."""
    rng, texts = random.Random(seed), {}
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(10):
            share = rng.choice([0.005, 0.01, 0.02, 0.03])
            texts[len(texts)] = " ".join(w if rng.random() > share else f"x{rng.randrange(4000)}" for w in base)
    return texts | {900: "", 901: " ", 902: "one two", 903: "one  Two"}


def held_against(texts, got):
    """Share of the near pairs that got (id -> root) joins; got may join nothing that pairs of near copies don't."""
    want, pairs = brute(texts)
    assert all(want[i] == want[r] for i, r in got.items())
    return sum(got.get(a, a) == got.get(b, b) for a, b in pairs) / len(pairs), len(pairs)


def test_all_pairs(spark):
    texts = made()
    docs = spark.createDataFrame([*texts.items(), (None, "one two")], "doc_id long, text string")
    for rows in (256, 4):
        got = {r.v: r.root for r in near_copies.near_components(docs, rows).collect()}
        share, n = held_against(texts, got)
        assert n > 200 and share >= 0.95 and got[903] == 902


def test_candidate_prints_follow_the_words(spark):
    rng = random.Random(4)
    texts = {i: " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(12))) for i in range(60)}
    rows = [(2 * i, t) for i, t in texts.items()] + [(2 * i + 1, t.upper().replace(" ", "\t ")) for i, t in texts.items()]
    got = {}
    for r in near_copies.with_prints(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect():
        got.setdefault(r.doc_id, []).append((r.space, r.fp, r.check))
    assert {i // 2 for i in got} == {i for i, t in texts.items() if t}
    assert all(got[i] == got[i + 1] and len(got[i]) == near_copies.SPACES for i in got if i % 2 == 0)


def test_majority():
    rng = np.random.default_rng(3)
    codes, weights = rng.integers(0, 1 << 63, 7000, dtype=np.uint64) * np.uint64(2), rng.integers(1, 58, 7000).astype(np.uint8)
    codes[:3000] |= np.uint64(5)
    begin = np.array([0, 1, 3000, 3001, 5900])
    for k, (i, j) in enumerate(zip(begin, [*begin[1:], 7000], strict=True)):
        total = weights[i:j].astype(int).sum()
        want = sum(1 << b for b in range(64) if 2 * weights[i:j][(codes[i:j] >> np.uint64(b)) & np.uint64(1) > 0].astype(int).sum() > total)
        assert int(simhash.majority(codes, weights, begin)[k]) == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_stage_against_all_pairs(spark, sf):
    """Recall and false removals of the whole stage, over distinct texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["text"])
    docs = near_copies.saved(docs, "test-distinct")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want, pairs = brute_by_shingle(texts)
    roots = {r.v: r.root for r in near_copies.near_components(docs).collect()}
    assert all(want[i] == want[r] for i, r in roots.items())
    joined = sum(roots.get(a, a) == roots.get(b, b) for a, b in pairs)
    assert joined >= 0.9 * len(pairs)
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).select("doc_id").collect()}
    assert got == {i for i in texts if roots.get(i, i) == i}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_contracted_links_join_the_same(spark, kind):
    rng = random.Random(6)
    links = [(rng.randrange(6) + 100 * g, rng.randrange(20, 99) + 100 * g) for g in range(5) for _ in range(300)]
    df = spark.createDataFrame(links, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))
    got = near_copies.contracted(df)
    assert got.count() < 0.8 * len(set(links)) and not got.where("a = b").count()
    assert {tuple(r) for r in graph.components(got).collect()} == {tuple(r) for r in graph.components(df).collect()}
    assert near_copies.contracted(df.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "leaf", "blocks"), [(2, simhash.LEAF_ROWS, None), (2, 3, 1), (2, 2, 21), (3, 4, 7), (0, 2, 2)])
def test_groups_link_as_all_pairs_do(spark, radius, leaf, blocks):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 2))) for f in fps for _ in range(4)]
    rows = sorted({(s, f, rng.getrandbits(3)) for s in (0, 1) for f in fps})
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    prints = spark.createDataFrame([(s, signed(f), c, v) for v, (s, f, c) in enumerate(rows)], "space int, fp long, check long, v long")
    near = [(i, j) for j, (s, f, c) in enumerate(rows) for i, (t, g, d) in enumerate(rows[:j]) if s == t and (f ^ g).bit_count() <= radius and (c ^ d).bit_count() <= 1]
    want = {tuple(r) for r in graph.components(spark.createDataFrame(near or [(0, 0)], "a long, b long")).collect()}
    got = simhash.grouped_links(prints, radius, 1, leaf, blocks)
    assert {tuple(r) for r in graph.components(got).collect()} == want


def test_prints_go_to_as_many_shards_whatever_their_number(spark):
    """Before, a print visited 21 shards of four blocks on the average and 73 of eight, which large inputs need."""
    few = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    sizes = [simhash.group_blocks(few, n, 2) for n in (100, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[-1] > 4
    prints = spark.createDataFrame([(0, int(f), 0, k) for k, f in enumerate(few.tolist())], "space int, fp long, check long, v long")
    assert {simhash._in_groups(prints, 5, b, 2).count() for b in sizes} == {3 * len(few)}


def test_saved_rows_leave_no_shuffle_files(spark):
    place = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in place for p in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    got = near_copies.saved(spark.range(50_000).groupBy((F.col("id") % 9000).alias("k")).count(), "test-cleanup")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert got.count() == 9000 and not left
