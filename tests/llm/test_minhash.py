"""The multi-index Hamming join: its guarantee, and groups against all pairs."""

import random
import re

import numpy as np
import pandas as pd

from textloom.llm import minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)


def plain_groups(rows):
    """The component of each row, by all pairs of distinct sets."""
    sets = sorted({shingles(t) for _, t in rows} - {frozenset()}, key=repr)
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                links += 1
                root[find(i)] = find(j)
    group = {s: find(k) for k, s in enumerate(sets)}
    ids = {}
    for i, t in rows:
        if shingles(t):
            ids.setdefault(group[shingles(t)], []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [(i, len(shingles(t)), least[group[shingles(t)]] if shingles(t) else i) for i, t in rows], links


def changed(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return words


def families(rng):
    """Copies around bases, chains of copies, families of two bases that share much and aren't linked, and strangers."""
    rows = []
    for size in (3, 12, 60):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        rows += [" ".join(changed(rng, base, rng.randrange(0, 9))) for _ in range(size)]
        chain = base = [f"w{rng.randrange(4000)}" for _ in range(90)]
        for _ in range(12):
            chain = changed(rng, chain, 4)
            rows.append(" ".join(chain))
        other = changed(rng, base, 14)
        rows += [" ".join(changed(rng, rng.choice([base, other]), rng.randrange(0, 5))) for _ in range(size)]
    return rows + [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))) for _ in range(150)]


def test_every_pair_within_the_threshold_shares_a_key(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        a = rng.integers(0, 1 << 16, minhash.POSITIONS).astype("<u2")
        b = a.copy()
        b[rng.permutation(minhash.POSITIONS)[: minhash.THRESHOLD]] ^= np.uint16(1 + k)
        rows += [(f"{k}a".encode(), a.tobytes()), (f"{k}b".encode(), b.tobytes())]
    got = minhash.keys(spark.createDataFrame(rows, "v binary, signature binary")).toPandas()
    assert len(got) == len(rows) * minhash.POSITIONS
    shared = got.groupby(["slot", "key"])["v"].agg(lambda s: {bytes(v)[:-1] for v in s} if len(s) > 1 else set())
    assert set().union(*shared) == {str(k).encode() for k in range(200)}


def test_groups_equal_all_pairs(spark):
    rng = random.Random(7)
    texts = families(rng)
    rng.shuffle(texts)
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    rows += [(i, t.upper()) for i, t in rows[:40]]  # rows of one id, equal sets
    rows += [(1, None), (2, ""), (3, " \t"), (4, "Word"), (5, "word\x0b"), (6, "word word"), (None, "word"), (None, None), (7, "k a b c d e f g h i k a"), (8, "k a b c d e f g h i k z")]
    want, links = plain_groups(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, v string, n long").repartition(5)
    for how in ({}, {"block_rows": 3}):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(docs, **how).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert links > 500
    assert minhash.near_groups(docs.limit(0)).count() == 0


def test_apart_vertices_of_a_bucket_are_compared(spark):
    """One bucket of two families and a stranger, whose centre is the stranger: no star has a link."""
    rng = random.Random(9)
    a, b = ([f"{c}{k}" for k in range(100)] for c in "ab")
    texts = [" ".join(changed(rng, w, 3)) for w in (a, a, a, b, b, b)] + ["some stranger"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = minhash.with_signatures(docs).toPandas().set_index("doc_id")
    vs = prints["v"].map(bytes)
    members = spark.createDataFrame(pd.DataFrame({"slot": 0, "key": 5, "v": vs, "n": len(texts)}), "slot int, key long, v binary, n long")
    sets = minhash.with_sets(docs, members.select("v")).cache()
    none = spark.createDataFrame([], "v binary, label binary")
    for rows in (2, 3, 256):
        near = minhash.near_labels(members, none, sets, rows)
        labels = minhash.joined_labels(none, minhash.links_in_clusters(near, none, sets, rows))
        got = {bytes(r.v): bytes(r.label) for r in labels.collect()}
        assert {frozenset(i for i in range(7) if got.get(vs[i]) == x) for x in set(got.values())} == {frozenset({0, 1, 2}), frozenset({3, 4, 5})}
    # with one family as a component, its members aren't compared with each other, the others with all
    known = spark.createDataFrame([(v, vs[0]) for v in vs[:3]], "v binary, label binary")
    near = minhash.near_labels(members, known, sets, 2)
    links = {frozenset((bytes(r.a), bytes(r.b))) for r in minhash.links_in_clusters(near, known, sets, 2).collect()}
    assert links and all(not pair & set(vs[:3]) for pair in links)
