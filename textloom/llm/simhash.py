"""SimHash near-duplicates through vantage-point trees.

Fingerprints of 64 bits come from word shingles hashed with XXH64. A vantage point is chosen
from a sample of them, the one with the widest spread of distances. Distinct fingerprints
are partitioned by their Hamming distances to it, taken over disjoint blocks
of bits: the tuple of those distances is a path down the tree, its end a shard. The triangle
inequality holds for each block and, as blocks are disjoint, for their sum, so two fingerprints
within the radius lie in shards whose distances differ by no more than the radius in all.
Each fingerprint visits the shards within that reach, and no others.

The tree is as deep as the data need: the first depth is chosen by the number of fingerprints and the
sample's shares of shards, and shards that are still over ``leaf_rows`` go down another level, with every block halved. At the
last level a block is one bit and a shard one fingerprint, so the descent ends; nothing is dealt
out as a grid of pairs. Inside a shard a tree over finer blocks prunes branches by the same bounds
and leaves are compared exactly. A shard hands on a spanning forest of its links, never
all pairs; components follow from ``graph``.

Defined cases: null text counts as empty; a text without words has fingerprint zero, which
links like any other; fewer words than a shingle make one shingle; null ids never name
a component unless all ids in it are null; repeated rows share a fingerprint; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import drop_saved, saved, table, text_blocks
from textloom.llm.graph import components

SEED = 42
#: Blocks of bits at each depth of the shards, and for the trees inside them.
DEPTHS, INNER_BLOCKS = (2, 4, 8, 16, 32, 64), 8
#: Rows of a shard above which it goes down a level, and comparisons of a leaf inside it.
LEAF_ROWS, LEAF = 20_000, 1 << 16
#: Distinct fingerprints that the vantage point and the first depth are chosen from, and candidates for it.
SAMPLE_ROWS, CANDIDATES = 20_000, 64
#: Blocks of each group of bits (``grouped_links``), and rows that the shard of a random row should hold at most.
GROUP_BLOCKS, GROUP_ROWS = (1, 2, 4, 7, 11, 21), 1_000


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    parts = text.lower().split()
    if len(parts) <= words:
        grams = [b" ".join(parts)] if parts else []
    else:
        grams = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)


#: Sixteen bits as sixteen numbers of two bytes, four to a word: four words' worth of counts are added at once.
_LANES = np.ascontiguousarray(np.unpackbits(np.arange(1 << 16, dtype="<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little").astype("<u2")).view("<u8")
#: Codes that are counted before the two bytes could run over; weights are 57 at most.
_LANE_CODES = 1024


def majority(codes: np.ndarray, weights: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A word for each run of codes from begin on: its bits are set where codes of over half the weight (57 each at most) have them."""
    size = np.diff(np.append(begin, len(codes)))
    parts = -(-size // _LANE_CODES)
    place = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.repeat(begin, parts) + place * _LANE_CODES
    short, heavy, counts = codes.view("<u2"), weights.astype(np.uint64)[:, None], np.empty((len(cuts), 16), np.uint64)
    ends, at = np.append(cuts[1:], len(codes)), 0
    while at < len(cuts):  # a piece at a time that stays in the cache
        to = max(at + 1, int(np.searchsorted(ends, cuts[at] + 4 * _LANE_CODES, "right")))
        i, j = int(cuts[at]), int(ends[to - 1])
        lanes = np.take(_LANES, short[4 * i : 4 * j], axis=0).reshape(j - i, 16)
        lanes *= heavy[i:j]
        counts[at:to] = np.add.reduceat(lanes, cuts[at:to] - i, axis=0)
        at = to
    have = np.add.reduceat(counts.view("<u2").astype(np.uint32), np.cumsum(parts) - parts, axis=0).astype(np.int64)
    whole = np.add.reduceat(weights.astype(np.int64), begin)
    return np.packbits(2 * have > whole[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array of hashes: a bit is set if over half of them have it; of no hashes zero."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        joined = np.concatenate([hashes[i] for i in full])
        out[full] = majority(joined, np.ones(len(joined), np.uint8), np.cumsum(sizes[full]) - sizes[full])
    return out


def with_fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of whole texts."""

    def run(batches):
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, raw, off in text_blocks(b.column("text")):
                data = raw.tobytes()
                found.append(fingerprints([shingle_hashes(data[i:j], words) for i, j in zip(off[:-1], off[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _masks(blocks: int) -> list[int]:
    """Disjoint blocks of bits that cover all 64; where they don't come out even, the last is longer."""
    size = 64 // blocks
    return [((1 << (size if k < blocks - 1 else 64 - size * k)) - 1) << (size * k) for k in range(blocks)]


class Forest:
    """Labels of the rows of a shard; rows with one label are linked."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        p, q = self.label[a], self.label[b]
        apart = p != q
        if not apart.any():
            return
        pairs = np.unique(np.column_stack([np.minimum(p, q)[apart], np.maximum(p, q)[apart]]), axis=0)
        parent = np.arange(len(self.label))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in pairs:
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        for x in np.unique(pairs):
            parent[x] = root(x)
        self.label = parent[self.label]


def link_within(fp: np.ndarray, rows: np.ndarray, cols: np.ndarray, radius: int, forest: Forest, level: int = 0, slack: int | None = None, check: np.ndarray | None = None, check_radius: int = 64) -> None:
    """Unite rows and cols (places in fp) that differ in radius bits at most, by a vantage-point tree over blocks of bits.

    check: second fingerprints, which must differ in check_radius bits at most. slack: what the blocks seen so far leave of the radius.
    """
    if not len(rows) or not len(cols):
        return
    slack = radius if slack is None else slack
    if len(rows) * len(cols) <= LEAF or level == INNER_BLOCKS:
        step = max(1, (1 << 18) // len(cols))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[cols][None, :]) <= radius)
            if check is not None:
                near = np.bitwise_count(check[part[i]] ^ check[cols[j]]) <= check_radius
                i, j = i[near], j[near]
            forest.unite(part[i], cols[j])
        return
    mask, vantage = np.uint64(_masks(INNER_BLOCKS)[level]), fp[rows[0]]
    far_rows, far_cols = np.bitwise_count((fp[rows] ^ vantage) & mask), np.bitwise_count((fp[cols] ^ vantage) & mask)
    for d in np.unique(far_rows):
        mine = rows[far_rows == d]
        for e in range(max(0, int(d) - slack), int(d) + slack + 1):
            theirs = cols[far_cols == e]
            link_within(fp, mine, theirs, radius, forest, level + 1, slack - abs(int(d) - e), check, check_radius)


def choose_vantage(sample: np.ndarray) -> int:
    """Of the sample's first words the one whose distances to the sample spread the most over the coarsest blocks; zero without a sample."""
    if not len(sample):
        return 0
    spread = lambda v: sum(float(np.var(np.bitwise_count((sample ^ v) & np.uint64(m)))) for m in _masks(DEPTHS[0]))
    return int(max(sample[:CANDIDATES], key=lambda v: (spread(v), -int(v))))


def distances(x: np.ndarray, blocks: int) -> np.ndarray:
    """A row for each word: its distance from the vantage point (x: the words with that taken away) in each block."""
    return np.column_stack([np.bitwise_count(x & np.uint64(m)) for m in _masks(blocks)]).astype(np.int64)


def path_of(far: np.ndarray, blocks: int) -> np.ndarray:
    """The distances as one number; with one bit a block the number wraps to the word itself."""
    path = np.zeros(len(far), np.uint64)
    for k in range(blocks):
        path = path * np.uint64(64 // blocks + (blocks < 64)) + far[:, k].astype(np.uint64) if blocks < 64 else path | (far[:, k].astype(np.uint64) << np.uint64(k))
    return path


@cache
def moves(blocks: int, radius: int) -> np.ndarray:
    """All changes of distances, a row each, that two words within the radius can show: radius in all at most."""
    found = {(0,) * blocks}
    edge = set(found)
    for _ in range(radius):
        edge = {(*m[:k], m[k] + d, *m[k + 1 :]) for m in edge for k in range(blocks) for d in (-1, 1)}
        edge = {m for m in edge if sum(map(abs, m)) <= radius}
        found |= edge
    return np.array(sorted(found), np.int64).reshape(-1, blocks)


@cache
def finer_moves(blocks: int, radius: int) -> dict[tuple[int, ...], np.ndarray]:
    """The moves over blocks by what they come to over half as many."""
    out: dict[tuple[int, ...], list[np.ndarray]] = {}
    for m in moves(blocks, radius):
        out.setdefault(tuple(int(v) for v in m.reshape(-1, 2).sum(1)), []).append(m)
    return {k: np.array(v) for k, v in out.items()}


def reached(x: np.ndarray, blocks: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, whether it is the row's home) of every shard that a row lies in or has to visit; of two shards the later is visited."""
    far, most = distances(x, blocks), 64 // blocks
    home = path_of(far, blocks)
    rows, shards = [np.arange(len(x))], [home]
    for m in moves(blocks, radius):
        to = far + m
        inside = np.flatnonzero(((to >= 0) & (to <= most)).all(1)) if m.any() else np.zeros(0, np.int64)
        path = path_of(to[inside], blocks)
        later = path > home[inside]
        rows.append(inside[later])
        shards.append(path[later])
    row, shard = np.concatenate(rows), np.concatenate(shards)
    return row, shard, np.arange(len(row)) < len(x)


def reached_below(x: np.ndarray, shard: np.ndarray, blocks: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for rows that are in, or visit, a shard over half as many blocks, inside that shard."""
    far, most, coarse = distances(x, blocks), 64 // blocks, blocks // 2
    width, rest = np.uint64(64 // coarse + 1), shard.copy()
    change = np.zeros((len(x), coarse), np.int64)
    for k in range(coarse - 1, -1, -1):
        change[:, k] = (rest % width).astype(np.int64) - far[:, 2 * k] - far[:, 2 * k + 1]
        rest //= width
    kinds, which = np.unique(change, axis=0, return_inverse=True)
    rows, shards, own = [], [], []
    for k, kind in enumerate(kinds):
        mine = np.flatnonzero(which.ravel() == k)
        for m in finer_moves(blocks, radius).get(tuple(int(v) for v in kind), ()):
            to = far[mine] + m
            inside = ((to >= 0) & (to <= most)).all(1)
            rows.append(mine[inside])
            shards.append(path_of(to[inside], blocks))
            own.append(np.full(int(inside.sum()), not m.any()))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(own)


def _dealt(rows: DataFrame, vantage: int, blocks: int, radius: int, below: bool) -> DataFrame:
    kind = dict(rows.dtypes)["v"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1 << 13):
                part = b.slice(at, 1 << 13)
                x = part.column("fp").to_numpy().view(np.uint64) ^ np.uint64(vantage)
                row, shard, own = reached_below(x, part.column("shard").to_numpy().view(np.uint64), blocks, radius) if below else reached(x, blocks, radius)
                take = lambda c: part.column(c).take(pa.array(row))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([take("space"), pa.array(shard.view(np.int64)), pa.array(own), take("fp"), take("check"), take("v")], ["space", "shard", "own", "fp", "check", "v"])

    return rows.mapInArrow(run, f"space int, shard long, own boolean, fp long, check long, v {kind}")


def first_depth(sample: np.ndarray, n: int, radius: int, leaf_rows: int) -> int:
    """The first depth at which the shard of a random one of n rows is expected to hold a leaf's rows at most, visitors included."""
    for k, blocks in enumerate(DEPTHS[:-1]):
        _, size = np.unique(path_of(distances(sample, blocks), blocks), return_counts=True)
        share = float((size * (size - 1)).sum()) / max(1, len(sample) * (len(sample) - 1))
        if n * share * (len(moves(blocks, radius)) + 1) / 2 <= leaf_rows:
            return k
    return len(DEPTHS) - 2


def sampled(prints: DataFrame) -> np.ndarray:
    """Fingerprints of prints (space, fp, check) that hashes choose: SAMPLE_ROWS rows of 8 bytes at most."""
    rows = prints.orderBy(F.xxhash64("space", "fp", "check"), "space", "fp", "check").select("fp").limit(SAMPLE_ROWS)
    return rows.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)


def most_of_a_space(prints: DataFrame) -> int:
    return prints.groupBy("space").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def group_masks(radius: int, blocks: int) -> list[list[int]]:
    """The bits in radius + 1 disjoint groups, each in blocks (of a bit at least)."""
    edges = [g * 64 // (radius + 1) for g in range(radius + 2)]
    cuts = [[a + (b - a) * k // min(blocks, b - a) for k in range(min(blocks, b - a) + 1)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [[((1 << (hi - lo)) - 1) << lo for lo, hi in zip(c[:-1], c[1:], strict=True)] for c in cuts]


def group_blocks(sample: np.ndarray, n: int, radius: int, rows: int = GROUP_ROWS) -> int:
    """The fewest blocks at which the shard of a random one of n rows is expected to hold so many rows at most, in every group."""
    for blocks in GROUP_BLOCKS[:-1]:
        pairs = 0
        for masks in group_masks(radius, blocks):
            far = np.column_stack([np.bitwise_count(sample & np.uint64(m)) for m in masks])
            _, size = np.unique(far, axis=0, return_counts=True)
            pairs = max(pairs, int((size * (size - 1)).sum()))
        if n * pairs / max(1, len(sample) * (len(sample) - 1)) <= rows:
            return blocks
    return GROUP_BLOCKS[-1]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _in_groups(prints: DataFrame, vantage: int, blocks: int, radius: int) -> DataFrame:
    """A row for each print and group: the shard is the path of its distances from the vantage point over the group's blocks."""
    shards = []
    for masks in group_masks(radius, blocks):
        path = F.lit(0).cast("long")
        for m in masks:
            path = path * (m.bit_count() + 1) + F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(vantage))).bitwiseAND(F.lit(_signed(m))))
        shards.append(path)
    return prints.select("space", F.posexplode(F.array(*shards)).alias("group", "shard"), F.lit(True).alias("own"), "fp", "check", "v")


def grouped_links(prints: DataFrame, radius: int, check_radius: int | None = None, leaf_rows: int = LEAF_ROWS, blocks: int | None = None) -> DataFrame:
    """What ``vantage_links`` links, with radius + 1 rows a print at any number of prints, as no print visits another's shard.

    The bits make radius + 1 groups. Distances within the radius leave a group without any difference, and there both prints have the same
    distances from the vantage point in all blocks: they share that group's shard. A shard is joined exactly; what lies in shards of
    over leaf_rows rows goes through ``vantage_links``.
    """
    sample = sampled(prints)
    vantage = choose_vantage(sample)
    if blocks is None:
        blocks = group_blocks(sample ^ np.uint64(vantage), most_of_a_space(prints), radius)
    keys, names = ["space", "group", "shard"], ["space", "fp", "check", "v"]
    rows = _in_groups(prints, vantage, blocks, radius)
    large = saved(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows).select(*keys), "large-shards")
    if large.isEmpty():
        return saved(shard_links(rows, radius, check_radius, keys).distinct(), "fingerprint-links")
    found = saved(shard_links(rows.join(large, keys, "left_anti"), radius, check_radius, keys).distinct(), "shard-links")
    rest = saved(rows.join(large, keys, "left_semi").select(*names).distinct(), "large-rows")
    more = vantage_links(rest, radius, check_radius, leaf_rows)
    drop_saved(rest)
    return saved(found.unionByName(more).distinct(), "fingerprint-links")


def vantage_links(prints: DataFrame, radius: int, check_radius: int | None = None, leaf_rows: int = LEAF_ROWS, depth: int | None = None) -> DataFrame:
    """Links (a, b) of the vertices v of distinct prints (space, fp, check, v): those joined by links within the radius in some space, and no others.

    Each shard joins what it links to the least vertex of them, so that shards and spaces tell the same links.
    """
    sample = sampled(prints)
    vantage = choose_vantage(sample)
    if depth is None:
        depth = first_depth(sample ^ np.uint64(vantage), most_of_a_space(prints), radius, leaf_rows)
    names = ["space", "fp", "check", "v"]
    rows, found = saved(_dealt(prints.select(*names), vantage, DEPTHS[depth], radius, False), "shard-rows"), []
    while True:
        last = depth == len(DEPTHS) - 1
        sizes = rows.groupBy("space", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows).select("space", "shard")
        large = None if last else saved(sizes, "large-shards")
        if large is None or large.isEmpty():
            found.append(saved(shard_links(rows, radius, check_radius).distinct(), "shard-links"))
            drop_saved(rows)
            break
        found.append(saved(shard_links(rows.join(large, ["space", "shard"], "left_anti"), radius, check_radius).distinct(), "shard-links"))
        depth += 1
        above, rows = rows, _dealt(rows.join(large, ["space", "shard"], "left_semi").select(*names[:1], "shard", *names[1:]), vantage, DEPTHS[depth], radius, True)
        rows = saved(rows, "shard-rows")
        drop_saved(above)
    return saved(reduce(DataFrame.unionByName, found).distinct(), "fingerprint-links")


def shard_links(rows: DataFrame, radius: int, check_radius: int | None = None, keys: Sequence[str] = ("space", "shard")) -> DataFrame:
    """Links (a, b) of vertices: for each shard (of one value of keys), every vertex that its exact links join to others, with the least of them."""
    kind = dict(rows.dtypes)["v"]

    def solve(own: np.ndarray, fp: np.ndarray, check: np.ndarray, v: pa.Array):
        order = np.argsort(v.to_numpy(zero_copy_only=False), kind="stable")  # labels are the least places, so the least vertices
        own, fp, check = own[order], fp[order].view(np.uint64), check[order].view(np.uint64)
        forest = Forest(len(fp))
        how = {} if check_radius is None else {"check": check, "check_radius": check_radius}
        home, visitors = np.flatnonzero(own), np.flatnonzero(~own)
        if not len(home) or len(fp) < 2:
            return None
        link_within(fp, home, home, radius, forest, **how)
        link_within(fp, home, visitors, radius, forest, **how)
        linked = np.flatnonzero(forest.label != np.arange(len(fp)))
        return v.take(pa.array(order[linked])), v.take(pa.array(order[forest.label[linked]]))

    def run(batches):
        held: list[tuple] = []
        key = None

        def flush():
            own, fp, check = (np.concatenate([h[k] for h in held]) for k in range(3))
            found = solve(own, fp, check, pa.concat_arrays([h[3] for h in held]))
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([found[1], found[0]], ["a", "b"])

        for batch in batches:
            fp, check = (batch.column(c).to_numpy() for c in ("fp", "check"))
            own, names = batch.column("own").to_numpy(zero_copy_only=False), [batch.column(c).to_numpy() for c in keys]
            if not len(fp):
                continue
            new = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in names], axis=0))))
            for i, j in zip(new, np.append(new[1:], len(fp)), strict=True):
                this = tuple(x[i] for x in names)
                if held and this != key:
                    yield from flush()
                    held = []
                key = this
                held.append((own[i:j], fp[i:j], check[i:j], batch.column("v").slice(i, j - i)))
        if held:
            yield from flush()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {kind}, b {kind}").where("a <> b")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, leaf_rows: int = LEAF_ROWS, depth: int | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links of fingerprints) of every row of docs."""
    prints = saved(with_fingerprint(docs, words), "fingerprints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    links = vantage_links(distinct.select(F.lit(0).alias("space"), "fp", F.lit(0).cast("long").alias("check"), F.col("fp").alias("v")), radius, None, leaf_rows, depth)
    if links.isEmpty():
        return prints.join(distinct.withColumnRenamed("first_id", "component_id"), "fp").select("doc_id", "fp", "component_id")
    roots = components(links)
    named = roots.join(distinct.withColumnRenamed("fp", "v"), "v")
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "root").select(F.col("v").alias("fp"), "least_id")
    groups = saved(distinct.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "fingerprint-groups")
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
