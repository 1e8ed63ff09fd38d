"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's set holds its distinct two-word shingles. Texts of equal sets are one vertex. A vertex has a
signature of POSITIONS minimum hashes, of which BITS bits each are kept; two signatures' distance is the number of positions in
which they differ. Signatures are split into chunks of CHUNK positions. By the pigeonhole principle, two within THRESHOLD differ in one
position at most in some chunk, so each vertex has a key for each chunk and each position of it that may err: the other positions' bits, exactly
64. Every pair within THRESHOLD shares a key, whatever the data; a pair at similarity 0.8 is farther apart once in 350 times, and even then
shares no key only once in 40,000.

1. Vertices that share a key meet in its bucket. Of each bucket one vertex is the centre, the one whose
   buckets hold most others (a text that many copies derive from), and every other is compared with it: rows linear in the keys.
2. A link is a pair whose whole sets are similar enough, in whole numbers. Links make components.
3. Buckets of vertices in several components hold pairs not compared yet. Their rows get longer signatures
   (CHECK positions of a byte); by those, each bucket names which of its components come near each other, a forest of them and no pairs. Components that
   come near make clusters. In a cluster, all vertices outside its largest component are compared with all others, set by set, in
   blocks of BLOCK_ROWS that meet two by two, and a block tells a forest of links. Longer signatures refuse a similar pair once in 30,000 times.
   Buckets within one component, such as those of a large group of copies, are never opened, and the largest component isn't compared with itself.

Shingles and sets are known by hashes: 64 bits of a shingle (``words``), 128 of a set.

Defined cases: null text counts as empty; a text without words has an empty set and is linked with nothing; a
single word is a shingle; null ids never name a component unless all ids in it are null; rows of one id with different texts are
rows each, and linked only by their sets; repeated rows share a vertex; a row is kept where its id is its component's, so copies of that row are, too; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import drop_saved, saved, small_batches, table, text_blocks
from textloom.llm.graph import components
from textloom.llm.near_copies import part_links
from textloom.llm.words import LOWER, codes, mix, spans

#: The least similarity in hundredths.
LEAST = 80
#: Positions of a signature, their bits, positions of a chunk, and the distance within which no pair is missed.
POSITIONS, BITS, CHUNK = 40, 16, 5
THRESHOLD = 2 * (POSITIONS // CHUNK) - 1
#: Positions of the longer signature, and those in which a pair may differ: at a similarity of 0.8, 25.5 on average, with a deviation of 4.5.
CHECK, CHECK_THRESHOLD = 128, 44
#: Rows of a bucket, or of a cluster, that are compared as one block.
BLOCK_ROWS = 256
#: Bits of the table that tells vertices with a partner from the rest; its size is fixed.
WANTED_BITS = 1 << 26

_ODD = np.random.default_rng(11).integers(1, 1 << 63, POSITIONS + CHECK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIR, _ALONE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def block_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents with words, where each one's shingles begin, the sorted distinct shingles) of a block of texts."""
    low = LOWER[raw]
    first, length, doc = spans(low, off)
    if not len(doc):
        return doc, doc, np.zeros(0, np.uint64)
    word = codes(low, first, length)
    follows = np.append(doc[1:] == doc[:-1], False)
    alone = ~follows & ~np.concatenate(([False], follows[:-1]))
    shingle = mix(np.where(alone, word + _ALONE, mix(word + _PAIR) ^ np.append(word[1:], np.uint64(0))))
    real = follows | alone
    doc, shingle = doc[real], shingle[real]
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])))
    doc, shingle = doc[new], shingle[new]
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return doc[begin], begin, shingle


def minima(values: np.ndarray, begin: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The mixed minimum hashes of the sets that begin at begin, a row for each set and a column for each of odd."""
    return np.column_stack([mix(np.minimum.reduceat(values * k, begin)) for k in odd])


def vertex(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def with_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, v (the set's name; null for the empty set), n_shingles and signature of each row of docs."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    odd = _ODD[:POSITIONS]

    def run(batches):
        for b in batches:
            for at, end, raw, off in text_blocks(b.column("text")):
                own, begin, values = block_sets(raw, off)
                size, names, prints = np.zeros(end - at, np.int64), [None] * (end - at), [None] * (end - at)
                if len(own):
                    stop = np.append(begin[1:], len(values))
                    size[own] = stop - begin
                    low = minima(values, begin, odd).astype("<u2")
                    for k, d in enumerate(own):
                        names[d], prints[d] = vertex(values[begin[k] : stop[k]]), low[k].tobytes()
                arrays = [b.column("doc_id").slice(at, end - at), pa.array(names, pa.binary()), pa.array(size), pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "v", "n_shingles", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, v binary, n_shingles long, signature binary")


def keys(vertices: DataFrame) -> DataFrame:
    """slot, key and v: a key for each position that may err, the bits of the rest of its chunk."""
    slots = np.arange(POSITIONS, dtype=np.int32)
    others = np.array([[p for p in range(s - s % CHUNK, s - s % CHUNK + CHUNK) if p != s] for s in slots])

    def run(batches):
        for b in batches:
            n = len(b)
            if not n:
                continue
            prints = np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u2").reshape(n, POSITIONS).astype(np.uint64)
            key = np.zeros((n, POSITIONS), np.uint64)
            for k in range(CHUNK - 1):
                key |= prints[:, others[:, k]] << np.uint64(BITS * k)
            v = b.column("v").take(pa.array(np.repeat(np.arange(n), POSITIONS)))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(slots, n)), pa.array(key.ravel().view(np.int64)), v], ["slot", "key", "v"])

    return vertices.select("v", "signature").mapInArrow(run, "slot int, key long, v binary")


def _bit(name: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(bits))


def with_sets(docs: DataFrame, wanted: DataFrame, bits: int = WANTED_BITS) -> DataFrame:
    """v, values (its set's sorted shingles) and checked (its longer signature) of the vertices wanted (v).

    Sets are made again from the texts. A table of bits, broadcast, lets through those that are wanted and few others, before the shuffle.
    """
    odd = _ODD[POSITIONS:]

    def run(batches):
        for b in batches:
            for _, _, raw, off in text_blocks(b.column("text")):
                own, begin, values = block_sets(raw, off)
                stop = np.append(begin[1:], len(values))
                sets = [values[i:j] for i, j in zip(begin, stop, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(map(vertex, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "values"])

    def longer(batches):
        for b in batches:
            out = []
            for data in b.column("values"):
                out.append(minima(np.frombuffer(data.as_buffer(), np.uint64), np.zeros(1, np.int64), odd)[0].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], ["v", "values", "checked"])

    place = _bit(F.col("v"), bits)
    flags = wanted.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    found = docs.select("text").mapInArrow(run, "v binary, values binary").withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place).cast("int")})
    byte = F.conv(F.hex(F.expr("substring(bitmap, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    found = found.join(F.broadcast(flags), "bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")) != 0)
    one = found.groupBy("v").agg(F.first("values").alias("values"))
    return one.join(wanted, "v", "left_semi").mapInArrow(longer, "v binary, values binary, checked binary")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The sets of a, which may be a centre of very many, are joined last, so that they aren't shuffled with each."""
    x, y = (sets.select(F.col("v").alias(k), F.col("values").alias(f"{k}_set")) for k in "ab")
    each = pairs.join(y, "b").join(x, "a")
    short, long = (f(F.length("a_set"), F.length("b_set")) for f in (F.least, F.greatest))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("a_set"), b.column("b_set"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= LEAST * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return each.where(short * 100 >= long * LEAST).select("a", "b", "a_set", "b_set").mapInArrow(run, "a binary, b binary")


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's centre and its others."""
    weight = members.groupBy("v").agg(F.sum("n").alias("weight"))
    centre = members.join(weight, "v").groupBy("slot", "key").agg(F.max(F.struct("weight", "v")).alias("best"))
    return members.join(centre.select("slot", "key", F.col("best.v").alias("a")), ["slot", "key"]).where("a <> v").select("a", F.col("v").alias("b")).distinct()


def near_forest(label: np.ndarray, checked: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> list[tuple[int, int]]:
    """Places of pairs, one of mine and one of theirs, that are near by checked and join all labels that such pairs join; label is changed."""
    found = []
    for i in mine:
        apart = theirs[label[theirs] != label[i]]
        if not len(apart):
            continue
        near = apart[(checked[apart] != checked[i]).sum(axis=1) <= CHECK_THRESHOLD]
        while len(near):
            j = near[0]
            found.append((int(i), int(j)))
            label[label == label[j]] = label[i]
            near = near[label[near] != label[i]]
    return found


def _blocks(own: Column, parts: Column) -> Column:
    """The pairs of blocks (part, other) that a row of block own takes part in, on the side 0 or 1, where all blocks meet."""
    grid = F.sequence(F.lit(0), parts - 1)
    as_row = F.transform(F.filter(grid, lambda j: j >= own), lambda j: F.struct(own.alias("part"), j.alias("other"), F.lit(0).alias("side")))
    as_col = F.transform(F.filter(grid, lambda i: i < own), lambda i: F.struct(i.alias("part"), own.alias("other"), F.lit(1).alias("side")))
    return F.concat(as_row, as_col)


def _met(rows: DataFrame, keys: list[str], column: str, solve) -> DataFrame:
    """Pairs (a, b) of v that solve(label, values of column, mine, theirs) finds in each pair of blocks of rows (keys, part, other, side, v, label)."""
    names = [*keys, "part", "other"]

    def run(batches):
        held, current = [], None

        def flush():
            side, v, label, values = (np.concatenate([h[k] for h in held]) for k in range(4))
            label = np.unique(label, return_inverse=True)[1]
            mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            theirs = mine if current[-1] == current[-2] else theirs
            found = solve(label, values, mine, theirs) if len(mine) and len(theirs) else []
            return pa.RecordBatch.from_arrays([pa.array([v[p[k]] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            n = len(b)
            if not n:
                continue
            at = [b.column(c).to_numpy() for c in names]
            new = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in at], axis=0))))
            side = b.column("side").to_numpy()
            v, label, values = (np.array([*b.column(c).to_pylist(), None], object)[:-1] for c in ("v", "label", column))
            for i, j in zip(new, np.append(new[1:], n), strict=True):
                this = tuple(int(x[i]) for x in at)
                if this != current:
                    if held:
                        yield flush()
                    held, current = [], this
                held.append((side[i:j], v[i:j], label[i:j], values[i:j]))
        if held:
            yield flush()

    rows = rows.select(*names, "side", "v", "label", column)
    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a binary, b binary").distinct()


def near_labels(members: DataFrame, labels: DataFrame, sets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (a, b) of vertices of a bucket and different labels whose longer signatures are near: a forest for each bucket."""
    named = members.join(labels, "v", "left").select("slot", "key", "n", "v", F.coalesce("label", "v").alias("label"))
    # two in a bucket have been compared
    mixed = named.where("n > 2").groupBy("slot", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("slot", "key")
    rows = named.join(mixed, ["slot", "key"]).join(sets.select("v", "checked"), "v")
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    rows = rows.withColumn("g", F.explode(_blocks(F.pmod(F.xxhash64("v"), parts).cast("int"), parts))).select("slot", "key", "g.part", "g.other", "g.side", "v", "label", "checked")

    def solve(label, values, mine, theirs):
        return near_forest(label, np.frombuffer(b"".join(values), np.uint8).reshape(len(values), CHECK), mine, theirs)

    return _met(rows, ["slot", "key"], "checked", solve)


def links_in_clusters(near: DataFrame, labels: DataFrame, sets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that join the labels that near pairs bring together, where sets of theirs are similar: all vertices of such
    labels are compared, but for those of a cluster's largest label among themselves."""
    x, y = (labels.select(F.col("v").alias(k), F.col("label").alias(f"{k}_label")) for k in "ab")
    ends = near.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    clusters = components(ends).select(F.col("v").alias("label"), F.col("root").alias("cluster"))
    alone = clusters.join(labels.select(F.col("v").alias("label")), "label", "left_anti").select("cluster", "label", F.col("label").alias("v"))
    named = saved(clusters.join(labels, "label").select("cluster", "label", "v").unionByName(alone), "minhash-clusters")
    sizes = named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster")
    sizes = sizes.agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).select("cluster", F.col("top.label").alias("top"), F.ceil(F.col("top.n") / block_rows).cast("int").alias("tops"), F.ceil((F.col("n") - F.col("top.n")) / block_rows).cast("int").alias("parts"))
    dealt = named.join(sizes, "cluster")
    at = lambda parts: F.pmod(F.xxhash64("v"), F.col(parts)).cast("int")
    with_top = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda k: F.struct(at("parts").alias("part"), (F.col("parts") + k).alias("other"), F.lit(0).alias("side")))
    as_top = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("part"), (F.col("parts") + at("tops")).alias("other"), F.lit(1).alias("side")))
    pairs = F.when(F.col("label") == F.col("top"), as_top).otherwise(F.concat(_blocks(at("parts"), F.col("parts")), with_top))
    rows = dealt.select(F.xxhash64("cluster").alias("key"), "v", "label", F.explode(pairs).alias("g")).select("key", "g.part", "g.other", "g.side", "v", "label")

    def solve(label, values, mine, theirs):
        return part_links([np.frombuffer(x, np.uint64) for x in values], label, mine, theirs)

    return _met(rows.join(sets.select("v", "values"), "v"), ["key"], "values", solve)


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after components that links (a, b) join have become one."""
    x, y = (labels.select(F.col("v").alias(k), F.col("label").alias(f"{k}_label")) for k in "ab")
    ends = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    roots = components(ends)
    # vertices that had no label of their own are their own label
    old = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(labels, "v", "left_anti").withColumn("label", F.col("v")))
    return saved(old.join(roots.withColumnRenamed("v", "label"), "label", "left").select("v", F.coalesce("root", "label").alias("label")), "minhash-labels")


def near_groups(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, v and component_id (the smallest doc_id reachable by links of sets) of every row of docs."""
    prints = saved(with_signatures(docs), "minhash-prints")
    vertices = saved(prints.where("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature")), "minhash-vertices")
    rows = keys(vertices)
    buckets = rows.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(rows.join(buckets, ["slot", "key"]), "minhash-members")
    sets = saved(with_sets(docs, members.select("v").distinct()), "minhash-sets")
    links = saved(linked(star_pairs(members), sets), "minhash-links")
    labels = components(links).withColumnRenamed("root", "label")
    near = saved(near_labels(members, labels, sets, block_rows), "minhash-near")
    if not near.isEmpty():
        more = saved(links_in_clusters(near, labels, sets, block_rows), "minhash-links")
        labels = labels if more.isEmpty() else joined_labels(labels, more)
    drop_saved(members)
    drop_saved(sets)
    named = vertices.select("v", "first_id").join(labels, "v", "left").select("v", "first_id", F.coalesce("label", "v").alias("label"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    groups = saved(named.join(least, "label").select("v", "component_id"), "minhash-groups")
    return prints.join(groups, "v", "left").select("doc_id", "n_shingles", "v", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Shingles by rising frequency: of two similar sets, the rarest of both are among the first fifth of each, one more.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS f FROM s)),
p AS (SELECT r.doc_id, s, n FROM r JOIN n USING (doc_id) WHERE i <= n * {100 - LEAST} // 100 + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS an, y.n AS bn FROM p x JOIN p y ON x.s = y.s AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= {LEAST} * greatest(x.n, y.n)),
l AS (SELECT a, b FROM (SELECT a, b, an, bn, count(*) AS shared FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.s = y.s GROUP BY ALL) WHERE 100 * shared >= {LEAST} * (an + bn - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
g(v, u) AS (SELECT a, b FROM e UNION SELECT g.v, e.b FROM g JOIN e ON g.u = e.a),
m AS (SELECT v, min(u) AS u FROM g GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(u, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(u, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON v = doc_id
"""
