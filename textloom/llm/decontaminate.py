"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

Text and item overlap where some run of SPAN consecutive words of the item (the whole of a
shorter item) stands in the text with LEAST_SIMILARITY of its words or more unchanged, each in
its place. A seed is a fixed mask over such a run of which only some words count, so a hit
survives substituted words at the ignored places; every word position of every document is
hashed under each mask and joined to the hashes of the benchmark's items. The masks leave out
every pair of places of SPAN, and every single place of a shorter item, so no overlap is without a hit.
Around each hit the whole item is then laid along the text and compared word by word, and the
overlap stands if one of its runs agrees as said.

Words are runs of letters and digits in lower case. Items of one to four words must stand whole.

The seeds, and the items' words, go to every task only if they are few (``broadcast_limit`` seeds, counted first);
beyond that, seeds and positions are shuffled by hash.

Defined cases: null texts count as empty and match nothing; null ids are ids like others;
rows of one doc_id, or item_id, are reported together; repeated rows change nothing;
extra columns are ignored; empty tables give no rows; of overlaps of one document and item that
match alike, the one that compares fewer words and then the earliest is told.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

SPAN = 10
LEAST_SIMILARITY = 0.8
#: Places of SPAN that count; any two places are both ignored by one of the masks.
MASKS = ((1, 4, 5, 7, 8), (1, 2, 4, 7, 9), (2, 5, 6, 8, 9), (0, 2, 3, 5, 8), (0, 3, 4, 6, 7), (0, 1, 3, 6, 9))
#: Seeds that are sent to every task at most.
BROADCAST_LIMIT = 200_000


def masks_of(words: int) -> tuple[tuple[int, ...], ...]:
    """The masks for items of so many words: of SPAN or more MASKS, of 5 to SPAN - 1 every other place, else all places."""
    if words >= SPAN:
        return MASKS
    every = tuple(range(words))
    return (every[::2], every[1::2]) if words >= 5 else (every,)


def least_words(span: int, least_similarity: float = LEAST_SIMILARITY) -> int:
    return math.ceil(least_similarity * span - 1e-9)


def words_of(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def word_codes(text: str = "text") -> Column:
    """A 64-bit hash of each word: windows are hashed, and words compared, as longs."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def positions(texts: DataFrame, spans: list[int]) -> DataFrame:
    """The columns of texts (with an array words of their codes), and p (place of the window) and code, for each window of each mask of each span."""
    names, shortest = texts.columns, min(spans)
    # not a filter: pushed below, that would split every text twice
    places = F.when(F.size("words") >= shortest, F.sequence(F.lit(0), F.size("words") - shortest))
    rows = texts.select(*names, F.explode(places).alias("p"))
    each = []
    for span in spans:
        for k, counted in enumerate(masks_of(span)):
            code = F.xxhash64(F.lit(100 * span + k), *(F.get("words", F.col("p") + F.lit(i)) for i in counted))
            each.append(code if span == shortest else F.when(F.col("p") + span <= F.size("words"), code))
    return rows.select(*names, "p", F.explode(F.array(*each)).alias("code")).where(F.col("code").isNotNull())


def seeds(items: DataFrame, spans: list[int]) -> DataFrame:
    """code, item_id, wording, n_words, at (place of the window in the item) of items (item_id, wording, words)."""
    parts = []
    for span in spans:
        own = items.where(F.size("words") >= span) if span == SPAN else items.where(F.size("words") == span)
        parts.append(positions(own, [span]).select("code", "item_id", "wording", F.size("words").alias("n_words"), F.col("p").alias("at")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, least_similarity: float = LEAST_SIMILARITY, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, matched, compared, doc_word.

    matched and compared count the words along the whole item, doc_word is where it begins in the document. Of several
    places, the one with the most matched words, then the fewest compared, then the earliest.
    """
    if least_similarity < LEAST_SIMILARITY:
        raise ValueError(f"the masks find overlaps from {LEAST_SIMILARITY} on")
    items = benchmark.select("item_id", word_codes().alias("words")).where(F.size("words") > 0).withColumn("wording", F.xxhash64("words"))
    # at most SPAN rows
    spans = sorted(r["n"] for r in items.select(F.least(F.size("words"), F.lit(SPAN)).alias("n")).distinct().collect())
    if not spans:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema.add(items.schema["item_id"]).add("matched", "long").add("compared", "long").add("doc_word", "long"))
    seed = seeds(items, spans)
    windows = positions(docs.select("doc_id", word_codes().alias("words")), spans)
    few = seed.limit(broadcast_limit + 1).count() <= broadcast_limit
    words = items.select("wording", F.col("words").alias("item_words")).distinct()
    diagonal = F.col("p") - F.col("at")
    skip = F.greatest(F.lit(0), -diagonal)
    if few:
        hits = windows.join(F.broadcast(seed), "code")
        # the words of the text along the item
        along = hits.select("doc_id", "item_id", "wording", diagonal.alias("diagonal"), F.slice("words", diagonal + skip + 1, F.col("n_words") - skip).alias("b"))
        words = F.broadcast(words)
    else:
        # shuffled by code, positions go without their texts; the places that are hit fetch their words again
        rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", word_codes().alias("words"))
        thin = positions(rows, spans).select("row", "p", "code")
        places = thin.join(seed, "code").select("row", "item_id", "wording", "n_words", diagonal.alias("diagonal")).distinct()
        start = F.greatest(F.lit(0), F.col("diagonal"))
        along = rows.distinct().join(places, "row").select("doc_id", "item_id", "wording", "diagonal", F.slice("words", start + 1, F.col("n_words") - start + F.col("diagonal")).alias("b"))
    # one row for each diagonal and wording of both sides; the comparison stays above this aggregate, so that the join's loop is small
    # enough to be compiled and no document's words are copied for its positions
    once = along.groupBy("doc_id", "item_id", "wording", "diagonal", F.xxhash64("b").alias("text_wording")).agg(F.first("b").alias("b"))
    pairs = once.join(words, "wording").withColumn("skip", F.greatest(F.lit(0), -F.col("diagonal")))
    same = F.zip_with(F.slice("item_words", F.col("skip") + 1, F.size("b")), "b", lambda x, y: (x == y).cast("int"))
    checked = pairs.select("doc_id", "item_id", F.greatest(F.lit(0), F.col("diagonal")).alias("doc_word"), F.size("b").alias("compared"), F.least(F.size("item_words"), F.lit(SPAN)).alias("span"), same.alias("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best_run = F.array_max(F.transform(F.sequence(F.lit(1), F.col("compared") - F.col("span") + 1), lambda k: total(F.slice("same", k, F.col("span")))))
    needed = F.ceil(F.lit(least_similarity) * F.col("span") - F.lit(1e-9))
    checked = checked.where(F.col("compared") >= F.col("span")).where(best_run >= needed).select("doc_id", "item_id", "doc_word", "compared", total(F.col("same")).alias("matched"))
    best = F.min(F.struct((-F.col("matched")).alias("less"), "compared", "doc_word"))
    return (
        checked.groupBy("doc_id", "item_id").agg(best.alias("best"))
        .select("doc_id", "item_id", (-F.col("best.less")).cast("long").alias("matched"), F.col("best.compared").cast("long").alias("compared"), F.col("best.doc_word").cast("long").alias("doc_word"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, that overlap no benchmark item; rows with a null id are kept."""
    found = overlaps(docs, benchmark, least_similarity).select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct()
    return docs.join(found, F.col("doc_id") == F.col("__id"), "left_anti")


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Without seeds: every pair of equal words lies on a diagonal of its text and item, and runs of a diagonal are counted.
ORACLE_SQL = rf"""
WITH dt AS (SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
it AS (SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT d, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM dt),
iw AS (SELECT i, unnest(w) AS word, unnest(range(0, len(w))) AS q FROM it),
points AS (SELECT d, i, p - q AS diagonal, q FROM dw JOIN iw USING (word)),
many AS (SELECT d, i, diagonal, count(*) AS matched FROM points GROUP BY ALL HAVING count(*) >= {least_words(SPAN)} OR count(*) >= 0.8 * (SELECT min(len(w)) FROM it)),
runs AS (
  SELECT d, i, diagonal, matched, count(*) OVER (PARTITION BY d, i, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS run
  FROM points JOIN many USING (d, i, diagonal)),
best AS (SELECT d, i, diagonal, matched, max(run) AS run FROM runs GROUP BY ALL),
sides AS (
  SELECT doc_id, item_id, greatest(0, diagonal) AS doc_word, matched, run, least(len(it.w), {SPAN}) AS span,
         least(len(it.w), len(dt.w) - diagonal) - greatest(0, -diagonal) AS compared
  FROM best JOIN dt USING (d) JOIN it USING (i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, compared, doc_word) AS r
  FROM sides WHERE compared >= span AND run >= ceil({LEAST_SIMILARITY} * span - 1e-9))
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(compared AS BIGINT) AS compared, CAST(doc_word AS BIGINT) AS doc_word FROM ranked WHERE r = 1
"""
