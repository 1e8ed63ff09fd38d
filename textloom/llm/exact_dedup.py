"""Exact deduplication as a stateful stream.

A thin row for each document (digest of the normalised text, code points, id, content
locator) streams through a keyed state that RocksDB holds on disk and that never expires:
for each digest it retains the identifier and content locator of the document that stays,
and how many rows share it. Rows are combined before the shuffle, so a digest that a third
of all rows share reaches its state as one row from each task. Then full bytes are checked
on hits: normalised texts whose digest is another row's too are grouped by digest and text, and a digest that turns out to stand for
several texts is resolved by the texts themselves.

Texts are equal when identical after deleting every blank and every character from tab to
carriage return; of equal texts the longest in code points stays, then the smallest id.

Defined cases: null text counts as empty, and all empty texts are equal; a null id is
smaller than any other; of rows alike in text and id exactly one is kept; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import new_path, saved, table

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # memory of a store outside the heap
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    # a store that is done with its batch leaves the executor's disk; what it holds is in the shared checkpoint
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Bytes of thin rows that one micro-batch takes; the state carries over.
BATCH_BYTES = 64 << 30
#: Bits of the table that tells rows whose digest hit another's from the rest; a smaller share of them is told apart as digests outnumber them, nothing else changes.
HIT_BITS = 1 << 26


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def sha256_of(norm: Column) -> Column:
    return F.sha2(norm, 256)


def thin_rows(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """digest, n_chars, doc_id, row_id (unique once stored) and locator (file and row of the content, where docs is a scan)."""
    try:
        found = docs.select("doc_id", "text", F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("locator"))
    except AnalysisException:
        found = docs.select("doc_id", "text", F.concat(F.lit("doc_id="), F.col("doc_id").cast("string")).alias("locator"))
    return found.select(
        digest(normalised()).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "doc_id", F.monotonically_increasing_id().alias("row_id"), "locator"
    )


def stream_state(thin: DataFrame, path: str) -> DataFrame:
    """digest, keep (n_chars negated, doc_id, row_id, locator) and group_size, by streaming the table at path through the state."""
    spark = thin.sparkSession
    out = new_path(spark, "dedup-updates")
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(thin.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)
        best = F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row_id", "locator"))
        state = rows.groupBy("digest").agg(best.alias("keep"), F.count(F.lit(1)).alias("group_size"))

        def emit(updates: DataFrame, batch: int) -> None:
            updates.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", new_path(spark, "dedup-state")).trigger(availableNow=True).foreachBatch(emit).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = state.schema
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)):
        return spark.createDataFrame([], schema)
    updates = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
    # a key that several micro-batches touched has an update for each; the largest group is the last
    return updates.groupBy("digest").agg(F.max_by("keep", "group_size").alias("keep"), F.max("group_size").alias("group_size"))


def repeated_bits(state: DataFrame, bits: int = HIT_BITS) -> DataFrame:
    """(bucket, bitmap): a bit for the hash of each digest that several rows share; a table of bits / 8 bytes at most, whatever the input."""
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    return state.where("group_size > 1").select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def conflicting(docs: DataFrame, state: DataFrame, digest=sha256_of, bits: int = HIT_BITS) -> DataFrame:
    """Digests that stand for more than one text, by the full bytes of the rows that hit a digest of another row.

    A text whose digest no other row has stays in its task: the bits (broadcast; their size is fixed) let through only digests that are repeated
    and some that share a bit with one, which make groups of a single text. Texts are combined before the shuffle.
    """
    flags = F.broadcast(repeated_bits(state, bits))
    texts = docs.select(normalised().alias("norm")).withColumn("digest", digest(F.col("norm")))
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bitmap, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hits = texts.withColumns({"bucket": F.bitmap_bucket_number(place), "bit": bit}).join(flags, "bucket")
    hits = hits.where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")) != 0).select("digest", "norm")
    several = hits.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    return several


def exact_groups(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, digest, keep_id, group_size, kept."""
    spark = docs.sparkSession
    path = new_path(spark, "dedup-thin")
    thin = thin_rows(docs, digest)
    thin.write.parquet(path)
    thin = spark.read.schema(thin.schema).parquet(path)
    state = saved(stream_state(thin, path), "dedup-groups")
    found = thin.join(state, "digest", "left").select(
        "doc_id", "n_chars", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept")
    )
    clash = saved(conflicting(docs, state, digest), "dedup-clashes")
    if clash.isEmpty():
        return found
    # one digest, several texts: these rows are grouped by the texts themselves
    rows = docs.select("doc_id", "text", normalised().alias("norm")).withColumn("digest", digest(F.col("norm"))).join(clash, "digest", "left_semi")
    rows = saved(rows.select("doc_id", "digest", "norm", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row_id")), "dedup-clash-rows")
    best = rows.groupBy("digest", "norm").agg(F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = rows.join(best, ["digest", "norm"]).select("doc_id", "n_chars", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"))
    return found.join(clash, "digest", "left_anti").unionByName(again)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns; docs that hold an id twice, with texts alike, give one of those rows."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("n_chars").alias("__n"))
    own = docs.withColumn("__sha", sha256_of(normalised())).withColumn("__chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest")) & (F.col("__chars") == F.col("__n"))
    left = own.join(kept, same, "left_semi")
    unique = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return (left if unique else left.dropDuplicates(["doc_id", "__sha", "__chars"])).drop("__sha", "__chars")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_groups(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, sha256(norm) AS text_sha256,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size
      FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
