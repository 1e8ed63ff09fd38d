"""Running a streaming query to the end of its input, going on from where a run stopped, and reading what it emitted."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources import versions
from textloom.sources.shared import shared_path
from textloom.sources.writers import require_fingerprint, save_revisions


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table as a stream of its files; back pressure is the number of files that a micro-batch takes."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def json_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Requests as JSON lines, from the files that come into a folder; a malformed line fails the query."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(folder)


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_parts(df: DataFrame, time: str, parts: int, name: str, tick: str | None = None, files: int = 1) -> DataFrame:
    """df as a stream that arrives in parts, a micro-batch each, in the order of a timestamp; rows of one time come together.

    A part is that many files, so that as many tasks write and read it (empty ones where it has too few rows). With tick (an interval), a last row that is null but for its time, that much after all others, moves the clock on.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    low, high = df.agg(F.unix_micros(F.min(time)), F.unix_micros(F.max(time))).first()
    none = df.limit(0).coalesce(1)

    def filled(rows: DataFrame, before: int) -> int:
        rows.write.mode("append").parquet(path)
        for _ in range(before + files - len(spark.read.parquet(path).inputFiles()) if files > 1 else 0):
            none.write.mode("append").parquet(path)
        return before + files

    n = 0
    at, step = F.unix_micros(F.col(time)), 1 if low is None else (high - low) // parts + 1
    for k in range(parts if low is not None else 0):
        n = filled(df.where((at >= low + k * step) & (at < low + (k + 1) * step)).coalesce(files), n)
    if tick is not None and low is not None:
        late = F.timestamp_micros(F.lit(high)) + F.expr(f"INTERVAL {tick}")
        filled(spark.range(1).coalesce(1).select(*((late if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema)), n)
    none.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, mode: str, name: str, each: Callable[[DataFrame], DataFrame] | None = None, place: str | None = None, fingerprint: str | None = None, settings: dict[str, str] | None = None, emits: str | None = None) -> DataFrame:
    """Everything that the query emits on the input there is, with the number of its micro-batch as ``batch``.

    settings are the session's while the query starts; emits is the schema of what each gives, if another than the query's. each is applied to every micro-batch. With a place of its own (a folder) the query's progress and results stay there: the next
    run goes on from them, and is refused where its settings' fingerprint is another.
    """
    spark = stream.sparkSession
    root = place or shared_path(spark, name)
    if fingerprint is not None:
        require_fingerprint(spark, f"{root}/fingerprint", fingerprint)
    out = f"{root}/out"

    def keep(df: DataFrame, batch: int) -> None:
        df = df if each is None else each(df)
        # a micro-batch that is run again replaces what its first run wrote
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/b{batch}")

    own = stream.schema if emits is None else T._parse_datatype_string(emits)
    schema = T.StructType([*own.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], own).withColumn("batch", F.lit(0).cast("long")).write.mode("ignore").parquet(f"{out}/none")
    with session_settings(spark, settings or {}):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema(schema).parquet(out)


def coalesced_previews(batch: DataFrame, most: int | None = None) -> DataFrame:
    """Of the queued items of a micro-batch (id, arrival, final): all finals, and the last preview of ids that have none.

    With most, of those previews only the latest that leave the queue no longer than that; finals always stay.
    """
    finals = batch.where("final")
    previews = batch.where("NOT final").join(finals.select("id").distinct(), "id", "left_anti")
    last = previews.groupBy("id").agg(F.max("arrival").alias("arrival"))
    kept = previews.join(last, ["id", "arrival"], "left_semi").select(*batch.columns)
    if most is not None:
        kept = kept.orderBy(F.desc("arrival")).limit(max(0, most - finals.count()))
    return finals.unionByName(kept)


def saved_revisions(saves: DataFrame, stored: DataFrame, place: str | None = None) -> DataFrame:
    """The table after a stream of compare-and-set saves (id, revision, value), each micro-batch judged against the table that the last one left.

    The table is one of numbered versions, which say what micro-batch made them: a run that starts again goes on from the last
    version, and a batch that is run again changes nothing. stored begins it; with a place where a table is, that one goes on.
    """
    spark = stored.sparkSession
    root = place or shared_path(spark, "revisions")
    if versions.version(spark, f"{root}/table") is None:
        versions.commit(stored, f"{root}/table", 0)

    def keep(batch: DataFrame, number: int) -> None:
        versions.update(spark, f"{root}/table", lambda now: save_revisions(now, batch)[0], mark=("saves", number))

    query = saves.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return versions.read(spark, f"{root}/table")
