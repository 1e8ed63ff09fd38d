"""Sinks: manifests by split, quarantine, reports, publication that is whole or nothing, checked reruns."""

from __future__ import annotations

import io
import uuid
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import snapshots
from textloom.sources.shared import shared_path
from textloom.sources.versions import put_file


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_manifests(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines, a folder for each split."""
    df.write.partitionBy(split).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """The few rows of a report as one JSON file."""
    df.coalesce(1).write.json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, there as a whole or not at all: written beside its place, then renamed over it in one step."""
    put_file(spark, path, text, overwrite=True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None where there is none."""
    fs, where = _fs(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(where) else None


def require_fingerprint(spark: SparkSession, path: str, fingerprint: str) -> None:
    """Keep a fingerprint of the settings that a state was made with; raise ValueError where another one is kept."""
    kept = read_text(spark, path)
    if kept is None:
        write_text(spark, path, fingerprint)
    elif kept != fingerprint:
        raise ValueError(f"{path}: the state there was made with other settings")


def publish(spark: SparkSession, target: str, outputs: dict[str, DataFrame], violations: DataFrame | None = None, inputs: str | None = None) -> None:
    """Write several outputs as one: to a staging folder that is renamed when all are there.

    Refused with a ValueError, and nothing left behind, if violations has rows, the target exists, or the files of the folder
    inputs have changed meanwhile.
    """
    if violations is not None and (bad := violations.take(5)):
        raise ValueError(f"refused: {[r.asDict() for r in bad]}")
    fs, final = _fs(spark, target)
    if fs.exists(final):
        raise ValueError(f"{target} exists")
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    try:
        if inputs is not None:
            snapshot(spark, inputs).write.parquet(f"{staging}/.inputs")
        for name, df in outputs.items():
            df.write.json(f"{staging}/{name}")
        if inputs is not None:
            if changed := changed_files(spark.read.parquet(f"{staging}/.inputs"), snapshot(spark, inputs)).take(5):
                raise ValueError(f"refused: inputs changed: {[r.path for r in changed]}")
            fs.delete(_fs(spark, f"{staging}/.inputs")[1], True)
        if not fs.rename(_fs(spark, staging)[1], final):
            raise OSError(f"{target} could not be published")
    finally:
        fs.delete(_fs(spark, staging)[1], True)


def publish_quarantined(df: DataFrame, target: str, status: str = "status") -> None:
    """Publish all rows as ``all`` and those that don't pass as ``quarantine``; df is computed once, to the shared folder, and both are read from there."""
    spark = df.sparkSession
    path = shared_path(spark, "quarantine")
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    publish(spark, target, {"all": rows, "quarantine": rows.where(~F.col(status).eqNullSafe(F.lit("pass")))})


def write_once(df: DataFrame, path: str) -> bool:
    """Write df, or, where path exists, require that it holds the same rows; whether it was written."""
    spark = df.sparkSession
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        df.write.mode("errorifexists").parquet(path)
        return True
    stored = spark.read.schema(df.schema).parquet(path)
    if not (df.exceptAll(stored).isEmpty() and stored.exceptAll(df).isEmpty()):
        raise ValueError(f"{path} holds other rows than this run")
    return False


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of the files of a folder: the hash of a file's length and its ranges' hashes (``snapshots``)."""
    return snapshots.snapshot(spark, folder).where("kind = 'file'").select("path", F.col("hash").alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that came, went or changed between two snapshots."""
    j = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    return j.where(~F.col("old").eqNullSafe(F.col("new")))


def save_revisions(stored: DataFrame, saves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare-and-set: (the new table, the refused saves). Both have id, revision, value; a save names the revision that it replaces.

    A save of an id that isn't stored must name revision 0; of several saves of one revision the first by value wins.
    """
    now = stored.select("id", F.col("revision").alias("__now"))
    judged = saves.join(now, "id", "left").withColumn("__ok", F.col("revision") == F.coalesce("__now", F.lit(0)))
    winner = judged.where("__ok").groupBy("id").agg(F.min("value").alias("value"), F.first("revision").alias("revision"))
    new = winner.select("id", (F.col("revision") + 1).alias("revision"), "value")
    refused = saves.join(winner.select("id", F.col("value").alias("__v"), F.lit(True).alias("__won")), "id", "left")
    refused = refused.join(now, "id", "left").where("NOT (coalesce(__won, false) AND value = __v AND revision = coalesce(__now, 0))")
    return stored.join(new, "id", "left_anti").unionByName(new), refused.select("id", "revision", "value")


def markdown(title: Column, lines: Column) -> Column:
    """A heading and an array of lines as a Markdown text."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))


def _wav_bytes(pcm: pd.Series, rate: pd.Series) -> pd.Series:
    out = []
    for p, r in zip(pcm, rate, strict=True):
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes(p)
        out.append(buffer.getvalue())
    return pd.Series(out)


def wav_bytes(pcm: Column, rate: Column) -> Column:
    """Mono 16-bit samples as the bytes of a WAV file."""
    return F.pandas_udf(_wav_bytes, "binary")(pcm, rate)
