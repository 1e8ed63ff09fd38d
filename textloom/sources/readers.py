"""Sources: JSON lines and documents, files of a folder, split settings, WAV audio, data inside pages, saved records."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import canonical_title
from textloom.functions.unicode import nfc_udf


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a malformed line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def files(spark: SparkSession, folder: str, kinds: dict[str, str]) -> DataFrame:
    """path, name, title (canonical, composed), kind of the files of a folder; kinds maps suffixes, others are 'ignored'. Contents aren't read."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    suffix = F.lower(F.regexp_extract("name", "(\\.[^.]+)$", 1))
    kind = F.coalesce(*(F.when(suffix == s, F.lit(k)) for s, k in kinds.items()), F.lit("ignored"))
    return found.select("path", "name", "length", canonical_title(nfc_udf(F.regexp_replace(F.try_url_decode("name"), "\\.[^.]+$", ""))).alias("title"), kind.alias("kind"))


def unpaired(found: DataFrame, left: str, right: str) -> DataFrame:
    """Titles that have only one of two kinds of files, and which one is missing."""
    a = found.where(F.col("kind") == left).select("title", F.lit(True).alias("a")).distinct()
    b = found.where(F.col("kind") == right).select("title", F.lit(True).alias("b")).distinct()
    return a.join(b, "title", "full_outer").where("a IS NULL OR b IS NULL").select("title", F.when(F.col("a").isNull(), left).otherwise(right).alias("missing"))


def split_settings(df: DataFrame, splits: str = "splits") -> DataFrame:
    """(title, split, valid) of a map column of titles to splits."""
    e = df.select(F.explode(F.map_entries(splits)).alias("e"))
    return e.select(F.col("e.key").alias("title"), F.col("e.value").alias("split"), F.col("e.value").isin("train", "validation", "test").alias("valid"))


def repeated_titles(df: DataFrame, title: str) -> DataFrame:
    """Canonical titles that several settings name, and how many."""
    return df.select(canonical_title(title).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fetched(pages: DataFrame, cached: DataFrame, key: str, body: str, most_bytes: int) -> DataFrame:
    """What becomes of pages that are asked for: cached (kept as they are), failed (without a body), too_large or fetched."""
    there = cached.select(key, F.lit(True).alias("__there")).distinct()
    state = F.when(F.col("__there"), "cached").when(F.col(body).isNull(), "failed").when(F.octet_length(body) > most_bytes, "too_large").otherwise("fetched")
    return pages.join(there, key, "left").withColumn("state", state).drop("__there")


def _wav(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for c in contents:
        try:
            with wave.open(io.BytesIO(c)) as w:
                raw = w.readframes(w.getnframes())
                rows.append((w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes(), raw, None))
        except (wave.Error, EOFError, TypeError) as e:
            rows.append((None, None, None, None, None, str(e) or type(e).__name__))
    return pd.DataFrame(rows, columns=["rate", "channels", "width", "frames", "pcm", "error"]).astype({"rate": "Int32", "channels": "Int32", "width": "Int32", "frames": "Int64"})


def wav(column: Column | str) -> Column:
    """Struct of a WAV file's rate, channels, width, frames, samples and, where it can't be read, the error."""
    return F.pandas_udf(_wav, "rate int, channels int, width int, frames long, pcm binary, error string")(column)


def page_json(html: Column, element_id: str, schema: str) -> Column:
    """The JSON of a page's script element with an id; null where there is none or it is malformed."""
    body = F.regexp_extract(html, f'(?s)<script[^>]*id="{element_id}"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.nullif(body, F.lit("")), schema)


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Saved records of a folder, those with an id of the usual form, the newest first."""
    r = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("id", F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\.json$", 1))
    return r.where(F.col("id").rlike("^[A-Za-z0-9_-]{1,64}$")).orderBy(F.desc("updatedAt"), "id")


def cyclic(spark: SparkSession, n: int, length: int, offset: int = 0) -> DataFrame:
    """(i, sample): n places over a sample of some length, read around and around."""
    return spark.range(n).select(F.col("id").alias("i"), F.pmod(F.col("id") + offset, F.lit(length)).alias("sample"))
