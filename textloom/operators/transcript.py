"""Transcript texts: front matter, heading, speakers, events in brackets, paragraphs; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_EVENT = "\\[([^\\]\\n]+)\\]"


def _lines(raw: Column) -> Column:
    return F.split(F.regexp_replace(raw, "^\\x{FEFF}", ""), "\r\n|\n|\r")


def body_start(lines: Column) -> Column:
    """Place of the first line behind the front matter; null where that isn't closed."""
    closing = F.array_position(F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x) == "---"), True)
    return F.when(F.trim(F.get(lines, F.lit(0))) != "---", F.lit(0).cast("long")).when(closing > 0, closing + 1)


def front_matter(raw: Column) -> Column:
    """Map of the keys and values between the first lines of dashes; of one key twice, the last."""
    lines = _lines(raw)
    inner = F.slice(lines, 2, F.greatest(F.lit(0), F.coalesce(body_start(lines), F.lit(2)).cast("int") - 2))
    pairs = F.filter(inner, lambda x: F.contains(x, F.lit(":")))
    entry = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.substr(x, F.locate(":", x) + 1)), '^"+|"+$', "").alias("v")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def paragraphs(df: DataFrame, key: str, raw: str, events: set[str]) -> DataFrame:
    """A row for each paragraph: key, source_line, source_line_end, speaker, text, removed, unknown.

    Blank lines and speaker labels end a paragraph; its lines are joined by blanks. Events in
    brackets go where they are known and are listed either way. The first line with content may be a heading, which is no paragraph.
    """
    lines = _lines(F.col(raw))
    rows = df.select(key, body_start(lines).alias("body"), F.posexplode(lines).alias("i", "line")).where("i >= body").select(key, "i", F.trim("line").alias("line"))
    w = Window.partitionBy(key).orderBy("i")
    seen = F.sum(F.when(F.col("line") != "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    heading = (seen == 1) & F.col("line").rlike("^#\\s+")
    rows = rows.withColumn("heading", heading).where("NOT heading")
    speaker = F.nullif(F.regexp_extract("line", "^([A-Z]):\\s*", 1), F.lit(""))
    rows = rows.withColumn("speaker", speaker).withColumn("blank", F.col("line") == "")
    cut = F.col("blank") | F.col("speaker").isNotNull() | F.coalesce(F.lag("blank").over(w), F.lit(True))
    rows = rows.withColumn("paragraph", F.sum(F.when(cut, 1).otherwise(0)).over(w)).where("NOT blank")
    known = F.array(*(F.lit(e) for e in sorted(events))).cast("array<string>")
    body = F.regexp_replace("line", "^[A-Z]:\\s*", "")
    found = F.regexp_extract_all(body, F.lit(_EVENT), F.lit(1))
    is_known = lambda e: F.array_contains(known, F.lower(F.trim(e)))
    removed = F.filter(found, is_known)
    clean = F.aggregate(removed, body, lambda acc, e: F.replace(acc, F.concat(F.lit("["), e, F.lit("]")), F.lit(" ")))
    parts = rows.select(key, "paragraph", F.struct("i", clean.alias("text"), "speaker", removed.alias("removed"), F.filter(found, lambda e: ~is_known(e)).alias("unknown")).alias("p"))
    g = parts.groupBy(key, "paragraph").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    text = F.trim(F.regexp_replace(F.trim(F.array_join("ps.text", " ")), "[ \\t]+", " "))
    out = g.select(
        key, (F.col("ps")[0]["i"] + 1).cast("long").alias("source_line"), (F.element_at("ps", -1)["i"] + 1).cast("long").alias("source_line_end"), F.col("ps")[0]["speaker"].alias("speaker"), text.alias("text"),
        F.flatten("ps.removed").alias("removed"), F.flatten("ps.unknown").alias("unknown"),
    )
    return out.where("text <> ''")
