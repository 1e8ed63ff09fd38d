"""Text functions as Catalyst expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_fast(c: Column | str) -> Column:
    """Lower case with sharp s spelt out, letters and digits only; equals full normalisation where no compatibility characters occur."""
    return F.regexp_replace(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), "[^\\p{L}\\p{N}]", "")


def normalize_lower(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^\\p{L}\\p{N}]", "")


def collapse_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), "\\s+", " "))


def error_rate(reference: Column, hypothesis: Column, edits: Column | None = None) -> Column:
    """Edits (counted here unless given) per reference character; 0 where both are empty, null where only the reference is."""
    edits = F.levenshtein(reference, hypothesis) if edits is None else edits
    return F.when(F.length(reference) > 0, edits / F.length(reference)).when(F.length(hypothesis) == 0, F.lit(0.0))


def canonical_title(c: Column | str) -> Column:
    """Without a leading number and underscore, spaces collapsed."""
    return collapse_space(F.regexp_replace(_col(c), "^\\d+_", ""))


def hash_id(prefix: str, c: Column | str, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(_col(c), 256), 1, digits))


def clock(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on; whole seconds, rounded down."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def clock_fine(seconds: Column) -> Column:
    """m:ss.cc; hundredths, rounded down."""
    c = F.floor(seconds * 100).cast("long")
    return F.format_string("%d:%02d.%02d", F.floor(c / 6000), F.floor(c / 100) % 60, c % 100)


def text_chunks(c: Column | str, size: int) -> Column:
    """Array of (offset, part) with parts of size characters; an empty text has none."""
    c = _col(c)
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda o: F.struct(o.alias("offset"), F.substr(c, o + 1, F.lit(size)).alias("part")))


def term_list(c: Column | str, most: int = 50) -> Column:
    """Terms between commas and line ends: trimmed, without empty ones, the first ``most``."""
    return F.slice(F.filter(F.transform(F.split(_col(c), "[,\n]"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def remove_overlap(previous: Column | str, current: Column | str, least: int = 6, most: int = 60) -> Column:
    """current without a beginning whose letters and digits repeat the end of previous.

    The longest repeat of least to most such characters goes, with the punctuation behind it.
    """
    plain = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N}]", "")
    current = _col(current)
    ends = F.struct(F.right(plain(_col(previous)), F.lit(most)).alias("left"), F.left(plain(current), F.lit(most)).alias("right"))
    sizes = F.sequence(F.lit(most), F.lit(least), F.lit(-1))
    # the ends as the one element of an array, so that they are made once and not for every size
    longest = F.transform(F.array(ends), lambda e: F.get(F.filter(sizes, lambda n: (F.length(e["left"]) >= n) & (F.length(e["right"]) >= n) & (F.right(e["left"], n) == F.left(e["right"], n))), F.lit(0)))
    size = F.get(longest, F.lit(0))
    # cut after the size-th letter or digit: the shortest head of current that holds size of them
    counted = F.call_function("regexp_extract", current, F.concat(F.lit("^(?:[^\\p{L}\\p{N}]*+[\\p{L}\\p{N}]){"), F.coalesce(size, F.lit(1)).cast("string"), F.lit("}")), F.lit(0))
    rest = F.regexp_replace(F.substr(current, F.length(counted) + 1), "^[\\s,.!?。]+", "")
    return F.when(size.isNull(), current).otherwise(rest)


def highlight(c: Column | str, query: str) -> Column:
    """The parts of a text between the matches of a literal, which keep their places."""
    return F.split(_col(c), "\\Q" + query.replace("\\E", "") + "\\E") if query else F.array(_col(c))


def strict_json(*names: str) -> Column:
    """Columns as a JSON object with its keys in order; numbers that aren't finite are refused."""
    bad = [F.coalesce(F.isnan(F.col(n).try_cast("double")) | (F.abs(F.col(n).try_cast("double")) == F.lit(float("inf"))), F.lit(False)) for n in names]
    refused = F.raise_error(F.lit("a number that is not finite")).cast("string")
    return F.when(F.exists(F.array(*bad), lambda b: b), refused).otherwise(F.to_json(F.struct(*(F.col(n) for n in sorted(names))), {"ignoreNullFields": "false"}))


def html_safe_json(c: Column) -> Column:
    """JSON that can stand inside a script element."""
    out = c
    for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def even_bounds(n: Column, parts: int) -> Column:
    """The parts + 1 bounds that divide n things evenly: i * n div parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.floor(i.cast("long") * n / parts).cast("long"))


def stamp(at: Column) -> Column:
    """A time as text, to the millisecond in UTC, whose order as text is that of time; the session's zone has to be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
