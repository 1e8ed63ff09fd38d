"""Rules of audio clips, source times and whole recordings; guards of held-out data; payload and duration checks.

All are expressions over columns and neighbouring rows. The bounds are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.operators.issues import issue_codes
from textloom.operators.ordered import folded

#: Seconds of a clip, characters a second, level, share of clipped samples, distance of tokens from a context's edges, what a clip takes along.
CLIP_SECONDS, TEXT_RATE, LEAST_LEVEL, MOST_CLIPPED, EDGE, PADDING = (1, 32), (1, 22), 0.0005, 0.01, 0.08, 0.03
#: Fixed values of whole recordings: share of near-silent samples, of clipped ones, level.
NEAR_SILENT, CLIPPED, LOW_LEVEL = 0.5, 0.001, 0.003


# units


def frames_of(milliseconds: Column, rate: int = 16000) -> Column:
    """Whole milliseconds as frames."""
    return (milliseconds * (rate // 1000)).cast("long")


def samples_of(seconds: Column, rate: int = 16000) -> Column:
    """Seconds as the nearest sample, halves to even."""
    return F.bround(seconds * rate).cast("long")


def on_grid(seconds: Column, rate: int = 16000, tolerance: float = 1e-6) -> Column:
    """Whether seconds are a whole number of samples."""
    return F.abs(seconds * rate - samples_of(seconds, rate)) < tolerance


def text_rate(chars: Column, seconds: Column) -> Column:
    """Characters a second; no duration counts as a millisecond."""
    return chars / F.greatest(seconds, F.lit(0.001))


def durations_differ(decoded: Column, header: Column) -> Column:
    """Whether a decoded duration is further from the header's than a quarter of a second and a thousandth."""
    return F.abs(decoded - header) > F.greatest(F.lit(0.25), 0.001 * header)


def locator(clip: Column, recording: Column, start: Column, end: Column) -> Column:
    """Where a row's audio is: its clip, or else a stretch of the recording."""
    return F.when(clip.isNotNull(), F.concat(F.lit("clips/"), clip, F.lit(".wav"))).otherwise(F.format_string("lectures/%s.wav#t=%.6f,%.6f", recording, start, end))


def without_prefix(text: Column, prefix: str) -> Column:
    """The text behind a prefix that it must have, and that something must follow; else null."""
    return F.when(text.startswith(prefix) & (F.trim(F.substr(text, F.lit(len(prefix) + 1))) != ""), F.substr(text, F.lit(len(prefix) + 1)))


# clips


def clip_bounds(rows: DataFrame) -> DataFrame:
    """rows (context_start, context_end, first_start, last_end in seconds of the context) with audio_start, audio_end and duration of their clips."""
    begin = F.greatest(samples_of(F.col("context_start")), samples_of(F.col("context_start")) + samples_of(F.col("first_start") - PADDING))
    end = F.least(samples_of(F.col("context_end")), samples_of(F.col("context_start")) + samples_of(F.col("last_end") + PADDING))
    return rows.withColumns({"audio_start": begin / 16000, "audio_end": end / 16000}).withColumn("duration", F.col("audio_end") - F.col("audio_start"))


def clip_issues(rows: DataFrame, recording: str, order: str, eligible: str = "eligible") -> DataFrame:
    """rows (context_start, context_end, first_start, last_end, chars, rms, clipped, reference_start, reference_end and a boolean eligible) with issues.

    Overlaps are judged against the last row before that is eligible and has no issue, overlaps included: a fold.
    """
    rows = clip_bounds(rows)
    own = F.coalesce(F.col(eligible), F.lit(False))
    length, rate = F.col("context_end") - F.col("context_start"), text_rate(F.col("chars"), F.col("duration"))
    rules = [
        ("alignment_touches_context_boundary", (F.col("first_start") < EDGE) | (F.col("last_end") > length - EDGE)), ("clip_duration_out_of_bounds", ~F.col("duration").between(*CLIP_SECONDS)),
        ("implausible_text_rate", ~rate.between(*TEXT_RATE)), ("near_silent_audio", F.col("rms") < LEAST_LEVEL), ("excessive_clipping", F.col("clipped") > MOST_CLIPPED),
    ]
    rows = rows.withColumn("issues", F.when(own, issue_codes(rules)).otherwise(F.array().cast("array<string>"))).withColumn("own_row", own)

    def step(until, row):
        if not row.own_row:
            return until, ([],)
        found = [] if until is None else [c for c, at, end in (("overlapping_audio", row.audio_start, until[0]), ("overlapping_reference_span", row.reference_start, until[1])) if at < end]
        return (until if found or row.issues else (row.audio_end, row.reference_end)), (found,)

    out = folded(rows, [recording], [order], step, None, "overlaps array<string>")
    return out.withColumn("issues", F.concat("issues", "overlaps")).drop("own_row", "overlaps")


def duplicate_clips(rows: DataFrame, key: str, order: str, split: str) -> DataFrame:
    """rows with the issues duplicate_audio (a row with this key stands before) and duplicate_audio_across_splits (of the first such row, where a later one is of another split).

    By two combined aggregates, so that no group of copies is gathered.
    """
    firsts = rows.groupBy(key).agg(F.min(F.struct(order, split)).alias("__first"), F.min(split).alias("__low"), F.max(split).alias("__high"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = rows.join(firsts, key, "left")
    is_first = F.col(order) == F.col(f"__first.{order}")
    codes = issue_codes([
        ("duplicate_audio", F.col("__n").isNotNull() & ~is_first), ("duplicate_audio_across_splits", F.col("__n").isNotNull() & is_first & (F.col("__low") != F.col("__high"))),
    ])
    return joined.select(*rows.columns, codes.alias("duplicate_issues"))


# source times


def interval_issues(rows: DataFrame, recording: str, order: str, most_seconds: float = 90.0) -> DataFrame:
    """rows (text, start_ms, end_ms: whole or null; frames of the recording) with issues; overlaps are marked on all rows that overlap."""
    valid = F.coalesce((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms")), F.lit(False))
    rows = rows.withColumn("__valid", valid)
    own = Window.partitionBy(recording, "__valid").orderBy(order)
    by_start = Window.partitionBy(recording, "__valid").orderBy("start_ms", order)
    before = F.max("end_ms").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("start_ms").over(by_start.rowsBetween(1, Window.unboundedFollowing))
    marks = rows.withColumns({
        "__back": F.coalesce(F.col("start_ms") < F.lag("start_ms").over(own), F.lit(False)), "__ahead": F.coalesce(F.lead("start_ms").over(own) < F.col("start_ms"), F.lit(False)),
        "__over": F.coalesce(before > F.col("start_ms"), F.lit(False)) | F.coalesce(after < F.col("end_ms"), F.lit(False)),
    })
    there = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    codes = issue_codes([
        ("no_speech_label", F.coalesce(F.col("text"), F.lit("")) == ""), ("missing_or_invalid_source_timestamps", ~there), ("invalid_source_interval", there & ~F.col("__valid")),
        ("source_interval_out_of_bounds", F.col("__valid") & (frames_of(F.col("end_ms")) > F.col("frames"))), ("paragraph_exceeds_max_duration", F.col("__valid") & ((F.col("end_ms") - F.col("start_ms")) / 1000 > most_seconds)),
        ("unordered_source_timestamps", F.col("__valid") & (F.col("__back") | F.col("__ahead"))), ("overlapping_source_timestamps", F.col("__valid") & F.col("__over")),
    ])
    return marks.withColumn("issues", codes).drop("__valid", "__back", "__ahead", "__over")


def metadata_warnings(stated_ms: Column, seconds: Column) -> Column:
    """What is wrong with a recording's stated duration."""
    finite = stated_ms.isNotNull() & ~F.isnan(stated_ms) & (F.abs(stated_ms) != F.lit(float("inf")))
    return issue_codes([("missing_note_duration_metadata", ~finite), ("stale_note_duration_metadata", finite & (F.abs(stated_ms / 1000 - seconds) > 0.5))])


def drop_equal_audio(rows: DataFrame, key: str) -> DataFrame:
    """rows with exact_duplicate_audio on all members of a group of equal keys."""
    several = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = rows.join(several, key, "left")
    return joined.select(*rows.columns, issue_codes([("exact_duplicate_audio", F.col("__n").isNotNull())]).alias("duplicate_issues"))


# whole recordings


def recording_issues(near_silent: Column, clipped: Column, rms: Column, unknown_brackets: Column) -> Column:
    """The constants that hold of every recording without times, and what its samples and transcript show."""
    always = [(c, F.lit(True)) for c in ("no_source_timestamps", "transcript_accuracy_unverified", "speaker_identity_unverified")]
    return issue_codes([
        *always, ("high_near_silence_sample_fraction", near_silent > NEAR_SILENT), ("clipping_review_required", clipped > CLIPPED), ("low_audio_level_review_required", rms < LOW_LEVEL),
        ("unrecognized_bracket_content_preserved", F.size(unknown_brackets) > 0),
    ])


# held-out data


def refuse_held_out(df: DataFrame, split: str = "split", path: str | None = None) -> DataFrame:
    """df, whose evaluation fails at the first held-out row; path is the manifest's, whose name may not be that of a held-out one."""
    if path is not None and path.rstrip("/").rsplit("/", 1)[-1].lower() in ("test.jsonl", "held_out_test.jsonl"):
        raise ValueError("held-out data must not be read for training")
    bad = F.raise_error(F.lit("a held-out row among the rows for training")).cast("boolean")
    return df.where(F.when(F.coalesce(F.col(split) == "test", F.lit(False)), bad).otherwise(F.lit(True)))


def leaks(held: DataFrame, others: dict[str, DataFrame], keys: list[str], row_id: str) -> DataFrame:
    """(row_id, split, leaked_key) for each key whose value also stands in another split.

    Each table is read once: its keys become rows (key, value), the other splits' are combined to the set of splits that have them, and the held-out rows meet those once.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("leaked_key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("p")
    known = [other.select(pairs).select("p.*", F.lit(name).alias("split")) for name, other in others.items()]
    known = reduce(DataFrame.unionByName, known).where("value IS NOT NULL").groupBy("leaked_key", "value").agg(F.collect_set("split").alias("splits"))
    mine = held.select(row_id, pairs).select(row_id, "p.*").where("value IS NOT NULL")
    return mine.join(known, ["leaked_key", "value"]).select(row_id, F.explode("splits").alias("split"), "leaked_key")


def quoted(examples: DataFrame, recordings: DataFrame, parts: DataFrame) -> DataFrame:
    """examples (recording_id, start, original, other) with outcome: whether recordings (recording_id, text) still have the original and the recording's
    part that begins at start (parts: recording_id, start, text) the other quote; of parts that begin together the first by text counts.

    no_recording, no_part, stale_original and stale_other say what is wrong, in that order; otherwise quoted. Null quotes are in nothing.
    """
    whole = recordings.select("recording_id", F.col("text").alias("__text"), F.lit(True).alias("__known"))
    first = parts.groupBy("recording_id", "start").agg(F.min("text").alias("__part"), F.lit(True).alias("__there"))
    has = lambda text, quote: F.coalesce(F.contains(text, quote), F.lit(False))
    outcome = (
        F.when(F.col("__known").isNull(), "no_recording").when(F.col("__there").isNull(), "no_part")
        .when(~has(F.col("__text"), F.col("original")), "stale_original").when(~has(F.col("__part"), F.col("other")), "stale_other").otherwise("quoted")
    )
    return examples.join(whole, "recording_id", "left").join(first, ["recording_id", "start"], "left").withColumn("outcome", outcome).select(*examples.columns, "outcome")


def mismatched_inputs(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and differs: rows of two runs over the same inputs that only one run has ("missing"), or whose columns aren't equal, null-safely."""
    both = left.select(key, F.struct(*columns).alias("__l")).join(right.select(key, F.struct(*columns).alias("__r")), key, "full_outer")
    differs = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.array(F.lit("missing"))).otherwise(issue_codes([(c, ~F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}"))) for c in columns]))
    return both.select(key, differs.alias("differs")).where(F.size("differs") > 0)


def decode_issues(tokens: Column, budget: int, repeated: Column) -> Column:
    """Codes of a decoded text: as many tokens as it might have, a sequence repeated over and over."""
    return issue_codes([("generation_token_limit", tokens >= budget), ("consecutive_repetition", F.coalesce(repeated, F.lit(False)))])


# payloads


def extra_columns(payload: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object beyond those that are allowed; null where it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(payload), F.array(*(F.lit(a) for a in allowed))))


NOTE = T.StructType([T.StructField("title", T.StringType()), T.StructField("bullets", T.ArrayType(T.StringType())), T.StructField("cleaned", T.StringType())])


def note_violations(text: Column) -> Column:
    """Codes of what is wrong with a written note, JSON of title, bullets and cleaned."""
    note = F.from_json(text, NOTE)
    good = lambda c, most: F.coalesce((F.trim(c) != "") & (F.length(c) <= most), F.lit(False))
    whole = F.coalesce(F.try_parse_json(text).isNotNull() & text.rlike("^\\s*\\{"), F.lit(False))
    bullets = note["bullets"]
    return issue_codes([
        ("not_an_object", ~whole), ("title", ~good(note["title"], 120)), ("cleaned", ~good(note["cleaned"], 10000)), ("bullet_count", ~F.coalesce(F.size(bullets).between(1, 6), F.lit(False))),
        ("bullet", ~F.coalesce(F.forall(bullets, lambda b: good(b, 1500)), F.lit(False))),
        ("summary", F.coalesce(F.length(F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("• "), F.trim(b))), "\n")) > 6000, F.lit(False))),
    ])


def differing_children(children: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """children whose parent is missing or has another value, null-safely, in one of the columns: with those columns."""
    p = parents.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__there"))
    wrong = F.when(F.col("__there").isNull(), F.array(F.lit("missing"))).otherwise(issue_codes([(c, ~F.col(c).eqNullSafe(F.col(f"__{c}"))) for c in columns]))
    return children.join(p, key, "left").withColumn("differs", wrong).where(F.size("differs") > 0).select(*children.columns, "differs")


def review_outcomes(reviews: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """reviews with outcome: unknown (no such segment), stale (the segment has other hashes), invalid_status, or their status. keys: the id, then the hashes."""
    known = segments.select(F.col(keys[0]), *(F.col(k).alias(f"__{k}") for k in keys[1:]), F.lit(True).alias("__there"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys[1:]))
    outcome = F.when(F.col("__there").isNull(), "unknown").when(~same, "stale").when(~F.coalesce(F.col("status").isin("approved", "rejected"), F.lit(False)), "invalid_status").otherwise(F.col("status"))
    return reviews.join(known, keys[0], "left").withColumn("outcome", outcome).select(*reviews.columns, "outcome")
