"""Queries of the rules for clips, source times, recordings, payloads and guards, over stand-ins made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import rules as U
from textloom.plans.registry import query, table

_CLIPS = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS tt, value, event_type FROM events),
b AS (SELECT *, tt - tt % 60 AS c0, value / 4 + 0.05 AS f0, value / 4 + value / 3 AS l0 FROM e),
d AS (SELECT *, greatest(round_even(c0 * 16000, 0), round_even(c0 * 16000, 0) + round_even((f0 - 0.03) * 16000, 0)) / 16000 AS a, least(round_even((c0 + 60) * 16000, 0), round_even(c0 * 16000, 0) + round_even((l0 + 0.03) * 16000, 0)) / 16000 AS z FROM b),
i AS (SELECT *, list_filter([CASE WHEN f0 < 0.08 OR l0 > 60 - 0.08 THEN 'alignment_touches_context_boundary' END, CASE WHEN NOT (z - a BETWEEN 1 AND 32) THEN 'clip_duration_out_of_bounds' END,
CASE WHEN NOT (event_id % 60 / greatest(z - a, 0.001) BETWEEN 1 AND 22) THEN 'implausible_text_rate' END, CASE WHEN event_id % 997 / 1000.0 < 0.0005 THEN 'near_silent_audio' END, CASE WHEN event_id % 89 / 1000.0 > 0.08 THEN 'excessive_clipping' END], lambda x: x IS NOT NULL) AS own, event_type <> 'error' AS eligible FROM d),
k AS (SELECT *, event_id % 7 AS rs, event_id % 7 + 3 AS re, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM i),
f AS (SELECT user_id, event_id, k, CASE WHEN eligible THEN own ELSE [] END AS issues, CASE WHEN eligible AND len(own) = 0 THEN z END AS until_a, CASE WHEN eligible AND len(own) = 0 THEN re END AS until_r FROM k WHERE k = 1
UNION ALL SELECT user_id, event_id, k, CASE WHEN eligible THEN list_concat(own, found) ELSE [] END, CASE WHEN eligible AND len(own) + len(found) = 0 THEN z ELSE until_a END, CASE WHEN eligible AND len(own) + len(found) = 0 THEN re ELSE until_r END
FROM (SELECT k.*, f.until_a, f.until_r, list_filter([CASE WHEN k.a < f.until_a THEN 'overlapping_audio' END, CASE WHEN k.rs < f.until_r THEN 'overlapping_reference_span' END], lambda x: x IS NOT NULL) AS found FROM f JOIN k ON k.user_id = f.user_id AND k.k = f.k + 1))"""


def _clips(spark, sf_dir):
    """Events as clips of contexts of a minute."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", at.alias("at"))
    c0 = F.col("at") - F.col("at") % 60
    return e.select(
        "event_id", "user_id", c0.alias("context_start"), (c0 + 60).alias("context_end"), (F.col("value") / 4 + 0.05).alias("first_start"), (F.col("value") / 4 + F.col("value") / 3).alias("last_end"),
        (F.col("event_id") % 60).alias("chars"), (F.col("event_id") % 997 / 1000.0).alias("rms"), F.when(F.col("event_id") % 89 > 80, 0.5).otherwise(0.0).alias("clipped"),
        (F.col("event_id") % 7).alias("reference_start"), (F.col("event_id") % 7 + 3).alias("reference_end"), (F.col("event_type") != "error").alias("eligible"),
    )


@query(_CLIPS + " SELECT event_id, CAST(round(a * 16000) AS BIGINT) AS first_sample, CAST(round(z * 16000) AS BIGINT) AS last_sample, issues FROM f JOIN d USING (event_id)")
def clip_audit(spark, sf_dir):
    """Issue codes of clips, overlaps with the last good one before included."""
    return U.clip_issues(_clips(spark, sf_dir), "user_id", "event_id").select("event_id", F.round(F.col("audio_start") * 16000).cast("long").alias("first_sample"), F.round(F.col("audio_end") * 16000).cast("long").alias("last_sample"), "issues")


_SPLIT = "CASE event_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


@query(f"""WITH e AS (SELECT event_id, user_id || event_type AS pcm, {_SPLIT} AS split FROM events),
w AS (SELECT *, event_id = min(event_id) OVER p AS is_first, min(split) OVER p <> max(split) OVER p AS mixed, count(*) OVER p AS n FROM e WINDOW p AS (PARTITION BY pcm))
SELECT event_id, list_filter([CASE WHEN n > 1 AND NOT is_first THEN 'duplicate_audio' END, CASE WHEN n > 1 AND is_first AND mixed THEN 'duplicate_audio_across_splits' END], lambda x: x IS NOT NULL) AS issues FROM w""")
def duplicate_clips(spark, sf_dir):
    """Equal audio: all but the first go, and the first too where a later one is of another split."""
    split = F.when(F.col("event_id") % 10 == 0, "test").when(F.col("event_id") % 10 == 1, "validation").otherwise("train")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.col("user_id").cast("string"), "event_type").alias("pcm"), split.alias("split"))
    return U.duplicate_clips(rows, "pcm", "event_id", "split").select("event_id", F.col("duplicate_issues").alias("issues"))


_TIMES = """WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 13 = 4 THEN '' ELSE text END AS text, CASE WHEN (conv_id * 3 + turn) % 17 = 5 THEN NULL ELSE turn * 20000 + (conv_id * 7919 + turn * 104729) % 30000 END AS s FROM conversations),
u AS (SELECT *, CASE WHEN (conv_id + turn) % 19 = 3 THEN s - 5 WHEN (conv_id + turn) % 23 = 7 THEN s + 95000 ELSE s + 15000 END AS e, 16 * 120000 AS frames FROM t),
v AS (SELECT *, coalesce(s >= 0 AND s < e, false) AS ok FROM u),
o AS (SELECT v.*, coalesce(s < lag(s) OVER w, false) OR coalesce(lead(s) OVER w < s, false) AS disorder FROM v WINDOW w AS (PARTITION BY conv_id, ok ORDER BY turn)),
x AS (SELECT o.*, EXISTS (SELECT 1 FROM v b WHERE b.conv_id = o.conv_id AND b.turn <> o.turn AND b.ok AND b.s < o.e AND o.s < b.e) AS meets FROM o)
SELECT conv_id, turn, list_filter([CASE WHEN text = '' THEN 'no_speech_label' END, CASE WHEN s IS NULL THEN 'missing_or_invalid_source_timestamps' END, CASE WHEN s IS NOT NULL AND NOT ok THEN 'invalid_source_interval' END,
CASE WHEN ok AND e * 16 > frames THEN 'source_interval_out_of_bounds' END, CASE WHEN ok AND (e - s) / 1000 > 90 THEN 'paragraph_exceeds_max_duration' END, CASE WHEN ok AND disorder THEN 'unordered_source_timestamps' END, CASE WHEN ok AND meets THEN 'overlapping_source_timestamps' END], lambda x: x IS NOT NULL) AS issues FROM x"""


@query(_TIMES)
def source_times(spark, sf_dir):
    """Turns as paragraphs with times of their own, some missing, reversed, too long, out of order or overlapping."""
    c, t = F.col("conv_id"), F.col("turn")
    start = F.when((c * 3 + t) % 17 != 5, t * 20000 + (c * 7919 + t * 104729) % 30000)
    end = F.when((c + t) % 19 == 3, start - 5).when((c + t) % 23 == 7, start + 95000).otherwise(start + 15000)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((c + t) % 13 == 4, "").otherwise(F.col("text")).alias("text"), start.alias("start_ms"), end.alias("end_ms"), F.lit(16 * 120000).alias("frames"))
    return U.interval_issues(rows, "conv_id", "turn").select("conv_id", "turn", "issues")


@query("""SELECT o_orderkey, list_filter([CASE WHEN m IS NULL THEN 'missing_note_duration_metadata' END, CASE WHEN m IS NOT NULL AND abs(m / 1000 - s) > 0.5 THEN 'stale_note_duration_metadata' END], lambda x: x IS NOT NULL) AS warnings,
abs(s + o_orderkey % 5 / 10.0 - s) > greatest(0.25, 0.001 * s) AS differs FROM (SELECT o_orderkey, o_custkey::DOUBLE AS s, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey * 1000.0::DOUBLE + o_orderkey % 4 * 300 END AS m FROM orders)""")
def duration_checks(spark, sf_dir):
    """Stated durations that are missing or stale, and decoded ones beyond their tolerance."""
    k, s = F.col("o_orderkey"), F.col("o_custkey").cast("double")
    stated = F.when(k % 7 != 0, s * 1000.0 + k % 4 * 300)
    return table(spark, sf_dir, "orders").select("o_orderkey", U.metadata_warnings(stated, s).alias("warnings"), U.durations_differ(s + k % 5 / 10.0, s).alias("differs"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
m AS (SELECT vec_id, len(list_filter(e, lambda v: abs(v) < 0.05)) / len(e) AS quiet, len(list_filter(e, lambda v: abs(v) >= 0.3)) / len(e) AS clipped, CASE WHEN vec_id % 9 = 0 THEN 0.002 ELSE 0.1 END AS rms, CASE WHEN vec_id % 4 = 0 THEN ['x'] ELSE [] END AS unknown FROM x)
SELECT vec_id, list_filter(['no_source_timestamps', 'transcript_accuracy_unverified', 'speaker_identity_unverified', CASE WHEN quiet > 0.5 THEN 'high_near_silence_sample_fraction' END, CASE WHEN clipped > 0.001 THEN 'clipping_review_required' END,
CASE WHEN rms < 0.003 THEN 'low_audio_level_review_required' END, CASE WHEN len(unknown) > 0 THEN 'unrecognized_bracket_content_preserved' END], lambda x: x IS NOT NULL) AS issues FROM m""")
def recording_audit(spark, sf_dir):
    """Issue codes of whole recordings, vectors standing for their samples."""
    e = F.col("embedding").cast("array<double>")
    share = lambda rule: F.size(F.filter(e, rule)) / F.size(e)
    unknown = F.when(F.col("vec_id") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    codes = U.recording_issues(share(lambda v: F.abs(v) < 0.05), share(lambda v: F.abs(v) >= 0.3), F.when(F.col("vec_id") % 9 == 0, 0.002).otherwise(0.1), unknown)
    return table(spark, sf_dir, "embeddings").select("vec_id", codes.alias("issues"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'clips/c' || o_orderkey || '.wav' ELSE 'lectures/l' || o_custkey || '.wav#t=' || printf('%.6f,%.6f', o_orderkey / 8.0, o_orderkey / 8.0 + 2.5) END AS audio,
CAST(o_orderkey * 16 AS BIGINT) AS frames, CAST(o_orderkey AS BIGINT) AS samples, o_orderkey % 2 = 0 AS whole, round(o_custkey / greatest(o_orderkey % 5 / 2.0, 0.001), 4) AS rate FROM orders""")
def audio_places(spark, sf_dir):
    """Where each row's audio is, and its times in frames and samples."""
    k = F.col("o_orderkey")
    clip, recording, start = F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"))), F.concat(F.lit("l"), F.col("o_custkey").cast("string")), k / 8.0
    seconds = (k + k % 2 * 0.3) / 16000.0
    rate = F.round(U.text_rate(F.col("o_custkey"), k % 5 / 2.0), 4)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", U.locator(clip, recording, start, start + 2.5).alias("audio"), U.frames_of(k).alias("frames"), U.samples_of(seconds).alias("samples"), U.on_grid(seconds).alias("whole"), rate.alias("rate")
    )


@query("""SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') AND trim(substr(p_type, 9)) <> '' THEN substr(p_type, 9) END AS rest FROM part""")
def prefix_rest(spark, sf_dir):
    """Texts behind a prefix that they must have."""
    return table(spark, sf_dir, "part").select("p_partkey", U.without_prefix(F.col("p_type"), "STANDARD").alias("rest"))


@query("""WITH n AS (SELECT doc_id, left(split_part(text, chr(10), 1), 200) AS title, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS bullets, text FROM documents),
v AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 9 = 0 THEN 'not_an_object' END, CASE WHEN doc_id % 9 = 0 OR trim(title) = '' OR length(title) > 120 THEN 'title' END, CASE WHEN doc_id % 9 = 0 OR trim(text) = '' OR length(text) > 10000 THEN 'cleaned' END,
CASE WHEN doc_id % 9 = 0 OR NOT len(bullets) BETWEEN 1 AND 6 THEN 'bullet_count' END, CASE WHEN doc_id % 9 = 0 OR len(list_filter(bullets, lambda b: length(b) > 1500)) > 0 THEN 'bullet' END,
CASE WHEN doc_id % 9 <> 0 AND list_sum(list_transform(bullets, lambda b: length(trim(b)) + 2)) + len(bullets) - 1 > 6000 THEN 'summary' END], lambda x: x IS NOT NULL) AS violations FROM n)
SELECT * FROM v WHERE len(violations) > 0""")
def note_validation(spark, sf_dir):
    """Documents as written notes, some of them no JSON: what is wrong with them."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    note = F.to_json(F.struct(F.left(F.substring_index("text", "\n", 1), F.lit(200)).alias("title"), lines.alias("bullets"), F.col("text").alias("cleaned")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("[1")).otherwise(note).alias("note"))
    return rows.select("doc_id", U.note_violations(F.col("note")).alias("violations")).where(F.size("violations") > 0)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['extra'] ELSE [] END AS extra FROM events WHERE props IS NOT NULL""")
def closed_columns(spark, sf_dir):
    """Keys of payloads beyond those that are allowed."""
    payload = F.to_json(F.when(F.col("event_id") % 3 == 0, F.struct(F.lit(1).alias("clip"), F.lit("x").alias("extra"))).otherwise(F.struct(F.lit(1).alias("clip"), F.lit(None).cast("string").alias("extra"))))
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", U.extra_columns(payload, ["clip", "status"]).alias("extra"))


@query("""WITH r AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole FROM conversations WHERE conv_id % 9 <> 4 GROUP BY conv_id),
e AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN turn * 30.0 + 15 ELSE turn * 30.0 END AS start, CASE WHEN conv_id % 5 = 2 THEN reverse(left(text, 25)) ELSE left(text, 25) END AS original,
CASE WHEN turn % 3 = 2 THEN 'x' || right(text, 20) ELSE right(text, 20) END AS other FROM conversations)
SELECT e.conv_id AS recording_id, e.turn, CASE WHEN r.conv_id IS NULL THEN 'no_recording' WHEN p.conv_id IS NULL THEN 'no_part' WHEN NOT contains(whole, original) THEN 'stale_original' WHEN NOT contains(p.text, other) THEN 'stale_other' ELSE 'quoted' END AS outcome
FROM e LEFT JOIN r ON r.conv_id = e.conv_id LEFT JOIN conversations p ON p.conv_id = e.conv_id AND p.turn * 30.0 = e.start""")
def quoted_examples(spark, sf_dir):
    """Examples looked up in their recording by its id, and in its part by the part's start: whether both still quote them."""
    t = table(spark, sf_dir, "conversations").withColumn("recording_id", F.col("conv_id"))
    parts = t.select("recording_id", (F.col("turn") * 30.0).alias("start"), "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    recordings = t.where("conv_id % 9 <> 4").groupBy("recording_id").agg(whole.alias("text"))
    opening, ending = F.left("text", F.lit(25)), F.right("text", F.lit(20))
    examples = t.select(
        "recording_id", "turn", F.when(F.col("turn") % 4 == 3, F.col("turn") * 30.0 + 15).otherwise(F.col("turn") * 30.0).alias("start"),
        F.when(F.col("conv_id") % 5 == 2, F.reverse(opening)).otherwise(opening).alias("original"), F.when(F.col("turn") % 3 == 2, F.concat(F.lit("x"), ending)).otherwise(ending).alias("other"),
    )
    return U.quoted(examples, recordings, parts).select("recording_id", "turn", "outcome")


@query("""WITH l AS (SELECT l_orderkey AS k, min(l_shipdate)::DATE AS day, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), o AS (SELECT l_orderkey AS k, min(l_shipdate)::DATE AS day, count(*) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY 1)
SELECT k, CASE WHEN l.n IS NULL OR o.n IS NULL THEN ['missing'] ELSE list_filter([CASE WHEN l.day IS DISTINCT FROM o.day THEN 'day' END, CASE WHEN l.n <> o.n THEN 'n' END], lambda x: x IS NOT NULL) END AS differs
FROM l FULL JOIN o USING (k) WHERE l.n IS NULL OR o.n IS NULL OR l.day IS DISTINCT FROM o.day OR l.n <> o.n""")
def run_inputs(spark, sf_dir):
    """Two runs' inputs for each order, chosen by two rules: where they aren't the same."""
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey"))
    one = lambda rule: li.where(rule).groupBy("k").agg(F.min("l_shipdate").cast("date").alias("day"), F.count(F.lit(1)).alias("n"))
    return U.mismatched_inputs(one("l_linenumber <= 4"), one("l_quantity > 5"), "k", ["day", "n"])


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0")
def training_rows(spark, sf_dir):
    """Rows for training, read behind the guard against held-out ones."""
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    rows = table(spark, sf_dir, "documents").select("doc_id", split.alias("split")).where("split <> 'test'")
    return U.refuse_held_out(rows, path="manifests/train.jsonl").select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100")
def capped_steps(spark, sf_dir):
    """The first steps of an epoch, up to the cap on steps."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(100)
