"""Queries over ordered rows: gaps, overlaps, sessions, packing, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import signal as S
from textloom.functions import text as X
from textloom.operators import ordered as O  # noqa: E741
from textloom.plans.registry import query, table


def event_intervals(spark, sf_dir):
    """Events as intervals of value minutes, in whole microseconds."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + F.floor(F.col("value") * 60_000_000)).cast("long").alias("end"))


_IV = "WITH i AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e FROM events) "


@query(_IV.rstrip() + """, f AS (SELECT *, coalesce(s - lag(s) OVER w > 86400000000, false) AS hit FROM i WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT event_id, hit OR coalesce(lead(hit) OVER (PARTITION BY user_id ORDER BY s, event_id), false) AS gap FROM f""")
def event_gaps(spark, sf_dir):
    """Both neighbours of a gap of more than a day."""
    ev = event_intervals(spark, sf_dir)
    return O.neighbours_flagged(ev, ["user_id"], ["start", "event_id"], lambda prev: F.col("start") - prev("start") > 86_400_000_000, "gap").select("event_id", "gap")


@query(_IV + "SELECT DISTINCT a.event_id FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.s < b.e AND b.s < a.e")
def interval_overlaps(spark, sf_dir):
    return O.overlapping(event_intervals(spark, sf_dir), ["user_id"], "start", "end", "event_id").where("overlaps").select("event_id")


@query("""SELECT e.event_id, p.event_id AS previous_event_id, p.value AS previous_value FROM (SELECT * FROM events WHERE event_type = 'error') e
LEFT JOIN LATERAL (SELECT event_id, value FROM events q WHERE q.event_type = 'purchase' AND q.user_id = e.user_id AND q.ts < e.ts ORDER BY q.ts DESC, q.event_id DESC LIMIT 1) p ON true""")
def asof_previous(spark, sf_dir):
    """The last purchase before each error of a user."""
    ev = table(spark, sf_dir, "events")
    left = ev.where("event_type = 'error'").select("user_id", "ts", "event_id")
    right = ev.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    # event_id serves as tie and as value: it is carried under both names
    got = O.latest_before(left, right.withColumn("other_id", F.col("event_id")), ["user_id"], "ts", ["other_id", "value"], "event_id")
    return got.select("event_id", F.col("previous_other_id").alias("previous_event_id"), "previous_value")


@query("""WITH b AS (SELECT doc_id, n_chars, i, i * n_chars // 4 AS s, (i + 1) * n_chars // 4 AS e FROM documents, unnest(range(0, 4)) AS u(i) WHERE NOT (doc_id % 10 = 3 AND i = 2) AND NOT (doc_id % 10 = 4 AND i = 3)),
w AS (SELECT *, lag(e) OVER x AS p, lead(s) OVER x AS n FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY s, e)),
r AS (SELECT doc_id, s AS "start", CASE WHEN e <= s THEN 'empty' WHEN p IS NULL AND s <> 0 THEN 'starts_late' WHEN p IS NOT NULL AND s > p THEN 'gap_before' WHEN p IS NOT NULL AND s < p THEN 'overlap_before' WHEN n IS NULL AND e <> n_chars THEN 'ends_short' END AS reason FROM w)
SELECT * FROM r WHERE reason IS NOT NULL""")
def coverage_check(spark, sf_dir):
    """Even quarters of documents, with some left out: what doesn't tile the whole."""
    bounds = X.even_bounds(F.col("n_chars"), 4)
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.posexplode(F.arrays_zip(F.slice(bounds, 1, 4).alias("s"), F.slice(bounds, 2, 4).alias("e"))).alias("i", "b"))
    rows = rows.select("doc_id", "n_chars", "i", F.col("b.s").alias("start"), F.col("b.e").alias("end")).where("NOT (doc_id % 10 = 3 AND i = 2) AND NOT (doc_id % 10 = 4 AND i = 3)")
    return O.uncovered(rows, ["doc_id"], "start", "end", "n_chars").select("doc_id", "start", "reason")


def _tumbling(seconds):
    return f"SELECT epoch_us(ts) // {seconds}000000 * {seconds} AS window_start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL"


def _windows(spark, sf_dir, size):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = ev.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "events", "total")


@query(_tumbling(20))
def tumbling_20s(spark, sf_dir):
    return _windows(spark, sf_dir, "20 seconds")


@query(_tumbling(86400))
def tumbling_1d(spark, sf_dir):
    return _windows(spark, sf_dir, "1 day")


def _sessions_sql(gap):
    return f"""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL {gap}, true) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS last_event, CAST(count(*) AS BIGINT) AS events FROM s GROUP BY user_id, n"""


def _sessions(spark, sf_dir, gap):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = ev.groupBy("user_id", F.session_window("ts", gap)).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.unix_micros("session_window.start").alias("session_start"), F.unix_micros("last").alias("last_event"), "events")


@query(_sessions_sql("30 MINUTE"))
def session_30m(spark, sf_dir):
    return _sessions(spark, sf_dir, "30 minutes")


@query(_sessions_sql("6 HOUR"))
def session_6h(spark, sf_dir):
    return _sessions(spark, sf_dir, "6 hours")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, 0 AS block, n + 20 AS used FROM t WHERE k = 1
UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN f.used + t.n + 20 <= 1500 THEN f.block ELSE f.block + 1 END, CASE WHEN f.used + t.n + 20 <= 1500 THEN f.used + t.n + 20 ELSE t.n + 20 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id, turn, CAST(block AS INT) AS block FROM f""")
def greedy_blocks(spark, sf_dir):
    """Turns go into blocks of 1500 characters at most, 20 more for each; turns are a second apart, so time never splits."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(0).cast("long").alias("at"), F.length("text").cast("long").alias("size"))
    return O.greedy_blocks(rows, ["conv_id"], ["turn"], 20, 1500, 20).select("conv_id", "turn", "block")


@query("""WITH RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, 0 AS block, s AS since FROM t WHERE k = 1
UNION ALL SELECT t.user_id, t.event_id, t.k, CASE WHEN t.s - f.since < 86400000000 THEN f.block ELSE f.block + 1 END, CASE WHEN t.s - f.since < 86400000000 THEN f.since ELSE t.s END FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1)
SELECT event_id, CAST(block AS INT) AS block FROM f""")
def timed_blocks(spark, sf_dir):
    """Events of a user go into blocks that span less than a day each; here only time splits."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(0).cast("long").alias("size"))
    return O.greedy_blocks(rows, ["user_id"], ["at", "event_id"], 1, 1 << 60, 86_400_000_000).select("event_id", "block")


@query("""WITH RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 3600000000) AS BIGINT) AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, true AS kept, e AS until FROM t WHERE k = 1
UNION ALL SELECT t.user_id, t.event_id, t.k, t.s >= f.until, CASE WHEN t.s >= f.until THEN t.e ELSE f.until END FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1)
SELECT event_id, kept FROM f""")
def self_gated_nonoverlap(spark, sf_dir):
    """Greedy choice of disjoint intervals: each is kept if it starts after the last kept one ends."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    end = (start + F.floor(F.col("value") * 3_600_000_000)).cast("long")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("start"), end.alias("end"))
    return O.disjoint(rows, ["user_id"], ["start", "event_id"]).select("event_id", "kept")


@query("""WITH RECURSIVE t AS MATERIALIZED (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_id, k, true AS kept, e AS until FROM t WHERE k = 1
UNION ALL SELECT t.event_id, t.k, t.s >= f.until, CASE WHEN t.s >= f.until THEN t.e ELSE f.until END FROM f JOIN t ON t.k = f.k + 1)
SELECT event_id, kept FROM f""")
def one_chain(spark, sf_dir):
    """The same over all events as one key: a chain whose rows no single task holds, by searches and pointer doubling."""
    return O.disjoint(event_intervals(spark, sf_dir).withColumn("all", F.lit(0)), ["all"], ["start", "event_id"], key_rows=0).select("event_id", "kept")


@query("""WITH RECURSIVE t AS MATERIALIZED (SELECT event_id, epoch_us(ts) AS s, CAST(floor(value) AS BIGINT) + 20 AS need, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_id, k, 0 AS block, s AS since, need AS used FROM t WHERE k = 1
UNION ALL SELECT t.event_id, t.k, CASE WHEN f.used + t.need <= 6400 AND t.s - f.since < 86400000000 THEN f.block ELSE f.block + 1 END, CASE WHEN f.used + t.need <= 6400 AND t.s - f.since < 86400000000 THEN f.since ELSE t.s END,
CASE WHEN f.used + t.need <= 6400 AND t.s - f.since < 86400000000 THEN f.used + t.need ELSE t.need END FROM f JOIN t ON t.k = f.k + 1)
SELECT event_id, CAST(block AS INT) AS block FROM f""")
def one_chain_blocks(spark, sf_dir):
    """Blocks of all events as one key, by size and time."""
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("all"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.floor("value").cast("long").alias("size"))
    return O.greedy_blocks(rows, ["all"], ["at", "event_id"], 20, 6400, 86_400_000_000, key_rows=0).select("event_id", "block")


@query("""WITH k AS (SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 5 <> 3), p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM k)
SELECT conv_id, turn, CASE WHEN prev IS NULL THEN 'starts_late' ELSE 'gap' END AS violation FROM p WHERE (prev IS NULL AND turn <> 0) OR turn <> prev + 1""")
def sequence_audit(spark, sf_dir):
    """Turns that don't follow their predecessor by one, with some removed first."""
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn").where("(conv_id + turn) % 5 <> 3")
    prev = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    bad = F.when(prev.isNull() & (F.col("turn") != 0), "starts_late").when(F.col("turn") != prev + 1, "gap")
    return k.withColumn("violation", bad).where("violation IS NOT NULL")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def latest_per_key(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("value", at).alias("value"))


@query("""WITH r AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, min(value) AS loss FROM events GROUP BY ALL)
SELECT day, loss, min(loss) OVER (ORDER BY day) AS best_so_far, coalesce(loss < min(loss) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improves FROM r""")
def running_best(spark, sf_dir):
    """The best value up to each epoch; the window spans all days, which are few whatever the events."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    r = table(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.min("value").alias("loss"))
    w = Window.orderBy("day")
    before = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return r.select("day", "loss", F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best_so_far"), F.coalesce(F.col("loss") < before, F.lit(True)).alias("improves"))


@query("""WITH RECURSIVE v AS (SELECT doc_id, CAST(0 AS BIGINT) AS s, n_chars * 10 AS e, 0 AS depth FROM documents
UNION ALL SELECT doc_id, CASE h WHEN 0 THEN s ELSE (s + e) // 2 END, CASE h WHEN 0 THEN (s + e) // 2 ELSE e END, depth + 1 FROM v, unnest([0, 1]) AS u(h) WHERE (s + e * 7) % 3 = 0 AND depth < 3 AND (s + e) // 2 - s >= 300 AND e - (s + e) // 2 >= 300)
SELECT doc_id, s AS "start", e AS "end", depth, (s + e * 7) % 3 = 0 AS unresolved FROM v WHERE NOT ((s + e * 7) % 3 = 0 AND depth < 3 AND (s + e) // 2 - s >= 300 AND e - (s + e) // 2 >= 300)""")
def bisect_intervals(spark, sf_dir):
    """Intervals that fail a test are halved, three times at most, down to 300."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).cast("long").alias("start"), (F.col("n_chars") * 10).alias("end"))
    return O.bisected(rows, "start", "end", lambda s, e: (s + e * 7) % 3 == 0, depth=3, least=300)


@query("""SELECT vec_id, CAST(i // 16 AS BIGINT) AS packet, CAST(count(*) AS BIGINT) AS samples, bool_or(i = len(embedding) - 1) AS final FROM embeddings, unnest(range(0, len(embedding))) AS u(i) GROUP BY vec_id, i // 16""")
def sample_packets(spark, sf_dir):
    """Samples in packets of a fixed size; the last packet is final and may be short."""
    starts = F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(16))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode(starts).alias("packet", "s"))
    return rows.select("vec_id", F.col("packet").cast("long").alias("packet"), F.least(F.lit(16), F.col("n") - F.col("s")).cast("long").alias("samples"), (F.col("s") + 16 >= F.col("n")).alias("final"))


_REACH = -(-S.HALF * 3 // 2)


@query(f"""WITH v AS (SELECT vec_id, embedding AS x, len(embedding) AS n, unnest(range((len(embedding) * 2 + 2) // 3)) AS i FROM embeddings),
w AS (SELECT vec_id, i, x[1 + least(greatest(j, 0), n - 1)]::DOUBLE AS x, j - i * 1.5::DOUBLE AS p FROM (SELECT *, unnest(range(i * 3 // 2 - {_REACH} + 1, i * 3 // 2 + {_REACH} + 1)) AS j FROM v)),
h AS (SELECT vec_id, i, x, CASE WHEN abs(p) >= {_REACH} THEN 0 ELSE CASE WHEN p = 0 THEN 1 ELSE sin(pi() * {S.EDGE} / 1.5 * p) / (pi() * {S.EDGE} / 1.5 * p) END
* ({S.WINDOW[0]} - {S.WINDOW[1]} * cos(pi() * (p / {_REACH} + 1)) + {S.WINDOW[2]} * cos(2 * pi() * (p / {_REACH} + 1)) - {S.WINDOW[3]} * cos(3 * pi() * (p / {_REACH} + 1))) END AS h FROM w)
SELECT vec_id, CAST(i AS BIGINT) AS place, round(sum(x * h) / sum(h), 6) + 0.0 AS sample FROM h GROUP BY vec_id, i""")
def resampled_packets(spark, sf_dir):
    """Vectors as signals in packets of 16 samples, at two thirds of their rate: the filter's taps are carried from packet to packet."""
    starts = F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(16))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.posexplode(starts).alias("packet", "s"))
    rows = rows.select("vec_id", "packet", F.transform(F.slice("embedding", F.col("s") + 1, F.lit(16)), lambda x: x.cast("double")).alias("samples"))
    found = S.resampled_frames(rows, ["vec_id"], ["packet"], "samples", 3, 2)
    whole = found.groupBy("vec_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("packet", "resampled"))), lambda x: x["resampled"])).alias("x"))
    return whole.select("vec_id", F.posexplode("x").alias("place", "sample")).select("vec_id", F.col("place").cast("long").alias("place"), (F.round("sample", 6) + 0.0).alias("sample"))
