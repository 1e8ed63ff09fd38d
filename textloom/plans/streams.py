"""Streaming queries over the tables as file streams; their oracles are the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.plans import ordered, relational  # noqa: F401 (their oracles)
from textloom.plans.ordered import _tumbling
from textloom.plans.registry import ORACLES, query
from textloom.sources.shared import shared_path, stored
from textloom.operators import sketches as K
from textloom.streaming import clocked as C
from textloom.streaming.run import coalesced_previews, drained, in_parts, saved_revisions, stream_of
from textloom.streaming.table_functions import register_all
from textloom.streaming.segments import block_stream, endpoint_stream, ingest_stream, overlap_stream, packet_stream, segment_stream


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def stream_upsert(spark, sf_dir):
    """The latest row of each key, updated in place."""
    ev = stream_of(spark, sf_dir, "events")
    s = ev.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"))
    out = drained(s, "update", "upsert")
    return out.groupBy("user_id", "event_type").agg(F.max_by("event_id", "batch").alias("event_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    ev = in_parts(_user_events(spark, sf_dir), "ts", 3, "dedupe-events").withColumnRenamed("session", "user_id")
    return drained(ev.dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), "append", "dedupe").drop("batch")


@query(_tumbling(86400))
def stream_windows(spark, sf_dir):
    """Event-time windows with a watermark, in update mode: the last update of each window."""
    ev = in_parts(_user_events(spark, sf_dir), "ts", 3, "window-events").withWatermark("ts", "60 days")
    w = ev.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    s = w.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "events", "total")
    last = F.max_by(F.struct("events", "total"), "batch")
    return drained(s, "update", "windows").groupBy("window_start", "event_type").agg(last.alias("l")).select("window_start", "event_type", "l.events", F.round("l.total", 6).alias("total"))


def _turns(spark, sf_dir, name):
    """Conversations as a stream of several micro-batches, the earlier turns first."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return in_parts(t.withColumn("ts", F.timestamp_seconds("turn")), "ts", 3, name)


@query("""WITH k AS (SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 5 <> 3), c AS (SELECT k.conv_id, turn, copy FROM k, unnest([0, 1]) AS u(copy) WHERE copy = 0 OR turn % 4 = 1),
r AS (SELECT *, (SELECT count(*) FROM k o WHERE o.conv_id = c.conv_id AND o.turn < c.turn) = turn AS reached, (conv_id * 7 + turn) % 13 = 4 AS fails,
coalesce((SELECT min(o.turn) FROM k o WHERE o.conv_id = c.conv_id AND ((o.conv_id * 7 + o.turn) % 13 = 4 OR o.turn = 5)), 99) AS stop FROM c)
SELECT conv_id AS session, turn * 2 + copy AS arrival, turn AS sequence, CASE WHEN NOT reached OR turn > stop OR (fails AND copy = 1) THEN 'refused' WHEN fails THEN 'failed' WHEN copy = 1 THEN 'replayed' ELSE 'accepted' END AS outcome FROM r""")
def stream_ingest(spark, sf_dir):
    """Turns as packets, with some lost, some sent twice, some that fail; the sixth ends a session."""
    t = _turns(spark, sf_dir, "ingest-turns").where("(conv_id + turn) % 5 <> 3")
    copies = F.when(F.col("turn") % 4 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    t = t.select(F.col("conv_id").alias("session"), F.col("turn").alias("sequence"), F.explode(copies).alias("copy"))
    packets = t.select("session", (F.col("sequence") * 2 + F.col("copy")).alias("arrival"), "sequence", (F.col("sequence") == 5).alias("final"), ((F.col("session") * 7 + F.col("sequence")) % 13 == 4).alias("fails"))
    return drained(ingest_stream(packets), "append", "ingest").drop("batch")


@query("""WITH q AS (SELECT event_id AS arrival, user_id AS id, event_type = 'purchase' AS final FROM events)
SELECT arrival, id, final FROM q WHERE final UNION ALL SELECT max(arrival), id, false FROM q WHERE NOT final AND id NOT IN (SELECT id FROM q WHERE final) GROUP BY id""")
def preview_queue(spark, sf_dir):
    """Queued previews of a stream give way to finals and to later previews of their id, in each micro-batch."""
    q = stream_of(spark, sf_dir, "events").select(F.col("event_id").alias("arrival"), F.col("user_id").alias("id"), (F.col("event_type") == "purchase").alias("final"))
    return drained(q, "append", "previews", each=coalesced_previews).drop("batch")


_PACKETS = """WITH RECURSIVE p AS (SELECT conv_id, turn, length(text) / 64.0 AS seconds, turn % 3 = 2 AS silent, turn = max(turn) OVER (PARTITION BY conv_id) AS final, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
n AS (SELECT conv_id, k, 0 AS number, 0.0::DOUBLE AS tt, seconds::DOUBLE AS now, CASE WHEN silent THEN seconds ELSE 0 END::DOUBLE AS quiet, NOT silent AS spoken, final, seconds FROM p WHERE k = 1),
f AS (SELECT conv_id, k, number, tt, now, CASE WHEN final THEN 'final' WHEN spoken AND quiet >= 0.6 THEN 'pause' WHEN quiet >= 1.2 THEN 'silence' WHEN now - tt >= 20 THEN 'length' END AS reason, quiet, spoken FROM n
UNION ALL SELECT conv_id, k, number, tt, now, CASE WHEN final THEN 'final' WHEN spoken AND quiet >= 0.6 THEN 'pause' WHEN quiet >= 1.2 THEN 'silence' WHEN now - tt >= 20 THEN 'length' END, quiet, spoken
FROM (SELECT p.conv_id, p.k, p.final, f.number + (f.reason IS NOT NULL)::INT AS number, CASE WHEN f.reason IS NULL THEN f.tt ELSE f.now END AS tt, f.now + p.seconds AS now,
CASE WHEN p.silent THEN p.seconds + CASE WHEN f.reason IS NULL THEN f.quiet ELSE 0 END ELSE 0 END::DOUBLE AS quiet, NOT p.silent OR (f.reason IS NULL AND f.spoken) AS spoken FROM f JOIN p ON p.conv_id = f.conv_id AND p.k = f.k + 1))
SELECT conv_id AS session, CAST(number AS BIGINT) AS number, round(tt, 6) AS "start", round(now, 6) AS "end", reason FROM f WHERE reason IS NOT NULL"""


def _last_turn(spark, sf_dir):
    """The turns of a stream, with the number of their conversation's last (a batch lookup)."""
    last = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return _turns(spark, sf_dir, "last-turns").join(last, "conv_id")


@query(_PACKETS)
def stream_endpoints(spark, sf_dir):
    """Turns as packets of speech and silence: the stretches that pauses, lengths and ends of sessions close."""
    t = _last_turn(spark, sf_dir)
    packets = t.select(F.col("conv_id").alias("session"), F.col("turn").alias("sequence"), (F.length("text") / 64.0).cast("double").alias("seconds"), (F.col("turn") % 3 == 2).alias("silent"), (F.col("turn") == F.col("last")).alias("final"))
    out = drained(endpoint_stream(packets), "append", "endpoints")
    return out.select("session", "number", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "reason")


@query()
def stream_segments(spark, sf_dir):
    """Turns as blocks of sound, a tenth of a second for every 16 characters: the speech-gated segments of each conversation, the last one ended by the session."""
    t = _last_turn(spark, sf_dir)
    blocks = t.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("sequence"), F.when(F.col("turn") % 4 == 3, 0.0).otherwise(0.1).alias("level"), (F.length("text") * 100).cast("long").alias("size"), (F.col("turn") == F.col("last")).alias("final")
    )
    return drained(segment_stream(blocks), "append", "segments").drop("batch")


@query(ORACLES["greedy_blocks"].replace("SELECT conv_id, turn, CAST(block AS INT) AS block FROM f", "SELECT conv_id AS session, CAST(turn AS BIGINT) AS place, CAST(block AS INT) AS block FROM f"))
def stream_blocks(spark, sf_dir):
    """The greedy blocks of turns, as a stream."""
    t = _turns(spark, sf_dir, "block-turns")
    items = t.select(F.col("conv_id").alias("session"), F.col("turn").alias("place"), F.lit(0.0).alias("seconds"), F.length("text").alias("size"))
    return drained(block_stream(items, most=1500), "append", "blocks").drop("batch")


@query()
def stream_overlaps(spark, sf_dir):
    """Turns that begin with the end of the one before, as a stream: without what they repeat."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    path = shared_path(spark, "overlapping-turns")
    t.withColumn("text", F.concat(F.coalesce(F.right(before, F.lit(40)), F.lit("")), "text")).write.parquet(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return drained(overlap_stream(rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("place"), "text", F.lit(True).alias("final"))), "append", "overlaps").drop("batch")


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY ALL")
def stream_resumed(spark, sf_dir):
    """Counts of a stream whose input comes in two parts, each drained by a run of its own that goes on from the checkpoint of the last."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    path, place = shared_path(spark, "parts"), shared_path(spark, "progress")
    out = None
    for half in (0, 1):
        ev.where(F.col("event_id") % 2 == half).write.mode("append").parquet(path)
        rows = spark.readStream.schema(ev.schema).parquet(path)
        out = drained(rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events")), "update", "resumed", place=place, fingerprint="counts of events")
    return out.groupBy("user_id", "event_type").agg(F.max_by("events", "batch").alias("events"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN 3 WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END AS revision, CASE WHEN doc_id % 3 = 1 THEN 'second' WHEN doc_id % 3 = 2 THEN 'first' ELSE lang END AS value FROM documents")
def stream_revisions(spark, sf_dir):
    """Compare-and-set saves that arrive as a stream, a micro-batch after the other: those that name the stored revision win."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("revision"), F.col("lang").alias("value"))
    rounds = [("doc_id % 3 > 0", 1, "first"), ("doc_id % 3 = 1", 2, "second"), ("doc_id % 3 = 0", 0, "late")]
    path = shared_path(spark, "saves")
    for rule, revision, value in rounds:  # a file, and a micro-batch, each
        docs.where(rule).select(F.col("doc_id").alias("id"), F.lit(revision).alias("revision"), F.lit(value).alias("value")).coalesce(1).write.mode("append").parquet(path)
    return saved_revisions(spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path), stored)


@query(ORACLES["point_in_interval"].replace("SELECT e.event_id, w.window_id", "SELECT e.event_id AS response_id, w.window_id AS request_id"))
def stream_correlation(spark, sf_dir):
    """Responses and the requests of the same key within the hour before them: a stream joined with itself, with watermarks that bound its state."""
    ev = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    requests = ev.where("event_type = 'error'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("request_user"), F.col("ts").alias("asked")).withWatermark("asked", "60 days")
    ev = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    responses = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("response_id"), "user_id", F.col("ts").alias("answered")).withWatermark("answered", "60 days")
    joined = responses.join(requests, F.expr("user_id = request_user AND answered >= asked AND answered < asked + INTERVAL 1 HOUR"))
    return drained(joined.select("response_id", "request_id"), "append", "correlation").drop("batch")


# sessions that the clock ends: rows come in parts, a micro-batch each, and a last tick moves the clock on

HOUR = 3_600_000_000


def _clocked(spark, rows, rule, order, columns, name):
    most, own = int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()
    found = C.clocked(in_parts(rows, "ts", 3, name, tick="400 days", files=min(most, own)), rule, "session", "ts", order, columns)
    # a state's partitions are for good, and each costs a store and a worker in every micro-batch: as many as the input has, or a few
    wanted = min(most, max(8, own))
    return drained(found, "append", name, settings=C.STATE_STORE | {"spark.sql.shuffle.partitions": str(wanted)}).drop("batch")


def _user_events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'purchase' AS final FROM events),
f AS (SELECT *, lag(t) OVER w AS before, lag(final) OVER w AS ended FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT *, sum((before IS NULL OR ended OR t - before >= {6 * HOUR})::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM f)
SELECT user_id AS session, min(t) AS "start", CASE WHEN bool_or(final) THEN max(t) ELSE max(t) + {6 * HOUR} END AS "end", count(*) AS rows, CASE WHEN bool_or(final) THEN 'final' ELSE 'silence' END AS reason FROM g GROUP BY user_id, n""")
def stream_sessions_end(spark, sf_dir):
    """Sessions of users that a purchase ends, or the clock after six hours of silence."""
    rows = _user_events(spark, sf_dir).withColumn("final", F.col("event_type") == "purchase")
    return _clocked(spark, rows, C.silence_rule(6 * HOUR), ["event_id"], ["event_id", "final"], "sessions-end")


def _chain(need: str, most: int, span: int) -> str:
    """Each user's rows in blocks from their first one on, by time and size: begun, and why the block before ended."""
    new, by_time = f"(t.t - f.begun >= {span} OR f.used + t.need > {most})", f"t.t - f.begun >= {span}"
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS t, {need} AS need, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, t AS begun, need AS used, 0 AS n, NULL::BIGINT AS full_at FROM t WHERE k = 1
UNION ALL SELECT t.user_id, t.event_id, t.k, CASE WHEN {new} THEN t.t ELSE f.begun END, CASE WHEN {new} THEN t.need ELSE f.used + t.need END, CASE WHEN {new} THEN f.n + 1 ELSE f.n END,
CASE WHEN {new} AND NOT {by_time} THEN t.t END FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1),
b AS (SELECT user_id, n, begun, count(*) AS items, max(used) AS used, arg_max(event_id, k) AS last, max(full_at) AS full_at FROM f GROUP BY user_id, n, begun),
c AS (SELECT *, lead(full_at) OVER (PARTITION BY user_id ORDER BY n) AS until FROM b)"""


@query(_chain("CAST(floor(value) AS BIGINT) + 20", 300, 24 * HOUR) + f"""
SELECT user_id AS session, begun AS "start", coalesce(until, begun + {24 * HOUR}) AS "end", items, used, CASE WHEN until IS NULL THEN 'time' ELSE 'size' END AS reason FROM c""")
def stream_blocks_close(spark, sf_dir):
    """Events of a user in blocks that close a day after their first one, by the clock, or when the next one doesn't fit."""
    rows = _user_events(spark, sf_dir).withColumn("size", F.floor("value").cast("long"))
    return _clocked(spark, rows, C.block_rule(24 * HOUR, 300), ["event_id"], ["event_id", "size"], "blocks-close")


@query(_chain("CAST(0 AS BIGINT)", 1, 2 * HOUR) + f"""
SELECT user_id AS session, begun + {2 * HOUR} AS saved_at, items AS changes, last AS version FROM c""")
def stream_autosaves(spark, sf_dir):
    """Events as changes of a user's record: saves are due two hours after the first change that isn't saved."""
    rows = _user_events(spark, sf_dir).withColumn("version", F.col("event_id"))
    return _clocked(spark, rows, C.autosave_rule(2 * HOUR), ["event_id"], ["event_id", "version"], "autosaves")


@query("""WITH r AS (SELECT o_custkey AS session, o_orderkey AS request, epoch_us(o_orderdate::TIMESTAMP) AS asked, (SELECT epoch_us(min(l_shipdate)::TIMESTAMP) FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) AS sent FROM orders)
SELECT session, request, asked, CASE WHEN sent < asked + 5184000000000 THEN sent ELSE asked + 5184000000000 END AS ended, CASE WHEN sent < asked + 5184000000000 THEN 'answered' ELSE 'timed_out' END AS outcome FROM r
UNION ALL SELECT session, request, NULL, sent, 'late' FROM r WHERE sent >= asked + 5184000000000""")
def stream_timeouts(spark, sf_dir):
    """Orders as requests of a customer and their first shipment from then on as the answer: those without one in sixty days time out, and their answer, if any, comes late."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    sent = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("sent"))
    answers = orders.join(sent, "id").where("sent >= ts").groupBy("session", "id").agg(F.min("sent").alias("ts")).withColumn("answer", F.lit(True))
    # the joins run once, not for each part
    rows = stored(orders.withColumn("answer", F.lit(False)).unionByName(answers), "timeout-rows")
    return _clocked(spark, rows, C.request_rule(60 * 24 * HOUR), ["answer", "id"], ["id", "answer"], "timeouts")


@query("""WITH s AS (SELECT * FROM (VALUES ('p05', 0.05), ('p50', 0.5), ('p95', 0.95)) v(name, share))
SELECT event_type, name, count(*) AS n, true AS near FROM events, s WHERE value IS NOT NULL GROUP BY event_type, name""")
def stream_quantiles(spark, sf_dir):
    """Quantiles from sketches of each micro-batch, stored and merged: whether each one's rank among all values is as near as sketches promise."""
    shares = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    ev = _user_events(spark, sf_dir)
    rows = in_parts(ev.select("event_type", "value", "ts"), "ts", 4, "quantiles")
    stored = drained(rows, "append", "quantiles", each=lambda batch: K.sketched(batch, ["event_type"], "value"), emits="event_type string, sketch binary")
    found = K.quantiles(K.merged(stored, ["event_type"]), ["event_type"], shares)
    asked = found.select("event_type", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(p).alias("share"), F.col(k).alias("at")) for k, p in shares.items()))).alias("a")).select("event_type", "n", "a.*")
    # a quantile has all ranks between the values below it and those up to it
    ranks = ev.join(asked, "event_type").where("value IS NOT NULL").groupBy("event_type", "name", "share", "n").agg(F.count_if(F.col("value") < F.col("at")).alias("below"), F.count_if(F.col("value") <= F.col("at")).alias("up_to"))
    off = F.greatest(F.col("below") - F.col("share") * F.col("n"), F.col("share") * F.col("n") - F.col("up_to"), F.lit(0.0)) / F.col("n")
    return ranks.select("event_type", "name", "n", (off <= K.RANK_ERROR).alias("near"))


@query(ORACLES["stream_sessions_end"])
def sessions_by_sql(spark, sf_dir):
    """The same sessions by a table function of SQL."""
    register_all(spark)
    _user_events(spark, sf_dir).select("session", F.unix_micros("ts").alias("at"), "event_id", (F.col("event_type") == "purchase").alias("final")).createOrReplaceTempView("session_rows")
    return spark.sql(f"SELECT * FROM sessions_ended(rows => TABLE(session_rows) PARTITION BY session ORDER BY (at, event_id), session => 'session', gap => {6 * HOUR})")


@query(ORACLES["sample_packets"].replace("SELECT vec_id, CAST(i // 16 AS BIGINT) AS packet", "SELECT vec_id AS session, CAST(i // 16 AS BIGINT) AS number").replace("CAST(count(*) AS BIGINT) AS samples", "CAST(count(*) AS BIGINT) AS samples, round(sum(embedding[i + 1]::DOUBLE), 6) + 0.0 AS total"))
def stream_packets(spark, sf_dir):
    """Vectors that arrive in pieces of 10 samples, the pieces of one place in a micro-batch: packets of 16, carried from piece to piece."""
    starts = F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(10))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("session"), F.size("embedding").alias("n"), "embedding", F.posexplode(starts).alias("place", "s"))
    pieces = rows.select("session", "place", F.transform(F.slice("embedding", F.col("s") + 1, F.lit(10)), lambda x: x.cast("double")).alias("samples"), (F.col("s") + 10 >= F.col("n")).alias("final"), F.timestamp_seconds("place").alias("ts"))
    out = drained(packet_stream(in_parts(pieces, "ts", 3, "pieces"), 16), "append", "packets")
    total = F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6) + 0.0
    return out.select("session", "number", F.size("samples").cast("long").alias("samples"), total.alias("total"), "final")
