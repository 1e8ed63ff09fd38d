"""Sessions that the clock ends: rules against plain simulations, streams against the same rows at hand, micro-batches and a restart."""

import datetime
import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from textloom.streaming import clocked as C
from textloom.streaming.run import drained

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SECOND = 1_000_000


def rows_of(rule, rows, columns, until=C.FOREVER):
    row = namedtuple("Row", ["at", *columns])
    return C.stepped(rule, None, [row(*r) for r in sorted(rows)], until)[1]


def test_silence_ends_a_session():
    rows = [(0, False), (5, False), (14, False), (24, False), (30, True), (31, False)]
    got = rows_of(C.silence_rule(10), rows, ["final"])
    assert got == [(0, 24, 3, "silence"), (24, 30, 2, "final"), (31, 41, 1, "silence")]
    assert rows_of(C.silence_rule(10), rows, ["final"], until=40) == got[:2]  # the clock hasn't come so far


def test_blocks_close_by_time_and_by_size():
    rows = [(0, 30), (10, 30), (19, 30), (20, 10), (21, 60), (22, 500), (60, 1)]
    assert rows_of(C.block_rule(20, 200), rows, ["size"]) == [(0, 20, 3, 150, "time"), (20, 22, 2, 110, "size"), (22, 42, 1, 520, "time"), (60, 80, 1, 21, "time")]


def test_saves_are_due_after_the_first_change():
    assert rows_of(C.autosave_rule(2), [(0, 1), (1, 2), (2, 3), (9, 4)], ["version"]) == [(2, 2, 2), (4, 1, 3), (11, 1, 4)]


@pytest.mark.parametrize(("most", "all_"), [(None, False), (3, False), (3, True), (1, True)])
def test_requests(most, all_):
    """Against a simulation that looks at every tick of the clock."""
    rng = random.Random(3)
    for _ in range(60):
        rows = []
        for i in range(rng.randrange(1, 14)):
            at = rng.randrange(60)
            rows.append((at, i, False))
            if rng.random() < 0.7:
                rows.append((at + rng.randrange(1, 30), i, True))
        rows = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
        want, waits = [], {}
        for now in range(130):
            over = [i for i, a in waits.items() if a + 12 <= now]
            want += [(i, waits.pop(i), now, "timed_out") for i in over]
            if over and all_:
                want += [(i, a, now, "stopped") for i, a in waits.items()]
                waits = {}
            for at, i, answer in rows:
                if at != now:
                    continue
                if answer and i in waits:
                    want.append((i, waits.pop(i), now, "answered"))
                elif answer:
                    want.append((i, None, now, "late"))
                elif most is not None and len(waits) >= most:
                    want.append((i, now, now, "refused"))
                else:
                    waits[i] = now
        row = namedtuple("Row", ["at", "id", "answer"])
        got = C.stepped(C.request_rule(12, most, all_), None, [row(*r) for r in rows])[1]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_micro_batches_restart_and_clock(spark, tmp_path):
    """Three micro-batches, a stop, two more with late and early rows of one session, and a tick: as if all had been at hand."""
    rng = random.Random(8)
    schema = "session long, ts timestamp, k long, final boolean"
    stamp = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [(rng.randrange(4), stamp(rng.randrange(600)), k, rng.random() < 0.2) for k in range(160)]
    # within the delay of the watermark, parts overlap in time and come in any order
    parts = [[r for r in rows if (r[1] - T0).total_seconds() // 20 % 30 in range(6 * p, 6 * p + 6)] for p in range(5)]
    for p in range(4):
        late = [r for r in parts[p] if rng.random() < 0.3 and (r[1] - T0).total_seconds() >= 120 * (p + 1) - 30]
        parts[p] = [r for r in parts[p] if r not in late]
        parts[p + 1] += late
    where, place = str(tmp_path / "in"), f"file://{tmp_path}/place"
    spark.createDataFrame([], schema).write.parquet(where)

    def feed(some):
        rng.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(where)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
        found = C.clocked(stream, C.silence_rule(20 * SECOND), "session", "ts", ["k"], ["k", "final"], late="100 seconds")
        return drained(found, "append", "clock", place=place, settings=C.STATE_STORE | {"spark.sql.shuffle.partitions": "2"})

    at_hand = lambda until: sorted(tuple(r) for r in C.clocked_rows(spark.createDataFrame(rows, schema), C.silence_rule(20 * SECOND), "session", "ts", ["k"], ["k", "final"], until).collect())
    for p in range(3):
        feed(parts[p])
    first = sorted(tuple(r) for r in run().drop("batch").collect())
    seen = max(r[1] for p in parts[:3] for r in p) - datetime.timedelta(seconds=100)
    done = [r for r in at_hand(None) if r[2] <= int(seen.timestamp() * 1e6)]
    assert first == done and 0 < len(first) < len(at_hand(None))
    for p in (3, 4):
        feed(parts[p])
    feed([(None, stamp(10_000), None, None)])
    out = run()
    assert sorted(tuple(r) for r in out.drop("batch").collect()) == at_hand(None)
    assert out.select("batch").distinct().count() >= 3


def test_sessions_at_hand(spark):
    """Order, ties, nulls and an empty table."""
    df = spark.createDataFrame([(1, T0, 2, True), (1, T0, 1, False), (None, T0, 3, False), (2, T0, 4, None)], "session long, ts timestamp, k long, final boolean")
    at = int(T0.timestamp() * 1e6)
    rule = C.silence_rule(7)
    got = sorted(tuple(r) for r in C.clocked_rows(df, rule, "session", "ts", ["k"], ["k", "final"]).collect())
    assert got == [(1, at, at, 2, "final"), (2, at, at + 7, 1, "silence")]
    assert C.clocked_rows(df.where(F.lit(False)), rule, "session", "ts", ["k"], ["k", "final"]).count() == 0


def test_packets_of_any_pieces():
    from textloom.streaming import segments

    rng = random.Random(5)
    piece = namedtuple("piece", ["samples", "final"])
    for _ in range(200):
        samples = [float(k) for k in range(rng.randrange(0, 60))]
        pieces, at = [], 0
        while at < len(samples):
            n = rng.randrange(0, 25)
            pieces.append(piece(samples[at : at + n], False))
            at += n
        pieces = [*pieces, piece([], True)] if rng.random() < 0.5 or not pieces else [*pieces[:-1], pieces[-1]._replace(final=True)]
        _, out = segments.stepped(segments.packet_step(16), segments.Packets(), pieces)
        want = [samples[k : k + 16] for k in range(0, len(samples), 16)] or [[]]
        assert out == [(k, w, k == len(want) - 1) for k, w in enumerate(want)]


def test_sessions_share_the_calls_of_their_bucket(spark, tmp_path):
    """Sessions of several files a micro-batch: as at hand, and the store has a key for each bucket, not for each session."""
    from textloom.streaming.run import in_parts

    rng = random.Random(12)
    stamp = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [(f"u{rng.randrange(300)}", stamp(rng.randrange(900)), rng.choice([k, k, k + (1 << 40), None]), rng.random() < 0.5) for k in range(2000)]
    df = spark.createDataFrame(rows, "session string, ts timestamp, id long, answer boolean").repartition(6)
    rule, place = C.request_rule(60 * SECOND), f"file://{tmp_path}/place"
    stream = in_parts(df, "ts", 3, "bucket-rows", tick="1 day", files=4)
    assert stream.isStreaming
    out = drained(C.clocked(stream, rule, "session", "ts", ["answer", "id"], ["id", "answer"], buckets=8), "append", "buckets", place=place, settings=C.STATE_STORE | {"spark.sql.shuffle.partitions": "2"})
    want = C.clocked_rows(df, rule, "session", "ts", ["answer", "id"], ["id", "answer"])
    plain = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    assert plain(out.drop("batch")) == plain(want)
    with_states = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 1).load(f"{place}/state")
    assert 0 < with_states.count() <= 8
