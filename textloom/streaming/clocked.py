"""Sessions that the clock ends: silences, blocks with a time limit, due saves, requests without an answer.

A rule is a pure step from a state and a row to the next state, plus a deadline: the time at which the state ends by
itself (``due``) and what it emits then (``ring``). The time is that of the rows, so results depend on what was sent, not on
when it was read: a row waits in its session's state until the watermark has passed it, rows are then taken in
the order of their time, and between two rows all deadlines up to the second one ring. A deadline up to a row's time
rings before the row. A timer wakes sessions for their next row or deadline, even if nothing arrives, and sessions without a state are gone from the store.

A key of the store is a bucket of sessions, by their hash: a micro-batch calls Python and the store once for each bucket that has rows or a deadline, not for each session.
The states and waiting rows of a bucket are two tables in Arrow's format. The number of buckets is for good, like that of a state's partitions.

``clocked`` runs a rule over a stream and ``clocked_rows`` over the same rows at hand, with the same results for what the watermark has passed.
Rows that arrive behind the watermark are late and dropped, as Spark does; the watermark's delay says how late rows may be.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

#: Timers and lists of rows in a state need this store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
FOREVER = math.inf
#: Buckets of sessions in a state.
BUCKETS = 1024


class Rule(NamedTuple):
    """step(state, row), due(state) and ring(state, at); a state of None is no state. Times are microseconds, rows have ``at``."""

    step: Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]]
    due: Callable[[tuple], int]
    ring: Callable[[tuple, int], tuple[tuple | None, list[tuple]]]
    state: str
    emits: str


def rung(rule: Rule, state: tuple | None, until: float, out: list[tuple]) -> tuple | None:
    """The state once all deadlines up to a time have rung."""
    while state is not None and (due := rule.due(state)) <= until:
        state, found = rule.ring(state, due)
        out += found
    return state


def stepped(rule: Rule, state: tuple | None, rows: Iterable[tuple], until: float = FOREVER) -> tuple[tuple | None, list[tuple]]:
    """The state after rows, in the order of their time, and all deadlines up to a time; and everything emitted."""
    out: list[tuple] = []
    for row in rows:
        state = rung(rule, state, row.at, out)
        state, found = rule.step(state, row)
        out += found
    return rung(rule, state, until, out), out


class _Bucket(StatefulProcessor):
    """The states of a bucket's sessions, the rows that the watermark hasn't passed, and the timer that is set."""

    def __init__(self, rule: Rule, row_schema: T.StructType, state_schema: T.StructType, order: list[str], names: list[str]) -> None:
        self.rule, self.order, self.names = rule, order, names
        self.row_kinds, self.state_kinds = to_arrow_schema(row_schema), to_arrow_schema(state_schema)

    def init(self, handle) -> None:
        self.handle = handle
        self.own = handle.getValueState("states", "data binary")
        self.waiting = handle.getValueState("waiting", "data binary")
        self.timer = handle.getValueState("timer", "at long")

    @staticmethod
    def _read(place, kinds: pa.Schema) -> pa.Table:
        return pa.ipc.open_stream(bytes(place.get()[0])).read_all() if place.exists() else kinds.empty_table()

    @staticmethod
    def _keep(place, now: pa.Table, before: pa.Table) -> None:
        if len(now):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, now.schema) as out:
                out.write_table(now)
            place.update((sink.getvalue().to_pybytes(),))
        elif len(before):
            place.clear()

    def _run(self, new: list[pa.Table], watermark_ms: int) -> Iterator[pd.DataFrame]:
        until = watermark_ms * 1000
        held, known = self._read(self.waiting, self.row_kinds), self._read(self.own, self.state_kinds)
        rows = pa.concat_tables([held, *new])
        passed = pc.less_equal(rows["at"], until)
        ready, rest = rows.filter(passed), rows.filter(pc.invert(passed))
        ready = ready.take(pc.sort_indices(ready, [(c, "ascending") for c in (ready.column_names[0], "at", *self.order)], null_placement="at_start"))
        states = {own: tuple(s) for own, *s in zip(*(c.to_pylist() for c in known.columns), strict=True)}
        row, out = namedtuple("Row", ["_", *ready.column_names[1:]], rename=True), []
        for own, some in groupby(zip(*(c.to_pylist() for c in ready.columns), strict=True), itemgetter(0)):
            states[own], found = stepped(self.rule, states.get(own), map(row._make, some), until)
            out += [(own, *f) for f in found]
        left = []
        for own, state in states.items():
            found = []
            state = rung(self.rule, state, until, found)
            out += [(own, *f) for f in found]
            if state is not None:
                left.append((own, *state))
        columns = list(zip(*left, strict=True)) or [()] * len(self.state_kinds)
        self._keep(self.own, pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.state_kinds, strict=True)], schema=self.state_kinds), known)
        if len(rest) or len(held):
            self._keep(self.waiting, rest, held)
        self._wake([pc.min(rest["at"]).as_py()] * (len(rest) > 0) + [self.rule.due(s[1:]) for s in left])
        columns = list(zip(*out, strict=True)) or [()] * len(self.names)
        yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.names, columns, strict=True)})

    def _wake(self, times: list[int]) -> None:
        """Set the timer for the first of times, in whole milliseconds that are no earlier."""
        was = self.timer.get()[0] if self.timer.exists() else None
        at = -(-min(times) // 1000) if times else None
        if was == at:
            return
        if was is not None:
            self.handle.deleteTimer(was)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [pa.Table.from_pandas(frame[self.row_kinds.names], self.row_kinds, preserve_index=False) for frame in rows]
        if key[0] is not None:  # rows without a session only move the clock
            yield from self._run(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.timer.exists():
            self.timer.clear()
        yield from self._run([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _prepared(df: DataFrame, session: str, time: str, columns: list[str]) -> DataFrame:
    return df.withColumn("at", F.unix_micros(F.col(time))).select(session, time, "at", *columns)


def clocked(df: DataFrame, rule: Rule, session: str, time: str, order: list[str], columns: list[str], late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """rule over each session of a streaming DataFrame (time: a timestamp; order: columns that settle ties). Rows with a null session are clock ticks."""
    rows = _prepared(df.withWatermark(time, late), session, time, columns)
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in (session, "at", *columns)])
    state = T.StructType([T.StructField(f"s{k}", f.dataType) for k, f in enumerate([schema[0], *T._parse_datatype_string(rule.state)])])
    emits = f"{session} {dict(rows.dtypes)[session]}, {rule.emits}"
    names = T._parse_datatype_string(emits).names
    bucket = F.when(F.col(session).isNotNull(), F.pmod(F.xxhash64(session), F.lit(buckets)))
    return rows.withColumn("clocked_bucket", bucket).groupBy("clocked_bucket").transformWithStateInPandas(_Bucket(rule, schema, state, order, names), emits, "append", "EventTime")


def clocked_rows(df: DataFrame, rule: Rule, session: str, time: str, order: list[str], columns: list[str], until: int | None = None) -> DataFrame:
    """rule over the rows of a DataFrame at hand; a session's rows stream through one task. until: microseconds, or all deadlines."""
    rows = _prepared(df, session, time, columns).drop(time).where(F.col(session).isNotNull())
    names = ["at", *columns]
    emits = T._parse_datatype_string(f"{session} {dict(rows.dtypes)[session]}, {rule.emits}")
    end = FOREVER if until is None else until

    def run(batches):
        key, state, out = None, None, []
        row = namedtuple("Row", names)
        for b in batches:
            for own, *values in zip(*(b.column(c).to_pylist() for c in (session, *names)), strict=True):
                if key is not None and own != key:
                    found: list[tuple] = []
                    rung(rule, state, end, found)
                    out += [(key, *f) for f in found]
                    state = None
                key = own
                state, found = stepped(rule, state, [row(*values)], -FOREVER)
                out += [(key, *f) for f in found]
            yield batch(out)
            out = []
        if key is not None:
            found = []
            rung(rule, state, end, found)
            yield batch([(key, *f) for f in found])

    kinds = to_arrow_schema(emits)

    def batch(out):
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], kinds.names)

    return rows.repartition(session).sortWithinPartitions(session, "at", *order).mapInArrow(run, emits)


# rules; their states are tuples


def silence_rule(gap: int) -> Rule:
    """Rows (final): start, end, rows and reason of each session, which a final row ends, or gap microseconds without a row."""

    def step(s, row):
        start, _, rows = s or (row.at, row.at, 0)
        return (None, [(start, row.at, rows + 1, "final")]) if row.final else ((start, row.at, rows + 1), [])

    return Rule(step, lambda s: s[1] + gap, lambda s, at: (None, [(s[0], at, s[2], "silence")]), "start long, last long, rows long", "start long, end long, rows long, reason string")


def block_rule(span: int, most: int, cost: int = 20) -> Rule:
    """Rows (size): start, end, items, used and reason of each block. It closes span microseconds after its first item, or for an item
    that would take it over most with cost more for each; an item larger than that has a block of its own."""

    def step(s, row):
        need, out = int(row.size) + cost, []
        if s is not None and s[1] + need > most:
            out, s = [(s[0], row.at, s[2], s[1], "size")], None
        return ((row.at, need, 1) if s is None else (s[0], s[1] + need, s[2] + 1)), out

    return Rule(step, lambda s: s[0] + span, lambda s, at: (None, [(s[0], at, s[2], s[1], "time")]), "start long, used long, items long", "start long, end long, items long, used long, reason string")


def autosave_rule(wait: int) -> Rule:
    """Rows (version): saved_at, changes and version of each save, which is due wait microseconds after the first change that isn't saved."""

    def step(s, row):
        return ((row.at, 1, row.version) if s is None else (s[0], s[1] + 1, row.version)), []

    return Rule(step, lambda s: s[0] + wait, lambda s, at: (None, [(at, s[1], s[2])]), "first long, changes long, version long", "saved_at long, changes long, version long")


def request_rule(timeout: int, most: int | None = None, one_ends_all: bool = False) -> Rule:
    """Rows (id, answer): request, asked, ended and outcome of each request of a worker, and of each answer that nothing waits for.

    A request is answered, or timed out after timeout microseconds, or refused while most others wait. With one_ends_all a request that times out stops
    the worker, which fails all that wait for it.
    """

    def state(waits: list[tuple[int, int]]):
        return ([i for i, _ in waits], [a for _, a in waits]) if waits else None

    def pending(s) -> list[tuple[int, int]]:
        return [] if s is None else list(zip(s[0], s[1], strict=True))

    def step(s, row):
        waits = pending(s)
        if row.answer:
            hit = next((w for w in waits if w[0] == row.id), None)
            if hit is None:
                return s, [(row.id, None, row.at, "late")]
            waits.remove(hit)
            return state(waits), [(*hit, row.at, "answered")]
        if most is not None and len(waits) >= most:
            return s, [(row.id, row.at, row.at, "refused")]
        return state([*waits, (row.id, row.at)]), []

    def ring(s, at):
        waits = pending(s)
        over = [w for w in waits if w[1] + timeout <= at]
        rest = [w for w in waits if w not in over]
        out = [(*w, at, "timed_out") for w in over]
        if one_ends_all:
            out, rest = out + [(*w, at, "stopped") for w in rest], []
        return state(rest), out

    return Rule(step, lambda s: min(s[1]) + timeout, ring, "ids array<long>, asked array<long>", "request long, asked long, ended long, outcome string")
