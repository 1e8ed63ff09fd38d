"""Sessions as states: speech-gated segments, endpoints, ordered ingest, blocks of turns, texts without their overlaps.

Each is a pure step from a state and one row to the next state and what is emitted; ``stateful`` runs such a
step over a stream, a session at a time, and ``stepped`` over rows at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from enum import IntEnum
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions.text import WORD


def stepped(step: Callable, state: NamedTuple, rows: Iterable) -> tuple[NamedTuple, list[tuple]]:
    """The state after all rows, and everything emitted."""
    out: list[tuple] = []
    for row in rows:
        state, found = step(state, row)
        out += found
    return state, out


def stateful(df: DataFrame, step: Callable, start: NamedTuple, order: str, emits: str, state_schema: str, session: str = "session") -> DataFrame:
    """step over each session of a streaming DataFrame, in the order of a column within a micro-batch; rows that come in a later one are taken as they come, and sessions have no expiry (``clocked`` has both)."""
    kind = dict(df.dtypes)[session]
    names = [c.split()[0] for c in emits.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = type(start)(*(list(v) if isinstance(v, (list, np.ndarray)) else v for v in state.get)) if state.exists else start
        rows = pd.concat(list(frames)).sort_values(order)
        now, out = stepped(step, now, rows.itertuples(index=False))
        state.update(tuple(int(v) if isinstance(v, IntEnum) else v for v in now))
        found = pd.DataFrame(out, columns=names)
        found.insert(0, session, [key[0]] * len(found))
        yield found

    return df.groupBy(session).applyInPandasWithState(run, f"{session} {kind}, {emits}", state_schema, "append", GroupStateTimeout.NoTimeout)


# speech-gated segments


class Phase(IntEnum):
    QUIET = 0
    SPEECH = 1


class Rules(NamedTuple):
    """Seconds, but for the samples a second and the level from which on a block is loud. Fixed values of the usual set-up."""

    rate: int = 16000
    threshold: float = 0.008
    preview: float = 0.35
    pause: float = 0.5
    longest: float = 8.0
    lead: float = 0.2
    carry: float = 0.4
    least: float = 0.16

    def samples(self, seconds: float) -> int:
        return round(seconds * self.rate)


class Gate(NamedTuple):
    """A session in samples: where it stands, the open segment's first sample, its loud samples, the quiet behind them, and where its last preview ended.

    marks: first samples of the blocks that a segment may begin with; joined: whether a cut segment runs on into this one.
    """

    phase: int = Phase.QUIET
    now: int = 0
    number: int = -1
    origin: int = 0
    loud: int = 0
    hush: int = 0
    shown: int = 0
    joined: bool = False
    marks: list[int] = []


def gate_step(rules: Rules) -> Callable:
    """A step over blocks (level, size, final): id, start, end, final, overlap of previews and finished segments.

    A loud block opens a segment, with the quiet blocks of the last ``lead`` seconds; ``pause`` seconds of quiet finish it, and
    ``longest`` seconds cut it, so that its last ``carry`` seconds also begin the next. Segments with less than ``least``
    seconds of speech vanish. A final block ends the session, and with it the open segment.
    """

    def emitted(s: Gate, final: bool) -> list[tuple]:
        return [(s.number, s.origin, s.now, final, s.joined)] if s.loud >= rules.samples(rules.least) else []

    def closed(s: Gate, cut: bool) -> Gate:
        marks = [max(s.origin, s.now - rules.samples(rules.carry))] if cut else []
        return s._replace(phase=Phase.QUIET, joined=cut, loud=0, hush=0, marks=marks)

    def heard(s: Gate, is_loud: bool, before: int) -> tuple[Gate, list[tuple]]:
        if s.phase == Phase.QUIET and not is_loud:
            near = [m for m in (*s.marks, before) if s.now - m <= rules.samples(rules.lead)]
            return s._replace(marks=near or [before]), []
        if s.phase == Phase.QUIET:
            origin = min([*s.marks, before])
            s = s._replace(phase=Phase.SPEECH, number=s.number + 1, origin=origin, shown=origin, loud=0, hush=0)
        size = s.now - before
        s = s._replace(loud=s.loud + size * is_loud, hush=0 if is_loud else s.hush + size)
        if s.hush >= rules.samples(rules.pause):
            return closed(s, False), emitted(s, True)
        if s.now - s.origin >= rules.samples(rules.longest):
            return closed(s, True), emitted(s, True)
        due = is_loud and s.now - s.shown >= rules.samples(rules.preview) and s.loud >= rules.samples(rules.least)
        return (s._replace(shown=s.now), emitted(s, False)) if due else (s, [])

    def step(s: Gate, block) -> tuple[Gate, list[tuple]]:
        before = s.now
        s, out = heard(s._replace(now=before + int(block.size)), bool(block.level >= rules.threshold), before)
        if block.final and s.phase == Phase.SPEECH:
            out, s = out + emitted(s, True), closed(s, False)
        return s, out

    return step


def segment_stream(blocks: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Segments of a streaming DataFrame of blocks (session, sequence, level, size, final): session, id, start, end, final, overlap."""
    return stateful(
        blocks, gate_step(rules), Gate(), "sequence", "id long, start long, end long, final boolean, overlap boolean",
        "phase int, now long, number long, origin long, loud long, hush long, shown long, joined boolean, marks array<long>",
    )


# endpoints


class Endpoint(NamedTuple):
    number: int = 0
    start: float = 0.0
    now: float = 0.0
    silence: float = 0.0
    spoken: bool = False


def endpoint_step(any_silence: float = 1.2, silence: float = 0.6, longest: float = 20.0) -> Callable:
    """A step over packets (seconds, silent, final): the number, start, end and reason of each stretch that ends.

    It ends with that much silence, with less once something was said, at its longest, or with the session.
    """

    def step(s: Endpoint, packet) -> tuple[Endpoint, list[tuple]]:
        now = s.now + float(packet.seconds)
        quiet = s.silence + float(packet.seconds) if packet.silent else 0.0
        spoken = s.spoken or not packet.silent
        reason = "final" if packet.final else "pause" if spoken and quiet >= silence else "silence" if quiet >= any_silence else "length" if now - s.start >= longest else None
        if reason is None:
            return s._replace(now=now, silence=quiet, spoken=spoken), []
        return Endpoint(s.number + 1, now, now), [(s.number, s.start, now, reason)]

    return step


def endpoint_stream(packets: DataFrame, **limits) -> DataFrame:
    """Stretches of a streaming DataFrame of packets (session, sequence, seconds, silent, final)."""
    return stateful(packets, endpoint_step(**limits), Endpoint(), "sequence", "number long, start double, end double, reason string", "number long, start double, now double, silence double, spoken boolean")


# ordered ingest


class Ingest(NamedTuple):
    """Of a session of packets: the last one taken, whether that was the final one, and whether one failed."""

    last: int = -1
    ended: bool = False
    faulted: bool = False


def ingest_step(s: Ingest, packet) -> tuple[Ingest, list[tuple]]:
    """Packets are taken in order without a gap; the last one again is a replay. A failure shuts the session, as the final packet does."""
    sequence = int(packet.sequence)
    if sequence == s.last >= 0:
        return s, [(int(packet.arrival), sequence, "replayed")]
    if s.faulted or s.ended or sequence != s.last + 1:
        return s, [(int(packet.arrival), sequence, "refused")]
    if packet.fails:
        return s._replace(faulted=True), [(int(packet.arrival), sequence, "failed")]
    return Ingest(sequence, bool(packet.final)), [(int(packet.arrival), sequence, "accepted")]


def ingest_stream(packets: DataFrame) -> DataFrame:
    """What became of each packet of a streaming DataFrame (session, arrival, sequence, final, fails)."""
    return stateful(packets, ingest_step, Ingest(), "arrival", "arrival long, sequence long, outcome string", "last long, ended boolean, faulted boolean")


# blocks of turns


class Block(NamedTuple):
    number: int = -1
    used: int = 0
    since: float = 0.0


def block_step(cost: int = 20, most: int = 6400, span: float = 20.0) -> Callable:
    """A step over items (place, seconds, size): place and number of the block, which takes items of most characters, with cost more for each, within span seconds."""

    def step(s: Block, item) -> tuple[Block, list[tuple]]:
        need = int(item.size) + cost
        fits = s.number >= 0 and s.used + need <= most and float(item.seconds) - s.since < span
        s = s._replace(used=s.used + need) if fits else Block(s.number + 1, need, float(item.seconds))
        return s, [(int(item.place), s.number)]

    return step


def block_stream(items: DataFrame, **limits) -> DataFrame:
    """The block of each item of a streaming DataFrame (session, place, seconds, size)."""
    return stateful(items, block_step(**limits), Block(), "place", "place long, block int", "number int, used long, since double")


# packets of samples


class Packets(NamedTuple):
    number: int = 0
    held: list[float] = []


def packet_step(size: int) -> Callable:
    """A step over pieces (samples, final) of any length: number, samples and final of each packet of so many samples; the last one may be short, and is there even if empty where nothing else is."""

    def step(s: Packets, piece) -> tuple[Packets, list[tuple]]:
        held = [*s.held, *(float(x) for x in piece.samples)]
        # the last packet is known for the last one only when the session ends
        full = (len(held) - 1) // size if not piece.final else max(0, -(-len(held) // size) - 1)
        full = max(0, full)
        out = [(s.number + k, held[k * size : (k + 1) * size], False) for k in range(full)]
        rest = held[full * size :]
        if piece.final:
            return Packets(s.number + full + 1), [*out, (s.number + full, rest, True)]
        return Packets(s.number + full, rest), out

    return step


def packet_stream(pieces: DataFrame, size: int) -> DataFrame:
    """Packets of a streaming DataFrame of pieces (session, place, samples, final)."""
    return stateful(pieces, packet_step(size), Packets(), "place", "number long, samples array<double>, final boolean", "number long, held array<double>")


# texts without their overlaps


class Spoken(NamedTuple):
    text: str = ""


def without_overlap(previous: str, current: str, least: int = 6, most: int = 60) -> str:
    """current without a beginning whose letters and digits repeat the end of previous (functions.text.remove_overlap, for one pair)."""
    import regex

    word = regex.compile(WORD.rstrip("+"))
    left, right = "".join(word.findall(previous))[-most:], [m for m in word.finditer(current)]
    size = next((n for n in range(min(most, len(left), len(right)), least - 1, -1) if left.endswith("".join(m.group() for m in right[:n]))), 0)
    return regex.sub(r"^[\s,.!?。]+", "", current[right[size - 1].end() :]) if size else current


def overlap_step(s: Spoken, row) -> tuple[Spoken, list[tuple]]:
    """The text of each segment (place, text, final) without what it repeats of the final one before it."""
    rest = without_overlap(s.text, row.text or "")
    return (Spoken(rest) if row.final and rest else s), [(int(row.place), rest, bool(row.final))]


def overlap_stream(segments: DataFrame) -> DataFrame:
    """Segments of a streaming DataFrame (session, place, text, final) without overlaps."""
    return stateful(segments, overlap_step, Spoken(), "place", "place long, text string, final boolean", "text string")
