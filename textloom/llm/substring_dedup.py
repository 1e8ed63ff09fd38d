"""Removal of repeated byte strings across a corpus by suffix order.

Every byte that a string of ``length`` bytes covers which also starts earlier (in a
document with a smaller id, or earlier in the same document) is removed. Strings are judged
on the input, and never cross documents.

1. Each task cuts its documents into segments: runs of windows of ``length`` bytes that
   share the least hash of their GRAM-byte grams. Equal windows have equal least hashes, so
   all copies of a window meet under one key wherever they stand. Of equal segments in
   a task all but the first are removed there and then; one goes on.
2. By key, the first of equal segments stays and the others are removed. Where a key has several
   different segments (the edges of passages, places of edits) or one that may repeat
   itself, equal windows may hide inside, and the segments go on to step 3.
3. Those segments make shards. Induced sorting (``induced``) orders the suffixes of a shard
   with their common prefixes; neighbours that share ``length`` bytes or more are equal
   windows, of which all but the first are removed.

The segments of a key with more than ``hot_segments`` different ones are cut and met again by wider grams (steps 1 and 2
over those segments), as often as a key has so many, at last window by window, so that no key grows with the corpus.
Each cut makes a few segments of one, where its single windows would be some 30 times its bytes.
The number of shards follows the number of the input's partitions.

Segments of one key are equal where their sizes and the 128 bits of a cryptographic digest (BLAKE2b) of all their bytes are.
A shard's pieces, its text and its order are on the task's disk, not in its
memory; what is in memory is 48 bytes for each piece.

Defined cases: null text counts as empty; texts shorter than ``length`` lose nothing; rows
alike in id and text are one document and get the same result each; rows of one id, or of none, with
different texts are different documents, in the order of their texts' hashes (63 bits beside an id, 126 without one); a null id
comes before all others; ids that are no integers are refused; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import drop_saved, saved, table, text_blocks
from textloom.llm.induced import MEMORY_ROWS, sorted_suffixes

#: Wide grams: short ones that many texts hold would be the key of many different segments.
LENGTH, GRAM = 100, 32
#: Different segments of one key above which they are cut again by wider grams.
HOT_SEGMENTS = 4_000
#: Shards at most: beyond it they grow in size, and the queues of a shard on disk, not in number.
MAX_SHARDS = 100_000
#: Segments that a task of step 1 combines at a time.
COMBINE_ROWS = 1 << 20
#: Bytes of segments that leave a task together, and of those of hot keys that it cuts at a time.
PIECE_BYTES, HOT_BYTES = 8 << 20, 2 << 20

#: doc and row name a document: its id and, with the highest bit set, 63 bits of its text's hash; without an id two hashes of its text, that bit clear.
SEGMENT = np.dtype([("key", "<u8"), ("code", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u4"), ("row", "<u8")])
HAS_ID = np.uint64(1 << 63)
SPAN = np.dtype([("start", "<u4"), ("size", "<u4")])
#: Kinds of rows that the steps hand on: spans to remove, segments, segments of hot keys.
REMOVED, PIECES, HOT = 0, 1, 2
ROW_SCHEMA = "kind int, place long, doc long, row long, data binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed hash of the gram bytes from each place on (beyond the end: zeros)."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(gram + 16, np.uint8)])
    eight = np.zeros(n + gram + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (len(padded) - k) // 8 * 8].view("<u8")
        eight[k::8][: len(part)] = part[: len(eight[k::8])]
    whole, rest = divmod(gram, 8)
    h = np.zeros(n, np.uint64)
    for k in range(whole):
        h = (h ^ eight[8 * k : 8 * k + n]) * _ODD
        h ^= h >> np.uint64(29)
    if rest:
        h = (h ^ (eight[8 * whole : 8 * whole + n] & np.uint64((1 << (8 * rest)) - 1))) * _ODD
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row; len(values) - width + 1 results."""
    n = len(values)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, off: np.ndarray, docs: np.ndarray, rows: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a block of documents, and for each whether it may hold a window twice. With grams of the whole length each window is one."""
    n = len(raw)
    if n < length:
        return np.zeros(0, SEGMENT), np.zeros(0, bool)
    h = gram_hashes(raw, gram)
    width = length - gram + 1
    key = sliding_min(h[: n - gram + 1], width)
    windows = n - length + 1
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:windows]
    ok = np.arange(windows) + length <= off[1:][doc]
    change = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1] | (gram == length)))
    first = np.flatnonzero(change & ok)
    if not len(first):
        return np.zeros(0, SEGMENT), np.zeros(0, bool)
    border = np.append(np.flatnonzero(change | ~ok), windows)
    stop = border[np.searchsorted(border, first, "right")]
    out = np.zeros(len(first), SEGMENT)
    out["key"] = key[first]
    data = memoryview(raw.tobytes())
    digests = b"".join([hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(first.tolist(), (stop - 1 + length).tolist(), strict=True)])
    out["code"], out["more"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    out["doc"], out["row"] = docs[doc[first]], rows[doc[first]]
    out["start"], out["size"] = first - off[doc[first]], stop - 1 + length - first
    # a window whose own first gram is the least, with the key still the same after it, has that gram twice
    again = (h[:windows] == key) & np.concatenate((~change[1:] & ok[1:], [False]))
    count = np.concatenate(([0], np.cumsum(again)))
    return out, count[stop] > count[first]


def place_keys(seg: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort keys, the last one first, of the order in the corpus: documents without an id come before all others."""
    with_id = (seg["row"] & HAS_ID) > 0
    return (start, seg["row"], seg["doc"]) if with_id.all() else (start, seg["row"], seg["doc"], with_id)


def placed(seg: np.ndarray) -> np.ndarray:
    """The order of segments by key, content, then place in the corpus."""
    return np.lexsort((*place_keys(seg, seg["start"]), seg["size"], seg["more"], seg["code"], seg["key"]))


def firsts(seg: np.ndarray) -> np.ndarray:
    """Of segments in the order of placed(): whether each is the first of its content."""
    new = np.ones(len(seg), bool)
    if len(seg) > 1:
        new[1:] = np.any([seg[c][1:] != seg[c][:-1] for c in ("key", "code", "more", "size")], axis=0)
    return new


def repeats_of_first(seg: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Those that are not their content's first, nor the same document as the first at the same start."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(seg)), 0))
    f = seg[head]
    return (seg["doc"] != f["doc"]) | (seg["row"] != f["row"]) | (seg["start"] != f["start"])


def _batch(kind: int, places, docs, rows, datas) -> pa.RecordBatch:
    n = len(datas)
    arrays = [pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(places, np.int64)), pa.array(np.asarray(docs, np.int64)), pa.array(np.asarray(rows, np.uint64).view(np.int64)), pa.array(datas, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "place", "doc", "row", "data"])


def by_document(kind: int, found: np.ndarray, shards: int) -> pa.RecordBatch:
    """A row for each document of found (SEGMENT): its spans, or its whole segments."""
    found = found[np.lexsort((found["start"], found["row"], found["doc"]))]
    head = np.flatnonzero(np.concatenate(([True], (found["doc"][1:] != found["doc"][:-1]) | (found["row"][1:] != found["row"][:-1])))) if len(found) else np.zeros(0, np.int64)
    datas = []
    for i, j in zip(head, np.append(head[1:], len(found))[: len(head)], strict=True):
        part = found[i:j]
        if kind == REMOVED:
            # overlapping spans become one
            start, end = part["start"].astype(np.int64), np.maximum.accumulate(part["start"].astype(np.int64) + part["size"])
            cut = np.concatenate(([True], start[1:] > end[:-1]))
            spans = np.zeros(int(cut.sum()), SPAN)
            spans["start"] = start[cut]
            spans["size"] = end[np.append(np.flatnonzero(cut)[1:] - 1, len(part) - 1)] - start[cut]
            datas.append(spans.tobytes())
        else:
            datas.append(part.tobytes())
    d, r = found["doc"][head], found["row"][head]
    return _batch(kind, (d.astype(np.uint64) * _ODD >> np.uint64(33)).astype(np.int64) % shards, d, r, datas)


def by_shard(kind: int, seg: np.ndarray, flags: np.ndarray, shards: int) -> pa.RecordBatch:
    """A row for each shard that seg has keys of: the segments, then a byte for each with its flag."""
    place = (seg["key"] * _ODD >> np.uint64(33)).astype(np.int64) % shards
    order = np.argsort(place, kind="stable")
    seg, flags, place = seg[order], flags[order], place[order]
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(seg) else np.zeros(0, np.int64)
    datas = [seg[i:j].tobytes() + flags[i:j].astype(np.uint8).tobytes() for i, j in zip(head, np.append(head[1:], len(seg))[: len(head)], strict=True)]
    return _batch(kind, place[head], np.zeros(len(head)), np.zeros(len(head)), datas)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (SEGMENT.itemsize + 1)
    return np.frombuffer(data, SEGMENT, n), np.frombuffer(data, np.uint8, n, n * SEGMENT.itemsize) > 0


def cut_documents(docs: DataFrame, length: int, gram: int, shards: int, combine_rows: int = COMBINE_ROWS) -> DataFrame:
    """Step 1 over (doc, row, text)."""

    def combine(held: list) -> list[pa.RecordBatch]:
        seg, flags = np.concatenate([s for s, _ in held]), np.concatenate([f for _, f in held])
        held.clear()
        order = placed(seg)
        seg, flags = seg[order], flags[order]
        new = firsts(seg)
        gone = repeats_of_first(seg, new)
        return [by_document(REMOVED, seg[gone], shards), by_shard(PIECES, seg[new], flags[new], shards)]

    def run(batches):
        held, n = [], 0
        for b in batches:
            docs_, rows = b.column("doc").to_numpy(), b.column("row").to_numpy().view(np.uint64)
            for at, end, raw, off in text_blocks(b.column("text"), 1 << 20):
                held.append(segments(raw, off, docs_[at:end], rows[at:end], length, gram))
                n += len(held[-1][0])
                if n >= combine_rows:
                    yield from combine(held)
                    n = 0
        if n:
            yield from combine(held)

    return docs.select("doc", "row", "text").mapInArrow(run, ROW_SCHEMA)


def meet_by_key(pieces: DataFrame, shards: int, hot_segments: int) -> DataFrame:
    """Step 2: spans to remove, and by document the segments that step 3 has to look into."""

    def run(batches):
        held = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            gone = np.flatnonzero(kind == REMOVED)
            if len(gone):
                yield b.take(pa.array(gone))
            held += [_unpack(b.column("data")[int(i)].as_py()) for i in np.flatnonzero(kind == PIECES)]
        if not held:
            return
        seg, flags = np.concatenate([s for s, _ in held]), np.concatenate([f for _, f in held])
        held.clear()
        order = placed(seg)
        seg, flags = seg[order], flags[order]
        new = firsts(seg)
        yield by_document(REMOVED, seg[repeats_of_first(seg, new)], shards)
        seg, flags = seg[new], flags[new]
        head = np.flatnonzero(np.concatenate(([True], seg["key"][1:] != seg["key"][:-1])))
        size = np.diff(np.append(head, len(seg)))
        contents = np.repeat(size, size)
        yield by_document(PIECES, seg[((contents > 1) | flags) & (contents <= hot_segments)], shards)
        yield by_document(HOT, seg[contents > hot_segments], shards)

    return pieces.repartition(shards, "place").mapInArrow(run, ROW_SCHEMA)


def wider_grams(length: int, gram: int) -> list[int]:
    """Grams for the cuts of hot keys' segments; the last is the whole window."""
    out, rest = [], length - gram
    while not out or rest:
        rest //= 3
        out.append(length - rest)
    return out


def with_bytes(kind: int, seg: np.ndarray, flags: np.ndarray, texts: list[bytes], shards: int) -> pa.RecordBatch:
    """A row for each shard that seg has keys of: how many segments, those (size: their bytes), of HOT ones a byte each with its flag, and their bytes."""
    place = (seg["key"] * _ODD >> np.uint64(33)).astype(np.int64) % shards
    order = np.argsort(place, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], place[order][1:] != place[order][:-1]))) if len(seg) else np.zeros(0, np.int64)
    datas = []
    for i, j in zip(head, np.append(head[1:], len(seg))[: len(head)], strict=True):
        own = order[i:j]
        marks = flags[own].astype(np.uint8).tobytes() if kind == HOT else b""
        datas.append(len(own).to_bytes(4, "little") + seg[own].tobytes() + marks + b"".join(texts[k] for k in own))
    return _batch(kind, place[order][head], np.zeros(len(head)), np.zeros(len(head)), datas)


def cut_again(seg: np.ndarray, texts: list[bytes], length: int, gram: int, shards: int) -> list[pa.RecordBatch]:
    """Step 1 over segments of hot keys, by wider grams: spans to remove, and one of each content with its bytes."""
    raw = b"".join(texts)
    off = np.concatenate(([0], np.cumsum(seg["size"].astype(np.int64))))
    sub, flags = segments(np.frombuffer(raw, np.uint8), off, np.arange(len(seg)), np.zeros(len(seg), np.uint64), length, gram)
    own = sub["doc"].copy()
    at = off[own] + sub["start"]
    sub["doc"], sub["row"] = seg["doc"][own], seg["row"][own]
    sub["start"] += seg["start"][own]
    order = placed(sub)
    sub, flags, at = sub[order], flags[order], at[order]
    new = firsts(sub)
    gone, sub, flags, at = sub[repeats_of_first(sub, new)], sub[new], flags[new], at[new]
    return [by_document(REMOVED, gone, shards), with_bytes(HOT, sub, flags, [raw[i : i + n] for i, n in zip(at.tolist(), sub["size"].tolist(), strict=True)], shards)]


def fetch(docs: DataFrame, wanted: DataFrame, length: int, gram: int, shards: int) -> DataFrame:
    """The bytes of the wanted segments by shard of their keys; those of hot keys cut by grams of gram bytes, and what they lose in a task."""
    lists = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("kind", "data")).alias("parts"))
    joined = docs.join(lists, ["doc", "row"]).select("text", "parts")

    def leave(kind: int, held: list, texts: list[bytes]) -> list[pa.RecordBatch]:
        seg = np.concatenate(held)
        out = cut_again(seg, texts, length, gram, shards) if kind == HOT else [with_bytes(PIECES, seg, np.zeros(0, bool), texts, shards)]
        held.clear()
        texts.clear()
        return out

    def run(batches):
        held, texts, size, most = {PIECES: [], HOT: []}, {PIECES: [], HOT: []}, {PIECES: 0, HOT: 0}, {PIECES: PIECE_BYTES, HOT: HOT_BYTES}
        for b in batches:
            for text, parts in zip(b.column("text"), b.column("parts"), strict=True):
                raw = (text.as_py() or "").encode()
                for p in parts.as_py():
                    kind, seg = p["kind"], np.frombuffer(p["data"], SEGMENT)
                    held[kind].append(seg)
                    texts[kind] += [raw[i : i + n] for i, n in zip(seg["start"].tolist(), seg["size"].tolist(), strict=True)]
                    size[kind] += int(seg["size"].sum())
                    if size[kind] >= most[kind]:
                        yield from leave(kind, held[kind], texts[kind])
                        size[kind] = 0
        for kind in (PIECES, HOT):
            if held[kind]:
                yield from leave(kind, held[kind], texts[kind])

    return joined.mapInArrow(run, ROW_SCHEMA)


def meet_again(pieces: DataFrame, length: int, gram: int | None, shards: int, hot_segments: int) -> DataFrame:
    """Step 2 over segments of hot keys and their bytes, which are on the task's disk: what is hot still is cut by grams of gram bytes (None: nothing is)."""

    def run(batches):
        folder = tempfile.mkdtemp(prefix="hot-")
        try:
            held, path = [], os.path.join(folder, "text")
            with open(path, "wb") as out:
                for b in batches:
                    for data in b.column("data"):
                        data = data.as_py()
                        n = int.from_bytes(data[:4], "little")
                        held.append(_unpack(data[4 : 4 + n * (SEGMENT.itemsize + 1)]))
                        out.write(data[4 + n * (SEGMENT.itemsize + 1) :])
            if not held:
                return
            seg, flags = np.concatenate([s for s, _ in held]), np.concatenate([f for _, f in held])
            held.clear()
            at = np.cumsum(seg["size"].astype(np.int64)) - seg["size"]
            order = placed(seg)
            seg, flags, at = seg[order], flags[order], at[order]
            new = firsts(seg)
            yield by_document(REMOVED, seg[repeats_of_first(seg, new)], shards)
            seg, flags, at = seg[new], flags[new], at[new]
            head = np.flatnonzero(np.concatenate(([True], seg["key"][1:] != seg["key"][:-1])))
            size = np.diff(np.append(head, len(seg)))
            contents = np.repeat(size, size)
            hot = contents > hot_segments if gram is not None else np.zeros(len(seg), bool)
            with open(path, "rb") as found:
                for kind, chosen, most in ((PIECES, ((contents > 1) | flags) & ~hot, PIECE_BYTES), (HOT, hot, HOT_BYTES)):
                    picked = np.flatnonzero(chosen)
                    block = np.cumsum(seg["size"][picked].astype(np.int64)) // most
                    for own in np.split(picked, np.flatnonzero(np.diff(block)) + 1):
                        if not len(own):
                            continue
                        texts = []
                        for i, n in zip(at[own].tolist(), seg["size"][own].tolist(), strict=True):
                            found.seek(i)
                            texts.append(found.read(n))
                        yield from cut_again(seg[own], texts, length, gram, shards) if kind == HOT else [with_bytes(PIECES, seg[own], flags[own], texts, shards)]
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return pieces.repartition(shards, "place").mapInArrow(run, ROW_SCHEMA)


def shard_text(pieces, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces' segments, where each begins, the text) of a shard; the text is on disk, a piece at a time is in memory.

    Characters are shifted by two; each segment ends with 1, the text with 0.
    """
    segs, path = [], os.path.join(folder, "text")
    with open(path, "wb") as out:
        for data in pieces:
            n = int.from_bytes(data[:4], "little")
            seg = np.frombuffer(data, SEGMENT, n, 4)
            body = np.frombuffer(data, np.uint8, offset=4 + n * SEGMENT.itemsize)
            size = seg["size"].astype(np.int64)
            ends = np.cumsum(size + 1) - 1
            part = np.ones(len(body) + n, np.uint16)
            inside = np.ones(len(part), bool)
            inside[ends] = False
            part[inside] = body
            part[inside] += np.uint16(2)
            part.tofile(out)
            segs.append(seg)
        np.zeros(1, np.uint16).tofile(out)
    seg = np.concatenate(segs)
    size = seg["size"].astype(np.int64)
    return seg, np.cumsum(size + 1) - size - 1, np.asarray(np.memmap(path, np.uint16, "r"))


def repeats_in_shard(pieces, length: int, folder: str | None = None, memory_rows: int = MEMORY_ROWS) -> np.ndarray:
    """The windows (SEGMENT of that size) that start earlier elsewhere among the pieces of a shard."""
    folder = tempfile.mkdtemp(prefix="shard-", dir=folder)
    try:
        return _repeats(*shard_text(pieces, folder), length, folder, memory_rows)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _repeats(seg: np.ndarray, begin: np.ndarray, text: np.ndarray, length: int, folder: str, memory_rows: int) -> np.ndarray:
    size = seg["size"].astype(np.int64)
    out = []

    def settle(group: np.ndarray) -> None:
        """group: suffixes in runs of equal windows; the first column numbers the runs."""
        run, suffix = group
        own = np.searchsorted(begin, suffix, "right") - 1
        # what runs over the end of a segment is no window; such suffixes only ever meet each other
        inside = suffix + length <= begin[own] + size[own]
        run, suffix, own = run[inside], suffix[inside], own[inside]
        if not len(run):
            return
        s = seg[own]
        start = s["start"].astype(np.int64) + suffix - begin[own]
        order = np.lexsort((*place_keys(s, start), run))
        run, s, start = run[order], s[order], start[order]
        new = np.concatenate(([True], run[1:] != run[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
        later = (s["doc"] != s["doc"][head]) | (s["row"] != s["row"][head]) | (start != start[head])
        w = np.zeros(int(later.sum()), SEGMENT)
        w["doc"], w["row"], w["start"], w["size"] = s["doc"][later], s["row"][later], start[later], length
        out.append(w)

    runs, held = 0, []
    for suffix, prefix in sorted_suffixes(text, length, folder, memory_rows):
        joins = prefix >= length
        number = runs + np.cumsum(~joins)
        runs = int(number[-1])
        held.append((number, suffix))
        if sum(len(h[0]) for h in held) > 1 << 20:
            number, suffix = (np.concatenate(c) for c in zip(*held, strict=True))
            done = number < runs
            held = [(number[~done], suffix[~done])]
            _settle_runs(number[done], suffix[done], settle)
    if held:
        number, suffix = (np.concatenate(c) for c in zip(*held, strict=True))
        _settle_runs(number, suffix, settle)
    return np.concatenate(out) if out else np.zeros(0, SEGMENT)


def _settle_runs(number: np.ndarray, suffix: np.ndarray, settle) -> None:
    if len(number) < 2:
        return
    alone = np.concatenate(([True], number[1:] != number[:-1])) & np.concatenate((number[1:] != number[:-1], [True]))
    if not alone.all():
        settle((number[~alone], suffix[~alone]))


def _spooled(path: str):
    """The pieces that a task has put aside for a shard."""
    with open(path, "rb") as found:
        while size := found.read(8):
            yield found.read(int.from_bytes(size, "little"))


def order_shards(pieces: DataFrame, length: int, shards: int) -> DataFrame:
    """Step 3: spans to remove, from the suffix order of each shard."""

    def run(batches):
        folder, places = tempfile.mkdtemp(prefix="shards-"), set()
        try:
            for b in batches:
                for place, data in zip(b.column("place"), b.column("data"), strict=True):
                    place, data = place.as_py(), data.as_py()
                    places.add(place)
                    with open(os.path.join(folder, str(place)), "ab") as out:
                        out.write(len(data).to_bytes(8, "little") + data)
            for place in sorted(places):
                path = os.path.join(folder, str(place))
                found = repeats_in_shard(_spooled(path), length, folder)
                os.remove(path)
                yield by_document(REMOVED, found, shards)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return pieces.repartition(shards, "place").mapInArrow(run, ROW_SCHEMA)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS, shards: int | None = None) -> DataFrame:
    """doc, row and spans (a list of packed SPAN arrays) of the documents (doc, row, text) that lose something."""
    if shards is None:
        # a multiple of the input's own partitions: a shard is of the order of what a task reads
        shards = min(MAX_SHARDS, max(16, 4 * docs.rdd.getNumPartitions()))
    met = saved(meet_by_key(cut_documents(docs, length, gram, shards), shards, hot_segments), "segments")
    # texts are shuffled again at the end: what they and the shards are shuffled through isn't on disk at the same time
    grams = wider_grams(length, gram)
    levels = [saved(fetch(docs, met.where(F.col("kind") != REMOVED), length, grams[0], shards), "pieces")]
    for wider in (*grams[1:], None):
        hot = levels[-1].where(F.col("kind") == HOT)
        if hot.isEmpty():
            break
        levels.append(saved(meet_again(hot, length, wider, shards, hot_segments), "pieces"))
    found = reduce(DataFrame.unionByName, levels)
    hidden = saved(order_shards(found.where(F.col("kind") == PIECES), length, shards).unionByName(found.where(F.col("kind") == REMOVED)), "spans")
    for level in levels:
        drop_saved(level)
    spans = met.where(F.col("kind") == REMOVED).select("doc", "row", "data").unionByName(hidden.select("doc", "row", "data"))
    return spans.groupBy("doc", "row").agg(F.collect_list("data").alias("spans"))


def _documents(docs: DataFrame) -> DataFrame:
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer: documents are in its order")
    text, there = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNotNull()
    row = F.shiftrightunsigned(F.xxhash64(text), 1).bitwiseOR(F.when(there, F.lit(-(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)).alias("doc"), row.alias("row"), text.alias("text"))


def without_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (start, size) of every row of docs."""
    rows = _documents(docs)
    joined = rows.join(repeated_spans(rows, length, **how), ["doc", "row"], "left")

    def run(batches):
        for b in batches:
            out = []
            for doc, text, spans in zip(*(b.column(c) for c in ("doc_id", "text", "spans")), strict=True):
                raw = text.as_py().encode()
                cut = np.frombuffer(b"".join(spans.as_py() or ()), SPAN)
                mark = np.zeros(len(raw) + 1, np.int64)
                start = cut["start"].astype(np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + cut["size"], -1)
                gone = np.cumsum(mark)[:-1] > 0
                first = np.flatnonzero(gone & ~np.concatenate(([False], gone[:-1]))) if len(raw) else np.zeros(0, np.int64)
                last = np.flatnonzero(gone & ~np.concatenate((gone[1:], [False]))) if len(raw) else first
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc.as_py(), len(raw), int(gone.sum()), len(first), kept, [{"start": int(i), "size": int(j - i + 1)} for i, j in zip(first, last, strict=True)]))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,size:long>>")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
