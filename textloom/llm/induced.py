"""Suffix order and common prefixes of a shard by external induced sorting.

Suffixes are L where they are greater than the next one and S where smaller; an S suffix
behind an L suffix starts a substring. Those substrings are named in order, the string of
names is sorted by recursion, down to a string whose names all differ, and the order of all
suffixes follows by induction: one pass over the characters upwards for the L suffixes and
one downwards for the S suffixes.

The suffixes that are yet to be met wait in a priority queue: tuples of first character, suffix,
common prefix with the tuple before it of that character, and the characters in front of it, so that a
suffix induces the next one without a look at the text. The queue is a list of tuples for
each range of characters; the tuples of a character arrive in order, so that a range is put in order when
its turn comes. A range holds a bounded share of the text, whatever the alphabet; the suffixes
that a range induces in itself are ordered by what induced them. Tuples over ``memory_rows`` go to disk, as
do the text's types, the substrings' places and names, and their order, where they are longer than that.

Common prefixes are carried along: that of two induced suffixes is one more than the least of
the values between the suffixes that they came from; that of two substrings' starts is the length of the substrings that
the recursion found equal and the few characters that the next two share. They are told up to a
cap only.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues of a shard hold in memory, together; longer arrays are on disk.
MEMORY_ROWS = 4 << 20
#: Ranges that the characters of a text are dealt out to, about, and suffixes that a range has at least.
RANGES, LEAST_RANGE = 64, 2048
#: Text looked at together where a pass goes over all of it.
BLOCK = 1 << 20
#: Steps of one suffix after another within a range, after which runs of one character are taken as a whole.
STEPS = 12

Columns = tuple[np.ndarray, ...]


class Store:
    """A folder of a shard, for arrays and tuples that are too long for memory."""

    def __init__(self, folder: str, memory_rows: int) -> None:
        self.folder, self.memory_rows, self.files = tempfile.mkdtemp(prefix="induced-", dir=folder), memory_rows, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"{self.files}.npy")

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.memory_rows:
            return np.empty(n, dtype)
        return np.lib.format.open_memmap(self.path(), "w+", dtype, (n,))

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class RangeQueues:
    """First-in-first-out queues of tuples (character, suffix, prefix, characters in front), one for each range, on disk beyond a bound."""

    def __init__(self, ranges: int, store: Store) -> None:
        self.parts: list[list] = [[] for _ in range(ranges)]
        self.held, self.store = 0, store

    def push(self, k: int, columns: Columns) -> None:
        if not len(columns[0]):
            return
        self.parts[k].append(columns)
        self.held += len(columns[0])
        if self.held > self.store.memory_rows:
            self.spill()

    def spill(self) -> None:
        for parts in self.parts:
            at = 0
            while at < len(parts):
                end = at
                while end < len(parts) and not isinstance(parts[end], str):
                    end += 1
                if end > at:
                    path = self.store.path()
                    with open(path, "wb") as out:
                        for column in zip(*parts[at:end], strict=True):
                            np.save(out, np.concatenate(column))
                    parts[at:end] = [path]
                at += 1
        self.held = 0

    def pop(self, k: int, backwards: bool = False) -> Iterator[Columns]:
        """What the queue holds, what is in memory together and each file by itself; backwards in the other direction."""
        parts, self.parts[k] = self.parts[k], []
        if backwards:
            parts.reverse()
        turn = slice(None, None, -1 if backwards else 1)
        live: list[Columns] = []

        def together() -> Columns:
            both = live[0] if len(live) == 1 else tuple(np.concatenate(c) for c in zip(*live, strict=True))
            live.clear()
            self.held -= len(both[0])
            return both

        for p in parts:
            if not isinstance(p, str):
                live.append(tuple(c[turn] for c in p))
                continue
            if live:
                yield together()
            with open(p, "rb") as source:
                columns = tuple(np.load(source)[turn] for _ in range(4))
            os.remove(p)
            yield columns
        if live:
            yield together()


def suffix_types(text: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """True for S suffixes; the last character is the smallest and stands once. A block at a time, from the end."""
    n = len(text)
    kind = np.empty(n, bool) if out is None else out
    kind[n - 1] = True
    for end in range(n - 1, 0, -BLOCK):
        at = max(0, end - BLOCK)
        here, ahead = text[at:end], text[at + 1 : end + 1]
        # a run of one character is of the type of what follows it
        known = np.where(here != ahead, np.arange(end - at), end - at)
        follow = np.minimum.accumulate(known[::-1])[::-1]
        less = np.append(here < ahead, kind[end])
        kind[at:end] = less[follow]
    return kind


def substring_starts(kind: np.ndarray, store: Store) -> np.ndarray:
    """Places of S suffixes behind L suffixes, in order."""
    found = []
    for at in range(1, len(kind), BLOCK):
        end = min(len(kind), at + BLOCK)
        found.append(np.flatnonzero(kind[at:end] & ~kind[at - 1 : end - 1]) + at)
    starts = store.array(sum(map(len, found)), np.int64)
    at = 0
    for f in found:
        starts[at : at + len(f)] = f
        at += len(f)
    return starts


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray | int) -> np.ndarray:
    """Equal characters of the suffixes a and b, cap at most."""
    n, cap = len(text), np.broadcast_to(np.asarray(cap, np.int64), a.shape)
    out = cap.copy()
    live, k = np.flatnonzero(cap > 0), 0
    if text.dtype == np.uint16 and n >= 4:
        # four characters at a time, but near the end of the text
        four = np.ndarray((n - 3,), "<u8", text, strides=(2,))
        slow = []
        while len(live):
            x, y = a[live] + k, b[live] + k
            near_end = np.maximum(x, y) > n - 4
            if near_end.any():
                slow.append(live[near_end])
                live, x, y = live[~near_end], x[~near_end], y[~near_end]
            differ = four[x] ^ four[y]
            there = differ != 0
            low = differ[there]
            out[live[there]] = k + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 16
            k += 4
            live = live[~there]
            live = live[cap[live] > k]
        np.minimum(out, cap, out=out)
        live, k = np.concatenate(slow) if slow else np.zeros(0, np.int64), 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        same = (x < n) & (y < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        out[live[~same]] = k
        k += 1
        live = live[same]
        live = live[cap[live] > k]
    return out


def char_ranges(text: np.ndarray, alphabet: int, memory_rows: int) -> np.ndarray:
    """First characters of ranges that hold about the same number of suffixes, and the alphabet's size at the end."""
    count = np.zeros(alphabet, np.int64)
    for at in range(0, len(text), BLOCK):
        count += np.bincount(text[at : at + BLOCK], minlength=alphabet)
    least = max(1, min(max(LEAST_RANGE, len(text) // RANGES), memory_rows))
    # a character that fills a range by itself gets one of its own
    alone = count >= least
    part = np.cumsum(np.where(alone, 0, count)) // least
    key = 2 * part + alone
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | alone[1:])))
    return np.append(new, alphabet)


def name_substrings(text: np.ndarray, kind: np.ndarray, starts: np.ndarray, ranges: np.ndarray, store: Store) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each start to the next one, both ends included, and how many differ; a range of first characters at a time."""
    m = len(starts)
    names, part = store.array(m, np.int64), store.array(m, np.int32)
    for at in range(0, m, BLOCK):
        part[at : at + BLOCK] = np.searchsorted(ranges, text[starts[at : at + BLOCK]], "right") - 1
    width = int(2 * (ranges[-1] - 1) + 3).bit_length()
    each, total = max(1, 62 // width), 0
    for k in range(len(ranges) - 1):
        mine = np.flatnonzero(part == k)
        if not len(mine):
            continue
        begin, end = np.asarray(starts[mine]), np.asarray(starts[np.minimum(mine + 1, m - 1)])
        name = np.zeros(len(mine), np.int64)
        live, at = np.arange(len(mine)), 0
        while len(live):
            word = np.zeros(len(live), np.int64)
            for i in range(each):
                p = begin[live] + at + i
                q = np.minimum(p, len(text) - 1)
                word = (word << width) | np.where(p <= end[live], text[q].astype(np.int64) * 2 + kind[q] + 1, 0)
            order = np.argsort(word, kind="stable") if not at else np.lexsort((word, name[live]))
            at += each
            n_, w_ = name[live][order], word[order]
            new = np.concatenate(([True], (n_[1:] != n_[:-1]) | (w_[1:] != w_[:-1])))
            head = np.concatenate(([True], n_[1:] != n_[:-1]))
            place = np.arange(len(n_))
            # places within the old class, so that classes keep their distance to each other
            fresh = n_ + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
            name[live[order]] = fresh
            alone = np.concatenate(([True], fresh[1:] != fresh[:-1])) & np.concatenate((fresh[1:] != fresh[:-1], [True]))
            rest = live[order[~alone]]
            live = rest[begin[rest] + at <= end[rest]]
        distinct = np.unique(name)
        names[mine] = total + np.searchsorted(distinct, name)
        total += len(distinct)
    return names, total


class RangeMinimum:
    """The least of any stretch of values."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= longest:
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of values[first] .. values[last]."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in range(len(self.rows)):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] - (1 << k) + 1])
        return out


class Induction:
    """One pass over the ranges, upwards for the L suffixes or downwards for the S suffixes."""

    def __init__(self, text: np.ndarray, ranges: np.ndarray, cap: int, up: bool, store: Store, packing: tuple[int, int]) -> None:
        self.text, self.ranges, self.cap, self.up, self.store = text, ranges, cap, up, store
        self.bits, self.fields = packing
        self.queues = RangeQueues(len(ranges) - 1, store)
        self.begun = np.zeros(int(ranges[-1]), bool)
        self.least: np.ndarray | None = None

    def front(self, suffix: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The character in front of each suffix (-1 at the start of the text), and what is carried beyond it."""
        mask = np.int64((1 << self.bits) - 1)
        empty = np.flatnonzero((before & mask) == 0)
        if len(empty):
            before = before.copy()
            before[empty] = packed_front(self.text, suffix[empty], self.bits, self.fields)
        return (before & mask) - 1, before >> self.bits

    def induces(self, ahead: np.ndarray, chars: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        further = ahead > chars if self.up else (ahead < chars) & (ahead >= 0)
        return further | ((ahead == chars) & ~fixed)

    def range_in_order(self, k: int, old: Columns, fixed: Columns) -> tuple[Columns, np.ndarray]:
        """All suffixes of a range in the order of the pass, with their common prefixes, and which are fixed ones.

        In a character come first the old ones (induced by other ranges), then those that the range itself induces, then the fixed ones.
        """
        n_old, n_fixed = len(old[0]), len(fixed[0])
        chars, suffix, prefix, before = (np.concatenate(c) for c in zip(old, fixed, strict=True))
        is_fixed = np.arange(n_old + n_fixed) >= n_old
        low, high = self.ranges[k], self.ranges[k + 1]
        # what the range induces in itself, a step at a time; parent: what induced it
        waves = [(chars, suffix, prefix, before)]
        parents: list[np.ndarray] = []
        place, step = 0, 0
        done = np.zeros(len(chars), bool)
        last, last_fixed = waves[0], is_fixed
        while len(last[0]):
            ahead, rest = self.front(last[1], last[3])
            more = np.flatnonzero(self.induces(ahead, last[0], last_fixed) & (ahead >= low) & (ahead < high) & ~done)
            if not len(more):
                break
            new = (ahead[more], last[1][more] - 1, np.zeros(len(more), prefix.dtype), rest[more])
            parent, done = place + more, np.zeros(len(more), bool)
            step += 1
            if step > STEPS:
                # runs of one character as a whole: each suffix of the run comes from the one behind it
                run = self.run_in_front(new[1], new[0])
                if run.any():
                    own = np.repeat(np.arange(len(more)), run + 1)
                    back = np.arange(len(own)) - np.repeat(np.cumsum(run + 1) - run - 1, run + 1)
                    here = place + len(last[0]) + np.arange(len(own))
                    parent = np.where(back == 0, parent[own], here - 1)
                    done = back < run[own]
                    new = (new[0][own], new[1][own] - back, np.zeros(len(own), prefix.dtype), np.where(back == 0, new[3][own], 0))
            place += len(last[0])
            waves.append(new)
            parents.append(parent)
            last, last_fixed = new, np.zeros(len(new[0]), bool)
        if parents:
            chars, suffix, prefix, before = (np.concatenate(c) for c in zip(*waves, strict=True))
        n = len(chars)
        group = np.zeros(n, np.int8)
        group[n_old : n_old + n_fixed] = 2
        group[n_old + n_fixed :] = 1
        key = (chars - low if self.up else high - 1 - chars).astype(np.int64) * 3 + group
        # a stable order by small numbers is a matter of counting
        order = np.arange(n) if n and (key[1:] >= key[:-1]).all() else np.argsort(key.astype(np.uint16) if (high - low) * 3 < 1 << 16 else key, kind="stable")
        if parents:
            order = self.by_parents(key, order, np.concatenate(parents), n_old + n_fixed)
        chars, suffix, prefix, before, group = chars[order], suffix[order], prefix[order], before[order], group[order]
        same = np.concatenate(([False], chars[1:] == chars[:-1]))
        carried = same & np.concatenate(([False], (group[1:] == group[:-1]) & (group[1:] != 1)))
        prefix = np.where(carried, prefix, 0)
        compare = np.flatnonzero(same & ~carried)
        if len(compare):
            prefix[compare] = common_prefix(self.text, suffix[compare - 1], suffix[compare], self.cap)
        return (chars, suffix, prefix, before), group == 2

    def run_in_front(self, suffix: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """How many characters in front of each suffix are the same as its own."""
        out, live = np.zeros(len(suffix), np.int64), np.flatnonzero(suffix > 0)
        while len(live):
            p = suffix[live] - 1 - out[live]
            live = live[(p >= 0) & (self.text[np.maximum(p, 0)] == chars[live])]
            if len(live) < 8:
                break
            out[live] += 1
        for i in live:  # a few long runs: by stretches of the text
            p = int(suffix[i] - 1 - out[i])
            while p >= 0:
                at = max(0, p + 1 - BLOCK // 16)
                other = np.flatnonzero(self.text[at : p + 1] != chars[i])
                if len(other):
                    out[i] += p - (at + int(other[-1]))
                    break
                out[i] += p + 1 - at
                p = at - 1
        return out

    @staticmethod
    def by_parents(key: np.ndarray, order: np.ndarray, parents: np.ndarray, terminals: int) -> np.ndarray:
        """order, with the suffixes from terminals on, which stand together by character, in the order of what induced them."""
        n = len(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        live = np.arange(terminals, n)
        rank[live] = start[rank[live]]
        parent = np.concatenate((np.arange(terminals), parents))
        while len(live):
            a, b = rank[live], rank[parent[live]]
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            place = np.arange(len(by))
            old = np.concatenate(([True], a[1:] != a[:-1]))
            new = old | np.concatenate(([True], b[1:] != b[:-1]))
            fresh = a + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
            rank[live[by]] = fresh
            # each comparison reaches twice as far back as the one before
            parent[terminals:] = parent[parent[terminals:]]
            tied = ~(new & np.concatenate((new[1:], [True])))
            live = live[by[tied]]
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        return out

    def push(self, batch: Columns, fixed: np.ndarray, inside: tuple[int, int] | None) -> None:
        """Send on what a batch, in order, induces outside the characters of inside."""
        chars, suffix, prefix, before = batch
        ahead, rest = self.front(suffix, before)
        picked = self.induces(ahead, chars, fixed)
        if inside is not None:
            picked &= (ahead < inside[0]) | (ahead >= inside[1])
        at = np.flatnonzero(picked)
        if len(at):
            to = ahead[at]
            order = np.argsort(to.astype(np.uint16) if self.ranges[-1] <= 1 << 16 else to, kind="stable")
            at, to = at[order], to[order]
            first = np.concatenate(([True], to[1:] != to[:-1]))
            value = np.empty(len(at), prefix.dtype)
            follow = np.flatnonzero(~first)
            if len(follow):
                begin, end = at[follow - 1] + 1, at[follow]
                value[follow] = RangeMinimum(prefix, int((end - begin).max()) + 1).least(begin, end) + 1
            head = np.flatnonzero(first)
            # a suffix of another character lies between it and the one before, unless a character is met in several batches
            between = np.zeros(len(head), prefix.dtype)
            if self.least is not None:
                between = np.minimum(self.least[to[head]], np.minimum.accumulate(prefix)[at[head]])
            value[head] = np.where(self.begun[to[head]], between + 1, 0)
            columns = (to, suffix[at] - 1, np.minimum(value, self.cap).astype(prefix.dtype), rest[at])
            part = np.searchsorted(self.ranges, to[head], "right") - 1
            cuts = np.concatenate((head[np.concatenate(([True], part[1:] != part[:-1]))], [len(at)]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                self.queues.push(int(np.searchsorted(self.ranges, to[i], "right") - 1), tuple(c[i:j] for c in columns))
        if self.least is not None:
            np.minimum(self.least, prefix.min(), out=self.least)
            if len(at):
                tail = np.append(np.minimum.accumulate(prefix[::-1])[::-1], self.cap)
                final = np.append(head[1:], len(at)) - 1
                self.least[to[final]] = tail[at[final] + 1]
        if len(at):
            self.begun[to] = True

    def run(self, k: int, fixed: Iterator[Columns], n_fixed: int) -> Iterator[tuple[Columns, np.ndarray]]:
        """The suffixes of range k in the order of the pass, in parts, with which are fixed ones; what they induce is sent on."""
        waiting = sum(1 if isinstance(p, str) else len(p[0]) for p in self.queues.parts[k])
        on_disk = any(isinstance(p, str) for p in self.queues.parts[k])
        if self.ranges[k + 1] - self.ranges[k] > 1 or not (on_disk or waiting + n_fixed > self.store.memory_rows):
            empty = self.nothing()
            old = [empty, *self.queues.pop(k)]
            held = [empty, *fixed]
            batch, is_fixed = self.range_in_order(k, *(tuple(np.concatenate(c) for c in zip(*x, strict=True)) for x in (old, held)))
            if len(batch[0]):
                self.push(batch, is_fixed, (int(self.ranges[k]), int(self.ranges[k + 1])))
                yield batch, is_fixed
            return
        # one character that is too many for memory: in the order of arrival, what it induces in itself goes to the end of its own queue
        self.least = np.zeros(len(self.begun), np.int32)
        tail: np.ndarray | None = None
        while self.queues.parts[k]:
            for batch in self.queues.pop(k):
                if tail is None:
                    batch[2][:1] = 0
                is_fixed = np.zeros(len(batch[0]), bool)
                self.push(batch, is_fixed, None)
                tail = batch[1][-1:]
                yield batch, is_fixed
        met = False
        for batch in fixed:
            prefix = batch[2].copy()
            if not met:
                prefix[:1] = 0 if tail is None else common_prefix(self.text, tail, batch[1][:1], self.cap)
            batch, met = (batch[0], batch[1], prefix, batch[3]), True
            is_fixed = np.ones(len(prefix), bool)
            self.push(batch, is_fixed, None)
            yield batch, is_fixed
        self.least = None

    def nothing(self) -> Columns:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)


def packed_front(text: np.ndarray, suffix: np.ndarray, bits: int, fields: int) -> np.ndarray:
    """The characters in front of each suffix, one more each, the nearest lowest; none beyond the start of the text, whose first suffix is marked by 0 alone."""
    out = np.zeros(len(suffix), np.int64)
    for k in range(fields, 0, -1):
        p = suffix - k
        out = (out << bits) | np.where(p >= 0, text[np.maximum(p, 0)].astype(np.int64) + 1, 0)
    return out


def order_of_starts(text: np.ndarray, kind: np.ndarray, starts: np.ndarray, ranges: np.ndarray, cap: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """The substrings' starts from the smallest suffix to the greatest, and the common prefix of each with the one before."""
    m = len(starts)
    names, distinct = name_substrings(text, kind, starts, ranges, store)
    order, equal = store.array(m, np.int64), store.array(m, np.int32)
    if distinct == m:
        order[names] = np.arange(m)
        equal[:] = 0
    else:
        # a substring is two characters at least before the next
        at = m
        for suffix, prefix in sorted_suffixes(names, cap // 2 + 1, store.folder, store.memory_rows):
            n = len(suffix)
            order[at - n : at] = suffix[::-1]
            # from the greatest down a prefix is that with the one before; upwards it is that with the next
            equal[at - n + 1 : at + 1][: m - at + n - 1] = prefix[::-1][: m - at + n - 1]
            at -= n
        equal[0] = 0
    seeds, prefix = store.array(m, np.int64), store.array(m, np.int32)
    for at in range(0, m, BLOCK):
        end = min(m, at + BLOCK)
        mine = np.asarray(order[at:end])
        seeds[at:end] = starts[mine]
        if at:
            other = np.asarray(order[at - 1 : end - 1])
        else:
            other = np.concatenate((mine[:1], mine[:-1]))
        n_equal = np.asarray(equal[at:end]).astype(np.int64)
        a, b = starts[np.minimum(mine + n_equal, m - 1)], starts[np.minimum(other + n_equal, m - 1)]
        covered = np.minimum(a - starts[mine], cap)
        prefix[at:end] = covered + common_prefix(text, np.asarray(a), np.asarray(b), cap - covered)
    prefix[0] = 0
    return seeds, prefix


def sorted_suffixes(text: np.ndarray, cap: int, folder: str, memory_rows: int = MEMORY_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of text from the greatest to the smallest, in parts: (suffix, common prefix with the one before, cap at most).

    text ends with its smallest character, which stands once.
    """
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    store = Store(folder, memory_rows)
    try:
        kind = suffix_types(text, store.array(n, bool))
        starts = substring_starts(kind, store)
        alphabet = int(text.max()) + 1
        ranges = char_ranges(text, alphabet, memory_rows)
        seeds, seed_prefix = order_of_starts(text, kind, starts, ranges, cap, store)
        bits = alphabet.bit_length()
        packing = bits, max(1, 62 // bits)
        parts = len(ranges) - 1
        seed_chars = store.array(len(seeds), np.int64)
        for at in range(0, len(seeds), BLOCK):
            seed_chars[at : at + BLOCK] = text[seeds[at : at + BLOCK]]
        cuts = np.searchsorted(seed_chars, ranges)

        def seeds_of(k: int) -> Iterator[Columns]:
            for at in range(int(cuts[k]), int(cuts[k + 1]), BLOCK):
                to = min(at + BLOCK, int(cuts[k + 1]))
                own = np.asarray(seeds[at:to])
                yield np.asarray(seed_chars[at:to]), own, np.asarray(seed_prefix[at:to]), packed_front(text, own, *packing)

        up = Induction(text, ranges, cap, True, store, packing)
        greater = RangeQueues(parts, store)
        n_greater = [0] * parts
        for k in range(parts):
            for batch, is_seed in up.run(k, seeds_of(k), int(cuts[k + 1] - cuts[k])):
                own = ~is_seed
                if own.any():
                    # a seed may stand between two of these only where the character changes
                    greater.push(k, tuple(c[own] for c in batch))
                    n_greater[k] += int(own.sum())
        down = Induction(text, ranges, cap, False, store, packing)

        def greater_of(k: int) -> Iterator[Columns]:
            held = 0
            for chars, suffix, prefix, before in greater.pop(k, backwards=True):
                # the common prefix of a suffix with the greater one is what the greater one holds upwards
                yield chars, suffix, np.concatenate((np.array([held], prefix.dtype), prefix[:-1])), before
                held = prefix[-1]

        # the last suffix has nothing behind it that could have induced it
        first = int(text[-1])
        down.queues.push(int(np.searchsorted(ranges, first, "right") - 1), (np.array([first]), np.array([n - 1]), np.zeros(1, np.int32), np.zeros(1, np.int64)))
        down.begun[first] = True
        for k in range(parts - 1, -1, -1):
            for batch, _ in down.run(k, greater_of(k), n_greater[k]):
                yield batch[1], batch[2]
    finally:
        store.close()
