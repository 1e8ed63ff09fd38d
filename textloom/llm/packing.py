"""Best-fit-decreasing packing of tokenised documents.

Token ids come from a public tokenizer file (bytes of UTF-8, normal form C, lower case,
a split into letter runs, single digits and punctuation runs, byte-pair merges). Words are
found with numpy over code points; only words not yet seen by the worker, which knows them by their
bytes, go through the tokenizer, so the ids are the library's own.

Documents longer than a sequence are cut; then best-fit decreasing runs over the counts of
pieces of each length: a segment tree over remaining capacities gives the tightest open
bin for a piece in logarithmic time, and as pieces of one length are alike, a run of them
is placed at once. The plan is a list of (length, ranks, bins) records whose number
depends on the capacity, not on the documents; each piece finds its place from its rank
among the pieces of its length.

Defined cases: null text counts as empty and gives one piece holding the end token;
repeated rows are packed each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import new_path, small_batches, table
from textloom.llm.words import distinct

CAPACITY = 2048
#: Characters that a worker looks at together, and words that it remembers at most.
BLOCK_CHARS, MAX_WORDS = 1 << 19, 1 << 20
#: Words that the tokenizer gets together.
TOGETHER = 4096

SPACE, OTHER, NUMBER, LETTER = range(4)


@cache
def char_classes() -> np.ndarray:
    """Class of each code point by its Unicode category: letters, numbers, white space, all else."""
    of = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


class WordTokens:
    """Token ids of texts, with a table of the words met so far."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.load(open(path))["added_tokens"]]
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, joined, and how many each has."""
        # as one text, which the tokenizer takes apart at the blanks again; where it finds other words, one by one
        whole = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        of_word = np.array(whole.word_ids, np.float64)  # a token of no word is not a number
        begin = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        if len(of_word) and of_word[-1] == len(words) - 1:
            heads = np.flatnonzero(np.concatenate(([True], of_word[1:] != of_word[:-1])))
            if len(heads) == len(words) and (np.array(whole.offsets)[heads, 0] == begin).all():
                return np.array(whole.ids, np.int32), np.diff(np.append(heads, len(of_word)))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum())), sizes

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        parts = [self.tokens_of(texts[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        sizes = np.concatenate([n for _, n in parts])
        self.slots.update(zip(words, range(len(self.begin) - 1, len(self.begin) - 1 + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, *(i for i, _ in parts)])

    def slots_of(self, joined: str, chars: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where the ids of each word are told; words not met before are learnt."""
        at = np.concatenate(([0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))))
        data = joined.encode("utf-8", "surrogatepass")
        begin, size = at[first], at[first + length] - at[first]
        head, own = distinct(np.frombuffer(data, np.uint8), begin, size)
        words = [data[i : i + n] for i, n in zip(begin[head].tolist(), size[head].tolist(), strict=True)]
        slots = [self.slots.get(w, -1) for w in words]
        if -1 in slots:
            new = [w for w, k in zip(words, slots, strict=True) if k < 0]
            if len(self.slots) + len(new) > MAX_WORDS:
                self.clear()
                new = words
            self.learn(new)
            slots = [self.slots[w] for w in words]
        return np.array(slots, np.int64)[own]

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, offsets of the texts in them); no text holds a special token's string."""
        offsets = np.zeros(len(texts) + 1, np.int64)
        plain = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
        plain = [t.lower() if t.isascii() else t.replace("Σ", "σ").lower() for t in plain]
        joined = "\n".join(plain)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(chars):
            return np.zeros(0, np.int32), offsets
        kind = char_classes()[chars]
        start = np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == NUMBER)
        # an apostrophe alone before s, t, m, d, re, ve or ll takes them along
        lone = np.flatnonzero((chars == 39) & start)
        if len(lone):
            pad = np.concatenate([chars, np.zeros(3, np.uint32)])
            pad_kind = np.concatenate([kind, np.zeros(3, np.uint8)])
            a, b = pad[lone + 1], pad[lone + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for at, size in ((lone[one], 1), (lone[two], 2)):
                start[at + 1] = False
                after = at + 1 + size
                ok = after < len(chars)
                start[after[ok & (pad_kind[np.minimum(after, len(pad) - 1)] != SPACE)]] = True
        first = np.flatnonzero(start & (kind != SPACE))
        if len(first):
            ends = np.append(np.flatnonzero(start), len(chars))
            length = ends[np.searchsorted(ends, first, "right")] - first
            slot = self.slots_of(joined, chars, first, length)
            size = self.begin[slot + 1] - self.begin[slot]
            ends_at = np.cumsum(size)
            ids = self.ids[np.repeat(self.begin[slot] - (ends_at - size), size) + np.arange(int(ends_at[-1]))]
        else:
            ids, ends_at, size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        borders = np.cumsum([len(t) + 1 for t in plain]) - 1  # where each text's separator stands
        n_words = np.searchsorted(first, borders)
        offsets[1:] = np.concatenate(([0], ends_at))[n_words]
        return ids, offsets

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        rest: list[int] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            ids, off = self.block([texts[i] for i in rest])
            for k, i in enumerate(rest):
                out[i] = ids[off[k] : off[k + 1]]
            rest.clear()
            chars = 0

        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
                continue
            rest.append(i)
            chars += len(t)
            if chars >= BLOCK_CHARS:
                flush()
        if rest:
            flush()
        return out


@cache
def word_tokens(path: str) -> WordTokens:
    """One for each worker process and tokenizer file."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and chunk and rank, which number the
    pieces of one length within the task that made them; with_ids adds the ids themselves."""
    small_batches(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, chunk long, rank long" + ", ids array<int>" * with_ids

    def run(batches):
        tools = word_tokens(path)
        seen: dict[int, int] = {}
        chunk = TaskContext.get().partitionId()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            owners, cols, ids_out = [], [], []
            for i, ids in enumerate(tools.encode(texts)):
                ids = np.append(ids, end_id).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rank = seen.get(len(part), 0)
                    seen[len(part)] = rank + 1
                    owners.append(i)
                    cols.append((k, at, len(part), zlib.crc32(part.tobytes()), chunk, rank))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            if not cols:
                continue
            found = np.array(cols, np.int64).T
            arrays = [b.column("doc_id").take(pa.array(owners)), pa.array(found[0].astype(np.int32)), *(pa.array(c) for c in found[1:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class CapacityTree:
    """Segment tree over remaining capacities 1..capacity: how many open bins have each, and the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        node = self.size + remaining
        while node:
            self.some[node] += bins
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity that is at least length and that an open bin has."""
        node = self.size + length
        if self.some[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Records (length, first rank, pieces, first bin, pieces a bin, offset in the bin of a bin's first piece).

    Pieces of one length go in from the longest to the shortest, each to the tightest open bin that
    fits, a new one if none does. As a bin that takes a piece and still fits the next of its
    length is then the tightest, it takes as many as fit; bins alike are filled in one step.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, deque[tuple[int, int]]] = {}
    plan: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put_back(remaining: int, first: int, n: int) -> None:
        if remaining > 0:
            open_bins.setdefault(remaining, deque()).append((first, n))
            tree.add(remaining, n)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                full = left // each
                groups = [(bins, full, each)] if full else [(bins, 1, left)]
                bins += groups[0][1]
                room = capacity
            else:
                first, n = open_bins[room].popleft()
                each = min(room // length, left)
                used = min(n, left // each)
                tree.add(room, -n)
                if n > used:
                    open_bins[room].appendleft((first + used, n - used))
                    tree.add(room, n - used)
                groups = [(first, used, each)]
            for first, n, each in groups:
                plan.append((length, rank, n * each, first, each, capacity - room))
                rank += n * each
                left -= n * each
                put_back(room - each * length, first, n)
    return plan


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a stored table with length, chunk and rank) with sequence_id and offset."""
    names = [c for c in pieces.columns if c not in ("chunk", "rank")]
    each = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = each.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # at most one row for each length up to the capacity
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 6)
    starts = plan[:, 0] * (1 << 44) + plan[:, 1]
    order = np.argsort(starts)
    plan, starts = plan[order], starts[order]
    ranked = pieces.join(shift, ["length", "chunk"]).select(*names, (F.col("shift") + F.col("rank")).alias("rank"))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*names).dtypes) + ", sequence_id long, offset long"

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = plan[np.searchsorted(starts, length * (1 << 44) + rank, "right") - 1]
            inside = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(r[:, 3] + inside // r[:, 4]), pa.array(r[:, 5] + inside % r[:, 4] * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of docs (doc_id, text) with its sequence and offset there."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    where = new_path(spark, "pieces")
    token_pieces(docs, path, capacity, with_ids=with_ids).write.parquet(where)
    return place(spark.read.parquet(where), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
