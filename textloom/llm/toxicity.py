"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text: densities of a lexicon of insults (written plainly, obfuscated by
look-alike characters, inner punctuation, repeated or masked letters, or spelt letter by
letter) and of a lexicon learnt from the labels (words, and beginnings of words, that mark
toxic documents), how near second-person words stand to the hits, and rates of capitals,
punctuation and obfuscation. Each half of the rows learnt from gives a lexicon by which the other half's
features are made; on histograms of these grow the trees. Pool adjacent violators turn margins
into probabilities, on margins of rows that the trees behind them have not seen. Documents are scored with the
lexicon of all rows.

Defined cases: null text counts as empty and has all features zero; repeated ids give a
row each; extra columns are ignored; without labels of both classes every score is the
share of label 1 (0.5 without labels); labels that are null or neither 0 nor 1 are not
learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import held_out, table, text_blocks
from textloom.llm.docstats import KIND
from textloom.llm.quality import MAX_FIT_ROWS, labelled_sample
from textloom.llm.words import codes, mix

#: Words whose use against someone is abusive, in the languages that the corpus holds.
LEXICON = """
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin dimwit halfwit nitwit fool
loser losers pathetic worthless useless trash garbage scum scumbag vermin filth filthy disgusting disgrace clown clowns
pig swine rat parasite coward liar creep freak retard retarded lunatic psycho jerk bastard bitch whore slut asshole
arsehole dickhead prick wanker twat shit bullshit crap fuck fucking fucker hate despise
idiote imbécile crétin connard connasse salope ordure débile merde
dummkopf trottel vollidiot arschloch schlampe abschaum drecksau wichser
estúpido imbécil pendejo cabrón gilipollas puta basura inútil mierda
""".split()
SECOND_PERSON = "you your yours yourself youre u ur ya tu toi vous votre ton ta du dein deine dich dir ihr euch tú usted ustedes vosotros".split()
#: Look-alikes of letters inside words.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
#: Bytes of the beginnings of words that the learnt lexicon may hold.
STEMS = (4, 5, 6)
#: Entries of the learnt lexicon at most, in how many toxic documents each stands at least, and its least log-odds.
LEAST_DOCS, LEAST_ODDS = 3, 3.0
#: Words apart within which a second-person word counts as near.
NEAR = 5

NAMES = (
    "log_words", "plain", "plain_count", "obfuscated", "obfuscated_count", "spelt", "near_share", "near_count", "second_person",
    "learnt", "learnt_count", "learnt_stems", "capitals", "caps_words", "caps_hits", "exclaim", "question", "punct", "symbols", "digits_in_words", "mean_word", "distinct_hits",
)


def _table(kept: dict[int, int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for a, b in kept.items():
        out[a] = b
    return out


_LETTERS = {c: c | 32 for c in range(65, 91)} | {c: c for c in range(97, 123)} | {c: c for c in range(128, 256)}
#: Plain reading: letters in lower case, all else 0, which ends a word.
PLAIN = _table(_LETTERS)
#: Open reading: look-alikes are letters too; 1 marks white space and 0 is skipped inside a word.
OPEN = _table(_LETTERS | {ord(a): ord(b) for a, b in LOOK_ALIKES.items()} | dict.fromkeys((9, 10, 11, 12, 13, 32), 1))
MASKS = np.isin(np.arange(256), list(b"*#%_"))


def hash_runs(letters: np.ndarray, first: np.ndarray, length: np.ndarray, stems: bool = False):
    """A hash of each run letters[first : first + length].

    With stems also those of the first STEMS bytes, a row for each size, zero where the run isn't longer.
    """
    if not len(first):
        return (np.zeros(0, np.uint64), np.zeros((len(STEMS), 0), np.uint64)) if stems else np.zeros(0, np.uint64)
    whole = codes(letters, first, length)
    if not stems:
        return whole
    begun = np.zeros((len(STEMS), len(first)), np.uint64)
    for row, k in zip(begun, STEMS, strict=True):
        longer = np.flatnonzero(length > k)
        # a beginning isn't the word that is spelt so
        row[longer] = mix(codes(letters, first[longer], np.full(len(longer), k)))
    return whole, begun


def word_hash(word: str | bytes) -> int:
    b = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(hash_runs(b, np.array([0]), np.array([len(b)]))[0])


def squeezed(word: str) -> bytes:
    """Without repeats of a byte."""
    b = word.encode()
    return bytes(c for i, c in enumerate(b) if not i or b[i - 1] != c)


def masked_forms(word: str) -> set[bytes]:
    """What is left of a word of five letters or more when one or two inner letters in a row are masked."""
    b = squeezed(word)
    return {b[:i] + b[i + k :] for k in (1, 2) for i in range(1, len(b) - k)} if len(b) >= 5 else set()


def _hashes(words) -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in words], np.uint64))


HIT = _hashes(LEXICON)
HIT_SQUEEZED = _hashes(squeezed(w) for w in LEXICON if len(w) >= 4)
HIT_MASKED = _hashes(f for w in LEXICON for f in masked_forms(w) if len(f) >= 3)
YOU = _hashes(SECOND_PERSON)


def member(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(codes.shape, bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[at] == codes


def runs(mapped: np.ndarray, inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start in the block, document, length, hash, hashes of the beginnings) of the runs of inside, cut at documents."""
    edge = np.zeros(len(mapped) + 1, bool)
    edge[off] = True
    begins = inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1])
    first = np.flatnonzero(begins)
    letters = mapped[inside]
    at = np.searchsorted(np.flatnonzero(inside), first) if len(first) else first
    length = np.diff(np.append(at, len(letters)))
    return first, np.searchsorted(off, first, "right") - 1, length, *hash_runs(letters, at, length, stems=True)


def word_marks(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the words and beginnings of words of a block, each once for a document."""
    plain = PLAIN[raw]
    _, doc, _, code, begun = runs(plain, plain > 0, off)
    docs, codes = np.concatenate([doc] * (1 + len(STEMS))), np.concatenate([code, *begun])
    pair = np.unique(np.rec.fromarrays([docs[codes > 0], codes[codes > 0]]))
    return pair.f0, pair.f1


def toxic_features(raw: np.ndarray, off: np.ndarray, learnt: np.ndarray = np.zeros(0, np.uint64)) -> np.ndarray:  # noqa: B008
    """A row of NAMES for each document of a block."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    if not n or not len(raw):
        return out
    chars = np.maximum(np.diff(off), 1)
    doc_of = np.repeat(np.arange(n), np.diff(off))
    count = lambda docs, w=None: np.bincount(docs, w, minlength=n)[:n].astype(float)

    plain = PLAIN[raw]
    first, doc, length, code, begun = runs(plain, plain > 0, off)
    words = count(doc)
    per_word = np.maximum(words, 1)
    hit, you = member(code, HIT), member(code, YOU)
    stem_hit = member(begun, learnt).any(0)
    taught = member(code, learnt) | stem_hit
    upper = (raw >= 65) & (raw <= 90)
    caps = np.zeros(len(first), bool)
    if len(first):
        up = np.add.reduceat(upper.astype(np.int64), first)
        caps = (up >= 2) & (up == length)

    # the open reading: words between white space, with look-alikes as letters, other characters skipped
    opened = OPEN[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    solid = opened != 1
    starts = solid & (~np.concatenate(([False], solid[:-1])) | edge[:-1])
    word_of = np.cumsum(starts) - 1
    keep = opened > 1
    kept_at = np.flatnonzero(keep)
    letters, owner = opened[kept_at], word_of[kept_at]
    fresh = np.concatenate(([True], (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1]))) if len(kept_at) else np.zeros(0, bool)
    letters, owner, kept_at = letters[fresh], owner[fresh], kept_at[fresh]
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(owner)))
    open_code = hash_runs(letters, begin, size)
    open_doc = doc_of[kept_at[begin]] if len(begin) else begin
    open_start = kept_at[begin] if len(begin) else begin
    odd = np.zeros(len(begin), bool)
    masked = np.zeros(len(begin), bool)
    if len(begin):
        token = owner[begin]
        n_tokens = int(word_of[-1]) + 1
        plain_bytes = np.bincount(word_of[solid], PLAIN[raw[solid]] > 0, minlength=n_tokens)
        all_bytes = np.bincount(word_of[solid], minlength=n_tokens)
        inner_mask = np.bincount(word_of[solid], MASKS[raw[solid]], minlength=n_tokens)
        odd = (plain_bytes[token] < all_bytes[token]) | (size < all_bytes[token])
        masked = inner_mask[token] > 0
    hit_at = np.unique(first[hit])
    open_hit = (odd & member(open_code, HIT_SQUEEZED)) | (masked & member(open_code, HIT_MASKED))
    # a plain hit with a comma after it is no obfuscation: its plain reading starts at the same place
    covered = np.isin(open_start, hit_at)
    open_hit &= ~covered

    # words spelt letter by letter
    single = size == 1
    spelt_doc = np.zeros(0, np.int64)
    if single.any():
        edge1 = single & ~np.concatenate(([False], single[:-1] & (open_doc[1:] == open_doc[:-1])))
        group = np.cumsum(edge1) - 1
        at = np.flatnonzero(single)
        heads = np.flatnonzero(np.concatenate(([True], group[at][1:] != group[at][:-1])))
        lens = np.diff(np.append(heads, len(at)))
        spelt = hash_runs(letters[begin[at]], heads, lens)
        spelt_doc = open_doc[at[heads]][(lens >= 4) & (member(spelt, HIT) | member(spelt, HIT_SQUEEZED))]

    # nearness of second-person words to hits, in plain words
    index = np.arange(len(first))
    you_at = index[you]
    gap = np.full(len(first), 1 << 30)
    if len(you_at):
        j = np.searchsorted(you_at, index)
        left, right = you_at[np.maximum(j - 1, 0)], you_at[np.minimum(j, len(you_at) - 1)]
        for other in (left, right):
            d = np.abs(index - other)
            gap = np.where(doc[other] == doc, np.minimum(gap, d), gap)
    near = (hit | taught) & (gap <= NEAR)
    hits, near_n, taught_n = count(doc[hit]), count(doc[near]), count(doc[taught])
    obf = count(open_doc[open_hit])
    spelt_n = count(spelt_doc)
    pairs = np.unique(np.column_stack([doc[hit], code[hit].astype(np.int64)]), axis=0) if hit.any() else np.zeros((0, 2), np.int64)
    exclaim, question = count(doc_of[raw == 33]), count(doc_of[raw == 63])
    kind = KIND[raw]
    digit = (raw >= 48) & (raw <= 57)
    touching = digit & (np.concatenate(([False], plain[:-1] > 0)) | np.concatenate((plain[1:] > 0, [False])))
    cols = (
        np.log1p(words), 100 * hits / per_word, np.minimum(hits, 20), 100 * obf / per_word, np.minimum(obf, 20), np.minimum(spelt_n, 20),
        near_n / np.maximum(hits + taught_n, 1), np.minimum(near_n, 20), 100 * count(doc[you]) / per_word,
        100 * taught_n / per_word, np.minimum(taught_n, 20), np.minimum(count(doc[stem_hit]), 20), count(doc_of[upper]) / chars,
        count(doc[caps]) / per_word, count(doc[caps & hit]), exclaim / chars, question / chars, count(doc_of[(kind == 4) | (kind == 5)]) / chars,
        count(doc_of[kind == 6]) / chars, count(doc_of[touching]) / chars, chars / per_word, count(pairs[:, 0]),
    )
    for k, c in enumerate(cols):
        out[:, k] = c
    return out


@dataclass
class Boosted:
    """Trees of a fixed depth as arrays: a split feature and threshold for each inner node, a value for each leaf."""

    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    steps_x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps_y: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if len(self.steps_x):
            return np.interp(m, self.steps_x, self.steps_y)
        return 1 / (1 + np.exp(-m))


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots of the non-decreasing fit, one for each block, smoothed by half a row each way."""
    order = np.argsort(m, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for a, b in zip(m[order], y[order], strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    x = np.array([b[2] / b[1] for b in blocks])
    v = np.array([(b[0] + 0.5 * (b[0] > 0)) / (b[1] + 0.5 + 0.5 * (b[0] == 0)) for b in blocks])
    return x, np.clip(np.maximum.accumulate(v), 0, 1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 0.5, least: float = 0.5) -> Boosted:
    """Newton boosting of the logistic loss on histograms of quantile bins."""
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p0 / (1 - p0))), depth)
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        edges.append((values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    width = max(len(e) for e in edges) + 1
    m = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feat = np.zeros(2**depth - 1, np.int64)
        thr = np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, wide = 2**level - 1, 2**level
            local = node - base
            best = np.zeros(wide)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * width + binned[:, j]
                gs = np.bincount(key, g, wide * width).reshape(wide, width).cumsum(1)
                hs = np.bincount(key, h, wide * width).reshape(wide, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(e) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], feat[base + k], thr[base + k] = top[k], j, e[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feat[node]] > thr[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.feature.append(feat)
        model.threshold.append(thr)
        model.value.append(value)
        m = m + value[leaf]
    return model


def half_of(doc_id: str = "doc_id"):
    """0 or 1, by a hash of the id, of whatever type."""
    return F.pmod(F.xxhash64(F.lit(7), F.col(doc_id)), F.lit(2)).cast("int")


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Boosted | float:
    """Trees on all rows, calibrated on margins that trees from the other fold give; the share of label 1 where a class is missing."""
    if len(y) < 8 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    model = grow(x, y)
    if y[fold].sum() in (0, fold.sum()) or y[~fold].sum() in (0, (~fold).sum()):
        return model
    unseen = np.zeros(len(y))
    for part in (fold, ~fold):
        unseen[part] = grow(x[~part], y[~part]).margin(x[part])
    model.steps_x, model.steps_y = isotonic(unseen, y)
    return model


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and beginnings of words that mark toxic rows: those of half 0, of half 1, and of both. The sample is bounded, and with it its words."""

    def run(batches):
        for b in batches:
            halves, y = b.column("__half").to_numpy(), b.column("__y").to_numpy()
            for at, end, raw, off in text_blocks(b.column("text")):
                doc, marks = word_marks(raw, off)
                for h in (0, 1):
                    use = halves[at:end] == h
                    d, code = doc[use[doc]], marks[use[doc]]
                    code, inv, n = np.unique(code, return_inverse=True, return_counts=True)
                    bad = np.bincount(inv, y[at:end][d], minlength=len(code)) if len(code) else np.zeros(0)
                    # the rows themselves are counted under the code zero
                    code = np.append(code, np.uint64(0)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code), pa.array(np.full(len(code), h, np.int32)), pa.array(np.append(bad, y[at:end][use].sum()).astype(np.int64)), pa.array(np.append(n, use.sum()).astype(np.int64))],
                        ["code", "half", "bad", "n"],
                    )

    of = lambda c, h: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}")
    counts = sample.mapInArrow(run, "code long, half int, bad long, n long").groupBy("code").agg(*(of(c, h) for c in ("bad", "n") for h in (0, 1)))
    bad, n = F.col("bad0") + F.col("bad1"), F.col("n0") + F.col("n1")
    # the total goes along as one more row, so that one pass over the counts suffices
    found = counts.where((F.col("code") == 0) | ((bad >= LEAST_DOCS) & (bad > 0.3 * n))).toPandas()
    total, rows = found[found["code"] == 0], found[found["code"] != 0]

    def marking(bad_name, n_name) -> np.ndarray:
        if not len(total):
            return np.zeros(0, np.uint64)
        bad_all, all_ = float(total.eval(bad_name).iloc[0]), float(total.eval(n_name).iloc[0])
        if not bad_all or bad_all == all_ or not len(rows):
            return np.zeros(0, np.uint64)
        b, m = rows.eval(bad_name), rows.eval(n_name)
        odds = np.log((b + 0.5) / (bad_all + 1)) - np.log((m - b + 0.5) / (all_ - bad_all + 1))
        kept = rows[(odds >= LEAST_ODDS) & (b >= LEAST_DOCS)]
        return np.unique(kept["code"].to_numpy().view(np.uint64))

    return marking("bad0", "n0"), marking("bad1", "n1"), marking("bad0 + bad1", "n0 + n1")


@dataclass
class Toxicity:
    """The learnt lexicon and the trees, or a constant score where no trees could be grown."""

    lexicon: np.ndarray
    trees: Boosted | float

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        if isinstance(self.trees, float):
            return np.full(len(off) - 1, self.trees)
        return self.trees.score(toxic_features(raw, off, self.lexicon))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> Toxicity:
    """Fit on a bounded sample of labelled rows (see quality.labelled_sample); their features come to the driver."""
    sample = labelled_sample(docs, labels, label, max_rows).withColumn("__half", half_of())
    *other, lexicon = learn_lexicon(sample)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("half", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            # each row with the lexicon that the other half gave
            half = b.column("__half").to_numpy()
            x = np.zeros((b.num_rows, len(NAMES)))
            for at, end, raw, off in text_blocks(b.column("text")):
                both = [toxic_features(raw, off, other[1 - h]) for h in (0, 1)]
                x[at:end] = np.where((half[at:end] == 0)[:, None], both[0], both[1])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__half").cast(pa.int32()), b.column("__y").cast(pa.int32()), rows], ["doc_id", "half", "y", "x"])

    rows = sample.mapInArrow(run, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(max_rows).toPandas()
    if not len(rows):
        return Toxicity(lexicon, 0.5)
    return Toxicity(lexicon, fit(np.array(rows["x"].tolist()), rows["y"].to_numpy().astype(float), rows["half"].to_numpy() == 1))


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the calibrated score as a last column; no shuffle, whole texts, block by block."""
    names = [c for c in docs.columns if c != column]
    schema = docs.select(*names).schema.add(column, "double")

    def run(batches):
        for b in batches:
            parts = [model.score(raw, off) for _, _, raw, off in text_blocks(b.column(text))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(score)], [*names, column])

    return docs.select(*names).mapInArrow(run, schema)


def op4_toxicity_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
