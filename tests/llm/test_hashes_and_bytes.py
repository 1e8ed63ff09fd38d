"""Texts built so that sums of hashes would cancel: op3's segments, op8's words, language slices, whole rows of op8."""

import glob
import random
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import docstats, language, packing, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


def without(rows, length=100):
    """doc_id, bytes, removed, spans and what is kept, window by window."""
    seen, out = set(), []
    for d, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", gone)), bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.without_repeats(df, **how).collect())


def test_texts_of_the_same_parts_in_other_orders(spark):
    """Fillers by the parity of binary digits, and swapped: sums of place-weighed hashes are equal, and no window stands twice."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    part = lambda: "".join(rng.choices(letters, k=32))
    some = [part() for _ in range(20_000)]
    low = substring_dedup.gram_hashes(np.frombuffer("".join(some).encode(), np.uint8))[::32]
    g = some[int(low.argmin())]
    a, b = part(), part()
    z = [part() for _ in range(64)]
    first, second = ("".join(g + (x, y)[i.bit_count() % 2] + g + z[i] for i in range(64)) for x, y in ((a, b), (b, a)))
    rows = [(1, first), (2, second)]
    assert found(spark, rows) == without(rows)
    assert all(n == 0 for _, _, n, _, _ in without(rows))


def test_whole_operator_at_its_length(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(200)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = text(500)
    rows = []
    for i in range(120):
        at = rng.randrange(len(base) - 700)
        t = text(rng.randint(0, 60)) + base[at : at + rng.randint(0, 600)] + text(rng.randint(0, 40))
        rows.append((i, rng.choice([t, t, t + "é" * 120, "ab" * 90 + t, base[:150] + t])))
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, None), (301, ""), (302, base * 3)]
    want = without([(i, t or "") for i, t in rows])
    assert sum(r[2] > 0 for r in want) > 60
    for how in ({}, {"hot_segments": 2, "shards": 3}):
        assert found(spark, rows, **how) == want


def test_segments_of_one_code_are_told_apart_by_the_rest_of_the_digest():
    seg = np.zeros(2, substring_dedup.SEGMENT)
    seg["key"], seg["code"], seg["size"], seg["doc"] = 7, 9, 100, [1, 2]
    assert substring_dedup.firsts(seg).tolist() == [True, False]
    seg["more"] = [1, 2]
    assert substring_dedup.firsts(seg).tolist() == [True, True]


def tricky_words():
    """Runs of letters whose sums of weighed places are equal where places 64 apart differ by a constant."""
    one, two = ["a"] * 140, ["a"] * 140
    one[64], two[0], two[128] = "c", "b", "b"
    return ["".join(one), "".join(two), "-" * 200, "-" * 64 + "+" + "-" * 135, "a" * 64 + "b" + "a" * 75]


def test_token_ids_of_tricky_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tool, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    for texts in ([t] for t in tricky_words()):
        assert list(tokens.encode(texts)[0]) == tool.encode(texts[0], add_special_tokens=False).ids
    for _ in range(2):  # the second time all words are known
        for t, ids in zip(tricky_words(), tokens.encode(tricky_words()), strict=True):
            assert list(ids) == tool.encode(t, add_special_tokens=False).ids


def test_a_full_table_of_words_starts_anew(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MAX_WORDS", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:40]
    for t in texts:
        assert list(tokens.encode([t])[0]) == tool.encode(t, add_special_tokens=False).ids


def test_rows_of_packing(spark):
    """start, length, ids_crc32, and gapless places in sequences of at most the capacity, from the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*tricky_words(), None, "", "word " * 5000, "Twelve 12 ½ <|endoftext|>", *pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:60]]
    want = {}
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_words_over_64_bytes_in_statistics_and_lexicon():
    a, b = (w.encode() for w in tricky_words()[:2])
    raw = np.frombuffer(a + b" " + b, np.uint8)
    _, _, _, code = docstats.word_table(raw, np.array([0, len(raw)]))
    assert code[0] != code[1]
    assert toxicity.word_hash(a) != toxicity.word_hash(b)


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ 12", "—", "", "_"])
def test_texts_without_letters_have_no_language(text):
    tools = language.Compressors({"en": b"the cat and the dog " * 9, "fr": b"le chat et le chien " * 9})
    assert tools.predict(text) == ("und", 0.0)
    assert tools.predict(text + "the cat and the")[0] == "en"


def test_scripts_of_three_bytes_give_as_many_slices(spark):
    """Every sampled text has its slice in the dictionary, whatever its letters take in bytes."""
    rng = random.Random(2)
    rows = []
    for i in range(240):
        for k, (lang, low) in enumerate((("aa", 97), ("ru", 0x430), ("ja", 0x3041))):
            letters = "".join(chr(low + rng.randrange(26)) for _ in range(300))
            rows.append((1000 * k + i, lang, f"{letters}"))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.learn(docs, max_docs=60, size=60 * 101)
    for lang, each in (("aa", 100), ("ru", 100), ("ja", 99)):
        slices = got[lang].decode().split(" ")
        assert len(slices) == 60 and {len(s.encode()) for s in slices} == {each}


def test_segments_leave_no_shuffle_files(spark):
    """What the segments were shuffled through is gone before the texts are shuffled."""
    place = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in place for p in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    docs = spark.createDataFrame([(i, 0, f"{i % 5} " + "some words " * 30) for i in range(40)], "doc long, row long, text string")
    found = substring_dedup.repeated_spans(docs, shards=4)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and found.count() > 30


def test_segments_of_hot_keys_do_not_go_window_by_window(spark, monkeypatch):
    """A passage in many texts, each with edges of its own: what is stored of them grows with their bytes, not with their windows times the length."""
    rng = random.Random(9)
    part = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = part(300)
    rows = [(i, part(120) + passage + part(120)) for i in range(400)]
    stored, keep = [], substring_dedup.saved
    monkeypatch.setattr(substring_dedup, "saved", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    monkeypatch.setattr(substring_dedup, "drop_saved", lambda df: None)
    assert found(spark, rows, hot_segments=50, shards=4) == without(rows)
    size = sum(df.where(F.col("kind") != substring_dedup.REMOVED).agg(F.sum(F.length("data"))).first()[0] or 0 for df in stored)
    edges = 400 * 2 * 200
    windows = 400 * 2 * 34 * (100 + substring_dedup.SEGMENT.itemsize)
    assert edges < size < windows // 2, (edges, size, windows)
