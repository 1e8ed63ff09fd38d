import wave
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import issues, joins, ordered, rules, transcript
from textloom.sources import readers, writers
from textloom.streaming import run, segments


def test_remove_overlap(spark):
    rows = [("and then the lamps went out", "the lamps went out. Nobody moved."), ("abc", "xyz"), (None, "x"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(X.remove_overlap("a", "b")).collect()]
    assert got[0] == "Nobody moved." and got[1] == "xyz" and got[3] == ""


@pytest.mark.parametrize(("text", "copies", "want"), [("ha " * 10, 10, (10, 1)), ("ha " * 9, 10, None), ("so so " * 6, 10, (12, 1)), ("x tick tock tick tock tick tock y", 3, (3, 2)), ("", 3, None), ("a b c a b c a b", 2, (2, 3))])
def test_repeated_grams(spark, text, copies, want):
    df = spark.createDataFrame([(1, text.split())], "k int, words array<string>")
    got = ordered.repeated_grams(df, "k", copies=copies).collect()
    assert [(r.copies, r.ngram_words) for r in got] == ([want] if want else [])


def test_overlaps_flag_both_sides(spark):
    df = spark.createDataFrame([(1, 1, 250, 3500), (1, 2, 3000, 5000), (1, 3, 5000, 6000), (2, 4, 0, 9)], "k int, id int, s int, e int")
    got = {r.id: r.overlaps for r in ordered.overlapping(df, ["k"], "s", "e", "id").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_folds(spark):
    rows = [(1, 0.0, 10), (1, 5.0, 10), (1, 21.0, 10), (2, 3.0, 90), (2, 4.0, 40), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "k int, seconds double, size long")
    got = sorted(((r.k, r.seconds, r.block) for r in ordered.folded(df, ["k"], ["seconds"], ordered.block_of(20, 150, 20.0), None, "block int").collect()), key=str)
    assert got == sorted([(1, 0.0, 0), (1, 5.0, 0), (1, 21.0, 1), (2, 3.0, 0), (2, 4.0, 1), (None, 1.0, 0)], key=str)
    assert ordered.folded(df.limit(0), ["k"], ["seconds"], ordered.block_of(1, 1, 1.0), None, "block int").count() == 0
    spans = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 5, 6), (1, 8, 9)], "k int, start int, end int")
    assert [(r.start, r.kept) for r in ordered.folded(spans, ["k"], ["start"], ordered.kept_disjoint, None, "kept boolean").orderBy("start").collect()] == [(0, True), (3, False), (5, True), (8, True)]


def test_containing(spark):
    texts = spark.createDataFrame([(1, "xx the quick brown fox jumps"), (2, "quick brown fox"), (3, None), (4, "a quick brown fix"), (5, "")], "t int, text string")
    items = spark.createDataFrame([(1, "quick brown fox jumps"), (2, "brown"), (3, ""), (4, None), (5, "the quick brown fox j")], "i int, item string")
    want = {(t.t, i.i) for t in texts.collect() for i in items.collect() if t.text is not None and i.item is not None and i.item in t.text}
    assert {(r.t, r.i) for r in joins.containing(texts, items, "text", "item").collect()} == want and len(want) == 9


def test_bisection_covers_everything(spark):
    df = spark.range(1).select(F.lit(0).cast("long").alias("s"), F.lit(90 * 16000).cast("long").alias("e"))
    got = sorted((r.s, r.e) for r in ordered.bisected(df, "s", "e", lambda s, e: F.lit(True), 3, 3 * 16000).collect())
    assert got[0][0] == 0 and got[-1][1] == 90 * 16000 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False)) and len(got) == 8


def test_transcript(spark):
    raw = '---\ntitle: "x"\nkey: a:b\n---\n# Heading\n\nA: hello [Cough] there\nand  more\n\n[Ca++] ions\nB: next [cough]'
    df = spark.createDataFrame([(1, raw)], "id int, raw string")
    assert df.select(transcript.front_matter(F.col("raw"))).first()[0] == {"title": "x", "key": "a:b"}
    got = sorted((r.source_line, r.speaker, r.text, list(r.removed), list(r.unknown)) for r in transcript.paragraphs(df, "id", "raw", {"cough"}).collect())
    assert got == [(7, "A", "hello there and more", ["Cough"], []), (10, None, "[Ca++] ions", [], ["Ca++"]), (11, "B", "next", ["cough"], [])]


def test_leaks_by_every_key(spark):
    held = spark.createDataFrame([(1, "h1", "s1"), (2, "h2", "s2")], "id int, hash string, source string")
    other = spark.createDataFrame([("h1", "s9"), ("h8", "s2")], "hash string, source string")
    assert sorted(map(tuple, issues.held_out_leaks(held, other, ["hash", "source"], "id").collect())) == [(1, "hash"), (2, "source")]


def test_require_raises(spark):
    with pytest.raises(Exception, match="too small"):
        issues.require(spark.range(3), F.col("id") > 0, "too small").collect()


def test_publish_is_whole_or_nothing(spark, tmp_path):
    df, target = spark.range(3), str(tmp_path / "out")
    with pytest.raises(ValueError, match="refused"):
        writers.publish(spark, target, {"a": df}, violations=df.where("id = 1"))
    assert not (tmp_path / "out").exists() and not list(tmp_path.iterdir())
    writers.publish(spark, target, {"a": df}, violations=df.where("id > 9"))
    assert spark.read.json(f"{target}/a").count() == 3
    with pytest.raises(ValueError, match="exists"):
        writers.publish(spark, target, {"a": df})


def test_publish_refuses_inputs_that_change(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one")

    def touched(rows):
        (source / "a.txt").write_text("two")
        yield from rows

    df = spark.range(2).coalesce(1).mapInPandas(touched, "id long")
    with pytest.raises(ValueError, match="inputs changed"):
        writers.publish(spark, str(tmp_path / "out"), {"a": df}, inputs=str(source))
    assert not (tmp_path / "out").exists()
    writers.publish(spark, str(tmp_path / "out"), {"a": spark.range(2)}, inputs=str(source))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a"]


def test_quarantine_is_published_beside_all(spark, tmp_path):
    df = spark.createDataFrame([(1, "pass"), (2, "quarantined"), (3, None)], "id int, status string")
    writers.publish_quarantined(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/all")).count() == 3 and {r.id for r in spark.read.json(str(tmp_path / "out/quarantine")).collect()} == {2, 3}


def test_small_files_and_fingerprints(spark, tmp_path):
    path = str(tmp_path / "state.txt")
    assert writers.read_text(spark, path) is None
    writers.write_text(spark, path, "one\ntwo")
    writers.write_text(spark, path, "three\nfour")
    assert writers.read_text(spark, path) == "three\nfour" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["state.txt"]
    writers.require_fingerprint(spark, str(tmp_path / "f"), "a")
    writers.require_fingerprint(spark, str(tmp_path / "f"), "a")
    with pytest.raises(ValueError, match="other settings"):
        writers.require_fingerprint(spark, str(tmp_path / "f"), "b")


def test_manifests_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, id int")
    writers.write_manifests(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/split=test")).first().id == 2
    writers.write_report(df.groupBy("split").count(), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    lines = spark.createDataFrame([("T", ["x", "y"])], "t string, l array<string>")
    assert lines.select(writers.markdown(F.col("t"), F.col("l"))).first()[0] == "# T\n\n- x\n- y\n"


def test_other_sources(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{"splits": {"b": "train",\n "a": "odd", "c": "train"}}')
    doc = readers.json_document(spark, str(tmp_path / "doc.json"), "splits map<string,string>")
    assert sorted(map(tuple, readers.split_settings(doc).collect())) == [("a", "odd", False), ("b", "train", True), ("c", "train", True)]
    folder = tmp_path / "records"
    folder.mkdir()
    for name, at in (("r1", "2024-01-01"), ("r2", "2024-02-01"), ("bad name!", "2024-03-01")):
        (folder / f"{name}.json").write_text('{"updatedAt": "%s"}' % at)
    assert [r.id for r in readers.records(spark, str(folder), "updatedAt string").collect()] == ["r2", "r1"]
    assert [r.sample for r in readers.cyclic(spark, 5, 3, 2).orderBy("i").collect()] == [2, 0, 1, 2, 0]
    pages = spark.createDataFrame([(1, "old"), (2, "x" * 30), (3, "new"), (4, None)], "id int, body string")
    there = spark.createDataFrame([(1,)], "id int")
    got = {r.id: r.state for r in readers.fetched(pages, there, "id", "body", 20).collect()}
    assert got == {1: "cached", 2: "too_large", 3: "fetched", 4: "failed"}


def test_duplicate_titles_of_settings(spark):
    df = spark.createDataFrame([("One",), ("01_One",), ("Two",)], "title string")
    assert [tuple(r) for r in readers.repeated_titles(df, "title").collect()] == [("One", 2)]


def test_write_once_refuses_drift(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.write_once(spark.range(3), path) and not writers.write_once(spark.range(3), path)
    with pytest.raises(ValueError, match="other rows"):
        writers.write_once(spark.range(4), path)


def test_revisions(spark):
    stored = spark.createDataFrame([("a", 1, "x")], "id string, revision int, value string")
    saves = spark.createDataFrame([("a", 1, "new"), ("a", 1, "other"), ("a", 0, "old"), ("b", 0, "first")], "id string, revision int, value string")
    new, refused = writers.save_revisions(stored, saves)
    assert sorted(map(tuple, new.collect())) == [("a", 2, "new"), ("b", 1, "first")]
    assert sorted(map(tuple, refused.collect())) == [("a", 0, "old"), ("a", 1, "other")]


def test_wav_round_trip_and_bad_file(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000), w.writeframes(b"\1\0" * 50)
    (tmp_path / "b.wav").write_bytes(b"none")
    (tmp_path / "a.txt").write_text("x")
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(tmp_path)).select(readers.wav("content").alias("w")).select("w.*")
    rows = sorted(((r.rate, r.frames, r.error is None) for r in df.collect()), key=str)
    assert rows == [(16000, 50, True), (None, None, False)]
    found = readers.files(spark, str(tmp_path), {".wav": "audio", ".txt": "text"})
    assert [tuple(r) for r in readers.unpaired(found, "audio", "text").collect()] == [("b", "text")]


def test_json_lines_are_strict(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": oops}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.json_lines(spark, str(tmp_path), "a int").collect()


def test_page_json(spark):
    html = '<html><script id="d" type="application/json">{"n": 3}</script></html>'
    df = spark.createDataFrame([(html,), ("<p>",), (None,)], "h string")
    assert [r[0] and r[0].n for r in df.select(readers.page_json(F.col("h"), "d", "n int")).collect()] == [3, None, None]


Sound = namedtuple("Sound", "level size final")


def test_speech_gate():
    """Segments against what the rules say of whole blocks of 20 ms."""
    rules = segments.Rules()
    step = segments.gate_step(rules)
    quiet, loud = Sound(0.0, 320, False), Sound(0.02, 320, False)
    # speech of 0.3 s, a pause that ends it
    _, out = segments.stepped(step, segments.Gate(), [quiet] * 30 + [loud] * 15 + [quiet] * 40)
    (only,) = [x for x in out if x[3]]
    assert only == (0, (30 - 10) * 320, (45 + 25) * 320, True, False)  # the lead before it, the pause behind it
    # too little speech gives nothing; a session that ends gives the open segment
    assert segments.stepped(step, segments.Gate(), [loud] * 7 + [quiet] * 40)[1] == []
    assert segments.stepped(step, segments.Gate(), [loud] * 10 + [Sound(0.02, 320, True)])[1] == [(0, 0, 11 * 320, True, False)]
    # long speech is cut, and the next segment begins with the end of the one before
    _, out = segments.stepped(step, segments.Gate(), [loud] * 900 + [Sound(0.0, 320, True)])
    finals = [x for x in out if x[3]]
    assert [(x[1], x[2], x[4]) for x in finals] == [(0, 128000, False), (128000 - 6400, 249600, True), (249600 - 6400, 901 * 320, True)]
    previews = [x for x in out if not x[3]]
    assert all(b[2] - a[2] >= 5600 for a, b in zip(previews, previews[1:], strict=False) if a[0] == b[0]) and len(previews) > 40


def test_endpoints():
    packet = namedtuple("Packet", "seconds silent final")
    step = segments.endpoint_step()
    rows = [packet(1.0, True, False), packet(0.5, True, False), packet(2.0, False, False), packet(0.7, True, False), packet(19.0, False, False), packet(2.0, False, False), packet(0.1, False, True)]
    assert [x[3] for x in segments.stepped(step, segments.Endpoint(), rows)[1]] == ["silence", "pause", "length", "final"]


def test_ingest():
    packet = namedtuple("Packet", "arrival sequence final fails")

    def outcomes(*rows):
        return [x[2] for x in segments.stepped(segments.ingest_step, segments.Ingest(), [packet(i, *r) for i, r in enumerate(rows)])[1]]

    assert outcomes((0, False, False), (0, False, False), (3, False, False), (1, True, False), (1, True, False), (2, False, False)) == ["accepted", "replayed", "refused", "accepted", "replayed", "refused"]
    assert outcomes((0, False, True), (0, False, False), (1, False, False)) == ["failed", "refused", "refused"]
    assert outcomes((1, False, False)) == ["refused"]


def test_overlaps_in_turn(spark):
    rows = [("the boats came home at dusk", True), ("home at dusk, and were counted", False), ("home at dusk, and were counted twice", True), ("counted twice. Nobody slept", True), ("new", True)]
    row = namedtuple("Row", "place text final")
    got = [x[1] for x in segments.stepped(segments.overlap_step, segments.Spoken(), [row(i, *r) for i, r in enumerate(rows)])[1]]
    assert got == ["the boats came home at dusk", "and were counted", "and were counted twice", "Nobody slept", "new"]
    pairs = [("ab cd ef gh", "cd, ef gh! ij"), ("", "x"), ("x", ""), ("abcdefg", "abcdefg"), ("one two", "two one two")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(X.remove_overlap("a", "b")).collect()] == [segments.without_overlap(a, b) for a, b in pairs]


def test_previews_give_way(spark):
    q = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "b", True), (4, "b", False), (5, "c", False), (6, "d", False)], "arrival int, id string, final boolean")
    assert {r.arrival for r in run.coalesced_previews(q).collect()} == {2, 3, 5, 6} and {r.arrival for r in run.coalesced_previews(q, 3).collect()} == {3, 5, 6} and {r.arrival for r in run.coalesced_previews(q, 0).collect()} == {3}


def test_state_of_other_settings_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert run.drained(rows, "append", "x", place=str(tmp_path / "place"), fingerprint="one").count() == 3
    with pytest.raises(ValueError, match="other settings"):
        run.drained(rows, "append", "x", place=str(tmp_path / "place"), fingerprint="two")
    assert run.drained(rows, "append", "x", place=str(tmp_path / "place"), fingerprint="one").count() == 3


def test_requests_as_a_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "text": "x"}\n{"id": 2, "text": null}\n')
    assert {r.id for r in run.drained(run.json_stream(spark, str(tmp_path), "id long, text string"), "append", "json").collect()} == {1, 2}


def test_held_out_rows_are_refused(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    with pytest.raises(Exception, match="held-out"):
        rules.refuse_held_out(df).collect()
    with pytest.raises(ValueError, match="held-out"):
        rules.refuse_held_out(df, path="x/test.jsonl")
    assert rules.refuse_held_out(df.where("id = 1"), path="x/train.jsonl").count() == 1


def test_review_outcomes(spark):
    seen = spark.createDataFrame([("a", "h1", "t1"), ("b", "h2", None)], "id string, audio string, words string")
    reviews = spark.createDataFrame([("a", "h1", "t1", "approved"), ("a", "h0", "t1", "approved"), ("b", "h2", None, "maybe"), ("c", "h", "t", "approved"), ("b", "h2", None, "rejected")], "id string, audio string, words string, status string")
    assert sorted(r.outcome for r in rules.review_outcomes(reviews, seen, ["id", "audio", "words"]).collect()) == ["approved", "invalid_status", "rejected", "stale", "unknown"]
