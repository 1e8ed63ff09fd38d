"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import common, decontaminate, exact_dedup, graph, language, licenses, packing, quality, simhash, substring_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, score string, sequence_id string, kept string, rank string, p string, words string, digest string, fp string, row string, doc string, family string, payload string, n string"
LONG = "word and more " * 30_000
ROWS = [(1, None), (2, ""), (3, "Hello there, you idiot!"), (3, "Hello there, you idiot!"), (None, "Hello  there, you idiot!"), (None, None), (4, LONG), (5, LONG + "x"), (6, "été Straße\x0b\x0c ok"), (7, "Released under the MIT License.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", *["clash"] * 13) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 8)] + [(None, 1, None), (3, None, 5)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, empty, labels):
    model = quality.learn(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.learn(empty, labels) == 0.5 and quality.learn(docs, labels.limit(0)) == 0.5
    assert quality.score_quality(empty, model).count() == 0


def test_toxicity(docs, empty, labels):
    model = toxicity.learn(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(empty, toxicity.learn(empty, labels)).count() == 0


def test_language(docs, empty):
    got = language.identify(docs, language.learn(docs)).collect()
    assert [r.lang_pred for r in got if not r.text] == ["und"] * 3 and len(got) == len(ROWS)
    assert language.learn(empty) == {} and {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == 6
    group = [r for r in got if r.group_size == 3 and r.n_chars]
    assert {r.keep_id for r in group} == {None}  # the text with two blanks is the longest
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.keep_first(docs).count() == 6 and exact_dedup.keep_first(docs).columns == docs.columns


def test_colliding_digests_are_settled_by_full_bytes(docs):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    strong = sorted((str(r.doc_id), r.n_chars, str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert sorted((str(r.doc_id), r.n_chars, str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, digest=weak).collect()) == strong


def test_simhash(docs, empty):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(ROWS) and {r.fp for r in got if r.doc_id in (1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id == 3} == {3}
    assert simhash.near_groups(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, "hello there you idiot"), (2, None), (3, ""), (4, "word and more word and more word"), (5, "Hello there you old idiot"), (6, "hello there you fine idiot friend")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(3, 1), (None, 1), (4, 4), (5, 4)}  # words in their places count: in item 5 and 6 too few are
    assert decontaminate.overlaps(empty, bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench).count() == len(ROWS) - 4  # a null id names no row


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    assert len({(r.doc_id, r.piece) for r in got if r.doc_id == 4}) > 20 and all(r.offset + r.length <= 2048 for r in got)
    assert sum(r.length == 1 for r in got if r.doc_id in (1, 2)) == 2
    assert packing.pack(empty).count() == 0


def test_warc(spark, tmp_path):
    big = "x" * 2000
    rows = [(1, "http://a b/\n", big, "c"), (2, None, big, "c"), (None, "u", big, "c"), (3, "u", None, "c"), (4, "u", "é" * 999, "c"), (4, "u", "é" * 999, "c"), (5, "u", "short", "c"), (6, "u", "short", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    folder = f"file://{tmp_path}/a"
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(pages, folder), folder).collect()}
    assert got == {(1, "revisit", 2, 2000), (2, "response", None, 2000), (None, "revisit", 2, 2000), (3, "response", None, 0), (4, "response", None, 1998), (5, "response", None, 5), (6, "response", None, 5)}
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"{folder}-empty"), f"{folder}-empty").count() == 0


def test_licenses(docs, empty):
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in licenses.scan(docs).collect()] == [(7, 0, "mit", True)]
    assert licenses.scan(empty).count() == 0


def test_substrings(docs, empty):
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in substring_dedup.without_repeats(docs).collect()}
    n = len(LONG)
    assert (5, n + 1, n) in got and (1, 0, 0) in got and (2, 0, 0) in got
    first = next(r for r in got if r[0] == 4)
    assert n - 120 < first[2] < n  # all but the first period of its windows repeats
    assert substring_dedup.without_repeats(empty).count() == 0


@pytest.fixture(scope="module")
def sf_dir(spark, labels, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("stages"))
    labels.write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, "Released under the MIT License."), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, empty, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, sf_dir)
    rows = got.collect()
    if name == "packing":
        assert len({(r.doc_id, r.length) for r in rows if r.doc_id is None}) == 2 and sum(r.piece == 0 for r in rows) == len(ROWS)
    else:
        assert got.columns == docs.columns
        texts = [(r.doc_id, r.text) for r in rows]
        assert set(texts) <= set(ROWS)
        if name == "exact_dedup":
            assert len(texts) == 6
        if name == "near_dedup":
            # the long texts share three of four shingles; rows of one id and those without one stay
            assert sorted(map(repr, texts)) == sorted(map(repr, ROWS))
        if name == "decontamination":
            assert sorted(map(repr, texts)) == sorted(map(repr, [r for r in ROWS if r[0] != 7]))
    assert stage(spark, empty, sf_dir).count() == 0


def test_components(spark):
    """Chains, stars, ties and loops."""
    chain = [(i, i + 1) for i in range(100, 140)]
    links = [*chain, *((200, i) for i in range(201, 230)), (5, 3), (3, 5), (5, 3), (7, 7), (9, 8), (8, 9)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 200 for i in range(200, 230)}, 5: 3, 3: 3, 8: 8, 9: 8}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_wrapped_lines_of_one_letter_and_rows_out_of_a_shuffle(spark):
    """Lines join around a line of one letter; rows that a shuffle deals out anew have the same numbers both times they are read."""
    text = "Licensed under\na\nvariant of the MIT license.\nNext"
    df = spark.createDataFrame([(1, 5, text)], "row_id long, doc_id long, text string")
    assert [r.words for r in licenses.paragraphs(df).orderBy("paragraph").collect()] == [["licensed", "under", "a", "variant", "of", "the", "mit", "license"], ["next"]]
    rows = [(k, "Released under the MIT License." if k % 7 == 0 else f"Nothing here {k}.") for k in range(200)]
    shuffled = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((r.doc_id, r.family) for r in licenses.scan(shuffled).collect()) == [(k, "mit") for k in range(0, 200, 7)]


def test_scans_are_told_from_other_plans(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert common.is_scan(df) and common.is_scan(df.where("id > 1").select("id")) and not common.is_scan(df.repartition(2)) and not common.is_scan(df.join(df.limit(1), "id"))
