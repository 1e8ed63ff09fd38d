"""Queries over texts longer than any prefix, against plain Python."""

import random

import pytest
from test_align import slow_distance

from textloom.operators import align as A
from textloom.plans import registry


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, where = random.Random(3), str(tmp_path_factory.mktemp("sf"))
    same = " ".join(f"word{i}" for i in range(100))
    turns = [(1, 0, "user", same + " first end"), (1, 1, "bot", same + " öther & <b>"), (1, 2, "user", same[:-200] + "".join(rng.choice("aé .x") for _ in range(500)))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{where}/conversations.parquet")
    docs = [(1, "a" * 600 + " the end & <b>"), (2, "the x " * 200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{where}/documents.parquet")
    return where, turns, docs


def norm(t):
    return "".join(c for c in t.lower() if c.isalnum())


def test_error_rates(spark, sf):
    where, turns, _ = sf
    texts = [norm(t[3]) for t in turns]
    want = {k: slow_distance(texts[k - 1], texts[k]) for k in (1, 2)}
    got = {r.turn: r for r in registry.QUERIES["turn_error_rate"](spark, where).collect()}
    assert {k: r.edits for k, r in got.items()} == want
    assert {k: r.cer for k, r in got.items()} == {k: round(want[k] / len(texts[k - 1]), 6) for k in want}
    by_role = {r.role: (r.edits, r.reference_chars) for r in registry.QUERIES["micro_average_by_role"](spark, where).collect()}
    assert by_role == {"bot": (want[1], len(texts[0])), "user": (want[2], len(texts[1]))}


def test_differences_and_coverage(spark, sf):
    where, turns, _ = sf
    got: dict[int, list] = {}
    for r in registry.QUERIES["token_diff"](spark, where).collect():
        got.setdefault(r.turn, []).append(r)
    for k in (1, 2):
        assert "".join(r.original for r in got[k]) == turns[k - 1][3] and "".join(r.other for r in got[k]) == turns[k][3]
    share = {r.turn: r.coverage for r in registry.QUERIES["match_coverage"](spark, where).collect()}
    assert share == {k: A.coverage(turns[k - 1][3], turns[k][3]) for k in (1, 2)}


def test_documents_and_turns_go_through_whole(spark, sf):
    where, turns, docs = sf
    assert {r.doc_id: list(r.parts) for r in registry.QUERIES["highlight_split"](spark, where).collect()} == {i: t.split("the") for i, t in docs}
    safe = {r.doc_id: r.payload for r in registry.QUERIES["html_safe_payload"](spark, where).collect()}
    assert safe[1] == '{"text":"' + "a" * 600 + ' the end \\u0026 \\u003cb\\u003e\\u003c/script\\u003e"}' and safe[2].count("the x") == 200
    joined = registry.QUERIES["ordered_concat"](spark, where).collect()
    assert [r.transcript for r in joined] == ["\n".join(f"[{t[2]}] {t[3]}" for t in turns)]
