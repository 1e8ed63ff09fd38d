"""Normal forms of columns against plain Python, on texts on both sides of the fast path."""

import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import unicode as U

TEXTS = ["Plain words, 12!", "Größe ÀÉ ø", "ﬁn ② ＫＭ ½ µ ª", unicodedata.normalize("NFD", "Ångström é"), "\u212b ς Σ ß", "", None, "漢字 ｶﾅ", "a\u00a0b \u00b5"]


def test_forms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("i", U.normalized("t").alias("n"), U.composed("t").alias("c"), U.folded("t").alias("f")).collect():
        t = TEXTS[r.i]
        assert r.n == U.normalize(t) and r.c == (None if t is None else unicodedata.normalize("NFC", t)) and r.f == (None if t is None else U.fold(t))


def test_json_and_clocks(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, None)], "b int, a double, c string")
    assert [r[0] for r in df.select(X.strict_json("b", "a", "c")).collect()] == ['{"a":2.5,"b":1,"c":"x"}', '{"a":null,"b":2,"c":null}']
    with pytest.raises(Exception, match="not finite"):
        df.select(X.strict_json("b", "a").alias("j"), F.lit(1)).unionAll(spark.createDataFrame([(float("nan"), 1)], "a double, b int").select(X.strict_json("b", "a"), F.lit(1))).collect()
    assert [r[0] for r in spark.createDataFrame([(0.0,), (61.239,), (3599.999,), (3600.5,)], "s double").select(X.clock_fine(F.col("s"))).collect()] == ["0:00.00", "1:01.23", "59:59.99", "60:00.50"]


def test_spans_come_in_bounded_batches(spark):
    texts = ["Ａb é" * 30, None, "", "ﬁx ß" * 10] * 20
    rows = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    got = list(U.span_batches([rows, rows.slice(0, 0)], "text", 200))
    assert len(got) > 5 and all(sum(map(len, b.column("text").to_pylist())) < 200 + 120 for b in got)
    want = [(k, t, [a for a, _ in s], [b for _, b in s]) for k, (t, s) in enumerate(U.normalize_with_spans(t or "") for t in texts)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert sorted(tuple(r) for r in U.with_normalized_spans(df).collect()) == want
