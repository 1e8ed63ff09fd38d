"""Rules as table functions of SQL: as the DataFrame functions say, with schemas that follow the arguments."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.streaming import clocked as C
from textloom.streaming import table_functions


@pytest.fixture(scope="module")
def sessions(spark):
    table_functions.register_all(spark)
    rows = [(k, 7 * i + (i % 5) ** 3 * k, i, i % 9 == 8, 30 * (i % 4), i % 3 == 2) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, at long, i long, final boolean, size long, answer boolean").repartition(3)
    df = df.withColumn("at", F.max("at").over(Window.partitionBy("k").orderBy("i")))
    df.createOrReplaceTempView("packets")
    return df.withColumn("ts", F.timestamp_micros("at"))


def sql(spark, call):
    return sorted(map(tuple, spark.sql(f"SELECT * FROM {call}").collect()), key=repr)


@pytest.mark.parametrize(("call", "rule", "columns"), [
    ("sessions_ended(rows => TABLE(SELECT k, at, i, final FROM packets) PARTITION BY k ORDER BY (at, i), session => 'k', gap => 30)", C.silence_rule(30), ["i", "final"]),
    ("blocks_closed(rows => TABLE(SELECT k, at, i, size FROM packets) PARTITION BY k ORDER BY (at, i), session => 'k', span => 40, most => 150)", C.block_rule(40, 150), ["i", "size"]),
    ("saves_due(rows => TABLE(SELECT k, at, i, i AS version FROM packets) PARTITION BY k ORDER BY (at, i), session => 'k', wait => 20)", C.autosave_rule(20), ["i", "version"]),
    ("requests_ended(rows => TABLE(SELECT k, at, i, i DIV 3 AS id, answer FROM packets) PARTITION BY k ORDER BY (at, i), session => 'k', timeout => 25, most => 2)", C.request_rule(25, 2), ["i", "id", "answer"]),
])
def test_calls_equal_the_functions(spark, sessions, call, rule, columns):
    df = sessions.withColumns({"version": F.col("i"), "id": F.floor(F.col("i") / 3).cast("long")})
    want = C.clocked_rows(df, rule, "k", "ts", ["i"], columns)
    got = sql(spark, call)
    assert got == sorted(map(tuple, want.collect()), key=repr) and len(got) > 10
    assert spark.sql(f"SELECT * FROM {call}").columns == want.columns


def test_a_callers_own_step(spark, sessions):
    """A rule whose result has other columns for other arguments, and that rings twice."""

    def counter(every, names=False):
        def step(s, row):
            s = (row.at, 1) if s is None else (s[0], s[1] + 1)
            return s, []

        emits = "start long, n long" + (", label string" if names else "")
        ring = lambda s, at: (None, [(s[0], s[1], *(["many" if s[1] > 2 else "few"] if names else []))])
        return C.Rule(step, lambda s: s[0] + every, ring, "start long, n long", emits)

    table_functions.register(spark, "counted", counter)
    rows = "TABLE(SELECT k, at FROM packets) PARTITION BY k ORDER BY at"
    plain = spark.sql(f"SELECT * FROM counted(rows => {rows}, session => 'k', every => 50)")
    named = spark.sql(f"SELECT * FROM counted(rows => {rows}, session => 'k', every => 50, names => true)")
    assert plain.columns == ["k", "start", "n"] and named.columns == ["k", "start", "n", "label"]
    assert named.drop("label").exceptAll(plain).count() == 0 and sum(r.n for r in plain.collect()) == 200
    assert {(r.n > 2, r.label) for r in named.collect()} <= {(True, "many"), (False, "few")}


def test_refused_calls(spark, sessions):
    for call, said in (
        ("sessions_ended(rows => TABLE(SELECT k, i FROM packets) PARTITION BY k, session => 'k', gap => 1)", "no column at"),
        ("sessions_ended(rows => TABLE(SELECT k, at FROM packets) PARTITION BY k, session => 'nobody', gap => 1)", "no column nobody"),
        ("sessions_ended(rows => 1, session => 'k', gap => 1)", "must be a table"),
    ):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert sql(spark, "sessions_ended(rows => TABLE(SELECT k, at, final FROM packets WHERE false) PARTITION BY k ORDER BY at, session => 'k', gap => 1)") == []
