import base64

import numpy as np
import random

from pyspark.sql import functions as F

from textloom.functions import signal
from textloom.operators import align, records


def test_pcm_round_trip(spark):
    x = np.sin(np.arange(4800) / 9)
    df = spark.createDataFrame([(x.tolist(), 48_000), ([], 16_000)], "s array<double>, r int")
    got = df.select(signal.pcm_samples(signal.pcm_base64(F.col("s"), F.col("r"))).alias("x")).collect()
    assert len(got[0].x) == 1600 and abs(np.array(got[0].x) - x.reshape(-1, 3).mean(1)).max() < 1e-3 and got[1].x == []
    assert np.frombuffer(signal.to_pcm(np.array([-2, -1, 0, 1, 2])), "<i2").tolist() == [-32768, -32768, 0, 32767, 32767]


def test_mono(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "c array<array<double>>")
    assert df.select(signal.mono(F.col("c"))).first()[0] == [2.0, 3.0]


def test_packets(spark):
    ok = base64.b64encode(b"\0" * 6400).decode()
    rows = [(ok, "", "s", 0, False), ("", "", "s", 1, True), ("", "", "s", 1, False), ("a!==", None, None, -1, None)]
    df = spark.createDataFrame(rows, "a string, g string, s string, q long, f boolean")
    got = [r[0] for r in df.select(records.packet_violations(*(F.col(c) for c in "agsqf"))).collect()]
    assert got[:3] == [[], [], ["audio_length"]] and set(got[3]) >= {"glossary_too_long", "audio_not_base64", "session_missing", "sequence_invalid"}


def test_differences_are_whole(spark):
    a, b = "one two three", "one 2 three four"
    d = align.token_diff(a, b)
    rows = [([tuple(x.values()) for x in d], a, b), ([("insert", "x", "y")], "x", "z")]
    df = spark.createDataFrame(rows, "p array<struct<tag:string,original:string,other:string>>, a string, b string")
    got = [r[0] for r in df.select(records.diff_violations(F.col("p"), F.col("a"), F.col("b"))).collect()]
    assert got == [[], ["insert_side", "other_lost"]]


def test_passages_lose_nothing(spark):
    parts = [{"tag": "equal", "original": "word " * 900, "other": "word " * 900}, {"tag": "replace", "original": "a" * 3000, "other": "b. " * 100}, {"tag": "delete", "original": "end.", "other": ""}]
    got = records.passages(parts)
    for side in ("original", "other"):
        assert "".join(p[side] for g in got for p in g["parts"]) == "".join(p[side] for p in parts)
        assert all(sum(len(p[side]) for p in g["parts"]) <= records.PASSAGE for g in got)
    assert [g["index"] for g in got] == list(range(len(got))) and not got[0]["changed"] and got[-1]["changed"] and records.passages([]) == []
    # a passage ends with a sentence once it is long enough, and equal sides are cut alike
    text = "Short one. " * 200
    ends = ["".join(p["original"] for p in g["parts"]) for g in records.passages([{"tag": "equal", "original": t, "other": t} for t in text.splitlines(True)])]
    assert all(e.rstrip().endswith(".") for e in ends)
    sized = records.passages([{"tag": "equal", "original": "x" * 800 + ".", "other": "x" * 800 + "."}, {"tag": "insert", "original": "", "other": "y"}])
    assert len(sized) == 2 and [g["changed"] for g in sized] == [False, True]
    df = spark.createDataFrame([([tuple(p.values()) for p in parts],), (None,)], "p array<struct<tag:string,original:string,other:string>>")
    assert [len(r[0]) for r in df.select(records.passages_udf(F.col("p"))).collect()] == [len(got), 0]


def walked(parts):
    """The rule of passages told character by character: places where passages and parts end, with both sides of a part side by side."""
    out, used, here = [], 0, []
    for part in parts:
        a, b = part["original"], part["other"]
        while a or b:
            if 1400 - used < 150:
                out, used, here = [*out, here], 0, []
            takes = []
            for side in (a, b):
                take = 0
                while take < len(side) and take < 1400 - used:
                    take += 1
                if take < len(side):
                    back = take
                    while back > 0 and side[back - 1] not in " \n":
                        back -= 1
                    take = back if back - 1 > 0.55 * take else take
                takes.append(take)
            if part["tag"] == "equal":
                takes[1] = takes[0]
            here = [*here, (part["tag"], a[: takes[0]], b[: takes[1]])]
            used += max(takes)
            said = (a[: takes[0]] + b[: takes[1]]).rstrip(" \t")
            a, b = a[takes[0] :], b[takes[1] :]
            if a or b or used >= 1300 or (used >= 750 and said.rstrip()[-1:] in [*".!?。？！"]) or (used >= 750 and said.endswith("\n")):
                out, used, here = [*out, here], 0, []
    return [p for p in [*out, here] if p]


def test_passages_against_a_walk():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(["word ", "longer words ", "end. ", "x" * 40, "\n", "No? ", "y" * 300]) for _ in range(n))
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(0, 9)):
            t = text(rng.randrange(0, 60))
            tag = rng.choice(["equal", "equal", "replace", "insert", "delete"])
            parts.append({"tag": tag, "original": "" if tag == "insert" else t, "other": "" if tag == "delete" else t if tag == "equal" else text(rng.randrange(0, 50))})
        got = records.passages(parts)
        assert [[(p["tag"], p["original"], p["other"]) for p in g["parts"]] for g in got] == walked(parts)
        for side in ("original", "other"):
            assert "".join(p[side] for g in got for p in g["parts"]) == "".join(p[side] for p in parts)
            assert all(sum(len(p[side]) for p in g["parts"]) <= 1400 for g in got)


def test_head_size():
    assert records.head_size("a b c", 9) == 5 and records.head_size("x" * 250, 100) == 100
    assert records.head_size("a " + "x" * 250, 100) == 100  # the blank stands too early
    assert records.head_size("x" * 80 + " " + "y" * 90, 100) == 81 and records.head_size("x" * 80 + "\n" + "y" * 90, 100) == 81


def test_review_and_restore(spark):
    rows = [("pass", [], False), ("review_required", ["zero_duration_alignment_token"], True), ("review_required", ["x"], True), ("pass", ["x"], True)]
    df = spark.createDataFrame(rows, "s string, i array<string>, e boolean")
    assert [r[0] for r in df.select(records.review_category(F.col("s"), F.col("i"), F.col("e"))).collect()] == ["automatic_pass", "boundary_review", None, None]
    df = spark.createDataFrame([([(1, "pending"), (2, "done")],)], "b array<struct<id:int,state:string>>")
    assert [x.state for x in df.select(records.restored_blocks(F.col("b"))).first()[0]] == ["failed", "done"]
    t = spark.createDataFrame([("a", 61.0, "y"), ("a", 5.0, "x")], "k string, s double, t string")
    assert tuple(records.timed_text(t, "k", "s", "t").first()) == ("a", "x\ny", "[00:05] x\n[01:01] y")
