"""Versions of tables: one writer wins, crashes leave the last version, streams that start again."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from textloom.sources import versions, writers
from textloom.streaming.run import saved_revisions


@pytest.fixture(params=["links", "renames"])
def root(request, tmp_path, monkeypatch):
    """A table's folder, with either way of taking a number."""
    if request.param == "renames":
        monkeypatch.setattr(versions, "_local_path", lambda spark, path: None)
    return f"file://{tmp_path}/table"


def test_of_two_writers_one_is_refused(spark, root):
    a, b = (spark.range(n).withColumn("who", F.lit(w)) for n, w in ((3, "a"), (4, "b")))
    assert versions.read(spark, root) is None and versions.commit(a, root, 0).number == 1
    assert versions.commit(b, root, 1).number == 2
    with pytest.raises(versions.Conflict):
        versions.commit(a, root, 1)
    with pytest.raises(ValueError, match="no version 7"):
        versions.commit(a, root, 7)
    assert versions.read(spark, root).count() == 4 and versions.read(spark, root, 1).count() == 3 and versions.read(spark, root, 9) is None
    assert versions.expire(spark, root, 1) == [1] and versions.numbers(spark, root) == [2] and versions.read(spark, root).count() == 4


def test_writers_at_the_same_time(spark, tmp_path):
    """Eight threads take one number: one wins, and its text is whole."""
    path, won = f"file://{tmp_path}/v/1.json", []
    texts = [str(k) * 10_000 for k in range(8)]
    threads = [threading.Thread(target=lambda t=t: versions.put_file(spark, path, t, False) and won.append(t)) for t in texts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and writers.read_text(spark, path) == won[0] and os.listdir(tmp_path / "v") == ["1.json"]


def test_a_crash_before_the_number_leaves_the_last_version(spark, root, monkeypatch):
    versions.commit(spark.range(3), root, 0)

    def crash(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(versions, "put_file", crash)
    with pytest.raises(OSError, match="lost"):
        versions.commit(spark.range(9), root, 1)
    monkeypatch.undo()
    assert versions.read(spark, root).count() == 3 and versions.commit(spark.range(5), root, 1).number == 2


def test_updates_follow_a_faster_writer(spark, root):
    versions.commit(spark.range(3), root, 0)
    others = iter([True, False])

    def change(now):
        if next(others):  # someone else commits while this change is made
            versions.commit(now.where("id > 0"), root, 1)
        return now.withColumn("id", F.col("id") + 10)

    made = versions.update(spark, root, change, mark=("s", 4))
    assert made.number == 3 and sorted(r.id for r in versions.read(spark, root).collect()) == [11, 12]
    assert versions.update(spark, root, lambda now: now.limit(0), mark=("s", 4)).number == 3  # that batch is there
    assert versions.update(spark, root, lambda now: now.limit(0), mark=("t", 0)).marks == {"s": 4, "t": 0}


def test_texts_are_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/x/report.json"
    writers.write_text(spark, path, "one")
    writers.write_text(spark, path, "two é")
    assert writers.read_text(spark, path) == "two é" and os.listdir(tmp_path / "x") == ["report.json"]
    assert not versions.put_file(spark, path, "three", overwrite=False) and writers.read_text(spark, path) == "two é"


def test_a_restarted_stream_gives_the_same_table(spark, tmp_path):
    """A batch that fails after its commit is run again, and changes nothing then."""
    stored = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, revision int, value string")
    where, place = str(tmp_path / "in"), f"file://{tmp_path}/place"

    def feed(*rows):
        spark.createDataFrame(list(rows), stored.schema).coalesce(1).write.mode("append").parquet(where)

    run = lambda: saved_revisions(spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(where), stored, place)
    feed((1, 1, "x"))
    feed((1, 2, "y"), (2, 0, "late"))
    assert sorted(map(tuple, run().collect())) == [(1, 3, "y"), (2, 1, "b")]
    last = versions.version(spark, f"{place}/table")
    assert last.number == 3 and last.marks == {"saves": 1}
    # as if the run had stopped between the table's version and the stream's own commit
    for name in (".1.crc", "1"):
        if (tmp_path / "place/state/commits" / name).exists():
            os.remove(tmp_path / "place/state/commits" / name)
    assert sorted(map(tuple, run().collect())) == [(1, 3, "y"), (2, 1, "b")] and versions.version(spark, f"{place}/table").number == 3
    feed((2, 1, "z"))
    assert sorted(map(tuple, run().collect())) == [(1, 3, "y"), (2, 2, "z")]
