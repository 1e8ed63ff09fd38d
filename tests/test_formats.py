"""Sources of Spark's own kind: windows of WAV files, pushed filters, appended lines over restarts."""

import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.sources import formats


@pytest.fixture(scope="module")
def sources(spark):
    formats.register(spark)
    return spark


def write_wav(path, samples, rate=8000, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())


def test_windows_of_wav_files(sources, tmp_path):
    a, b = np.arange(8000 * 7 + 11) % 3000, np.arange(2 * 16000 * 3) % 500
    (tmp_path / "in").mkdir()
    write_wav(tmp_path / "in/a.wav", a)
    write_wav(tmp_path / "in/b.wav", b, 16000, 2)
    write_wav(tmp_path / "in/empty.wav", [])
    (tmp_path / "in/note.txt").write_text("no sound")
    for path in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        rows = sources.read.format("wav_windows").option("path", path).option("seconds", 2).load().orderBy("path", "window").collect()
        assert [(os.path.basename(r.path), r.window, r.start, r.rate, r.channels, r.frames) for r in rows] == [("a.wav", k, 2.0 * k, 8000, 1, 16000) for k in range(3)] + [("a.wav", 3, 6.0, 8000, 1, 8011), ("b.wav", 0, 0.0, 16000, 2, 32000), ("b.wav", 1, 2.0, 16000, 2, 16000)]
        assert np.array_equal(np.concatenate([np.frombuffer(r.pcm, "<i2") for r in rows[:4]]), a) and np.array_equal(np.concatenate([np.frombuffer(r.pcm, "<i2") for r in rows[4:]]), b)
    sources.sql(f"CREATE OR REPLACE TEMP VIEW sound USING wav_windows OPTIONS (path '{tmp_path}/in', seconds '2')")
    assert sources.sql("SELECT count(*), sum(frames) FROM sound").first() == (6, len(a) + len(b) // 2)


def test_filters_choose_the_windows_that_are_read(sources, tmp_path):
    write_wav(tmp_path / "a.wav", np.arange(8000 * 20))
    reader = formats.WavReader(str(tmp_path), 1.0, None)
    left = list(reader.pushFilters([formats.GreaterThanOrEqual(("window",), 3), formats.LessThan(("window",), 6), formats.In(("window",), (1, 4, 5, 9)), formats.EqualTo(("rate",), 8000)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [p.window for p in reader.partitions()] == [4, 5]
    df = sources.read.format("wav_windows").option("path", str(tmp_path)).option("seconds", 1).load().where("window BETWEEN 3 AND 5 AND rate = 8000")
    assert df.rdd.getNumPartitions() == 3 and sorted(r.window for r in df.collect()) == [3, 4, 5]
    assert df.where("path = 'elsewhere'").count() == 0


def test_files_that_are_no_sound(sources, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"RIFF\x00\x00\x00\x00WAVEjunk")
    with pytest.raises(Exception, match="no samples"):
        sources.read.format("wav_windows").option("path", str(tmp_path)).load().collect()
    with pytest.raises(Exception, match="FileNotFound"):
        sources.read.format("wav_windows").option("path", str(tmp_path / "none")).load().collect()


def test_appended_lines_over_restarts(sources, tmp_path):
    (tmp_path / "in").mkdir()

    def append(name, data):
        with open(tmp_path / "in" / name, "ab") as f:
            f.write(data)

    def run():
        rows = sources.readStream.format("appended_lines").option("path", str(tmp_path / "in")).option("part_bytes", 64).load()
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = sources.read.parquet(str(tmp_path / "out")).collect()
        return sorted((os.path.basename(r.path), r.place, r.line) for r in got)

    first = [json.dumps({"n": k, "text": "é" * (k % 7)}, ensure_ascii=False) for k in range(40)]
    append("a", "".join(f"{x}\n" for x in first).encode() + b'{"n": "cut')
    whole = run()
    assert [x[2] for x in whole] == first and [x[1] for x in whole] == [sum(len(y.encode()) + 1 for y in first[:k]) for k in range(40)]
    assert run() == whole  # nothing new
    append("a", b' off"}\r\n\nlast')
    append("b", b"x" * 500 + b"\nsecond\n")
    got = run()
    assert [x[2] for x in got] == [*first, '{"n": "cut off"}', "", "x" * 500, "second"]
    append("a", b" line\n")
    assert [x[2] for x in run()] == [*first, '{"n": "cut off"}', "", "last line", "x" * 500, "second"]
    parsed = sources.read.parquet(str(tmp_path / "out")).select(F.from_json("line", "n string").alias("j")).where("j.n IS NOT NULL")
    assert parsed.count() == 41


def test_a_file_that_shrinks_is_an_error(tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\n")
    reader = formats.LinesReader(str(tmp_path), 100)
    seen = reader.latestOffset()
    (tmp_path / "a").write_bytes(b"one\n")
    with pytest.raises(ValueError, match="shrunk"):
        reader.partitions(seen, reader.latestOffset())
