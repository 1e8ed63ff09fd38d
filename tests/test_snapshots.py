"""Trees of hashes: files of any size, changes by folder and range, what is read again."""

import os

import pytest

from textloom.sources import snapshots, writers


@pytest.fixture
def folder(tmp_path):
    for name, data in (("a/one", b"1" * 250), ("a/two", b"2" * 99), ("b/deep/er/three", bytes(range(200))), ("b/four", b""), ("five", b"5" * 100)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path / "in"


def named(rows, root):
    return sorted((os.path.relpath(r.path.removeprefix("file:"), root), r.kind, r.begin, r.end, r.change) for r in rows if r.kind != "folder")


def read(tree):
    return sum(r.end - r.begin for r in tree.where("was_read").collect())


def test_changes_are_found_from_the_root_down(spark, folder):
    first = snapshots.snapshot(spark, str(folder), range_bytes=100)
    assert first.where("kind = 'folder'").count() == 5 and first.where("kind = 'file'").count() == 5 and first.where("kind = 'range'").count() == 3 + 1 + 2 + 1 + 1
    assert read(first) == 649
    again = snapshots.snapshot(spark, str(folder), range_bytes=100)
    assert snapshots.differences(first, again).count() == 0
    data = bytearray((folder / "a/one").read_bytes())
    data[120] = 0
    (folder / "a/one").write_bytes(data)
    (folder / "b/deep/er/three").write_bytes(bytes(range(201)))
    os.remove(folder / "five")
    (folder / "c").mkdir()
    (folder / "c/new").write_bytes(b"n")
    last = snapshots.snapshot(spark, str(folder), range_bytes=100)
    got = snapshots.differences(first, last).collect()
    assert named(got, folder) == sorted([
        ("a/one", "file", 0, 250, "changed"), ("a/one", "range", 100, 200, "changed"), ("b/deep/er/three", "file", 0, 201, "changed"), ("b/deep/er/three", "range", 200, 201, "came"),
        ("five", "file", 0, 100, "went"), ("five", "range", 0, 100, "went"), ("c/new", "file", 0, 1, "came"), ("c/new", "range", 0, 1, "came"),
    ])
    assert sorted(os.path.relpath(r.path.removeprefix("file:"), folder) for r in got if r.kind == "folder") == [".", "a", "b", "b/deep", "b/deep/er", "c"]


def test_only_what_may_have_changed_is_read_again(spark, folder):
    first = snapshots.snapshot(spark, f"file://{folder}", range_bytes=100)
    (folder / "a/one").write_bytes(b"1" * 249 + b"x")
    os.utime(folder / "a/one", (10**9, 10**9))
    last = snapshots.snapshot(spark, f"file://{folder}", before=first, range_bytes=100)
    assert read(last) == 250 and last.where("kind = 'range'").count() == first.where("kind = 'range'").count()
    assert named(snapshots.differences(first, last).collect(), folder) == [("a/one", "file", 0, 250, "changed"), ("a/one", "range", 200, 250, "changed")]


def test_a_file_of_three_gigabytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in/big", "wb") as f:
        f.truncate(3 << 30)
    first = snapshots.snapshot(spark, str(tmp_path / "in"))
    with open(tmp_path / "in/big", "r+b") as f:
        f.seek((2 << 30) + 77)
        f.write(b"x")
    last = snapshots.snapshot(spark, str(tmp_path / "in"))
    assert first.where("kind = 'range'").count() == 48
    assert [(r.begin, r.end) for r in snapshots.differences(first, last).where("kind = 'range'").collect()] == [(2 << 30, (2 << 30) + (64 << 20))]


def test_changed_files(spark, folder):
    first = writers.snapshot(spark, str(folder))
    (folder / "five").write_bytes(b"6" * 100)
    assert [os.path.basename(r.path) for r in writers.changed_files(first, writers.snapshot(spark, str(folder))).collect()] == ["five"]
