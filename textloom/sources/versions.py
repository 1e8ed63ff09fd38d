"""Tables of numbered versions: compare-and-set commits that either win whole or are refused.

A version's rows are written first, to a folder of their own; then a small file that names the folder takes the next number, by an operation that fails
where the number is taken: a hard link on a local file system, elsewhere a rename that doesn't overwrite. So readers see a whole version or the
one before, a crash leaves the last version in place, and of two writers of one version one is refused.

A version also carries marks: for each stream that writes the table its last micro-batch, so that a batch which is run again changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(ValueError):
    """Another writer has made the version already."""


class Version(NamedTuple):
    """A version's number (from 1 on), the folder of its rows, their schema and the marks of streams."""

    number: int
    data: str
    schema: str
    marks: dict[str, int]


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path on this machine's file system, if it is one."""
    fs, where = _file_system(spark, path)
    return where.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _rename(spark: SparkSession, part: str, final: str, overwrite: bool) -> bool:
    """Rename on a file system of Hadoop's; False if the final name is taken and isn't to be replaced."""
    sc, (_, source), (_, target) = spark.sparkContext, _file_system(spark, part), _file_system(spark, final)
    kinds = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if overwrite else kinds.NONE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, how)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def put_file(spark: SparkSession, path: str, text: str, overwrite: bool) -> bool:
    """A small file that is there as a whole or not at all; one that is there is replaced in one step, or left alone and False returned."""
    name = f"{path}.{uuid.uuid4().hex}.part"
    local = _local_path(spark, path)
    if local is not None:
        part = _local_path(spark, name)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(part, "w", encoding="utf-8") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            if overwrite:
                os.replace(part, local)
            else:
                os.link(part, local)
        except FileExistsError:
            return False
        finally:
            if os.path.exists(part):
                os.remove(part)
        return True
    fs, part = _file_system(spark, name)
    try:
        out = fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return _rename(spark, name, path, overwrite)
    finally:
        fs.delete(part, False)


def _version_file(root: str, number: int) -> str:
    return f"{root}/versions/{number:012d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of a table's versions, in order."""
    fs, where = _file_system(spark, f"{root}/versions")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """A version, by default the last; None where there is none."""
    known = numbers(spark, root)
    if not known or (number is not None and number not in known):
        return None
    found = json.loads("\n".join(r[0] for r in spark.read.text(_version_file(root, number or known[-1]), wholetext=True).collect()))
    return Version(**found)


def rows_of(spark: SparkSession, root: str, v: Version) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(v.schema))).parquet(f"{root}/{v.data}")


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version, by default the last."""
    found = version(spark, root, number)
    return None if found is None else rows_of(spark, root, found)


def commit(df: DataFrame, root: str, base: int, marks: dict[str, int] | None = None) -> Version:
    """Make df the version that follows base (0: the first); Conflict, and nothing changed, where that version is there."""
    spark = df.sparkSession
    before = version(spark, root, base) if base else None
    if base and before is None:
        raise ValueError(f"{root} has no version {base}")
    if base + 1 in numbers(spark, root):
        raise Conflict(f"{root} has a version {base + 1}")
    made = Version(base + 1, f"data-{uuid.uuid4().hex}", df.schema.json(), {**(before.marks if before else {}), **(marks or {})})
    df.write.parquet(f"{root}/{made.data}")
    if not put_file(spark, _version_file(root, made.number), json.dumps(made._asdict()), overwrite=False):
        fs, data = _file_system(spark, f"{root}/{made.data}")
        fs.delete(data, True)
        raise Conflict(f"{root} has a version {made.number}")
    return made


def update(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], mark: tuple[str, int] | None = None, tries: int = 10) -> Version:
    """Commit change(rows) on the last version, again on the new one where another writer was faster.

    With a mark (a stream's name and micro-batch), a batch that the table has is not applied again.
    """
    for _ in range(tries):
        last = version(spark, root)
        if last is None:
            raise ValueError(f"{root} has no version")
        if mark is not None and last.marks.get(mark[0], -1) >= mark[1]:
            return last
        try:
            return commit(change(rows_of(spark, root, last)), root, last.number, dict([mark]) if mark else None)
        except Conflict:
            continue
    raise Conflict(f"{root} was changed {tries} times meanwhile")


def expire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Delete all versions but the last keep ones, and their rows; the numbers deleted. Readers of those fail."""
    gone = numbers(spark, root)[:-keep] if keep else []
    for n in gone:
        data = version(spark, root, n).data
        for path, deep in ((_version_file(root, n), False), (f"{root}/{data}", True)):
            fs, where = _file_system(spark, path)
            fs.delete(where, deep)
    return gone
