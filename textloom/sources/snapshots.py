"""Snapshots of folders as trees of hashes: what changed is found from the root down, by folder, file and range.

Leaves are hashes of fixed ranges of bytes, read by as many tasks as there are ranges, a piece at a time, so files may be of any size. A file's hash is that of
its length and its ranges' hashes, a folder's that of its entries' names, kinds and hashes. Two trees are compared from the root
down, and only below nodes that differ. A snapshot that is given an earlier one reads again only files whose length or time of change are others.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.scans import stored
from textloom.sources.formats import opened

#: Bytes of a range, and of what a task holds of it at a time.
RANGE, PIECE = 64 << 20, 1 << 20
SCHEMA = "path string, parent string, kind string, number long, begin long, end long, modified timestamp, hash string, was_read boolean"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modified of all files of a folder and the folders in it, empty ones included; names that begin with a dot or underscore are left out, and contents aren't read."""
    system, where = opened(folder)
    root, base = folder.rstrip("/"), where.rstrip("/")
    rows = []
    for f in system.get_file_info(pafs.FileSelector(where, recursive=True)):
        name = f.path[len(base) :]
        if f.type == pafs.FileType.File and not any(part[:1] in ("_", ".") for part in name.strip("/").split("/")):
            rows.append((root + name, f.size, f.mtime_ns // 1000))
    return spark.createDataFrame(rows, "path string, length long, modified long").withColumn("modified", F.timestamp_micros("modified"))


def _hashed(ranges: DataFrame) -> DataFrame:
    """ranges (path, number, begin, end, ...) with hash."""

    def run(batches):
        for b in batches:
            out = []
            for path, begin, end in zip(*(b.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True):
                digest = hashlib.sha256()
                if end > begin:
                    system, where = opened(path)
                    with system.open_input_file(where) as source:
                        for at in range(begin, end, PIECE):
                            piece = source.read_at(min(PIECE, end - at), at)
                            if len(piece) != min(PIECE, end - at):
                                raise OSError(f"{path} has changed while it was read")
                            digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "hash"])

    kinds = ", ".join(f"{c} {t}" for c, t in ranges.dtypes)
    return ranges.repartition(F.col("path"), F.col("number")).mapInArrow(run, f"{kinds}, hash string")


def _parent(path: str = "path"):
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def snapshot(spark: SparkSession, folder: str, before: DataFrame | None = None, range_bytes: int = RANGE) -> DataFrame:
    """The tree of a folder as rows of SCHEMA: ranges (numbered within their file), files and folders; was_read tells ranges that this snapshot has read.

    before: an earlier tree with the same range_bytes. The result is a stored table.
    """
    files = stored(listed(spark, folder), "files")
    count = F.greatest(F.ceil(F.col("length") / range_bytes), F.lit(1))
    ranges = files.select("path", "length", "modified", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("number"))
    ranges = ranges.select("path", "modified", "number", (F.col("number") * range_bytes).alias("begin"), F.least("length", (F.col("number") + 1) * range_bytes).alias("end"), "length")
    if before is None:
        leaves = _hashed(ranges).withColumn("was_read", F.lit(True))
    else:
        known = before.where("kind = 'file'").select("path", F.col("end").alias("length"), "modified")
        old = before.where("kind = 'range'").select("path", "number", "hash")
        kept = ranges.join(known, ["path", "length", "modified"], "left_semi").join(old, ["path", "number"]).withColumn("was_read", F.lit(False))
        leaves = kept.unionByName(_hashed(ranges.join(known, ["path", "length", "modified"], "left_anti")).withColumn("was_read", F.lit(True)))
    leaves = stored(leaves, "ranges")
    tree = leaves.select("path", F.col("path").alias("parent"), F.lit("range").alias("kind"), "number", "begin", "end", "modified", "hash", "was_read")
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda x: x["hash"]), "\n")
    none = F.lit(None).cast("long")
    level = leaves.groupBy("path").agg(F.sha2(F.concat(F.max("length").cast("string"), F.lit("\n"), hashes), 256).alias("hash"), F.max("length").alias("end"), F.max("modified").alias("modified"))
    level = stored(level.select("path", _parent().alias("parent"), F.lit("file").alias("kind"), none.alias("number"), F.lit(0).cast("long").alias("begin"), "end", "modified", "hash", F.lit(None).cast("boolean").alias("was_read")), "tree")
    tree = tree.unionByName(level)
    # folders, the deepest first; a folder is done when all below it are
    root = folder.rstrip("/")
    entries = level
    while True:
        depth = entries.where(F.length("parent") >= len(root)).agg(F.max(F.size(F.split("parent", "/")))).first()[0]
        if depth is None:
            break
        deepest = F.size(F.split("parent", "/")) == depth
        lines = F.array_sort(F.collect_list(F.concat(F.regexp_extract("path", "([^/]+)$", 1), F.lit("\t"), F.col("kind"), F.lit("\t"), F.col("hash"))))
        folders = entries.where(deepest).groupBy(F.col("parent").alias("path")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))
        folders = folders.select("path", _parent().alias("parent"), F.lit("folder").alias("kind"), none.alias("number"), none.alias("begin"), none.alias("end"), F.lit(None).cast("timestamp").alias("modified"), "hash", F.lit(None).cast("boolean").alias("was_read"))
        folders = stored(folders, "tree")
        tree = tree.unionByName(folders)
        entries = stored(entries.where(~deepest).unionByName(folders), "tree")
    return stored(tree, "snapshot")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kind, number, begin, end and change (came, went, changed) of what differs between two trees, folders and files included.

    From the roots down: what is below folders and files that are alike is never compared.
    """
    keys = ["path", "kind", "number"]

    def compared(old: DataFrame, new: DataFrame) -> DataFrame:
        x = old.select(*keys, F.col("begin").alias("b0"), F.col("end").alias("e0"), F.col("hash").alias("h0"))
        y = new.select(*(F.col(k).alias("__" + k) for k in keys), F.col("begin").alias("b1"), F.col("end").alias("e1"), F.col("hash").alias("h1"))
        same = (F.col("path") == F.col("__path")) & (F.col("kind") == F.col("__kind")) & F.col("number").eqNullSafe(F.col("__number"))
        change = F.when(F.col("h0").isNull(), "came").when(F.col("h1").isNull(), "went").otherwise("changed")
        both = x.join(y, same, "full_outer").where(~F.col("h0").eqNullSafe(F.col("h1")))
        return both.select(*(F.coalesce(k, "__" + k).alias(k) for k in keys), F.coalesce("b1", "b0").alias("begin"), F.coalesce("e1", "e0").alias("end"), change.alias("change"))

    # a root is what no other row has for its parent's path
    def roots(tree: DataFrame) -> DataFrame:
        folders = tree.where("kind = 'folder'")
        return folders.join(folders.select(F.col("path").alias("parent")), "parent", "left_anti").select(*tree.columns)

    found = level = stored(compared(roots(before), roots(after)), "differences")
    while not level.where("kind <> 'range'").isEmpty():
        above = level.where("kind <> 'range'").select(F.col("path").alias("parent"), F.when(F.col("kind") == "file", "range").alias("only")).distinct()
        below = lambda tree: tree.where("kind <> 'range' OR number IS NOT NULL").join(above, "parent").where("(only = 'range') = (kind = 'range') OR (only IS NULL AND kind <> 'range')").select(*tree.columns)
        level = stored(compared(below(before), below(after)), "differences")
        found = found.unionByName(level)
    return found
