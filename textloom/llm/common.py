"""What the operators of this subpackage share: tables in the shared folder, splits, text blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker looks at together.
BLOCK_BYTES = 1 << 19
#: Rows of an Arrow batch.
BATCH_ROWS = 2000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("textloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("textloom.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, a lost executor loses nothing, and what was shuffled for it goes at once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete what saved() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def is_scan(df: DataFrame) -> bool:
    """Whether df is files' rows, projected and filtered at most, so that every reading gives them in the same tasks and order."""
    plans = [df._jdf.queryExecution().analyzed()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") and not plan.nodeName().startswith("Relation"):
            return False
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return True


def small_batches(spark: SparkSession) -> None:
    """Let the session send BATCH_ROWS rows at a time to Python, unless it says otherwise: texts of thousands of rows would be held twice beside the heap."""
    if spark.conf.get(_BATCH_KEY) == "10000":  # Spark's own default
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows that no model learns from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes joined, offsets of the rows in them); nulls are empty.

    A block ends before a row that would take it over block_bytes; one longer row makes a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + block_bytes, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end
