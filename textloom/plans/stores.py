"""Queries that write what sinks write, and read it back as sources do."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.plans.registry import query, table
from textloom.plans.relational import SPLIT, split_documents
from textloom.plans.reports import _ISSUES, documents_with_issues
from textloom.sources import readers, versions, writers
from textloom.sources.shared import shared_path


@query(f"SELECT doc_id, {SPLIT} AS split, n_chars, sha256(text) AS hash FROM documents")
def manifests_read_back(spark, sf_dir):
    """Documents as JSON lines, a folder for each split, read back strictly."""
    path = shared_path(spark, "manifests")
    writers.write_manifests(split_documents(spark, sf_dir).select("doc_id", "text", "n_chars", "split"), path)
    back = readers.json_lines(spark, path, "doc_id long, text string, n_chars long, split string")
    return back.select("doc_id", "split", "n_chars", F.sha2("text", 256).alias("hash"))


@query(_ISSUES + "SELECT 'all' AS output, doc_id, status, issues FROM s UNION ALL SELECT 'quarantine', doc_id, status, issues FROM s WHERE status <> 'pass'")
def quarantine_read_back(spark, sf_dir):
    """Documents with their issues, published as a whole: all of them, and those that don't pass."""
    path = shared_path(spark, "published")
    writers.publish_quarantined(documents_with_issues(spark, sf_dir).select("doc_id", "status", "issues"), path)
    read = lambda name: readers.json_lines(spark, f"{path}/{name}", "doc_id long, status string, issues array<string>").select(F.lit(name).alias("output"), "doc_id", "status", "issues")
    return read("all").unionByName(read("quarantine"))


@query("SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def report_read_back(spark, sf_dir):
    """A report as one JSON file, read back as a document."""
    path = shared_path(spark, "report")
    report = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    writers.write_report(report.agg(F.collect_list(F.struct("*")).alias("rows")), path)
    return readers.json_document(spark, path, "rows array<struct<lang:string,documents:long,chars:long>>").select(F.explode("rows").alias("r")).select("r.*")


@query("""SELECT vec_id, 16000 AS rate, CAST(len(embedding) AS BIGINT) AS frames, CAST(list_sum(list_transform(embedding, lambda x: floor(least(greatest(x::DOUBLE, -1), 1) * CASE WHEN x < 0 THEN 32768 ELSE 32767 END + 0.5))) AS BIGINT) AS total FROM embeddings""")
def wav_read_back(spark, sf_dir):
    """Vectors as samples of WAV files' bytes, and back."""
    x = F.transform("embedding", lambda v: F.least(F.greatest(v.cast("double"), F.lit(-1.0)), F.lit(1.0)))
    level = F.transform(x, lambda v: F.floor(v * F.when(v < 0, 32768).otherwise(32767) + 0.5).cast("int"))
    low_high = F.transform(level, lambda v: F.concat(F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0"), F.lpad(F.hex(F.pmod(F.floor(v / 256), F.lit(256))), 2, "0")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", writers.wav_bytes(F.unhex(F.array_join(low_high, "")), F.lit(16000)).alias("file"))
    read = rows.select("vec_id", readers.wav("file").alias("w")).where("w.error IS NULL AND w.channels = 1 AND w.width = 2")
    back = F.transform(F.sequence(F.lit(1).cast("long"), F.col("w.frames") * 2 - 1, F.lit(2).cast("long")), lambda i: F.conv(F.hex(F.substring(F.col("w.pcm"), i.cast("int") + 1, F.lit(1))), 16, 10).cast("int") * 256 + F.conv(F.hex(F.substring(F.col("w.pcm"), i.cast("int"), F.lit(1))), 16, 10).cast("int"))
    signed = F.transform(back, lambda v: F.when(v >= 32768, v - 65536).otherwise(v))
    return read.select("vec_id", "w.rate", "w.frames", F.aggregate(signed, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("SELECT lang, CAST(CASE WHEN lang < 'f' THEN 3 ELSE 1 END AS INT) AS version, count(*) AS documents FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def versions_read_back(spark, sf_dir):
    """A table in numbered versions: counts of documents, of which two commits change some; read as the last version has them."""
    path = shared_path(spark, "versions")
    counts = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).withColumn("version", F.lit(1))
    versions.commit(counts.select("lang", "version", "documents"), path, 0)
    for _ in range(2):
        versions.update(spark, path, lambda now: now.withColumn("version", F.when(F.col("lang") < "f", F.col("version") + 1).otherwise(F.col("version"))))
    return versions.read(spark, path)
