"""Reports: counts, rollups, histograms, weighted means, percentiles, verification."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import issues as I  # noqa: E741
from textloom.plans.registry import query, table
from textloom.plans.relational import SPLIT, split_documents

def percentiles(df, group: str, value: str, shares: dict[str, float], longest: str):
    """Percentiles of each group with linear interpolation, and the greatest value; nulls don't count.

    Equal values are counted, never ranked one by one. Values go to ranges of a sketch of each group's quantiles; only the counts of ranges, a bounded number for each group, tell which ranges hold
    the wanted ranks, and only those ranges' values are put in order.
    """
    df = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__c"))
    cuts = df.groupBy(group).agg(F.percentile_approx(value, [k / 64 for k in range(1, 64)], 1000).alias("__cuts"))
    part = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    # a row for each group, so small that adaptive execution broadcasts it by its size
    dealt = df.join(cuts, group).select(group, value, "__c", part.alias("__part"))
    sizes = dealt.groupBy(group, "__part").agg(F.sum("__c").alias("__n"), F.max(value).alias("__max"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    sizes = sizes.select(group, "__part", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"), F.sum("__n").over(whole).alias("__total"), F.max("__max").over(whole).alias("__longest"))
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("__total") - 1)).alias("at")) for k, p in shares.items()))
    places = sizes.withColumn("__w", F.explode(wanted)).select("*", F.col("__w.name").alias("__name"), F.col("__w.at").alias("__at"))
    places = places.where((F.ceil("__at") >= F.col("__from")) & (F.floor("__at") < F.col("__from") + F.col("__n")))
    needed = places.select(group, "__part", "__from").distinct()
    # a value has all ranks from the number of smaller ones on, up to its own count
    up_to = F.sum("__c").over(Window.partitionBy(group, "__part").orderBy(value))
    ranked = dealt.join(needed, [group, "__part"]).select(group, value, (up_to - F.col("__c") + F.col("__from")).alias("__first"), (up_to + F.col("__from")).alias("__stop"))
    ends = places.select(group, "__name", "__at", "__longest").distinct()
    holds = lambda at: (F.col("__first") <= at) & (at < F.col("__stop"))
    down, up = F.floor("__at"), F.ceil("__at")
    hit = ends.join(ranked, group).where(holds(down) | holds(up))
    low, high = F.min(F.when(holds(down), F.col(value))), F.max(F.when(holds(up), F.col(value)))
    each = hit.groupBy(group, "__name").agg((low + (high - low) * (F.first("__at") - F.floor(F.first("__at")))).alias("__v"), F.first("__longest").alias(longest))
    return each.groupBy(group).agg(*(F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in shares), F.first(longest).alias(longest))


_ISSUES = f"""WITH d AS (SELECT doc_id, {SPLIT} AS split, n_chars, text, count(*) OVER (PARTITION BY text) AS n, doc_id = min(doc_id) OVER (PARTITION BY text) AND min({SPLIT}) OVER (PARTITION BY text) <> max({SPLIT}) OVER (PARTITION BY text) AS crosses FROM documents),
i AS (SELECT doc_id, split, n_chars, list_filter([CASE WHEN length(trim(text)) < 40 THEN 'short_text' END, CASE WHEN n > 1 THEN 'exact_duplicate' END, CASE WHEN crosses THEN 'duplicate_across_splits' END, CASE WHEN length(text) > 20000 THEN 'text_exceeds_max_length' END], lambda x: x IS NOT NULL) AS issues FROM d),
s AS (SELECT *, CASE WHEN len(issues) = 0 THEN 'pass' WHEN issues = ['text_exceeds_max_length'] THEN 'review_required' ELSE 'quarantined' END AS status FROM i) """


def documents_with_issues(spark, sf_dir):
    d = I.flag_duplicates(split_documents(spark, sf_dir).select("doc_id", "split", "n_chars", "hash", F.length(F.trim("text")).alias("trimmed"), F.length("text").alias("chars")), "hash", "doc_id", "split")
    issues = I.issue_codes([
        ("short_text", F.col("trimmed") < 40), ("exact_duplicate", F.col("n_alike") > 1), ("duplicate_across_splits", F.col("crosses")), ("text_exceeds_max_length", F.col("chars") > 20000),
    ])
    d = d.withColumn("issues", issues)
    return d.withColumn("status", I.status(F.col("issues"), I.exactly(F.col("issues"), ["text_exceeds_max_length"])))


@query(_ISSUES + "SELECT split, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'review_required') AS review_required, count(*) FILTER (status = 'quarantined') AS quarantined FROM s GROUP BY split")
def quarantine_report(spark, sf_dir):
    """Documents by split and status."""
    n = {s: F.count_if(F.col("status") == s) for s in ("pass", "review_required", "quarantined")}
    return documents_with_issues(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), n["pass"].alias("passed"), n["review_required"].alias("review_required"), n["quarantined"].alias("quarantined")
    )


@query(_ISSUES + "SELECT code, count(*) AS documents FROM s, unnest(issues) AS u(code) GROUP BY code")
def issue_histogram(spark, sf_dir):
    return documents_with_issues(spark, sf_dir).select(F.explode("issues").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("documents"))


@query(_ISSUES + "SELECT doc_id, issues, status FROM s WHERE status <> 'pass'")
def quarantined_documents(spark, sf_dir):
    return documents_with_issues(spark, sf_dir).where("status <> 'pass'").select("doc_id", "issues", "status")


@query(f"SELECT coalesce(split, 'all') AS split, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT {SPLIT} AS split, n_chars FROM documents) GROUP BY ROLLUP (split)")
def split_summary_rollup(spark, sf_dir):
    d = split_documents(spark, sf_dir)
    return d.rollup("split").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")).select(F.coalesce("split", F.lit("all")).alias("split"), "documents", "chars")


@query(f"""SELECT s.split, CAST(count(d.doc_id) AS BIGINT) AS documents, CAST(coalesce(sum(d.n_chars), 0) AS BIGINT) AS chars, coalesce(list_sort(list(d.source) FILTER (d.source IS NOT NULL)), []) AS sources
FROM (VALUES ('train'), ('validation'), ('test'), ('holdout')) AS s(split) LEFT JOIN (SELECT doc_id, n_chars, CASE WHEN doc_id % 50 = 0 THEN source END AS source, {SPLIT} AS split FROM documents) d USING (split) GROUP BY s.split""")
def split_counts_with_absent(spark, sf_dir):
    """Counts, sums and the ids of a few; splits without documents appear with zero."""
    names = spark.sql("SELECT * FROM VALUES ('train'), ('validation'), ('test'), ('holdout') AS s(split)")
    ids = F.sort_array(F.collect_list(F.when(F.col("doc_id") % 50 == 0, F.col("source"))))
    n = split_documents(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"), ids.alias("ids"))
    joined = names.join(n, "split", "left")
    return joined.select("split", F.coalesce("n", F.lit(0)).cast("long").alias("documents"), F.coalesce("c", F.lit(0)).cast("long").alias("chars"), F.coalesce("ids", F.array().cast("array<string>")).alias("sources"))


@query("""SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS longest FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    """Exact percentiles with linear interpolation, from ranks over ranges of values: no task holds a group."""
    return percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, "longest")


@query("""SELECT vec_id, round(sqrt(list_avg(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS rms, round(20 * log10(greatest(sqrt(list_avg(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12)), 4) AS dbfs,
round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak, round(len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.25)) / len(embedding), 6) AS clipped, round(len(list_filter(embedding, lambda x: abs(x::DOUBLE) < 0.01)) / len(embedding), 6) AS near_silent FROM embeddings""")
def signal_metrics(spark, sf_dir):
    """Level, peak, clipped and near-silent shares over arrays of samples."""
    e = F.col("embedding").cast("array<double>")
    rms = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x) / F.size(e))
    share = lambda cond: F.round(F.size(F.filter(e, cond)) / F.size(e), 6)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(rms, 6).alias("rms"), F.round(20 * F.log10(F.greatest(rms, F.lit(1e-12))), 4).alias("dbfs"), F.round(F.array_max(F.transform(e, lambda x: F.abs(x))), 6).alias("peak"),
        share(lambda x: F.abs(x) >= 0.25).alias("clipped"), share(lambda x: F.abs(x) < 0.01).alias("near_silent"),
    )


@query("""WITH r AS (SELECT event_type, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, min(value) AS loss FROM events GROUP BY ALL) SELECT event_type, arg_min(day, (loss, day)) AS best_day, min(loss) AS best_loss FROM r GROUP BY event_type""")
def best_checkpoint(spark, sf_dir):
    """The epoch with the least loss; the earliest of equals."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    r = table(spark, sf_dir, "events").groupBy("event_type", day.alias("day")).agg(F.min("value").alias("loss"))
    return r.groupBy("event_type").agg(F.min_by("day", F.struct("loss", "day")).alias("best_day"), F.min("loss").alias("best_loss"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_discount, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, sf_dir):
    """A mean of values weighted by their sizes, as for losses and tokens."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * q) / F.sum(q), 6).alias("weighted_discount"), F.sum(q).cast("long").alias("weight"))


@query("""SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS transcript, list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY conv_id""")
def ordered_concat(spark, sf_dir):
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), "text")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"), F.sort_array(F.collect_set("role")).alias("roles"))
    return g.select("conv_id", F.array_join("l.line", "\n").alias("transcript"), "roles")


@query("""SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1), 6) AS delta FROM events GROUP BY event_type""")
def group_delta(spark, sf_dir):
    """The difference of one aggregate between two groups."""
    mean = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(mean(0) - mean(1), 6).alias("delta"))


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY o_custkey HAVING o_custkey % 4 = 0""")
def stored_aggregate_mismatch(spark, sf_dir):
    """Aggregates made again and compared with stored ones (a perturbed copy)."""
    again = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    stored = again.select("o_custkey", (F.col("orders") + F.when(F.col("o_custkey") % 4 == 0, 1).otherwise(0)).alias("stored"))
    return again.join(stored, "o_custkey").where(F.abs(F.col("orders") - F.col("stored")) > 1e-9).select("o_custkey", "orders")


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS segments, substr(arg_min(text, turn) FILTER (text <> ''), 1, 160) AS preview FROM conversations GROUP BY conv_id""")
def record_previews(spark, sf_dir):
    """How many segments a record has, and the start of its first text."""
    text = F.when(F.col("text") != "", F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("segments"), F.substring(F.min_by(text, F.when(text.isNotNull(), F.col("turn"))), 1, 160).alias("preview"))


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def regional_revenue(spark, sf_dir):
    """A star join: the small dimensions are broadcast by Spark's own size check, the large sides stay sorted by key."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
        .groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    )
