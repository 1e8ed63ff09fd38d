"""Queries that join, filter, page and compare tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import issues as I  # noqa: E741
from textloom.operators import joins as J
from textloom.operators import rules as U
from textloom.plans.registry import query, table

SPLIT = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def split_of(c="doc_id"):
    """Stands for a frozen assignment of documents to splits."""
    return F.when(F.col(c) % 10 == 0, "test").when(F.col(c) % 10 == 1, "validation").otherwise("train")


def split_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("split", split_of()).withColumn("hash", F.sha2("text", 256))


_D = f"WITH d AS (SELECT *, {SPLIT} AS split, sha256(text) AS hash FROM documents) "


_KEYS = _D + ", k AS (SELECT doc_id, split, hash, source, 'l' || doc_id // 4 AS lecture, CASE WHEN length(text) > 80 THEN left(text, 80) END AS opening FROM d) "


@query(_KEYS + " UNION ALL ".join(f"SELECT h.doc_id, '{s}' AS split, '{c}' AS leaked_key FROM k h WHERE h.split = 'test' AND EXISTS (SELECT 1 FROM k o WHERE o.split = '{s}' AND o.{c} = h.{c})" for s in ("train", "validation") for c in ("hash", "source", "lecture", "opening")))
def leakage_exact(spark, sf_dir):
    """Held-out documents of which one of four keys also stands in another split."""
    d = split_documents(spark, sf_dir).select(
        "doc_id", "split", "hash", "source", F.concat(F.lit("l"), F.floor(F.col("doc_id") / 4).cast("string")).alias("lecture"), F.when(F.length("text") > 80, F.left("text", F.lit(80))).alias("opening")
    )
    others = {s: d.where(F.col("split") == s) for s in ("train", "validation")}
    return U.leaks(d.where("split = 'test'"), others, ["hash", "source", "lecture", "opening"], "doc_id")


@query("SELECT p_brand, p_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def repeated_part_keys(spark, sf_dir):
    """Keys that should be unique and aren't."""
    return I.repeated_keys(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(spark, sf_dir):
    """Whole items as substrings: an equi-join on one run of characters of each item, and contains as the check of its hits."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return J.containing(d.select("doc_id", "text"), b.select("item_id", F.col("text").alias("item")), "text", "item").select("doc_id", "item_id")


@query("""WITH d AS (SELECT doc_id, source, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM documents), g AS (SELECT doc_id, 'part' || doc_id // 4 AS lecture, split FROM d)
SELECT lecture, CAST(count(DISTINCT split) AS BIGINT) AS n_groups, min(split) AS first_group, max(split) AS last_group FROM g GROUP BY lecture HAVING count(DISTINCT split) > 1""")
def cross_split_lectures(spark, sf_dir):
    """Groups (four documents each) that stand in more than one split."""
    d = split_documents(spark, sf_dir).select(F.concat(F.lit("part"), F.floor(F.col("doc_id") / 4).cast("string")).alias("lecture"), "split")
    return I.crossing_groups(d, "lecture", "split")


@query(_D + """, g AS (SELECT split, regexp_extract(text, '^[^ \n]+') AS opening FROM d)
SELECT opening, CAST(count(DISTINCT split) AS BIGINT) AS n_groups, min(split) AS first_group, max(split) AS last_group FROM g GROUP BY opening HAVING count(DISTINCT split) > 1""")
def cross_split_groups(spark, sf_dir):
    """Documents that begin with the same word, where they stand in more than one split."""
    return I.crossing_groups(split_documents(spark, sf_dir).withColumn("opening", F.regexp_extract("text", "^[^ \\n]+", 0)), "opening", "split")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicates_drop_all(spark, sf_dir):
    """Only texts that stand once: all copies go."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("doc_id")


@query(_D + """SELECT doc_id, CAST(count(*) OVER h AS BIGINT) AS n_alike, doc_id = min(doc_id) OVER h AS is_first, doc_id = min(doc_id) OVER h AND min(split) OVER h <> max(split) OVER h AS crosses FROM d WINDOW h AS (PARTITION BY hash)""")
def duplicates_keep_first(spark, sf_dir):
    d = split_documents(spark, sf_dir).select("doc_id", "split", "hash")
    return I.flag_duplicates(d, "hash", "doc_id", "split").select("doc_id", "n_alike", "is_first", "crosses")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_label' ELSE 'no_document' END AS missing
FROM documents d FULL JOIN (SELECT doc_id + 5 AS doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def inventory_full_outer(spark, sf_dir):
    """Pairing check: what either side lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("label_id"))
    j = d.join(lab, d.doc_id == lab.label_id, "full_outer").where("doc_id IS NULL OR label_id IS NULL")
    return j.select(F.coalesce("doc_id", "label_id").alias("doc_id"), F.when(F.col("label_id").isNull(), "no_label").otherwise("no_document").alias("missing"))


@query(_D + """, r AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'old' ELSE sha256(text) END AS hash, sha256(source) AS source_hash, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' END AS status FROM documents JOIN labels USING (doc_id)),
j AS (SELECT d.split, r.doc_id, CASE WHEN r.doc_id IS NULL THEN NULL WHEN r.hash <> d.hash OR r.source_hash <> sha256(d.source) THEN 'stale' ELSE r.status END AS outcome FROM d LEFT JOIN r USING (doc_id))
SELECT split, count(*) AS documents, count(doc_id) AS reviewed, count(*) FILTER (outcome = 'approved') AS approved, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'stale') AS stale, bool_or(coalesce(outcome, '') = 'approved') AS has_approved FROM j GROUP BY split""")
def review_join(spark, sf_dir):
    """Reviews joined on id and two hashes, stale ones told apart, by split, and whether each split has an approved document."""
    d = split_documents(spark, sf_dir).select("doc_id", "split", "hash", F.sha2("source", 256).alias("source_hash"))
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected")
    reviews = table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.when(F.col("doc_id") % 6 == 5, "old").otherwise(F.col("hash")).alias("hash"), "source_hash", status.alias("status"))
    judged = U.review_outcomes(reviews, d, ["doc_id", "hash", "source_hash"]).select("doc_id", "outcome", F.lit(1).alias("there"))
    j = d.select("doc_id", "split").join(judged, "doc_id", "left")
    n = lambda o: F.count_if(F.col("outcome") == o)
    return j.groupBy("split").agg(
        F.count(F.lit(1)).alias("documents"), F.count("there").alias("reviewed"), n("approved").alias("approved"), n("rejected").alias("rejected"), n("stale").alias("stale"),
        F.bool_or(F.coalesce(F.col("outcome") == "approved", F.lit(False))).alias("has_approved"),
    )


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT doc_id, list_filter(['lang', 'source', 'n_chars'], lambda x: (x = 'lang' AND doc_id % 7 = 0) OR (x = 'source' AND doc_id % 11 = 0) OR (x = 'n_chars' AND doc_id % 13 = 0)) AS changed
FROM documents WHERE doc_id % 17 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0) UNION ALL SELECT doc_id, ['missing'] FROM documents WHERE doc_id % 17 = 0""")
def null_safe_staleness(spark, sf_dir):
    """Stored rows (a perturbed copy) that are missing or differ, null-safely, from the current ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    kept = d.where("doc_id % 17 <> 0").select(
        "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 13 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"),
    )
    return I.stale_columns(d, kept, "doc_id", ["lang", "source", "n_chars"])


@query("""WITH p AS (SELECT conv_id, max(text) FILTER (role = 'system') AS s, max(text) FILTER (role = 'assistant') AS a, max(text) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(coalesce(nullif(s, ''), nullif(a, ''), nullif(u, ''))) AS chosen_sha256, CASE WHEN nullif(s, '') IS NOT NULL THEN 'system' WHEN nullif(a, '') IS NOT NULL THEN 'assistant' WHEN nullif(u, '') IS NOT NULL THEN 'user' END AS chosen_field FROM p""")
def coalesce_priority(spark, sf_dir):
    """The first alternative that isn't null or empty, and which one it was."""
    fields = ("system", "assistant", "user")
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.max(F.when(F.col("role") == f, F.col("text"))).alias(f) for f in fields))
    some = [F.nullif(F.col(f), F.lit("")) for f in fields]
    return p.select("conv_id", F.sha2(F.coalesce(*some), 256).alias("chosen_sha256"), F.coalesce(*(F.when(c.isNotNull(), f) for f, c in zip(fields, some, strict=True))).alias("chosen_field"))


_SEARCH = "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license'))"


@query(_SEARCH)
def faceted_search(spark, sf_dir):
    """A facet and a case-insensitive substring over several columns."""
    wanted = F.lit("license")
    hit = F.contains(F.lower("text"), wanted) | F.contains(F.lower("source"), wanted) | F.contains(F.lower("lang"), wanted)
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & hit).select("doc_id", "lang", "source")


@query("SELECT doc_id, n_chars, (SELECT CAST(ceil(count(*) / 24.0) AS BIGINT) FROM documents) AS pages FROM documents ORDER BY n_chars DESC, source, doc_id LIMIT 24 OFFSET 24")
def page_second(spark, sf_dir):
    """The second page of 24 rows in a total order of three keys, and how many pages there are."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    pages = d.agg(F.ceil(F.count(F.lit(1)) / 24.0).cast("long").alias("pages"))
    return d.orderBy(F.desc("n_chars"), "source", "doc_id").offset(24).limit(24).select("doc_id", "n_chars").crossJoin(F.broadcast(pages))  # one row


@query("""SELECT page_id, regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.(com|net|org)(/|$|\\?|#|:)') AS allowed, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_param FROM pages""")
def url_allowlist(spark, sf_dir):
    host = F.try_parse_url("url", F.lit("HOST"))
    ok = F.col("url").rlike("^https?://([a-z0-9-]+\\.)*example\\.(com|net|org)(/|$|\\?|#|:)")
    return table(spark, sf_dir, "pages").select("page_id", ok.alias("allowed"), F.coalesce(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), F.lit("")).alias("page_param"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k")).where("k IS NOT NULL")


@query("""SELECT o_orderkey, list_filter([CASE WHEN NOT coalesce(o_totalprice >= 1000, false) THEN 'price_range' END, CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'status' END, CASE WHEN NOT coalesce(regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+'), false) THEN 'priority' END], lambda x: x IS NOT NULL) AS violations
FROM orders WHERE NOT (o_totalprice >= 1000 AND o_orderstatus IN ('O', 'F') AND regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+'))""")
def record_validation(spark, sf_dir):
    rules = [("price_range", I.finite("o_totalprice") & (F.col("o_totalprice") >= 1000)), ("status", F.col("o_orderstatus").isin("O", "F")), ("priority", F.col("o_orderpriority").rlike("^[1-3]-[A-Z]+$"))]
    return I.violations(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "violations")


@query("""SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey * 10 + k, c_acctbal / 2 FROM customer, unnest([1, 2]) AS u(k) WHERE c_acctbal < 0""")
def substitution_join(spark, sf_dir):
    """Rows that fail a test are replaced by their children."""
    c = table(spark, sf_dir, "customer")
    children = c.select(F.col("c_custkey").alias("parent"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), (F.col("c_acctbal") / 2).alias("balance"))
    failing = c.where("c_acctbal < 0")
    kept = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return kept.unionByName(failing.join(children, failing.c_custkey == children.parent).select((F.col("c_custkey") * 10 + F.col("k")).alias("id"), "balance"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, 'new ' || p_brand FROM part WHERE p_partkey % 10 = 0")
def config_upsert(spark, sf_dir):
    """New settings replace those of their key, others stay."""
    old = table(spark, sf_dir, "part")
    new = old.where("p_partkey % 10 = 0").select("p_partkey", F.concat(F.lit("new "), "p_brand").alias("p_name"))
    return old.select("p_partkey", "p_name").join(new, "p_partkey", "left_anti").unionByName(new)


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)")
def referential_anti(spark, sf_dir):
    """Keys that are referred to but not there."""
    there = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().join(there, "l_suppkey", "left_anti")


@query("""(SELECT doc_id, lang, 'left' AS side FROM documents WHERE doc_id % 50 = 0) UNION ALL (SELECT doc_id, 'xx' AS lang, 'right' AS side FROM documents WHERE doc_id % 50 = 0)""")
def rerun_difference(spark, sf_dir):
    """Rows in which a second run differs from the first, as bags."""
    a = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return I.same_rows(a, a.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang"))))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7:1'), doc_id) - 1 AS position FROM documents")
def seeded_shuffle(spark, sf_dir):
    """A reproducible order for an epoch, by a hash of id, seed and epoch: the place of every document, numbered within ranges of the hash."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7:1"))).alias("key"))
    # the hash is even, so its first three digits deal the rows out evenly; only their counts are added up in one place
    keyed = keyed.withColumn("part", F.left("key", F.lit(3)))
    sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id")) - 1
    return keyed.join(sizes, "part").select("doc_id", (F.col("from") + own).alias("position"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(count(*) AS BIGINT) AS lines FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY l_orderkey HAVING count(*) >= 4""")
def pushed_filter_aggregate(spark, sf_dir):
    """A plain scan, filter and aggregate: the date reaches the Parquet reader and only three columns are read."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01'")
    return li.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("lines")).where("lines >= 4")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), w AS (SELECT user_id, ts AS s, ts + INTERVAL 1 HOUR AS e, event_id AS window_id FROM events WHERE event_type = 'error')
SELECT e.event_id, w.window_id FROM e JOIN w ON e.user_id = w.user_id AND e.ts >= w.s AND e.ts < w.e""")
def point_in_interval(spark, sf_dir):
    """Points within half-open intervals of their key."""
    ev = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    p = ev.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    iv = ev.where("event_type = 'error'").select(F.col("event_id").alias("window_id"), "user_id", F.col("at").alias("s"), (F.col("at") + 3_600_000_000).alias("e"))
    return J.points_in_intervals(p, iv, ["user_id"], "at", "s", "e").select("event_id", "window_id")


_SPANS = "WITH i AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(pow(value, 3) * 60000) AS BIGINT) AS e FROM events) "


def _spans(spark, sf_dir):
    """Events as intervals from fractions of a second to weeks."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", at.alias("s"), (at + F.floor(F.pow("value", F.lit(3)) * 60_000)).cast("long").alias("e"))


@query(_SPANS + "SELECT p.event_id, w.event_id AS window_id FROM i p JOIN i w ON p.user_id = w.user_id AND p.event_type = 'purchase' AND w.event_type = 'click' AND p.s >= w.s AND p.s < w.e")
def point_in_any_interval(spark, sf_dir):
    """Points within intervals of very different lengths."""
    rows = _spans(spark, sf_dir)
    p = rows.where("event_type = 'purchase'").select("event_id", "user_id", F.col("s").alias("at"))
    return J.points_in_intervals(p, rows.where("event_type = 'click'").select(F.col("event_id").alias("window_id"), "user_id", "s", "e"), ["user_id"], "at", "s", "e").select("event_id", "window_id")


@query(_SPANS + "SELECT a.event_id, b.event_id AS other_id FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e")
def overlap_pairs(spark, sf_dir):
    """Pairs of overlapping intervals of a user, of two kinds."""
    rows = _spans(spark, sf_dir)
    a = rows.where("event_type = 'purchase'").select("event_id", "user_id", "s", "e")
    b = rows.where("event_type = 'error'").select(F.col("event_id").alias("other_id"), "user_id", F.col("s").alias("t"), F.col("e").alias("f"))
    return J.overlapping_pairs(a, b, ["user_id"], ("s", "e"), ("t", "f")).select("event_id", "other_id")


@query("""SELECT doc_id, list_filter(['lang', 'source', 'n_chars'], lambda x: (x = 'lang' AND doc_id % 7 = 0) OR (x = 'source' AND doc_id % 11 = 0) OR (x = 'n_chars' AND doc_id % 13 = 0)) AS changed
FROM documents WHERE doc_id % 17 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0) UNION ALL SELECT doc_id, ['missing'] FROM documents WHERE doc_id % 17 = 0""")
def null_safe_staleness(spark, sf_dir):
    """Stored rows (a perturbed copy) that are missing or differ, null-safely, from the current ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    kept = d.where("doc_id % 17 <> 0").select(
        "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 11 == 0, "other").otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 13 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"),
    )
    return I.stale_columns(d, kept, "doc_id", ["lang", "source", "n_chars"])


@query("""WITH p AS (SELECT conv_id, max(text) FILTER (role = 'system') AS s, max(text) FILTER (role = 'assistant') AS a, max(text) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(coalesce(nullif(s, ''), nullif(a, ''), nullif(u, ''))) AS chosen_sha256, CASE WHEN nullif(s, '') IS NOT NULL THEN 'system' WHEN nullif(a, '') IS NOT NULL THEN 'assistant' WHEN nullif(u, '') IS NOT NULL THEN 'user' END AS chosen_field FROM p""")
def coalesce_priority(spark, sf_dir):
    """The first alternative that isn't null or empty, and which one it was."""
    fields = ("system", "assistant", "user")
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.max(F.when(F.col("role") == f, F.col("text"))).alias(f) for f in fields))
    some = [F.nullif(F.col(f), F.lit("")) for f in fields]
    return p.select("conv_id", F.sha2(F.coalesce(*some), 256).alias("chosen_sha256"), F.coalesce(*(F.when(c.isNotNull(), f) for f, c in zip(fields, some, strict=True))).alias("chosen_field"))


_SEARCH = "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license'))"


@query(_SEARCH)
def faceted_search(spark, sf_dir):
    """A facet and a case-insensitive substring over several columns."""
    wanted = F.lit("license")
    hit = F.contains(F.lower("text"), wanted) | F.contains(F.lower("source"), wanted) | F.contains(F.lower("lang"), wanted)
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & hit).select("doc_id", "lang", "source")


@query("SELECT doc_id, n_chars, (SELECT CAST(ceil(count(*) / 24.0) AS BIGINT) FROM documents) AS pages FROM documents ORDER BY n_chars DESC, source, doc_id LIMIT 24 OFFSET 24")
def page_second(spark, sf_dir):
    """The second page of 24 rows in a total order of three keys, and how many pages there are."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    pages = d.agg(F.ceil(F.count(F.lit(1)) / 24.0).cast("long").alias("pages"))
    return d.orderBy(F.desc("n_chars"), "source", "doc_id").offset(24).limit(24).select("doc_id", "n_chars").crossJoin(F.broadcast(pages))  # one row


@query("""SELECT page_id, regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.(com|net|org)(/|$|\\?|#|:)') AS allowed, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_param FROM pages""")
def url_allowlist(spark, sf_dir):
    host = F.try_parse_url("url", F.lit("HOST"))
    ok = F.col("url").rlike("^https?://([a-z0-9-]+\\.)*example\\.(com|net|org)(/|$|\\?|#|:)")
    return table(spark, sf_dir, "pages").select("page_id", ok.alias("allowed"), F.coalesce(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), F.lit("")).alias("page_param"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k")).where("k IS NOT NULL")


@query("""SELECT o_orderkey, list_filter([CASE WHEN NOT coalesce(o_totalprice >= 1000, false) THEN 'price_range' END, CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'status' END, CASE WHEN NOT coalesce(regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+'), false) THEN 'priority' END], lambda x: x IS NOT NULL) AS violations
FROM orders WHERE NOT (o_totalprice >= 1000 AND o_orderstatus IN ('O', 'F') AND regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+'))""")
def record_validation(spark, sf_dir):
    rules = [("price_range", I.finite("o_totalprice") & (F.col("o_totalprice") >= 1000)), ("status", F.col("o_orderstatus").isin("O", "F")), ("priority", F.col("o_orderpriority").rlike("^[1-3]-[A-Z]+$"))]
    return I.violations(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "violations")


@query("""SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey * 10 + k, c_acctbal / 2 FROM customer, unnest([1, 2]) AS u(k) WHERE c_acctbal < 0""")
def substitution_join(spark, sf_dir):
    """Rows that fail a test are replaced by their children."""
    c = table(spark, sf_dir, "customer")
    children = c.select(F.col("c_custkey").alias("parent"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), (F.col("c_acctbal") / 2).alias("balance"))
    failing = c.where("c_acctbal < 0")
    kept = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return kept.unionByName(failing.join(children, failing.c_custkey == children.parent).select((F.col("c_custkey") * 10 + F.col("k")).alias("id"), "balance"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, 'new ' || p_brand FROM part WHERE p_partkey % 10 = 0")
def config_upsert(spark, sf_dir):
    """New settings replace those of their key, others stay."""
    old = table(spark, sf_dir, "part")
    new = old.where("p_partkey % 10 = 0").select("p_partkey", F.concat(F.lit("new "), "p_brand").alias("p_name"))
    return old.select("p_partkey", "p_name").join(new, "p_partkey", "left_anti").unionByName(new)


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)")
def referential_anti(spark, sf_dir):
    """Keys that are referred to but not there."""
    there = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().join(there, "l_suppkey", "left_anti")


@query("""(SELECT doc_id, lang, 'left' AS side FROM documents WHERE doc_id % 50 = 0) UNION ALL (SELECT doc_id, 'xx' AS lang, 'right' AS side FROM documents WHERE doc_id % 50 = 0)""")
def rerun_difference(spark, sf_dir):
    """Rows in which a second run differs from the first, as bags."""
    a = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return I.same_rows(a, a.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang"))))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7:1'), doc_id) - 1 AS position FROM documents")
def seeded_shuffle(spark, sf_dir):
    """A reproducible order for an epoch, by a hash of id, seed and epoch: the place of every document, numbered within ranges of the hash."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7:1"))).alias("key"))
    # the hash is even, so its first three digits deal the rows out evenly; only their counts are added up in one place
    keyed = keyed.withColumn("part", F.left("key", F.lit(3)))
    sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id")) - 1
    return keyed.join(sizes, "part").select("doc_id", (F.col("from") + own).alias("position"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(count(*) AS BIGINT) AS lines FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY l_orderkey HAVING count(*) >= 4""")
def pushed_filter_aggregate(spark, sf_dir):
    """A plain scan, filter and aggregate: the date reaches the Parquet reader and only three columns are read."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01'")
    return li.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("lines")).where("lines >= 4")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), w AS (SELECT user_id, ts AS s, ts + INTERVAL 1 HOUR AS e, event_id AS window_id FROM events WHERE event_type = 'error')
SELECT e.event_id, w.window_id FROM e JOIN w ON e.user_id = w.user_id AND e.ts >= w.s AND e.ts < w.e""")
def point_in_interval(spark, sf_dir):
    """Points within half-open intervals of their key: a range join made equal on hour buckets, so no key is compared with all its rows."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    p = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts", hour.alias("bucket"))
    iv = ev.where("event_type = 'error'").select(F.col("event_id").alias("window_id"), "user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("e"), F.explode(F.array(hour, hour + 1)).alias("bucket"))
    return p.join(iv, ["user_id", "bucket"]).where("ts >= s AND ts < e").select("event_id", "window_id")


@query("""SELECT doc_id, list_filter(['lang', 'source', 'n_chars'], lambda x: (x = 'lang' AND doc_id % 9 = 0) OR (x = 'source' AND doc_id % 12 = 0) OR (x = 'n_chars' AND doc_id % 15 = 0)) AS differs FROM documents WHERE doc_id % 9 = 0 OR doc_id % 12 = 0 OR doc_id % 15 = 0
UNION ALL SELECT doc_id + 1000000, ['missing'] FROM documents WHERE doc_id % 40 = 7""")
def lock_mismatch(spark, sf_dir):
    """A manifest against a frozen lock, equal on every column or reported, rows that the lock lacks included."""
    columns = ["lang", "source", "n_chars"]
    lock = table(spark, sf_dir, "documents").select("doc_id", *columns)
    now = lock.select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, "zz").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 12 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 15 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"),
    )
    new = lock.where("doc_id % 40 = 7").withColumn("doc_id", F.col("doc_id") + 1000000)
    return U.differing_children(now.unionByName(new), lock, "doc_id", columns).select("doc_id", "differs")


@query("""SELECT conv_id, turn, list_filter([CASE WHEN conv_id % 7 = 3 THEN 'split' END, CASE WHEN turn % 5 = 4 THEN 'hash' END], lambda x: x IS NOT NULL) AS differs FROM conversations WHERE conv_id % 11 <> 6 AND (conv_id % 7 = 3 OR turn % 5 = 4)
UNION ALL SELECT conv_id, turn, ['missing'] FROM conversations WHERE conv_id % 11 = 6""")
def child_mismatch(spark, sf_dir):
    """Turns whose split or hash isn't that of their conversation, or whose conversation is missing: many to one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    hash_ = F.sha2(F.col("conv_id").cast("string"), 256)
    parents = c.select("conv_id").distinct().where("conv_id % 11 <> 6").select("conv_id", split_of("conv_id").alias("split"), hash_.alias("hash"))
    children = c.select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 3, "other").otherwise(split_of("conv_id")).alias("split"), F.when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(hash_).alias("hash"))
    return U.differing_children(children, parents, "conv_id", ["split", "hash"]).select("conv_id", "turn", "differs")


@query("SELECT doc_id, doc_id % 3 = 1 AS revision_ok, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS revision FROM documents")
def revision_upsert(spark, sf_dir):
    """Compare-and-set saves: those that name the stored revision win, others are refused and change nothing."""
    stored = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("stored"))
    saves = stored.select("doc_id", F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0).alias("base"))
    return stored.join(saves, "doc_id").select("doc_id", (F.col("base") == F.col("stored")).alias("revision_ok"), F.when(F.col("base") == F.col("stored"), F.col("stored") + 1).otherwise(F.col("stored")).alias("revision"))


