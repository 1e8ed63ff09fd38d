"""Queries over texts: normalisation, hashing, chunks, error rates, repeats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.functions.unicode import composed, folded
from textloom.operators import align as A
from textloom.operators import ordered as O  # noqa: E741
from textloom.operators import rules as U
from textloom.plans.registry import ORACLES, query, table

SPLIT = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"
NORM = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')"
#: DuckDB's levenshtein counts bytes, so the letters beyond ASCII get one byte each first.
ONE_BYTE = "translate({}, 'äçèéêíñóöü', '!\"#$%&()*+')"


@query(f"SELECT doc_id, sha256({NORM}) AS norm_sha256, CAST(length({NORM}) AS BIGINT) AS norm_chars FROM documents")
def normalize_text(spark, sf_dir):
    norm = X.normalize_fast("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(norm, 256).alias("norm_sha256"), F.length(norm).cast("long").alias("norm_chars"))


@query(r"SELECT doc_id, sha256(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS norm_sha256 FROM documents")
def normalize_lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalize_lower(composed("text")), 256).alias("norm_sha256"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS text_sha256 FROM documents""")
def collapsed_text(spark, sf_dir):
    """Texts in normal form C with single blanks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.collapse_space(composed("text")), 256).alias("text_sha256"))


@query(r"""SELECT doc_id, CAST(len(w) AS BIGINT) AS words, sha256(list_aggregate(w, 'string_agg', ' ')) AS words_sha256 FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents) WHERE len(w) > 0""")
def word_tokens(spark, sf_dir):
    """Words of the folded compatibility form."""
    w = F.regexp_extract_all(folded("text"), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.sha2(F.array_join("w", " "), 256).alias("words_sha256"))


@query("SELECT o_orderkey, '{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS payload FROM orders")
def strict_payload(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.strict_json("o_orderkey", "o_custkey", "o_orderstatus").alias("payload"))


@query("SELECT event_id, (c // 6000) || ':' || lpad(CAST(c // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, CAST(floor(value * 3 * 100) AS BIGINT) AS c FROM events)")
def clock_hundredths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.clock_fine(F.col("value") * 3).alias("clock"))


@query("""SELECT doc_id, 'doc-' || substr(sha256(text), 1, 12) AS text_id, sha256(text) AS text_sha256,
sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS fingerprint FROM documents""")
def text_fingerprint(spark, sf_dir):
    print_ = F.sha2(F.to_json(F.struct("doc_id", "lang", "source")), 256)  # keys in sorted order
    return table(spark, sf_dir, "documents").select("doc_id", X.hash_id("doc-", "text").alias("text_id"), F.sha2("text", 256).alias("text_sha256"), print_.alias("fingerprint"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^\d+_', ''), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS title FROM pages")
def canonical_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, p, ls[p + 1] AS line FROM l, unnest(range(0, len(ls))) AS u(p)),
k AS (SELECT * FROM e WHERE trim(line) <> '')
SELECT doc_id, 'p' || lpad(CAST(row_number() OVER w - 1 AS VARCHAR), 4, '0') AS paragraph_id,
       CAST(coalesce(sum(length(line) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, CAST(length(line) AS BIGINT) AS chars
FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY p)""")
def lines_with_offsets(spark, sf_dir):
    """Numbered lines with the offsets that they have when joined by blank lines."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where("trim(line) <> ''")
    w = Window.partitionBy("doc_id").orderBy("p")
    number = F.lpad((F.row_number().over(w) - 1).cast("string"), 4, "0")
    start = F.coalesce(F.sum(F.length("line") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", F.concat(F.lit("p"), number).alias("paragraph_id"), start.cast("long").alias("char_start"), F.length("line").cast("long").alias("chars"))


@query("""SELECT doc_id || ':' || o AS chunk_id, CAST(length(substr(text, o + 1, 3000)) AS BIGINT) AS chars, sha256(substr(text, o + 1, 3000)) AS part_sha256
FROM documents, unnest(range(0, length(text), 3000)) AS u(o)""")
def chunk_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.text_chunks("text", 3000)).alias("c"))
    return rows.select(F.concat_ws(":", "doc_id", "c.offset").alias("chunk_id"), F.length("c.part").cast("long").alias("chars"), F.sha2("c.part", 256).alias("part_sha256"))


_TURNS = f"""WITH t AS (SELECT conv_id, turn, {ONE_BYTE.format(NORM)} AS n FROM conversations),
p AS (SELECT conv_id, turn, lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS ref, n AS hyp FROM t),
r AS (SELECT *, levenshtein(ref, hyp) AS edits FROM p WHERE ref IS NOT NULL)"""


def _turn_pairs(spark, sf_dir):
    norm = X.normalize_fast("text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", norm.alias("hyp"))
    return rows.withColumn("ref", F.lag("hyp").over(w)).where("ref IS NOT NULL").withColumn("edits", A.edit_distance_udf("ref", "hyp"))


@query(_TURNS + " SELECT conv_id, turn, CAST(edits AS BIGINT) AS edits, CASE WHEN length(ref) > 0 THEN round(edits / length(ref), 6) WHEN length(hyp) = 0 THEN 0.0 END AS cer FROM r")
def turn_error_rate(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", "edits", F.round(X.error_rate(F.col("ref"), F.col("hyp"), F.col("edits")), 6).alias("cer"))


@query(_TURNS.replace("SELECT conv_id, turn, translate", "SELECT conv_id, turn, role, translate").replace("SELECT conv_id, turn, lag", "SELECT conv_id, turn, role, lag") + """
SELECT role, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(length(ref)) AS BIGINT) AS reference_chars, round(sum(edits) / sum(length(ref)), 6) AS micro_cer FROM r GROUP BY role""")
def micro_average_by_role(spark, sf_dir):
    chars = F.sum(F.length("ref"))
    return _turn_pairs(spark, sf_dir).groupBy("role").agg(F.sum("edits").alias("edits"), chars.cast("long").alias("reference_chars"), F.round(F.try_divide(F.sum("edits"), chars), 6).alias("micro_cer"))


@query(r"""WITH d AS (SELECT doc_id, left(text, length(text) // 2 + 15) AS a, substr(text, greatest(length(text) // 2 - 14, 1)) AS b FROM documents),
n AS (SELECT *, right(regexp_replace(a, '[^\p{L}\p{N}]', '', 'g'), 60) AS l, left(regexp_replace(b, '[^\p{L}\p{N}]', '', 'g'), 60) AS r FROM d),
s AS (SELECT *, list_filter(range(60, 5, -1), lambda k: length(l) >= k AND length(r) >= k AND right(l, k) = left(r, k))[1] AS k FROM n),
c AS (SELECT doc_id, b, k, list_filter(range(1, 601), lambda i: regexp_matches(substr(b, i, 1), '[\p{L}\p{N}]'))[k] AS cut FROM s)
SELECT doc_id, CASE WHEN k IS NULL THEN b ELSE regexp_replace(substr(b, cut + 1), '^[ \t\n\r\f\x0b,.!?。]+', '') END AS rest FROM c""")
def overlap_prefix(spark, sf_dir):
    """The halves of a document, which share about 30 characters: the second without the repeat."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.left("text", half + 15), F.substr("text", F.greatest(half - 14, F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", X.remove_overlap(first, second).alias("rest"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, w, s, list_filter(range(0, len(w) - s), lambda i: w[i + 1] = w[i + s + 1]) AS eq FROM t, unnest(range(1, 9)) AS a(s) WHERE len(w) >= 3 * s),
e AS (SELECT doc_id, s, i, i - row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS island FROM g, unnest(eq) AS u(i)),
r AS (SELECT doc_id, s, min(i) AS f, count(*) // s + 1 AS copies, count(*) % s AS rest FROM e GROUP BY doc_id, s, island HAVING count(*) // s + 1 >= 3),
x AS (SELECT doc_id, s, copies, start, start % s AS o FROM r, unnest(range(f, f + least(rest, s - 1) + 1)) AS u(start)),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY copies * s DESC, s, o, start) = 1)
SELECT doc_id, w[start + 1 : start + s] AS ngram, CAST(copies AS BIGINT) AS copies, CAST(s AS INT) AS ngram_words, CAST(start AS INT) AS start_word, CAST(copies * s AS BIGINT) AS repeated_words FROM b JOIN t USING (doc_id)""")
def repeated_ngrams(spark, sf_dir):
    words = F.regexp_extract_all(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    return O.repeated_grams(table(spark, sf_dir, "documents").select("doc_id", words.alias("words")), "doc_id", copies=3)


@query(r"""SELECT d.doc_id, list_filter([CASE WHEN len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')) >= 400 THEN 'generation_token_limit' END, CASE WHEN n.doc_id IS NOT NULL THEN 'consecutive_repetition' END], lambda x: x IS NOT NULL) AS issues
FROM documents d LEFT JOIN (""" + ORACLES["repeated_ngrams"] + ") n ON d.doc_id = n.doc_id")
def decode_issues(spark, sf_dir):
    """Documents as decoded texts of at most 400 words: those that may have been cut, and those that repeat themselves."""
    words = F.regexp_extract_all(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    repeated = O.repeated_grams(rows, "doc_id", copies=3).select("doc_id", F.lit(True).alias("repeated"))
    return rows.join(repeated, "doc_id", "left").select("doc_id", U.decode_issues(F.size("words"), 400, F.col("repeated")).alias("issues"))


@query("""SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || ', ' || p_type || ',,' || p_brand, '[,\n]'), lambda x: trim(x)), lambda x: x <> '')[1:50] AS terms FROM part""")
def glossary_split(spark, sf_dir):
    line = F.concat("p_name", F.lit(", "), "p_type", F.lit(",,"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", X.term_list(line).alias("terms"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
ELSE lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events)""")
def clock_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.clock(F.col("value") * 60).alias("clock"))


@query("""SELECT doc_id, replace(replace(replace('{"text":"' || regexp_replace(text, '[^a-zA-Z<>& ]', '', 'g') || '</script>"}', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS payload FROM documents""".replace("\\\\", "\\"))
def html_safe_payload(spark, sf_dir):
    letters = F.concat(F.regexp_replace("text", "[^a-zA-Z<>& ]", ""), F.lit("</script>"))
    return table(spark, sf_dir, "documents").select("doc_id", X.html_safe_json(F.to_json(F.struct(letters.alias("text")), {"escapeForwardSlash": "false"})).alias("payload"))


@query("""SELECT doc_id, string_split(text, 'the') AS parts FROM documents""")
def highlight_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.highlight("text", "the").alias("parts"))


@query("""WITH s AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM events)
SELECT event_id, stamp, row_number() OVER (PARTITION BY user_id ORDER BY stamp DESC, event_id) AS place FROM s""")
def stamped_events(spark, sf_dir):
    """Events with their time as text, and their place among their user's, the newest first, by that text."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", X.stamp(F.col("ts").cast("timestamp")).alias("stamp"))
    return rows.select("event_id", "stamp", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("stamp"), "event_id")).cast("long").alias("place"))
