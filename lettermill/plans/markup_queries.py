"""Queries of markup functions and file ledgers."""

from pyspark.sql import functions as F

from lettermill.functions import markup
from lettermill.operators import ledger
from lettermill.plans.registry import Registry
from lettermill.plans.sqlparts import q
from lettermill.plans.views import docs_mail, html_mail
from lettermill.sources import renderers

Q = Registry()

_CLEAN = "coalesce(html, '')"
for _p in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?is)<(?:meta|link)\b[^>]*>", "(?s)<!--.*?-->", r"(?s)<[^>]*>"):
    _CLEAN = f"regexp_replace({_CLEAN}, {q(_p)}, '{' ' if _p == r'(?s)<[^>]*>' else ''}', 'g')"
for _name, _letter in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}.items():
    _CLEAN = f"replace({_CLEAN}, {q(_name)}, {q(_letter)})"
_TEXT = f"trim(regexp_replace({_CLEAN}, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'))"


@Q.add("html_text", f"SELECT page_id AS gmail_id, sha256({_TEXT}) AS digest, CAST(length({_TEXT}) AS INTEGER) AS n FROM pages")
def html_text(spark, d):
    t = html_mail(spark, d).select("gmail_id", markup.html_text(F.coalesce("body_html", F.lit(""))).alias("t"))
    return t.select("gmail_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("n"))


@Q.add("markdown_quality", r"""WITH m AS (SELECT doc_id AS gmail_id, '# ' || split_part(text, chr(10), 1) || chr(10) || chr(10) || text AS md, text AS t FROM documents WHERE text IS NOT NULL),
  l AS (SELECT *, list_filter(string_split(md, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM m), a AS (SELECT *, list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / len(ls) AS mean FROM l)
  SELECT gmail_id, round(least(1.0::DOUBLE, CASE WHEN length(trim(t)) > 0 THEN least(length(trim(md))::DOUBLE / length(trim(t)), 1.0::DOUBLE) ELSE 0.0::DOUBLE END * 0.4::DOUBLE
    + (regexp_matches(md, '(?m)^#{1,6}[\t\n\x0B\f\r ]')::INT + regexp_matches(md, '(?m)^[*\-+\d.][\t\n\x0B\f\r ]')::INT + regexp_matches(md, '\[.+\]\(.+\)')::INT) / 3.0::DOUBLE * 0.3::DOUBLE
    + CASE WHEN mean BETWEEN 20 AND 120 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE
    + ((NOT regexp_matches(md, '\n{4,}'))::INT + (NOT regexp_matches(md, '(?m)^#{1,6}[^#\t\n\x0B\f\r ]'))::INT) / 2.0::DOUBLE * 0.1::DOUBLE), 6) AS quality FROM a""")
def markdown_quality(spark, d):
    m = docs_mail(spark, d).where(F.col("body").isNotNull())
    md = F.concat(F.lit("# "), "subject", F.lit("\n\n"), "body")
    return m.select("gmail_id", F.round(markup.markdown_quality(md, F.col("body")), 6).alias("quality"))


@Q.add("best_rendering", "SELECT doc_id AS gmail_id, 'plain' AS name FROM documents WHERE text IS NOT NULL")
def best_rendering(spark, d):
    m = docs_mail(spark, d).where(F.col("body").isNotNull())
    best = markup.best_rendering({"plain": (F.col("body"), F.lit(0.8)), "fallback": (F.lit(""), F.lit(0.6)), "failed": (F.lit(""), F.lit(0.0))})
    return m.select("gmail_id", best["name"].alias("name"))


def _spread(rows, key):
    """Small tables are few partitions; pages are rendered in Python, so rows are dealt to all cores."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


@Q.add("tree_markdown", """SELECT event_id AS gmail_id, '## ' || event_type || chr(10) || chr(10) || 'User **' || user_id || '** at [' || event_type || '](http://x/' || event_id || ')' || chr(10) || chr(10) || '- a' || chr(10) || '  - ' || user_id || chr(10) || '- c' || chr(10) || chr(10)
    || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| n\\|m | ' || event_id || ' |' AS tree,
  '## ' || event_type || chr(10) || chr(10) || 'User **' || user_id || '** at [' || event_type || '][1]' || chr(10) || chr(10) || '- a' || chr(10) || '  - ' || user_id || chr(10) || '- c' || chr(10) || chr(10)
    || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| n\\|m | ' || event_id || ' |' || chr(10) || chr(10) || '[1]: http://x/' || event_id AS links FROM events""")
def tree_markdown(spark, d):
    """Pages made of events, with a heading, a link, a nested list without end tags, and a table; two renderings."""
    e = _spread(spark.read.parquet(f"{d}/events.parquet"), "event_id")
    k, kind, user = F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string")
    page = F.concat(F.lit("<div><h2>"), kind, F.lit("</h2><script>x</script><p>User <b>"), user, F.lit("</b>\n at <a href='http://x/"), k, F.lit("'>"), kind, F.lit("</a><ul><li>a<ul><li>"), user, F.lit("</ul><li>c</ul><table><tr><th>k<th>v<tr><td>n|m<td>"), k, F.lit("</table></div>"))
    return renderers.with_renderings(e.select(F.col("event_id").alias("gmail_id"), page.alias("body_html")), names=("tree", "links")).select("gmail_id", "tree", "links")


@Q.add("best_of_renderings", """SELECT page_id AS gmail_id, page_id % 4 = 3 AS is_plain, true AS whole FROM pages""")
def best_of_renderings(spark, d):
    """The best of three renderings of each page; where the page is gone, of its text part."""
    m = _spread(html_mail(spark, d), "gmail_id").withColumn("body", F.when(F.col("gmail_id") % 4 == 3, "a text part")).withColumn("body_html", F.when(F.col("gmail_id") % 4 != 3, F.col("body_html")))
    best = renderers.best_markdown(m, plain="body")
    return best.select("gmail_id", (F.col("rendering") == "plain").alias("is_plain"), ((F.length("markdown") > 0) & F.col("quality").between(0.01, 1.0)).alias("whole"))


def _files(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select(F.concat(F.lit("2024/0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".EML").when(F.col("page_id") % 3 == 1, ".md").otherwise("")).alias("path"), F.octet_length("html").cast("long").alias("size"))


@Q.add("file_extension_stats", "SELECT CASE page_id % 3 WHEN 0 THEN '.eml' WHEN 1 THEN '.md' ELSE '' END AS extension, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def file_extension_stats(spark, d):
    return ledger.file_stats(_files(spark, d))


@Q.add("path_periods", "SELECT 'year' AS kind, '2024' AS period, count(*) AS n FROM pages UNION ALL SELECT 'month', '0' || (page_id % 9 + 1), count(*) FROM pages GROUP BY 2 UNION ALL SELECT 'month', page_id::VARCHAR, count(*) FROM pages WHERE page_id % 3 = 2 AND length(page_id::VARCHAR) = 2 GROUP BY 2 UNION ALL SELECT 'year', page_id::VARCHAR, count(*) FROM pages WHERE page_id % 3 = 2 AND length(page_id::VARCHAR) = 4 GROUP BY 2")
def path_periods(spark, d):
    return ledger.path_periods(_files(spark, d))


@Q.add("error_classes", """SELECT event_id, CASE WHEN s = 401 THEN 'authentication' WHEN s = 403 AND m = 'Quota exceeded' THEN 'quota' WHEN s = 403 THEN 'permission' WHEN s = 429 THEN 'rate_limit' WHEN s >= 500 THEN 'network' WHEN m = 'Invalid value' THEN 'validation' ELSE 'unknown' END AS category,
  CASE WHEN s IN (401, 403) THEN 'high' WHEN s IS NULL AND m = 'Invalid value' THEN 'low' ELSE 'medium' END AS severity, NOT (s = 401 OR (s = 403 AND m <> 'Quota exceeded')) IS TRUE AS recoverable
  FROM (SELECT event_id, [401, 403, 429, 503, NULL][event_id % 5 + 1] AS s, CASE WHEN event_id % 2 = 0 THEN 'Quota exceeded' ELSE 'Invalid value' END AS m FROM events)""")
def error_classes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    status = F.get(F.array(*[F.lit(x).cast("int") for x in (401, 403, 429, 503, None)]), (F.col("event_id") % 5).cast("int"))
    message = F.when(F.col("event_id") % 2 == 0, "Quota exceeded").otherwise("Invalid value")
    return e.select("event_id", markup.error_class(status, message).alias("c")).select("event_id", "c.*")


@Q.add("redact_records")
def redact_records(spark, d):
    """Conversations as nested records, with senders and personal data replaced; tests hold the rules."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    rows = c.select("conv_id", "turn", F.struct(F.col("role").alias("sender"), F.array("text").alias("parts")).alias("mail"))
    return markup.redact_record(rows).select("conv_id", "turn", "mail.sender", F.sha2(F.get("mail.parts", F.lit(0)), 256).alias("body"))


@Q.add("wrapped_bodies")
def wrapped_bodies(spark, d):
    """Bodies with lines of 100 characters at most where spaces allow it."""
    return docs_mail(spark, d).select("gmail_id", markup.wrap(F.coalesce("body", F.lit(""))).alias("body"))



@Q.add("content_types", "SELECT CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'message/rfc822' END AS content_type, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def content_types(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return ledger.content_types(p.select(F.when(F.col("page_id") % 2 == 0, "text/html").otherwise("message/rfc822").alias("content_type"), F.octet_length("html").cast("long").alias("size")))


_SYNC = "s AS (SELECT user_id % 20 AS source, max(event_id) AS history_id, count(*) AS total_synced FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT user_id % 20 AS source, max(event_id) AS history_id, count(*) AS total_synced FROM events WHERE event_id % 3 = 0 GROUP BY 1)"


def _synced(spark, d, step):
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_id") % step == 0)
    return e.groupBy((F.col("user_id") % 20).alias("source")).agg(F.max("event_id").alias("history_id"), F.count("*").alias("total_synced"))


@Q.add("sync_needed", f"WITH {_SYNC} SELECT c.source, s.history_id IS NULL OR c.history_id > s.history_id AS needed FROM c LEFT JOIN s USING (source)")
def sync_needed(spark, d):
    return ledger.sync_needed(_synced(spark, d, 3), _synced(spark, d, 2))


@Q.add("sync_state", f"WITH {_SYNC} SELECT source, max(history_id) AS history_id, CAST(sum(total_synced) AS BIGINT) AS total_synced FROM (SELECT * FROM s UNION ALL SELECT * FROM c) GROUP BY 1")
def sync_state(spark, d):
    return ledger.sync_state(_synced(spark, d, 2), _synced(spark, d, 3))


@Q.add("exhausted_letters", "SELECT user_id AS message_id, event_type AS failure_type, count(*) AS attempts FROM events WHERE event_type IN ('error', 'click') GROUP BY 1, 2 HAVING count(*) >= 5")
def exhausted_letters(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type in ('error', 'click')")
    letters = ledger.dead_letters(e.select(F.col("user_id").alias("message_id"), F.col("event_type").alias("failure_type"), F.col("ts").alias("failed_at")))
    return ledger.exhausted(letters).select("message_id", "failure_type", "attempts")
