"""Queries of text functions: personal data, URLs, addresses, dates, retry schedules, reports."""

from pyspark.sql import functions as F

from lettermill.functions import packs, text
from lettermill.operators import insights, ledger
from lettermill.plans.profile_queries import CLASSIFIED, classified_events
from lettermill.plans.registry import Registry
from lettermill.plans.sqlparts import q
from lettermill.plans.views import docs_mail, events_mail, html_mail

Q = Registry()

_REDACTED = "coalesce(text, '')"
for _k, _p, _m in packs.PII:
    _REDACTED = f"regexp_replace({_REDACTED}, {q(_p)}, {q(_m)}, 'g')"


@Q.add("redact_text", f"SELECT doc_id AS gmail_id, sha256({_REDACTED}) AS redacted FROM documents")
def redact_text(spark, d):
    """Digest of the redacted body."""
    return docs_mail(spark, d).select("gmail_id", F.sha2(text.redact(F.coalesce("body", F.lit(""))), 256).alias("redacted"))


@Q.add("redact_counts", f"WITH r AS (SELECT doc_id AS gmail_id, {_REDACTED} AS t FROM documents) SELECT gmail_id, " + ", ".join(f"CAST((length(t) - length(replace(t, {q(m)}, ''))) // {len(m)} AS INTEGER) AS {k}" for k, _, m in packs.PII) + " FROM r")
def redact_counts(spark, d):
    counts = text.count_pii(F.col("body"))
    return docs_mail(spark, d).select("gmail_id", *[c.alias(k) for k, c in counts.items()])


@Q.add("mask_address", "SELECT event_id AS gmail_id, 'us***@' || event_type || '.example.com' AS masked, CASE WHEN length(props) > 6 THEN left(props, 6) || '...' ELSE props END AS short FROM events")
def mask_address(spark, d):
    return events_mail(spark, d).select("gmail_id", text.mask_address(F.col("sender")).alias("masked"), text.mask_subject(F.col("body"), 6).alias("short"))


@Q.add("tracking_param_strip", f"""WITH u AS (SELECT page_id AS gmail_id, url, regexp_extract(url, '^([^?#]*)', 1) AS head, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '(#.*)$', 1) AS tail FROM pages),
  k AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT ({" OR ".join(f"contains(lower(split_part(p, '=', 1)), '{t}')" for t in packs.TRACKING)})), '&') AS kept FROM u)
  SELECT gmail_id, head || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || tail AS clean FROM k""")
def tracking_param_strip(spark, d):
    return html_mail(spark, d).select("gmail_id", text.strip_tracking(F.col("url")).alias("clean"))


@Q.add("host_of_url", "SELECT page_id AS gmail_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages")
def host_of_url(spark, d):
    return html_mail(spark, d).select("gmail_id", text.host_of(F.col("url")).alias("host"))


@Q.add("address_parse", "SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.com' AS address, c_name AS display_name, lower(c_mktsegment) || '.com' AS export_domain FROM customer")
def address_parse(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    header = F.concat("c_name", F.lit(" <"), F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.lit("@"), "c_mktsegment", F.lit(".com>"))
    rows = c.select("c_custkey", header.alias("h"))
    return rows.select("c_custkey", text.parse_address(F.col("h"))["address"].alias("address"), text.parse_address(F.col("h"))["display_name"].alias("display_name"), text.export_domain(F.col("h")).alias("export_domain"))


@Q.add("filename_sanitise", r"""SELECT page_id, CASE WHEN c = '' THEN 'unnamed' WHEN length(c) > 40 THEN left(c, 40 - length(e)) || e ELSE c END AS file_name FROM (SELECT page_id, c, regexp_extract(c, '(\.[A-Za-z0-9]{1,10})$', 1) AS e FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS c FROM pages))""")
def filename_sanitise(spark, d):
    return html_mail(spark, d).select(F.col("gmail_id").alias("page_id"), text.sanitise_filename(F.col("url"), 40).alias("file_name"))


@Q.add("message_id_from_name", "SELECT doc_id, substr(md5(doc_id::VARCHAR), 1, 16) AS message_id FROM documents")
def message_id_from_name(spark, d):
    name = F.concat(F.lit("2024-06-01_172200_subject_"), F.left(F.md5(F.col("doc_id").cast("string")), F.lit(16)), F.lit(".eml"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.message_id(name).alias("message_id"))


@Q.add("mail_date_parse", "SELECT o_orderkey, o_orderdate + INTERVAL 5 HOUR AS parsed FROM orders")
def mail_date_parse(spark, d):
    """RFC 2822 dates with a wrong weekday and an offset, read back to UTC."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    written = F.concat(F.lit("Mon, "), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" -0500 (EST)"))
    return o.select("o_orderkey", text.parse_mail_date(written).cast("timestamp_ntz").alias("parsed"))


@Q.add("retry_schedule", """SELECT event_id, CAST(event_id % 7 + 1 AS INTEGER) AS attempt, least(pow(2.0::DOUBLE, event_id % 7), 30.0::DOUBLE) AS backoff_s,
  CASE WHEN event_id % 7 + 1 < 5 THEN ts + to_seconds(CAST(300 * pow(2, event_id % 7) AS BIGINT)) END AS next_retry FROM events""")
def retry_schedule(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("attempt", (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", "attempt", text.backoff_seconds(F.col("attempt"), 1.0, 30.0).alias("backoff_s"), text.next_retry(F.col("ts"), F.col("attempt")).cast("timestamp_ntz").alias("next_retry"))


_FAILURES = "f AS (SELECT event_id, user_id AS message_id, event_type AS failure_type, ts AS failed_at, CAST(event_id % 7 AS INTEGER) AS attempts FROM events WHERE event_type IN ('error', 'click'))"


def _failures(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type in ('error', 'click')")
    return e.select(F.col("user_id").alias("message_id"), F.col("event_type").alias("failure_type"), F.col("ts").alias("failed_at"))


@Q.add("dead_letters", f"""WITH {_FAILURES} SELECT message_id, failure_type, count(*) AS attempts, min(failed_at) AS first_failure, max(failed_at) AS last_failure,
  CASE WHEN count(*) < 5 THEN max(failed_at) + to_seconds(CAST(300 * pow(2, count(*) - 1) AS BIGINT)) END AS next_retry FROM f GROUP BY 1, 2""")
def dead_letters(spark, d):
    return ledger.dead_letters(_failures(spark, d))


@Q.add("dead_letter_stats", f"""WITH {_FAILURES}, l AS (SELECT message_id, failure_type, count(*) AS a, CASE WHEN count(*) < 5 THEN max(failed_at) + to_seconds(CAST(300 * pow(2, count(*) - 1) AS BIGINT)) END AS r FROM f GROUP BY 1, 2)
  SELECT failure_type, count(*) AS pending, count(*) FILTER (r <= TIMESTAMP '2024-01-31') AS ready, count(*) FILTER (r IS NULL) AS exhausted, round(avg(a), 3) AS mean_attempts FROM l GROUP BY 1""")
def dead_letter_stats(spark, d):
    return ledger.dead_letter_stats(ledger.dead_letters(_failures(spark, d)), F.expr("timestamp_ntz'2024-01-31'"))


@Q.add("retry_queue", f"""WITH {_FAILURES}, l AS (SELECT message_id, failure_type, CASE WHEN count(*) < 5 THEN max(failed_at) + to_seconds(CAST(300 * pow(2, count(*) - 1) AS BIGINT)) END AS next_retry FROM f GROUP BY 1, 2)
  SELECT message_id, failure_type, next_retry FROM l WHERE next_retry <= TIMESTAMP '2024-01-31' ORDER BY next_retry, message_id, failure_type LIMIT 100""")
def retry_queue(spark, d):
    return ledger.ready(ledger.dead_letters(_failures(spark, d)), F.expr("timestamp_ntz'2024-01-31'"), 100).select("message_id", "failure_type", "next_retry")


@Q.add("history_delta", """WITH e AS (SELECT user_id AS message_id, event_id AS history_id, event_type, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' WHEN 'click' THEN 'label_added' ELSE 'label_removed' END AS type FROM events)
  SELECT message_id, max(history_id) AS history_id, bool_or(type = 'added') AND NOT bool_or(type = 'deleted') AS net_added, bool_or(type = 'deleted') AS deleted, count(*) FILTER (type LIKE 'label%') AS label_changes FROM e GROUP BY 1""")
def history_delta(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "click", "label_added").otherwise("label_removed")
    return ledger.history_delta(e.select(F.col("user_id").alias("message_id"), F.col("event_id").alias("history_id"), kind.alias("type")))


@Q.add("checkpoint_stats", "SELECT event_type AS state, count(*) AS n, count(*) FILTER (event_type IN ('error', 'view')) AS resumable, round(avg(least(value, 100.0)), 3) AS mean_progress FROM events GROUP BY 1")
def checkpoint_stats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return ledger.checkpoint_stats(e.select(F.col("event_type").alias("state"), F.least("value", F.lit(100.0)).alias("processed"), F.lit(100.0).alias("total")), ("error", "view"))


@Q.add("metric_histogram", """WITH v AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT name, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = CASE WHEN n > 20 THEN CAST(floor(n * 0.95) AS BIGINT) ELSE n - 1 END) AS p95, max(value) FILTER (i = CASE WHEN n > 100 THEN CAST(floor(n * 0.99) AS BIGINT) ELSE n - 1 END) AS p99 FROM v GROUP BY name""")
def metric_histogram(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return ledger.histograms(e.select(F.col("event_type").alias("name"), "value"))


@Q.add("metric_gauges", "SELECT event_type AS name, count(*) AS counter, max_by(value, ts) AS gauge FROM events GROUP BY 1")
def metric_gauges(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return ledger.gauges(e.select(F.col("event_type").alias("name"), "value", "ts"))


@Q.add("insight_rules", f"""{CLASSIFIED}, m AS (SELECT max(n) * 100.0::DOUBLE / sum(n) AS top_share FROM (SELECT count(*) AS n FROM classified GROUP BY category)), a AS (SELECT avg(is_automated::INT) * 100 AS auto_rate, avg(CASE WHEN category = 'Other' THEN 1 ELSE 0 END) * 100 AS other_rate FROM classified),
  s AS (SELECT max(n) * 100.0::DOUBLE / sum(n) AS sender_share FROM (SELECT count(*) AS n FROM classified GROUP BY sender)), v AS (SELECT stddev_samp(n) / avg(n) AS vol FROM (SELECT count(*) AS n FROM classified GROUP BY CAST(date_received AS DATE)))
  SELECT 'category' AS kind, CASE WHEN top_share > 50 THEN 'High' WHEN top_share > 30 THEN 'Medium' ELSE 'Low' END AS priority, round(top_share, 3) AS measured FROM m UNION ALL
  SELECT 'automation', CASE WHEN auto_rate > 70 THEN 'High' WHEN auto_rate > 50 THEN 'Medium' ELSE 'Low' END, round(auto_rate, 3) FROM a UNION ALL
  SELECT 'coverage', CASE WHEN other_rate > 50 THEN 'High' WHEN other_rate > 20 THEN 'Medium' ELSE 'Low' END, round(other_rate, 3) FROM a UNION ALL
  SELECT 'sender', CASE WHEN sender_share > 20 THEN 'High' WHEN sender_share > 10 THEN 'Medium' ELSE 'Low' END, round(sender_share, 3) FROM s UNION ALL
  SELECT 'volume', CASE WHEN vol > 1 THEN 'High' WHEN vol > 0.5 THEN 'Medium' ELSE 'Low' END, round(vol, 3) FROM v""")
def insight_rules(spark, d):
    return insights.insights(classified_events(spark, d))


@Q.add("markdown_plain")
def markdown_plain(spark, d):
    """Markdown made from documents, back to plain text; tests hold the rules."""
    m = docs_mail(spark, d)
    page = F.concat(F.lit("# "), F.coalesce("subject", F.lit("")), F.lit("\n\n> quoted\n\n- **item**\n\n"), F.coalesce("body", F.lit("")))
    return m.select("gmail_id", text.markdown_to_plain(page).alias("plain"))
