"""Queries of the store: dedup, merges, exports, ledgers, search."""

from pyspark.sql import functions as F

from lettermill.operators import search, store
from lettermill.operators.fulltext import MailIndex
from lettermill.plans.profile_queries import DOCS, EVENTS, as_text
from lettermill.plans.registry import Registry
from lettermill.plans.scratch import shared_folder
from lettermill.plans.views import docs_mail, events_mail, threads

Q = Registry()


@Q.add("dedup_first", "SELECT min(doc_id) AS gmail_id, text AS body FROM documents GROUP BY text")
def dedup_first(spark, d):
    return store.dedup(docs_mail(spark, d).select("gmail_id", "body"), "body", ["gmail_id"])


@Q.add("dedup_last", "SELECT max(doc_id) AS gmail_id, text AS body FROM documents GROUP BY text")
def dedup_last(spark, d):
    return store.dedup(docs_mail(spark, d).select("gmail_id", "body"), "body", ["gmail_id"], "last")


@Q.add("dedup_best", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_best(spark, d):
    """The largest, then the newest of each key."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value")
    return store.dedup(e, "user_id", ["value", "event_id"], "last")


@Q.add("duplicate_groups", "SELECT text AS body, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) - 1 AS surplus FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return store.duplicate_groups(docs_mail(spark, d), "body", "gmail_id")


@Q.add("sha256_duplicates", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def sha256_duplicates(spark, d):
    m = docs_mail(spark, d).select("gmail_id", F.sha2("body", 256).alias("sha256"))
    return store.duplicate_groups(m, "sha256", "gmail_id").select("sha256", "n", "first_id")


@Q.add("monthly_summary", f"{EVENTS} SELECT strftime(date_received, '%Y-%m') AS year_month, count(*) AS n, count(DISTINCT sender) AS senders, min(date_received) AS first_mail, max(date_received) AS last_mail, count(*) FILTER (list_contains(labels, 'error')) AS flagged FROM mail GROUP BY 1")
def monthly_summary(spark, d):
    return store.monthly_summary(events_mail(spark, d))


@Q.add("sender_summary_having", f"{EVENTS} SELECT sender, count(*) AS n, min(date_received) AS first_mail, max(date_received) AS last_mail FROM mail GROUP BY sender HAVING count(*) >= 12")
def sender_summary_having(spark, d):
    return store.sender_summary(events_mail(spark, d), 12)


@Q.add("store_totals", f"{EVENTS} SELECT count(*) AS total, count(DISTINCT sender) AS senders, count(DISTINCT gmail_id) AS ids, min(date_received) AS first_mail, max(date_received) AS last_mail, count(DISTINCT strftime(date_received, '%Y-%m')) AS months FROM mail")
def store_totals(spark, d):
    return store.store_totals(events_mail(spark, d))


@Q.add("monthly_envelopes", f"{EVENTS} SELECT strftime(date_received, '%Y-%m') AS year_month, count(*) AS n, min(date_received) AS first_mail, max(date_received) AS last_mail, CAST(sum(gmail_id) AS BIGINT) AS ids_sum FROM mail GROUP BY 1")
def monthly_envelopes(spark, d):
    return store.monthly_documents(events_mail(spark, d))


@Q.add("label_table", f"{DOCS} SELECT DISTINCT gmail_id, unnest(labels) AS label FROM mail")
def label_table(spark, d):
    return store.labels_table(docs_mail(spark, d))


@Q.add("participants", "SELECT event_id AS gmail_id, t AS type, 'user' || user_id || '@' || event_type || '.example.com' AS address, CASE t WHEN 'from' THEN 'User ' || user_id END AS display_name, event_type || '.example.com' AS domain FROM events, (VALUES ('from'), ('to')) v(t)")
def participants(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    addr = F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@"), F.col("event_type"), F.lit(".example.com"))
    heads = e.select(F.col("event_id").alias("gmail_id"), F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" <"), addr, F.lit(">")).alias("from"), F.concat(addr, F.lit(", "), addr).alias("to"))
    return store.participants(heads)


@Q.add("export_rows", f"{EVENTS} SELECT gmail_id, sender, lower(split_part(sender, '@', 2)) AS sender_domain, subject, date_received AS date, CAST(length(body) AS INTEGER) AS message_length, contains(upper(array_to_string(labels, ',')), 'ATTACHMENT') AS has_attachments, NOT contains(upper(array_to_string(labels, ',')), 'UNREAD') AS is_read, strftime(date_received, '%Y-%m') AS year_month FROM mail")
def export_rows(spark, d):
    return store.export_rows(events_mail(spark, d))


def _halves(spark, d):
    """A store and a delta that overlaps it: views and clicks; later rows carry new subjects."""
    m = events_mail(spark, d).select("gmail_id", "subject", "sender", "body")
    old = m.where("subject in ('view', 'click')")
    new = m.where("subject in ('click', 'error')").withColumns({"subject": F.when(F.col("gmail_id") % 2 == 0, F.concat("subject", F.lit("!"))), "sender": F.lit(None).cast("string")})
    return old, new


@Q.add("upsert_merge", f"""{EVENTS}, o AS (SELECT gmail_id, subject, sender, body FROM mail WHERE subject IN ('view', 'click')), n AS (SELECT gmail_id, CASE WHEN gmail_id % 2 = 0 THEN subject || '!' END AS subject, body FROM mail WHERE subject IN ('click', 'error'))
  SELECT coalesce(o.gmail_id, n.gmail_id) AS gmail_id, coalesce(n.subject, o.subject) AS subject, o.sender, coalesce(n.body, o.body) AS body,
    CASE WHEN o.gmail_id IS NULL THEN 'inserted' WHEN n.gmail_id IS NULL THEN 'kept' WHEN n.subject IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS merge_action FROM o FULL JOIN n USING (gmail_id)""")
def upsert_merge(spark, d):
    return store.upsert(*_halves(spark, d))


@Q.add("soft_delete_live", f"{EVENTS} SELECT gmail_id, sender FROM mail WHERE subject <> 'click'")
def soft_delete_live(spark, d):
    m = events_mail(spark, d).select("gmail_id", "sender", "subject").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    gone = store.soft_delete(m, m.where("subject = 'click'"), F.expr("timestamp_ntz'2024-02-01'"))
    return store.live(gone).select("gmail_id", "sender")


@Q.add("restore_deleted", f"{EVENTS} SELECT gmail_id, CASE WHEN subject = 'click' AND gmail_id % 2 = 1 THEN '2024-02-01 00:00:00' END AS deleted_at FROM mail")
def restore_deleted(spark, d):
    m = events_mail(spark, d).select("gmail_id", "subject").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    gone = store.soft_delete(m, m.where("subject = 'click'"), F.expr("timestamp_ntz'2024-02-01'"))
    return as_text(store.restore(gone, m.where("gmail_id % 2 = 0")).select("gmail_id", "deleted_at"), "deleted_at")


@Q.add("net_added", "SELECT DISTINCT user_id AS message_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)")
def net_added(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("user_id", "message_id")
    return store.net_added(e.where("event_type = 'signup'"), e.where("event_type = 'error' and value > 200"))


@Q.add("existence_probe", "SELECT o_orderkey AS gmail_id, o_orderkey IN (SELECT event_id FROM events) AS found FROM orders")
def existence_probe(spark, d):
    ids = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("gmail_id"))
    return store.exists(ids, events_mail(spark, d))


@Q.add("verify_manifest", """WITH m AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS want FROM documents WHERE lang <> 'de'), k AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN lang = 'fr' THEN text || '.' ELSE text END) AS have FROM documents WHERE lang <> 'es')
  SELECT coalesce(m.path, k.path) AS path, CASE WHEN m.path IS NULL THEN 'extra' WHEN k.path IS NULL THEN 'missing' WHEN want = have THEN 'verified' ELSE 'corrupted' END AS status FROM m FULL JOIN k USING (path)""")
def verify_manifest(spark, d):
    m = docs_mail(spark, d).select(F.col("gmail_id").cast("string").alias("path"), "body", "lang")
    disk = m.where("lang <> 'es'").withColumn("body", F.when(F.col("lang") == "fr", F.concat("body", F.lit("."))).otherwise(F.col("body")))
    return store.verify_manifest(m.where("lang <> 'de'").withColumn("sha256", F.sha2("body", 256)), disk.withColumn("sha256", F.sha2("body", 256)))


@Q.add("merge_backups", """WITH s AS (SELECT o_orderkey AS file_id, 'eml' AS ext, CAST(o_totalprice AS BIGINT) AS s FROM orders WHERE o_orderstatus <> 'O'), t AS (SELECT o_orderkey AS file_id, 'eml' AS ext, CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_totalprice AS BIGINT) ELSE o_custkey * 100 END AS t FROM orders WHERE o_orderstatus <> 'P')
  SELECT coalesce(s.file_id, t.file_id) AS file_id, 'eml' AS ext, CASE WHEN s.file_id IS NULL THEN 'stay' WHEN t.file_id IS NULL THEN 'move' WHEN s = t THEN 'drop' WHEN s > t THEN 'replace' ELSE 'keep' END AS action FROM s FULL JOIN t USING (file_id)""")
def merge_backups(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("file_id"), F.lit("eml").alias("ext"), F.round("o_totalprice").cast("long").alias("size"), "o_orderstatus", "o_orderpriority", "o_custkey")
    other = o.withColumn("size", F.when(F.col("o_orderpriority") == "5-LOW", F.col("size")).otherwise(F.col("o_custkey") * 100))
    return store.merge_backups(o.where("o_orderstatus <> 'O'"), other.where("o_orderstatus <> 'P'"))


@Q.add("rename_conflicts", "SELECT p_partkey AS path, p_brand || '.eml' AS name, CASE WHEN i = 0 THEN p_brand || '.eml' ELSE p_brand || '_dup' || i || '.eml' END AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)")
def rename_conflicts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("path"), F.concat("p_brand", F.lit(".eml")).alias("name"))
    return store.rename_conflicts(p)


@Q.add("retention_rank", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events) WHERE event_type NOT IN ('click', 'error') OR r <= CASE event_type WHEN 'click' THEN 5 ELSE 3 END")
def retention_rank(spark, d):
    """Newest five of one state, newest three of another, all others."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return store.retain(e, "event_type", "ts", {"click": 5, "error": 3}).select("event_id", "event_type")


@Q.add("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return store.latest(e, "user_id", "ts").select("user_id", "event_id", "event_type")


@Q.add("label_mutation", f"{EVENTS} SELECT gmail_id, array_to_string(CASE WHEN subject IN ('view', 'error') THEN list_sort(list_filter(list_concat(labels, ['DONE']), lambda x: x <> 'error')) ELSE labels END, ',') AS labels FROM mail")
def label_mutation(spark, d):
    m = events_mail(spark, d).select("gmail_id", "labels", "subject")
    out = store.change_labels(m, ["DONE"], ["error"], m.where("subject in ('view', 'error')"))
    return out.select("gmail_id", F.array_join("labels", ",").alias("labels"))


@Q.add("high_water_mark", f"{EVENTS} SELECT max(date_received) AS high_water, strftime(max(date_received), '%Y/%m/%d') AS after FROM mail")
def high_water_mark(spark, d):
    return store.high_water(events_mail(spark, d))


@Q.add("date_range_filter", f"{EVENTS} SELECT gmail_id FROM mail WHERE date_received >= TIMESTAMP '2024-01-05' AND date_received < TIMESTAMP '2024-01-11'")
def date_range_filter(spark, d):
    return search.between_days(events_mail(spark, d), "2024-01-05", "2024-01-10", whole_last_day=True).select("gmail_id")


@Q.add("date_range_midnight", f"{EVENTS} SELECT gmail_id FROM mail WHERE date_received BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def date_range_midnight(spark, d):
    return search.between_days(events_mail(spark, d), "2024-01-05", "2024-01-10").select("gmail_id")


@Q.add("exact_day_filter", f"{EVENTS} SELECT gmail_id, sender FROM mail WHERE CAST(date_received AS DATE) = DATE '2024-01-07'")
def exact_day_filter(spark, d):
    return search.on_day(events_mail(spark, d), "2024-01-07").select("gmail_id", "sender")


@Q.add("like_search", "SELECT gmail_id FROM (SELECT doc_id AS gmail_id FROM documents WHERE contains(lower(text), 'disgusting') ORDER BY doc_id DESC LIMIT 50)")
def like_search(spark, d):
    return search.like_search(docs_mail(spark, d).withColumn("date_received", F.col("gmail_id")), "Disgusting", 50).select("gmail_id")


@Q.add("mail_query_grammar", f"""{EVENTS} SELECT gmail_id FROM mail WHERE contains(sender, 'user1') AND (contains(subject, 'error') OR contains(subject, 'click')) AND NOT list_contains(labels, 'click') AND date_received >= TIMESTAMP '2024-01-03' AND date_received < TIMESTAMP '2024-01-20'""")
def mail_query_grammar(spark, d):
    return events_mail(spark, d).where(search.mail_query("from:user1 (subject:error OR subject:click) -label:click after:2024/01/03 before:2024/01/20")).select("gmail_id")


@Q.add("segment_counts", f"""{EVENTS} SELECT 'errors' AS segment, count(*) FILTER (subject = 'error') AS n FROM mail UNION ALL SELECT 'older', count(*) FILTER (date_received < TIMESTAMP '2024-01-24') FROM mail UNION ALL SELECT 'large', count(*) FILTER (value > 100) FROM mail""")
def segment_counts(spark, d):
    seg = {"errors": search.mail_query("label:error"), "older": search.mail_query("older_than:7d", now="2024-01-31"), "large": search.mail_query("larger:100", size="value")}
    return search.segment_counts(events_mail(spark, d), seg)


_TOK = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@Q.add("inverted_index", "WITH t AS (SELECT doc_id AS gmail_id, unnest(" + _TOK.format(c="text") + ") AS term FROM documents) SELECT term, gmail_id, 'body' AS field, count(*) AS tf FROM t GROUP BY 1, 2")
def inverted_index(spark, d):
    return search.postings(docs_mail(spark, d), fields=("body",))


def _bm25(terms):
    n = "+".join(f"CASE WHEN c{i} > 0 THEN 0 ELSE 1 END" for i in range(len(terms)))
    cs = ", ".join(f"2.0::DOUBLE * len(list_filter(su, lambda x: x = '{t}')) + len(list_filter(bo, lambda x: x = '{t}')) + len(list_filter(se, lambda x: x = '{t}')) AS c{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (c{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + ((SELECT count(*) FROM c) - d{i} + 0.5) / (d{i} + 0.5)) * c{i} * 2.2 / (c{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))" for i in range(len(terms)))
    return f"""{DOCS}, t AS (SELECT gmail_id, {_TOK.format(c='subject')} AS su, {_TOK.format(c='body')} AS bo, {_TOK.format(c='sender')} AS se FROM mail), c AS (SELECT gmail_id, len(su) + len(bo) + len(se) AS dl, {cs} FROM t),
  s AS (SELECT avg(dl) AS av, {dfs} FROM c) SELECT gmail_id, round({score}, 6) AS score FROM c, s WHERE ({n}) = 0 ORDER BY score DESC, gmail_id LIMIT 50"""


@Q.add("bm25_search", _bm25(["the", "worthless"]))
def bm25_search(spark, d):
    return search.bm25_search(docs_mail(spark, d), "the worthless", 50)


def _counted(terms: str, prefix: bool = False, only: str | None = None) -> str:
    """DuckDB: how often a phrase stands in the fields, each with its weight."""
    words, out = terms.split(), []
    for field, weight in (("su", 2), ("bo", 1), ("se", 1)):
        if only in (None, field):
            fits = " AND ".join(f"starts_with({field}[i + {j}], '{w}')" if prefix and j == len(words) - 1 else f"{field}[i + {j}] = '{w}'" for j, w in enumerate(words))
            out.append(f"{weight}.0::DOUBLE * len(list_filter(range(1, len({field}) + 2 - {len(words)}), lambda i: {fits}))")
    return " + ".join(out)


def _match(mail: str, units: list[str], where: str) -> str:
    """DuckDB: BM25 of the units over the tokens of a CTE ``mail``, for the mails that ``where`` takes."""
    counts = ", ".join(f"{u} AS c{i}" for i, u in enumerate(units))
    dfs = ", ".join(f"count(*) FILTER (c{i} > 0) AS d{i}" for i in range(len(units)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * c{i} * 2.2 / (c{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))" for i in range(len(units)))
    return f"""{mail}, t AS (SELECT gmail_id, {_TOK.format(c='subject')} AS su, {_TOK.format(c='body')} AS bo, {_TOK.format(c='sender')} AS se FROM mail), c AS (SELECT gmail_id, len(su) + len(bo) + len(se) AS dl, {counts} FROM t),
  s AS (SELECT avg(dl) AS av, count(*) AS n, {dfs} FROM c) SELECT gmail_id, round({score}, 6) AS score FROM c, s WHERE {where} ORDER BY score DESC, gmail_id LIMIT 50"""


@Q.add("match_expression", _match(DOCS, [_counted("the the"), _counted("wor", True), _counted("worthless"), _counted("er"), _counted("src1", True, "se")], "c0 > 0 AND c1 > 0 AND NOT (c2 > 0 OR c3 > 0) OR c4 > 0 AND c0 > 0"))
def match_expression(spark, d):
    """A phrase, a prefix, a negation and a field, by a fresh index."""
    index = MailIndex(spark, shared_folder(spark, "index"))
    index.update(docs_mail(spark, d))
    return index.match('"the the" wor* NOT (worthless OR er) OR (sender : src1* AND "the the")')


@Q.add("match_after_changes", _match("""WITH mail AS (SELECT doc_id AS gmail_id, source || '@' || lang || '.example.org' AS sender, split_part(text, chr(10), 1) AS subject, CASE WHEN doc_id % 3 = 0 THEN 'Urgent notice ' || text ELSE text END AS body
  FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 AND doc_id % 5 <> 0)""", [_counted("urgent notice"), _counted("the"), _counted("worthless"), _counted("of the")], "(c0 > 0 AND c1 > 0) AND NOT c2 > 0 OR c3 > 0"))
def match_after_changes(spark, d):
    """The same mailbox in three segments: half of it, then changed and new mail, then deletions."""
    m = docs_mail(spark, d).select("gmail_id", "subject", "body", "sender")
    index = MailIndex(spark, shared_folder(spark, "index"), buckets=16)
    index.update(m.where("gmail_id % 2 = 0"))
    index.update(m.where("gmail_id % 3 = 0").withColumn("body", F.concat(F.lit("Urgent notice "), "body")))
    index.update(m.limit(0), m.where("gmail_id % 5 = 0 and gmail_id % 3 <> 0"))
    return index.match('urgent + notice the NOT worthless OR "of the"')


@Q.add("thread_summary", "SELECT conv_id AS thread_id, count(*) AS n, count(DISTINCT role) AS senders, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def thread_summary(spark, d):
    return threads(spark, d).groupBy("thread_id").agg(F.count("*").alias("n"), F.countDistinct("sender").alias("senders"), F.sum(F.length("body")).alias("chars"))
