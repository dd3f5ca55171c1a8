"""Queries of the classifiers."""

from pyspark.sql import functions as F

from lettermill.functions import packs
from lettermill.operators import reports, rules, store
from lettermill.plans.profile_queries import CLASSIFIED, CLASSIFIED_DOCS, DOCS, EVENTS, classified_docs, classified_events
from lettermill.plans.registry import Registry
from lettermill.plans.sqlparts import any_match, any_of, case, hits, q
from lettermill.plans.views import docs_mail, events_mail, html_mail

Q = Registry()


@Q.add("rule_classification", f"{CLASSIFIED_DOCS} SELECT gmail_id, category, confidence, is_automated FROM classified")
def rule_classification(spark, d):
    return classified_docs(spark, d).select("gmail_id", "category", "confidence", "is_automated")


@Q.add("confidence_bands", f"{CLASSIFIED} SELECT CASE WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.6 THEN 'Medium' WHEN confidence >= 0.4 THEN 'Low' ELSE 'Very Low' END AS band, count(*) AS n FROM classified GROUP BY 1")
def confidence_bands(spark, d):
    return store.confidence_bands(classified_events(spark, d))


@Q.add("category_distribution", f"{CLASSIFIED_DOCS} SELECT category, count(*) AS n, round(avg(confidence), 3) AS avg_confidence, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM classified), 2) AS pct FROM classified GROUP BY category")
def category_distribution(spark, d):
    return store.category_shares(classified_docs(spark, d))


@Q.add("category_top_senders", f"""{CLASSIFIED_DOCS}, n AS (SELECT category, sender, count(*) AS n FROM classified GROUP BY 1, 2 HAVING count(*) >= 3), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, sender) AS INTEGER) AS rank FROM n) SELECT category, sender, n, rank FROM r WHERE rank <= 5""")
def category_top_senders(spark, d):
    return store.category_senders(classified_docs(spark, d))


def _group(text, groups, test):
    return case([(test(text, words), q(name)) for name, words in groups.items()], "NULL")


_SCORES = {d: " + ".join(f"(length(tx) - length(replace(tx, {q(w)}, ''))) // {len(w)}" for w in words) for d, words in packs.DOMAIN_KEYWORDS.items()}
_NAMES = "[" + ", ".join(map(q, _SCORES)) + "]"


def _three(mail: str) -> str:
    high, medium = any_of("su", packs.PRIORITY_KEYWORDS["High"]), any_of("su", packs.PRIORITY_KEYWORDS["Medium"])
    return f"""{mail}, f AS (SELECT mail.*, count(*) OVER (PARTITION BY sender) AS freq, lower(coalesce(sender, '')) AS fr, lower(coalesce(subject, '')) AS su, lower(coalesce(body, '')) AS tx, lower(coalesce(array_to_string(labels, ','), '')) AS tg FROM mail),
  g AS (SELECT *, {_group('fr', packs.SENDER_PATTERNS, any_match)} AS bp, {any_of('fr', packs.SOURCE_AUTOMATED)} AS auto, {_group('su', packs.SUBJECT_PATTERNS, any_match)} AS fs, {high} AS hi, {medium} AS me,
    regexp_matches(su, '^(re:|fwd:|fw:)') AS th, contains(tx, 'unsubscribe') AS un, [{", ".join(_SCORES.values())}] AS sc, contains(tg, 'important') AS imp, contains(tg, 'category_promotions') AS promo FROM f),
  h AS (SELECT *, list_max(sc) AS best, CASE WHEN list_max(sc) > 0 THEN {_NAMES}[list_position(sc, list_max(sc))] END AS dom FROM g)
  SELECT gmail_id, freq AS sender_frequency, coalesce(bp, CASE WHEN freq > 50 THEN 'Newsletter' WHEN freq = 1 THEN 'Personal' END, fs, 'Other') AS primary_category,
    coalesce(dom, CASE WHEN tx <> '' AND NOT imp AND promo THEN 'Shopping/Retail' END, 'Other') AS domain_category, CASE WHEN me THEN 'Medium' WHEN hi THEN 'High' ELSE 'Medium' END AS priority_level,
    CASE WHEN auto THEN 'Automated' WHEN bp IN ('Newsletter', 'Service_Notification') THEN 'Semi-automated' ELSE 'Human' END AS source_type,
    CASE WHEN tx <> '' AND imp THEN 'Reply_Needed' ELSE 'Read_Only' END AS action_required, th AS is_thread, un AS has_unsubscribe,
    round(least({hits('tx', packs.AUTOMATION_INDICATORS)} * 0.2::DOUBLE, 1.0::DOUBLE), 3) AS automated_score,
    round(least(1.0::DOUBLE,
      (CASE WHEN bp IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN auto THEN 0.3::DOUBLE WHEN bp IN ('Newsletter', 'Service_Notification') THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN freq > 50 THEN 0.4::DOUBLE WHEN freq = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) * 0.4::DOUBLE
      + (th::INT * 0.3::DOUBLE + (fs IS NOT NULL)::INT * 0.6::DOUBLE + hi::INT * 0.2::DOUBLE + me::INT * 0.2::DOUBLE) * 0.3::DOUBLE
      + CASE WHEN tx <> '' THEN (un::INT * 0.3::DOUBLE + CASE WHEN best > 0 THEN least(best * 0.1::DOUBLE, 0.5::DOUBLE) ELSE 0.0::DOUBLE END + CASE WHEN imp THEN 0.2::DOUBLE WHEN promo THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0.0::DOUBLE END * 0.3::DOUBLE), 6) AS confidence_score FROM h"""


_OUT = ["gmail_id", "sender_frequency", "primary_category", "domain_category", "priority_level", "source_type", "action_required", "is_thread", "has_unsubscribe", "automated_score", "confidence_score"]


@Q.add("three_signals_docs", _three(DOCS))
def three_signals_docs(spark, d):
    return rules.three_signals(docs_mail(spark, d)).select(*_OUT)


@Q.add("three_signals_events", _three(EVENTS))
def three_signals_events(spark, d):
    return rules.three_signals(events_mail(spark, d)).select(*_OUT)


@Q.add("domain_distribution", f"WITH t AS ({_three(DOCS)}) SELECT domain_category AS category, count(*) AS n, round(avg(confidence_score), 3) AS avg_confidence, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM t), 2) AS pct FROM t WHERE domain_category <> 'Other' GROUP BY 1")
def domain_distribution(spark, d):
    return store.category_shares(rules.three_signals(docs_mail(spark, d)), "domain_category", "confidence_score", skip="Other")


@Q.add("classification_quality", f"""WITH t AS ({_three(DOCS)}) SELECT count(*) AS total, count(*) FILTER (automated_score > 0.5) AS automated, count(*) FILTER (has_unsubscribe) AS unsubscribe, count(*) FILTER (is_thread) AS threads,
  round(count(*) FILTER (automated_score > 0.5) * 100.0::DOUBLE / count(*), 3) AS automated_pct, round(count(*) FILTER (has_unsubscribe) * 100.0::DOUBLE / count(*), 3) AS unsubscribe_pct, round(count(*) FILTER (is_thread) * 100.0::DOUBLE / count(*), 3) AS threads_pct FROM t""")
def classification_quality(spark, d):
    return store.quality_counts(rules.three_signals(docs_mail(spark, d)))


@Q.add("keyword_domain_score", f"WITH t AS (SELECT doc_id AS gmail_id, lower(coalesce(text, '')) AS tx FROM documents) SELECT gmail_id, " + ", ".join(f"CAST({s} AS BIGINT) AS s{i}" for i, s in enumerate(_SCORES.values())) + " FROM t")
def keyword_domain_score(spark, d):
    """Occurrences of each domain's keywords, not overlapping."""
    text = F.lower(F.coalesce("body", F.lit("")))
    count = lambda w: F.floor((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / F.lit(len(w)))
    return docs_mail(spark, d).select("gmail_id", *[sum((count(w) for w in words), F.lit(0)).cast("long").alias(f"s{i}") for i, words in enumerate(packs.DOMAIN_KEYWORDS.values())])


_NEWS_SIGNS = [any_of("s", packs.AI_KEYWORDS), any_of("f", packs.AI_KEYWORDS), any_of("f", packs.AI_DOMAINS), any_match("(s || ' ' || f)", packs.NEWSLETTER_PATTERNS), any_match("b", packs.UNSUBSCRIBE_PATTERNS), any_of("f", packs.NEWSLETTER_SENDERS)]
_NEWS = f"""{DOCS}, c AS (SELECT gmail_id, lower(coalesce(subject, '')) AS s, lower(coalesce(sender, '')) AS f, lower(coalesce(body, '')) AS b FROM mail),
  p AS (SELECT gmail_id, CAST({" + ".join(f"CASE WHEN {t} THEN {n} ELSE 0 END" for t, n in zip(_NEWS_SIGNS, packs.NEWSLETTER_POINTS))} AS INTEGER) AS newsletter_points, CAST({" + ".join(f"{t}::INT" for t in _NEWS_SIGNS)} AS INTEGER) AS reasons FROM c)"""


@Q.add("newsletter_score", f"{_NEWS} SELECT gmail_id, newsletter_points, reasons, newsletter_points >= 4 OR (newsletter_points >= 3 AND reasons >= 2) AS is_newsletter FROM p")
def newsletter_score(spark, d):
    out = rules.newsletter_score(docs_mail(spark, d))
    return out.select("gmail_id", "newsletter_points", F.size("newsletter_reasons").alias("reasons"), "is_newsletter")


@Q.add("newsletter_split", f"{_NEWS} SELECT newsletter_points >= 4 OR (newsletter_points >= 3 AND reasons >= 2) AS is_newsletter, count(*) AS n FROM p GROUP BY 1")
def newsletter_split(spark, d):
    return rules.newsletter_score(docs_mail(spark, d)).groupBy("is_newsletter").agg(F.count("*").alias("n"))


@Q.add("simple_categories", f"{EVENTS}, t AS (SELECT lower(coalesce(subject, '') || ' ' || coalesce(sender, '')) AS t FROM mail) SELECT {case([(any_of('t', w), q(n)) for n, w in packs.CLI_CATEGORIES], q('Other'))} AS simple_category, count(*) AS n FROM t GROUP BY 1")
def simple_categories(spark, d):
    return rules.simple_category(events_mail(spark, d)).groupBy("simple_category").agg(F.count("*").alias("n"))


@Q.add("email_types", """WITH p AS (SELECT page_id AS gmail_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS f, coalesce(html, '') AS h FROM pages),
  t AS (SELECT *, len(regexp_extract_all(h, '(?i)<table\\b')) AS tb, len(regexp_extract_all(h, '(?i)<img\\b')) AS im, len(regexp_extract_all(h, '(?i)<div\\b')) AS dv FROM p)
  SELECT gmail_id, CASE WHEN contains(f, 'newsletter') OR contains(f, 'news') OR contains(f, 'digest') THEN 'newsletter' WHEN contains(f, 'noreply') OR contains(f, 'no-reply') OR contains(f, 'notification') THEN 'notification'
    WHEN tb > 0 AND im > 3 THEN 'marketing' WHEN (tb = 0 AND dv = 0) OR length(h) < 1000 THEN 'simple' ELSE 'complex' END AS email_type FROM t""")
def email_types(spark, d):
    return rules.email_type(html_mail(spark, d)).select("gmail_id", "email_type")


_QUERIES = {"user": "is:unread older_than:30d", "assistant": "is:read", "system": "subject:receipt"}


@Q.add("query_risk", "WITH q AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'is:unread older_than:30d' WHEN 'assistant' THEN 'is:read' WHEN 'system' THEN 'subject:receipt' END AS query FROM conversations) SELECT conv_id, turn, CASE WHEN query = 'is:read' THEN 'HIGH' WHEN query LIKE 'is:unread%' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM q")
def query_risk(spark, d):
    """A log of mailbox queries, one for each turn of a conversation."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    query = F.lit(None)
    for role, text in _QUERIES.items():
        query = F.when(F.col("role") == role, text).otherwise(query)
    return rules.query_risk(c.select("conv_id", "turn", query.alias("query"))).select("conv_id", "turn", "risk_level")


@Q.add("classifier_evaluation", """WITH p AS (SELECT l.toxic, contains(lower(d.text), 'worthless') OR contains(lower(d.text), 'trash') OR contains(lower(d.text), 'disgusting') AS said FROM documents d JOIN labels l USING (doc_id))
  SELECT count(*) AS total, count(*) FILTER (said AND toxic = 1) AS tp, count(*) FILTER (said AND toxic = 0) AS fp, count(*) FILTER (NOT said AND toxic = 1) AS fn FROM p""")
def classifier_evaluation(spark, d):
    """A keyword rule against the labels: counts for precision and recall."""
    rule = [rules.Rule("Abuse", 1, ("worthless", "trash", "disgusting"))]
    said = rules.classify(docs_mail(spark, d).withColumn("subject", F.lit("")), rule).select(F.col("gmail_id").alias("doc_id"), (F.col("category") == "Abuse").alias("said"))
    j = said.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return j.agg(F.count("*").alias("total"), F.count_if(F.col("said") & (F.col("toxic") == 1)).alias("tp"), F.count_if(F.col("said") & (F.col("toxic") == 0)).alias("fp"), F.count_if(~F.col("said") & (F.col("toxic") == 1)).alias("fn"))


_SHARE = "round(n * 100.0::DOUBLE / {whole}, 1)"
_DONE = "(SELECT count(primary_category) FROM t)"


@Q.add("classification_report", f"""WITH t AS ({_three(EVENTS).replace("SELECT gmail_id, freq AS sender_frequency", "SELECT sender, gmail_id, freq AS sender_frequency")}), w AS (SELECT count(*) AS total, count(primary_category) AS done, round(avg(confidence_score), 3) AS mean, count(*) FILTER (automated_score > 0.5) AS a, count(*) FILTER (has_unsubscribe) AS u, count(*) FILTER (is_thread) AS th FROM t),
  r AS (SELECT 'overview' AS section, 'total_emails' AS name, NULL AS detail, total AS n, {_SHARE.format(whole="total").replace("n *", "total *")} AS pct, mean AS avg_confidence FROM w UNION ALL SELECT 'overview', 'classified_emails', NULL, done, round(done * 100.0::DOUBLE / total, 1), NULL FROM w
    UNION ALL SELECT 'quality_metrics', 'automated', NULL, a, round(a * 100.0::DOUBLE / total, 1), NULL FROM w UNION ALL SELECT 'quality_metrics', 'unsubscribe', NULL, u, round(u * 100.0::DOUBLE / total, 1), NULL FROM w UNION ALL SELECT 'quality_metrics', 'threads', NULL, th, round(th * 100.0::DOUBLE / total, 1), NULL FROM w
    UNION ALL SELECT 'primary_categories', primary_category, NULL, count(*), round(count(*) * 100.0::DOUBLE / {_DONE}, 1), round(avg(confidence_score), 3) FROM t GROUP BY primary_category
    UNION ALL SELECT 'domain_categories', domain_category, NULL, count(*), round(count(*) * 100.0::DOUBLE / {_DONE}, 1), round(avg(confidence_score), 3) FROM t WHERE domain_category <> 'Other' GROUP BY domain_category
    UNION ALL SELECT 'confidence_analysis', CASE WHEN confidence_score >= 0.8 THEN 'High (0.8+)' WHEN confidence_score >= 0.6 THEN 'Medium (0.6-0.8)' WHEN confidence_score >= 0.4 THEN 'Low (0.4-0.6)' ELSE 'Very Low (<0.4)' END AS b, NULL, count(*), round(count(*) * 100.0::DOUBLE / {_DONE}, 1), NULL FROM t GROUP BY b
    UNION ALL SELECT 'sender_analysis', primary_category, CASE WHEN length(sender) > 50 THEN left(sender, 50) || '...' ELSE sender END, n, NULL, NULL FROM (SELECT primary_category, sender, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY primary_category ORDER BY n DESC, sender) <= 5)
  SELECT section, name, detail, n, pct, avg_confidence FROM r""")
def classification_report(spark, d):
    return reports.classification_report(rules.three_signals(events_mail(spark, d)))


@Q.add("database_info", f"""{EVENTS} SELECT 'total' AS section, 'emails' AS name, count(*) AS n, min(date_received) AS first_mail, max(date_received) AS last_mail FROM mail
  UNION ALL SELECT 'top_senders', sender, n, NULL, NULL FROM (SELECT sender, count(*) AS n FROM mail GROUP BY 1 ORDER BY n DESC, sender LIMIT 10) UNION ALL SELECT 'monthly_distribution', strftime(date_received, '%Y-%m'), count(*), NULL, NULL FROM mail GROUP BY 2""")
def database_info(spark, d):
    return reports.database_info(events_mail(spark, d))


@Q.add("store_stats", """WITH m AS (SELECT CASE WHEN event_id % 11 <> 0 THEN event_id - event_id % 3 END AS id, ts, CASE WHEN event_id % 7 = 0 THEN ts END AS deleted_at FROM events), d AS (SELECT count(*) AS n FROM m WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
  SELECT count(*) AS total_emails, count(DISTINCT id) AS unique_ids, count(deleted_at) AS soft_deleted, (SELECT count(*) FROM d) AS duplicate_groups, (SELECT CAST(sum(n - 1) AS BIGINT) FROM d) AS total_duplicates, min(ts) FILTER (deleted_at IS NULL) AS first_mail, max(ts) FILTER (deleted_at IS NULL) AS last_mail FROM m""")
def store_stats(spark, d):
    """Events as mail, three to an id, some without an id, some deleted."""
    k = F.col("gmail_id")
    m = events_mail(spark, d).withColumns({"deleted_at": F.when(k % 7 == 0, F.col("date_received")), "gmail_id": F.when(k % 11 != 0, k - k % 3)})
    return reports.store_stats(m)
