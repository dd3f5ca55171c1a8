"""Queries of quality, volume, sender and content profiles."""

from pyspark.sql import functions as F

from lettermill.functions import packs
from lettermill.operators import content, quality, rules, senders, temporal
from lettermill.plans.registry import Registry
from lettermill.plans.sqlparts import any_of, classified, q
from lettermill.plans.views import SQL_DOCS, SQL_EVENTS, docs_mail, events_mail

Q = Registry()
EVENTS, DOCS = f"WITH {SQL_EVENTS}", f"WITH {SQL_DOCS}"
CLASSIFIED = f"{EVENTS}, {classified()}"
CLASSIFIED_DOCS = f"{DOCS}, {classified()}"


def as_text(df, *dates):
    """Dates as text, alike in every engine."""
    return df.withColumns({c: F.col(c).cast("string") for c in dates})


def classified_events(spark, d):
    return rules.classify(events_mail(spark, d))


def classified_docs(spark, d):
    return rules.classify(docs_mail(spark, d))


@Q.add("category_summary", f"""{CLASSIFIED} SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM classified), 3) AS pct, round(avg(confidence), 3) AS mean_confidence FROM classified GROUP BY category""")
def category_summary(spark, d):
    """The flagship: quality gate, rule classification, summary by category, in one scan."""
    mail = events_mail(spark, d).select("gmail_id", "date_received", "subject", "sender", "body")
    summary = lambda rows: rows.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    out = quality.gated_report(mail, rules.classify, ["category", "confidence"], summary)
    return senders.with_share(out).select("category", "n", "pct", "mean_confidence")


@Q.add("category_summary_docs", f"""{CLASSIFIED_DOCS} SELECT category, count(*) AS n, round(avg(confidence), 3) AS mean_confidence FROM classified GROUP BY category""")
def category_summary_docs(spark, d):
    return classified_docs(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


_CUSTOM = classified(rules=rules.rule_pack(custom=packs.CUSTOM_RULES), cap=False)


@Q.add("category_custom_uncapped", f"""{DOCS}, {_CUSTOM} SELECT category, count(*) AS n, round(avg(confidence), 3) AS mean_confidence FROM classified GROUP BY category""")
def category_custom_uncapped(spark, d):
    """Custom categories added to the base rules, and confidence without the cap."""
    out = rules.classify(docs_mail(spark, d), rules.rule_pack(custom=packs.CUSTOM_RULES), cap=False)
    return out.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


_FIELDS = ["gmail_id", "date_received", "sender", "subject", "body"]


@Q.add("quality_completeness", EVENTS + ", c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) - count({f}) AS missing, count(*) AS total FROM mail" for f in _FIELDS) + ") SELECT field, missing, total, round((total - missing) * 100.0::DOUBLE / total, 3) AS completeness FROM (SELECT * FROM c UNION ALL SELECT '*', CAST(sum(missing) AS BIGINT), CAST(sum(total) AS BIGINT) FROM c)")
def quality_completeness(spark, d):
    return quality.completeness(events_mail(spark, d), _FIELDS)


@Q.add("id_uniqueness", "SELECT count(*) AS total, count(DISTINCT text) AS distinct_ids, count(*) - count(DISTINCT text) AS duplicates, round(count(DISTINCT text) * 100.0::DOUBLE / count(*), 3) AS uniqueness_rate FROM documents")
def id_uniqueness(spark, d):
    """Texts stand in for ids, since they do repeat."""
    return quality.uniqueness(docs_mail(spark, d), "body")


@Q.add("validity_metrics", f"""{EVENTS} SELECT count(date_received) AS valid_dates, min(date_received) AS min_date, max(date_received) AS max_date,
  CAST(floor((epoch_us(max(date_received)) - epoch_us(min(date_received))) / 86400000000) AS BIGINT) AS span_days,
  count(*) FILTER (regexp_matches(regexp_extract(sender, '[\\w\\.-]+@[\\w\\.-]+\\.\\w+'), {q(packs.VALID_ADDRESS)})) AS valid_emails,
  count(*) FILTER (NOT regexp_matches(regexp_extract(sender, '[\\w\\.-]+@[\\w\\.-]+\\.\\w+'), {q(packs.VALID_ADDRESS)})) AS invalid_emails,
  round(count(*) FILTER (regexp_matches(regexp_extract(sender, '[\\w\\.-]+@[\\w\\.-]+\\.\\w+'), {q(packs.VALID_ADDRESS)})) * 100.0::DOUBLE / count(*), 3) AS email_validity FROM mail""")
def validity_metrics(spark, d):
    return quality.validity(events_mail(spark, d))


@Q.add("quality_gates", "SELECT 'duplicate_ids' AS issue, 'body' AS field, (count(*) - count(DISTINCT text))::DOUBLE AS measured FROM documents HAVING count(*) > count(DISTINCT text)")
def quality_gates(spark, d):
    return quality.gate_issues(docs_mail(spark, d), key="body")


_DAILY = f"{EVENTS}, daily AS (SELECT CAST(date_received AS DATE) AS day, count(*) AS volume FROM mail GROUP BY 1)"


@Q.add("daily_volume", f"{_DAILY} SELECT CAST(day AS VARCHAR) AS day, volume FROM daily")
def daily_volume(spark, d):
    return as_text(temporal.day_volume(events_mail(spark, d)), "day")


@Q.add("daily_volume_stats", f"""{_DAILY} SELECT count(*) AS total_days, CAST(sum(volume) AS BIGINT) AS total, round(avg(volume), 3) AS mean_volume, round(median(volume), 3) AS median_volume,
  round(stddev_samp(volume), 3) AS std_volume, (SELECT CAST(day AS VARCHAR) FROM daily ORDER BY volume DESC, day LIMIT 1) AS busiest_day, (SELECT CAST(day AS VARCHAR) FROM daily ORDER BY volume, day LIMIT 1) AS quietest_day,
  round(stddev_samp(volume) / avg(volume), 3) AS volatility FROM daily""")
def daily_volume_stats(spark, d):
    return as_text(temporal.volume_stats(temporal.day_volume(events_mail(spark, d))), "busiest_day", "quietest_day")


@Q.add("peak_days_centered7", f"""{_DAILY}, r AS (SELECT day, volume, avg(volume) OVER w AS m, stddev_samp(volume) OVER w AS s, count(*) OVER w AS n FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
  SELECT CAST(day AS VARCHAR) AS day, volume, round(m, 3) AS rolling_mean, round(s, 3) AS rolling_std FROM r WHERE n = 7 AND volume > m + 1.2 * s""")
def peak_days_centered7(spark, d):
    """1.2 deviations, since a centred window of seven holds its own peak down."""
    return as_text(temporal.peak_days(temporal.day_volume(events_mail(spark, d)), 7, 1.2), "day")


for _part, _sql in (("hour", "CAST(hour(date_received) AS INTEGER)"), ("weekday", "CAST(isodow(date_received) - 1 AS INTEGER)"), ("day_name", "dayname(date_received)")):
    Q.add(f"{_part}_distribution", f"{EVENTS} SELECT {_sql} AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM mail), 3) AS pct FROM mail GROUP BY 1")(
        lambda spark, d, part=_part: temporal.distribution(events_mail(spark, d), part))


@Q.add("category_gini", f"""{CLASSIFIED}, x AS (SELECT category, CAST(date_received AS DATE) AS day, count(*) AS x FROM classified GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY x, day) AS i FROM x)
  SELECT category, count(*) AS days, round(CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE 2 * sum(i * x)::DOUBLE / (count(*) * sum(x)::DOUBLE) - (count(*) + 1) / count(*)::DOUBLE END, 6) AS gini FROM r GROUP BY category""")
def category_gini(spark, d):
    return temporal.concentration(classified_events(spark, d))


@Q.add("category_temporal_profile", f"""{CLASSIFIED}, h AS (SELECT category, hour(date_received) AS v, count(*) AS n FROM classified GROUP BY 1, 2), hr AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, v) AS r FROM h),
  t AS (SELECT category, CAST(date_received AS DATE) AS v, count(*) AS n FROM classified GROUP BY 1, 2), tr AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, v) AS r FROM t)
  SELECT category, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(DISTINCT CAST(date_received AS DATE)) FROM mail), 3) AS per_day,
    (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY r) FROM hr WHERE r <= 3 AND hr.category = c.category) AS top_hours,
    (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY r) FROM tr WHERE r <= 3 AND tr.category = c.category) AS top_days FROM classified c GROUP BY category""")
def category_temporal_profile(spark, d):
    return temporal.category_profile(classified_events(spark, d))


@Q.add("sender_top20", f"{EVENTS} SELECT sender, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM mail), 3) AS pct FROM mail GROUP BY sender ORDER BY n DESC, sender LIMIT 20")
def sender_top20(spark, d):
    return senders.top_senders(events_mail(spark, d), 20)


@Q.add("sender_profile", f"""{CLASSIFIED}, c AS (SELECT sender, category, count(*) AS c FROM classified GROUP BY 1, 2), k AS (SELECT sender, string_agg(category || ':' || c, ',' ORDER BY category) AS categories FROM c GROUP BY 1)
  SELECT sender, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM mail), 3) AS pct, any_value(categories) AS categories, CAST(floor(sum(length(body)) / count(*)) AS BIGINT) AS avg_length,
    min(date_received) AS first_mail, max(date_received) AS last_mail, bool_or(is_automated) AS is_automated, round(count(*)::DOUBLE / count(DISTINCT CAST(date_received AS DATE)), 3) AS per_active_day
  FROM classified JOIN k USING (sender) GROUP BY sender ORDER BY n DESC, sender LIMIT 50""")
def sender_profile(spark, d):
    return senders.sender_profile(classified_events(spark, d), 50)


@Q.add("sender_totals", f"{EVENTS} SELECT count(DISTINCT sender) AS unique_senders, count(*) AS total, round(count(*)::DOUBLE / count(DISTINCT sender), 3) AS mean_per_sender FROM mail")
def sender_totals(spark, d):
    return senders.sender_totals(events_mail(spark, d))


@Q.add("automation_by_category", f"{CLASSIFIED} SELECT category, count(*) AS n, count(*) FILTER (is_automated) AS automated, round(avg(is_automated::INT), 6) AS rate FROM classified GROUP BY category")
def automation_by_category(spark, d):
    return senders.automation(classified_events(spark, d))


_DOMAINS = ", dom AS (SELECT nullif(regexp_extract(sender, '@([^>\\s]+)', 1), '') AS domain, count(*) AS n FROM mail GROUP BY 1)"


@Q.add("domain_top20", f"{DOCS}{_DOMAINS} SELECT domain, n, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM dom), 3) AS pct FROM dom WHERE domain IS NOT NULL ORDER BY n DESC, domain LIMIT 20")
def domain_top20(spark, d):
    return senders.top_domains(docs_mail(spark, d), 20)


@Q.add("domain_type_split", f"""{EVENTS}{_DOMAINS} SELECT CASE WHEN lower(domain) IN ({", ".join(map(q, packs.PERSONAL_HOSTS))}) THEN 'personal' WHEN {any_of('lower(domain)', packs.SERVICE_WORDS)} THEN 'service' ELSE 'corporate' END AS kind, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT * FROM dom WHERE domain IS NOT NULL ORDER BY n DESC, domain LIMIT 20) GROUP BY 1""")
def domain_type_split(spark, d):
    return senders.domain_kinds(events_mail(spark, d), 20)


_DIVERSITY = """, c AS (SELECT {key} AS k, count(*)::DOUBLE AS n FROM mail WHERE {key} IS NOT NULL GROUP BY 1), p AS (SELECT k, n, n / (SELECT sum(n) FROM c) AS p FROM c)
  SELECT count(*) AS distinct_keys, round(sum(-p * ln(p + 1e-10)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson, round(exp(sum(-p * ln(p + 1e-10))), 3) AS effective,
    round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, k LIMIT 10)) / sum(n), 6) AS top_10_share FROM p"""


@Q.add("sender_diversity", EVENTS + _DIVERSITY.format(key="sender"))
def sender_diversity(spark, d):
    return senders.diversity(events_mail(spark, d), F.col("sender"))


@Q.add("domain_diversity", DOCS + _DIVERSITY.format(key="nullif(regexp_extract(sender, '@([^>\\s]+)', 1), '')"))
def domain_diversity(spark, d):
    return senders.diversity(docs_mail(spark, d), senders.domain(F.col("sender")))


@Q.add("length_percentiles", "SELECT count(*) AS n, round(avg(l), 3) AS mean, round(stddev_samp(l), 3) AS std, min(l) AS least, max(l) AS most, " + ", ".join(f"CAST(floor(quantile_cont(l, {p})) AS BIGINT) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM (SELECT CAST(coalesce(length(text), 0) AS INTEGER) AS l FROM documents)")
def length_percentiles(spark, d):
    return content.length_stats(docs_mail(spark, d))


_BUCKET = "CASE " + " ".join(f"WHEN l <= {e} THEN '{n}'" for e, n in zip(packs.LENGTH_EDGES[1:], packs.LENGTH_LABELS, strict=False)) + f" ELSE '{packs.LENGTH_LABELS[-1]}' END"


@Q.add("length_buckets", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM (SELECT coalesce(length(text), 0) AS l FROM documents) GROUP BY 1")
def length_buckets(spark, d):
    return content.length_buckets(docs_mail(spark, d))


@Q.add("category_lengths", f"{CLASSIFIED_DOCS} SELECT category, count(*) AS n, round(avg(length(body)), 1) AS mean, round(median(length(body)), 1) AS median, round(stddev_samp(length(body)), 1) AS std FROM classified GROUP BY category")
def category_lengths(spark, d):
    return content.category_lengths(classified_docs(spark, d))


@Q.add("content_patterns", f"""SELECT count(*) FILTER (u > 0) AS with_urls, round(avg(u), 3) AS mean_urls, CAST(max(u) AS INTEGER) AS most_urls, count(*) FILTER (s) AS signed, round(avg(s::INT) * 100, 1) AS signature_rate, round(avg(w), 3) AS mean_words, CAST(max(w) AS INTEGER) AS most_words
  FROM (SELECT len(regexp_extract_all(text, {q(packs.URL_PATTERN)})) AS u, {any_of('lower(text)', packs.SIGNATURES)} AS s, len(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+')) AS w FROM (SELECT coalesce(text, '') AS text FROM documents))""")
def content_patterns(spark, d):
    return content.patterns(docs_mail(spark, d))


@Q.add("subject_analysis", f"""{DOCS}, s AS (SELECT coalesce(subject, '') AS s FROM mail) SELECT count(*) AS total, count(DISTINCT s) AS distinct_subjects, round(avg(length(s)), 3) AS mean_length, CAST(max(length(s)) AS INTEGER) AS longest,
  count(*) FILTER (regexp_matches(s, '(?i)^(re:|fwd:|fw:)')) AS replies, round(count(*) FILTER (regexp_matches(s, '(?i)^(re:|fwd:|fw:)')) * 100.0::DOUBLE / count(*), 3) AS reply_rate, round(count(DISTINCT s)::DOUBLE / count(*), 6) AS diversity FROM s""")
def subject_analysis(spark, d):
    return content.subjects(docs_mail(spark, d))


@Q.add("subject_top10", f"{DOCS} SELECT coalesce(subject, '') AS subject, count(*) AS n FROM mail GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def subject_top10(spark, d):
    return content.top_subjects(docs_mail(spark, d))


@Q.add("english_score", "SELECT count(*) AS mails, round(avg((" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in packs.ENGLISH_WORDS) + ") / 8.0::DOUBLE) * 100, 3) AS english_pct FROM documents")
def english_score(spark, d):
    return content.english_score(docs_mail(spark, d))
