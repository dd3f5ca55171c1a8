"""Queries of the way in and out: messages written and read again, snapshots, history, deletions, checkpoints."""

from pyspark.sql import functions as F

from lettermill.functions import markup, text
from lettermill.operators import chunks, ledger, search, store
from lettermill.plans.registry import Registry
from lettermill.plans.scratch import shared_folder
from lettermill.plans.views import SQL_DOCS, SQL_EVENTS, docs_mail, events_mail
from lettermill.schema import from_loose_json
from lettermill.sources import readers, writers
from lettermill.sources.pages import read_pages, stream_pages
from lettermill.sources.snapshots import DeadLetterStore, MailStore, Migration
from lettermill.streaming import mail_stream

Q = Registry()
EVENTS, DOCS = f"WITH {SQL_EVENTS}", f"WITH {SQL_DOCS}"


def _ids(mail):
    return mail.withColumn("gmail_id", F.col("gmail_id").cast("string"))


def _spread(mail):
    """Small tables are one partition; messages are parsed in Python, so mail is dealt to all cores, as files are. Dealt before messages are made of it, it is smaller."""
    return mail.repartition(4 * mail.sparkSession.sparkContext.defaultParallelism, "gmail_id")


# Messages written and read again


@Q.add("eml_round_trip", f"{DOCS} SELECT gmail_id::VARCHAR AS gmail_id, sender, sha256(coalesce(body, '') || chr(13) || chr(10)) AS digest, false AS has_attachments FROM mail")
def eml_round_trip(spark, d):
    mail = _spread(docs_mail(spark, d)).withColumns({"to": F.lit("me@example.org"), "body_html": F.lit(None).cast("string"), "date_received": F.expr("timestamp_ntz'2024-01-02 03:04:05'")})
    files = mail.select(F.concat(F.col("gmail_id").cast("string"), F.lit(".eml")).alias("path"), writers.eml_text().cast("binary").alias("content"))
    return readers.parse_eml(files).select("gmail_id", "sender", F.sha2("body", 256).alias("digest"), "has_attachments")


@Q.add("eml_dates", f"{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, sender, subject, date_trunc('second', date_received) AS date_received FROM mail")
def eml_dates(spark, d):
    mail = _spread(events_mail(spark, d)).withColumns({"to": F.lit("me@example.org"), "body_html": F.lit("<p>page</p>")})
    files = mail.select(F.concat(F.lit("box/"), F.col("gmail_id").cast("string"), F.lit(".eml")).alias("path"), writers.eml_text().cast("binary").alias("content"))
    return readers.parse_eml(files).select("gmail_id", "sender", "subject", "date_received")


@Q.add("buried_headers", f"{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, sender, subject, 'body ' || gmail_id AS body FROM mail")
def buried_headers(spark, d):
    e = _spread(events_mail(spark, d))
    raw = F.concat(F.lit("+OK 512 octets\nreceived by relay\n\nFrom: nobody@x\nFrom: "), "sender", F.lit("\nSubject:\n "), "subject", F.lit("\nX-Gmail-ID: "), F.col("gmail_id").cast("string"), F.lit("\n\nbody "), F.col("gmail_id").cast("string"))
    files = e.select(F.concat(F.col("gmail_id").cast("string"), F.lit(".eml")).alias("path"), raw.cast("binary").alias("content"))
    return readers.parse_eml(files).select("gmail_id", "sender", F.trim("subject").alias("subject"), F.trim("body").alias("body"))


@Q.add("buried_headers_and_quotes", f"{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, sender, subject, 'my answer ' || gmail_id || chr(10) || chr(10) || 'From: old@x' || chr(10) || 'Subject: old' || chr(10) || 'X-Gmail-ID: 0' || chr(10) || chr(10) || 'quoted ' || subject AS body FROM mail")
def buried_headers_and_quotes(spark, d):
    """Buried headers before a body that quotes another mail with its headers."""
    e = _spread(events_mail(spark, d))
    head = F.concat(F.lit("+OK 5\nX-Relay: a\n\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nFrom: "), "sender", F.lit("\nSubject: "), "subject", F.lit("\nX-Gmail-ID: "), F.col("gmail_id").cast("string"), F.lit("\n\nContent-Type: text/plain; charset=utf-8\n\n"))
    raw = F.concat(head, F.lit("my answer "), F.col("gmail_id").cast("string"), F.lit("\n\nFrom: old@x\nSubject: old\nX-Gmail-ID: 0\n\nquoted "), "subject")
    files = e.select(F.concat(F.col("gmail_id").cast("string"), F.lit(".eml")).alias("path"), raw.cast("binary").alias("content"))
    return readers.parse_eml(files).select("gmail_id", "sender", "subject", "body")


@Q.add("markdown_round_trip", f"{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, sender, subject, body FROM mail")
def markdown_round_trip(spark, d):
    mail = events_mail(spark, d).withColumn("to", F.lit(None).cast("string"))
    files = mail.select(writers.markdown_text().alias("value"), F.concat(F.col("gmail_id").cast("string"), F.lit(".md")).alias("source_file"))
    return readers.parse_markdown(files).select("gmail_id", "sender", "subject", "body")


@Q.add("json_round_trip", f"{EVENTS} SELECT strftime(date_received, '%Y-%m') AS year_month, count(*) AS n, CAST(sum(gmail_id) AS BIGINT) AS ids, count(DISTINCT sender) AS senders FROM mail GROUP BY 1")
def json_round_trip(spark, d):
    folder = shared_folder(spark, "monthly")
    writers.write_monthly_json(events_mail(spark, d), folder)
    back = readers.to_mail(spark.read.json(folder).drop("value").withColumn("year_month", F.col("year_month").cast("string")))
    return back.groupBy("year_month").agg(F.count("*").alias("n"), F.sum(F.col("gmail_id").cast("long")).alias("ids"), F.countDistinct("sender").alias("senders"))


@Q.add("monthly_envelopes", f"{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, sender, subject, date_received FROM mail WHERE day(date_received) % 2 = 0")
def monthly_envelopes(spark, d):
    folder = shared_folder(spark, "envelopes")
    # The table has one month, so that days stand for months here.
    e = events_mail(spark, d).withColumn("year_month", F.date_format("date_received", "yyyy-MM-dd"))
    one = F.struct(F.col("gmail_id").cast("string").alias("gmail_id"), "sender", "subject", F.col("date_received").cast("string").alias("date"))
    e.groupBy("year_month", F.pmod("gmail_id", F.lit(50)).alias("part")).agg(F.collect_list(one).alias("emails")).drop("part").write.json(folder)
    done = e.where("day(date_received) % 2 = 1").select("year_month").distinct()
    files = spark.read.schema("year_month string, emails array<struct<gmail_id:string,sender:string,subject:string,date:string>>").json(folder)
    return readers.mail_of_envelopes(files, done).select("gmail_id", "sender", "subject", "date_received")


@Q.add("partitioned_export", f"{EVENTS} SELECT strftime(date_received, '%Y-%m') AS year_month, count(*) AS n FROM mail GROUP BY 1")
def partitioned_export(spark, d):
    return writers.write_partitioned(events_mail(spark, d), shared_folder(spark, "export")).select(F.col("year_month").cast("string").alias("year_month"), "n")


@Q.add("export_by_domain", f"{EVENTS} SELECT subject || '.example.com' AS sender_domain, count(*) AS n FROM mail GROUP BY 1")
def export_by_domain(spark, d):
    return writers.write_partitioned(events_mail(spark, d), shared_folder(spark, "export"), by="sender_domain")


@Q.add("analysis_file", f"{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, sender, subject, '' AS plain_text_content FROM mail")
def analysis_file(spark, d):
    path = f"{shared_folder(spark, 'analysis')}.csv"
    events_mail(spark, d).select("gmail_id", "sender", "subject", F.col("date_received").cast("string").alias("date_received")).write.option("header", True).csv(path)
    return readers.read_analysis_file(spark, path).select("gmail_id", "sender", "subject", "plain_text_content")


@Q.add("newsletter_csv", f"{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, sender, subject, body FROM mail")
def newsletter_csv(spark, d):
    path = f"{shared_folder(spark, 'letters')}.csv"
    events_mail(spark, d).select(F.col("gmail_id").alias("id"), F.col("sender").alias("from"), "subject", F.col("body").alias("body_plain")).write.option("header", True).option("escape", '"').csv(path)
    return readers.read_newsletters(spark, path).select("gmail_id", "sender", "subject", "body")


@Q.add("parquet_ids", "SELECT event_id AS gmail_id FROM events WHERE event_id % 10 <> 0")
def parquet_ids(spark, d):
    path = shared_folder(spark, "ids")
    events_mail(spark, d).select(F.when(F.col("gmail_id") % 10 != 0, F.col("gmail_id")).alias("gmail_id"), "subject").write.parquet(path)
    return readers.read_ids(spark, path)


@Q.add("api_messages", f"{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, sender, subject, date_trunc('second', date_received) AS date_received, 2 AS recipients FROM mail")
def api_messages(spark, d):
    e = events_mail(spark, d)
    head = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    heads = F.array(head("From", F.concat(F.lit("A B <"), "sender", F.lit(">"))), head("Subject", F.lit("old")), head("subject", F.col("subject")), head("To", F.lit("x@y.z, Q <q@r.s>")))
    ms = F.unix_seconds(F.col("date_received").cast("timestamp")) * 1000
    api = e.select(F.col("gmail_id").cast("string").alias("id"), F.lit("t").alias("threadId"), F.col("labels").alias("labelIds"), F.lit("").alias("snippet"), F.struct(heads.alias("headers")).alias("payload"), F.lit(1).alias("sizeEstimate"), ms.cast("string").alias("internalDate"))
    return readers.from_api_messages(api).select("gmail_id", "sender", "subject", "date_received", F.size("recipients").alias("recipients"))


@Q.add("output_folders", f"{EVENTS} SELECT strftime(date_received, '%Y/%m') AS folder, count(*) AS n, CAST(sum(length(sender)) AS BIGINT) AS chars FROM mail GROUP BY 1")
def output_folders(spark, d):
    out = writers.Outputs()
    out.register("from", lambda df: F.col("sender"))
    return out.generate(events_mail(spark, d), "from").groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@Q.add("mbox_lines", f"{EVENTS} SELECT gmail_id, 'From ' || sender AS first_line, '>From here' AS quoted FROM mail")
def mbox_lines(spark, d):
    m = events_mail(spark, d).withColumns({"to": F.lit("a@b"), "body_html": F.lit(None).cast("string"), "body": F.lit("hello\nFrom here")})
    lines = F.split(writers.mbox_text(), "\n")
    return m.select("gmail_id", F.get(lines, F.lit(0)).alias("first_line"), F.get(F.filter(lines, lambda x: x.startswith(">From")), F.lit(0)).alias("quoted"))


@Q.add("manifest_round_trip", "SELECT page_id::VARCHAR AS path, sha256(html) AS sha256, strlen(html) AS size FROM pages")
def manifest_round_trip(spark, d):
    path = shared_folder(spark, "manifest")
    files = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))
    writers.write_manifest(files, path)
    return spark.read.schema("path string, sha256 string, size long").option("sep", "\t").csv(path)


@Q.add("base64_bodies", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def base64_bodies(spark, d):
    coded = F.rtrim(F.translate(F.base64(F.coalesce("text", F.lit("")).cast("binary")), "+/\r\n", "-_"), F.lit("="))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(readers.decode_base64url(coded), 256).alias("digest"))


@Q.add("loose_records", """SELECT event_id::VARCHAR AS gmail_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'user' || user_id || '@x.org' END AS sender, event_type AS subject, CASE event_id % 4 WHEN 0 THEN event_type || ',UNREAD' WHEN 3 THEN '' ELSE event_type END AS labels,
  date_trunc('millisecond', ts) AS date_received FROM events""")
def loose_records(spark, d):
    """Ids as numbers and texts, labels as lists and texts, dates as milliseconds and texts, senders under two names, all in one file; every fifth line is broken besides."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k, q = F.col("event_id"), lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    sender = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@x.org"))
    parts = F.concat_ws(
        ", ", F.concat(F.lit('"id": '), F.when(k % 2 == 0, k.cast("string")).otherwise(q(k.cast("string")))), F.concat(F.lit('"subject": '), q(F.col("event_type"))),
        F.when(k % 3 == 0, F.concat(F.lit('"from": '), q(sender))).when(k % 3 == 1, F.concat(F.lit('"from": "", "sender": '), q(sender))),
        F.concat(F.lit('"labels": '), F.when(k % 4 == 0, q(F.concat("event_type", F.lit(" , UNREAD")))).when(k % 4 == 1, q(F.col("event_type"))).when(k % 4 == 2, F.to_json(F.array("event_type"))).otherwise("[]")),
        F.concat(F.lit('"date": '), F.when(k % 5 < 2, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise(q(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")))))
    lines = e.select(F.concat(F.lit("{"), parts, F.lit("}")).alias("value")).unionByName(e.where("event_id % 5 = 0").select(F.concat(F.lit('{"id": '), k.cast("string")).alias("value")))
    return from_loose_json(lines).select("gmail_id", "sender", "subject", F.array_join("labels", ",").alias("labels"), "date_received")


@Q.add("paged_ids", "SELECT event_id::VARCHAR AS id, 't' || user_id AS thread_id, 1 AS times FROM events")
def paged_ids(spark, d):
    """Ids written as pages; half of them are streamed, then, from the same checkpoint, the rest: none is lost or comes twice."""
    folder = shared_folder(spark, "pages")
    e = spark.read.parquet(f"{d}/events.parquet")
    one = F.struct(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("threadId"))
    pages = e.groupBy(F.floor(F.col("event_id") / 500).alias("page")).agg(F.collect_list(one).alias("messages"))
    for half in (0, 1):
        pages.where(F.pmod("page", F.lit(2)) == half).select("messages").write.mode("append").json(f"{folder}/in/{half}")
        mail_stream.write_available(stream_pages(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{folder}/out").select("id", "thread_id").unionByName(read_pages(spark, f"{folder}/in").select("id", "thread_id"))
    return got.groupBy("id", "thread_id").agg((F.count("*") / 2).cast("int").alias("times"))


@Q.add("store_migrations", f"""{EVENTS} SELECT gmail_id::VARCHAR AS gmail_id, CASE WHEN gmail_id % 10 = 0 THEN 'late' ELSE subject END AS title, 5 + length(CASE WHEN gmail_id % 10 = 0 THEN 'late' ELSE subject END) AS title_length, 2 AS applied FROM mail""")
def store_migrations(spark, d):
    """Two migrations, mail merged after them, the first rolled back and applied again."""
    m = _ids(events_mail(spark, d).select("gmail_id", "subject", "sender"))
    box = MailStore(spark, shared_folder(spark, "store"), 8)
    box.create(m)
    measure, name = Migration("001", add={"subject_length": "5 + length(subject)"}), Migration("002", rename={"subject": "title", "subject_length": "title_length"})
    box.migrate([measure])
    box.roll_back(measure)
    box.upsert(m.where("gmail_id % 10 = 0").withColumn("subject", F.lit("late")))
    box.migrate([measure, name])
    status = box.migration_status([measure, name]).where("status = 'applied'").count()
    return box.read().select("gmail_id", "title", "title_length", F.lit(status).alias("applied"))


# Text checks


@Q.add("header_dates", f"{EVENTS} SELECT gmail_id, date_trunc('second', date_received) AS sent FROM mail")
def header_dates(spark, d):
    m = events_mail(spark, d)
    raw = F.concat(F.lit("From: a@b\r\ndate: Mon, "), F.date_format("date_received", "d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)\r\nDate: 1 Jan 1999 00:00:00 +0000\r\n\r\nbody"))
    return m.select("gmail_id", text.header_date(raw).cast("timestamp_ntz").alias("sent"))


@Q.add("valid_inputs", "SELECT event_id, user_id % 3 <> 0 AS address_ok, event_id % 2 = 0 AS date_ok, CASE WHEN user_id BETWEEN 1 AND 50 THEN user_id::INTEGER END AS size FROM events")
def valid_inputs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    address = F.concat(F.when(F.col("user_id") % 3 == 0, "user ").otherwise("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
    day = F.when(F.col("event_id") % 2 == 0, "2024/02/29").otherwise("29.02.2023")
    return e.select("event_id", text.valid_address(address).alias("address_ok"), text.valid_date(day).alias("date_ok"), markup.valid_integer(F.col("user_id").cast("string"), 1, 50).alias("size"))


@Q.add("front_matter", f"""{EVENTS} SELECT gmail_id, '---' || chr(10) || 'title: "' || subject || '"' || chr(10) || 'from: "' || sender || '"' || chr(10) || '---' || chr(10) AS head, '![x](files/' || gmail_id || '.png)' AS image,
  'a' || chr(13) || chr(10) || 'b' || chr(13) || chr(10) || subject AS lines FROM mail""")
def front_matter(spark, d):
    m = events_mail(spark, d)
    head = markup.front_matter({"title": F.col("subject"), "gone": F.lit(None).cast("string"), "from": F.col("sender")})
    paths = F.create_map(F.lit("p1"), F.concat(F.lit("files/"), F.col("gmail_id").cast("string"), F.lit(".png")))
    return m.select("gmail_id", head.alias("head"), markup.rewrite_cid(F.lit("![x](cid:p1)"), paths).alias("image"), markup.repair_line_ends(F.concat(F.lit("a\r\r\nb\n"), "subject")).alias("lines"))


@Q.add("chunked_work", "SELECT doc_id AS gmail_id, CASE WHEN doc_id % 7 <> 0 THEN length(coalesce(text, '')) END AS n, doc_id % 7 = 0 AS failed FROM documents")
def chunked_work(spark, d):
    def lengths(rows):
        if (rows["gmail_id"] % 7 == 0).any():
            raise ValueError("cannot be read")
        return rows.assign(n=rows["body"].fillna("").str.len())

    out = chunks.process_chunks(docs_mail(spark, d).select("gmail_id", "body"), lengths, "gmail_id long, n double")
    return out.select("gmail_id", F.col("n").cast("long").alias("n"), F.col("error").isNotNull().alias("failed"))


# Store, history, ledgers


@Q.add("unprocessed_rows", "SELECT event_id AS gmail_id FROM events WHERE event_id % 3 <> 0")
def unprocessed_rows(spark, d):
    seen = F.when(F.col("gmail_id") % 3 == 0, "x").when(F.col("gmail_id") % 3 == 1, "")
    return store.unprocessed(events_mail(spark, d).withColumn("primary_category", seen)).select("gmail_id")


@Q.add("write_back", f"{EVENTS} SELECT gmail_id, CASE WHEN gmail_id % 2 = 0 THEN subject ELSE 'old' END AS category, CASE WHEN gmail_id % 2 = 0 THEN value END AS confidence FROM mail")
def write_back(spark, d):
    m = events_mail(spark, d)
    found = m.where("gmail_id % 2 = 0").select("gmail_id", F.col("subject").alias("category"), F.col("value").alias("confidence"))
    return store.write_back(m.select("gmail_id", F.lit("old").alias("category")), found)


@Q.add("deletion_plan", f"{EVENTS} SELECT gmail_id, 'would_delete' AS action FROM (SELECT DISTINCT gmail_id FROM mail WHERE subject = 'click' ORDER BY gmail_id LIMIT 100)")
def deletion_plan(spark, d):
    return store.deletion_plan(events_mail(spark, d), search.mail_query("subject:click"), most=100)


@Q.add("files_in_order", "SELECT path FROM (SELECT 'Box/' || event_type || '-' || event_id || '.EML' AS path FROM events) ORDER BY lower(path), path LIMIT 50")
def files_in_order(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return readers.first_files(e.select(F.concat(F.lit("Box/"), "event_type", F.lit("-"), F.col("event_id").cast("string"), F.lit(".EML")).alias("path")), 50)


@Q.add("extraction_rates", "SELECT count(*) AS total, count(*) FILTER (value <= 90 OR value IS NULL) AS extracted, count(*) FILTER (value > 90) AS failed, round(count(*) FILTER (value <= 90 OR value IS NULL) * 100.0::DOUBLE / count(*), 2) AS success_rate FROM events")
def extraction_rates(spark, d):
    return ledger.extraction_stats(spark.read.parquet(f"{d}/events.parquet").select(F.when(F.col("value") > 90, "too large").alias("error")))


_STATES = "['in_progress', 'interrupted', 'in_progress', 'completed', 'failed']"


@Q.add("checkpoint_states", f"""WITH e AS (SELECT user_id AS sync_id, event_id AS seq, {_STATES}[(event_id * 7 + user_id) % 5 + 1] AS s FROM events),
  g AS (SELECT sync_id, list(s ORDER BY seq) AS ss FROM e GROUP BY sync_id)
  SELECT sync_id, list_reduce(list_prepend('pending', ss), lambda a, x: CASE WHEN a = 'pending' AND x IN ('in_progress', 'failed') OR a = 'in_progress' OR a = 'interrupted' AND x IN ('in_progress', 'failed') THEN x ELSE a END) AS state FROM g""")
def checkpoint_states(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    state = F.get(F.array(*[F.lit(x) for x in ("in_progress", "interrupted", "in_progress", "completed", "failed")]), ((F.col("event_id") * 7 + F.col("user_id")) % 5).cast("int"))
    return ledger.checkpoints(e.select(F.col("user_id").alias("sync_id"), F.col("event_id").alias("seq"), state.alias("state"), F.lit(1).alias("processed"), F.lit(2).alias("total"))).select("sync_id", "state")


@Q.add("index_after_changes", f"""{EVENTS}, t AS (SELECT gmail_id, unnest(['subject', 'sender']) AS field, unnest([CASE WHEN gmail_id % 4 = 0 THEN 'new ' || subject ELSE subject END, sender]) AS text FROM mail WHERE gmail_id % 5 <> 0 OR gmail_id % 4 = 0),
  w AS (SELECT gmail_id, field, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM t) SELECT term, field, count(DISTINCT gmail_id) AS mails, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2""")
def index_after_changes(spark, d):
    m = events_mail(spark, d).select("gmail_id", "subject", "sender")
    fields = ("subject", "sender")
    delta = m.where("gmail_id % 4 = 0").withColumn("subject", F.concat(F.lit("new "), "subject"))
    index = search.update_postings(search.postings(m, fields=fields), delta, m.where("gmail_id % 5 = 0").select("gmail_id"), fields=fields)
    return index.groupBy("term", "field").agg(F.countDistinct("gmail_id").alias("mails"), F.sum("tf").alias("tf"))


@Q.add("snapshot_store", f"""{EVENTS}, n AS (SELECT gmail_id, max(history) AS h FROM (SELECT gmail_id % 500 AS gmail_id, gmail_id AS history FROM mail) GROUP BY 1)
  SELECT n.gmail_id::VARCHAR AS gmail_id, CASE WHEN n.gmail_id % 3 = 0 THEN 'changed' ELSE m.subject END AS subject FROM n JOIN mail m ON m.gmail_id = n.h WHERE n.gmail_id % 7 <> 0 OR n.gmail_id % 14 = 0""")
def snapshot_store(spark, d):
    """Versions of 500 mails, of which the newest counts; then a merge, a deletion and a restore."""
    m = _ids(events_mail(spark, d).select((F.col("gmail_id") % 500).alias("gmail_id"), "subject", "sender", F.col("gmail_id").alias("history_id")))
    box = MailStore(spark, shared_folder(spark, "store"))
    box.create(m)
    ids = box.read().select("gmail_id")
    box.upsert(ids.where("gmail_id % 3 = 0").withColumn("subject", F.lit("changed")))
    box.delete(ids.where("gmail_id % 7 = 0"), F.localtimestamp())
    box.restore(ids.where("gmail_id % 14 = 0"))
    box.vacuum()
    return box.find(F.lit(True)).select("gmail_id", "subject")


@Q.add("store_one_commit", """WITH m AS (SELECT event_id AS id, event_type AS t FROM events)
  SELECT id::VARCHAR AS gmail_id, CASE WHEN id % 3 = 0 THEN 'changed ' || t ELSE t END AS subject, id % 5 = 0 AS gone, CASE WHEN id % 4 = 0 THEN 'seen' WHEN id % 2 = 0 THEN t ELSE '' END AS labels, 2 AS versions FROM m WHERE id % 2 = 0 OR id % 3 = 0""")
def store_one_commit(spark, d):
    """Half of the events as mail; then changes, new mail, deletions, restores and label changes in one version."""
    m = _ids(events_mail(spark, d).select("gmail_id", "subject", "sender", "labels"))
    box = MailStore(spark, shared_folder(spark, "store"), 16)
    box.create(m.where("gmail_id % 2 = 0"))
    changed = m.where("gmail_id % 3 = 0").select("gmail_id", F.concat(F.lit("changed "), "subject").alias("subject"))
    marks = m.where("gmail_id % 4 = 0").select("gmail_id", F.array(F.lit("seen")).alias("add"), F.array("subject").alias("remove"))
    version = box.apply(changed, m.where("gmail_id % 10 = 0"), m.where("gmail_id % 5 = 0"), marks)
    return box.read().select("gmail_id", "subject", F.col("deleted_at").isNotNull().alias("gone"), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ",").alias("labels"), F.lit(version).alias("versions"))


@Q.add("dead_letters_by_batch", """WITH f AS (SELECT user_id, user_id::VARCHAR AS message_id, event_type AS failure_type, ts FROM events WHERE event_type IN ('error', 'click')),
  l AS (SELECT user_id, message_id, failure_type, count(*) AS n, min(ts) AS first_failure, max(ts) AS last_failure FROM f GROUP BY ALL)
  SELECT message_id, failure_type, CASE WHEN n >= 5 AND user_id % 4 <> 0 AND user_id % 6 = 1 THEN 0 ELSE n END AS attempts, first_failure, last_failure, user_id % 4 = 0 AS resolved,
    CASE WHEN user_id % 4 = 0 THEN NULL WHEN n < 5 THEN last_failure + to_seconds(CAST(300 * pow(2, n - 1) AS BIGINT)) WHEN user_id % 6 = 1 THEN TIMESTAMP '2024-03-01 00:05:00' END AS next_retry FROM l""")
def dead_letters_by_batch(spark, d):
    """Failures in five batches, one of them sent twice; attempts add up. Then some are resolved, and some of the exhausted start again."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type in ('error', 'click')")
    f = e.select(F.col("user_id").cast("string").alias("message_id"), F.col("event_type").alias("failure_type"), F.col("ts").alias("failed_at"), F.pmod("event_id", F.lit(5)).alias("batch"))
    letters = DeadLetterStore(spark, shared_folder(spark, "letters"), 8)
    for number in (0, 1, 2, 2, 3, 4):
        letters.add(f.where(F.col("batch") == number).drop("batch"), ("feed", number))
    now = F.expr("timestamp_ntz'2024-03-01'")
    letters.resolve(f.where("message_id % 4 = 0"), now, "sent again")
    letters.reset(ledger.exhausted(letters.open()).where("message_id % 6 = 1"), now)
    return letters.read().select("message_id", "failure_type", "attempts", "first_failure", "last_failure", "resolved", "next_retry")


_TYPES = "['added', 'label_added', 'deleted', 'label_removed', 'added']"


@Q.add("history_sync", f"""WITH c AS (SELECT user_id::VARCHAR AS gmail_id, event_id AS h, {_TYPES}[(event_id * 3 + user_id) % 5 + 1] AS type, event_type AS subject, value > 95 AS bad FROM events),
  g AS (SELECT * FROM c WHERE NOT bad), a AS (SELECT gmail_id, arg_max(subject, h) AS subject FROM g WHERE type = 'added' GROUP BY 1), l AS (SELECT gmail_id, arg_max(type, h) AS last FROM g WHERE type IN ('added', 'deleted') GROUP BY 1),
  b AS (SELECT gmail_id, subject AS label, arg_max(type, h) AS t FROM g WHERE type LIKE 'label%' GROUP BY 1, 2), k AS (SELECT gmail_id, string_agg(label, ',' ORDER BY label) AS labels FROM b WHERE t = 'label_added' GROUP BY 1)
  SELECT a.gmail_id, a.subject, l.last = 'deleted' AS gone, coalesce(k.labels, '') AS labels FROM a JOIN l USING (gmail_id) LEFT JOIN k USING (gmail_id)""")
def history_sync(spark, d):
    """The event file as a stream of changes: additions, deletions and labels of one id in one batch each take effect."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = mail_stream.read_stream(spark, f"{d}/events.parque[t]", schema)
    kind = F.get(F.array(*[F.lit(x) for x in ("added", "label_added", "deleted", "label_removed", "added")]), ((F.col("event_id") * 3 + F.col("user_id")) % 5).cast("int"))
    changes = e.select(
        F.col("user_id").cast("string").alias("gmail_id"), F.col("event_id").alias("history_id"), kind.alias("type"), F.col("event_type").alias("subject"), F.lit("a@b").alias("sender"), F.col("props").alias("body"),
        F.when(F.col("value") > 95, "timeout").alias("error"), F.array("event_type").alias("labels"))
    folder = shared_folder(spark, "history")
    box = MailStore(spark, f"{folder}/store")
    box.create(spark.createDataFrame([], "gmail_id string, subject string, sender string, body string, labels array<string>"))
    mail_stream.sync_history(changes, box, f"{folder}/letters", f"{folder}/checkpoint").awaitTermination()
    return box.read().select("gmail_id", "subject", F.col("deleted_at").isNotNull().alias("gone"), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ",").alias("labels"))
