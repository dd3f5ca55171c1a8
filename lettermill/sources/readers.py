"""Readers: analysis files, EML, Markdown, monthly JSON, newsletter JSON and CSV, API messages."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import text
from lettermill.schema import to_mail
from lettermill.sources.mime import best_body, parse_message

REQUIRED = ("gmail_id", "date_received", "subject", "sender", "plain_text_content")


def read_analysis_file(spark: SparkSession, path: str) -> DataFrame:
    """A .parquet, .csv or .json table; required columns that are absent are '' (ids: unique numbers as text)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    elif kind == "json":
        df = spark.read.json(path, multiLine=True)
    else:
        raise ValueError(f"unsupported file format: .{kind}")
    fill = {c: (F.monotonically_increasing_id().cast("string") if c == "gmail_id" else F.lit("")) for c in REQUIRED if c not in df.columns}
    return df.withColumns(fill) if fill else df


_EML = "gmail_id string, thread_id string, subject string, sender string, to string, cc string, bcc string, date string, labels string, body string, body_html string, has_attachments boolean, size long, source_file string, error string"


_EML_ARROW = pa.schema([(n, {"boolean": pa.bool_(), "long": pa.int64()}.get(t, pa.string())) for n, t in (f.split() for f in _EML.split(", "))])


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            m = parse_message(content)
            h = m["headers"]
            name = path.rsplit("/", 1)[-1]
            rows.append((h.get("X-Gmail-ID") or None, h.get("X-Thread-ID"), h.get("Subject"), h.get("From"), h.get("To"), h.get("Cc"), h.get("Bcc"), h.get("Date"), h.get("X-Gmail-Labels"), best_body(m["plain"], m["html"]), m["html"], m["attachments"], len(content or b""), name, m["error"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_EML_ARROW), _EML_ARROW.types, strict=True)], schema=_EML_ARROW)


def read_eml(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """EML files below ``path`` in the canonical schema, with ``to, cc, bcc, error``; the id comes from the header, else from the file name."""
    return parse_eml(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))


def first_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files in the order of their lower-case paths; the first ``limit`` if it is given."""
    ordered = files.orderBy(F.lower("path"), "path")
    return ordered if limit is None else ordered.limit(limit)


def parse_eml(files: DataFrame) -> DataFrame:
    """Mail of (path, content) rows; see ``read_eml``."""
    raw = files.select("path", "content").mapInArrow(_parse_files, _EML)
    raw = raw.withColumn("gmail_id", F.coalesce("gmail_id", text.message_id(F.col("source_file")), F.col("source_file")))
    return _with_extra(raw, ("to", "cc", "bcc", "error"))


def _with_extra(raw: DataFrame, extra) -> DataFrame:
    """Canonical mail with more columns of ``raw``; these travel in the snippet, which such rows do not have."""
    mail = to_mail(raw.withColumn("snippet", F.to_json(F.struct(*extra))))
    mail = mail.withColumn("__x", F.from_json("snippet", ", ".join(f"`{e}` string" for e in extra)))
    return mail.withColumn("snippet", F.lit(None).cast("string")).select("*", "__x.*").drop("__x")


def _table_value(page: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(page, rf"(?mi)^\|\s*\**{name}\**\s*\|\s*(.*?)\s*\|\s*$", 1)), F.lit(""))


def read_markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Markdown mails: a metadata table, then the body after ``## Email Content`` or ``## Message Content``, else after the first heading, else all."""
    return parse_markdown(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)))


def parse_markdown(files: DataFrame) -> DataFrame:
    """Mail of (value, source_file) rows; see ``read_markdown``."""
    page = F.col("value")
    body = F.coalesce(
        F.when(page.rlike(r"(?m)^## (?:Email|Message) Content\s*$"), F.regexp_extract(page, r"(?ms)^## (?:Email|Message) Content\s*\n(.*)\z", 1)),
        F.when(page.rlike(r"(?m)^## "), F.regexp_extract(page, r"(?ms)^## [^\n]*\n(.*)\z", 1)), page)
    day = F.nullif(F.regexp_extract("source_file", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    raw = files.select(
        F.coalesce(_table_value(page, "Message ID"), text.message_id(F.col("source_file")), F.col("source_file")).alias("gmail_id"), _table_value(page, "Thread ID").alias("thread_id"), _table_value(page, "Subject").alias("subject"),
        _table_value(page, "From").alias("sender"), F.coalesce(_table_value(page, "Date"), day).alias("date"), _table_value(page, "Labels").alias("labels"),
        F.regexp_replace(F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")), r"\n{3,}", "\n\n").alias("body"), "source_file")
    return to_mail(raw)


def read_directory(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """EML and Markdown below ``path``; with days given only their mail, and each id once (the first file by name)."""
    from lettermill.operators.search import between_days
    from lettermill.operators.store import dedup

    mail = read_eml(spark, path).drop("to", "cc", "bcc", "error").unionByName(read_markdown(spark, path))
    if first:
        mail = between_days(mail, first, last or first, whole_last_day=True)
    return dedup(mail, "gmail_id", ["source_file"])


def read_monthly_json(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """Monthly envelopes ``{year_month, emails: [...]}`` as mail; months in ``done`` (year_month) are left out."""
    return mail_of_envelopes(spark.read.option("multiLine", "true").json(path), done)


def mail_of_envelopes(files: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Mail of (year_month, emails) rows; see ``read_monthly_json``."""
    if done is not None:
        files = files.join(done.select("year_month").distinct(), "year_month", "left_anti")
    rows = files.select(F.explode("emails").alias("e")).select("e.*")
    return to_mail(rows)


def read_newsletters(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list, ``{emails: [...]}``, ``{messages: [...]}``, one object, or a CSV with a header, as mail."""
    if path.lower().endswith(".csv"):
        return to_mail(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    df = spark.read.option("multiLine", "true").json(path)
    for c in ("emails", "messages"):
        if c in df.columns:
            df = df.select(F.explode(c).alias("e")).select("e.*")
            break
    return to_mail(df)


def from_api_messages(df: DataFrame) -> DataFrame:
    """API messages (id, threadId, labelIds, snippet, payload.headers, internalDate in ms) as mail; of repeated headers the last counts."""
    heads = F.reverse(F.transform("payload.headers", lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))))
    one = lambda n: F.get(F.filter(heads, lambda h: h["name"] == n), F.lit(0))["value"]
    who = lambda n: F.transform(text.split_addresses(one(n)), lambda a: F.struct(text.parse_address(a)["address"].alias("address"), F.lit(n).alias("type"), text.parse_address(a)["display_name"].alias("display_name")))
    raw = df.select(
        F.col("id").alias("gmail_id"), F.col("threadId").alias("thread_id"), one("subject").alias("subject"), text.parse_address(one("from"))["address"].alias("sender"),
        F.concat(who("to"), who("cc"), who("bcc")).alias("recipients"), F.timestamp_millis(F.col("internalDate").cast("long")).alias("date_received"), F.col("labelIds").alias("labels"), "snippet",
        F.col("sizeEstimate").cast("long").alias("size"))
    return to_mail(raw)


def decode_base64url(data: Column) -> Column:
    """URL-safe base64 as UTF-8 text; '' where it cannot be decoded."""
    plain = F.translate(data, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.coalesce(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), F.lit(""))


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table over JDBC (its driver must be on the class path), in ``parts`` ranges of the number ``key`` if one is given."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return reader.option("dbtable", table).load()
    least, most = reader.option("query", f"select min({key}) as a, max({key}) as b from {table}").load().first()
    ranges = {"partitionColumn": key, "lowerBound": least or 0, "upperBound": (most or 0) + 1, "numPartitions": parts}
    return reader.options(**ranges).option("dbtable", table).load()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a Parquet table, nulls left out; only that column is read."""
    return spark.read.parquet(path).select("gmail_id").na.drop()


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, modified, content_type) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("eml", "message/rfc822", "md", "text/markdown", "json", "application/json", "parquet", "application/parquet")]), F.lower(F.element_at(F.split("path", r"\."), -1)))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"), F.coalesce(kind, F.lit("application/octet-stream")).alias("content_type"))
