"""Mail views of the test tables, for Spark and as DuckDB CTEs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("gmail_id"), F.col("ts").alias("date_received"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@"), F.col("event_type"), F.lit(".example.com")).alias("sender"),
        F.col("event_type").alias("subject"), F.array("event_type").alias("labels"), F.col("props").alias("body"), "value",
    )


def docs_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("gmail_id"), F.concat("source", F.lit("@"), "lang", F.lit(".example.org")).alias("sender"), F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("subject"),
        F.col("text").alias("body"), F.array("source", "lang").alias("labels"), "source", "lang",
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("gmail_id"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), F.col("role").alias("sender"), F.col("text").alias("body"))


def html_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.col("page_id").alias("gmail_id"), "url", F.col("html").alias("body_html"), F.lower(F.parse_url("url", F.lit("HOST"))).alias("sender"))


SQL_EVENTS = "mail AS (SELECT event_id AS gmail_id, ts AS date_received, 'user' || user_id || '@' || event_type || '.example.com' AS sender, event_type AS subject, [event_type] AS labels, props AS body, value FROM events)"
SQL_DOCS = "mail AS (SELECT doc_id AS gmail_id, source || '@' || lang || '.example.org' AS sender, split_part(text, chr(10), 1) AS subject, text AS body, [source, lang] AS labels, source, lang FROM documents)"
