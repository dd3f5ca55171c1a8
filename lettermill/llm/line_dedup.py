"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host. A line that stands on more than ``ratio`` of the
host's pages is boilerplate of that host and leaves all of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.scratch import Scratch

#: A line is boilerplate of its host when it stands on more than this share of the host's pages ...
RATIO = 0.02
#: ... and on at least this many of them.
MIN_PAGES = 5
#: Boilerplate lines (16-byte digests) that may be broadcast; beyond it, hosts are joined by shuffle.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def boilerplate(df: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, digests): per host, the digests of its boilerplate lines.

    Pages of one host with the same text count as one page. Only 16-byte digests are shuffled; the
    hot lines and hosts are pre-aggregated before each exchange. A host's list holds at most
    (lines per page) / ratio digests.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(host).alias("__host"), _digest(F.col(text)).alias("__page"), _lines(F.col(text)).alias("__all"))
    totals = rows.groupBy("__host", "__page").count().groupBy("__host").agg(F.count("*").alias("__pages"))
    lines = rows.select("__host", "__page", F.explode(F.array_distinct("__all")).alias("__line")).where(F.col("__line").rlike(r"[^\x20\x09-\x0D]"))
    on = (
        lines.select("__host", "__page", _digest(F.col("__line")).alias("__digest"))
        .groupBy("__host", "__digest", "__page").agg(F.lit(1).alias("__one"))
        .groupBy("__host", "__digest").agg(F.count("*").alias("__on"))
        .where(F.col("__on") >= min_pages)
    )
    t = totals.withColumnRenamed("__host", "__t_host")
    frequent = on.join(t, on["__host"].eqNullSafe(t["__t_host"])).where(F.col("__on") > F.lit(float(ratio)) * F.col("__pages"))
    return frequent.groupBy("__host").agg(F.collect_list("__digest").alias("__bad"))


def drop_site_lines(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    r"""``df`` with ``text`` freed of its host's boilerplate lines; with ``counts`` also ``n_lines, n_dropped``.

    - Lines are split at \n and compared as they are; lines of white space only are never counted or dropped.
    - A line counts once a page, and pages of one host with equal texts count once.
    - Null text stays null (0 lines). Null hosts form one host. Empty text stays as it is.
    - A page on which every line is boilerplate becomes empty; no row is dropped.
    - Columns named ``n_lines`` and ``n_dropped`` are replaced, all others are kept.
    """
    scratch = Scratch(df.sparkSession, "lines")
    bad = scratch.save(boilerplate(df, host, text, ratio, min_pages), "boilerplate")
    size = bad.agg(F.coalesce(F.sum(F.size("__bad")), F.lit(0)).alias("n")).first()["n"]
    bad = bad.withColumnRenamed("__host", "__b_host")
    bad = F.broadcast(bad) if size <= BROADCAST_LINES else bad
    joined = df.join(bad, df[host].eqNullSafe(bad["__b_host"]), "left").drop("__b_host")
    kept = F.filter(_lines(F.col(text)), lambda line: ~F.array_contains(F.col("__bad"), _digest(line)))
    out = joined.withColumn("__kept", F.when(F.col("__bad").isNotNull(), kept).otherwise(_lines(F.col(text))))
    if counts:
        n = F.coalesce(F.size(_lines(F.col(text))), F.lit(0))
        n = F.when(F.col(text).isNull(), 0).otherwise(n)
        out = out.withColumns({"n_lines": n.cast("long"), "n_dropped": (n - F.when(F.col(text).isNull(), 0).otherwise(F.size("__kept"))).cast("long")})
    return out.withColumn(text, F.when(F.col("__bad").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n"))).drop("__bad", "__kept")


def op1_site_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_site_lines(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


OP1_SQL = f"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
lines AS (SELECT source, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
bad AS (
  SELECT l.source, l.line FROM (
    SELECT source, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.n >= {MIN_PAGES} AND l.n > {RATIO} * t.pages),
per AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
cut AS (
  SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS ls,
         CASE WHEN p.bad IS NULL THEN string_split(d.text, chr(10))
              ELSE list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(p.bad, x)) END AS kept
  FROM documents d LEFT JOIN per p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text
FROM cut
"""
