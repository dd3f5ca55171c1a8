"""Lengths, patterns, subjects and language of mail bodies."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import packs
from lettermill.operators.quality import pct
from lettermill.operators.rules import any_of


def content_length(body: str = "body") -> Column:
    return F.coalesce(F.length(body), F.lit(0))


def word_count(body: str = "body") -> Column:
    return F.coalesce(F.regexp_count(body, F.lit(r"\S+")), F.lit(0))


def length_stats(df: DataFrame, body: str = "body") -> DataFrame:
    """Mean, median, sample deviation, extremes, and percentiles (linear, cut to whole characters) of body lengths."""
    df = df.select(content_length(body).alias("len"))
    ps = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    out = df.agg(F.count("*").alias("n"), F.round(F.avg("len"), 3).alias("mean"), F.round(F.stddev_samp("len"), 3).alias("std"), F.min("len").alias("least"), F.max("len").alias("most"), F.percentile("len", ps).alias("p"))
    return out.select("n", "mean", "std", "least", "most", *[F.get("p", F.lit(i)).cast("long").alias(f"p{int(q * 100)}") for i, q in enumerate(ps)])


def length_bucket(length: Column) -> Column:
    """Right-closed buckets, the lowest edge included."""
    out = F.lit(packs.LENGTH_LABELS[-1])
    for edge, label in reversed(list(zip(packs.LENGTH_EDGES[1:], packs.LENGTH_LABELS[:-1], strict=True))):
        out = F.when(length <= edge, F.lit(label)).otherwise(out)
    return out


def length_buckets(df: DataFrame, body: str = "body") -> DataFrame:
    return df.groupBy(length_bucket(content_length(body)).alias("bucket")).agg(F.count("*").alias("n"))


def category_lengths(df: DataFrame, category: str = "category", body: str = "body") -> DataFrame:
    n = content_length(body)
    return df.groupBy(category).agg(F.count("*").alias("n"), F.round(F.avg(n), 1).alias("mean"), F.round(F.median(n), 1).alias("median"), F.round(F.stddev_samp(n), 1).alias("std"))


def patterns(df: DataFrame, body: str = "body") -> DataFrame:
    """URLs, signatures and words over all mail, in one pass."""
    text = F.coalesce(F.col(body), F.lit(""))
    df = df.select(F.regexp_count(text, F.lit(packs.URL_PATTERN)).alias("urls"), any_of(F.lower(text), packs.SIGNATURES).alias("signed"), word_count(body).alias("words"))
    return df.agg(
        F.count_if(F.col("urls") > 0).alias("with_urls"), F.round(F.avg("urls"), 3).alias("mean_urls"), F.max("urls").alias("most_urls"), F.count_if("signed").alias("signed"),
        F.round(F.avg(F.col("signed").cast("int")) * 100, 1).alias("signature_rate"), F.round(F.avg("words"), 3).alias("mean_words"), F.max("words").alias("most_words"))


def subjects(df: DataFrame, subject: str = "subject") -> DataFrame:
    """Length statistics, reply rate, distinct share of subjects; nulls are empty."""
    per = df.select(F.coalesce(F.col(subject), F.lit("")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    reply = F.col("s").rlike("(?i)^(re:|fwd:|fw:)")
    out = per.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_subjects"), F.round(F.sum(F.length("s") * F.col("n")) / F.sum("n"), 3).alias("mean_length"), F.max(F.length("s")).alias("longest"), F.coalesce(F.sum(F.when(reply, F.col("n"))), F.lit(0)).alias("replies"))
    return out.withColumns({"reply_rate": pct(F.col("replies"), F.col("total")), "diversity": F.round(F.col("distinct_subjects") / F.col("total"), 6)})


def top_subjects(df: DataFrame, k: int = 10, subject: str = "subject") -> DataFrame:
    n = df.select(F.coalesce(F.col(subject), F.lit("")).alias("subject")).groupBy("subject").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "subject").limit(k)


def english_score(df: DataFrame, body: str = "body") -> DataFrame:
    """(mails, english_pct): mean share of eight common words that stand in a body as substrings."""
    text = F.lower(F.coalesce(F.col(body), F.lit("")))
    score = reduce(add, [text.contains(w).cast("int") for w in packs.ENGLISH_WORDS]) / F.lit(float(len(packs.ENGLISH_WORDS)))
    return df.agg(F.count("*").alias("mails"), F.round(F.avg(score) * 100, 3).alias("english_pct"))
