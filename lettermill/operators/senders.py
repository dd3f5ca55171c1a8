"""Profiles of senders and their domains, diversity."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions import packs
from lettermill.operators.quality import pct
from lettermill.operators.rules import any_of


def domain(sender: Column) -> Column:
    """What follows the first @ up to > or white space; null without one."""
    return F.nullif(F.regexp_extract(sender, r"@([^>\s]+)", 1), F.lit(""))


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """``counts`` with ``pct`` of the total, a scalar subquery."""
    return counts.withColumn("pct", pct(F.col(n), counts.agg(F.sum(n)).scalar()))


def top_senders(df: DataFrame, k: int = 20, sender: str = "sender") -> DataFrame:
    """(sender, n, pct): the k most frequent senders, by name on ties."""
    n = df.where(F.col(sender).isNotNull()).groupBy(sender).agg(F.count("*").alias("n"))
    return with_share(n).orderBy(F.desc("n"), sender).limit(k)


def sender_profile(df: DataFrame, k: int = 50, sender: str = "sender", category: str = "category", date: str = "date_received", body: str = "body") -> DataFrame:
    """Top k senders: count, share, categories ``name:count`` by name, mean length, first and last mail, mail per active day, automation.

    One aggregate by (sender, category) feeds the one by sender, so a hot sender is combined twice before it is one row.
    """
    per = df.where(F.col(sender).isNotNull()).groupBy(sender, category).agg(
        F.count("*").alias("c"), F.sum(F.length(F.coalesce(F.col(body), F.lit("")))).alias("chars"), F.min(date).alias("a"), F.max(date).alias("b"), F.max("is_automated").alias("auto"))
    days = df.where(F.col(sender).isNotNull()).select(sender, F.to_date(date).alias("d")).distinct().groupBy(sender).agg(F.count("d").alias("active_days"))
    out = per.groupBy(sender).agg(
        F.sum("c").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(category, "c"))), lambda r: F.concat_ws(":", r[category], r["c"].cast("string"))), ",").alias("categories"),
        F.sum("chars").alias("chars"), F.min("a").alias("first_mail"), F.max("b").alias("last_mail"), F.max("auto").alias("is_automated"))
    out = with_share(out).orderBy(F.desc("n"), sender).limit(k).join(days, sender, "left")
    return out.select(
        sender, "n", "pct", "categories", F.floor(F.col("chars") / F.col("n")).cast("long").alias("avg_length"), "first_mail", "last_mail", "is_automated",
        F.round(F.col("n") / F.greatest(F.col("active_days"), F.lit(1)), 3).alias("per_active_day"))


def sender_totals(df: DataFrame, sender: str = "sender") -> DataFrame:
    """(unique_senders, total, mean_per_sender)."""
    n = df.where(F.col(sender).isNotNull()).groupBy(sender).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("unique_senders"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.round(F.avg("n"), 3).alias("mean_per_sender"))


def automation(df: DataFrame, category: str = "category") -> DataFrame:
    """(category, n, automated, rate) by category."""
    return df.groupBy(category).agg(F.count("*").alias("n"), F.count_if("is_automated").alias("automated"), F.round(F.avg(F.col("is_automated").cast("int")), 6).alias("rate"))


def top_domains(df: DataFrame, k: int | None = 20, sender: str = "sender") -> DataFrame:
    """(domain, n, pct); all domains with k None."""
    n = df.select(domain(F.col(sender)).alias("domain")).where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))
    out = with_share(n)
    return out.orderBy(F.desc("n"), "domain").limit(k) if k else out


def domain_kinds(df: DataFrame, k: int | None = 20, sender: str = "sender") -> DataFrame:
    """(kind, n): personal, service and corporate mail over the top k domains (all with k None)."""
    d = F.lower("domain")
    kind = F.when(d.isin(*packs.PERSONAL_HOSTS), "personal").when(any_of(d, packs.SERVICE_WORDS), "service").otherwise("corporate")
    return top_domains(df, k, sender).groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


def diversity(df: DataFrame, key: Column) -> DataFrame:
    """(distinct_keys, shannon, simpson, effective, top_10_share) of the counts by ``key``."""
    n = df.select(key.alias("k")).where("k is not null").groupBy("k").agg(F.count("*").cast("double").alias("n"))
    top = n.orderBy(F.desc("n"), "k").limit(10).agg(F.sum("n"))
    shares = n.withColumn("p", F.col("n") / n.agg(F.sum("n")).scalar())
    p = F.col("p")
    sums = shares.agg(F.count("*").alias("distinct_keys"), F.sum(-p * F.ln(p + F.lit(1e-10))).alias("h"), F.sum(p * p).alias("s2"), F.sum("n").alias("total"))
    return sums.select(
        "distinct_keys", F.round("h", 6).alias("shannon"), F.round(1 - F.col("s2"), 6).alias("simpson"), F.round(F.exp("h"), 3).alias("effective"), F.round(top.scalar() / F.col("total"), 6).alias("top_10_share"))
