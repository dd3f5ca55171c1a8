"""Reports as tables: a classified mailbox by section, what a store holds, and its state."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import year_month
from lettermill.operators import store
from lettermill.operators.quality import pct

#: The bands of a confidence, from the highest.
BANDS = ((0.8, "High (0.8+)"), (0.6, "Medium (0.6-0.8)"), (0.4, "Low (0.4-0.6)"))


def _band(confidence: Column) -> Column:
    out = F.when(confidence.isNull(), None)
    for least, name in BANDS:
        out = out.when(confidence >= least, name)
    return out.otherwise("Very Low (<0.4)")


def classification_report(mail: DataFrame, sender: str = "sender") -> DataFrame:
    """(section, name, detail, n, pct, avg_confidence) of mail with the results of ``rules.three_signals``.

    Sections: overview (total, classified), primary_categories, domain_categories (without Other), confidence_analysis, quality_metrics, and
    sender_analysis: up to five senders of three mails or more a category, with names cut at 50 characters. Shares are of the classified
    mail, in overview and quality_metrics of all. All but the senders come from one aggregate over grouping sets.
    """
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rows = mail.select("primary_category", "domain_category", "confidence_score", _band(F.col("confidence_score")).alias("band"), "automated_score", "has_unsubscribe", "is_thread", F.col(sender).alias("sender"))
    sets = rows.groupingSets([["primary_category"], ["domain_category"], ["band"], []], "primary_category", "domain_category", "band").agg(
        F.grouping_id().alias("of"), F.count("*").alias("n"), F.count("primary_category").alias("classified"), F.avg("confidence_score").alias("mean"),
        flag(F.col("automated_score") > 0.5).alias("automated"), flag(F.col("has_unsubscribe")).alias("unsubscribe"), flag(F.col("is_thread")).alias("threads"))
    # As many rows as there are categories and bands, which the rules bound: read once, whatever sections are made of them.
    sets = mail.sparkSession.createDataFrame(sets.collect(), sets.schema)
    whole = sets.where("of = 7").select(F.col("n").alias("total"), F.col("classified").alias("done"), "mean", "automated", "unsubscribe", "threads")
    done = F.lit(whole.first()["done"])
    line = lambda section, name, detail, n, share, mean: F.struct(F.lit(section).alias("section"), name.alias("name"), detail.alias("detail"), n.cast("long").alias("n"), share.alias("pct"), mean.alias("avg_confidence"))
    none, no_mean = F.lit(None).cast("string"), F.lit(None).cast("double")
    total = F.col("total")
    overview = [("overview", "total_emails", total, F.round("mean", 3)), ("overview", "classified_emails", F.col("done"), no_mean), *[("quality_metrics", x, F.col(x), no_mean) for x in ("automated", "unsubscribe", "threads")]]
    fixed = whole.select(F.explode(F.array(*[line(section, F.lit(name), none, n, pct(n, total, 1), mean) for section, name, n, mean in overview])).alias("r")).select("r.*")
    by = []
    for grouping, section, column in ((3, "primary_categories", "primary_category"), (5, "domain_categories", "domain_category"), (6, "confidence_analysis", "band")):
        own = sets.where((F.col("of") == grouping) & F.col(column).isNotNull())
        own = own.where("domain_category <> 'Other'") if section == "domain_categories" else own
        mean = no_mean if section == "confidence_analysis" else F.round("mean", 3)
        by.append(own.select(line(section, F.col(column), none, F.col("n"), pct(F.col("n"), done, 1), mean).alias("r")).select("r.*"))
    senders = store.category_senders(rows.where("primary_category is not null"), category="primary_category")
    cut = F.when(F.length("sender") > 50, F.concat(F.left("sender", F.lit(50)), F.lit("..."))).otherwise(F.col("sender"))
    senders = senders.select(line("sender_analysis", F.col("primary_category"), cut, F.col("n"), F.lit(None).cast("double"), no_mean).alias("r")).select("r.*")
    out = fixed
    for part in (*by, senders):
        out = out.unionByName(part)
    return out


def database_info(mail: DataFrame, date: str = "date_received", k: int = 10) -> DataFrame:
    """(section, name, n, first_mail, last_mail): total with the range of dates, the ``k`` most frequent senders that are not empty, and mail by month."""
    dates = lambda df: df.agg(F.count("*").alias("n"), F.min(date).alias("first_mail"), F.max(date).alias("last_mail"))
    no_date = F.lit(None).cast(mail.schema[date].dataType)
    one = lambda df, section, name: df.select(F.lit(section).alias("section"), name.alias("name"), "n")
    total = dates(mail).select(F.lit("total").alias("section"), F.lit("emails").alias("name"), "n", "first_mail", "last_mail")
    senders = mail.where("sender <> ''").groupBy("sender").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender").limit(k)
    months = mail.groupBy(year_month(F.col(date)).alias("month")).agg(F.count("*").alias("n"))
    parts = one(senders, "top_senders", F.col("sender")).unionByName(one(months, "monthly_distribution", F.col("month")))
    return total.unionByName(parts.withColumns({"first_mail": no_date, "last_mail": no_date}))


def store_stats(mail: DataFrame, key: str = "gmail_id", date: str = "date_received") -> DataFrame:
    """One row: (total_emails, unique_ids, soft_deleted, duplicate_groups, total_duplicates, first_mail, last_mail); dates are those of live mail. One scan: rows meet by id first."""
    alive = F.when(F.col("deleted_at").isNull(), F.col(date))
    by_id = mail.groupBy(key).agg(F.count("*").alias("n"), F.count("deleted_at").alias("gone"), F.min(alive).alias("first"), F.max(alive).alias("last"))
    named = F.col(key).isNotNull()
    return by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_emails"), F.count_if(named).alias("unique_ids"), F.coalesce(F.sum("gone"), F.lit(0)).alias("soft_deleted"), F.count_if(named & (F.col("n") > 1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(named, F.col("n") - 1)), F.lit(0)).alias("total_duplicates"), F.min("first").alias("first_mail"), F.max("last").alias("last_mail"))
