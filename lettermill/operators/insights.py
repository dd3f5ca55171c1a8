"""Threshold rules over the one-row metrics of a classified mailbox, and text reports of small results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind, High above, Medium above.
LIMITS = (("category", 50.0, 30.0), ("automation", 70.0, 50.0), ("coverage", 50.0, 20.0), ("sender", 20.0, 10.0), ("volume", 1.0, 0.5))

ACTIONS = {
    "category": "Set up a folder or filter for the leading category", "automation": "Bundle automated mail into a digest", "coverage": "Add rules for unclassified mail",
    "sender": "Review the leading sender's subscription", "volume": "Look into the peaks of the daily volume",
}


def _top_share(df: DataFrame, key) -> DataFrame:
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg((F.max("n") * 100.0 / F.sum("n")).cast("double").alias("x"))


def insights(df: DataFrame) -> DataFrame:
    """(kind, priority, measured): share of the top category, of automated mail, of mail without a rule, of the top sender; volatility."""
    rates = df.agg((F.avg(F.col("is_automated").cast("int")) * 100).alias("automation"), (F.avg((F.col("category") == "Other").cast("int")) * 100).alias("coverage"))
    daily = df.groupBy(F.to_date("date_received").alias("d")).agg(F.count("*").alias("n")).agg((F.stddev_samp("n") / F.avg("n")).alias("x"))
    one = rates.select("automation", "coverage", _top_share(df, F.col("category")).scalar().alias("category"), _top_share(df, F.col("sender")).scalar().alias("sender"), daily.scalar().alias("volume"))
    rows = [F.struct(F.lit(k).alias("kind"), F.when(F.col(k) > high, "High").when(F.col(k) > mid, "Medium").otherwise("Low").alias("priority"), F.round(k, 3).alias("measured")) for k, high, mid in LIMITS]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def recommendations(found: DataFrame, k: int = 3) -> DataFrame:
    """The first k insights of High or Medium priority, with an action."""
    action = F.create_map(*[x for kind, said in ACTIONS.items() for x in (F.lit(kind), F.lit(said))])
    rank = F.when(F.col("priority") == "High", 0).otherwise(1)
    return found.where("priority in ('High', 'Medium')").orderBy(rank, F.desc("measured"), "kind").limit(k).withColumn("action", F.element_at(action, F.col("kind")))


def text_report(summary: DataFrame, found: DataFrame) -> str:
    """A readable report of two small results (categories and insights, both bounded by their rules)."""
    lines = ["Categories"]
    lines += [f"  {r['category']:<20} {r['n']:>8}  {r['pct']:6.2f} %" for r in summary.orderBy(F.desc("pct"), "category").limit(50).collect()]
    lines += ["Recommendations"] + [f"  [{r['priority']}] {r['action']}" for r in recommendations(found, 5).collect()]
    return "\n".join(lines) + "\n"
