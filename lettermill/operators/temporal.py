"""Volume over time: daily series, peaks, concentration."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_volume(df: DataFrame, date: str = "date_received") -> DataFrame:
    """(day, volume) for days with mail."""
    return df.where(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("day")).agg(F.count("*").alias("volume"))


def volume_stats(daily: DataFrame) -> DataFrame:
    """One row: days, total, mean, median, sample deviation, busiest and quietest day (earliest on ties), volatility."""
    return daily.agg(
        F.count("*").alias("total_days"), F.coalesce(F.sum("volume"), F.lit(0)).alias("total"), F.round(F.avg("volume"), 3).alias("mean_volume"),
        F.round(F.median("volume"), 3).alias("median_volume"), F.round(F.stddev_samp("volume"), 3).alias("std_volume"),
        F.max(F.struct("volume", -F.unix_date("day"))).alias("top"), F.min(F.struct("volume", F.col("day"))).alias("low"),
        F.round(F.stddev_samp("volume") / F.avg("volume"), 3).alias("volatility"),
    ).select("total_days", "total", "mean_volume", "median_volume", "std_volume", F.date_from_unix_date(-F.col("top.col2")).alias("busiest_day"), F.col("low.day").alias("quietest_day"), "volatility")


def peak_days(daily: DataFrame, window: int = 7, threshold: float = 2.0) -> DataFrame:
    """(day, volume, mean, deviation) of peaks: over the mean plus ``threshold`` deviations of the centred window of days with mail.

    The window must be full. The one-partition window runs on the daily series: a row a day, however much mail there is.
    """
    w = Window.orderBy("day").rowsBetween(-(window // 2), (window - 1) // 2)
    rolled = daily.select("day", "volume", F.avg("volume").over(w).alias("mean"), F.stddev_samp("volume").over(w).alias("dev"), F.count("*").over(w).alias("n"))
    peaks = rolled.where((F.col("n") == window) & (F.col("volume") > F.col("mean") + threshold * F.col("dev")))
    return peaks.select("day", "volume", F.round("mean", 3).alias("rolling_mean"), F.round("dev", 3).alias("rolling_std"))


def distribution(df: DataFrame, part: str, date: str = "date_received") -> DataFrame:
    """(value, n, pct) by ``hour``, ``weekday`` (Monday 0) or ``day_name``."""
    value = {"hour": F.hour(date), "weekday": F.weekday(date), "day_name": F.date_format(date, "EEEE")}[part]
    n = df.where(F.col(date).isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n").cast("double") / n.agg(F.sum("n")).scalar() * 100, 3))


def concentration(df: DataFrame, category: str = "category", date: str = "date_received") -> DataFrame:
    """(category, days, gini): Gini index of the daily counts of each category; 0 with fewer than two days."""
    per = df.where(F.col(date).isNotNull()).groupBy(category, F.to_date(date).alias("day")).agg(F.count("*").alias("x"))
    ranked = per.withColumn("i", F.row_number().over(Window.partitionBy(category).orderBy("x", "day")))
    sums = ranked.groupBy(category).agg(F.count("*").alias("days"), F.sum(F.col("i") * F.col("x")).cast("double").alias("ix"), F.sum("x").cast("double").alias("sx"))
    gini = 2 * F.col("ix") / (F.col("days") * F.col("sx")) - (F.col("days") + 1) / F.col("days").cast("double")
    return sums.select(category, "days", F.round(F.when(F.col("days") < 2, 0.0).otherwise(gini), 6).alias("gini"))


def top_values(df: DataFrame, category: str, value, k: int = 3) -> DataFrame:
    """(category, value, n, rank): the k most frequent values of each category, lower value first on ties."""
    n = df.groupBy(F.col(category), value.alias("value")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(category).orderBy(F.desc("n"), "value"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def category_profile(df: DataFrame, category: str = "category", date: str = "date_received") -> DataFrame:
    """(category, n, per_day, top_hours, top_days): mail a day over the distinct days of all mail, three top hours and dates."""
    days = df.select(F.to_date(date).alias("d")).where("d is not null").distinct().agg(F.count("*"))
    total = df.where(F.col(date).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    text = lambda t: t.groupBy(category).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda r: r["value"].cast("string")), ",").alias("v"))
    hours = text(top_values(df, category, F.hour(date))).withColumnRenamed("v", "top_hours")
    dates = text(top_values(df, category, F.to_date(date))).withColumnRenamed("v", "top_days")
    out = total.join(hours, category).join(dates, category)
    return out.select(category, "n", F.round(F.col("n") / days.scalar(), 3).alias("per_day"), "top_hours", "top_days")
