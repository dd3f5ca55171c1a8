"""Data-quality metrics and gates over a mail table."""

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lettermill.functions import packs


@dataclass(frozen=True)
class Thresholds:
    min_completeness: float = 95.0
    max_null_rate: float = 5.0


def pct(part: Column, whole: Column, digits: int = 3) -> Column:
    """Percentage, 0 where the whole is 0; always double."""
    return F.round(F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(0.0), digits)


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, missing, total, completeness) per column and one row '*' over all: one pass, all columns in one aggregate."""
    columns = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(columns)])
    whole = sum((F.col(f"n_{i}") for i in range(len(columns))), F.lit(0))
    rows = [F.struct(F.lit(c).alias("field"), (F.col("total") - F.col(f"n_{i}")).alias("missing"), F.col("total").alias("total")) for i, c in enumerate(columns)]
    rows.append(F.struct(F.lit("*").alias("field"), (F.col("total") * len(columns) - whole).alias("missing"), (F.col("total") * len(columns)).alias("total")))
    long = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.withColumn("completeness", pct(F.col("total") - F.col("missing"), F.col("total")))


def uniqueness(df: DataFrame, key: str = "gmail_id") -> DataFrame:
    """(total, distinct_ids, duplicates, uniqueness_rate); null is one value. Distinct ids are found by a two-level aggregate."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_ids"))
    return out.select("total", "distinct_ids", (F.col("total") - F.col("distinct_ids")).alias("duplicates"), pct(F.col("distinct_ids"), F.col("total")).alias("uniqueness_rate"))


def validity(df: DataFrame, date: str = "date_received", sender: str = "sender") -> DataFrame:
    """(valid_dates, min_date, max_date, span_days, valid_emails, invalid_emails, email_validity): span is in whole days, rounded down."""
    found = F.regexp_extract(F.col(sender), packs.FOUND_ADDRESS, 0)
    good = found.rlike(packs.VALID_ADDRESS)
    out = df.agg(
        F.count(date).alias("valid_dates"), F.min(date).alias("min_date"), F.max(date).alias("max_date"),
        F.count_if(good).alias("valid_emails"), F.count_if(F.col(sender).isNotNull() & ~good).alias("invalid_emails"),
    )
    span = F.floor((F.unix_micros(F.col("max_date").cast("timestamp")) - F.unix_micros(F.col("min_date").cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
    return out.withColumns({"span_days": F.coalesce(span, F.lit(0)), "email_validity": pct(F.col("valid_emails"), F.col("valid_emails") + F.col("invalid_emails"))})


def gate_issues(df: DataFrame, thresholds: Thresholds = Thresholds(), key: str = "gmail_id") -> DataFrame:
    """(issue, field, measured): one row for each gate that fails; no rows means that the table passes."""
    c = completeness(df)
    low = c.where((F.col("field") == "*") & (F.col("completeness") < thresholds.min_completeness)).select(F.lit("low_completeness").alias("issue"), "field", F.col("completeness").alias("measured"))
    nulls = c.where((F.col("field") != "*") & (100 - F.col("completeness") > thresholds.max_null_rate)).select(F.lit("high_null_rate").alias("issue"), "field", F.round(100 - F.col("completeness"), 3).alias("measured"))
    dups = uniqueness(df, key).where("duplicates > 0").select(F.lit("duplicate_ids").alias("issue"), F.lit(key).alias("field"), F.col("duplicates").cast("double").alias("measured"))
    return low.unionByName(nulls).unionByName(dups)


class QualityError(ValueError):
    """A table that does not pass its gates."""


def require_quality(df: DataFrame, thresholds: Thresholds = Thresholds(), strict: bool = True) -> DataFrame:
    """``df`` if it passes the gates (or ``strict`` is off), else QualityError. Runs the gates' aggregates at once."""
    if strict:
        found = [f"{r['issue']} {r['field']}: {r['measured']}" for r in gate_issues(df, thresholds).limit(20).collect()]
        if found:
            raise QualityError("; ".join(found))
    return df


def gated_report(mail: DataFrame, work: Callable[[DataFrame], DataFrame], carry: list[str], report: Callable[[DataFrame], DataFrame], thresholds: Thresholds = Thresholds(), key: str = "gmail_id") -> DataFrame:
    """``report(work(mail))`` if ``mail`` passes its gates, else QualityError; both from one scan.

    ``work`` adds the columns ``carry``, row by row, and ``report`` sums them up to a few rows, which go by way of the driver. Rows are
    brought together by id, where duplicates show; what the gates count is observed on the way. Of a table that passes, each id is one row.
    """
    columns = mail.columns
    there = {f"__n{i}": F.col(c).isNotNull().cast("int") for i, c in enumerate(columns)}
    rows = work(mail.withColumns(there)).groupBy(key).agg(F.count("*").alias("__rows"), *[F.sum(n).alias(n) for n in there], *[F.first(c).alias(c) for c in carry])
    seen = Observation(f"gate-{uuid.uuid4().hex[:8]}")
    watched = rows.observe(seen, F.coalesce(F.sum("__rows"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("ids"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in there])
    out = report(watched.select(key, *carry))
    found, n = out.collect(), seen.get
    share = lambda part, whole: round(part / whole * 100, 3) if whole else 0.0
    whole = share(sum(n[c] for c in there), n["total"] * len(columns))
    issues = [f"low_completeness *: {whole}"] if whole < thresholds.min_completeness else []
    issues += [f"high_null_rate {c}: {round(100 - share(n[x], n['total']), 3)}" for c, x in zip(columns, there, strict=True) if 100 - share(n[x], n["total"]) > thresholds.max_null_rate]
    issues += [f"duplicate_ids {key}: {float(n['total'] - n['ids'])}"] if n["total"] > n["ids"] else []
    if issues:
        raise QualityError("; ".join(issues))
    return mail.sparkSession.createDataFrame(found, out.schema)
