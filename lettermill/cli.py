"""Command line: analyse, search, export and convert mailboxes.

    python -m lettermill.cli analyze --input mail.parquet [--date D | --yesterday | --date-range A B] [--output DIR] [--format json|csv|text]
    python -m lettermill.cli convert --input DIR --output mail.parquet
    python -m lettermill.cli search --input mail.parquet --query 'from:ann -is:unread'
    python -m lettermill.cli export --input mail.parquet --output DIR [--by year_month|sender_domain]
    python -m lettermill.cli manifest --input DIR --output FILE

``analyze`` ends with status 2 if the quality gates fail.
"""

import argparse
import datetime
import json
import sys

from pyspark.sql import functions as F

from lettermill.config import AnalysisConfig
from lettermill.operators import insights, quality, rules, search, senders
from lettermill.schema import to_mail
from lettermill.session import get_session
from lettermill.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lettermill", description=__doc__.split("\n\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "convert", "search", "export", "manifest"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--output")
        s.add_argument("--master")
        if name == "analyze":
            day = s.add_mutually_exclusive_group()
            day.add_argument("--date")
            day.add_argument("--yesterday", action="store_true")
            day.add_argument("--date-range", nargs=2)
            s.add_argument("--config")
            s.add_argument("--format", choices=("json", "csv", "text"), default="text")
            s.add_argument("--no-gate", action="store_true")
        if name == "search":
            s.add_argument("--query", required=True)
            s.add_argument("--limit", type=int, default=50)
        if name == "export":
            s.add_argument("--by", choices=("year_month", "sender_domain"), default="year_month")
            s.add_argument("--compression", default="snappy")
    return p


def analyze(spark, a) -> int:
    config = AnalysisConfig.load(a.config) if a.config else AnalysisConfig()
    mail = to_mail(readers.read_analysis_file(spark, a.input))
    if a.date or a.yesterday:
        mail = search.on_day(mail, a.date or str(datetime.date.today() - datetime.timedelta(days=1)))
    elif a.date_range:
        mail = search.between_days(mail, *a.date_range, whole_last_day=True)
    try:
        quality.require_quality(mail.select("gmail_id", "date_received", "subject", "sender", "body"), config.thresholds(), strict=not a.no_gate)
    except quality.QualityError as e:
        print(f"quality gates failed: {e}", file=sys.stderr)
        return 2
    classified = rules.classify(mail, config.rules()).cache()
    summary = senders.with_share(classified.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence")))
    found = insights.insights(classified)
    if a.format == "text":
        print(insights.text_report(summary, found))
    if a.output:
        writers.write_report(summary, f"{a.output}/categories", "csv" if a.format == "csv" else "json")
        writers.write_report(found, f"{a.output}/insights", "json")
    elif a.format == "json":
        # A row for each category and rule: bounded by the configuration.
        print(json.dumps({"categories": [r.asDict() for r in summary.collect()], "insights": [r.asDict() for r in found.collect()]}))
    classified.unpersist()
    return 0


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    spark = get_session(a.master)
    if a.command == "analyze":
        return analyze(spark, a)
    if a.command == "convert":
        readers.read_directory(spark, a.input).write.mode("overwrite").parquet(a.output)
    elif a.command == "search":
        mail = to_mail(readers.read_analysis_file(spark, a.input))
        for r in mail.where(search.mail_query(a.query)).orderBy(F.desc("date_received"), "gmail_id").limit(a.limit).select("gmail_id", "date_received", "sender", "subject").collect():
            print(*r, sep="\t")
    elif a.command == "export":
        writers.write_partitioned(to_mail(readers.read_analysis_file(spark, a.input)), a.output, a.by, a.compression)
    else:
        writers.write_manifest(readers.file_manifest(spark, a.input), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
