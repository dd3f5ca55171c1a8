"""Writers: partitioned Parquet, monthly JSON, EML, Markdown, mbox, reports, manifests. Spark commits each write as a whole."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import sanitise_filename
from lettermill.operators import store


def write_partitioned(mail: DataFrame, path: str, by: str = "year_month", compression: str = "snappy", include_deleted: bool = False) -> DataFrame:
    """Export rows by month or sender domain, a folder ``by=value`` each; rows without a value are left out. Returns (value, n) of what is there.

    Rows are dealt by partition and a salt before the write, so that a hot partition is written by several tasks.
    """
    if not include_deleted and "deleted_at" in mail.columns:
        mail = store.live(mail)
    rows = store.export_rows(mail).where(F.col(by).isNotNull() & (F.col(by) != ""))
    rows = rows.hint("rebalance", by)
    rows.write.mode("overwrite").partitionBy(by).option("compression", compression).parquet(path)
    return mail.sparkSession.read.parquet(path).groupBy(by).agg(F.count("*").alias("n"))


def write_monthly_json(mail: DataFrame, path: str) -> None:
    """Mail by month as JSON lines, a folder each; mail without a date is in ``unknown``."""
    m = mail.withColumn("year_month", F.coalesce(F.date_format("date_received", "yyyy-MM"), F.lit("unknown")))
    m.sortWithinPartitions("year_month", "date_received", "gmail_id").write.mode("overwrite").partitionBy("year_month").json(path)


def eml_text(sender="sender", to="to", subject="subject", date="date_received", body="body", html="body_html", key="gmail_id") -> Column:
    """One message as RFC 5322 text; multipart/alternative if both bodies are there."""
    v = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ")
    head = F.concat_ws("\r\n", *[F.concat(F.lit(f"{n}: "), v(c)) for n, c in (("From", sender), ("To", to), ("Subject", subject))], F.concat(F.lit("Date: "), F.coalesce(F.date_format(date, "d MMM yyyy HH:mm:ss '+0000'"), F.lit(""))), F.concat(F.lit("X-Gmail-ID: "), v(key)), F.lit("MIME-Version: 1.0"))
    mark = F.concat(F.lit("=_"), F.md5(v(key)))
    plain, page = F.coalesce(F.col(body), F.lit("")), F.col(html)
    one = F.concat(head, F.lit('\r\nContent-Type: text/plain; charset="utf-8"\r\n\r\n'), plain, F.lit("\r\n"))
    part = lambda kind, text: F.concat(F.lit("--"), mark, F.lit(f'\r\nContent-Type: text/{kind}; charset="utf-8"\r\n\r\n'), text, F.lit("\r\n"))
    both = F.concat(head, F.lit('\r\nContent-Type: multipart/alternative; boundary="'), mark, F.lit('"\r\n\r\n'), part("plain", plain), part("html", page), F.lit("--"), mark, F.lit("--\r\n"))
    return F.when(page.isNotNull() & (page != ""), both).otherwise(one)


def markdown_text(sender="sender", to="to", subject="subject", date="date_received", body="body", key="gmail_id") -> Column:
    """One message as Markdown: a metadata table and the body under ``## Message Content``."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    rows = [F.concat(F.lit(f"| {n} | "), cell(c), F.lit(" |")) for n, c in (("From", sender), ("To", to), ("Subject", subject), ("Date", date), ("Message ID", key))]
    return F.concat_ws("\n", F.lit("| Field | Value |"), F.lit("| --- | --- |"), *rows, F.lit(""), F.lit("## Message Content"), F.lit(""), F.coalesce(F.col(body), F.lit("")))


def mbox_text(**columns) -> Column:
    """One message of an mbox file: a ``From`` line, the message, a blank line; lines of the body that begin with From are quoted."""
    return F.concat(F.lit("From "), F.coalesce(F.col("sender"), F.lit("MAILER-DAEMON")), F.lit("\n"), F.regexp_replace(F.replace(eml_text(**columns), F.lit("\r\n"), F.lit("\n")), r"(?m)^From ", ">From "), F.lit("\n"))


def json_text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


class Outputs:
    """Named renderers of a message: eml, markdown, mbox, json, and what is registered."""

    def __init__(self):
        self.renderers: dict[str, Callable[[DataFrame], Column]] = {"eml": lambda df: eml_text(), "markdown": lambda df: markdown_text(), "mbox": lambda df: mbox_text(), "json": json_text}

    def register(self, name: str, render: Callable[[DataFrame], Column]) -> None:
        self.renderers[name] = render

    def generate(self, mail: DataFrame, name: str, organize_by: str = "date") -> DataFrame:
        """(folder, file_name, content): folders are YYYY/MM, the sender's local part, or none."""
        if name not in self.renderers:
            raise ValueError(f"unknown output: {name}")
        have = mail
        for c in ("to", "body_html"):
            have = have if c in have.columns else have.withColumn(c, F.lit(None).cast("string"))
        folder = {"date": F.coalesce(F.date_format("date_received", "yyyy/MM"), F.lit("unknown")), "sender": F.coalesce(F.nullif(F.split_part(F.col("sender"), F.lit("@"), F.lit(1)), F.lit("")), F.lit("unknown")), "none": F.lit("")}[organize_by]
        stem = F.concat_ws("_", F.date_format("date_received", "yyyy-MM-dd_HHmmss"), F.left(F.coalesce("subject", F.lit("")), F.lit(50)), F.col("gmail_id").cast("string"))
        return have.select(folder.alias("folder"), sanitise_filename(stem).alias("file_name"), self.renderers[name](have).alias("content"))

    def save(self, mail: DataFrame, name: str, path: str, organize_by: str = "date") -> None:
        """One text row per message, partitioned by folder (JSON lines, so that contents keep their line ends)."""
        self.generate(mail, name, organize_by).write.mode("overwrite").partitionBy("folder").json(path)


def write_report(result: DataFrame, path: str, kind: str = "json") -> None:
    """A small result (a row per category or rule) as one JSON or CSV file."""
    one = result.coalesce(1).write.mode("overwrite")
    one.json(path) if kind == "json" else one.option("header", True).csv(path)


def write_manifest(files: DataFrame, path: str) -> None:
    """path, sha256 and size as tab-separated values in the order of paths."""
    files.select("path", "sha256", "size").orderBy("path").write.mode("overwrite").option("sep", "\t").csv(path)


def write_dead_letters(letters: DataFrame, path: str) -> None:
    letters.orderBy(F.desc("last_failure"), "message_id").write.mode("overwrite").json(path)
