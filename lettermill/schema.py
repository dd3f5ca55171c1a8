"""The canonical mail schema, and mapping of loose records to it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECIPIENT = T.StructType([T.StructField("address", T.StringType()), T.StructField("type", T.StringType()), T.StructField("display_name", T.StringType())])
MAIL = T.StructType([
    T.StructField("gmail_id", T.StringType()), T.StructField("thread_id", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("sender", T.StringType()),
    T.StructField("recipients", T.ArrayType(RECIPIENT)), T.StructField("date_received", T.TimestampNTZType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("snippet", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("body_html", T.StringType()), T.StructField("history_id", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("has_attachments", T.BooleanType()), T.StructField("source_file", T.StringType()), T.StructField("year_month", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()), T.StructField("deleted_at", T.TimestampNTZType()),
])
#: Names under which a field may come; the first that is there and not empty counts.
ALIASES = {
    "gmail_id": ("gmail_id", "id", "message_id"), "thread_id": ("thread_id", "threadId"), "sender": ("sender", "from"), "date_received": ("date_received", "date", "received_date", "parsed_date"),
    "snippet": ("snippet", "body_snippet"), "body": ("body", "body_plain", "body_text", "message_content", "plain_text_content", "content"), "size": ("size", "size_estimate", "sizeEstimate", "size_bytes"),
}


def _first(df: DataFrame, names, kind: T.DataType) -> Column:
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    if isinstance(kind, T.StringType):
        have = [F.nullif(c.cast("string"), F.lit("")) for c in have]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def to_mail(df: DataFrame) -> DataFrame:
    """Loose records in the canonical schema: fields by their aliases, dates parsed, comma labels split, the month derived; what is absent is null."""
    from lettermill.functions.text import parse_mail_date, year_month

    types = dict(df.dtypes)
    out = {}
    for field in MAIL:
        names = ALIASES.get(field.name, (field.name,))
        if field.name == "date_received":
            have = [parse_mail_date(F.col(f"`{n}`")).cast("timestamp_ntz") if types[n] == "string" else F.col(f"`{n}`").cast("timestamp_ntz") for n in names if n in types]
            out[field.name] = F.coalesce(*have) if have else F.lit(None).cast(field.dataType)
        elif field.name == "labels" and types.get("labels") == "string":
            out["labels"] = F.filter(F.transform(F.split("labels", ","), lambda x: F.trim(x)), lambda x: x != "")
        elif field.name not in ("year_month",):
            c = _first(df, names, field.dataType)
            out[field.name] = c.cast(field.dataType)
    mail = df.select(*[c.alias(n) for n, c in out.items()])
    return mail.withColumn("year_month", year_month(F.col("date_received"))).select(*MAIL.names)


def check_mail(df: DataFrame) -> DataFrame:
    """Rows that break a constraint, with ``problem``: no id, a month that is not YYYY-MM, an address over 254 characters."""
    problem = (
        F.when(F.col("gmail_id").isNull() | (F.col("gmail_id") == ""), "no id").when(F.col("year_month").isNotNull() & ~F.col("year_month").rlike(r"^\d{4}-\d{2}$"), "bad month").when(F.length("sender") > 254, "long address")
    )
    return df.withColumn("problem", problem).where("problem is not null")


def from_loose_json(lines: DataFrame, text: str = "value") -> DataFrame:
    """Mail from JSON records whose fields differ in type from row to row, as a column of texts; rows that are no JSON object are left out.

    Each record is a variant: a field is looked up by its aliases, the first that is there and not empty, and taken as what it is. Numbers are
    ids, ``labels`` are a list or one text with commas, dates are texts or milliseconds, recipients a list or one text.
    """
    from lettermill.functions.text import parse_address, parse_mail_date, split_addresses, year_month

    v = lines.select(F.try_parse_json(F.col(text)).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    got = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    is_list = lambda name: F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant")).startswith("ARRAY")
    one = lambda name: F.nullif(F.when(~F.coalesce(is_list(name), F.lit(False)), got(name, "string")), F.lit(""))
    every = lambda name, cut: F.when(is_list(name), got(name, "array<string>")).otherwise(cut(got(name, "string")))
    commas = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    when = lambda name: F.coalesce(F.timestamp_millis(got(name, "bigint")).cast("timestamp_ntz"), parse_mail_date(one(name)).cast("timestamp_ntz"))

    def recipient(kind: str):
        lists = F.transform(F.flatten(F.transform(F.coalesce(every(kind, split_addresses), F.array().cast("array<string>")), split_addresses)), parse_address)
        return F.transform(F.filter(lists, lambda a: a["address"].isNotNull()), lambda a: F.struct(a["address"].alias("address"), F.lit(kind).alias("type"), a["display_name"].alias("display_name")))

    out = {}
    for field in MAIL:
        names = ALIASES.get(field.name, (field.name,))
        if field.name == "date_received":
            out[field.name] = F.coalesce(*[when(n) for n in names])
        elif field.name == "labels":
            out[field.name] = F.coalesce(every("labels", commas), every("labelIds", commas))
        elif field.name == "recipients":
            out[field.name] = F.concat(*[recipient(kind) for kind in ("to", "cc", "bcc")])
        elif isinstance(field.dataType, T.StringType):
            out[field.name] = F.coalesce(*[one(n) for n in names])
        elif field.name != "year_month":
            out[field.name] = F.coalesce(*[got(n, field.dataType.simpleString()) for n in names]).cast(field.dataType)
    mail = v.select(*[c.cast(MAIL[n].dataType).alias(n) for n, c in out.items()])
    return mail.withColumn("year_month", year_month(F.col("date_received"))).select(*MAIL.names)
