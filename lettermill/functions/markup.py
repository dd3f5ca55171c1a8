"""Markup functions as column expressions: tidying, quality of a Markdown rendering, front matter, repairs; record redaction."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.functions import text

SENSITIVE = ("email", "sender", "recipient", "phone", "ssn", "password", "token", "address", "from", "to", "cc", "bcc")
MARK = "***REDACTED***"


def clean_html(page: Column) -> Column:
    """Without scripts, styles, metadata, comments, and images that are one pixel wide or hidden."""
    for pattern in (r"(?is)<(script|style|noscript)\b.*?</\1\s*>", r"(?is)<(?:meta|link)\b[^>]*>", r"(?s)<!--.*?-->", r"""(?is)<img\b[^>]*(?:(?:width|height)\s*=\s*["']?[01]["'\s>]|display\s*:\s*none)[^>]*>?"""):
        page = F.regexp_replace(page, pattern, "")
    return page


def html_text(page: Column) -> Column:
    """The text of a page: tags become spaces, references are decoded, white space is one space."""
    bare = F.regexp_replace(clean_html(page), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(text.unescape(bare), r"\s+", " "))


def tidy_markdown(md: Column) -> Column:
    """Headings and lists with a space, at most one blank line, no spaces at line ends."""
    for pattern, new in ((r"\r\n?", "\n"), (r"(?m)[ \t]+$", ""), (r"(?m)^(#{1,6})([^#\s])", "$1 $2"), (r"(?m)^([*+])\s+", "- "), (r"\n{3,}", "\n\n")):
        md = F.regexp_replace(md, pattern, new)
    return md


def markdown_quality(md: Column, page_text: Column) -> Column:
    """0.4 kept length + 0.3 structure + 0.2 line length + 0.1 form, at most 1; 0 for an empty rendering."""
    flag = lambda c: c.cast("int").cast("double")
    kept = F.when(F.length(F.trim(page_text)) > 0, F.least(F.length(F.trim(md)) / F.length(F.trim(page_text)), F.lit(1.0))).otherwise(0.0)
    structure = (flag(md.rlike(r"(?m)^#{1,6}\s")) + flag(md.rlike(r"(?m)^[*\-+\d.]\s")) + flag(md.rlike(r"\[.+\]\(.+\)"))) / F.lit(3.0)
    lines = F.filter(F.split(md, "\n"), lambda x: F.length(F.trim(x)) > 0)
    mean = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.greatest(F.size(lines), F.lit(1))
    readable = F.when(F.size(lines) > 0, F.when(mean.between(20, 120), 1.0).otherwise(0.5)).otherwise(0.0)
    form = (flag(~md.rlike(r"\n{4,}")) + flag(~md.rlike(r"(?m)^#{1,6}[^#\s]"))) / F.lit(2.0)
    score = kept * 0.4 + structure * 0.3 + readable * 0.2 + form * 0.1
    return F.when(F.length(F.trim(md)) == 0, 0.0).otherwise(F.least(score.cast("double"), F.lit(1.0)))


def best_rendering(candidates: dict[str, tuple[Column, Column]]) -> Column:
    """struct<quality, name, text> of the best of {name: (text, quality)}; the first named wins ties."""
    rows = [F.struct(F.round(q, 6).alias("quality"), F.lit(-i).alias("i"), F.lit(n).alias("name"), t.alias("text")) for i, (n, (t, q)) in enumerate(candidates.items())]
    top = F.array_max(F.array(*rows))
    return F.struct(top["quality"].alias("quality"), top["name"].alias("name"), top["text"].alias("text"))


def rewrite_cid(md: Column, paths: Column) -> Column:
    """``](cid:x)`` becomes the attachment's path from the map ``paths``."""
    return F.aggregate(F.map_entries(paths), md, lambda a, e: F.replace(a, F.concat(F.lit("](cid:"), e["key"], F.lit(")")), F.concat(F.lit("]("), e["value"], F.lit(")"))))


def front_matter(headers: dict[str, Column]) -> Column:
    """YAML front matter with quoted values; nulls are left out."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), quote(F.regexp_replace(c, r"\s+", " ")))) for k, c in headers.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def repair_line_ends(raw: Column) -> Column:
    r"""Every line end as \r\n: doubled returns, lone returns and lone newlines."""
    return F.regexp_replace(raw, r"\r*\n|\r+", "\r\n")


def looks_like_mail(raw: Column) -> Column:
    """At least five lines, a colon in the first, and a blank line."""
    return (F.size(F.split(raw, r"\r?\n")) >= 5) & F.split_part(raw, F.lit("\n"), F.lit(1)).contains(":") & raw.rlike(r"\r?\n\r?\n")


def wrap(md: Column, width: int = 100) -> Column:
    """Paragraph lines broken at the last space before ``width``; quoted, indented, table, list and heading lines stay."""
    broken = F.transform(F.split(md, "\n"), lambda x: F.when(x.rlike(r"^(?:[>|#\-*+]|\s|\d+\.|```)"), x).otherwise(F.regexp_replace(x, rf"(.{{1,{width}}})(?: +|$)", "$1\n")))
    return F.regexp_replace(F.array_join(broken, "\n"), r"\n(\n|$)", "$1")


def redact_record(df: DataFrame, sensitive=SENSITIVE) -> DataFrame:
    """``df`` with sensitive fields replaced by a mark, in structs, arrays and map keys too; other strings have their personal data replaced."""

    def walk(c: Column, kind: T.DataType, name: str) -> Column:
        secret = any(s == name.lower() or name.lower().endswith("_" + s) for s in sensitive)
        if isinstance(kind, T.StringType):
            return F.when(c.isNotNull(), F.lit(MARK)) if secret else text.redact(c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, f.name).alias(f.name) for f in kind]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, name))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*sensitive), F.lit(MARK)).otherwise(text.redact(v)))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema])


def size_estimate(df: DataFrame) -> Column:
    """Bytes of a row as JSON."""
    return F.octet_length(F.to_json(F.struct(*df.columns)))


def error_class(status: Column, message: Column) -> Column:
    """struct<category, severity, recoverable> of a failure by HTTP status, else by its message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    rules = [
        (status == 401, "authentication", "high", False), ((status == 403) & m.contains("quota"), "quota", "high", True), (status == 403, "permission", "high", False),
        (status == 429, "rate_limit", "medium", True), (status >= 500, "network", "medium", True), (status.isNotNull(), "api", "medium", True),
        (m.contains("permission denied"), "permission", "high", False), (m.contains("no such file"), "file", "medium", True), (m.contains("no space"), "disk", "critical", False),
        (m.contains("memory"), "memory", "critical", False), (m.contains("invalid") | m.contains("valueerror"), "validation", "low", True),
    ]
    row = lambda c, s, r: F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(r).alias("recoverable"))
    out = row("unknown", "medium", True)
    for test, c, s, r in reversed(rules):
        out = F.when(test, row(c, s, r)).otherwise(out)
    return out


def valid_integer(value: Column, low: int, high: int) -> Column:
    """The integer if it is one from low to high, else null."""
    n = value.try_cast("int")
    return F.when(n.between(low, high), n)


def count_of(page: Column, tags) -> Column:
    return reduce(add, [F.regexp_count(page, F.lit(rf"(?i)<{t}\b")) for t in tags])
