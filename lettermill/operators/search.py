"""Search: mailbox queries as predicates, substring search, and full text with BM25 over an inverted index."""

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between_days(df: DataFrame, first: str, last: str, date: str = "date_received", whole_last_day: bool = False) -> DataFrame:
    """Mail from ``first`` to ``last``; as the source of the rule has it, the last day counts at midnight only, unless ``whole_last_day``."""
    end = F.expr(f"timestamp_ntz'{last}'")
    until = (F.col(date) < end + F.expr("interval 1 day")) if whole_last_day else (F.col(date) <= end)
    return df.where((F.col(date) >= F.expr(f"timestamp_ntz'{first}'")) & until)


def on_day(df: DataFrame, day: str, date: str = "date_received") -> DataFrame:
    """Mail of one day, as a half-open range, so that the scan can prune by it."""
    start = F.expr(f"timestamp_ntz'{day}'")
    return df.where((F.col(date) >= start) & (F.col(date) < start + F.expr("interval 1 day")))


def like_search(df: DataFrame, text: str, limit: int = 50, columns=("subject", "body", "sender"), newest: str = "date_received", key: str = "gmail_id") -> DataFrame:
    """The newest ``limit`` rows with ``text`` as a substring, letter case ignored."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return df.where(hit).orderBy(F.desc(newest), key).limit(limit)


#: Columns that the operators of a mailbox query look at; a DataFrame needs those that its queries name.
QUERY_COLUMNS = {
    "from": "sender", "to": "to", "cc": "cc", "bcc": "bcc", "deliveredto": "delivered_to", "subject": "subject", "body": "body", "filename": "attachments", "rfc822msgid": "message_id",
    "labels": "labels", "date": "date_received", "size": "size",
}
#: ``has:`` of things that a mail links to: what the body holds then.
LINKED = {"drive": "drive.google.com", "document": "docs.google.com/document", "spreadsheet": "docs.google.com/spreadsheets", "presentation": "docs.google.com/presentation", "youtube": "youtu"}
_TOKEN = re.compile(r'(-)?(?:(\w+):)?("[^"]*"|[({]|[^\s(){}"]+)|([)}])')


def mail_query(query: str, now: str | None = None, columns: dict[str, str] | None = None, **named: str) -> Column:
    """A mailbox query as a predicate. Terms: words and "phrases" anywhere, and the 20 operators
    ``from: to: cc: bcc: deliveredto: subject: filename: rfc822msgid: has: is: in: category: label: circle: before: after: older_than: newer_than: larger: smaller:``.
    ``-`` is not, ``OR`` joins its neighbours, ``( )`` groups, ``{ }`` is any of; an operator before a group holds for its plain terms.

    ``now`` fixes the day that relative dates count from. ``columns`` (or keywords by operator name) replaces entries of ``QUERY_COLUMNS``.
    """
    query = re.sub(r"\s+", " ", query).strip()
    if len(query) > 1000:
        raise ValueError("a query has at most 1000 characters")
    at = QUERY_COLUMNS | (columns or {}) | named
    today = F.expr(f"timestamp_ntz'{now}'") if now else F.localtimestamp()
    low = lambda name: F.lower(F.coalesce(F.col(at[name]).cast("string"), F.lit("")))

    def days(v: str) -> Column:
        if not re.fullmatch(r"\d+[dwmy]", v):
            raise ValueError(f"no time span: {v}")
        return F.make_interval(*[F.lit(int(v[:-1]) if v[-1] == unit else 0) for unit in "ymwd"])

    def size(v: str) -> float:
        scale = {"k": 1e3, "m": 1e6, "g": 1e9}.get(v[-1])
        return float(v[:-1]) * scale if scale else float(v)

    def labelled(word: str) -> Column:
        return F.exists(F.coalesce(F.col(at["labels"]), F.array().cast("array<string>")), lambda x: F.lower(x) == word)

    def term(name: str | None, v: str) -> Column:
        if name is None:
            return low("subject").contains(v) | low("body").contains(v) | low("from").contains(v)
        if name in ("from", "to", "cc", "bcc", "deliveredto", "subject", "filename"):
            return low(name).contains(v)
        if name == "rfc822msgid":
            return F.translate(low(name), "<>", "") == v.strip("<>")
        if name == "has":
            return low("body").contains(LINKED[v]) if v in LINKED else labelled(v)
        if name == "in" and v == "anywhere":
            return F.lit(True)
        if name in ("is", "in", "label", "category", "circle"):
            return labelled(f"{name}_{v}" if name in ("category", "circle") else v)
        if name in ("before", "after"):
            day = F.expr(f"timestamp_ntz'{'-'.join(map(str, map(int, re.split('[/-]', v))))}'")
            return F.col(at["date"]) < day if name == "before" else F.col(at["date"]) >= day
        if name in ("older_than", "newer_than"):
            return F.col(at["date"]) < today - days(v) if name == "older_than" else F.col(at["date"]) >= today - days(v)
        if name in ("larger", "smaller"):
            return F.col(at["size"]) > size(v) if name == "larger" else F.col(at["size"]) < size(v)
        raise ValueError(f"unknown operator {name}:")

    tokens = _TOKEN.findall(query)[::-1]

    def group(end: str, name: str | None) -> Column:
        """The terms up to ``end``: any of them in braces, else all, where OR joins two neighbours."""
        alternatives: list[list[Column]] = []
        joined = False
        while tokens:
            sign, own, value, close = tokens.pop()
            if close:
                if close != end:
                    raise ValueError(f"unexpected {close}")
                break
            if value == "OR" and not own:
                joined = True
                continue
            inner = own.lower() or name
            one = group(")" if value == "(" else "}", inner) if value in ("(", "{") else term(inner, value.strip('"').lower())
            one = ~one if sign else one
            if joined and alternatives:
                alternatives[-1].append(one)
            else:
                alternatives.append([one])
            joined = False
        else:
            if end:
                raise ValueError(f"{end} is missing")
        every = [reduce(or_, some) for some in alternatives]
        return reduce(or_ if end == "}" else and_, every) if every else F.lit(True)

    return group("", None)


#: Weight of a term by field.
FIELDS = {"subject": 2.0, "body": 1.0, "sender": 1.0}
K1, B = 1.2, 0.75


def postings(df: DataFrame, key: str = "gmail_id", fields=tuple(FIELDS)) -> DataFrame:
    """The inverted index: (term, key, field, tf). Terms are lower-case runs of letters and digits."""
    text = lambda f: F.filter(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    rows = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("terms")) for f in fields])).alias("x"))
    return rows.select(key, "x.field", F.explode("x.terms").alias("term")).groupBy("term", key, "field").agg(F.count("*").alias("tf"))


def update_postings(index: DataFrame, delta: DataFrame, deleted: DataFrame | None = None, key: str = "gmail_id", fields=tuple(FIELDS)) -> DataFrame:
    """The index after inserts and updates (the mails of ``delta``, each id once) and the deletions of the ids in ``deleted``.

    Only ids are joined with the old index; only the delta's texts are read.
    """
    gone = delta.select(key) if deleted is None else delta.select(key).unionByName(deleted.select(key))
    return index.join(gone.distinct(), key, "left_anti").select(*index.columns).unionByName(postings(delta, key, fields).select(*index.columns))


def bm25_search(df: DataFrame, query: str, limit: int = 50, key: str = "gmail_id", fields=tuple(FIELDS)) -> DataFrame:
    """(key, score) of the best ``limit`` rows that hold all terms of ``query`` (terms with a trailing * are prefixes).

    Two scans of the texts: one for the counts, one for the scores. ``postings`` and ``update_postings`` keep an index for other uses.
    """
    terms = [t for t in re.split(r"\s+", query.lower()) if t]
    texts = {f: F.filter(F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "") for f in fields}
    rows = df.select(key, *[texts[f].alias(f) for f in fields]).withColumn("dl", sum((F.size(f) for f in fields), F.lit(0)))
    fits = lambda t: (lambda x: x.startswith(t[:-1])) if t.endswith("*") else (lambda x: x == t)
    tf = [sum((F.size(F.filter(F.col(f), fits(t))) * F.lit(FIELDS.get(f, 1.0)) for f in fields), F.lit(0.0)) for t in terms]
    rows = rows.select(key, "dl", *[x.cast("double").alias(f"tf_{i}") for i, x in enumerate(tf)])
    stats = rows.agg(F.count("*").alias("total"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]).first()
    every, score = F.lit(True), F.lit(0.0)
    for i in range(len(terms)):
        f = F.col(f"tf_{i}")
        idf = F.lit(float(math.log(1 + (stats["total"] - stats[f"df_{i}"] + 0.5) / (stats[f"df_{i}"] + 0.5))))
        every = every & (f > 0)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(float(stats["avg"] or 1.0))))
    return rows.where(every).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def segment_counts(df: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """(segment, n): all named predicates counted in one pass."""
    one = df.agg(*[F.count_if(c).alias(name) for name, c in segments.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.col(n).alias("n")) for n in segments])).alias("r")).select("r.*")


def first_rows(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__r") <= k).drop("__r")
