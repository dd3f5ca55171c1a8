"""Text functions as column expressions: addresses, URLs, file names, personal data, Markdown, dates."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions import packs


def export_domain(sender: Column) -> Column:
    """Inside <> else whole, after the first @, lower case; '' without one."""
    inside = F.coalesce(F.nullif(F.regexp_extract(sender, r"<([^>]*)>", 1), F.lit("")), sender)
    return F.lower(F.coalesce(F.when(inside.contains("@"), F.split_part(inside, F.lit("@"), F.lit(2))), F.lit("")))


def host_of(text: Column) -> Column:
    """Host of an address (after the last @) or of a URL, lower case."""
    return F.lower(F.when(text.contains("@"), F.substring_index(text, "@", -1)).when(text.contains("http"), F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).otherwise(text))


def parse_address(header: Column) -> Column:
    """struct<address, display_name>: ``Name <a@b>`` or a bare address; addresses are lower-cased."""
    bracket = F.regexp_extract(header, r"<([^<>\s]+@[^<>\s]+)>", 1)
    bare = F.regexp_extract(header, r"([^\s<>,;\"']+@[^\s<>,;\"']+)", 1)
    name = F.trim(F.regexp_replace(F.when(bracket != "", F.regexp_extract(header, r"^([^<]*)<", 1)).otherwise(F.lit("")), '["\']', ""))
    return F.struct(F.lower(F.coalesce(F.nullif(bracket, F.lit("")), F.nullif(bare, F.lit("")))).alias("address"), F.nullif(name, F.lit("")).alias("display_name"))


def split_addresses(header: Column) -> Column:
    """Comma-split, trimmed, without empty parts; quoted commas are not special."""
    return F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")


def valid_address(address: Column) -> Column:
    a = F.lower(F.trim(address))
    return (F.length(a) <= 254) & a.rlike(packs.VALID_ADDRESS)


def valid_date(text: Column) -> Column:
    """Absolute dates with - or / (year first or last), and relative ones: 3d, 2w, 1m, 1y, today, yesterday."""
    return text.rlike(r"^(\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d+[dwmy]|today|yesterday)$")


def sanitise_filename(name: Column, longest: int = 200) -> Column:
    """Reserved characters become _, control characters go, dots and spaces at the ends go; the extension survives the cut."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f]", "")
    clean = F.regexp_replace(clean, r"^[. ]+|[. ]+$", "")
    ext = F.regexp_extract(clean, r"(\.[A-Za-z0-9]{1,10})$", 1)
    cut = F.concat(F.left(clean, F.lit(longest) - F.length(ext)), ext)
    return F.when(clean == "", "unnamed").when(F.length(clean) > longest, cut).otherwise(clean)


def message_id(file_name: Column) -> Column:
    """The hexadecimal id at the end of a saved mail's file name, else null."""
    return F.nullif(F.regexp_extract(file_name, r"([0-9a-f]{8,})\.(?:eml|md)$", 1), F.lit(""))


def strip_tracking(url: Column) -> Column:
    """The URL without query parameters whose name contains a tracking token."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    head, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    bad = lambda p: reduce(lambda a, b: a | b, [F.lower(F.split_part(p, F.lit("="), F.lit(1))).contains(t) for t in packs.TRACKING])
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~bad(p) & (p != "")), "&")
    return F.concat(head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), tail)


def repair_url(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit("[broken]"), url)).otherwise(url)


def redact(text: Column) -> Column:
    """Cards, then SSNs, addresses, phone numbers, IPs are replaced by their marks, in this order."""
    for _, pattern, mark in packs.PII:
        text = F.regexp_replace(text, pattern, mark.replace("$", r"\$"))
    return text


def count_pii(text: Column) -> dict[str, Column]:
    """How many marks of each kind ``redact`` leaves in the text."""
    done = redact(text)
    return {kind: F.coalesce(F.regexp_count(done, F.lit(mark.replace("[", r"\[").replace("]", r"\]"))), F.lit(0)) for kind, _, mark in packs.PII}


def mask_address(address: Column) -> Column:
    """jo***@host"""
    local, host = F.split_part(address, F.lit("@"), F.lit(1)), F.split_part(address, F.lit("@"), F.lit(2))
    return F.when(address.contains("@"), F.concat(F.left(local, F.lit(2)), F.lit("***@"), host)).otherwise(F.lit("***"))


def mask_subject(subject: Column, keep: int = 30) -> Column:
    return F.when(F.length(subject) > keep, F.concat(F.left(subject, F.lit(keep)), F.lit("..."))).otherwise(subject)


def mask_phone(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"\D", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))).otherwise(F.lit("***"))


def truncate(text: Column, n: int = 50) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """The common character references; the ampersand's last."""
    for name, letter in _ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def markdown_to_plain(text: Column) -> Column:
    """Markdown without its marks: tables, headings, emphasis, links as ``text (url)``, code, quotes, rules, lists, escapes, blank runs."""
    steps = [
        (r"(?m)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*(?:-{3,})?\s*$", ""), (r"(?m)^\|\s*", ""), (r"(?m)\s*\|\s*$", ""), (r" *\| *", " "),
        (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"__(.+?)__", "$1"), (r"\b_([^_\n]+)_\b", "$1"),
        (r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)"), (r"(?m)^```.*$", ""), (r"`([^`]+)`", "$1"), (r"(?m)^>\s*", "  "), (r"(?m)^[-=]{3,}$", ""),
        (r"(?m)^\s*[-*+]\s+", "  • "), (r"(?m)^\s*\d+\.\s+", "  "), (r"\\(.)", "$1"), (r"(?m)[ \t]+$", ""), (r" {2,}", " "), (r"\n{3,}", "\n\n"),
    ]
    out = unescape(F.coalesce(text, F.lit("")))
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


_MAIL_DATES = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"]


def parse_mail_date(text: Column) -> Column:
    """RFC 2822 and common forms to a UTC timestamp; the weekday and a zone name in brackets are ignored; null if none fits."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", ""), r"\s*\([A-Za-z ]+\)\s*$", ""))
    clean = F.regexp_replace(clean, r"\b(?:GMT|UTC|UT)$", "+0000")
    tried = [F.try_to_timestamp(clean, F.lit(f)) for f in _MAIL_DATES]
    found = F.try_to_timestamp(F.nullif(F.regexp_extract(clean, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd"))
    return F.coalesce(*tried, found)


def header_date(raw: Column) -> Column:
    """The first ``Date:`` line of a raw message as a timestamp."""
    return parse_mail_date(F.nullif(F.trim(F.regexp_extract(raw, r"(?mi)^Date:[ \t]*([^\r\n]*)", 1)), F.lit("")))


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def backoff_seconds(attempt: Column, base: float = 1.0, cap: float = 300.0) -> Column:
    """base * 2^(attempt - 1), at most ``cap``; jitter is left to the caller."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def next_retry(failed_at: Column, attempt: Column, base: int = 300, most: int = 5) -> Column:
    """When to try again: 300 s doubling; null from the fifth attempt on."""
    return F.when(attempt < most, F.timestamp_micros(F.unix_micros(failed_at.cast("timestamp")) + (F.lit(base * 1_000_000) * F.pow(F.lit(2.0), attempt - 1)).cast("long")))
