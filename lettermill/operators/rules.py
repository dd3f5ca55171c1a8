"""Rule packs compiled to column expressions: one CASE per classifier, no Python at run time."""

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import packs
from lettermill.functions.patterns import check_pattern


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int
    keywords: tuple[str, ...]
    senders: tuple[str, ...] = ()
    threshold: float = 0.8


def rule_pack(base=packs.BASE_RULES, custom=()) -> list[Rule]:
    """Rules in the order they are tried: by priority, base before custom at equal priority; a custom rule replaces a base rule of its name.

    A sender pattern that may backtrack without end is refused (UnsafePattern).
    """
    custom = [Rule(n, p, tuple(k), tuple(s), t) for n, p, k, s, t in custom]
    own = {r.name for r in custom}
    rules = [Rule(n, p, tuple(k), tuple(s), t) for n, p, k, s, t in base if n not in own] + custom
    for r in rules:
        for p in r.senders:
            check_pattern(p)
    return sorted(rules, key=lambda r: r.priority)


def mail_text(subject: str = "subject", body: str = "body") -> Column:
    """Lower-cased subject and body; nulls are empty."""
    return F.lower(F.concat_ws(" ", F.coalesce(F.col(subject), F.lit("")), F.coalesce(F.col(body), F.lit(""))))


def any_of(text: Column, words) -> Column:
    """Whether any word is a substring of ``text``."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def any_match(text: Column, patterns) -> Column:
    """Whether any pattern is found in ``text``; one alternation, so one pass and little generated code."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def hits(text: Column, words) -> Column:
    return reduce(add, [text.contains(w).cast("int") for w in words], F.lit(0))


def matches(text: Column, patterns) -> Column:
    return reduce(add, [text.rlike(p).cast("int") for p in patterns], F.lit(0))


def classify(df: DataFrame, rules: list[Rule] | None = None, cap: bool = True, subject: str = "subject", body: str = "body", sender: str = "sender") -> DataFrame:
    """``df`` with ``category, confidence, is_automated``.

    The first rule with a keyword in the text or a sender pattern wins, else 'Other' with confidence 0.5. Confidence is
    0.7 + 0.3 * (share of the rule's patterns that hit), with ``cap`` no more than the rule's threshold.
    """
    rules = rules if rules is not None else rule_pack()
    # The text is lower-cased once, in a projection of its own.
    df = df.withColumns({"__text": mail_text(subject, body), "__from": F.lower(F.coalesce(F.col(sender), F.lit("")))})
    text, who = F.col("__text"), F.col("__from")
    # The winner is a column of its own, so that each rule is tried once and only the winner's patterns are counted.
    winner = F.lit(-1)
    for i, r in reversed(list(enumerate(rules))):
        winner = F.when(any_of(text, r.keywords) | any_match(who, r.senders), i).otherwise(winner)
    df = df.withColumn("__rule", winner)
    category, confidence = F.lit("Other"), F.lit(0.5).cast("double")
    for i, r in enumerate(rules):
        total = len(r.keywords) + len(r.senders)
        score = F.lit(0.7).cast("double") + F.lit(0.3).cast("double") * F.least((hits(text, r.keywords) + matches(who, r.senders)) / F.lit(float(total)), F.lit(1.0).cast("double"))
        score = F.least(score, F.lit(float(r.threshold))) if cap else score
        wins = F.col("__rule") == i
        category = F.when(wins, F.lit(r.name)).otherwise(category)
        confidence = F.when(wins, F.round(score, 3)).otherwise(confidence)
    return df.withColumns({"category": category, "confidence": confidence, "is_automated": automated(who, F.coalesce(F.col(subject), F.lit("")))}).drop("__text", "__from", "__rule")


def automated(sender: Column, subject: Column) -> Column:
    """One point per automatic word in the (lower-cased) sender, half for a reply or alert subject, one for a mailing host: true from 1 on."""
    score = hits(sender, packs.AUTOMATED_SENDERS).cast("double")
    score = score + F.when(subject.rlike(packs.AUTOMATED_SUBJECT), 0.5).otherwise(0.0) + any_of(sender, packs.AUTOMATED_DOMAINS).cast("int")
    return score >= 1.0


def first_match(text: Column, groups: dict, test=any_match) -> Column:
    """The first group that ``test`` finds in ``text``, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(list(groups)):
        out = F.when(test(text, groups[name]), F.lit(name)).otherwise(out)
    return out


def three_signals(df: DataFrame, subject: str = "subject", body: str = "body", sender: str = "sender", labels: str = "labels", ignore_case: bool = False) -> DataFrame:
    """``df`` with the twelve results of the sender, subject and content classifiers and their merged confidence.

    Subjects are lower-cased before patterns such as ``^Re:`` are tried, so these never fit unless ``ignore_case``.
    A medium-priority word overrides a high one. ``labels`` is an array of strings.
    """
    counts = df.groupBy(F.col(sender).alias("__who")).agg(F.count("*").alias("sender_frequency"))
    df = df.withColumns({
        "__from": F.lower(F.coalesce(F.col(sender), F.lit(""))), "__subject": F.lower(F.coalesce(F.col(subject), F.lit(""))),
        "__body": F.lower(F.coalesce(F.col(body), F.lit(""))), "__labels": F.lower(F.coalesce(F.array_join(labels, ","), F.lit(""))),
    })
    who, title, text, tags = (F.col(c) for c in ("__from", "__subject", "__body", "__labels"))
    flags = "(?i)" if ignore_case else ""

    # What texts say comes first, so that a query that wants no texts moves none for the frequencies below.
    # Results that several others need are columns of their own, so that their code stands once in the plan.
    df = df.withColumns({"__pattern": first_match(who, packs.SENDER_PATTERNS), "__auto": any_of(who, packs.SOURCE_AUTOMATED), "__title": first_match(title, {k: [flags + p for p in v] for k, v in packs.SUBJECT_PATTERNS.items()})})
    # A fold over each word list: one small expression, where a sum of all words would outgrow a generated method.
    # Bytes are counted, since their number is known and that of characters is not.
    count = lambda acc, w: acc + F.floor((F.octet_length(text) - F.octet_length(F.replace(text, w, F.lit("")))) / F.octet_length(w))
    scores = {d: F.aggregate(F.array(*[F.lit(w) for w in words]), F.lit(0).cast("long"), count) for d, words in packs.DOMAIN_KEYWORDS.items()}
    df = df.withColumn("__scores", F.array(*[s.cast("int") for s in scores.values()]))
    best = F.array_max("__scores")
    df = df.withColumns({"__best": best, "__domain": F.when(best > 0, F.element_at(F.array(*[F.lit(d) for d in scores]), F.array_position("__scores", best).cast("int")))})
    df = df.withColumns({
        "__unsubscribe": text.contains("unsubscribe"), "__automation": F.least(hits(text, packs.AUTOMATION_INDICATORS) * F.lit(0.2).cast("double"), F.lit(1.0).cast("double")), "__has_text": text != "",
        "__thread": title.rlike("^(re:|fwd:|fw:)"), "__high": any_of(title, packs.PRIORITY_KEYWORDS["High"]), "__medium": any_of(title, packs.PRIORITY_KEYWORDS["Medium"]),
    })
    # Frequencies by an aggregate and a join, so that a very frequent sender is pre-aggregated and can be split.
    df = df.join(counts, F.col(sender).eqNullSafe(F.col("__who")), "left").drop("__who")
    known, unsubscribe, automation, has_text, thread, high, medium = (F.col(c) for c in ("sender_frequency", "__unsubscribe", "__automation", "__has_text", "__thread", "__high", "__medium"))
    by_pattern = F.col("__pattern")
    is_auto, often, once = F.col("__auto"), known > 50, known == 1
    source = F.when(is_auto, "Automated").when(by_pattern.isin("Newsletter", "Service_Notification"), "Semi-automated").otherwise("Human")
    from_sender = F.coalesce(by_pattern, F.when(often, "Newsletter").when(once, "Personal"))
    zero = F.lit(0.0).cast("double")
    num = lambda cond, x: F.when(cond, F.lit(float(x)).cast("double")).otherwise(zero)
    sender_score = num(by_pattern.isNotNull(), 0.8) + F.when(is_auto, 0.3).when(by_pattern.isin("Newsletter", "Service_Notification"), 0.2).otherwise(0.1).cast("double") + F.when(often, 0.4).when(once, 0.2).otherwise(0.0).cast("double")

    from_subject = F.col("__title")
    priority = F.when(medium, "Medium").when(high, "High").otherwise("Medium")
    subject_score = num(thread, 0.3) + num(from_subject.isNotNull(), 0.6) + num(high, 0.2) + num(medium, 0.2)

    best, domain = F.col("__best"), F.col("__domain")
    important, promo = tags.contains("important"), tags.contains("category_promotions")
    promo_domain = F.when(has_text & ~important & promo & domain.isNull(), "Shopping/Retail")
    content_score = F.when(has_text, num(unsubscribe, 0.3) + F.when(best > 0, F.least(best * F.lit(0.1).cast("double"), F.lit(0.5).cast("double"))).otherwise(zero) + F.when(important, 0.2).when(promo, 0.3).otherwise(0.0).cast("double")).otherwise(zero)

    total = sender_score * 0.4 + subject_score * 0.3 + content_score * 0.3
    trace = F.array_compact(F.array(
        F.when(by_pattern.isNotNull(), F.concat(F.lit("sender_pattern_"), by_pattern)), F.when(is_auto, F.lit("automated_sender")),
        F.when(often, F.lit("high_frequency_sender")), F.when(once, F.lit("single_email_sender")), F.when(thread, F.lit("thread_indicator")),
        F.when(from_subject.isNotNull(), F.concat(F.lit("subject_pattern_"), from_subject)), F.when(high, F.lit("priority_High")), F.when(medium, F.lit("priority_Medium")),
        F.when(unsubscribe, F.lit("has_unsubscribe")), F.when(domain.isNotNull(), F.concat(F.lit("domain_keyword_"), domain)),
    ))
    return df.withColumns({
        "primary_category": F.coalesce(from_sender, from_subject, F.lit("Other")), "domain_category": F.coalesce(domain, promo_domain, F.lit("Other")),
        "priority_level": priority, "source_type": source, "action_required": F.when(has_text & important, "Reply_Needed").otherwise("Read_Only"),
        "is_thread": thread, "has_unsubscribe": unsubscribe, "automated_score": F.round(automation, 3),
        "confidence_score": F.round(F.least(total.cast("double"), F.lit(1.0).cast("double")), 6), "classification_rules": F.to_json(trace),
    }).drop("__from", "__subject", "__body", "__labels", "__scores", "__pattern", "__auto", "__title", "__high", "__medium", "__best", "__domain", "__unsubscribe", "__automation", "__has_text", "__thread")


def newsletter_score(df: DataFrame, subject: str = "subject", sender: str = "sender", body: str = "body", limit: int | None = None) -> DataFrame:
    """``df`` with ``newsletter_points, newsletter_reasons, is_newsletter``, from whole texts; ``limit`` cuts them, at 500 characters in the rule that this follows."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    cut = lambda c: F.lower(F.left(whole(c), F.lit(limit)) if limit is not None else whole(c))
    df = df.withColumns({"__s": cut(subject), "__f": cut(sender), "__b": cut(body)})
    s, f, b = F.col("__s"), F.col("__f"), F.col("__b")
    signs = [
        ("AI keywords in subject", any_of(s, packs.AI_KEYWORDS)), ("AI keywords in sender", any_of(f, packs.AI_KEYWORDS)),
        ("Known AI newsletter domain", any_of(f, packs.AI_DOMAINS)), ("Newsletter pattern match", any_match(F.concat_ws(" ", s, f), packs.NEWSLETTER_PATTERNS)),
        ("Contains unsubscribe link", any_match(b, packs.UNSUBSCRIBE_PATTERNS)), ("Automated sender", any_of(f, packs.NEWSLETTER_SENDERS)),
    ]
    points = reduce(add, [F.when(test, p).otherwise(0) for (_, test), p in zip(signs, packs.NEWSLETTER_POINTS, strict=True)])
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in signs]))
    df = df.withColumns({"newsletter_points": points, "newsletter_reasons": reasons})
    verdict = (F.col("newsletter_points") >= 4) | ((F.col("newsletter_points") >= 3) & (F.size("newsletter_reasons") >= 2))
    return df.withColumn("is_newsletter", verdict).drop("__s", "__f", "__b")


def simple_category(df: DataFrame, subject: str = "subject", sender: str = "sender") -> DataFrame:
    """``df`` with ``simple_category``: five classes by substrings of subject and sender, first hit."""
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col(subject), F.lit("")), F.coalesce(F.col(sender), F.lit(""))))
    return df.withColumn("simple_category", F.coalesce(first_match(text, dict(packs.CLI_CATEGORIES), any_of), F.lit("Other")))


def query_risk(df: DataFrame, query: str = "query") -> DataFrame:
    """``df`` with ``risk_level, risk_reason`` of a mailbox query: broad queries are risky, narrow ones are not."""
    q = F.lower(F.coalesce(F.col(query), F.lit("")))
    high = [("is:read", "all read mail"), ("has:attachment", "all mail with attachments")]
    medium = [("is:unread", "all unread mail"), ("older_than:1y", "older than a year"), ("larger:10m", "over 10 MB")]
    low = [("from:", "one sender"), ("subject:", "one subject"), ("(payment or invoice)", "financial mail")]
    level = F.when(q == "", "HIGH")
    reason = F.when(q == "", "all mail")
    for name, group in (("HIGH", high), ("MEDIUM", medium), ("LOW", low)):
        for pattern, said in group:
            level, reason = level.when(q.contains(pattern), name), reason.when(q.contains(pattern), said)
    return df.withColumns({"risk_level": level.otherwise("LOW"), "risk_reason": reason})


def email_type(df: DataFrame, sender: str = "sender", html: str = "body_html") -> DataFrame:
    """``df`` with ``email_type``: newsletter, notification, marketing, simple or complex, from sender and tag counts."""
    who, page = F.lower(F.coalesce(F.col(sender), F.lit(""))), F.coalesce(F.col(html), F.lit(""))
    tags = lambda t: F.regexp_count(page, F.lit(rf"(?i)<{t}\b"))
    kind = (
        F.when(any_of(who, ["newsletter", "news", "digest"]), "newsletter").when(any_of(who, ["noreply", "no-reply", "notification"]), "notification")
        .when((tags("table") > 0) & (tags("img") > 3), "marketing").when(((tags("table") == 0) & (tags("div") == 0)) | (F.length(page) < 1000), "simple").otherwise("complex")
    )
    return df.withColumn("email_type", kind)
