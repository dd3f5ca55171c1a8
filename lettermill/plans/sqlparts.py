"""DuckDB expressions of rule packs, built from the same fixed values."""

from lettermill.functions import packs
from lettermill.operators.rules import rule_pack


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")" if words else "FALSE"


def any_match(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) + ")" if patterns else "FALSE"


def hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, {q(w)})::INT" for w in words) + ")" if words else "0"


def matches(text: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, {q(p)})::INT" for p in patterns) + ")" if patterns else "0"


def case(pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def classified(mail: str = "mail", rules=None, cap: bool = True) -> str:
    """CTE bodies ``lowered`` and ``classified`` over a CTE ``mail`` with subject, body, sender."""
    rules = rules if rules is not None else rule_pack()
    fits = [f"({any_of('tx', r.keywords)} OR {any_match('fr', r.senders)})" for r in rules]
    category = case([(f, q(r.name)) for f, r in zip(fits, rules)], "'Other'")

    def score(r):
        s = f"0.7::DOUBLE + 0.3::DOUBLE * least(({hits('tx', r.keywords)} + {matches('fr', r.senders)}) / {float(len(r.keywords) + len(r.senders))}::DOUBLE, 1.0::DOUBLE)"
        return f"round(least({s}, {r.threshold}::DOUBLE), 3)" if cap else f"round({s}, 3)"

    confidence = case([(f"category = {q(r.name)}", score(r)) for r in rules], "0.5::DOUBLE")
    auto = f"({hits('fr', packs.AUTOMATED_SENDERS)} + CASE WHEN regexp_matches(coalesce(subject, ''), {q(packs.AUTOMATED_SUBJECT)}) THEN 0.5 ELSE 0 END + {any_of('fr', packs.AUTOMATED_DOMAINS)}::INT) >= 1.0"
    return f"""lowered AS (SELECT *, lower(coalesce(subject, '') || ' ' || coalesce(body, '')) AS tx, lower(coalesce(sender, '')) AS fr FROM {mail}),
cat AS (SELECT *, {category} AS category FROM lowered),
classified AS (SELECT *, {confidence} AS confidence, {auto} AS is_automated FROM cat)"""
