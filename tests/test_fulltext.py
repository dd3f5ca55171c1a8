"""The kept index: match expressions against a plain reader, changes, compaction, and what a query opens."""

import re

import pytest

from lettermill.operators.fulltext import MailIndex, MatchError, Near, Phrase, parse_match, positions, search_mail

FIELDS = ("subject", "body", "sender")
ROWS = "gmail_id string, subject string, body string, sender string, date_received string"
MAIL = [
    ("1", "Budget plan", "The annual budget report, final version", "ann@x.org", "2024-01-01"), ("2", "Re: plan", "budget of the annual fair; no report", "bob@x.org", "2024-01-02"), ("3", None, "reporting budgets daily", "ann@y.org", "2024-01-03"),
    ("4", "Annual", "", None, "2024-01-04"), ("5", "final budget report", "annual annual budget", "cy@z.org", "2024-01-05"), ("6", "Grüße", "die jährliche Übersicht budget_2024", "ann@x.org", "2024-01-06"),
]


def plain(query, mail):
    """Ids that a match expression fits, mail by mail."""

    def places(p, terms):
        fits = lambda i, j, t: i + j < len(terms) and (terms[i + j].startswith(t) if p.prefix and j == len(p.terms) - 1 else terms[i + j] == t)
        return [i for i in range(len(terms)) if all(fits(i, j, t) for j, t in enumerate(p.terms)) and (not p.first or i == 0)]

    def fits(node, fields):
        if isinstance(node, tuple):
            a, b = fits(node[1], fields), fits(node[2], fields)
            return a and b if node[0] == "AND" else a or b if node[0] == "OR" else a and not b
        mine = [t for f, t in fields.items() if node.fields is None or f in node.fields]
        if isinstance(node, Phrase):
            return any(places(node, t) for t in mine)
        for terms in mine:
            at = [(places(p, terms), len(p.terms)) for p in node.phrases]
            for own, length in at:
                if any(all(any(s <= o <= s + length + node.gap for o in other) for other, _ in at) for s in own):
                    return True
        return False

    tree = parse_match(query, FIELDS)
    terms = lambda s: [t for t in re.split(r"[\W_]+", (s or "").lower()) if t]
    return {r[0] for r in mail if fits(tree, dict(zip(FIELDS, map(terms, r[1:4]), strict=True)))}


QUERIES = [
    "budget", "budget report", '"budget report"', "budget + rep*", "annual NOT report", "report* OR fair", "subject : budget", "- body : budget", "{subject sender} : (ann OR plan)", "^annual", "^budget + of", "NEAR(annual report, 2)", "NEAR(annual report, 0)",
    'NEAR("final version" annual, 3)', "budget AND (plan OR final) NOT bob", "b*", "ÜBERSICHT", "nothing", "budget nothing*", '"ann@x"', "subject : NEAR(final report, 1)",
]


def found(index, query, **more):
    return {r["gmail_id"] for r in index.match(query, **more).collect()}


def test_match_expressions_segments_and_compaction(spark, tmp_path):
    old = [(i, "gone subject", "budget budget", "old@x", d) for i, *_, d in MAIL[:3]] + [("9", "budget", "report", "x@y", "2024-01-09")]
    index = MailIndex(spark, str(tmp_path / "index"), buckets=8)
    with pytest.raises(FileNotFoundError):
        index.match("a")
    index.update(spark.createDataFrame(old, ROWS))
    index.update(spark.createDataFrame(MAIL, ROWS), spark.createDataFrame([("9",)], "gmail_id string"))
    for q in QUERIES:
        assert found(index, q) == plain(q, MAIL), q
    scores = [tuple(r) for r in index.match("budget report").collect()]
    assert scores == sorted(scores, key=lambda r: (-r[1], r[0])) and len(index.match("budget", 2).collect()) == 2
    index.compact()
    assert [tuple(r) for r in index.match("budget report").collect()] == scores
    assert all(found(index, q) == plain(q, MAIL) for q in QUERIES[:4]) and index.commits.children(str(tmp_path / "index" / "dead")) == []
    fresh = MailIndex(spark, str(tmp_path / "fresh"))
    fresh.update(spark.createDataFrame(MAIL, ROWS))
    assert [tuple(r) for r in fresh.match("budget report").collect()] == scores


def test_a_query_opens_its_terms_buckets_only(spark, tmp_path):
    index = MailIndex(spark, str(tmp_path / "index"), buckets=64)
    index.update(spark.range(500).selectExpr("cast(id as string) gmail_id", "concat('word', id % 90, ' ', char(97 + cast(id % 26 as int)), 'x') subject", "'common text' body", "'a@b.c' sender"))
    said = index.match("common NOT dx")._jdf.queryExecution().executedPlan().toString()
    opened = re.search(r"PartitionFilters: \[.*?__bucket#\d+ IN \(([\d,]+)\)", said) or re.search(r"PartitionFilters: \[.*?__bucket#\d+ INSET ([\d, ]+)", said)
    assert opened and len(opened[1].split(",")) == 2 and "PushedFilters: [Or(In(term" in said or "PushedFilters: [In(term" in said
    assert found(index, "common NOT dx", limit=1000) == {str(i) for i in range(500) if i % 26 != 3}


def test_search_falls_back_to_substrings(spark, tmp_path):
    mail = spark.createDataFrame(MAIL, ROWS)
    index = MailIndex(spark, str(tmp_path / "index"))
    index.update(mail)
    assert [r["gmail_id"] for r in search_mail(index, mail, '"budget report"').collect()] == [r["gmail_id"] for r in index.match('"budget report"').collect()]
    assert [r["gmail_id"] for r in search_mail(index, mail, "@x.").collect()] == ["6", "2", "1"]
    for bad in ("a AND", "(a", "other : a", "NEAR()", '"a', "a )"):
        with pytest.raises(MatchError):
            parse_match(bad, FIELDS)
    assert parse_match("a b NOT c OR d", FIELDS) == ("OR", ("NOT", ("AND", Phrase(("a",)), Phrase(("b",))), Phrase(("c",))), Phrase(("d",)))
    assert parse_match("NEAR(a b)", FIELDS) == Near((Phrase(("a",)), Phrase(("b",))), 10)


def test_an_empty_index(spark, tmp_path):
    index = MailIndex(spark, str(tmp_path / "index"))
    index.update(spark.createDataFrame([], ROWS))
    assert index.match("a* OR b").count() == 0 and index.postings().count() == 0


def test_terms_are_grouped_without_a_shuffle(spark):
    made = positions(spark.createDataFrame([(1, "b a b", None), (2, None, "A c"), (3, "", "b")], "id long, subject string, body string"), "id", ("subject", "body"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["term"], r["key"], r["field"], r["positions"], r["dl"]) for r in made.collect())
    assert got == [("a", 1, "subject", [1], 3), ("a", 2, "body", [0], 2), ("b", 1, "subject", [0, 2], 3), ("b", 3, "body", [0], 1), ("c", 2, "body", [1], 2)]
