"""Markup functions, record redaction and the lockout stream."""

from pyspark.sql import functions as F

from lettermill.functions import markup
from lettermill.operators import ledger, rules, store
from lettermill.sources import renderers
from lettermill.sources.mime import best_body, html_to_markdown, parse_message
from lettermill.streaming.lockout import lockouts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_html_text_drops_what_is_not_read(spark):
    page = '<style>p{}</style><script>var a="</p>"</script><p>A &amp; b</p><!-- no --><img width="1" src="t.gif"><img src="x.png">c'
    assert one(spark, markup.html_text(F.col("h")), h=page) == "A & b c"
    assert 't.gif' not in one(spark, markup.clean_html(F.col("h")), h=page) and "x.png" in one(spark, markup.clean_html(F.col("h")), h=page)


def test_repairs(spark):
    assert one(spark, markup.repair_line_ends(F.col("r")), r="a\r\r\nb\nc\rd\r\n") == "a\r\nb\r\nc\r\nd\r\n"
    assert one(spark, markup.looks_like_mail(F.col("r")), r="From: a\nTo: b\nSubject: c\n\nbody\n")
    assert not one(spark, markup.looks_like_mail(F.col("r")), r="hello")
    assert one(spark, markup.tidy_markdown(F.col("m")), m="#Head  \r\n* x\n\n\n\ny") == "# Head\n- x\n\ny"
    assert one(spark, markup.wrap(F.col("m"), 10), m="aaa bbb ccc ddd\n- keep this line as it is") == "aaa bbb\nccc ddd\n- keep this line as it is"
    assert one(spark, markup.front_matter({"subject": F.col("s"), "cc": F.col("c")}), s='say "hi"', c=None) == '---\nsubject: "say \\"hi\\""\n---\n'
    assert one(spark, markup.rewrite_cid(F.col("m"), F.create_map(F.lit("a1"), F.lit("files/a.png"))), m="![x](cid:a1)") == "![x](files/a.png)"


def test_redaction_reaches_nested_fields(spark):
    df = spark.createDataFrame([(1, ("ann@x.y", ["call 555-123-4567"]), {"token": "t", "note": "mail bob@x.y"})], "id long, mail struct<sender string, parts array<string>>, extra map<string,string>")
    r = markup.redact_record(df).first()
    assert r["mail"]["sender"] == markup.MARK and r["mail"]["parts"] == ["call [REDACTED_PHONE]"]
    assert r["extra"] == {"token": markup.MARK, "note": "mail [REDACTED_EMAIL]"} and r["id"] == 1
    again = markup.redact_record(markup.redact_record(df)).first()
    assert again == r


def test_mime_helpers():
    assert html_to_markdown("<h1>T</h1><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x</ul><script>no</script>") == "# T\n\na **b** [l](u)\n\n- x"
    assert best_body("short", "<p>" + "long text " * 50 + "</p>").startswith("long text") and best_body("plain", "<p>plain</p>") == "plain"
    bad = parse_message(b"Content-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nbroken")
    assert bad["error"] is None and parse_message(None)["plain"] is not Ellipsis


def test_progress_and_migrations(spark):
    assert spark.range(1).select(ledger.progress(F.lit(1), F.lit(0)).alias("x")).first()["x"] == 0.0
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, checksum string")
    done = spark.createDataFrame([("a", "1"), ("b", "x")], "name string, checksum string")
    assert {r["name"]: r["status"] for r in ledger.migrations_due(known, done).collect()} == {"a": "applied", "b": "changed", "c": "pending"}


def test_lockout_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "client string, at timestamp"
    for i, times in enumerate([[0, 10, 20], [30, 40, 50, 60], [2000]]):
        rows = [("a", t) for t in times] + ([("b", t) for t in times] if i == 0 else [])
        df = spark.createDataFrame(rows, "client string, s long").select("client", F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = lockouts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("client", F.unix_timestamp("locked_at").alias("s"), F.unix_timestamp("until").alias("u")).collect()
    assert [tuple(r) for r in got] == [("a", 40, 940)]


def test_histograms_by_nearest_rank(spark):
    # Sizes around the bounds, one value repeated, a heavy tail, nulls, and a metric without a name.
    metrics = {"one": [3.5], "few": [float(i) for i in range(20)], "more": [float(i % 7) for i in range(21)], "hundred": [float(-i) for i in range(100)], "tail": [2.0**i for i in range(101)] + [1.0] * 500,
               "same": [1.0] * 300, "nulls": [None] * 60 + [5.0, 4.0], "void": [None] * 3, None: [float(i * 37 % 5000) for i in range(5000)]}
    rows = [(name, v) for name, values in metrics.items() for v in values]
    got = {r["name"]: r for r in ledger.histograms(spark.createDataFrame(rows, "name string, value double").repartition(5)).collect()}
    assert got.keys() == metrics.keys()
    for name, values in metrics.items():
        s, n = sorted(values, key=lambda v: (v is not None, v)), len(values)
        r = got[name]
        assert (r["n"], r["most"]) == (n, s[-1])
        assert (r["p50"], r["p95"], r["p99"]) == (s[n // 2], s[int(n * 0.95) if n > 20 else n - 1], s[int(n * 0.99) if n > 100 else n - 1]), name


def test_retention_keeps_the_newest_of_limited_states(spark):
    df = spark.createDataFrame([(s, i) for i in range(30) for s in ("a", "b", "c", None)], "state string, at int")
    got = store.retain(df, "state", "at", {"a": 2, "b": 5}).groupBy("state").agg(F.count("*").alias("n"), F.min("at").alias("least")).collect()
    assert {r["state"]: (r["n"], r["least"]) for r in got} == {"a": (2, 28), "b": (5, 25), "c": (30, 0), None: (30, 0)}
    assert store.retain(df, "state", "at", {}).count() == 120


def test_classification_counts_the_winning_rule_only(spark):
    rules_ = [rules.Rule("x", 1, ("é", "bb"), (), 0.99), rules.Rule("y", 2, ("bb", "cc"), ("@z",), 0.99)]
    df = spark.createDataFrame([(1, "É bb", None, "q"), (2, "cc", None, "a@z"), (3, None, None, None)], "id int, subject string, body string, sender string")
    got = {r["id"]: (r["category"], r["confidence"]) for r in rules.classify(df, rules_).collect()}
    assert got == {1: ("x", 0.99), 2: ("y", 0.9), 3: ("Other", 0.5)}


def test_each_rendering_wins_somewhere(spark):
    from lettermill.sources import renderers

    article = "<h1>Head</h1><p>" + "A sentence of the article that is long enough. " * 2 + "</p><ul><li>" + "an item with some words in it" + "</li></ul><p><a href='u'>a link with words</a></p>"
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>{i}</a></li>" for i in range(10)) + "</ul></nav>"
    far = "http://example.org/" + "x" * 300
    rows = [
        ("tree", f"<div>{article}</div>", None), ("main", f"<body>{menu}<div>{article}</div></body>", None),
        ("links", f"<h1>Head</h1><ul><li>an item of some length, really</li></ul><p>see <a href='{far}'>the first of the pages</a></p><p>then <a href='{far}2'>the second of the pages</a></p><img src='p.png' alt='pic'>", None), ("plain", "<b></b>", "a text"), ("plain", None, "a text"),
    ]
    df = spark.createDataFrame(rows, "want string, body_html string, body string").withColumn("tree", F.lit("clash"))
    got = renderers.best_markdown(df, plain="body").collect()
    assert [r["rendering"] for r in got] == [r["want"] for r in got] and {r["want"] for r in got} == {"tree", "main", "links", "plain"}
    assert "[0](/0)" not in got[1]["markdown"] and f"[1]: {far}" in got[2]["markdown"]


def test_tree_renderings_of_odd_pages():
    from lettermill.sources.renderers import render, renderings, tree_of

    md = lambda page: render(tree_of(page))
    assert md("<ol start=3><li>a<li>b<ul><li>c<li>d</ul></ol>") == "3. a\n4. b\n    - c\n    - d"
    assert md("<table><tr><td>only<p>layout</td></tr></table>").split() == ["only", "layout"]
    assert md("<table><tr><th>a</th><th>b</th></tr><tr><td>x|y</td></tr></table>") == "| a | b |\n| --- | --- |\n| x\\|y |  |"
    assert md("<blockquote><p>a</p><p>b</p></blockquote>") == "> a\n>\n> b" and md("<pre>x\n  y</pre>") == "```\nx\n  y\n```"
    assert md("</p><b>x") == "**x**" and md("a<br>b") == "a\nb" and md("<span style='display: none'>x</span>y") == "y" and md("<img src=a width=1>") == ""
    assert renderings("<div>" * 20_000 + "deep" + "</div>" * 20_000)[0] == "deep" and renderings(None) == ("", "", "")


def test_periods_of_names_count_apart_from_folders(spark):
    files = spark.createDataFrame([("2024/01/2024",), ("2024/01/7.EML",), ("2024/02/12",), ("12",)], "path string")
    got = sorted(tuple(r) for r in ledger.path_periods(files).collect())
    assert got == [("month", "01", 2), ("month", "02", 1), ("month", "12", 2), ("year", "2024", 1), ("year", "2024", 3)]


def test_a_main_part_is_rendered_on_the_way(monkeypatch):
    page = "<nav><a href='/m'>menu</a></nav><div><p>The article is here, with words.</p><p>And <a href='u'>more</a>.</p></div>"
    passes = []
    plain = renderers._upwards
    monkeypatch.setattr(renderers, "_upwards", lambda root: passes.append(root.tag) or plain(root))
    root = renderers.tree_of(page)
    want = renderers.render(root), renderers.render(root, references=True), renderers.render(renderers.main_part(root))
    assert want[2].startswith("The article") and "menu" in want[0]
    passes.clear()
    assert renderers.renderings(page) == want and len(passes) < 4


def test_two_renderings_of_links_take_one_pass(monkeypatch):
    page = "<h2><a href='/u'>t</a></h2><ul><li>a <a href='http://x/1'>b</a><li><a href='/u'></a></ul><table><tr><th>k<th>v<tr><td>1<td><a href='#n'>n|m</a></table>"
    plain, passes = renderers._upwards, []
    monkeypatch.setattr(renderers, "_upwards", lambda root: passes.append(root.tag) or plain(root))
    for odd in (page, page.replace("/u", "/a|b c"), page.replace("b</a>", "b &#4;1&#5;</a>"), page.replace("b</a>", "b \x041\x05</a>"), "<p>no link"):
        root = renderers.tree_of(odd)
        want = renderers.render(root), renderers.render(root, references=True)
        passes.clear()
        assert renderers.renderings(odd, ("tree", "links")) == want
        assert len(passes) == 1 or odd not in (page, "<p>no link")
