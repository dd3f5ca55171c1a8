"""Reading, writing, merging and classifying small mailboxes."""

import json

import pytest
from pyspark.sql import functions as F

from lettermill.functions import text
from lettermill.operators import quality, rules, search, store, temporal
from lettermill.schema import MAIL, check_mail, to_mail
from lettermill.sources import mime, readers, writers
from lettermill.sources.snapshots import MailStore

EML = """From: Ann <Ann@Example.com>
To: bob@example.org, "C" <c@example.org>
Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=
Date: Mon, 10 Jan 2025 10:00:00 +0200 (EET)
X-Gmail-ID: 18fd4d295a4fe8ea
Content-Type: text/plain; charset="utf-8"

Hello there
"""


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_eml_scan_ignores_the_weekday_and_survives_bad_files(spark, tmp_path):
    (tmp_path / "a.eml").write_text(EML)
    (tmp_path / "2024-06-01_172200_x_18fd4d295a4fe8eb.eml").write_bytes(b"\xff\xfe not a mail")
    got = {r["gmail_id"]: r for r in readers.read_eml(spark, str(tmp_path)).collect()}
    a = got["18fd4d295a4fe8ea"]
    assert a["subject"] == "Grüße" and str(a["date_received"]) == "2025-01-10 08:00:00" and a["year_month"] == "2025-01"
    assert a["body"].strip() == "Hello there" and a["to"].startswith("bob@")
    assert "18fd4d295a4fe8eb" in got


def test_a_quoted_mail_is_body():
    from lettermill.sources.mime import parse_message

    got = parse_message(b"+OK 5\nFrom: a@x\nSubject: mine\n\nHello, my own answer.\n\nFrom: b@y\nSubject: old\n\nquoted rest")
    assert (got["headers"]["From"], got["headers"]["Subject"], got["plain"]) == ("a@x", "mine", "Hello, my own answer.\n\nFrom: b@y\nSubject: old\n\nquoted rest")
    parts = parse_message(b"relay line\n\nSubject: s\nFrom: a@x\n\n\nContent-Type: multipart/mixed; boundary=\"q\"\nMIME-Version: 1.0\n\n--q\nContent-Type: text/plain\n\nFrom: c@z\ninside\n--q--\n")
    assert parts["headers"]["From"] == "a@x" and parts["plain"].strip() == "From: c@z\ninside"
    assert parse_message(b"line\n\nDate: 1 Jan 2024 00:00:00 +0000\nTo: t@x\n\nbody")["error"] is None


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "2024-06-01_x_18fd4d295a4fe8ea.md").write_text("| Field | Value |\n| --- | --- |\n| From | a@b.c |\n| Subject | Hi |\n\n## Message Content\n\nBody\n\n\n\nend\n")
    r = readers.read_markdown(spark, str(tmp_path)).first()
    assert (r["gmail_id"], r["sender"], r["subject"], r["body"]) == ("18fd4d295a4fe8ea", "a@b.c", "Hi", "Body\n\nend")
    assert str(r["date_received"]) == "2024-06-01 00:00:00"


def test_monthly_json_skips_imported_months(spark, tmp_path):
    for m in ("2024-01", "2024-02"):
        (tmp_path / f"{m}_emails.json").write_text(json.dumps({"year_month": m, "emails": [{"gmail_id": m, "subject": "s", "date": f"{m}-03"}]}))
    done = spark.createDataFrame([("2024-01",)], "year_month string")
    assert [r["gmail_id"] for r in readers.read_monthly_json(spark, str(tmp_path), done).collect()] == ["2024-02"]


def test_api_messages_take_the_last_header(spark):
    m = [("i", "t", ["INBOX"], "s", {"headers": [{"name": "Subject", "value": "old"}, {"name": "subject", "value": "new"}, {"name": "From", "value": "N <A@B.c>"}, {"name": "To", "value": "x@y.z, "}]}, 5, "1736503200000")]
    df = spark.createDataFrame(m, "id string, threadId string, labelIds array<string>, snippet string, payload struct<headers array<struct<name string, value string>>>, sizeEstimate long, internalDate string")
    r = readers.from_api_messages(df).first()
    assert (r["subject"], r["sender"], len(r["recipients"]), str(r["date_received"])) == ("new", "a@b.c", 1, "2025-01-10 10:00:00")


def test_analysis_file_fills_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("subject,sender\nhi,a@b.c\n")
    assert set(readers.REQUIRED) <= set(readers.read_analysis_file(spark, f"{tmp_path}/x.csv").columns)
    with pytest.raises(ValueError):
        readers.read_analysis_file(spark, f"{tmp_path}/x.xml")


def test_dates(spark):
    want = {"Fri, 10 Jan 2025 10:00:00 -0500 (EST)": "2025-01-10 15:00:00", "10 Jan 2025 10:00:00 GMT": "2025-01-10 10:00:00", "2025-01-10 10:00:00": "2025-01-10 10:00:00", "2025-01-10T10:00:00+02:00": "2025-01-10 08:00:00", "on 2025-01-10, late": "2025-01-10 00:00:00", "no date": None}
    for said, day in want.items():
        got = one(spark, text.parse_mail_date(F.col("d")).cast("string"), d=said)
        assert got == day, said


def test_text_functions(spark):
    assert one(spark, text.strip_tracking(F.col("u")), u="http://a/b?x=1&utm_source=q&y=2#z") == "http://a/b?x=1&y=2#z"
    assert one(spark, text.mask_phone(F.col("p")), p="(555) 123-4567") == "***-***-4567"
    assert one(spark, text.sanitise_filename(F.col("n")), n=' a/b:c?.txt. ') == "a_b_c_.txt"
    assert one(spark, text.markdown_to_plain(F.col("m")), m="# T\n\n**b** and *i* [x](http://y) `c`\n\n\n\n- item\n> q &amp; r\n") == "T\n\nb and i x (http://y) c\n • item\n q & r"
    assert one(spark, readers.decode_base64url(F.col("b")), b="SGk_") == "Hi?"
    redacted = one(spark, text.redact(F.col("t")), t="card 4111-1111-1111-1111 ssn 123-45-6789 mail a@b.co ip 10.0.0.1")
    assert redacted == "card [REDACTED_CC] ssn [REDACTED_SSN] mail [REDACTED_EMAIL] ip [REDACTED_IP]"
    again = one(spark, text.redact(F.col("t")), t=redacted)
    assert again == redacted


def test_rules_keep_priority_and_cap(spark):
    df = spark.createDataFrame([("1", "Invoice alert", None, "x@y.z"), ("2", None, None, None), ("3", "hello", "", "noreply@x.y")], "gmail_id string, subject string, body string, sender string")
    got = {r["gmail_id"]: r for r in rules.classify(df).collect()}
    assert got["1"]["category"] == "Financial" and got["1"]["confidence"] == 0.7
    assert got["2"]["category"] == "Other" and got["2"]["confidence"] == 0.5 and not got["2"]["is_automated"]
    assert got["3"]["category"] == "Notifications" and got["3"]["is_automated"]
    replaced = rules.rule_pack(custom=[("Financial", 9, ["zzz"], [], 0.9)])
    assert [r.name for r in replaced][-1] == "Financial" and len(replaced) == 6


def test_quality_gate(spark):
    bad = spark.createDataFrame([("1", None), ("1", "x")], "gmail_id string, subject string")
    assert {r["issue"] for r in quality.gate_issues(bad).collect()} == {"low_completeness", "high_null_rate", "duplicate_ids"}
    with pytest.raises(quality.QualityError):
        quality.require_quality(bad)
    assert quality.require_quality(bad, strict=False) is bad
    empty = bad.limit(0)
    assert quality.uniqueness(empty).first()["total"] == 0


def test_merge_is_idempotent_and_snapshots_hold(spark, tmp_path):
    base = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "gmail_id string, subject string, sender string")
    delta = spark.createDataFrame([("2", "B", None), ("3", "c", "z")], "gmail_id string, subject string, sender string")
    once = store.upsert(base, delta).drop("merge_action")
    twice = store.upsert(once, delta).drop("merge_action")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("1", "a", "x"), ("2", "B", "y"), ("3", "c", "z")]
    s = MailStore(spark, str(tmp_path / "mail"))
    with pytest.raises(FileNotFoundError):
        s.read()
    s.create(base)
    s.upsert(delta)
    s.delete(delta.where("gmail_id = '3'"), F.localtimestamp())
    assert s.count() == 2 and not s.exists(delta.where("gmail_id = '3'")).first()["found"]
    s.restore(delta)
    assert s.count() == 3


def test_export_round_trip(spark, tmp_path):
    mail = spark.createDataFrame([("1", "a@b.c", "s", "t", ["UNREAD"], "2024-01-02"), ("2", "d@e.f", "s", None, None, None)], "gmail_id string, sender string, subject string, body string, labels array<string>, date string")
    mail = to_mail(mail)
    assert {r["year_month"]: r["n"] for r in writers.write_partitioned(mail, str(tmp_path / "m")).collect()} == {"2024-01": 1}
    assert {r["sender_domain"] for r in writers.write_partitioned(mail, str(tmp_path / "d"), by="sender_domain").collect()} == {"b.c", "e.f"}
    out = writers.Outputs()
    eml = {r["file_name"]: r["content"] for r in out.generate(mail, "eml").collect()}
    assert any("Subject: s\r\n" in c for c in eml.values())
    with pytest.raises(ValueError):
        out.generate(mail, "pdf")
    assert check_mail(mail).count() == 0 and mail.schema.names == MAIL.names


def test_eml_write_and_read(spark, tmp_path):
    mail = spark.createDataFrame([("18fd4d295a4fe8ea", "a@b.c", "d@e.f", "Subj", "<p>Hi <b>you</b></p>", "plain text here, long enough")], "gmail_id string, sender string, to string, subject string, body_html string, body string").withColumn("date_received", F.expr("timestamp_ntz'2024-01-02 03:04:05'"))
    content = mail.select(writers.eml_text().alias("c")).first()["c"]
    (tmp_path / "m.eml").write_text(content, newline="")
    r = readers.read_eml(spark, str(tmp_path)).first()
    assert (r["gmail_id"], r["subject"], r["body"].strip(), str(r["date_received"])) == ("18fd4d295a4fe8ea", "Subj", "plain text here, long enough", "2024-01-02 03:04:05")


def test_peaks_need_a_full_window(spark):
    daily = spark.createDataFrame([(f"2024-01-{i:02d}", 50 if i == 5 else 1) for i in range(1, 10)], "day string, volume long").withColumn("day", F.to_date("day"))
    assert [str(r["day"]) for r in temporal.peak_days(daily, 7, 2.0).collect()] == ["2024-01-05"]
    assert temporal.peak_days(daily.limit(3), 7).count() == 0


def test_mail_query(spark):
    df = spark.createDataFrame([("1", "Big sale", "shop@x.y", "b", ["INBOX"], "2024-01-05", 20e6), ("2", "hi", "ann@x.y", "sale", ["UNREAD"], "2024-02-05", 10.0)], "gmail_id string, subject string, sender string, body string, labels array<string>, d string, size double").withColumn("date_received", F.to_timestamp("d").cast("timestamp_ntz"))
    ids = lambda q: [r["gmail_id"] for r in df.where(search.mail_query(q, now="2024-02-10")).orderBy("gmail_id").collect()]
    assert ids("sale") == ["1", "2"] and ids("subject:sale") == ["1"] and ids("-subject:sale") == ["2"]
    assert ids("is:unread OR larger:10M") == ["1", "2"] and ids("newer_than:7d") == ["2"] and ids("(from:ann OR from:shop) before:2024/02/01") == ["1"]
    with pytest.raises(ValueError):
        search.mail_query("rfc:1")


def test_mail_query_operators_and_groups(spark):
    rows = [("1", "Bob <b@x>", "inv.pdf", "<id1@x>", ["INBOX", "circle_pals"], "see https://drive.google.com/x"), ("2", "Cy <c@x>", None, "id2@x", ["category_promo"], "hello")]
    df = spark.createDataFrame(rows, "gmail_id string, to string, attachments string, message_id string, labels array<string>, body string")
    df = df.withColumns({"subject": F.lit("s"), "sender": F.lit("z"), "cc": F.lit("cc@x"), "bcc": F.lit(None).cast("string"), "delivered_to": F.col("to")})
    ids = lambda q: "".join(r["gmail_id"] for r in df.where(search.mail_query(q)).select("gmail_id").orderBy("gmail_id").collect())
    assert ids("to:bob") == ids("filename:pdf") == ids("rfc822msgid:id1@x") == ids("has:drive") == ids("circle:pals") == "1"
    assert ids("{to:bob to:cy}") == ids("in:anywhere") == "12" and ids("to:(bob OR cy) -has:drive") == "2" and ids("cc:cc -{circle:pals category:promo}") == ids("bcc:x") == ""
    for bad in ("(a", "a)", "foo:1", "newer_than:xx"):
        with pytest.raises(ValueError):
            search.mail_query(bad)


PLAIN = b'From: user12@view.example.com\r\nTo: me@example.org\r\nSubject: gr\xc3\xbcn  x\r\nDate: 1 Jan 2024 00:00:11 +0000\r\nX-Gmail-ID: 12\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary="=_ab"\r\n\r\n--=_ab\r\nContent-Type: text/plain; charset="utf-8"\r\n\r\n{"k": 4}\r\n--=_ab\r\nContent-Type: text/html; charset="utf-8"\r\n\r\n<p>page</p>\r\n--=_ab--\r\n'


def _without_package(monkeypatch, raw):
    """The message as the email package reads it, and as it is read where the package must not be asked."""
    want = mime._parse_any(raw)
    monkeypatch.setattr(mime, "_parse_any", None)
    got = mime.parse_message(raw)
    monkeypatch.undo()
    return want, got


def test_plain_messages_are_read_without_the_email_package(monkeypatch):
    want, got = _without_package(monkeypatch, PLAIN)
    assert got == want and got["plain"] == '{"k": 4}' and got["headers"]["Date"] == "Mon, 01 Jan 2024 00:00:11 +0000" and got["headers"]["Subject"] == "grün  x"
    # Variants that are not plain give what the package gives.
    for old, new in ((b"\r\n", b"\n"), (b"\r\n\r\n--=_ab", b"\r--=_ab"), (b"--=_ab--", b""), (b"--=_ab--", b"--=_abc--"), (b"1 Jan", b"32 Jan"), (b"user12@", b"A B <user12@"), (b"x\r\n", b"=?utf-8?q?a_b?=\r\n more\r\n"), (b"Content-Type: text/html", b"Content-Disposition: attachment\r\nContent-Type: text/html"), (b"utf-8", b"nope"), (b"MIME-Version", b" MIME-Version")):
        raw = PLAIN.replace(old, new)
        try:
            want = mime._parse_any(raw)
        except LookupError as e:
            assert mime.parse_message(raw)["error"] == f"LookupError: {e}"
        else:
            assert mime.parse_message(raw) == want, new


def test_buried_headers_are_read_without_the_email_package(monkeypatch):
    raw = b"+OK 512 octets\nreceived by relay\n\nFrom: nobody@x\nFrom: a@view.example.com\nSubject:\n view\nX-Gmail-ID: 7\n\nbody 7"
    want, got = _without_package(monkeypatch, mime.repair_message(raw))
    monkeypatch.setattr(mime, "_parse_any", None)
    assert mime.parse_message(raw) == got == want and got["headers"]["From"] == "a@view.example.com" and got["plain"] == "body 7"


def test_buried_headers_before_quotes_are_read_without_the_email_package(monkeypatch):
    raw = b"+OK 5\nX-Relay: a\n\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nFrom: a@b.c\nSubject: s\n\nContent-Type: text/plain; charset=utf-8\n\nmine\n\nFrom: old@x\nSubject: old\n\nquoted"
    want, got = _without_package(monkeypatch, mime.repair_message(raw))
    monkeypatch.setattr(mime, "_parse_any", None)
    assert mime.parse_message(raw) == got == want and got["headers"]["From"] == "a@b.c" and got["plain"] == "mine\n\nFrom: old@x\nSubject: old\n\nquoted"


def test_long_subjects_are_read_without_the_email_package(monkeypatch):
    raw = b"From: web@de.example.org\r\nSubject: " + "Wörter und ".encode() * 50 + b'\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset="utf-8"\r\n\r\nFrom me\r\n' + "ß\n".encode() * 50
    want, got = _without_package(monkeypatch, raw)
    assert got == want and got["headers"]["Subject"].count("Wörter") == 50 and got["plain"].endswith("ß\n")
