"""Command line, configuration, streams and the entry module without the corpus operators."""

import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lettermill import cli
from lettermill.config import AnalysisConfig
from lettermill.operators import ledger
from lettermill.sources.snapshots import DeadLetterStore, MailStore
from lettermill.streaming import mail_stream

ROOT = Path(__file__).resolve().parent.parent


def test_config_bounds():
    said = {"quality_thresholds": {"min_completeness": 50, "other": 1}, "custom_categories": {"Pets": {"keywords": ["cat"], "priority": 0}}}
    c = AnalysisConfig.of(said)
    assert c.min_completeness == 50 and c.rules()[0].name == "Pets" and len(c.rules()) == 7
    with pytest.raises(ValueError):
        AnalysisConfig(min_completeness=101)


def test_config_of_pattern_groups(spark):
    from lettermill.operators import rules

    said = {"work_patterns": {"keywords": ["deadline"], "domains": ["corp.com"], "senders": ["boss@"]}, "delete_patterns": {"keywords": ["sale"], "personal_domains": ["x.y"], "confidence_threshold": 0.75}, "thresholds": {"a": 1}}
    c = AnalysisConfig.of_groups(said)
    df = spark.createDataFrame([("1", "hi", "boss@a"), ("2", "big sale", "z"), ("3", "q", "a@xzy"), ("4", "hi", "a@x.y")], "gmail_id string, subject string, sender string").withColumn("body", F.lit(""))
    got = {r["gmail_id"]: (r["category"], r["confidence"]) for r in rules.classify(df, c.rules()).collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "work", "2": "delete", "3": "Other", "4": "delete"} and got["2"][1] <= 0.75


def test_analyze(spark, tmp_path, capsys):
    rows = [(str(i), f"2024-01-0{i % 3 + 1} 10:00:00", "invoice" if i % 2 else "hi", "a@b.c", "text") for i in range(10)]
    spark.createDataFrame(rows, "gmail_id string, date_received string, subject string, sender string, plain_text_content string").coalesce(1).write.parquet(str(tmp_path / "m.parquet"))
    assert cli.main(["analyze", "--input", f"{tmp_path}/m.parquet", "--format", "json"]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert {r["category"]: r["n"] for r in got["categories"]} == {"Financial": 5, "Other": 5}
    assert cli.main(["analyze", "--input", f"{tmp_path}/m.parquet", "--date", "2030-01-01", "--no-gate"]) == 0
    spark.createDataFrame(rows + rows, "gmail_id string, date_received string, subject string, sender string, plain_text_content string").write.parquet(str(tmp_path / "d.parquet"))
    assert cli.main(["analyze", "--input", f"{tmp_path}/d.parquet"]) == 2
    assert cli.main(["search", "--input", f"{tmp_path}/m.parquet", "--query", "subject:invoice"]) == 0
    assert len(capsys.readouterr().out.split("invoice")) == 6


def test_history_sync_is_idempotent(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "store"))
    store.create(spark.createDataFrame([("1", "a", "x", "t"), ("2", "b", "y", "t")], "gmail_id string, subject string, sender string, body string"))
    changes = "gmail_id string, history_id long, type string, subject string, sender string, body string, error string"
    rows = [("3", 1, "added", "c", "z", "t", None), ("1", 2, "deleted", None, None, None, None), ("2", 3, "added", "old", None, None, None), ("2", 4, "added", "new", None, None, None), ("9", 5, "added", None, None, None, "timeout")]
    spark.createDataFrame(rows, changes).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = mail_stream.read_stream(spark, str(tmp_path / "in"), changes)
        mail_stream.sync_history(stream, store, str(tmp_path / "letters"), str(tmp_path / "cp")).awaitTermination()
        assert sorted((r["gmail_id"], r["subject"]) for r in store.find(F.lit(True)).collect()) == [("2", "new"), ("3", "c")]
    assert spark.read.json(str(tmp_path / "letters")).count() == 1


def test_sync_state(spark):
    state = spark.createDataFrame([("a", 5, 10)], "source string, history_id long, total_synced long")
    new = spark.createDataFrame([("a", 7, 2), ("b", 1, 1)], "source string, history_id long, total_synced long")
    assert sorted(map(tuple, ledger.sync_state(state, new).collect())) == [("a", 7, 12), ("b", 1, 1)]
    assert {r["source"]: r["needed"] for r in ledger.sync_needed(new, state).collect()} == {"a": True, "b": True}


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['lettermill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'category_summary' in q and not any(n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


MAIL_ROWS = "gmail_id string, subject string, sender string, body string, labels array<string>"


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in (folder / "data").rglob("*.parquet")}


def test_a_delta_rewrites_only_its_buckets(spark, tmp_path):
    box = MailStore(spark, str(tmp_path / "box"), 32)
    box.create(spark.range(2000).selectExpr("cast(id as string) gmail_id", "'s' subject", "'a@b' sender", "'t' body", "array('x') labels"))
    before = files_of(tmp_path / "box")
    ids = spark.range(10).selectExpr("cast(id * 7 as string) gmail_id")
    version = box.apply(ids.withColumn("subject", F.lit("new")), deleted=ids.where("gmail_id = '14'"), labels=ids.selectExpr("gmail_id", "array('y') add", "array('x') remove"), at=F.localtimestamp())
    after = files_of(tmp_path / "box")
    made = {p.split("/")[2] for p in after if p not in before}
    assert version == 2 and len(made) <= 10 and all(after[p] == t for p, t in before.items())
    assert box.count() == 1999 and box.find("subject = 'new'").count() == 9 and box.find("array_contains(labels, 'y')").count() == 9
    assert box.read(1).where("subject = 's'").count() == 2000
    # A read of some ids opens their buckets alone.
    some = box.get(ids.where("gmail_id = '7'"))
    assert some.count() == 1 and len({f.split("/")[-2] for f in some.inputFiles()}) == 1
    box.vacuum()
    assert box.commits.versions() == [2] and box.read().count() == 2000


def test_a_crash_between_steps_leaves_the_old_version(spark, tmp_path, monkeypatch):
    box = MailStore(spark, str(tmp_path / "box"), 4)
    box.create(spark.createDataFrame([("1", "a", "x", "t", None)], MAIL_ROWS))
    new = spark.createDataFrame([("1", "b"), ("2", "c")], "gmail_id string, subject string")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(box.commits, "put", crash)
        with pytest.raises(RuntimeError):
            box.upsert(new)
    assert [tuple(r)[:2] for r in box.read().collect()] == [("1", "a")]
    (tmp_path / "box" / "_versions" / "v2").mkdir()
    assert box.version() == 1
    assert box.upsert(new) == 2 and sorted(r["subject"] for r in box.read().collect()) == ["b", "c"]
    assert box.apply(new, batch=("s", 3)) == 3 and box.apply(new.where("false"), batch=("s", 3)) == 3 and box.applied("s") == 3
    with pytest.raises(FileNotFoundError):
        MailStore(spark, str(tmp_path / "none")).read()


def test_dead_letters_add_up_over_batches(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "store"), 4)
    store.create(spark.createDataFrame([], MAIL_ROWS))
    letters = DeadLetterStore(spark, str(tmp_path / "letters"), 4)
    changes = "gmail_id string, history_id long, type string, subject string, sender string, body string, error string"
    for i in range(5):
        spark.createDataFrame([("9", i, "added", "c", "z", "t", "timeout"), (f"ok{i}", i, "added", "c", "z", "t", None)], changes).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        mail_stream.sync_history(mail_stream.read_stream(spark, str(tmp_path / "in"), changes), store, letters, str(tmp_path / "cp")).awaitTermination()
        one = letters.open().first()
        assert one["attempts"] == i + 1 and (one["next_retry"] is None) == (i == 4)
    assert store.count() == 5 and ledger.exhausted(letters.open()).count() == 1
    at = F.expr("timestamp_ntz'2030-01-01'")
    letters.reset(letters.open(), at)
    assert str(letters.open().first()["next_retry"]) == "2030-01-01 00:05:00"
    letters.resolve(letters.open(), at, "sent")
    assert letters.open().count() == 0 and letters.read().first()["reason"] == "sent"
    letters.add(spark.createDataFrame([("9", "timeout")], "message_id string, failure_type string").withColumn("failed_at", at))
    assert sorted((r["attempts"], r["resolved"]) for r in letters.read().collect()) == [(0, True), (1, False)]
    letters.clean_up(F.expr("timestamp_ntz'2031-01-01'"))
    assert [r["resolved"] for r in letters.read().collect()] == [False]


def test_idle_lockout_state_is_gone(spark, tmp_path):
    from lettermill.streaming.lockout import lockouts

    for rows in ([("a", 1000), ("b", 1000)], [("c", 100_000)], [("c", 100_001)]):
        spark.createDataFrame(rows, "client string, s long").select("client", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema("client string, at timestamp").parquet(str(tmp_path / "in"))
        lockouts(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "client").load(str(tmp_path / "cp"))
    assert [r["key"]["client"] for r in state.collect()] == ["c"]


def test_progress_counts_what_was_sent(spark, tmp_path):
    from lettermill.streaming.progress import Progress, watched

    store = MailStore(spark, str(tmp_path / "store"), 4)
    store.create(spark.createDataFrame([], MAIL_ROWS))
    changes = "gmail_id string, history_id long, type string, subject string, sender string, body string, error string"
    for i in range(3):
        rows = [(f"{i}-{k}", k, "added", "c", "z", "t", "timeout" if k == 0 else None) for k in range(10 + i)]
        spark.createDataFrame(rows, changes).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    said = []
    with Progress(spark, lambda done, now: said.append((done, now))) as p:
        stream = watched(mail_stream.read_stream(spark, str(tmp_path / "in"), changes, 1), F.col("error"))
        mail_stream.sync_history(stream, store, str(tmp_path / "letters"), str(tmp_path / "cp")).awaitTermination()
    batches = p.table().where("rows > 0").orderBy("batch").collect()
    assert [(r["rows"], r["errors"]) for r in batches] in ([(10, 1), (11, 1), (12, 1)], [(x, 1) for x in sorted({10, 11, 12}, key=lambda n: [r["rows"] for r in batches].index(n))])
    assert sum(r["rows"] for r in batches) == 33 == said[-1][0] and store.count() == 30
    bad = watched(mail_stream.read_stream(spark, str(tmp_path / "in"), changes))
    failures = []
    with Progress(spark, on_error=lambda run, e: failures.append(e)) as p:
        q = bad.writeStream.foreachBatch(lambda *_: 1 / 0).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        with pytest.raises(Exception):
            q.awaitTermination()
    assert len(failures) == 1 and p.table().where("failure is not null").count() == 1


def test_patterns_without_end_are_refused():
    from lettermill.functions import packs
    from lettermill.functions.patterns import UnsafePattern, check_pattern
    from lettermill.operators import rules

    for bad in (r"(a+)+$", r"(a|aa)*b", r"(\w+\s*)*x", r"(.*)*y", r"([a-z]+)*1", r"(a|a?)+c", r"((a+)b?)+$", r"(\p{L}+)*!", "("):
        with pytest.raises(UnsafePattern):
            check_pattern(bad)
    for good in (r"(\w+,)*x", r"a+b+", r"(foo|bar)+x", r"^re:", r"[a-z]+@[a-z]+\.com", r"(\d{1,3}\.){3}\d+", r"(?:x(?:ab*)*)+y", r"(a+)+"):
        assert check_pattern(good) == good
    with pytest.raises(UnsafePattern):
        rules.rule_pack(custom=[("Bad", 1, ["x"], [r"(a+)+$"], 0.9)])

    def texts(x):
        return [x] if isinstance(x, str) else [t for v in (x.values() if isinstance(x, dict) else x) for t in texts(v)] if isinstance(x, (dict, list, tuple, set, frozenset)) else []

    assert len([check_pattern(t) for name in dir(packs) if name.isupper() and "PATTERN" in name for t in texts(getattr(packs, name))]) > 20


def test_loose_records(spark):
    from lettermill.schema import MAIL, from_loose_json

    lines = [
        '{"id": 7, "labels": "INBOX, UNREAD", "date": "2024-01-02 03:04:05", "from": "A <a@b.c>", "to": "x@y.z, Q <q@r.s>"}', '{"gmail_id": "m1", "labels": ["A"], "date": 1704164645000, "size": 12, "to": ["x@y.z"], "extra": {"a": [1]}}',
        '{"id": "", "message_id": "m2", "labels": null, "subject": 5, "size": "many", "labelIds": ["L"]}', "not json", "[1]", "", "{}",
    ]
    got = from_loose_json(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")).collect()
    by = {r["gmail_id"]: r for r in got}
    assert len(got) == 4 and got[0].__fields__ == MAIL.names and set(by) == {"7", "m1", "m2", None}
    assert by["7"]["labels"] == ["INBOX", "UNREAD"] and by["m1"]["labels"] == ["A"] and by["m2"]["labels"] == ["L"] and by["m2"]["subject"] == "5" and by["m2"]["size"] is None
    assert str(by["7"]["date_received"]) == str(by["m1"]["date_received"]) == "2024-01-02 03:04:05" and by["m1"]["size"] == 12 and by["m1"]["year_month"] == "2024-01"
    assert [r["address"] for r in by["7"]["recipients"]] == ["x@y.z", "q@r.s"] and [r["address"] for r in by["m1"]["recipients"]] == ["x@y.z"]


def test_the_gate_and_the_report_are_one_scan(spark):
    from lettermill.operators import quality

    mail = spark.createDataFrame([("1", "a"), ("2", None), ("2", "b")], "gmail_id string, subject string")
    report = lambda rows: rows.groupBy("twice").agg(F.count("*").alias("n"))
    twice = lambda df: df.withColumn("twice", F.concat("subject", "subject"))
    with pytest.raises(quality.QualityError) as e:
        quality.gated_report(mail, twice, ["twice"], report)
    want = {f"{r['issue']} {r['field']}: {r['measured']}" for r in quality.gate_issues(mail).collect()}
    assert set(str(e.value).split("; ")) == want
    good = spark.createDataFrame([(str(i), "a") for i in range(9)], "gmail_id string, subject string")
    assert [tuple(r) for r in quality.gated_report(good, twice, ["twice"], report).collect()] == [("aa", 9)]


def test_checkpoints_of_many_events_equal_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(ledger, "SPAN", 50)
    rng = random.Random(4)
    states = [*ledger.TRANSITIONS, "in_progress", "in_progress", "interrupted", None, "odd"]
    rows = [(rng.choice("ab"), i // 2 * 3, rng.choice([s for s in states if s not in ("failed", "completed") or rng.random() < 0.02]), i, 9000) for i in range(3000)]
    rows += [("c", 7, "completed", 1, 1), ("d", None, "in_progress", 3, 4), ("d", 0, "completed", 4, 4), ("d", 9, "failed", 5, 5)]
    want = {}
    for sync in "abcd":
        state, at, rejected = "pending", (0, 0, None), 0
        for seq, new, done, total in sorted((r[1:] for r in rows if r[0] == sync), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2])):
            if new in ledger.TRANSITIONS[state]:
                state, at = new, (done, total, seq)
            else:
                rejected += 1
        want[sync] = (state, *at, rejected)
    got = ledger.checkpoints(spark.createDataFrame(rows, "sync_id string, seq long, state string, processed int, total int")).collect()
    assert {r["sync_id"]: tuple(r)[1:] for r in got} == want
