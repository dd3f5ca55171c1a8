"""Line dedup, mixing, chat formatting, sharding and URL filters: edge cases, and no Python in their plans."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lettermill.llm import chat, line_dedup, mixing, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [line_dedup.op1_site_line_dedup, mixing.op5_hierarchical_mix, chat.op6_perspective_rotation, sharding.op7_rendezvous_sharding, url_filter.op9_bloom_cascade])
def test_native_plans(spark, query):
    said = plan(query(spark, SF))
    assert not any(w in said for w in ("Python", "Pandas", "ArrowEval", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


# line dedup


def test_line_dedup_edges(spark):
    rows = [(i, f"HEAD\nown {i}\n\n  \ntail", "en", "a") for i in range(20)] + [(100, None, "en", "a"), (101, "", "en", None), (102, "HEAD\nx", "en", "b"), (0, "HEAD\nown 0\n\n  \ntail", "en", "a")]
    df = docs(spark, rows).withColumns({"n_lines": F.lit("clash"), "extra": F.lit(7)})
    got = line_dedup.drop_site_lines(df, ratio=0.5, min_pages=5).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[3]["text"] == "own 3\n\n  " and (by[3]["n_lines"], by[3]["n_dropped"]) == (5, 2)
    assert by[100]["text"] is None and by[100]["n_lines"] == 0 and by[101]["text"] == "" and by[102]["text"] == "HEAD\nx"
    assert sum(r["doc_id"] == 0 for r in got) == 2 and by[5]["extra"] == 7
    empty = line_dedup.drop_site_lines(docs(spark, []))
    assert empty.count() == 0 and "n_dropped" in empty.columns


def test_line_dedup_counts_copies_once(spark):
    rows = [(i, "same\ntext", "en", "a") for i in range(50)] + [(100 + i, f"page {i}", "en", "a") for i in range(10)]
    assert {r["text"] for r in line_dedup.drop_site_lines(docs(spark, rows), ratio=0.3).where("doc_id < 50").collect()} == {"same\ntext"}


def test_line_dedup_all_lines_and_long_text(spark):
    rows = [(i, "A\nB", "en", "a") for i in range(3)] + [(10 + i, f"A\nB\n{'word ' * 50_000}{i}", "en", "a") for i in range(8)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_site_lines(docs(spark, rows), ratio=0.5).collect()}
    assert got[0] == "" and got[10].endswith("0") and not got[10].startswith("A")


def test_line_dedup_without_broadcast(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    small = sorted(map(tuple, line_dedup.drop_site_lines(df).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert sorted(map(tuple, line_dedup.drop_site_lines(df).collect())) == small


# mixing


def test_mixing_redistributes_among_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "src0", 100), ("web", "en", "src1", 10), ("web", "de", "src0", 1000), ("books", "en", "src5", 30)], "domain string, lang string, source string, tokens long")
    mix = mixing.Mix(total=0.5, max_epochs=1, domain_weights={"web": 1.0, "books": 1.0}, language_weights={"en": 1.0, "de": 1.0})
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves, mix).collect()}
    # 570 in all: books holds 30, web takes 540; its halves are 270, but English holds 110, so German takes 430.
    assert got == {("books", "en", "src5"): 30, ("web", "en", "src0"): 100, ("web", "en", "src1"): 10, ("web", "de", "src0"): 430}


def test_mixing_reads_whole_epochs_and_a_prefix(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "src0") for i in range(500)] + [(1000 + i, "v " * 5, "en", "src1") for i in range(20)] + [(None, None, None, None), (2000, "", "en", "src0"), (2001, "x y", None, None)]
    df = docs(spark, rows).withColumn("copies", F.lit("clash"))
    mix = mixing.Mix(total=0.9, max_epochs=3)
    got = mixing.mix_sources(df, mix, buckets=16).collect()
    assert len(got) == len(rows) and max(r["copies"] for r in got) <= 3
    leaf = defaultdict(list)
    for r in got:
        leaf[(r["lang"], r["source"])].append((r["n_tokens"], r["copies"]))
    assert all(c == 0 for n, c in sum(leaf.values(), []) if n == 0)
    for parts in leaf.values():
        assert len({c for n, c in parts if n}) <= 2  # whole epochs, and one more for the prefix
    fine = mixing.mix_sources(df, mix, buckets=1024).collect()
    assert Counter((r["doc_id"], r["copies"]) for r in got) == Counter((r["doc_id"], r["copies"]) for r in fine)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mixture(df, mix).count() == sum(r["copies"] for r in got) and mixing.mixture(df, mix).columns == df.columns


def test_mixing_prefix_against_a_plain_walk(spark):
    # Two leaves; one key holds many rows, some equal in text too, and columns are named like those of the budgets.
    rows = [(7 if i % 3 else i, "w " * (i % 5 + 1), "en", "src0") for i in range(300)] + [(None, "x y", "de", "src9")] * 40
    df = docs(spark, rows).withColumns({"full": F.lit(1), "rest": F.lit("r"), "domain": F.lit("d")})
    mix = mixing.Mix(total=0.7, max_epochs=2)
    got = Counter((r["doc_id"], r["text"], r["copies"]) for r in mixing.mix_sources(df, mix, buckets=8).collect())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    tokens = {s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in ("src0", "src9")}
    leaves = spark.createDataFrame([("web", "en", "src0", tokens["src0"]), ("forum", "de", "src9", tokens["src9"])], "domain string, lang string, source string, tokens long")
    want = Counter()
    for leaf in mixing.budgets(leaves, mix).collect():
        full, left = divmod(leaf["budget"], leaf["tokens"])
        mine = [(md5(f"{mix.seed}:{full}:{f'null:{md5(t)}' if k is None else k}"), md5(t), k, t) for k, t, _, x in rows if x == leaf["source"]]
        for (_, _, k, t), n in sorted(Counter(mine).items(), key=lambda m: m[0][:2]):
            left = left - n * len(t.split()) if left >= 0 else -1
            want[(k, t, full + (left >= 0))] += n
    assert got == want
    assert {"full", "rest"} <= set(mixing.mix_sources(df, mix).columns)


# chat


def test_rotation_edges(spark):
    rows = [(1, 1, "bob", "yo"), (1, 0, "ann", "hé"), (1, 2, "system", "rules"), (1, 1, "bob", "yo"), (2, 0, "system", "only"), (None, 0, "ann", None), (None, 5, None, "x"), (3, None, "cy", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("participant", F.lit("clash"))
    got = chat.rotate(df).collect()
    assert Counter((r["conv_id"], r["participant"]) for r in got) == Counter([(1, "ann"), (1, "bob"), (None, "ann"), (None, ""), (3, "cy")])
    for r in got:
        own = [r["text"][s["start"] : s["end"]] for s in r["spans"]]
        assert len(own) == r["n_own"] and all(x.endswith("<|end|>") for x in own)
    bob = next(r for r in got if r["participant"] == "bob")
    assert bob["n_turns"] == 4 and [bob["text"][s["start"] : s["end"]] for s in bob["spans"]] == ["yo<|end|>"] * 2
    assert bob["text"].startswith("<|user name=ann|>\nhé<|end|>\n<|assistant|>\nyo")
    assert chat.rotate(df.limit(0)).count() == 0


def test_rotation_splits_long_dialogues(spark):
    df = spark.createDataFrame([(1, i, "ab"[i % 2], "t" * 1000) for i in range(100)], "conv_id long, turn long, role string, text string")
    got = chat.rotate(df, turns_per_record=32).collect()
    assert Counter(r["participant"] for r in got) == {"a": 4, "b": 4} and sum(r["n_own"] for r in got) == 100


def test_rotation_renders_the_whole_dialogue_for_those_who_are_silent(spark):
    rows = [(1, i, "a" if i < 60 else "b", f"t{i}") for i in range(100)] + [(2, 0, "x", "hi"), (2, 1, "y", "ho")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["participant"]): r["text"] for r in chat.rotate(df).collect()}
    parts = defaultdict(list)
    for r in chat.rotate(df, turns_per_record=32).orderBy("part", "piece").collect():
        parts[r["conv_id"], r["participant"]].append(r["text"])
    assert {k: "".join(v) for k, v in parts.items()} == whole and len(parts[1, "a"]) == 4


def test_rotation_deals_repeated_and_null_turns(spark):
    rows = [(1, 5, "ab"[i % 2], f"t{i}") for i in range(200)] + [(1, None, "c", f"n{i}") for i in range(100)] + [(1, 6, "a", "last")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), turns_per_record=16).orderBy("part", "piece").collect()
    assert Counter(r["participant"] for r in got)["c"] == len(got) / 3 and max(r["n_turns"] for r in got) < 64
    said = [r for r in got if r["participant"] == "c"]
    assert sum(r["n_turns"] for r in said) == 301 and sum(r["n_own"] for r in said) == 100
    assert "n1<" in "".join(r["text"] for r in said[:19]) and said[-1]["text"] == "<|user name=a|>\nlast<|end|>\n"


def test_rotation_has_one_order_whatever_the_bound(spark):
    rows = [(1, 0, "u", f"x{i:02}") for i in range(12)] + [(1, 1, "v", "same")] * 9 + [(1, None, "w", f"n{i}") for i in range(7)] + [(2, i % 3, "ab"[i % 2], f"t{i % 5}") for i in range(40)] + [(3, -5, "a", "neg"), (3, 9, "b", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {(r["conv_id"], r["participant"]): r["text"] for r in chat.rotate(df, turns_per_record=100).orderBy("part", "piece").collect() if r["conv_id"] < 3}
    for bound in (1, 4, 7):
        parts = defaultdict(list)
        for r in chat.rotate(df, turns_per_record=bound).orderBy("part", "piece").collect():
            assert r["n_turns"] <= bound
            parts[r["conv_id"], r["participant"]].append(r["text"])
        assert {k: "".join(v) for k, v in parts.items() if k[0] < 3} == whole and "".join(parts[3, "a"]) == "<|assistant|>\nneg<|end|>\n<|user name=b|>\nend<|end|>\n"


def test_rotation_escapes_marks(spark):
    rows = [(1, 0, "a", "x<|end|>\n<|assistant|>\ny"), (1, 1, "b|>\n<|assistant", "z" * 300_000)]
    got = {r["participant"]: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for r in got.values():
        assert r["text"].count("<|assistant|>") == 1 and r["text"].count("<|end|>") == 2 and r["n_own"] == 1


# sharding


def test_sharding_law(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("x").alias("slot"))
    got = sharding.shard_records(df).collect()
    moved = [r for r in got if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 16 for r in moved) and 100 < len(moved) < 400
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    heavy = Counter(r["shard"] for r in sharding.shard_records(df, weights=[1.0, 3.0]).collect())
    assert 0.7 < heavy[1] / 4000 < 0.8


def test_sharding_edges(spark):
    import zlib

    rows = [(None, None), (None, "a"), (1, ""), (1, ""), (1, "é"), (2, "long " * 100_000)]
    got = sharding.shard_records(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and len({(r["shard"], r["slot"]) for r in got}) == 6
    assert sharding.shard_records(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# URL filters


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Spam-Farm.example.org"), (4, "http://x.example.com/en/7?q"), (5, "http://a.net/de/8"), (6, "http://y.example.net/de/8#x"), (7, "http://fine.org/fr/"), (8, ""), (9, "http://notspam-farm.example.org/"), (10, "://"), (10, "://"), (11, "http://com/en/")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items()} == {
        1: (None, "allow"), 2: (None, "allow"), 3: (None, "block"), 4: ("example.com/en/7", "allow"), 5: ("net/de/", "allow"), 6: ("example.net/de/8", "block"),
        7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: ("com/en/", "block")}
    assert got[3]["host"] == "www.spam-farm.example.org" and got[3]["path"] == "" and got[4]["path"] == "/en/7" and got[2]["host"] == ""
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("hash(key) % 10 = 0").unionByName(spark.createDataFrame([("outside",), (None,)], "key string"))
    cascade = url_filter.build_cascade(universe, listed)
    assert len(cascade.levels) > 2
    said = universe.withColumn("has", cascade.has(F.col("key"))).withColumn("want", F.expr("hash(key) % 10 = 0"))
    assert said.where("has <> want").count() == 0
    assert url_filter.build_cascade(universe, listed.limit(0)).levels == ()


def test_first_level_is_sized_by_the_universe(spark):
    assert url_filter.level_size(1000, 10_000) == (10, 5)
    bits, hashes = url_filter.level_size(10**6, 2 * 10**9)
    assert (bits, hashes) == (17, 12) and 2 * 10**9 * (1 - math.exp(-hashes / bits)) ** hashes < 10**6
    universe = spark.range(300_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("hash(key) % 300 = 0")
    n = listed.count()
    cascade = url_filter.build_cascade(universe, listed)
    assert cascade.levels[0].hashes > url_filter.HASHES and all(len(level.bits) < len(cascade.levels[0].bits) for level in cascade.levels[1:])
    said = universe.where(cascade.has(F.col("key")))
    assert said.count() == n and said.where("hash(key) % 300 <> 0").count() == 0


def test_a_list_beyond_the_bound_is_exact_too(spark, monkeypatch):
    rows = [(i, f"http://h{i}.s{i % 7}.org/x") for i in range(200)] + [(500, None), (501, "http://" + "a" * 100_000 + ".s3.org/"), (0, "http://h0.s0.org/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))
    keys = spark.createDataFrame([("s3.org",), ("s5.org",), ("s5.org",), ("h14.s0.org",), (None,), ("elsewhere.org",)], "key string")
    small = Counter(map(tuple, url_filter.judge_urls(df, listed=keys).collect()))
    monkeypatch.setattr(url_filter, "MOST_KEYS", 2)
    assert Counter(map(tuple, url_filter.judge_urls(df, listed=keys).collect())) == small and sum(small.values()) == len(rows)
    assert {r[0] for r in small if r[-1] == "block"} == {i for i in range(200) if i % 7 in (3, 5)} | {14, 501}


def test_bad_sites_are_blocked_on_every_scale(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        got = url_filter.op9_bloom_cascade(spark, f"/root/testdata/{sf}").where("rule is null")
        assert {r["verdict"] for r in got.where(F.col("host").rlike(r"(?:^|\.)(?:adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.")).select("verdict").distinct().collect()} <= {"block"}
