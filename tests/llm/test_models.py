"""Quality rules, BPE, near duplicates, vectors and HTML against plain versions."""

import hashlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lettermill.llm import bpe, embedding, html_extract, near_dup, quality

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(spark, name="documents"):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/{name}.parquet").select("doc_id", "text").collect()]


# quality


def test_base_counts(spark):
    got = {r["doc_id"]: r for r in quality.op3_boosted_quality(spark, SF).collect()}
    for d, t in texts(spark):
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_counts(t)


HARD = [None, "", " \n\t ", "a", "a b c d e " * 5, "x\nx\n \n \ny\nx", "é ü 日本 #|<>&", "\x0b\x0c\r \x1c w", "one two three four five six seven eight nine ten", "longword" * 200_000, "w " * 300_000, "a b c d e f g h i j\n" * 40]


def test_quality_edges(spark):
    trees = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    df = spark.createDataFrame(list(enumerate(HARD)) + [(1, "")], "doc_id long, text string").withColumns({"kept": F.lit("clash"), "extra": F.array(F.lit(1))})
    got = quality.judge_quality(df, trees).collect()
    assert len(got) == len(HARD) + 1
    for r in got:
        if r["doc_id"] not in (10,):
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_counts(r["text"]), r["doc_id"]
    long = next(r for r in got if r["doc_id"] == 10)
    assert long["n_words"] == long["n_repeat_words"] == 300_000 and long["base_failed"] and long["extra"] == [1]
    assert quality.judge_quality(df.limit(0), trees).count() == 0


def test_trees_are_monotonic_and_hold_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.normal(size=3000) < 0.5).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    assert (((trees.score(x[2000:]) >= 0) == y[2000:]).mean()) > 0.85
    for f, (_, m) in enumerate(quality.FEATURES):
        if m:
            grid = np.repeat(x[:50], 40, axis=0)
            grid[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
            steps = np.diff(trees.score(grid).reshape(50, 40), axis=1)
            assert (steps * m >= -1e-9).all()


def test_quality_holds_out_on_the_corpus(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge_quality(docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in judged) / len(judged) > 0.97
    assert len(quality.train(docs, labels.limit(0)).roots) == 0


# BPE

STRANGE = [None, "", "  ", "It's a TEST's 'S don't we'LL", "<|endoftext|> hi<|startoftext|>there <|endoftext|", "ΑΣ Σ ΟΔΟΣ", "İstanbul naïve café é ﬁ", "a\x1cb\x85c　d ​", "😀😃 ½ ² 123 4.5", "日本語 テスト", "aaaaaaaaaaaaaaab ababababab", "x" * 20_000, "\x00\x01 \x7f", "don'tdon't 'tis 're're", "a</w> </w> <</w>>b x</w>y", "word " * 100_000]


def test_bpe_is_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    lib.no_padding()
    lib.no_truncation()
    rows = list(enumerate(STRANGE)) + [(1, "")] + [(d + 100, t) for d, t in texts(spark)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    spec = bpe.load_spec(PATH)
    got = bpe.digests(bpe.decode(bpe.encode(df, spec), spec)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(r["ids"]) == raw and r["n_tokens"] == len(ids), r["doc_id"]
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(raw).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode(df.limit(0), spec).count() == 0
    at_once = bpe.digests(bpe.round_trip(df, spec)).collect()
    assert sorted(map(tuple, at_once), key=str) == sorted(map(tuple, got), key=str)


def test_bpe_of_a_very_long_word_in_little_memory():
    import random
    import tracemalloc

    letters = random.Random(7)
    words = ["".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (20_000, 200_000)]
    ours = bpe.WordBpe(bpe.load_spec(PATH))
    assert ours.encode_words({words[0]})[words[0]] == np.array(Tokenizer.from_file(PATH).encode(words[0], add_special_tokens=False).ids, "<u4").tobytes()
    tracemalloc.start()
    whole = ours.encode_words({words[1]})[words[1]]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Some numbers a letter, and the suffix states of the vocabulary; with every prefix's encoding kept it would be over 20 GB.
    assert len(whole) > 4 * 100_000 and most < 100 << 20


def test_bpe_of_random_letters_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    lib = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    own, memory, words = bpe.WordBpe(bpe.load_spec(PATH)), bpe.Recent(), bpe.Recent()
    for _ in range(30):
        some = ["".join(rng.choice(list("aeinrst"), rng.integers(1, 14))) for _ in range(200)]
        got = own.encode_texts([" ".join(some)], memory, words)[0]
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(" ".join(some), add_special_tokens=False).ids


# near duplicates


def family(seed, n, words=60, change=1):
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.integers(0, words, change):
            w[i] = f"y{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, shingle, percent):
    rows = texts(spark)[:120] + [(10_000 + i, t) for i, t in enumerate(family(1, 200) + family(2, 60, change=2) + ["shared " * 3 + t for t in family(3, 20, change=4)])]
    rows += [(20_000, None), (20_001, ""), (20_002, "two words"), (20_003, "TWO  words"), (20_004, " \n"), (20_005, "two words")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)), shingle=shingle, percent=percent, region=16).collect()
    want, links = brute.near_duplicates(rows, shingle, percent)
    assert len(got) == len(rows) and len(links) > 100
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_crowded_star_with_a_late_hub(spark):
    # Every variant links with the hub, no two with each other, and the hub has the greatest id.
    rng = np.random.default_rng(5)
    hub = [f"w{i}" for i in range(143)]
    rows = []
    for i in range(2000):
        w = list(hub)
        for at in rng.choice(range(2, 140, 4), 3, replace=False):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    rows.append((9000, " ".join(hub)))
    sets = [brute.shingles(t, 3) for _, t in rows]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(s, sets[-1]) >= 0.85 for s in sets) and like(sets[0], sets[1]) < 0.85
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert len(got) == 2001 and {r["component_id"] for r in got} == {0}
    assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_near_duplicate_keys(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")]
    got = sorted((tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None, True)] * 2 + [(1, 2, 1, True)] * 2 + [(2, 2, 1, False)], key=str)
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# vectors


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    return np.concatenate([b + 0.12 * rng.normal(size=(12, 16)) for b in base])


@pytest.mark.parametrize("block", [8, 512])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    monkeypatch.setattr(embedding, "VISITORS", 2 * block)
    x = vectors().astype(np.float32)
    label = np.arange(len(x)) // 12 % 5
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    rows += [(5000 + i, x[0].tolist(), 0) for i in range(30)]  # copies
    odd = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [None] * 16, 0), (9004, x[0].tolist(), None), (None, x[0].tolist(), 0), (9005, [], 0), (9006, x[0][:8].tolist(), 0), (9007, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("weight", F.lit("clash"))
    got = {r["vec_id"]: r for r in embedding.link_vectors(df).collect()}
    y = np.array([r[1] for r in rows], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    k = np.array([r[2] for r in rows])
    near = (y @ y.T >= 0.93) & (k[:, None] == k[None])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    want = brute.components(ids, links)
    found = sum(got[i]["n_links"] for i in ids)
    assert len(links) > 1000 and found >= 0.995 * 2 * len(links) and found <= 2 * len(links)
    assert sum(got[i]["component_id"] == want[i] for i in ids) >= 0.99 * len(ids)
    for i, *_ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_low_rank(spark, monkeypatch):
    # Neighbours differ along the few directions of the data, over a grid of 40 by 40 cells.
    monkeypatch.setattr(embedding, "CELL", 2)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(3200, 8)) @ rng.normal(size=(8, 64))).astype(np.float32)
    got = {r["vec_id"]: r for r in embedding.link_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.93
    np.fill_diagonal(near, False)
    n = near.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert n.sum() > 1000 and (found <= n).all() and found.sum() >= 0.999 * n.sum()


def test_flat_nodes_score_as_a_walk_does():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    trees = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) > 0).astype(float), trees=15)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = (trees.left if row[trees.feature[node]] <= trees.threshold[node] else trees.right)[node]
            total += trees.value[node]
        return total

    assert len(trees.roots) == 15 and len(trees.value) > 60
    np.testing.assert_allclose(trees.score(x), [walk(row) for row in x])


def test_labelled_ids_that_repeat_keep_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, f"text number {i} of some words") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)))
    quality.train(docs, labels, sample=10)
    quality.train(docs, labels)
    assert seen == [10, 60]


# HTML

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav>menu</nav><div id="cookie-notice">We use cookies</div><main><article class="post"><h1>Head &amp; line</h1>
<p>One <a href="x>y">link</a>, two&nbsp;three<br/>four</p><ul><li>a<li>b {i}</ul><div class="ad">BUY</div><form>f<input></form><script>var a="</p>"</script><!-- c --><blockquote>q <b>bold</b></blockquote>
<section class="comments"><p>cmt</p></section></article><aside>side</aside></main><footer>foot &copy;</footer></body></html>"""


def test_html_edges(spark):
    rows = [(i, f"http://a.b/{i}", PAGE.replace("{i}", str(i))) for i in range(4)]
    rows += [(10, None, None), (11, "http://c/", ""), (12, "http://a.b/x", "<p>other layout</p>"), (13, "http://d/", PAGE), (13, "http://d/", PAGE), (14, "http://a.b/cut", PAGE[: PAGE.index("four") + 2]), (15, "x", "plain < text & more"), (16, "http://e/", "<div><p>" + "long &lt;text&gt; " * 20_000 + "</p></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_main_text(df).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[2] == "Head & line\nOne link, two three four\na\nb 2\nq bold" and by[13].endswith("q bold")
    # Pages of one title and headline are versions of one text, cut or not: what they share is theirs.
    assert by[10] == by[11] == "" and by[12] == "other layout" and by[14] == "Head & line\nOne link, two three fo" and by[15] == "plain < text & more"
    assert by[16].startswith("long <text> long") and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


OWN = """<html><body><div class="k1">Start Politics Sport</div>{late}<div class="k2"><h1>Title {i}</h1><div class="k9">Read it in our app today</div><div class="related-work"><p>Earlier work {i} {w}</p></div>
<div class="social-history"><p>History {i}</p></div>{also}<ul>{items}</ul><p>Words {w} of {i}</p><div class="comment-list"><p>me too {i}</p></div></div><div class="k3">Imprint</div></body></html>"""


def own_pages(n):
    rng = np.random.default_rng(2)
    words = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 999, k))
    also = '<div class="k5"><b>Members</b> only</div>'
    return [OWN.format(i=i, w=words(30), also=also if i % 3 else "", late='<div class="k7">Live now</div>' if i % 2 else "", items="".join(f"<li>item {i} {j}" for j in range(i % 4))) for i in range(n)]


def test_template_text_goes_by_its_class(spark):
    pages = own_pages(12)
    want = brute.host_texts(pages, {"comment-list"})
    assert "app today" not in "".join(want) and "Members" not in "".join(want) and all("Earlier work" in t and "History" in t for t in want)
    df = spark.createDataFrame([(i, f"http://own/{i}", p) for i, p in enumerate(pages)] + [(100 + i, "http://own/0", pages[0]) for i in range(40)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    assert [got[i] for i in range(12)] == want and got[120] == want[0]


def test_shuffled_vectors_give_another_template():
    import pyarrow as pa

    pages = own_pages(12)
    batch = pa.RecordBatch.from_pydict({"host": ["own"] * 12, "page": range(12), "copies": [1] * 12, "html": pages})
    rows = pa.Table.from_batches(html_extract._count([batch])).to_pandas()
    tokens = []
    for t, g in rows.groupby("token"):
        step = g["step"].iloc[0]
        if step is not None or len(g) >= 6:
            tokens.append({"token": t, "parent": g["parent"].iloc[0], "step": step, "vector": hash(tuple(zip(g["page"], g["n"], strict=True))), "pages": len(g), "once": (g["n"] == 1).sum(), "chars": g["chars"].sum()})

    def fixed(vectors):
        some = [t | {"vector": v} for t, v in zip(tokens, vectors, strict=True)]
        with_host = pa.RecordBatch.from_pydict({"host": ["own"] * 12, "html": pages, "ids": [[t["token"] for t in some]] * 12, "vectors": [vectors] * 12})
        orders = pa.Table.from_batches(html_extract._orders([with_host])).to_pylist()
        ordered = {r["vector"] for r in orders if r["least"] == r["most"] != 0}
        return {t["token"] for t in html_extract.template(some, ordered) if t["step"] is None}

    true = [t["vector"] for t in tokens]
    assert len(fixed(true)) == 5
    rng = np.random.default_rng(1)
    assert all(fixed([true[i] for i in rng.permutation(len(true))]) != fixed(true) for _ in range(5))


def test_two_layouts_in_one_host(spark):
    rows = [(i, f"http://two/{i}", f"<body><nav>n {i}</nav><article><h1>A {i}</h1><header><p>by {i}</header><p>text {i}</article></body>") for i in range(6)]
    rows += [(10 + i, f"http://two/{i}", f"<body><div class='new'><article><p>new {i}</article></div><div class='other'>more {i}</div></body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "A 2\nby 2\ntext 2" and got[12] == "new 2"


def test_main_node_without_article_element():
    own = [(1, 0, "html", 10, 0), (2, 1, "body", 10, 0), (3, 2, "nav!", 10, 90), (4, 2, "div.content", 10, 5), (5, 4, "p", 1, 900), (6, 2, "div.list", 10, 50)]
    tokens = [{"token": t, "parent": p, "step": s, "pages": 10, "once": o, "chars": c} for t, p, s, o, c in own]
    assert html_extract.main_nodes(tokens) == [4]
    assert html_extract.main_nodes([]) == []


def texts_of(spark, pages, host="http://one/"):
    rows = [(i, f"{host}{i}", p) for i, p in enumerate(pages)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got)]


def test_constant_sentence_goes_though_articles_are_short(spark):
    said = "This sentence stands on each page of the host and is far longer than the few words of any article on it, but it is the template's all the same, is it not."
    pages = [f"<body><div><article><h1>Price {i}</h1><p>{i} euro</p></article><div>{said}</div></div></body>" for i in range(20)]
    inside = [f"<body><article><h1>Price {i}</h1><p>{i} euro</p><div>{said}</div></article></body>" for i in range(20)]
    assert texts_of(spark, pages) == texts_of(spark, inside) == [f"Price {i}\n{i} euro" for i in range(20)]


def test_versions_of_one_text_are_no_template(spark):
    pages = [f"<body><article><h1>One text</h1><p>A paragraph that all versions share.</p><p>Version {i}</p></article></body>" for i in range(12)]
    pages += [f"<body><article><h1>Other {i}</h1><p>Text {i}</p></article></body>" for i in range(6)]
    got = texts_of(spark, pages)
    assert got[:12] == [f"One text\nA paragraph that all versions share.\nVersion {i}" for i in range(12)]
    assert got[12:] == [f"Other {i}\nText {i}" for i in range(6)]


@pytest.mark.parametrize("name", ["notice", "share-list", "header", "menu"])
def test_names_within_an_article_may_be_its_text(spark, name):
    pages = [f'<body><div class="{name}">outer {i}</div><article><h1>H {i}</h1><div class="{name}">Notice of appeal {i}.</div><p>Text {i}</p><div class="comments">me too {i}</div></article></body>' for i in range(5)]
    assert texts_of(spark, pages) == [f"H {i}\nNotice of appeal {i}.\nText {i}" for i in range(5)]


def test_neutral_divs_only(spark):
    # Frame, menu, constant advert and article have names that say nothing: classes and the main node decide.
    pages = [
        f'<body><div class="a1"><div>Start</div><div>Politics</div></div><div class="a2"><div class="a3">Buy more now</div><div class="a4"><div class="t">Title {i}</div>'
        f'<div>{"word " * 20}{i}</div><div class="a5">Read on in our app</div><div>{"more " * 20}{i}</div></div><div class="a6">See {i}</div></div></body>'
        for i in range(10)
    ]
    assert texts_of(spark, pages) == [f"Title {i}\n{'word ' * 20}{i}\n{'more ' * 20}{i}" for i in range(10)]


def test_deep_nesting_is_linear():
    import tracemalloc

    def peak(n):
        tracemalloc.start()
        page = '<div class="wrapper">' * n + "<p>deep &amp; down</p>" + "</div>" * n + "</section>" * n
        assert html_extract.main_text(page, set(), set()) == "deep & down"
        got = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got

    assert peak(40_000) < 100 << 20


def test_deep_pages(spark):
    deep = 16_000
    pages = [f'{"<div>" * deep}<p>deep {i}</p>{"</div>" * deep}' for i in range(3)]
    assert texts_of(spark, pages) == [f"deep {i}" for i in range(3)]
