"""Source divergence, vector codes and suffix dedup against SQL and plain versions, with their edge cases."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import divergence, registry, suffix_dedup, vector_codes
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
VECTORS = "vec_id long, embedding array<float>, label int"


def test_all_queries_are_there():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(name.startswith(f"op{n}_") for name in found) for n in range(1, 14)] == [1] * 13 and "pipeline" in found


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_vector_codes", "op13_suffix_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.execute(registry.ORACLE_SQL[name]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


# source divergence


def divergence_rows(rows, min_docs=3, top=200):
    """The audit of (text, lang, source) rows in plain Python."""
    import re

    counts, holds, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = (x or "" for x in (text, lang, source))
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(brute.UPPER))
        for t in terms:
            counts[lang, source, t] += 1
        for t in set(terms):
            holds[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (of, t), n in holds.items() if of == lang and n >= min_docs]
        sources = [s for of, s in groups if of == lang]
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s, t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


ROWS = [
    (1, "The CAT sat; the cat\x00ran 12 Äpfel_äpfel", "en", "a"), (2, "the cat Äpfel", "en", "b"), (3, "THE dog dog dog äpfel Äpfel", "en", "b"), (3, "THE dog dog dog äpfel Äpfel", "en", "b"),
    (4, None, "en", "c"), (5, "", "en", None), (6, "the cat the cat", None, None), (7, "unique words only", "fr", "a"), (8, "12 34", "fr", "b"), (9, "dog cat", "en", ""), (10, "日本 the 日本 dog" * 3000, "en", "a"),
    *[(100 + i, f"tie{chr(97 + i % 7)} tie{chr(97 + (i + 1) % 7)}", "en", "zß"[i % 2]) for i in range(40)],
]


def test_divergence_edges(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, DOCS).withColumns({"term": F.lit("clash"), "n": F.lit(1), "rank": F.lit("x"), "item": F.lit(2)})
    want = divergence_rows([r[1:] for r in ROWS])
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == want
    assert ("fr", "a", "pair", "b", 0, 1) in want and any(r[1] == "zß"[1] and r[2] == "term" for r in want)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", -1)
    assert sorted(map(tuple, divergence.source_divergence(df, top=2).collect())) == divergence_rows([r[1:] for r in ROWS], top=2)
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_divergence_is_exact_beyond_64_bits(spark):
    counts = [("en", "a", "x", 10**12, 5), ("en", "b", "x", 3, 5), ("en", "b", "y", 10**10 + 7, 5)]
    df = spark.createDataFrame(counts, "lang string, source string, term string, n long, docs long")
    from lettermill.llm.scratch import Scratch

    groups, vocabulary, dense = divergence.dense_shares(df, Scratch(spark, "test"))
    got = {(r["source"], r["term"]): (r["p"], r["q"]) for r in dense.join(groups, "g").join(vocabulary, "t").collect()}
    total = {"a": 10**12, "b": 10**10 + 10}
    n = {("a", "x"): 10**12, ("a", "y"): 0, ("b", "x"): 3, ("b", "y"): 10**10 + 7}
    share = lambda n, total: 1 + 10**9 * (n + 1) // (total + 2)
    whole = sum(total.values())
    assert got == {k: (share(v, total[k[0]]), share(n["a", k[1]] + n["b", k[1]], whole)) for k, v in n.items()}


def test_divergence_plan_is_native(spark):
    said = divergence.op11_source_divergence(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in said for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


# vector codes


def plain_codes(rows, parts, entries, rounds, dimension):
    """(codes by row, codebooks) in plain integers."""
    width = -(-dimension // parts)
    x = [[v + [0] * (parts * width - len(v)) for v in [[int(np.floor(np.float64(c) * 256)) for c in r]]][0] for _, r in rows]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for (key, _), v in zip(rows, x, strict=True):
        if key is not None:
            first[key] = min(first.get(key, v), v)
    start = [first[k] for k in sorted(first)[:entries]] or [[0] * parts * width]
    books = [[cut(v, p) for v in start] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        met = defaultdict(list)
        for v in x:
            for p in range(parts):
                met[p, near(v, p)[1]].append(cut(v, p))
        for (p, i), own in met.items():
            books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[near(v, p) for p in range(parts)] for v in x]
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found], hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for bound, width in ((3, 4), (1 << 20, 4), (vector_codes.component_bound(64), 4), (1 << 12, 48)):
        x, entries = rng.integers(-bound, bound, (500, width)), rng.integers(-bound, bound, (64, width))
        entries[40:] = entries[:24]
        # Neighbours one apart, far from the origin: only the exact measure tells them.
        entries[10:20] = entries[9] + rng.integers(-1, 2, (10, width))
        x[:100] = entries[9] + rng.integers(-2, 3, (100, width))
        at, far = vector_codes.nearest(x, entries)
        whole = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert (far == whole.min(1)).all() and (at == [int(np.flatnonzero(w == w.min())[0]) for w in whole]).all()


def test_vector_codes_edges(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(v)) for v in rng.normal(0, 0.2, 6)], [0, 1, None][i % 3]) for i in range(40)]
    good += [(3, [float(np.float32(v)) for v in rng.normal(0, 1, 6)], 1), good[7], (None, [0.5] * 6, 2), (50, [], None), (51, [0.25, -0.25], 1), (52, [-0.001] * 6, 1)]
    bad = [(60, None, 1), (61, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (62, [float("nan")] * 6, 2), (63, [float("inf")] + [0.0] * 5, 9), (-5, [float("-inf")], None)]
    df = spark.createDataFrame(good + bad, VECTORS).repartition(5).withColumns({"code": F.lit(1), "x": F.lit("clash"), "key": F.lit(2)})
    rows, books = vector_codes.vector_codes(df, parts=4, entries=8)
    want, digest = plain_codes([(k, v) for k, v, _ in good], 4, 8, 2, 6)
    by_label = Counter()
    for (_, _, label), (_, error) in zip(good, want, strict=True):
        by_label[label] += error
    got = sorted((tuple(r) for r in rows.collect()), key=repr)
    assert books.digest == digest and got == sorted([(k, label, code, error, by_label[label], digest) for (k, _, label), (code, error) in zip(good, want, strict=True)], key=repr)
    empty, _ = vector_codes.vector_codes(spark.createDataFrame(bad[:1], VECTORS))
    assert empty.count() == 0
    no_key, books = vector_codes.vector_codes(spark.createDataFrame([(None, [1.0] * 16, 0)], VECTORS))
    assert [tuple(r)[2:4] for r in no_key.collect()] == [("00" * 16, 0)]


def test_vector_codes_huge_components(spark):
    rows = [(0, [3e38] * 64, 0), (1, [-3e38] * 64, 0), (2, [1.5] * 64, 0), *[(10 + i, [3e38] * 64, 0) for i in range(6)]]
    got, _ = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS), entries=2)
    got = {r["vec_id"]: r for r in got.collect()}
    assert len(got) == 9 and all(r["error"] >= 0 for r in got.values())


# suffix dedup


def plain_repeats(rows, window=13):
    """{row number: (words, removed, kept words)}: every window by its words."""
    texts = [brute.words(t or "") for _, t in rows]
    order = [k if k is not None else 2**63 - 1 for k, _ in rows]
    least = {}
    for k, w in zip(order, texts, strict=True):
        for i in range(len(w) - window + 1):
            least[tuple(w[i : i + window])] = min(k, least.get(tuple(w[i : i + window]), k))
    out = []
    for k, w in zip(order, texts, strict=True):
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def made_texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.integers(0, 300)) if rng.random() < 0.7 else 0}"
    passage = [word() for _ in range(60)]
    out = []
    for i in range(120):
        w = [word() for _ in range(int(rng.integers(0, 80)))]
        if i % 3 == 0:
            a, b = sorted(rng.integers(0, 61, 2).tolist())
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passage[a:b]
        out.append((int(rng.integers(0, 60)) if i % 4 == 0 else 1000 + i, " ".join(w)))
    long = " ".join(["same"] * 5000)
    return [*out, (None, " ".join(passage)), (None, out[0][1]), (5, None), (6, ""), (7, " \t\n "), (8, long), (9, long), (8, long), (10, "é x " * 40), (2, "é x " * 20), out[9], out[9]]


@pytest.mark.parametrize("group, chunk", [(None, None), (40, 1000), (1, 1)])
def test_suffix_dedup_against_plain(spark, monkeypatch, group, chunk):
    if chunk:
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = made_texts(group or 0)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row int, doc_id long, text string").withColumns({"kept": F.lit("clash"), "n_words": F.lit("x"), "id": F.lit(1), "spans": F.lit(0)}).repartition(3, "row").cache()
    got = {r["row"]: r for r in suffix_dedup.drop_repeats(df, group=group).collect()}
    want = plain_repeats(rows)
    assert len(got) == len(rows) and [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) for i in range(len(rows))] == want
    assert got[0]["id"] == 1 and sum(w[1] > 0 for w in want) > 20


def test_suffix_dedup_spans_are_maximal(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a), (2, f"x {a} y {a} z"), (3, " ".join(a.split()[:12]))]
    spans = suffix_dedup.repeat_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["id"], r["spans"]) for r in spans] == [(2, [1, 41, 42, 82])]
    none = suffix_dedup.drop_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "n_words", "n_removed", "n_repeats", "kept"]


def test_prefixes_lengthen_where_they_must():
    counts = np.zeros(1 << 18, np.int64)
    counts[5], counts[6], counts[(1 << 12) + 7], counts[200_000] = 1000, 30, 90, 10
    first, bits = suffix_dedup.choose_prefixes(counts, 100)
    assert bits[5] == 4 and bits[6] == 0 and first[6] != first[5] and first[(1 << 12) + 7] == first[(1 << 12) + 8] and first[200_000] == first[199_999]
    groups = [set(range(f, f + (1 << b))) for f, b in {(int(first[i]), int(bits[i])) for i in np.flatnonzero(counts)}]
    assert len(set().union(*groups)) == sum(map(len, groups))
