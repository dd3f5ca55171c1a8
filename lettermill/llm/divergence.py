r"""Audit of how the sources of a language diverge (plain relational; DataFrame functions only).

Texts are exploded into terms and counted by group, a group being one source of one language. The groups
of a language are crossed with its vocabulary, so that absent terms count as zero; a self-join on
language and term then compares the groups, and a window ranks what differs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.scratch import Scratch

#: Fixed values of the audit: what a term is, in how many documents of its language, the scale of probabilities, and how many terms are told.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same matches in a text without A-Z; one range less to look at for every character.
LOWER_TERM = r"[^\x00-\x60\x7B-\x7F]+"
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Groups that may be broadcast to the vocabulary; beyond it they are joined by shuffle, a language dealt over ``SALTS`` parts.
BROADCAST_GROUPS = 20_000
SALTS = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. A text of ASCII alone takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that hold it.

    A group's documents without any term give a row with a null term, so that no group is lost. One scan and one shuffle,
    after counting on the map side; terms of a document go in twice, as often as they occur and once each.
    """
    read = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    terms = read.select("lang", "source", F.regexp_extract_all(_lower_ascii(F.col("text")), F.lit(LOWER_TERM), F.lit(0)).alias("all"))
    each = terms.select("lang", "source", F.explode_outer(F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("docs"), F.col("all").alias("terms")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("docs"), F.array_distinct("all").alias("terms")))).alias("e"))
    rows = each.select("lang", "source", "e.n", "e.docs", F.explode_outer("e.terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, size: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + size)), exact: a product beyond 64 bits is a decimal."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div cast({total} + {size} as decimal(20, 0))")


def _numbered(df: DataFrame, name: str, scratch: Scratch, table: str) -> DataFrame:
    """``df`` with a number for each row, stable since the table is written: numbers stand for strings in all later shuffles."""
    return scratch.save(df.withColumn(name, F.monotonically_increasing_id()), table)


def dense_shares(counts: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, vocabulary, dense): (lang, source, g), (lang, term, of_lang, t), and (t, g, n, p, q) of every group and kept term of its language.

    p is the group's share of the term and q its language's. Kept are terms that ``min_docs`` documents of the language hold.
    """
    groups = _numbered(counts.select("lang", "source").distinct(), "g", scratch, "groups")
    few = groups.count() <= BROADCAST_GROUPS
    small = lambda df: F.broadcast(df) if few else df
    terms = counts.where("term is not null")
    kept_terms = terms.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    vocabulary = _numbered(kept_terms, "t", scratch, "vocabulary")
    kept = terms.join(vocabulary.select("lang", "term", "t"), ["lang", "term"]).join(small(groups), ["lang", "source"]).select("t", "g", "n")
    kept = scratch.save(kept, "kept")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("size"), F.sum("of_lang").alias("lang_total"))
    # A group without a kept term has N = 0; a language without one has no row in ``sizes`` and so no dense row.
    totals = kept.groupBy("g").agg(F.sum("n").alias("total"))
    known = groups.join(totals, "g", "left").join(sizes, "lang").select("lang", "g", F.coalesce("total", F.lit(0)).alias("total"), "size", "lang_total")
    terms = vocabulary.select("lang", "t", "of_lang")
    if few:
        crossed = terms.join(F.broadcast(known), "lang")
    else:
        crossed = terms.withColumn("part", F.pmod(F.col("t"), F.lit(SALTS))).join(known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "part"])
    dense = crossed.join(kept, ["t", "g"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return groups, vocabulary, scratch.save(dense.select("t", "g", "n", _share("n", "total", "size").alias("p"), _share("of_lang", "lang_total", "size").alias("q")), "dense")


def _gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are 1 + SCALE at most, so the square fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def source_divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    r"""(lang, source, part, item, value, rank): how far each source is from its language's other sources, and by which terms from the language.

    - Terms are matches of ``TERM`` after A-Z are lower-cased. Null text, lang and source are empty strings. Every row is a
      document of its own, equal rows too. No term is dropped for its length.
    - Part ``pair``: the item is each other source of the language; the value adds up f = floor((p - q)^2 / q) over the kept
      terms, q being the other source's share, 0 if there are none. All ranks.
    - Part ``term``: the item is each kept term that the source has and whose share p is above the language's q; the value is
      f, ranks to ``top``.
    - Ranks count from 1 by falling value, then by the item's UTF-8 bytes.
    - An empty table gives no rows; a language of one source has no pairs. Other columns of ``df`` are not read.

    What grows with the square of a language's sources are the pairs, which are the result; they are added up on the map side,
    both directions from one joined row. Keys of the self-join all have as many rows as the language has sources, so none is hot.
    """
    scratch = Scratch(df.sparkSession, "divergence")
    groups, vocabulary, dense = dense_shares(scratch.save(term_counts(df, lang, source, text), "counts"), scratch, min_docs)
    # The self-join by term, and so by language: each two sources once; both directions are added up before they become rows.
    one, other = dense.select("t", "g", "p"), dense.select("t", F.col("g").alias("h"), F.col("p").alias("q"))
    summed = one.join(other, "t").where("g < h").groupBy("g", "h").agg(F.sum(_gap("p", "q")).alias("there"), F.sum(_gap("q", "p")).alias("back"))
    two = F.array(F.struct("g", "h", F.col("there").alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))
    # Languages without a kept term have no sums, but their pairs count.
    mates = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").where("g <> h")
    pairs = mates.join(summed.select(F.explode(two).alias("r")).select("r.*"), ["g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    named = vocabulary.select("t", F.col("term").alias("item"))
    terms = dense.where("n > 0 and p > q").select("t", "g", _gap("p", "q").alias("value"))
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("value"), "item")
    ranked = terms.join(named, "t").withColumn("rank", F.row_number().over(order("g"))).where(F.col("rank") <= top)
    ranked = ranked.join(groups, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order("lang", "source"))).unionByName(ranked)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS terms FROM documents),
words AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS of_lang FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {MIN_DOCS}),
kept AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN vocabulary USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS size, sum(of_lang) AS lang_total FROM vocabulary GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM kept GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, v.term, coalesce(k.n, 0) AS n,
         CAST(1 + ({SCALE}::HUGEINT * (coalesce(k.n, 0) + 1)) // (coalesce(t.total, 0) + s.size) AS BIGINT) AS p,
         CAST(1 + ({SCALE}::HUGEINT * (v.of_lang + 1)) // (s.lang_total + s.size) AS BIGINT) AS q
  FROM groups g JOIN vocabulary v USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}
"""
