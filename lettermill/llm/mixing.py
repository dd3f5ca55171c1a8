"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

Leaves are (domain, language, source). Weights go down the tree; where a subtree holds too few
tokens for its share, the shortage is dealt to its siblings by their weights, and only what a whole
subtree cannot hold goes to the siblings of its parent. A leaf with budget b and t tokens is read
b div t times in full and then for a token-prefix of one more epoch, in a seeded order of its own.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.scratch import Scratch


@dataclass(frozen=True)
class Mix:
    """Weights by name; names that are not listed have weight 1. ``total`` is the budget as a share of all tokens."""

    total: float = 0.6
    max_epochs: int = 2
    seed: str = "mix-1"
    domain_weights: dict = field(default_factory=lambda: {"web": 5.0, "books": 3.0, "forum": 2.0})
    language_weights: dict = field(default_factory=lambda: {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0})
    source_weights: dict = field(default_factory=dict)


MIX = Mix()
#: Hash buckets of a leaf's epoch order: running totals are taken within a bucket, never over a whole leaf.
BUCKETS = 4096
#: Neighbouring buckets of one span: running totals go over a leaf's spans first, then over the buckets of one of them.
SPAN = 64


def domain_of(source: Column) -> Column:
    """web, books or forum by the last digit of the source's name; others are web."""
    return F.when(source.rlike("[0-4]$"), "web").when(source.rlike("[5-7]$"), "books").when(source.rlike("[89]$"), "forum").otherwise("web")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict) -> Column:
    out = F.lit(1.0)
    for k in sorted(weights):
        out = F.when(name == F.lit(k), F.lit(float(weights[k]))).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Split ``budget`` over the nodes of a parent by ``weight``, none over its ``cap``; what one cannot take its siblings get.

    Nodes fill up in the order of cap / weight, so the level that the others stand at is the largest
    of (budget left) / (weight left) along that order.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "name")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    nodes = nodes.withColumn("__level", level)
    nodes = nodes.withColumn("__level", F.max("__level").over(Window.partitionBy(*parent)))
    return nodes.withColumn(out, F.least(F.col("cap"), F.greatest(F.lit(0.0), F.col("weight") * F.col("__level")))).drop("__level")


def budgets(leaves: DataFrame, mix: Mix = MIX) -> DataFrame:
    """(domain, lang, source, tokens) to the same with ``budget`` (whole tokens); one row per leaf, so its size is that of the tree."""
    leaves = leaves.withColumn("leaf_cap", F.col("tokens").cast("double") * mix.max_epochs)
    # The branches are small aggregates of the leaves; each level is shared out within its parent.
    langs = leaves.groupBy("domain", "lang").agg(F.sum("leaf_cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumns({"weight": _weight(F.col("domain"), mix.domain_weights), "name": F.col("domain"), "all": F.lit(1)})
    domains = domains.withColumn("goal", F.floor(F.lit(float(mix.total)) * F.sum("tokens").over(Window.partitionBy("all"))).cast("double"))
    domains = _share(domains, ["all"], "goal", "domain_budget").select("domain", "domain_budget")
    langs = langs.withColumns({"weight": _weight(F.col("lang"), mix.language_weights), "name": F.col("lang")}).join(domains, "domain")
    langs = _share(langs, ["domain"], "domain_budget", "lang_budget").select("domain", "lang", "lang_budget")
    leaves = leaves.withColumns({"weight": _weight(F.col("source"), mix.source_weights), "name": F.col("source"), "cap": F.col("leaf_cap")}).join(langs, ["domain", "lang"])
    leaves = _share(leaves, ["domain", "lang"], "lang_budget", "budget")
    return leaves.select("domain", "lang", "source", "tokens", F.floor(F.col("budget") + F.lit(1e-6)).cast("long").alias("budget"))


def mix_sources(df: DataFrame, mix: Mix = MIX, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """All rows of ``df`` with ``domain, n_tokens, copies``: how often the mixture reads the document (0: not at all).

    - Tokens are words ``[^\\x20\\x09-\\x0D]+`` of the whole text; null and empty texts have none and are never read.
    - Null ``lang`` and ``source`` are leaves of their own, under the empty name.
    - The order in an epoch is by md5(seed:epoch:key), for a null key by that of the text, then md5 of the text; a leaf's prefix ends before the first
      document that would pass its budget. Rows equal in key and text have one place in the order: the budget holds all of them, or they end it.
    - ``copies`` is at most ``max_epochs``. Columns named like those made are replaced, others kept. Empty table: no rows.

    The running total of a leaf is never one task's work: bucket totals come from an aggregate (leaves x buckets
    rows at most), added up by spans of buckets first, and only the one bucket in which a leaf's budget ends is ordered
    document by document.
    """
    scratch = Scratch(df.sparkSession, "mix")
    by = ["domain", "__lang", "__source"]
    rows = df.withColumns({"domain": domain_of(F.coalesce("source", F.lit(""))), "n_tokens": n_words(F.col(text)), "__lang": F.coalesce("lang", F.lit("")), "__source": F.coalesce("source", F.lit(""))})
    tie = F.md5(F.coalesce(F.col(text), F.lit("")))
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), tie))
    # Texts are read twice: here for what the budgets need of them (some 100 bytes a row), and for the result.
    facts = scratch.save(rows.where("n_tokens > 0").select(*by, "n_tokens", name.alias("__name"), tie.alias("__tie")), "facts")
    sums = facts.groupBy("domain", F.col("__lang").alias("lang"), F.col("__source").alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(sums, mix)
    plan = plan.withColumns({"full": F.floor(F.col("budget") / F.col("tokens")).cast("int")})
    plan = plan.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    plan = scratch.save(plan, "plan").select("domain", F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("full").alias("__full"), F.col("rest").alias("__rest"))
    order = lambda of: F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("__full").cast("string"), of))
    bucket = (F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") / F.lit(2**32 / buckets)).cast("int")
    facts = facts.join(plan, by).withColumn("__order", order(F.col("__name"))).withColumn("__bucket", bucket)
    totals = facts.groupBy(*by, "__bucket", (F.col("__bucket") / SPAN).cast("int").alias("__span")).agg(F.sum("n_tokens").alias("__in"), F.first("__rest").alias("__rest"))
    ends_here = lambda ahead, own: (ahead <= F.col("__rest")) & (ahead + own > F.col("__rest"))
    so_far = lambda of, by, order: F.coalesce(F.sum(of).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = totals.groupBy(*by, "__span").agg(F.sum("__in").alias("__of"), F.first("__rest").alias("__rest")).withColumn("__ahead", so_far("__of", by, "__span"))
    spans = spans.where(ends_here(F.col("__ahead"), F.col("__of"))).select(*by, "__span", "__ahead")
    totals = totals.join(spans, [*by, "__span"]).withColumn("__before", F.col("__ahead") + so_far("__in", [*by, "__span"], "__bucket"))
    # The bucket where a leaf's prefix ends, and how much of the prefix is left on entering it: one row per leaf.
    ends = totals.where(ends_here(F.col("__before"), F.col("__in"))).select(*by, F.col("__bucket").alias("__end"), (F.col("__rest") - F.col("__before")).alias("__left"))
    ends = scratch.save(ends, "ends")
    last = facts.join(ends, by).where(F.col("__bucket") == F.col("__end")).select(*by, "__bucket", "__left", "n_tokens", "__order", "__tie")
    run = F.sum("n_tokens").over(Window.partitionBy(*by, "__bucket").orderBy("__order", "__tie").rowsBetween(Window.unboundedPreceding, 0))
    # The first document over the budget ends the prefix, even if a later one would fit.
    stop = last.withColumn("__run", run).where(F.col("__run") > F.col("__left")).groupBy(*by).agg(F.min(F.struct("__order", "__tie")).alias("__stop"))
    # All that the result needs of a leaf is one row of it.
    leaves = scratch.save(plan.join(ends.drop("__left"), by, "left").join(stop, by, "left"), "leaves")
    rows = rows.join(leaves, by, "left").withColumn("__order", order(name)).withColumn("__bucket", bucket)
    # No end: the prefix takes all (its budget is at least the leaf's tokens, or it is read in full only).
    more = (F.col("__bucket") < F.col("__end")) | ((F.col("__bucket") == F.col("__end")) & (F.struct(F.col("__order"), tie.alias("__tie")) < F.col("__stop")))
    copies = F.when(F.col("n_tokens") > 0, F.col("__full") + F.when(more & (F.col("__rest") > 0), 1).otherwise(0)).otherwise(0)
    return rows.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("int")).drop("__lang", "__source", "__full", "__rest", "__order", "__bucket", "__end", "__stop")


def mixture(df: DataFrame, mix: Mix = MIX) -> DataFrame:
    """The mixed corpus: every document as often as it is read, with the columns of ``df``."""
    out = mix_sources(df, mix).where("copies > 0")
    return out.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*df.columns)


def op5_hierarchical_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix_sources(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _sql_weight(name: str, weights: dict) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in sorted(weights.items())) + " ELSE 1.0::DOUBLE END" if weights else "1.0::DOUBLE"


def _sql_share(table: str, parent: str, budget: str, out: str) -> str:
    return f"""
  SELECT * EXCLUDE (lv), least(cap, greatest(0.0::DOUBLE, weight * max(lv) OVER (PARTITION BY {parent}))) AS {out} FROM (
    SELECT *, ({budget} - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM {table})"""


OP5_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, coalesce(lang, '') AS l, coalesce(source, '') AS s,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n,
                  CASE WHEN regexp_matches(source, '[0-4]$') THEN 'web' WHEN regexp_matches(source, '[5-7]$') THEN 'books'
                       WHEN regexp_matches(source, '[89]$') THEN 'forum' ELSE 'web' END AS domain FROM documents),
lf AS (SELECT domain, l, s, s AS name, CAST(sum(n) AS BIGINT) AS tokens, sum(n)::DOUBLE * {MIX.max_epochs} AS cap, {_sql_weight('s', MIX.source_weights)} AS weight FROM d WHERE n > 0 GROUP BY domain, l, s),
la AS (SELECT domain, l, l AS name, sum(cap) AS cap, sum(tokens) AS tokens, {_sql_weight('l', MIX.language_weights)} AS weight FROM lf GROUP BY domain, l),
dm AS (SELECT domain, domain AS name, 1 AS one, sum(cap) AS cap, sum(tokens) AS tokens, {_sql_weight('domain', MIX.domain_weights)} AS weight FROM la GROUP BY domain),
dg AS (SELECT *, floor({MIX.total}::DOUBLE * sum(tokens) OVER ()) AS goal FROM dm),
db AS ({_sql_share('dg', 'one', 'goal', 'domain_budget')}),
lg AS (SELECT la.*, db.domain_budget FROM la JOIN db USING (domain)),
lb AS ({_sql_share('lg', 'domain', 'domain_budget', 'lang_budget')}),
fg AS (SELECT lf.*, lb.lang_budget FROM lf JOIN lb USING (domain, l)),
fb AS ({_sql_share('fg', 'domain, l', 'lang_budget', 'budget')}),
pl AS (SELECT domain, l, s, CAST(floor(budget + 1e-6) AS BIGINT) // tokens AS whole, CAST(floor(budget + 1e-6) AS BIGINT) % tokens AS rest FROM fb),
r AS (SELECT d.*, pl.whole, pl.rest, sum(n) OVER (PARTITION BY d.domain, d.l, d.s ORDER BY md5('{MIX.seed}:' || pl.whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(text))), md5(text)
             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM d JOIN pl USING (domain, l, s) WHERE n > 0)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(whole + CASE WHEN run <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r
UNION ALL SELECT doc_id, domain, lang, source, n, 0 FROM d WHERE n = 0
"""
