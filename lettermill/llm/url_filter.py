r"""URL filters by a Bloom filter cascade (DataFrame functions only).

Level 0 encodes the listed keys. Level 1 encodes those keys of the corpus's complete key universe
that level 0 takes in by mistake, level 2 the listed keys that level 1 takes in, and so on until no
mistake is left. Level 0 is sized by the universe, so that it takes in about 0.7 keys by mistake for
each listed one (more where the list is of a hundred keys), and later levels hold ever fewer. A key of the universe is listed exactly if the first level that rejects it is odd.
Rows are then judged by reading bits of constant arrays: no join, no shuffle.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.scratch import Scratch

#: Listed keys: these sites under every ending that sites are listed for, and all names below them.
SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ENDINGS = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{site}.{ending}" for site in SITES for ending in ENDINGS)
#: (verdict, host, path): the rule's host and its subdomains, paths that start with the rule's; the longest wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Least bits a key and positions a key of a level; level 0 takes more where the universe is far larger than the list.
BITS_PER_KEY = 10
HASHES = 5
#: Most keys that one level may hold: 20 MB of bits at 10 bits a key, sent with the plan. A list with more is answered by a join, exactly too.
MOST_KEYS = 1 << 24
#: A level over this many keys still mistakes ever fewer; a cascade that needs more levels than this is a bug.
MOST_LEVELS = 40


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path up to ``? #``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(authority, upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and each name above it, longest first: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits, and ``hashes`` positions a key."""

    bits: bytes
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        # Shifted, so that the sums below stay within 64 bits.
        first, second = (F.shiftright(F.xxhash64(key, F.lit(self.seed + i)), 8) for i in range(2))
        # An odd step reaches all bits, and cubes part keys that share a step: this counts where the filter is small.
        second = second.bitwiseOR(F.lit(1).cast("long"))
        return [F.pmod(first + second * F.lit(i) + F.lit(i**3), F.lit(8 * len(self.bits)).cast("long")) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        def is_set(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), F.floor(p / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1

        # The bits stand in the plan once a level, whatever the number of hashes.
        return F.forall(F.array(*self.positions(key)), is_set)


def level_size(n: int, others: int) -> tuple[int, int]:
    """(bits a key, positions a key) of a filter of n keys that takes in about 0.7 n of ``others`` by mistake, or 1 % of them if that is less."""
    halvings = max(0.0, math.log2(max(others, 1) / max(n, 1) * math.sqrt(2)))
    return max(BITS_PER_KEY, math.ceil(halvings / math.log(2))), max(HASHES, math.ceil(halvings))


def build_level(keys: DataFrame, n: int, seed: int, bits: int = BITS_PER_KEY, hashes: int = HASHES) -> Level:
    """A Bloom filter over the column ``key`` of n rows; words are OR-ed in the executors, at most n * bits / 64 reach the driver."""
    words = max(1, -(-n * bits // 64))
    blank = Level(bytes(8 * words), hashes, seed)
    ones = keys.select(F.explode(F.array(*blank.positions(F.col("key")))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")
    found = ones.groupBy(F.floor(F.col("p") / F.lit(64)).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    got = {r["word"]: r["bits"] for r in found.collect()}
    return Level(b"".join(got.get(i, 0).to_bytes(8, "little", signed=True) for i in range(words)), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def has(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        out = F.lit(False) if len(self.levels) % 2 == 0 else F.lit(True)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
        return out if self.levels else F.lit(False)


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade | None:
    """A cascade over ``universe`` (all keys that will ever be asked for) that answers membership in ``listed``; both have a column ``key``.

    Listed keys outside the universe are left out: nothing asks for them. Null keys are ignored.
    Each level's candidates are those of two levels before that the last level let pass. None if a level would hold more
    than ``MOST_KEYS``.
    """
    scratch = Scratch(universe.sparkSession, "cascade")
    mark = listed.where("key is not null").select("key").distinct().withColumn("__listed", F.lit(True))
    keys = universe.where("key is not null").select("key").distinct().join(mark, "key", "left").select("key", F.coalesce("__listed", F.lit(False)).alias("listed"))
    keys = scratch.save(keys, "keys")
    sides = {True: keys.where("listed"), False: keys.where("not listed")}
    levels: list[Level] = []
    n = sides[True].count()
    size = level_size(n, keys.count() - n)
    while n:
        if n > MOST_KEYS:
            return None
        turn = len(levels) % 2 == 0
        levels.append(build_level(sides[turn], n, 2 * len(levels) + 1, *(() if levels else size)))
        sides[not turn] = sides[not turn].where(levels[-1].has(F.col("key")))
        n = sides[not turn].count()
        if len(levels) >= MOST_LEVELS:
            raise RuntimeError("the cascade does not shrink")
    scratch.drop("keys")
    return Cascade(tuple(levels))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. A rule's name is its host and path."""
    rule = verdict = F.lit(None).cast("string")
    for said, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == F.lit(name)) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge_urls(df: DataFrame, url: str = "url", listed=LISTED, rules=RULES) -> DataFrame:
    """``df`` with ``host, path, rule, verdict``.

    - A fitting rule decides; else ``block`` if the host or a name above it is listed, else ``allow``.
    - Null url, or one without ``://``: host and path are empty, no rule fits, verdict ``allow``.
    - Columns of these names are replaced, others kept; repeated rows are judged alike; an empty table gives no rows.
    - ``listed`` is a sequence of names or a DataFrame with a column ``key``.
    """
    spark = df.sparkSession
    host, path = split_url(F.col(url))
    names = df.select(host.alias("host")).distinct()
    universe = names.select(F.explode(suffixes(F.col("host"))).alias("key"))
    keys = listed if isinstance(listed, DataFrame) else spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in listed]).cast("array<string>")).alias("key"))
    cascade = build_cascade(universe, keys)
    out = df.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if cascade:
        on_list = F.exists(suffixes(F.col("host")), cascade.has)
    else:
        below = names.select("host", F.explode(suffixes(F.col("host"))).alias("key")).join(keys.distinct(), "key").select(F.col("host").alias("__on")).distinct()
        out, on_list = out.join(below, F.col("host") == F.col("__on"), "left"), F.col("__on").isNotNull()
    out = out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(on_list, F.lit("block")).otherwise(F.lit("allow")))})
    return out if cascade else out.drop("__on")


def op9_bloom_cascade(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _case(column: int) -> str:
    """CASE over the rules, longest first: the name (1) or the verdict (0)."""
    whens = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(said, h + p)[column]}'"
        for said, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {whens} END"


OP9_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {_case(1)} AS rule,
       coalesce({_case(0)}, CASE WHEN {" OR ".join(f"host = '{n}' OR ends_with(host, '.{n}')" for n in LISTED)} THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""
