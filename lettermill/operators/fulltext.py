"""Full-text search over a kept index: postings with positions in term buckets, segments for changes, match expressions with BM25.

An index has segments. A change writes one more: the postings of new and changed mail, and the ids whose older
postings count no longer. One commit makes both visible, with the number and length of the mail that is left. A
query opens the buckets of its terms alone.
"""

import math
import re
import zlib
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.operators.search import B, FIELDS, K1, like_search
from lettermill.sources.snapshots import Commits

#: Letters of a term that its bucket goes by. A prefix of as many letters or more is in one bucket.
LETTERS = 2
#: What separates terms. Python's \w has the same letters and digits, and "_", which separates too.
SEPARATORS = r"[^\p{L}\p{N}]+"
_SPLIT = re.compile(r"[\W_]+")


class MatchError(ValueError):
    """A match expression that cannot be read."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; with ``prefix`` the last is the beginning of one; with ``first`` they begin a field."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    fields: frozenset[str] | None = None


@dataclass(frozen=True)
class Near:
    """Phrases of one field with at most ``gap`` terms between the end of the first and the start of the last."""

    phrases: tuple[Phrase, ...]
    gap: int = 10

    @property
    def fields(self):
        return self.phrases[0].fields


_TOKENS = re.compile(r'\s*(?:("(?:[^"]|"")*")|(AND|OR|NOT|NEAR)(?=[\s(]|$)|([\w\u0080-\U0010ffff]+)|(.))')


def parse_match(text: str, fields: tuple[str, ...]) -> tuple:
    """The tree of a match expression: a ``Phrase``, a ``Near``, or (AND, OR or NOT, left, right).

    ``a b`` and ``a AND b``, ``a OR b``, ``a NOT b``, ``"a phrase"``, ``a + b``, ``pre*``, ``^first``, ``NEAR(a "b c", 5)``,
    ``field : a``, ``{f g} : a``, ``- f : a``, parentheses. Words side by side bind closest, then NOT, AND, OR.
    """
    tokens = [("quoted", q) if q else ("op", op) if op else ("word", w) if w else ("sign", s) for q, op, w, s in _TOKENS.findall(text) if q or op or w or s.strip()]
    at = 0

    def peek(k: int = 0):
        return tokens[at + k] if at + k < len(tokens) else ("end", "")

    def take(*wanted: str) -> str:
        nonlocal at
        kind, value = peek()
        if wanted and value not in wanted:
            raise MatchError(f"{' or '.join(wanted)} expected, not {value or 'the end'}")
        at += 1
        return value

    def phrase() -> Phrase:
        first = peek() == ("sign", "^") and bool(take())
        terms: list[str] = []
        while True:
            kind, value = peek()
            if kind not in ("quoted", "word"):
                raise MatchError(f"a term expected, not {value or 'the end'}")
            take()
            terms += [t for t in _SPLIT.split(value.lower()) if t]
            if peek() != ("sign", "+"):
                break
            take()
        prefix = peek() == ("sign", "*") and bool(take())
        return Phrase(tuple(terms), prefix, first)

    def near() -> Near:
        take("NEAR")
        take("(")
        found, gap = [], 10
        while peek()[1] not in (")", ","):
            found.append(phrase())
        if take(")", ",") == ",":
            if not peek()[1].isdigit():
                raise MatchError("NEAR wants a number")
            gap = int(take())
            take(")")
        if not found:
            raise MatchError("NEAR without a phrase")
        return Near(tuple(found), gap)

    def named() -> frozenset[str] | None:
        """The fields of a column filter that stands here."""
        nonlocal at
        start, without = at, False
        if peek() == ("sign", "-"):
            take()
            without = True
        names = []
        if peek() == ("sign", "{"):
            take()
            while peek() != ("sign", "}"):
                names.append(take())
                if peek()[0] == "end":
                    raise MatchError("} is missing")
            take()
        elif peek()[0] in ("word", "quoted"):
            names.append(take().strip('"'))
        if not names or peek() != ("sign", ":"):
            if without or (names and tokens[start] == ("sign", "{")):
                raise MatchError(": expected")
            at = start
            return None
        take()
        unknown = set(names) - set(fields)
        if unknown:
            raise MatchError(f"no such field: {', '.join(sorted(unknown))}")
        return frozenset(fields) - frozenset(names) if without else frozenset(names)

    def within(node, only: frozenset[str] | None):
        if only is None:
            return node
        if isinstance(node, tuple):
            return (node[0], *[within(x, only) for x in node[1:]])
        if isinstance(node, Near):
            return replace(node, phrases=tuple(within(p, only) for p in node.phrases))
        return replace(node, fields=only if node.fields is None else node.fields & only)

    def single():
        only = named()
        if peek() == ("sign", "("):
            take()
            node = either()
            take(")")
        else:
            node = near() if peek() == ("op", "NEAR") else phrase()
        return within(node, only)

    def beside():
        node = single()
        while peek()[0] in ("word", "quoted") or peek() in (("op", "NEAR"), ("sign", "^"), ("sign", "{"), ("sign", "-"), ("sign", "(")):
            node = ("AND", node, single())
        return node

    def chain(name: str, below):
        node = below()
        while peek() == ("op", name):
            take()
            node = (name, node, below())
        return node

    def either():
        return chain("OR", lambda: chain("AND", lambda: chain("NOT", beside)))

    node = either()
    if peek()[0] != "end":
        raise MatchError(f"unexpected {peek()[1]}")
    return node


def field_terms(field: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(field), F.lit(""))), SEPARATORS), lambda t: t != "")


#: Mails whose terms are grouped at once in a task.
GROUPED = 500


def positions(mail: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(term, key, field, positions, dl): where each term stands in each field of each mail, and how many terms the mail has.

    One mail's postings never depend on another's, so terms are grouped in the task that reads the mail, and no term travels alone.
    """
    read = mail.select(F.col(key).alias("key"), *[field_terms(f).alias(f"t{i}") for i, f in enumerate(fields)])

    def work(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, GROUPED):
                batch = whole.slice(start, GROUPED)
                sizes = [batch.column(f"t{i}").value_lengths().to_numpy(zero_copy_only=False).astype("int64") for i in range(len(fields))]
                dl = pa.array(sum(sizes).astype("int32"))
                for i, f in enumerate(fields):
                    terms = batch.column(f"t{i}").flatten().dictionary_encode()
                    if not len(terms):
                        continue
                    mails = np.repeat(np.arange(batch.num_rows), sizes[i])
                    at = np.arange(len(terms)) - np.repeat(np.cumsum(sizes[i]) - sizes[i], sizes[i])
                    each = mails * len(terms.dictionary) + terms.indices.to_numpy()
                    order = np.argsort(each, kind="stable")
                    each = each[order]
                    starts = np.flatnonzero(np.r_[True, each[1:] != each[:-1]])
                    mine, term = (pa.array(x) for x in np.divmod(each[starts], len(terms.dictionary)))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(each)].astype("int32")), pa.array(at[order].astype("int32")))
                    yield pa.RecordBatch.from_arrays([terms.dictionary.take(term), batch.column("key").take(mine), pa.array([f] * len(starts), pa.string()), lists, dl.take(mine)], names=["term", "key", "field", "positions", "dl"])

    return read.mapInArrow(work, f"term string, key {read.schema['key'].dataType.simpleString()}, field string, positions array<int>, dl int")


class MailIndex:
    """The index of ``fields`` of mail with unique ``key``, below ``path``.

    ``update`` indexes new and changed mail and forgets deleted one; only the delta's texts are read. ``compact`` makes one segment
    of all. ``match`` searches. One writer at a time; a crash leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "gmail_id", fields: tuple[str, ...] = tuple(FIELDS), buckets: int = 256):
        self.spark, self.path, self.key, self.fields, self.buckets = spark, path.rstrip("/"), key, tuple(fields), buckets
        self.commits = Commits(spark, self.path)

    def _state(self) -> dict[str, dict[str, str]]:
        version = self.commits.newest()
        if version is None:
            raise FileNotFoundError(f"no index below {self.path}")
        state: dict[str, dict[str, str]] = {"segment": {}, "dead": {}, "stats": {}, "key": {}}
        for kind, name, value in self.commits.read(version):
            state[kind][name] = value
        return state

    def _schema(self, table: str, key_type: str) -> T.StructType:
        columns = {"postings": f"term string, key {key_type}, field string, positions array<int>, dl int, __segment int, __bucket int", "docs": f"key {key_type}, dl int, __segment int", "dead": f"key {key_type}, __segment int"}
        return T.StructType.fromDDL(columns[table])

    def _table(self, table: str, state: dict) -> DataFrame:
        schema = self._schema(table, state["key"]["type"])
        segments = state["dead" if table == "dead" else "segment"]
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/__segment={v}" for v in segments])

    def _alive(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows of mail that no later segment has replaced or deleted."""
        if not state["dead"]:
            return rows
        dead = self._table("dead", state).groupBy(F.col("key").alias("__dead")).agg(F.max("__segment").alias("__until"))
        return rows.join(dead, (F.col("key") == F.col("__dead")) & (F.col("__segment") < F.col("__until")), "left_anti")

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.left("term", F.lit(LETTERS)).cast("binary")), F.lit(self.buckets)).cast("int")

    def _write(self, version: int, postings: DataFrame, docs: DataFrame) -> None:
        # Within a bucket by term, so that a file's statistics tell which terms it may hold; large buckets are several files.
        rows = postings.withColumn("__bucket", self._bucket()).hint("rebalance", "__bucket").sortWithinPartitions("__bucket", "term", "key")
        rows.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/postings/__segment={version}")
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/__segment={version}")

    def _commit(self, version: int, key_type: str, segments, dead, docs: int, length: int) -> int:
        rows = [("key", "type", key_type), ("stats", "docs", str(docs)), ("stats", "length", str(length))]
        self.commits.put(version, rows + [("segment", str(v), "") for v in segments] + [("dead", str(v), "") for v in dead])
        return version

    def update(self, delta: DataFrame, deleted: DataFrame | None = None) -> int:
        """Index the mail of ``delta`` (each key once) in place of what it was, and forget the keys in ``deleted``."""
        last = self.commits.newest()
        key_type = delta.schema[self.key].dataType.simpleString()
        state = self._state() if last is not None else {"segment": {}, "dead": {}, "stats": {"docs": "0", "length": "0"}, "key": {"type": key_type}}
        version = (last or 0) + 1
        lengths = sum((F.size(field_terms(f)) for f in self.fields), F.lit(0)).cast("int")
        self._write(version, positions(delta, self.key, self.fields), delta.select(F.col(self.key).alias("key"), lengths.alias("dl")))
        new = self.spark.read.schema(self._schema("docs", key_type)).parquet(f"{self.path}/docs/__segment={version}")
        added = new.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        dead, lost = list(state["dead"]), (0, 0)
        if state["segment"]:
            gone = new.select("key") if deleted is None else new.select("key").unionByName(deleted.select(F.col(self.key).cast(key_type).alias("key")))
            gone.distinct().write.mode("overwrite").parquet(f"{self.path}/dead/__segment={version}")
            gone = self.spark.read.schema(self._schema("dead", key_type)).parquet(f"{self.path}/dead/__segment={version}").select("key")
            lost = self._alive(self._table("docs", state), state).join(gone, "key", "left_semi").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            dead.append(str(version))
        n, length = int(state["stats"]["docs"]) + added[0] - lost[0], int(state["stats"]["length"]) + added[1] - lost[1]
        return self._commit(version, key_type, [*state["segment"], str(version)], dead, n, length)

    def compact(self) -> int:
        """One segment of all that is alive, and no dead ids; a query then reads as few files as it can. Older folders go."""
        state, version = self._state(), self.commits.newest() + 1
        self._write(version, self._alive(self._table("postings", state), state).drop("__segment", "__bucket"), self._alive(self._table("docs", state), state).drop("__segment"))
        self._commit(version, state["key"]["type"], [str(version)], [], int(state["stats"]["docs"]), int(state["stats"]["length"]))
        for table in ("postings", "docs", "dead"):
            for name in self.commits.children(f"{self.path}/{table}"):
                if name != f"__segment={version}":
                    self.commits.remove(f"{self.path}/{table}/{name}")
        return version

    def postings(self) -> DataFrame:
        """(term, key, field, positions, dl) of all that is alive."""
        state = self._state()
        return self._alive(self._table("postings", state), state).drop("__segment", "__bucket")

    def _opened(self, phrases: list[Phrase], state: dict) -> DataFrame:
        """The postings of some phrases' terms, from their buckets."""
        whole = {t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)}
        starts = {p.terms[-1] for p in phrases if p.prefix}
        rows = self._table("postings", state)
        if all(len(s) >= LETTERS for s in starts):
            rows = rows.where(F.col("__bucket").isin(*sorted({zlib.crc32(t[:LETTERS].encode()) % self.buckets for t in whole | starts})))
        fits = F.lit(False)
        if whole:
            fits = fits | F.col("term").isin(*sorted(whole))
        for s in sorted(starts):
            fits = fits | F.col("term").startswith(s)
        return self._alive(rows.where(fits), state)

    def match(self, query: str, limit: int = 50) -> DataFrame:
        """(key, score) of the best ``limit`` mails that a match expression fits, see ``parse_match``.

        The score adds up BM25 over the expression's phrases and NEAR groups, with the weights of ``FIELDS``. A phrase is found by the
        positions of its terms: those that begin at one place are grouped, and as many as the phrase has terms must meet there.
        """
        tree = parse_match(query, self.fields)
        units: list[Phrase | Near] = []

        def collect(node):
            if isinstance(node, tuple):
                for x in node[1:]:
                    collect(x)
            elif node not in units:
                units.append(node)

        collect(tree)
        phrases = list(dict.fromkeys(p for u in units for p in (u.phrases if isinstance(u, Near) else [u]) if p.terms))
        state = self._state()
        rows = self._opened(phrases, state)
        hits = []
        for i, p in enumerate(phrases):
            for j, term in enumerate(p.terms):
                here = F.col("term").startswith(term) if p.prefix and j == len(p.terms) - 1 else F.col("term") == term
                here = here & F.col("field").isin(*sorted(p.fields)) if p.fields is not None else here
                hits.append(F.when(here, F.struct(F.lit(i).alias("phrase"), F.lit(j).alias("part"))))
        rows = rows.select("key", "dl", "field", "positions", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("key", "dl", "field", "positions", "h.*")
        # Where phrases begin: the places at which all parts of one meet. All of a mail is brought together once, before places are rows.
        placed = rows.repartition("key").select("key", "dl", "field", "phrase", "part", F.explode("positions").alias("at")).withColumn("begin", F.col("at") - F.col("part"))
        begins = placed.groupBy("key", "dl", "field", "phrase", "begin").agg(F.count_distinct("part").alias("parts"))
        met = F.lit(False)
        for i, p in enumerate(phrases):
            met = met | ((F.col("phrase") == i) & (F.col("parts") == len(p.terms)) & (F.col("begin") == 0 if p.first else F.lit(True)))
        begins = begins.where(met)
        by_field = begins.groupBy("key", "dl", "field").agg(*[F.collect_list(F.when(F.col("phrase") == i, F.col("begin"))).alias(f"b{i}") for i in range(len(phrases))])

        def count(u: Phrase | Near) -> Column:
            if isinstance(u, Phrase):
                return F.size(f"b{phrases.index(u)}") if u.terms else F.lit(0)
            of = [(F.col(f"b{phrases.index(p)}"), len(p.terms)) for p in u.phrases if p.terms]
            def clumps(own: Column, length: int) -> Column:
                # A clump is counted at its first phrase: every other one begins there or behind, within the gap.
                together = lambda s: reduce(and_, [F.exists(other, lambda o: (o >= s) & (o - s - length <= u.gap)) for other, _ in of])
                return F.size(F.filter(own, together))

            return sum((clumps(*x) for x in of), F.lit(0))

        weight = F.lit(0.0)
        for f in self.fields:
            weight = F.when(F.col("field") == f, FIELDS.get(f, 1.0)).otherwise(weight)
        mails = by_field.select("key", "dl", weight.alias("w"), *[count(u).alias(f"n{i}") for i, u in enumerate(units)]) if phrases else rows.select("key", "dl", F.lit(0.0).alias("w"), *[F.lit(0).alias(f"n{i}") for i in range(len(units))])
        mails = mails.groupBy("key", "dl").agg(*[F.sum(F.col("w") * F.col(f"n{i}")).alias(f"tf{i}") for i in range(len(units))])

        def fits(node) -> Column:
            if not isinstance(node, tuple):
                return F.col(f"tf{units.index(node)}") > 0
            left, right = fits(node[1]), fits(node[2])
            return left & right if node[0] == "AND" else left | right if node[0] == "OR" else left & ~right

        n, length = int(state["stats"]["docs"]), int(state["stats"]["length"])
        # One number a unit of the query.
        found = mails.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(units))]).first()
        score = F.lit(0.0)
        for i in range(len(units)):
            tf, df = F.col(f"tf{i}"), found[f"df{i}"]
            score = score + F.lit(math.log(1 + (n - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(length / n if n and length else 1.0)))
        return mails.where(fits(tree)).select(F.col("key").alias(self.key), F.round(score, 6).alias("score")).orderBy(F.desc("score"), self.key).limit(limit)


def search_mail(index: MailIndex, mail: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The mails that ``query`` matches, best first; a query that is no match expression is looked for as a substring, newest first."""
    try:
        best = index.match(query, limit)
    except MatchError:
        return like_search(mail, query, limit, columns=index.fields, key=index.key)
    return mail.join(F.broadcast(best), index.key).orderBy(F.desc("score"), index.key).drop("score")
