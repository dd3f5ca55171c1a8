"""Keyed tables in hash buckets, and the mail store on them: a change rewrites only the buckets it touches, and one commit makes it visible."""

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.operators import store


class Commits:
    """Numbered versions below ``path``, each a small table (kind, name, value) that a Spark job writes.

    A version counts once its job has left the success mark; until then, and after a crash, the one before is the newest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def children(self, path: str) -> list[str]:
        """Names below a folder; none if it is not there. Other faults of the file system are raised."""
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def versions(self) -> list[int]:
        found = sorted(int(n[1:]) for n in self.children(f"{self.path}/_versions") if n[1:].isdigit())
        return [n for n in found if "_SUCCESS" in self.children(f"{self.path}/_versions/v{n}")]

    def newest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int) -> list[tuple[str, str, str]]:
        """The rows of a version: as many as the table has buckets or segments, which bounds them."""
        return [tuple(r) for r in self.spark.read.schema("kind string, name string, value string").json(f"{self.path}/_versions/v{version}").collect()]

    def put(self, version: int, rows: list[tuple[str, str, str]]) -> None:
        table = self.spark.createDataFrame(rows, "kind string, name string, value string").coalesce(1)
        table.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").json(f"{self.path}/_versions/v{version}")


@dataclass(frozen=True)
class State:
    """What one commit says: schema, the version that holds each bucket, the last batch of each source, applied migrations by name."""

    version: int
    schema: T.StructType
    at: dict[int, int]
    batches: dict[str, int]
    migrations: dict[str, str]


@dataclass(frozen=True)
class Migration:
    """A change of a store's columns: new ones by SQL expressions over the old, then new names."""

    name: str
    add: dict[str, str] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)

    @property
    def text(self) -> str:
        """The checksum of what it does."""
        return hashlib.md5(json.dumps([self.name, self.add, self.rename], sort_keys=True).encode()).hexdigest()

    def forward(self, rows: DataFrame) -> DataFrame:
        clash = ({*self.add} | {*self.rename.values()}) & {*rows.columns}
        if clash:
            raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")
        return rows.withColumns({c: F.expr(e) for c, e in self.add.items()}).withColumnsRenamed(self.rename)

    def backward(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({new: old for old, new in self.rename.items()}).drop(*self.add)


class KeyedStore:
    """A table whose rows lie in ``buckets`` folders by the hash of ``key``.

    ``merge`` reads and rewrites only the buckets of the changed keys, into the folder of a new version; the commit then names, for
    each bucket, the version that holds it. Readers keep the version they opened. Buckets should be so many that one is a few files; large ones are
    written by several tasks. One writer at a time. Folders that no kept version names are removed by ``vacuum``.
    A merge may carry ``batch`` = (source, number): a number that the source has already reached is not applied again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.commits = Commits(spark, self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets))

    def _state(self, version: int | None = None) -> "State":
        version = version if version is not None else self.commits.newest()
        if version is None:
            raise FileNotFoundError(f"no snapshot below {self.path}")
        rows = self.commits.read(version)
        of = lambda kind: [(n, v) for k, n, v in rows if k == kind]
        return State(version, T.StructType.fromJson(json.loads(of("schema")[0][1])), {int(n): int(v) for n, v in of("bucket")}, {n: int(v) for n, v in of("batch")}, dict(sorted(of("migration"), key=lambda x: x[0])))

    def _folders(self, schema: T.StructType, at: dict[int, int]) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/__version={v}/__bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    def version(self) -> int | None:
        return self.commits.newest()

    def read(self, version: int | None = None) -> DataFrame:
        state = self._state(version)
        return self._folders(state.schema, state.at)

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def get(self, ids: DataFrame) -> DataFrame:
        """The rows of the keys in ``ids``, from their buckets alone."""
        state = self._state()
        mine = self._folders(state.schema, {b: state.at[b] for b in self._touched(ids) if b in state.at})
        return mine.join(ids.select(self.key).distinct(), self.key, "left_semi")

    def applied(self, source: str) -> int:
        """The last batch number of a source, -1 if there is none."""
        return self._state().batches.get(source, -1)

    def _write(self, version: int, rows: DataFrame, at: dict[int, int], touched: list[int] | None, batches: dict[str, int], migrations: dict[str, str]) -> int:
        """Write ``rows`` as the buckets ``touched`` (None: all) of a version and commit it."""
        folder = f"{self.path}/data/__version={version}"
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        rows.withColumn("__bucket", self._bucket()).hint("rebalance", "__bucket").write.partitionBy("__bucket").mode("overwrite").parquet(folder)
        made = {int(n.partition("=")[2]) for n in self.commits.children(folder) if n.startswith("__bucket=")}
        at = {} if touched is None else {b: v for b, v in at.items() if b not in touched}
        at |= {b: version for b in made}
        of = lambda kind, values: [(kind, str(n), str(v)) for n, v in sorted(values.items())]
        self.commits.put(version, [("schema", "", schema.json()), *of("bucket", at), *of("batch", batches), *of("migration", migrations)])
        return version

    def create(self, rows: DataFrame) -> int:
        """The first version, or one that replaces all before."""
        return self._write((self.commits.newest() or 0) + 1, rows, {}, None, {}, {})

    def migrate(self, migrations: list["Migration"]) -> int:
        """Apply those of ``migrations`` that are not applied yet, in order, as one version; one that was applied with another text is an error."""
        state = self._state()
        for m in migrations:
            if state.migrations.get(m.name, m.text) != m.text:
                raise ValueError(f"migration {m.name} has changed since it was applied")
        due = [m for m in migrations if m.name not in state.migrations]
        if not due:
            return state.version
        rows = self._folders(state.schema, state.at)
        for m in due:
            rows = m.forward(rows)
        return self._write(state.version + 1, rows, {}, None, state.batches, state.migrations | {m.name: m.text for m in due})

    def roll_back(self, migration: "Migration") -> int:
        """Undo an applied migration: added columns go, names come back. The rows stay those of now."""
        state = self._state()
        if state.migrations.get(migration.name) != migration.text:
            raise ValueError(f"migration {migration.name} is not applied, or has changed since")
        rows = migration.backward(self._folders(state.schema, state.at))
        return self._write(state.version + 1, rows, {}, None, state.batches, {n: t for n, t in state.migrations.items() if n != migration.name})

    def migration_status(self, migrations: list["Migration"]) -> DataFrame:
        """(name, status): pending, applied, or changed."""
        done = self._state().migrations
        rows = [(m.name, "pending" if m.name not in done else "applied" if done[m.name] == m.text else "changed") for m in migrations]
        return self.spark.createDataFrame(rows, "name string, status string")

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Commit ``how(rows of the touched buckets, changes)``; the version stays if there are no changes or the batch was applied."""
        state = self._state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return state.version
        changes = changes.persist()
        try:
            touched = self._touched(changes)
            if not touched and not batch:
                return state.version
            old = self._folders(state.schema, {b: state.at[b] for b in touched if b in state.at})
            # The store's columns and types; a value that may be null stands where one of the schema could not.
            rows = how(old, changes)
            rows = rows.select(*[F.col(f.name) if rows.schema[f.name].dataType.simpleString() == f.dataType.simpleString() else F.col(f.name).cast(f.dataType).alias(f.name) for f in state.schema])
            return self._write(state.version + 1, rows, state.at, touched, state.batches | ({batch[0]: batch[1]} if batch else {}), state.migrations)
        finally:
            changes.unpersist()

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` versions, and the folders that none of those names."""
        versions = self.commits.versions()
        kept = versions[-max(keep, 1) :]
        used = {v for n in kept for v in self._state(n).at.values()}
        for name in self.commits.children(f"{self.path}/data"):
            if int(name.partition("=")[2]) not in used:
                self.commits.remove(f"{self.path}/data/{name}")
        for n in versions:
            if n not in kept:
                self.commits.remove(f"{self.path}/_versions/v{n}")


class MailStore(KeyedStore):
    """save, get, find, delete, count and exists of mail by ``gmail_id``.

    Of several rows of one id the newest counts: by history id, then date, then what they hold. ``apply`` commits additions,
    deletions, restores and label changes as one version; the single operations are commits of one kind each.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, "gmail_id", buckets)

    def _newest(self, mail: DataFrame) -> DataFrame:
        order = [c for c in ("history_id", "date_received") if c in mail.columns]
        mail = mail.withColumn("__what", F.xxhash64(*mail.columns))
        return store.dedup(mail, "gmail_id", [*order, "__what"], "last").drop("__what")

    def create(self, mail: DataFrame) -> int:
        base = mail if "deleted_at" in mail.columns else mail.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
        return super().create(self._newest(base))

    def apply(self, mail: DataFrame | None = None, restored: DataFrame | None = None, deleted: DataFrame | None = None, labels: DataFrame | None = None, at: Column | None = None, batch: tuple[str, int] | None = None) -> int:
        """One version with all of: ``mail`` merged in, ``restored`` ids live again, ``deleted`` ids marked with ``at``, ``labels`` (gmail_id, add, remove) changed; in that order for each id."""
        parts = []
        if mail is not None:
            mine = [c for c in mail.columns if c in store.UPDATED]
            parts.append(self._newest(mail).select("gmail_id", F.struct(*mine).alias("mail")))
        if restored is not None:
            parts.append(restored.select("gmail_id").distinct().withColumn("back", F.lit(True)))
        if deleted is not None:
            parts.append(deleted.select("gmail_id").distinct().withColumn("gone", F.lit(True)))
        if labels is not None:
            parts.append(labels.select("gmail_id", F.struct("add", "remove").alias("labels_")))
        if not parts:
            return self._state().version
        changes = parts[0]
        for p in parts[1:]:
            changes = changes.unionByName(p, allowMissingColumns=True)
        # Each kind names an id once, so the first value that is there is the only one.
        changes = changes.groupBy("gmail_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in changes.columns if c != "gmail_id"])
        return self.merge(changes, lambda old, new: store.merge_changes(old, new, at if at is not None else F.localtimestamp()), batch)

    def upsert(self, delta: DataFrame) -> int:
        return self.apply(mail=delta)

    def delete(self, ids: DataFrame, at) -> int:
        return self.apply(deleted=ids, at=at)

    def relabel(self, changes: DataFrame) -> int:
        return self.apply(labels=changes)

    def restore(self, ids: DataFrame) -> int:
        return self.apply(restored=ids)

    def find(self, where) -> DataFrame:
        return store.live(self.read()).where(where)

    def count(self) -> int:
        return store.live(self.read()).count()

    def exists(self, ids: DataFrame) -> DataFrame:
        return store.exists(ids, store.live(self.get(ids)))


#: Letters of one message: what failed, how often, and what became of it.
LETTERS = "message_id string, failure_type string, error string, attempts long, first_failure timestamp_ntz, last_failure timestamp_ntz, next_retry timestamp_ntz, resolved boolean, resolved_at timestamp_ntz, reason string"


class DeadLetterStore(KeyedStore):
    """Failed operations by message and kind of failure. Attempts add up over batches; the fifth is the last.

    A message has one open letter a kind; those that were resolved stay until ``clean_up``, and a failure after that opens a new one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        super().__init__(spark, path, "message_id", buckets)
        if self.version() is None:
            self.create(spark.createDataFrame([], LETTERS))

    def add(self, failures: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Failures (message_id, failure_type, failed_at, error if there is one), several of a letter in one batch as several attempts."""
        from lettermill.operators import ledger

        one = failures if "error" in failures.columns else failures.withColumn("error", F.lit(None).cast("string"))
        new = one.groupBy(F.col("message_id").cast("string").alias("message_id"), "failure_type").agg(
            F.count("*").alias("n"), F.min("failed_at").alias("first"), F.max("failed_at").alias("last"), F.max_by("error", "failed_at").alias("said"))
        return self.merge(new, ledger.add_attempts, batch)

    def resolve(self, ids: DataFrame, at: Column, reason: str | None = None) -> int:
        """Open letters of the messages in ``ids`` are resolved."""
        hit = ids.select(F.col("message_id").cast("string").alias("message_id")).distinct()

        def how(old, new):
            j = old.join(new.withColumn("__hit", F.lit(True)), "message_id", "left")
            mine = F.col("__hit").isNotNull() & ~F.col("resolved")
            return j.withColumns({"resolved_at": F.when(mine, at.cast("timestamp_ntz")).otherwise(F.col("resolved_at")), "reason": F.when(mine, F.lit(reason)).otherwise(F.col("reason")), "next_retry": F.when(~mine, F.col("next_retry")), "resolved": F.col("resolved") | mine})

        return self.merge(hit, how)

    def reset(self, letters: DataFrame, at: Column) -> int:
        """Exhausted letters (message_id, failure_type) start again: no attempts, due as after a first failure at ``at``."""
        from lettermill.functions.text import next_retry

        hit = letters.select(F.col("message_id").cast("string").alias("message_id"), F.col("failure_type").alias("__kind")).distinct()

        def how(old, new):
            j = old.join(new.withColumnRenamed("message_id", "__id"), (F.col("message_id") == F.col("__id")) & (F.col("failure_type") == F.col("__kind")), "left")
            mine = F.col("__id").isNotNull() & ~F.col("resolved") & F.col("next_retry").isNull()
            return j.withColumns({"attempts": F.when(mine, 0).otherwise(F.col("attempts")), "next_retry": F.when(mine, next_retry(at, F.lit(1)).cast("timestamp_ntz")).otherwise(F.col("next_retry"))})

        return self.merge(hit, how)

    def clean_up(self, before: Column) -> int:
        """Resolved letters that were resolved before a time are removed, from the buckets that have any."""
        old = self.read().where(F.col("resolved") & (F.col("resolved_at") < before)).select("message_id").distinct()
        return self.merge(old, lambda rows, _: rows.where(~(F.col("resolved") & (F.col("resolved_at") < before))))

    def open(self) -> DataFrame:
        """The letters that are not resolved, as ``ledger.ready`` and ``ledger.exhausted`` take them."""
        return self.read().where(~F.col("resolved"))
