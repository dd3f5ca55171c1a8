"""The mail store as snapshots: upsert, soft delete, dedup, child tables, exports, ledgers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.text import export_domain, parse_address, split_addresses, year_month
from lettermill.operators.quality import pct

UPDATED = ("subject", "sender", "body", "labels", "snippet", "thread_id")


def upsert(store: DataFrame, delta: DataFrame, key: str = "gmail_id", columns=UPDATED) -> DataFrame:
    """``store`` merged with ``delta``: values of ``delta`` that are not null replace, new keys are added; with ``merge_action``.

    Keys are unique on both sides (see ``dedup``). Columns that only the store has stay; a full outer join by key.
    """
    mine = [c for c in columns if c in delta.columns and c in store.columns]
    d = delta.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in mine], F.lit(True).alias("__new"))
    s = store.withColumn("__old", F.lit(True))
    m = s.join(d, F.col(key) == F.col("__k"), "full")
    values = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in mine}
    changed = F.lit(False)
    for c in mine:
        changed = changed | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    action = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "kept").when(changed, "updated").otherwise("unchanged")
    return m.select(*[(values[c] if c in values else F.coalesce(F.col(c), F.col("__k")) if c == key else F.col(c)).alias(c) for c in store.columns], action.alias("merge_action"))


def soft_delete(store: DataFrame, ids: DataFrame, at: Column, key: str = "gmail_id") -> DataFrame:
    """``deleted_at`` set for live rows with a key in ``ids``."""
    hit = ids.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    out = store.join(hit, F.col(key) == F.col("__k"), "left")
    return out.withColumn("deleted_at", F.when(F.col("__hit") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("__k", "__hit")


def restore(store: DataFrame, ids: DataFrame, key: str = "gmail_id") -> DataFrame:
    hit = ids.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    out = store.join(hit, F.col(key) == F.col("__k"), "left")
    return out.withColumn("deleted_at", F.when(F.col("__hit").isNull(), F.col("deleted_at"))).drop("__k", "__hit")


def live(store: DataFrame) -> DataFrame:
    return store.where(F.col("deleted_at").isNull())


def dedup(df: DataFrame, key: str, order: list, keep: str = "first") -> DataFrame:
    """One row of each key: the first or last by ``order`` (column names).

    min_by / max_by over the whole row is combined on the map side, so a key with very many rows is never one task's list.
    """
    row, by = F.struct(*df.columns), F.struct(*order)
    one = df.groupBy(key).agg((F.min_by if keep == "first" else F.max_by)(row, by).alias("r"))
    return one.select("r.*")


def duplicate_groups(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """(key, n, first_id, last_id, surplus) of keys with several rows."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")).where("n > 1")
    return g.withColumn("surplus", F.col("n") - 1)


def net_added(added: DataFrame, deleted: DataFrame, key: str = "message_id") -> DataFrame:
    """Keys that were added and not deleted."""
    return added.select(key).distinct().join(deleted.select(key).distinct(), key, "left_anti")


def exists(ids: DataFrame, store: DataFrame, key: str = "gmail_id") -> DataFrame:
    """``ids`` with ``found``."""
    have = store.select(F.col(key).alias("__k")).distinct()
    return ids.join(have, F.col(key) == F.col("__k"), "left").withColumn("found", F.col("__k").isNotNull()).drop("__k")


def verify_manifest(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, status): verified, corrupted, missing or extra, from (path, sha256) on both sides."""
    m = manifest.select("path", F.col("sha256").alias("want"))
    d = disk.select(F.col("path").alias("d_path"), F.col("sha256").alias("have"))
    j = m.join(d, F.col("path") == F.col("d_path"), "full")
    status = F.when(F.col("path").isNull(), "extra").when(F.col("d_path").isNull(), "missing").when(F.col("want") == F.col("have"), "verified").otherwise("corrupted")
    return j.select(F.coalesce("path", "d_path").alias("path"), status.alias("status"))


def merge_backups(source: DataFrame, target: DataFrame, prefer: str = "larger") -> DataFrame:
    """(file_id, ext, action): drop (same size), replace or keep (``larger``, ``source`` or ``target`` wins), move, stay."""
    s = source.select("file_id", "ext", F.col("size").alias("s_size"))
    t = target.select(F.col("file_id").alias("t_id"), F.col("ext").alias("t_ext"), F.col("size").alias("t_size"))
    j = s.join(t, (F.col("file_id") == F.col("t_id")) & (F.col("ext") == F.col("t_ext")), "full")
    wins = {"larger": F.col("s_size") > F.col("t_size"), "source": F.lit(True), "target": F.lit(False)}[prefer]
    action = F.when(F.col("file_id").isNull(), "stay").when(F.col("t_id").isNull(), "move").when(F.col("s_size") == F.col("t_size"), "drop").when(wins, "replace").otherwise("keep")
    return j.select(F.coalesce("file_id", "t_id").alias("file_id"), F.coalesce("ext", "t_ext").alias("ext"), action.alias("action"))


def rename_conflicts(files: DataFrame, name: str = "name", order: str = "path") -> DataFrame:
    """``files`` with ``new_name``: the second and further rows of a name get _dup1, _dup2 ... before the extension."""
    i = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    dup = F.concat(F.lit("_dup"), F.col("__i").cast("string"))
    new = F.when(F.col("__i") == 0, F.col(name)).otherwise(F.concat(F.regexp_replace(F.col(name), r"\.[^.]*$", ""), dup, F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)))
    return files.withColumn("__i", i).withColumn("new_name", new).drop("__i")


def labels_table(mail: DataFrame, key: str = "gmail_id") -> DataFrame:
    """(key, label), each once."""
    return mail.select(key, F.explode("labels").alias("label")).where(F.trim("label") != "").select(key, F.trim("label").alias("label")).dropDuplicates([key, "label"])


def participants(mail: DataFrame, key: str = "gmail_id", roles=("from", "to", "cc", "bcc")) -> DataFrame:
    """(key, type, address, display_name, domain), each address once a type; header columns that are absent are skipped."""
    headers = [r for r in roles if r in mail.columns]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("type"), F.col(f"`{r}`").alias("header")) for r in headers]))
    rows = mail.select(key, each.alias("h")).select(key, "h.type", F.explode(split_addresses(F.col("h.header"))).alias("one"))
    rows = rows.select(key, "type", parse_address(F.col("one")).alias("a")).where("a.address is not null")
    rows = rows.groupBy(key, "type", F.col("a.address").alias("address")).agg(F.min("a.display_name").alias("display_name"))
    return rows.withColumn("domain", F.split_part(F.col("address"), F.lit("@"), F.lit(2)))


def export_rows(mail: DataFrame) -> DataFrame:
    """Rows of the Parquet export: domain, length, label flags, month."""
    tags = F.upper(F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ","))
    return mail.select(
        "gmail_id", "sender", export_domain(F.col("sender")).alias("sender_domain"), "subject", F.col("date_received").alias("date"), F.length(F.coalesce("body", F.lit(""))).alias("message_length"),
        tags.contains("ATTACHMENT").alias("has_attachments"), (~tags.contains("UNREAD")).alias("is_read"), year_month(F.col("date_received")).alias("year_month"))


def monthly_summary(mail: DataFrame, date: str = "date_received") -> DataFrame:
    m = mail.where(F.col(date).isNotNull()).withColumn("year_month", year_month(F.col(date)))
    return m.groupBy("year_month").agg(F.count("*").alias("n"), F.countDistinct("sender").alias("senders"), F.min(date).alias("first_mail"), F.max(date).alias("last_mail"), F.count_if(F.array_contains("labels", "error")).alias("flagged"))


def sender_summary(mail: DataFrame, least: int = 5, date: str = "date_received") -> DataFrame:
    """Senders with ``least`` mails or more."""
    return mail.groupBy("sender").agg(F.count("*").alias("n"), F.min(date).alias("first_mail"), F.max(date).alias("last_mail")).where(F.col("n") >= least)


def store_totals(mail: DataFrame, key: str = "gmail_id", date: str = "date_received") -> DataFrame:
    """One row: counts, distinct values, date range, distinct months."""
    return mail.agg(
        F.count("*").alias("total"), F.countDistinct("sender").alias("senders"), F.countDistinct(key).alias("ids"), F.min(date).alias("first_mail"), F.max(date).alias("last_mail"), F.countDistinct(year_month(F.col(date))).alias("months"))


def monthly_documents(mail: DataFrame, date: str = "date_received", key: str = "gmail_id") -> DataFrame:
    """(year_month, n, first_mail, last_mail, ids_digest): the envelope of each month's file; mail without a date is month 'unknown'.

    Envelopes carry no list of the mail: bodies are written by ``sources.writers.write_monthly_json``, a row each.
    """
    m = mail.withColumn("year_month", F.coalesce(year_month(F.col(date)), F.lit("unknown")))
    return m.groupBy("year_month").agg(F.count("*").alias("n"), F.min(date).alias("first_mail"), F.max(date).alias("last_mail"), F.sum(F.col(key).cast("long")).alias("ids_sum"))


def confidence_bands(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    c = F.col(confidence)
    band = F.when(c >= 0.8, "High").when(c >= 0.6, "Medium").when(c >= 0.4, "Low").otherwise("Very Low")
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def category_shares(df: DataFrame, category: str = "category", confidence: str = "confidence", skip: str | None = None) -> DataFrame:
    """(category, n, avg_confidence, pct of classified)."""
    df = df.where(F.col(category).isNotNull())
    total = df.agg(F.count("*"))
    out = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 3).alias("avg_confidence"))
    out = out.withColumn("pct", pct(F.col("n"), total.scalar(), 2))
    # By the count too, which only the groups have: on the category alone, rows would be filtered, and their texts classified once more for it.
    return out.where(F.when(F.col("n") > 0, F.col("category") != skip)) if skip else out


def category_senders(df: DataFrame, least: int = 3, k: int = 5, category: str = "category", sender: str = "sender") -> DataFrame:
    """(category, sender, n, rank): the k most frequent senders of each category with ``least`` mails or more."""
    n = df.groupBy(category, sender).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("n"), sender))).where(F.col("rank") <= k)


def quality_counts(df: DataFrame) -> DataFrame:
    """Automated, unsubscribe and thread counts of a three-signal classification, with shares."""
    out = df.agg(F.count("*").alias("total"), F.count_if(F.col("automated_score") > 0.5).alias("automated"), F.count_if("has_unsubscribe").alias("unsubscribe"), F.count_if("is_thread").alias("threads"))
    return out.withColumns({f"{c}_pct": pct(F.col(c), F.col("total")) for c in ("automated", "unsubscribe", "threads")})


def retain(df: DataFrame, group: str, order: str, keep: dict[str, int]) -> DataFrame:
    """The newest ``keep[state]`` rows of each state; states that are not named stay whole."""
    if not keep:
        return df
    limit = F.lit(None).cast("int")
    for state, n in keep.items():
        limit = F.when(F.col(group) == state, n).otherwise(limit)
    # Only limited states are ranked, and the largest limit as a constant lets each task drop most rows before the shuffle.
    limited = F.coalesce(F.col(group).isin(*keep), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    newest = df.where(limited).withColumn("__r", rank).where(F.col("__r") <= max(keep.values())).where(F.col("__r") <= limit).drop("__r")
    return newest.unionByName(df.where(~limited))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return dedup(df, key, [order], "last")


def change_labels(mail: DataFrame, add: list[str], remove: list[str], ids: DataFrame, key: str = "gmail_id") -> DataFrame:
    """Labels added and removed for the rows with a key in ``ids``; sorted, so that the result is defined."""
    hit = ids.select(F.col(key).alias("__k")).distinct()
    j = mail.join(hit, F.col(key) == F.col("__k"), "left")
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    new = F.array_sort(F.array_except(F.array_union(F.coalesce("labels", arr([])), arr(add)), arr(remove)))
    return j.withColumn("labels", F.when(F.col("__k").isNotNull(), new).otherwise(F.col("labels"))).drop("__k")


def relabel(mail: DataFrame, changes: DataFrame, key: str = "gmail_id") -> DataFrame:
    """Labels changed row by row: ``changes`` has (key, add, remove) with arrays, each key once; sorted, so that the result is defined."""
    c = changes.select(F.col(key).alias("__k"), F.col("add").alias("__add"), F.col("remove").alias("__remove"))
    none = F.array().cast("array<string>")
    new = F.array_sort(F.array_except(F.array_union(F.coalesce("labels", none), F.coalesce("__add", none)), F.coalesce("__remove", none)))
    j = mail.join(c, F.col(key) == F.col("__k"), "left")
    return j.withColumn("labels", F.when(F.col("__k").isNotNull(), new).otherwise(F.col("labels"))).select(*mail.columns)


def merge_changes(mail: DataFrame, changes: DataFrame, at: Column, key: str = "gmail_id") -> DataFrame:
    """``mail`` after ``changes``, by one full outer join: (key, mail, back, gone, labels_) as far as these columns are there, each key once.

    ``mail`` is a struct whose values replace where they are not null, and a new row where the key is new; ``back`` clears
    ``deleted_at``, ``gone`` then sets it to ``at`` on live rows; ``labels_`` is a struct of the arrays add and remove. A change
    other than ``mail`` to a key that is not there does nothing.
    """
    have = set(changes.columns)
    c = changes.select(F.col(key).alias("__k"), *[F.col(x).alias(f"__{x}") for x in ("mail", "back", "gone", "labels_") if x in have])
    j = mail.withColumn("__old", F.lit(True)).join(c, F.col(key) == F.col("__k"), "full")
    new = {key: F.coalesce(F.col(key), F.col("__k"))}
    if "mail" in have:
        j = j.where(F.col("__old").isNotNull() | F.col("__mail").isNotNull())
        new |= {x: F.coalesce(F.col("__mail")[x], F.col(x)) for x in changes.schema["mail"].dataType.names if x in mail.columns}
    else:
        j = j.where(F.col("__old").isNotNull())
    deleted = F.col("deleted_at")
    if "back" in have:
        deleted = F.when(F.col("__back").isNull(), deleted)
    if "gone" in have:
        deleted = F.when(F.col("__gone") & deleted.isNull(), at).otherwise(deleted)
    new["deleted_at"] = deleted
    if "labels_" in have and "labels" in mail.columns:
        none = F.array().cast("array<string>")
        was = new.get("labels", F.col("labels"))
        changed = F.array_sort(F.array_except(F.array_union(F.coalesce(was, none), F.coalesce(F.col("__labels_")["add"], none)), F.coalesce(F.col("__labels_")["remove"], none)))
        new["labels"] = F.when(F.col("__labels_").isNotNull(), changed).otherwise(was)
    return j.select(*[new.get(x, F.col(x)).alias(x) for x in mail.columns])


def unprocessed(mail: DataFrame, column: str = "primary_category") -> DataFrame:
    """Rows whose ``column`` is null, or empty text: those that a classifier or a plain-text pass has not seen yet."""
    empty = F.col(column) == "" if dict(mail.dtypes)[column] == "string" else F.lit(False)
    return mail.where(F.col(column).isNull() | empty)


def write_back(mail: DataFrame, results: DataFrame, key: str = "gmail_id") -> DataFrame:
    """``mail`` with the columns of ``results`` (each key once) set for the rows that it names; other rows keep theirs, or have null."""
    made = [c for c in results.columns if c != key]
    r = results.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in made])
    j = mail.join(r, F.col(key) == F.col("__k"), "left")
    value = lambda c: F.when(F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c) if c in mail.columns else F.lit(None))
    return j.withColumns({c: value(c) for c in made}).select(*mail.columns, *[c for c in made if c not in mail.columns])


def deletion_plan(mail: DataFrame, where: Column, most: int | None = None, dry_run: bool = True, confirmed: bool = False, ask_from: int = 1000, key: str = "gmail_id") -> DataFrame:
    """(key, action) of the mail that a deletion by predicate takes: at most ``most``, the least keys first.

    ``action`` is would_delete in a dry run, else delete; needs_confirmation if more than ``ask_from`` mails are taken unconfirmed.
    """
    hit = mail.where(where).select(key).distinct()
    hit = hit.orderBy(key).limit(most) if most is not None else hit
    if dry_run:
        return hit.withColumn("action", F.lit("would_delete"))
    if confirmed:
        return hit.withColumn("action", F.lit("delete"))
    n = hit.agg(F.count("*")).scalar()
    return hit.withColumn("action", F.when(n > ask_from, "needs_confirmation").otherwise("delete"))


def high_water(mail: DataFrame, date: str = "date_received") -> DataFrame:
    """(high_water, after): the newest date, and the day from which mail is read again."""
    return mail.agg(F.max(date).alias("high_water")).withColumn("after", F.date_format("high_water", "yyyy/MM/dd"))
