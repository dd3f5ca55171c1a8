"""Incremental ingest and event-time analytics with Structured Streaming."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill.operators.ledger import dead_letters
from lettermill.sources.snapshots import DeadLetterStore, MailStore


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive below ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hourly_volume(mail: DataFrame, late: str = "1 day", date: str = "date_received") -> DataFrame:
    """(hour_start, subject, n, senders) in tumbling hours; mail later than ``late`` behind the newest is not counted. Works on tables too."""
    t = mail.withColumn(date, F.col(date).cast("timestamp")).withWatermark(date, late)
    out = t.groupBy(F.window(date, "1 hour"), "subject").agg(F.count("*").alias("n"), F.approx_count_distinct("sender").alias("senders"))
    return out.select(F.col("window.start").alias("hour_start"), "subject", "n", "senders")


def sliding_volume(mail: DataFrame, size: str = "6 hours", step: str = "1 hour", late: str = "1 day", date: str = "date_received") -> DataFrame:
    t = mail.withColumn(date, F.col(date).cast("timestamp")).withWatermark(date, late)
    out = t.groupBy(F.window(date, size, step)).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


def sender_sessions(mail: DataFrame, gap: str = "2 hours", late: str = "1 day", date: str = "date_received") -> DataFrame:
    """(sender, session_start, session_end, n): runs of a sender's mail without a pause of ``gap``."""
    t = mail.withColumn(date, F.col(date).cast("timestamp")).withWatermark(date, late)
    out = t.groupBy(F.session_window(date, gap), "sender").agg(F.count("*").alias("n"))
    return out.select("sender", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def drop_repeats(mail: DataFrame, late: str = "1 day", key: str = "gmail_id", date: str = "date_received") -> DataFrame:
    """Each id once within the watermark: the stream keeps no ids that are older."""
    return mail.withColumn(date, F.col(date).cast("timestamp")).withWatermark(date, late).dropDuplicatesWithinWatermark([key])


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into Parquet files and stop; a rerun with the same checkpoint goes on where this one ended."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_history(changes: DataFrame, store: MailStore, letters: str | DeadLetterStore, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes (gmail_id, history_id, type, subject, sender, body, error; ``labels`` for label changes) to a mail store, batch by batch.

    Types are added, deleted, label_added and label_removed. In a batch each kind counts for itself: of an id's additions the newest
    gives the mail; the last of its additions and deletions says whether it lives; of each label the last change counts. A batch is
    one commit of the store, in which readers see all of it or nothing; a batch that is repeated after a crash changes nothing more,
    since the commit holds its number. Failed changes (``error`` set) go to the dead letters: to a ``DeadLetterStore``, where attempts
    add up over batches, or to JSON files by batch below a path.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = batch.where("error is null")
        added = good.where("type = 'added'").groupBy("gmail_id").agg(F.max_by(F.struct("subject", "sender", "body"), "history_id").alias("r"))
        last = good.where("type in ('added', 'deleted')").groupBy("gmail_id").agg(F.max_by("type", "history_id").alias("last"))
        changed = None
        if "labels" in batch.columns:
            one = good.where("type in ('label_added', 'label_removed')").select("gmail_id", "history_id", "type", F.explode("labels").alias("label"))
            one = one.groupBy("gmail_id", "label").agg(F.max_by("type", "history_id").alias("type"))
            of = lambda kind: F.collect_set(F.when(F.col("type") == kind, F.col("label")))
            changed = one.groupBy("gmail_id").agg(of("label_added").alias("add"), of("label_removed").alias("remove"))
        store.apply(added.select("gmail_id", "r.*"), last.where("last = 'added'"), last.where("last = 'deleted'"), changed, batch=(checkpoint, number))
        failed = batch.where("error is not null").select(F.col("gmail_id").alias("message_id"), F.col("error").alias("failure_type"), F.localtimestamp().alias("failed_at"))
        if isinstance(letters, DeadLetterStore):
            letters.add(failed, batch=(checkpoint, number))
        else:
            dead_letters(failed).write.mode("overwrite").json(f"{letters}/batch={number}")
        batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
