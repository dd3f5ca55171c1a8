"""Queries that run a stream over the event files to its end and read what it wrote."""

from pyspark.sql import functions as F

from lettermill.plans.registry import Registry
from lettermill.plans.scratch import shared_folder
from lettermill.plans.views import SQL_EVENTS
from lettermill.streaming import mail_stream
from lettermill.streaming.lockout import lockouts

Q = Registry()


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = mail_stream.read_stream(spark, f"{d}/events.parque[t]", schema)
    sender = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@"), F.col("event_type"), F.lit(".example.com"))
    return e.select(F.col("event_id").alias("gmail_id"), F.col("ts").alias("date_received"), sender.alias("sender"), F.col("event_type").alias("subject"))


def _run(spark, df, mode="complete"):
    """Complete results go to a table in memory by way of a written file, so that open windows are seen as well."""
    folder = shared_folder(spark, "stream")
    if mode == "append":
        mail_stream.write_available(df, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    else:
        def put(batch, _):
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@Q.add("stream_hourly_volume", f"WITH {SQL_EVENTS} SELECT date_trunc('hour', date_received) AS hour_start, subject, count(*) AS n FROM mail GROUP BY 1, 2")
def stream_hourly_volume(spark, d):
    return _run(spark, mail_stream.hourly_volume(_events(spark, d))).select(F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "subject", "n")


@Q.add("stream_sliding_volume", f"WITH {SQL_EVENTS} SELECT date_trunc('hour', date_received) - to_hours(i) AS start, count(*) AS n FROM mail, range(6) r(i) GROUP BY 1")
def stream_sliding_volume(spark, d):
    return _run(spark, mail_stream.sliding_volume(_events(spark, d))).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@Q.add("stream_sender_sessions", f"""WITH {SQL_EVENTS}, g AS (SELECT sender, date_received AS t, CASE WHEN date_received - lag(date_received) OVER (PARTITION BY sender ORDER BY date_received) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM mail),
  s AS (SELECT sender, t, sum(new) OVER (PARTITION BY sender ORDER BY t) AS s FROM g) SELECT sender, min(t) AS session_start, max(t) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM s GROUP BY sender, s""")
def stream_sender_sessions(spark, d):
    out = _run(spark, mail_stream.sender_sessions(_events(spark, d), "12 hours"))
    return out.select("sender", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@Q.add("stream_drop_repeats", f"WITH {SQL_EVENTS} SELECT DISTINCT gmail_id, sender FROM mail")
def stream_drop_repeats(spark, d):
    return _run(spark, mail_stream.drop_repeats(_events(spark, d)), "append").select("gmail_id", "sender")


_DAY = 86400
_STATE = "{{'recent': {r}::DOUBLE[], 'until': {u}::DOUBLE, 'locks': {l}::DOUBLE[]}}"


@Q.add("auth_lockouts", f"""WITH f AS (SELECT user_id::VARCHAR AS client, list((epoch_us(ts) // 1000) / 1000.0 ORDER BY ts) AS times FROM events WHERE event_type = 'error' GROUP BY 1),
  s AS (SELECT client, list_reduce(list_prepend({_STATE.format(r="[]", u="0", l="[]")}, list_transform(times, lambda t: {_STATE.format(r="[t]", u="0", l="[]")})), lambda a, e: CASE
      WHEN e.recent[1] < a.until THEN a
      WHEN len(list_filter(a.recent, lambda x: e.recent[1] - x < {5 * _DAY})) >= 2 THEN {_STATE.format(r="[]", u=f"e.recent[1] + {2 * _DAY}", l="list_append(a.locks, e.recent[1])")}
      ELSE {_STATE.format(r=f"list_append(list_filter(a.recent, lambda x: e.recent[1] - x < {5 * _DAY}), e.recent[1])", u="a.until", l="a.locks")} END) AS s FROM f),
  l AS (SELECT client, unnest(s.locks) AS t FROM s)
  SELECT client, CAST(round(t * 1000) AS BIGINT) AS locked_ms, CAST(round(t * 1000) AS BIGINT) + {2 * _DAY * 1000} AS until_ms FROM l""")
def auth_lockouts(spark, d):
    """Errors of a user as failures: the third within five days locks for two days."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    failures = mail_stream.read_stream(spark, f"{d}/events.parque[t]", schema).where("event_type = 'error'").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at"))
    locks = _run(spark, lockouts(failures, 3, 5 * _DAY, 2 * _DAY), "append")
    return locks.select("client", F.unix_millis("locked_at").alias("locked_ms"), F.unix_millis("until").alias("until_ms"))
