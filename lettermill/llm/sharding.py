"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Every record scores all shards from a hash of its key and the shard number and
goes to the best one. A new shard can only win records for itself, so records
never move between old shards. A weight scales the share of a shard.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
#: Slots are counted within shard and hash bucket, so that no task numbers a whole shard.
BUCKETS = 4096


def record_key(key: str, text: str) -> Column:
    """The key as a string; a null key falls back to the digest of the text, so that null keys spread."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def choose_shard(key: Column, weights: list[float]) -> Column:
    """The shard with the least ``-ln(u) / weight``, u in (0, 1) from md5(key:shard); ties go to the lower number."""
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
        scores.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"]


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown_weight: float = 1.0, buckets: int = BUCKETS) -> DataFrame:
    """Add ``size, text_crc32, law, shard, slot, grown_shard`` to every row of ``df``.

    - ``size``: UTF-8 bytes of the text plus 1; null text counts as empty (size 1, crc 0).
    - ``shard``: by key and shard count alone. Null key: by the digest of the text.
    - ``slot``: gapless from 0 in each shard, in the order of md5(key), then size and crc.
      Rows with the same key share a shard; rows equal in key and text are interchangeable.
    - ``grown_shard``: the shard if one more of ``grown_weight`` is added.
    - Empty table: no rows. Columns of these names in ``df`` are replaced, others kept.

    One shuffle carries ``df`` by (shard, bucket); bucket sizes come from an aggregate of at most
    len(weights) x buckets rows, which is the bound of what is broadcast.
    """
    weights = weights or [1.0] * SHARDS
    k = record_key(key, text)
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own = df.drop(*[c for c in made if c not in (key, text)])
    rows = own.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
        "law": F.lit("key"),
        "shard": choose_shard(k, weights),
        "grown_shard": choose_shard(k, [*weights, grown_weight]),
        "__order": F.md5(k),
    })
    rows = rows.withColumn("__bucket", (F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") / F.lit(2**32 / buckets)).cast("int"))
    sizes = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("__order", "size", "text_crc32")
    return (
        rows.withColumn("__rank", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "__bucket"])
        .withColumn("slot", F.col("__start") + F.col("__rank") - 1)
        .drop("__order", "__bucket", "__rank", "__start")
    )


def op7_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_records(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# Same law in DuckDB. It has no CRC-32 function, so the fold over the bytes is spelled out with the reflected polynomial 0xEDB88320.
OP7_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h,
             coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (
  SELECT d.*, strlen(text) + 1 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
             lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
         list_transform(range({SHARDS + 1}), lambda s: {{'score': -ln((CAST('0x' || substr(md5(k || ':' || s), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0), 'shard': s}}) AS scores
  FROM d, crc),
c AS (SELECT *, list_min(scores[1:{SHARDS}]).shard AS shard, list_min(scores).shard AS grown FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(k), size, text_crc32) - 1 AS BIGINT) AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM c
"""
