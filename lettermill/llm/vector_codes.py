"""Compression of vectors to codes: each of 16 parts of a vector becomes the index of its nearest codebook entry.

Components become whole numbers, so that every task gives the same codes. Distances to all entries are screened
by a float32 matrix product; an interval that holds all its rounding errors is laid around each, and every entry whose
interval overlaps the best one's is measured again in int64, ties going to the lower index.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.llm.scratch import Scratch, small_batches

#: Fixed values of the code: parts of a vector, entries of a part's codebook, rounds of fitting, and the scale of components.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows screened at once; the distances of a block are BLOCK x ENTRIES numbers.
BLOCK = 4096
#: Labels whose sums may be broadcast; beyond it the join goes by shuffle.
BROADCAST_LABELS = 100_000
_HALF_ULP = 2.0**-24


@dataclass(frozen=True)
class Codebooks:
    """``entries``: int64 of shape (parts, entries, width). Bounded by parts x entries, however many vectors there are."""

    entries: np.ndarray

    @property
    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def component_bound(dimension: int) -> int:
    """Whole numbers up to this bound have squared distances of ``dimension`` components within 62 bits."""
    return 1 << max(0, (62 - max(1, dimension - 1).bit_length()) // 2 - 1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values as float64 with NaN for nulls, offsets, rows that are no null)."""
    column = column.cast(pa.large_list(pa.float64()))
    values = column.values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return values, column.offsets.to_numpy(), ~np.asarray(column.is_null())


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rows kept, their vectors as lists of floor(SCALE * x)): nulls and vectors with a null or non-finite component are dropped."""
    values, offsets, kept = _lists(column)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept &= bad[offsets[1:]] == bad[offsets[:-1]]
    lengths = (offsets[1:] - offsets[:-1]) * kept
    inside = np.repeat(kept, offsets[1:] - offsets[:-1])
    if len(inside) != len(values):
        full = np.zeros(len(values), bool)
        full[offsets[0] : offsets[-1]] = inside
        inside = full
    with np.errstate(over="ignore"):
        x = np.floor(values[inside] * SCALE)
    # Within 64 bits; the exact bound is applied when the dimension is known.
    x = np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)
    at = np.flatnonzero(kept)
    return at, pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths[at])]), x)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of ``dimension`` components, shorter vectors filled up with zeros, held within ``component_bound``."""
    column = column.cast(pa.large_list(pa.int64()))
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    out = np.zeros((len(column), dimension), np.int64)
    lengths = offsets[1:] - offsets[:-1]
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = values[offsets[0] : offsets[-1]]
    bound = component_bound(dimension)
    return np.clip(out, -bound, bound)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of ``entries`` for each row of ``x``, both int64 of one width; exact.

    Screened is s = |e|^2 - 2 x.e, which differs from the distance by |x|^2, the same for all entries. With u = 2^-24 a float32
    product of width w, of operands rounded to float32, errs by at most g |x| |e|, g = (w + 3) u / (1 - (w + 3) u) for any order
    of its sums; rounding |e|^2 and the last sum adds at most 2 u (|e|^2 + 2 |x| |e|) (1 + g). The radius below is over the sum
    of both for the longest entry, and so holds for all.
    """
    width = x.shape[1]
    norms = (entries * entries).sum(1)
    g = (width + 3) * _HALF_ULP / (1 - (width + 3) * _HALF_ULP)
    longest = float(np.sqrt(float(norms.max())))
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    radius = (g + 4 * _HALF_ULP) * 1.01 * (2 * lengths * longest + longest * longest)
    screened = (norms.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ entries.astype(np.float32).T)).astype(np.float64)
    overlaps = screened - radius[:, None] <= (screened.min(1) + radius)[:, None]
    rows, at = np.nonzero(overlaps)
    exact = x[rows] - entries[at]
    exact = (exact * exact).sum(1)
    starts = np.searchsorted(rows, np.arange(len(x)))
    least = np.minimum.reduceat(exact, starts) if len(x) else exact
    # Entries of a row come by rising index: the first that is least wins.
    best = np.flatnonzero(exact == least[rows])
    first = best[np.searchsorted(rows[best], np.arange(len(x)))]
    return at[first], least


def assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each of shape (rows, parts)."""
    parts, _, width = books.entries.shape
    codes, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for a in range(0, len(x), BLOCK):
        for p in range(parts):
            codes[a : a + BLOCK, p], far[a : a + BLOCK, p] = nearest(x[a : a + BLOCK, p * width : (p + 1) * width], books.entries[p])
    return codes, far


def _part_sums(vectors: DataFrame, books: Codebooks) -> list:
    """(slot, position, sum, count) over all rows: slot is part x entries + entry. Tasks add up first; the result is bounded by the codebooks."""
    parts, size, width = books.entries.shape

    def work(batches):
        sums, counts = np.zeros((parts * size, width), object), np.zeros(parts * size, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), parts * width)
            for a in range(0, len(x), BLOCK):
                block = x[a : a + BLOCK]
                codes, _ = assigned(block, books)
                for p in range(parts):
                    # Halves of 31 bits: the sums of a block stay within 64 bits whatever the components.
                    own = block[:, p * width : (p + 1) * width]
                    low, high = np.zeros((size, width), np.int64), np.zeros((size, width), np.int64)
                    np.add.at(low, codes[:, p], own & 0x7FFFFFFF)
                    np.add.at(high, codes[:, p], own >> 31)
                    sums[p * size : (p + 1) * size] += high.astype(object) * (1 << 31) + low
                    counts[p * size : (p + 1) * size] += np.bincount(codes[:, p], minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array([str(v) for v in sums[used].ravel()], pa.string()), pa.array(np.repeat(counts[used], width))], names=["slot", "position", "total", "n"])

    rows = vectors.select("x").mapInArrow(work, "slot long, position long, total string, n long")
    return rows.groupBy("slot", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()


def refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, which becomes the floor of its parts' mean; unused entries stay."""
    entries = books.entries.copy()
    flat = entries.reshape(-1, entries.shape[2])
    for r in _part_sums(vectors, books):
        flat[r["slot"], r["position"]] = int(r["total"]) // r["n"]
    return Codebooks(entries)


def _first_vectors(vectors: DataFrame, entries: int) -> list:
    """The rows of the ``entries`` least keys; of rows of one key the least vector counts. Only keys are shuffled, then a filter reads the few rows."""
    keys = vectors.where("key is not null").select("key").distinct().orderBy("key").limit(entries).collect()
    if not keys:
        return []
    return vectors.where(F.col("key") <= F.lit(keys[-1][0])).groupBy("key").agg(F.min("x").alias("x")).orderBy("key").collect()


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks); rows are (key, label, code, error, label_error, codebooks_sha256), one per vector that is kept.

    - Dropped: vectors that are null or hold a null or non-finite component. Components become floor(256 x).
    - A vector shorter than the longest, or than a multiple of ``parts``, is filled up with zeros; one without components is all zeros.
    - Codebooks start as the parts of the ``entries`` least keys (all keys, if there are fewer; a null key starts none, and of
      rows of one key the least vector counts); ``rounds`` rounds follow, over all rows, repeated ones too.
    - If no row has a key, codebooks are one zero entry a part. An empty table gives no rows.
    - Components are held within ``component_bound`` (2^27, an x of 524288, for 64 dimensions), so that distances fit 64 bits.
      ``label_error`` is added up in decimals, and null where it passes 64 bits; null labels are one label.
    - ``code`` has two hex digits a part. Columns of ``df`` other than the three are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "codes")
    read = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("x"))
    schema = T.StructType([read.schema["key"], read.schema["label"], T.StructField("x", T.ArrayType(T.LongType()))])

    def kept(batches):
        for batch in batches:
            at, x = whole_vectors(batch.column("x"))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), batch.column("label").take(pa.array(at)), x.cast(pa.list_(pa.int64()))], names=["key", "label", "x"])

    vectors = scratch.save(read.mapInArrow(kept, schema), "vectors")
    longest = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = _first_vectors(vectors, entries)
    start = matrix(pa.array([r["x"] for r in first] or [[]], pa.list_(pa.int64())), parts * width)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, width).swapaxes(0, 1)))
    for _ in range(rounds):
        books = refined(vectors, books)
    last = books

    def code(batches):
        digits = np.array([f"{i:02x}" for i in range(256)], "S2")
        for batch in batches:
            codes, far = assigned(matrix(batch.column("x"), parts * width), last)
            text = np.ascontiguousarray(digits[codes]).view(f"S{2 * parts}").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(text).cast(pa.string()), pa.array(far.sum(1))], names=["key", "label", "code", "error"])

    coded = scratch.save(vectors.mapInArrow(code, T.StructType([*schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])), "coded")
    sums = scratch.save(coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)").alias("label_error")), "labels")
    small = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    rows = coded.join(small, F.col("label").eqNullSafe(F.col("of"))).withColumn("codebooks_sha256", F.lit(books.digest))
    return rows.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", "codebooks_sha256"), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows, _ = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_WIDTH = 4  # of the given table: 64 dimensions in 16 parts
_FAR = " + ".join(f"(p.x[{i}] - b.x[{i}]) * (p.x[{i}] - b.x[{i}])" for i in range(1, _WIDTH + 1))


def _assign(n: int) -> str:
    """DuckDB: every part's nearest entry of the n-th codebooks, by distance and index."""
    return f"a{n} AS MATERIALIZED (SELECT p.vec_id, p.part, min({{'far': {_FAR}, 'entry': b.entry}}) AS best FROM parts p JOIN b{n} b ON p.part = b.part GROUP BY ALL)"


def _refine(n: int) -> str:
    """DuckDB: the codebooks after the n-th."""
    mean = ", ".join(f"CAST((sum(p.x[{i}]) - ((sum(p.x[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, _WIDTH + 1))
    return f"""m{n} AS (SELECT a.part, a.best.entry AS entry, [{mean}] AS x FROM a{n} a JOIN parts p ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON b.part = m.part AND b.entry = m.entry)"""


OP12_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT vec_id, r.part, x[r.part * {_WIDTH} + 1:r.part * {_WIDTH} + {_WIDTH}] AS x FROM kept, range({PARTS}) r(part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN firsts USING (vec_id)),
{_assign(0)}, {_refine(0)}, {_assign(1)}, {_refine(1)}, {_assign(2)},
codes AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
sums AS (SELECT k.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM kept k JOIN codes c USING (vec_id) GROUP BY k.label)
SELECT c.vec_id, c.code, c.error, s.label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM codes c JOIN kept k USING (vec_id) JOIN sums s ON k.label IS NOT DISTINCT FROM s.label
"""
