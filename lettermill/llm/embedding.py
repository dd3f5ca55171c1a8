"""Embedding near-dedup by an inverted multi-index.

A vector of length one is cut in two halves, each with a codebook of its own; the pairs of codewords
form a product grid of cells, one grid for each label. Every vector visits the cells of its grid from
the nearest on (multi-sequence traversal) until the target recall is reached, and is compared there
with all vectors of the cell in double precision.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.components import components
from lettermill.llm.scratch import Scratch

THRESHOLD = 0.93
#: Share of the neighbours at the threshold itself whose cell is visited; nearer ones are found more often.
RECALL = 0.9995
#: Vectors that the codebooks and the reach are fitted on at most: those with the least hash of their id.
SAMPLE = 20_000
#: Sampled vectors whose neighbours among all vectors widen the reach at most, and steps of the reach they are counted by.
QUERIES = 2000
STEP = 1e-4
#: Vectors a cell should hold on average, and codewords of a half at most.
CELL = 64
MOST_WORDS = 1024
#: Rows of one block of a cell and of one block of its visitors; larger cells are compared block by block.
BLOCK = 512
VISITORS = 4096


@dataclass(frozen=True)
class Codebooks:
    """Codewords of both halves, and how far beyond its own cell's distance a vector searches."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves of unit vectors to all codewords."""
        cut = self.first.shape[1]
        return _squares(x[:, :cut], self.first), _squares(x[:, cut:], self.second)

    def own(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def extra(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How far beyond the nearest cell each of ``cells`` (columns) comes for each row."""
        a, b = self.distances(x)
        return a[:, cells // len(self.second)] + b[:, cells % len(self.second)] - (a.min(1) + b.min(1))[:, None]

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each row visits, nearest first."""
        a, b = self.distances(x)
        order_a, order_b = a.argsort(1), b.argsort(1)
        a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        out = []
        for p, q, i_of, j_of in zip(a.tolist(), b.tolist(), order_a.tolist(), order_b.tolist(), strict=True):
            limit = p[0] + q[0] + self.reach
            cells, heap = [], [(p[0] + q[0], 0, 0)]
            while heap:
                far, i, j = heapq.heappop(heap)
                if far > limit:
                    break
                cells.append(i_of[i] * len(self.second) + j_of[j])
                # Each pair is pushed once: along the second half always, along the first from its head only.
                if j + 1 < len(q):
                    heapq.heappush(heap, (p[i] + q[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(p):
                    heapq.heappush(heap, (p[i + 1] + q[0], i + 1, 0))
            out.append(cells)
        return out


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)[None], 0)


def _codewords(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from distinct starting rows; words that no row is nearest to stay where they are."""
    x = np.unique(x, axis=0)
    words = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _squares(x, words).argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(words))
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def fit_codebooks(x: np.ndarray, largest: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 7) -> Codebooks:
    """Codebooks from unit vectors ``x``; ``largest`` is the number of vectors in the largest grid.

    The reach is measured: every sampled vector gets a neighbour at cosine ``threshold`` in a random
    direction, and the reach is the quantile ``recall`` of the distance at which the neighbour's cell comes.
    """
    rng = np.random.default_rng(seed)
    cut = x.shape[1] // 2
    k = int(np.clip(round((largest / CELL) ** 0.5), 1, MOST_WORDS))
    first, second = _codewords(x[:, :cut], k, rng), _codewords(x[:, cut:], k, rng)
    books = Codebooks(first, second, 0.0)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    other = threshold * x + (1 - threshold**2) ** 0.5 * away
    (a, b), cell = books.distances(x), books.own(other)
    rows = np.arange(len(x))
    extra = a[rows, cell // len(second)] + b[rows, cell % len(second)] - a.min(1) - b.min(1)
    return Codebooks(first, second, float(np.quantile(extra, recall)) + 1e-9)


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _extras(books: dict[int, Codebooks], asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float):
    """(size, step, n): at how many steps of reach the cells of the sampled vectors' true neighbours come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for d in sorted(set(np.unique(size).tolist()) & set(asked)):
                part = batch.filter(pa.array(size == d))
                grid, node, queries = asked[d]
                for a in range(0, part.num_rows, 1024):
                    rows = part.slice(a, 1024)
                    x = _unit(rows.column("embedding"))
                    near = (queries @ x.T >= threshold) & (grid[:, None] == rows.column("grid").to_numpy()[None]) & (node[:, None] != rows.column("node").to_numpy()[None])
                    some, found = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                    if len(some):
                        extra = books[d].extra(queries[some], books[d].own(x[found]))[near[np.ix_(some, found)]]
                        step, n = np.unique(np.ceil(extra / STEP).astype(np.int64), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d), pa.int32()), pa.array(step), pa.array(n)], names=["size", "step", "n"])

    return run


def _widened(books: dict[int, Codebooks], nodes: DataFrame, taken, threshold: float, recall: float) -> dict[int, Codebooks]:
    """Codebooks whose reach also covers the share ``recall`` of the true neighbours of up to ``QUERIES`` sampled vectors.

    The neighbours are those among all vectors, block by block; only counts by step of the reach get to the driver.
    """
    asked = {}
    for d, some in taken.head(QUERIES).groupby("size"):
        x = np.stack(some["embedding"].to_numpy()).astype(np.float64)
        asked[int(d)] = some["grid"].to_numpy(), some["node"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)
    counts = nodes.select("grid", "size", "node", "embedding").mapInArrow(_extras(books, asked, threshold), "size int, step long, n long")
    by_size: dict[int, list] = {}
    for r in counts.groupBy("size", "step").agg(F.sum("n").alias("n")).orderBy("size", "step").collect():
        by_size.setdefault(r["size"], []).append((r["step"], r["n"]))
    out = dict(books)
    for d, found in by_size.items():
        step, n = np.array(found).T
        least = step[np.searchsorted(n.cumsum(), recall * n.sum())] * STEP
        out[d] = replace(books[d], reach=max(books[d].reach, float(least)))
    return out


def _comparable(x: str) -> str:
    """SQL: the vector is not null, has only finite components, and is not zero."""
    return f"{x} is not null and size({x}) > 0 and forall({x}, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists({x}, v -> v <> 0)"


def _assign(books: dict[int, Codebooks]):
    """Each vector as a member of its cell (kind 0) and as a visitor of cells (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                for a in range(0, part.num_rows, 1024):
                    rows = part.slice(a, 1024)
                    x = _unit(rows.column("embedding"))
                    visits = books[d].visits(x)
                    at = np.repeat(np.arange(len(x)), [len(v) + 1 for v in visits])
                    own = books[d].own(x)
                    cell = np.concatenate([[o, *v] for o, v in zip(own.tolist(), visits, strict=True)])
                    kind = np.concatenate([[0, *[1] * len(v)] for v in visits])
                    taken = rows.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([taken.column("grid"), pa.array(cell, pa.int64()), pa.array(own[at], pa.int64()), pa.array(kind, pa.int32()), taken.column("node"), taken.column("weight"), taken.column("embedding")], names=["grid", "cell", "home", "kind", "node", "weight", "embedding"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per group of rows sorted by ``group``; groups are bounded by the blocks."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        table = pa.Table.from_batches(rest)
        group = table.column("group").to_numpy()
        bounds = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield table.slice(s, e - s)
        rest = table.slice(int(bounds[-1])).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def _compare(threshold: float, books: dict[int, Codebooks]):
    """Per visitor and block: how many vectors it links with, and edges that join what is linked in the block.

    A link counts for the visitor, and for the member too if the member does not visit the visitor's own cell.

    Edges are a star for each connected part of the block's links, so that dense blocks don't emit all pairs.
    """

    def run(batches):
        for table in _whole_groups(batches):
            kind, node, weight, home, grid, cell = (table.column(c).to_numpy() for c in ("kind", "node", "weight", "home", "grid", "cell"))
            if kind.min() == kind.max():
                continue
            x = _unit(table.column("embedding").combine_chunks())
            m, q = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            # Groups are told apart by a hash only, so the cells are compared too.
            same = (grid[q][:, None] == grid[m][None]) & (cell[q][:, None] == cell[m][None])
            near = (x[q] @ x[m].T >= threshold) & (node[q][:, None] != node[m][None]) & same
            linked = near.any(1)
            if not linked.any():
                continue
            near, q = near[linked], q[linked]
            label_q, label_m = node[q].copy(), node[m].copy()
            far = np.iinfo(np.int64).max
            while True:
                new_q = np.minimum(label_q, np.where(near, label_m[None], far).min(1))
                new_m = np.minimum(label_m, np.where(near, new_q[:, None], far).min(0))
                if (new_q == label_q).all() and (new_m == label_m).all():
                    break
                label_q, label_m = new_q, new_m
            n = (near * weight[m][None]).sum(1)
            used = near.any(0)
            book = books[x.shape[1]]
            one_way = near[:, used] & (book.extra(x[m[used]], home[q]) > book.reach).T
            a = np.concatenate([node[q], node[m][used]])
            b = np.concatenate([label_q, label_m[used]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([n, (one_way * weight[q][:, None]).sum(0)]))], names=["a", "b", "n"])

    return run


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``.

    - Rows link if their labels are equal and not null, their vectors have the same length and their cosine (double
      precision) is ``threshold`` or more. ``n_links`` counts the other rows linked directly, ``component_id`` is the
      least key reachable, ``kept`` is key = component_id.
    - Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows with a null
      label or a null key (``component_id`` null, kept). Each has n_links 0.
    - Rows equal in label and vector are one node with a weight: copies are never paired with each other, but count.
    - Other columns are ignored, repeated rows come out repeated, an empty table gives no rows.
    - Only the codebooks are fitted on a sample (``sample`` rows, bounded at the driver); every row is indexed and asks.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("embedding"), F.col(label).cast("string").alias("label"))
    fit_to = F.expr(_comparable("embedding")) & F.col("label").isNotNull() & F.col("key").isNotNull()
    hashed = rows.withColumns({"ok": F.coalesce(fit_to, F.lit(False)), "h_1": F.xxhash64("label", "embedding"), "h_2": F.xxhash64(F.lit(1), "embedding", "label")})
    nodes = hashed.where("ok").groupBy("label", "embedding").agg(F.min("key").alias("node"), F.count("*").alias("weight"))
    nodes = nodes.withColumns({"size": F.size("embedding"), "h_1": F.xxhash64("label", "embedding"), "h_2": F.xxhash64(F.lit(1), "embedding", "label")})
    nodes = scratch.save(nodes.withColumn("grid", F.xxhash64("label", "size")), "nodes")

    # Sizes of the grids by vector length: few rows, and bounded by the number of lengths.
    largest = {r["size"]: r["n"] for r in nodes.groupBy("grid", "size").count().groupBy("size").agg(F.max("count").alias("n")).orderBy("size").collect()}
    taken = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("grid", "node", "size", "embedding").toPandas()
    books = {}
    for d, n in largest.items():
        some = taken["embedding"][taken["size"] == d]
        # A length that the sample has missed is rare: a grid of one cell, where all are compared.
        x = np.stack(some.to_numpy()).astype(np.float64) if len(some) else np.ones((1, d))
        books[d] = fit_codebooks(x / np.linalg.norm(x, axis=1, keepdims=True), n if len(some) else 1, threshold, recall)
    books = _widened(books, nodes, taken, threshold, recall)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = nodes.select("grid", "size", "node", "weight", "embedding").mapInArrow(_assign(books), "grid long, cell long, home long, kind int, node long, weight long, embedding array<float>" if dict(df.dtypes)[vector] == "array<float>" else "grid long, cell long, home long, kind int, node long, weight long, embedding array<double>")
    placed = scratch.save(placed, "placed")
    counts = placed.groupBy("grid", "cell").agg(F.count_if(F.col("kind") == 0).alias("members"), F.count_if(F.col("kind") == 1).alias("visitors")).where("members > 0 and visitors > 0")
    counts = scratch.save(counts.select("grid", "cell", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("blocks"), F.ceil(F.col("visitors") / F.lit(VISITORS)).cast("int").alias("rounds")), "counts")
    # A member is in one block and meets every round of visitors; a visitor is in one round and meets every block.
    dealt = placed.join(counts, ["grid", "cell"])
    mine = F.when(F.col("kind") == 0, F.pmod(F.xxhash64("node"), "blocks")).otherwise(F.pmod(F.xxhash64("node"), "rounds")).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.col("rounds")).otherwise(F.col("blocks")) - 1)
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(others))
    group = F.when(F.col("kind") == 0, F.xxhash64("grid", "cell", "mine", "other")).otherwise(F.xxhash64("grid", "cell", "other", "mine"))
    dealt = dealt.select(group.alias("group"), "grid", "cell", "home", "kind", "node", "weight", "embedding").repartition(parts, "group").sortWithinPartitions("group")
    found = scratch.save(dealt.mapInArrow(_compare(threshold, books), "a long, b long, n long"), "found")
    scratch.drop("placed", "counts")
    groups = components(found.select("a", "b"), scratch)
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    whole = nodes.select("node", "weight", F.col("h_1").alias("n_1"), F.col("h_2").alias("n_2")).join(degree, "node", "left").join(groups, "node", "left")
    whole = scratch.save(whole.select("n_1", "n_2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "whole")
    out = hashed.select("key", "ok", "h_1", "h_2").join(whole, (F.col("h_1") == F.col("n_1")) & (F.col("h_2") == F.col("n_2")) & F.col("ok"), "left")
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "key").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op2_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
