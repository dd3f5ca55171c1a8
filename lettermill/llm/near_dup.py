"""MinHash near-dedup by an LSH forest.

Each tree sorts the documents by a signature order of its own; documents with a long common prefix
are neighbours. A region is the set of documents under one prefix. Its depth adapts: a crowded prefix
is first followed deeper until it holds few enough documents, and where no prefix does, dealt into
chunks that all hold the region's least document. There each document is confirmed with its leader on
the full texts. What that leaves apart is compared at the shallow prefix itself, crowded or not: block
against block, first by signatures, then the documents with a likely partner by their full shingle
sets. Confirmed links are closed to components; a block gives a tree of links, never all pairs.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.components import components
from lettermill.llm.scratch import Scratch, small_batches
from lettermill.llm.words import U, mix, pieces

TREES = 16
VALUES = 128
#: Documents of one region; a region's pairs are looked at in one task.
REGION = 64
#: Weight of one block of a crowded region, 1 for a document and 1 for every ``BLOCK`` shingles of it; two blocks are compared in one task.
BLOCK = 1024
#: Shingles of one step of a block's table of intersections.
COLUMNS = 4096
#: Chance of losing a pair at the threshold in all trees.
MISS = 2e-5
#: Depths below the least one that crowded regions are followed to.
DEEPER = (6, 8, 12, 16, 24, 32)
#: Candidates that may be broadcast (one long each); beyond it texts are joined by shuffle.
BROADCAST_IDS = 2_000_000

_rng = np.random.Generator(np.random.PCG64(8086))
_FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * U(2) + U(1)
_ASKED = ("region", "tree", "side", "node", "component", "n_shingles", "signature")
_SKETCH = "key long, n_shingles long, set_1 long, set_2 long, signature binary"


def least_depth(percent: int, trees: int = TREES, miss: float = MISS) -> int:
    """The deepest prefix at which a pair at the threshold is still together in some tree but for a chance of ``miss``."""
    t = percent / 100
    return max(d for d in range(1, 9) if d == 1 or (1 - t**d) ** trees <= miss)


def _signatures(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, one row per set; rows of empty sets are zero."""
    out = np.zeros((len(offsets) - 1, VALUES), np.uint16)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        for j in range(VALUES):
            # Mixed, since the least of many hashes has only zeros at its top.
            out[filled, j] = mix(np.minimum.reduceat(hashes * _FACTORS[j], offsets[filled])) >> U(48)
    return out


def _fingerprints(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, equal for equal sets."""
    sums = np.zeros((2, len(offsets) - 1), U)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        sums[0, filled] = np.add.reduceat(mix(hashes + U(1)), offsets[filled])
        sums[1, filled] = np.add.reduceat(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), offsets[filled])
    return sums[0].view(np.int64), sums[1].view(np.int64)


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column("text")):
                texts.words(lower=True)
                offsets, hashes = texts.shingle_sets(shingle)
                one, two = _fingerprints(offsets, hashes)
                rows = _signatures(offsets, hashes)
                signature = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(np.diff(offsets)), pa.array(one), pa.array(two), signature], names=["key", "n_shingles", "set_1", "set_2", "signature"])

    return run


def _hashes(shingle: int):
    """(node, hashes): the shingle sets as sorted 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for a, b, texts in pieces(batch.column("text")):
                texts.words(lower=True)
                offsets, hashes = texts.shingle_sets(shingle)
                rows = [hashes[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(rows, pa.binary())], names=["node", "hashes"])

    return run


def _regions(nodes: DataFrame, depth: int, region: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(region, node): which documents meet where, no region with more than about ``region`` rows; and (node, tree, region, n): the shallow regions, whole."""

    def prefixes(depths, tree):
        # A tree's order runs through the whole signature from its own place on; 2 bytes a value.
        width = 2 * VALUES // TREES
        turned = F.concat(F.expr(f"substring(signature, {tree} * {width} + 1, {2 * VALUES})"), F.expr(f"substring(signature, 1, {tree} * {width})"))
        return [F.struct(F.lit(d).alias("depth"), F.xxhash64(F.lit(tree), F.lit(d), F.substring(turned, 1, 2 * d)).alias("region")) for d in depths]

    first = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), prefixes([depth], t)[0]["region"].alias("region")) for t in range(TREES)])).alias("p")).select("node", "p.tree", "p.region")
    size = lambda rows: rows.groupBy("region").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1")
    sizes = scratch.save(size(first), "sizes")
    met = scratch.save(first.join(sizes.select("region", "n"), "region"), "met")
    deeper = [d for d in DEEPER if d > depth]
    crowded = met.where(F.col("n") > region).select("node", "tree")
    at = F.array(*[F.when(F.col("tree") == t, F.array(*prefixes(deeper, t))) for t in range(TREES)])
    below = crowded.join(nodes.select("node", "signature"), "node").select("node", "tree", F.explode(F.get(at, F.col("tree"))).alias("p")).select("node", "tree", "p.depth", "p.region")
    below = scratch.save(below, "below")
    below_sizes = scratch.save(size(below), "below-sizes")
    levels = below.join(below_sizes.select("region", "n"), "region").unionByName(met.where(F.col("n") > region).select("node", "tree", F.lit(depth).alias("depth"), "region", "n"))
    # The shallowest prefix that is not crowded; without one, the deepest that is shared at all.
    level = F.struct("depth", "region", "n")
    fit = levels.groupBy("node", "tree").agg(F.coalesce(F.min(F.when(F.col("n") <= region, level)), F.max(level)).alias("l")).select("node", "l.region", "l.n")
    chosen = met.where(F.col("n") <= region).select("node", "region", "n").unionByName(fit)
    chunks = F.ceil(F.col("n") / F.lit(region)).cast("int")
    chunk = F.when(F.col("n") <= region, F.lit(0)).otherwise(F.pmod(F.xxhash64("node", "region"), chunks).cast("int"))
    rows = chosen.select(F.xxhash64("region", chunk).alias("region"), "node")
    all_sizes = sizes.unionByName(below_sizes).where(F.col("n") > region)
    heads = all_sizes.select("region", F.col("head").alias("node"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c")).select(F.xxhash64("region", "c").alias("region"), "node")
    out = scratch.save(rows.unionByName(heads).distinct(), "regions")
    scratch.drop("sizes", "below", "below-sizes")
    return out, met


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(region, tree, side, node, component): every two blocks of a crowded region that hold different components meet as a region.

    ``rows`` has (region, tree, node, component, weight). A component that fills a block has blocks of its own, which never
    meet each other; the rest share blocks. A block that meets itself has side 0 only.
    """
    parts = rows.groupBy("region", "component").agg(F.sum("weight").alias("of"))
    small = F.coalesce(F.sum(F.when(F.col("of") < block, F.col("of"))), F.lit(0.0)).alias("small")
    parts = parts.join(parts.groupBy("region").agg(small), "region")
    own = F.col("of") >= block
    share = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    name = F.when(own, F.xxhash64("component", F.pmod(F.xxhash64("node"), share("of")))).otherwise(F.xxhash64(F.lit("rest"), F.pmod(F.xxhash64("component"), share("small"))))
    dealt = rows.join(parts, ["region", "component"]).select("region", "tree", "node", "component", name.alias("block"), F.when(own, F.col("component")).alias("whose"))
    known = dealt.select("region", "block", "whose").distinct()
    other = known.select("region", F.col("block").alias("block_2"), F.col("whose").alias("whose_2"))
    pairs = known.join(other, "region").where("block <= block_2 and not coalesce(whose = whose_2, false)")
    pair = F.xxhash64("region", "block", "block_2")
    sides = F.when(F.col("block") == F.col("block_2"), F.array(F.struct(F.lit(0).alias("side"), F.col("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("block")), F.struct(F.lit(1).alias("side"), F.col("block_2").alias("block"))))
    sides = pairs.select("region", pair.alias("pair"), F.explode(sides).alias("s")).select("region", "pair", "s.side", "s.block")
    return dealt.join(sides, ["region", "block"]).select(F.col("pair").alias("region"), "tree", "side", "node", "component")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole regions, of rows sorted by region; regions are bounded, so tables are."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        region = rest.column("region").to_numpy()
        cut = int(np.searchsorted(region, region[-1])) if len(region) else 0
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield rest


def _columns(table: pa.Table):
    column = lambda name: table.column(name).to_numpy()
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(table), VALUES)
    return column("region"), column("node"), column("n_shingles"), signature


def _agree(signature, size, i, j, percent: int, low: float) -> np.ndarray:
    """Estimated similarity of rows i and j, -1 where it or the sizes rule a link out."""
    share = (signature[i] == signature[j]).mean(axis=1)
    possible = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    return np.where((share >= low) & possible, share, -1.0)


def _leaders(percent: int, low: float):
    """In each region, documents follow the least one that they seem to match: (node, leader), at most one row each."""

    def run(batches):
        for table in _groups(batches):
            region, node, size, signature = _columns(table)
            left = np.arange(len(node))
            while len(left):
                new = np.ones(len(left), bool)
                new[1:] = region[left][1:] != region[left][:-1]
                head = left[np.flatnonzero(new)[np.cumsum(new) - 1]]
                rest = ~new
                i, j = left[rest], head[rest]
                good = _agree(signature, size, i, j, percent, low) >= 0
                yield pa.RecordBatch.from_arrays([pa.array(node[j[good]]), pa.array(node[i[good]])], names=["a", "b"])
                left = i[~good]

    return run


def _meetings(table: pa.Table, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each region of a table: its two sides, or all of it against itself; regions of one component are left out."""
    region, side = (table.column(c).to_numpy() for c in ("region", "side"))
    bounds = np.append(np.flatnonzero(np.append(True, region[1:] != region[:-1])), len(region))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if (component[s:e] == component[s]).all():
            continue
        two = side[s:e] == 1
        rows = s + np.flatnonzero(~two)
        cols = s + np.flatnonzero(two) if two.any() else rows
        if len(rows):
            yield rows, cols


def _likely(size, signature, component, rows: np.ndarray, cols: np.ndarray, percent: int, low: float) -> np.ndarray:
    """Which documents of the rows and columns may be similar by signature and size, and are of different components."""
    theirs = signature[cols]
    agree = np.empty((len(rows), len(cols)), np.int16)
    for i, x in enumerate(signature[rows]):
        agree[i] = np.count_nonzero(theirs == x, axis=1)
    a, b = size[rows][:, None], size[cols][None]
    return (agree >= low * VALUES) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (component[rows][:, None] != component[cols][None])


def _candidates(percent: int, low: float, depth: int):
    """The documents of each region that have a likely partner there whom they have not met in an earlier tree."""
    width = VALUES // TREES
    ahead = (np.arange(TREES)[:, None] * width + np.arange(depth)) % VALUES

    def run(batches):
        for table in _groups(batches):
            _, _, size, signature = _columns(table)
            tree, component = table.column("tree").to_numpy(), table.column("component").to_numpy()
            asked = np.zeros(len(table), bool)
            for rows, cols in _meetings(table, component):
                i, j = np.nonzero(_likely(size, signature, component, rows, cols, percent, low))
                i, j = rows[i], cols[j]
                for t in range(int(tree[rows[0]]) if len(i) else 0):
                    met = (signature[i][:, ahead[t]] == signature[j][:, ahead[t]]).all(1)
                    i, j = i[~met], j[~met]
                asked[i] = asked[j] = True
            if asked.any():
                yield from table.filter(pa.array(asked)).to_batches(max_chunksize=1024)

    return run


def _links(percent: int, low: float):
    """Links between the likely partners of each region, confirmed on their full sets: (a, b), a tree for each group that they join."""

    def run(batches):
        for table in _groups(batches):
            _, node, size, signature = _columns(table)
            component = table.column("component").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
            for rows, cols in _meetings(table, component):
                near = _similar(sets, rows, cols, _likely(size, signature, component, rows, cols, percent, low), percent)
                i, j = np.nonzero(near)
                if len(i):
                    a, b = _tree(node[rows[i]], node[cols[j]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _similar(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, likely: np.ndarray, percent: int) -> np.ndarray:
    """Which likely pairs are similar: 100 * intersection >= percent * union."""
    left, right = [sets[i] for i in rows], [sets[j] for j in cols]
    n, m = (np.array([len(x) for x in side]) for side in (left, right))
    i, j = np.nonzero(likely)
    if len(i) < 64:
        both = np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        both = _intersections(left, right)[i, j].astype(np.int64)
    out = np.zeros_like(likely)
    out[i, j] = 100 * both >= percent * (n[i] + m[j] - both)
    return out


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as the product of two tables of zeros and ones; ``COLUMNS`` of the shared shingles at a time."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    placed = []
    for h, row in sides:
        at = np.searchsorted(shared, h)
        held = at < len(shared)
        held[held] = shared[at[held]] == h[held]
        order = np.argsort(at[held], kind="stable")
        placed.append((at[held][order], row[held][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(shared), COLUMNS):
        tables = []
        for (at, row), n in zip(placed, out.shape, strict=True):
            s, e = np.searchsorted(at, [c, c + COLUMNS])
            ones = np.zeros((n, min(COLUMNS, len(shared) - c)), np.float32)
            ones[row[s:e], at[s:e] - c] = 1
            tables.append(ones)
        out += tables[0] @ tables[1].T
    return out


def _tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs with the least node that the pairs join it to."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, new[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(node))
    return node[label[apart]], node[apart]


def _confirm(shingle: int, percent: int):
    """Keeps pairs whose full sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            row = 0
            for (_, b, left), (_, _, right) in _both(batch):
                for t in (left, right):
                    t.words(lower=True)
                (o1, h1), (o2, h2) = left.shingle_sets(shingle), right.shingle_sets(shingle)
                for i in range(left.n):
                    x, y = h1[o1[i] : o1[i + 1]], h2[o2[i] : o2[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - both
                    keep.append(union > 0 and 100 * both >= percent * union)
                row = b
            assert row == batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _both(batch: pa.RecordBatch):
    """The two texts of each pair, row by row in runs of a bounded number of bytes."""
    left, right = batch.column("text_a"), batch.column("text_b")
    for i in range(0, batch.num_rows, 64):
        for (a, b, x) in pieces(left.slice(i, 64)):
            for (c, d, y) in pieces(right.slice(i + a, b - a), 1 << 62):
                yield (i + a, i + b, x), (i + a + c, i + a + d, y)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, region: int = REGION) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``df``.

    - A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a row's set holds its distinct ``shingle``-word
      runs, or its whole sequence as one if it has fewer words. Null and empty texts have empty sets (n_shingles 0),
      link with nothing and are kept.
    - Rows link if 100 * |intersection| >= percent * |union|; ``component_id`` is the least key reachable and
      ``kept`` is key = component_id. Rows with equal sets are one node, so copies are never paired with each other.
    - A row with a null key cannot be named as a partner: it links with nothing, its ``component_id`` is null, and it
      is kept. Repeated keys: their rows are one document, linked with all that any of them is linked with; repeated
      rows come out repeated. Other columns are ignored. Empty table: no rows.

    Two rounds of candidates are confirmed: each document with its region's leader, then all pairs of different components
    under every shallow prefix, crowded or not. So no pair of two components that meets under a shallow prefix and whose
    signatures agree to within four standard deviations goes unconfirmed. Pairs within a component are not looked at.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    small_batches(spark)
    t = percent / 100
    low = t - 4 * math.sqrt(t * (1 - t) / VALUES)
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    sketch = scratch.save(docs.mapInArrow(_sketch(shingle), _SKETCH), "sketch")

    # Equal sets are one node, named after the least key.
    own = sketch.where("n_shingles > 0 and key is not null")
    classes = scratch.save(own.groupBy("set_1", "set_2").agg(F.min("key").alias("node")), "classes")
    named = classes.select("node", F.col("set_1").alias("c_1"), F.col("set_2").alias("c_2"))
    heads = own.withColumnRenamed("key", "node").join(named, "node").where("set_1 = c_1 and set_2 = c_2")
    nodes = scratch.save(heads.groupBy("node").agg(F.max(F.struct("n_shingles", "signature")).alias("h")).select("node", "h.*"), "nodes")

    depth = least_depth(percent)
    meet, met = _regions(nodes, depth, region, scratch)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = scratch.save(meet.select("node").distinct(), "ids")
    known = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.withColumnRenamed("key", "node").join(known, "node", "left_semi")
    texts = scratch.save(texts, "texts")
    scratch.drop("ids")

    def by_region(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_parts, "region").sortWithinPartitions("region", "node")

    star = by_region(meet.join(nodes, "node")).mapInArrow(_leaders(percent, low), "a long, b long")
    # A document follows the least of its leaders. Texts are joined to the pairs, so a leader with many is split like any skewed key.
    pairs = scratch.save(star.groupBy("b").agg(F.min("a").alias("a")), "pairs")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    links = scratch.save(joined.mapInArrow(_confirm(shingle, percent), "a long, b long"), "links")
    groups = scratch.save(components(links, scratch, "cc-1"), "groups-1")

    rows = met.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = rows.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("region")
    rows = scratch.save(rows.join(apart, "region"), "apart")
    few = rows.where(F.col("n") <= region).select("region", "tree", F.lit(0).alias("side"), "node", "component")
    weight = nodes.select("node", (F.lit(1.0) + F.col("n_shingles") / F.lit(BLOCK)).alias("weight"))
    many = _blocks(rows.where(F.col("n") > region).select("region", "tree", "node", "component").join(weight, "node"), BLOCK)
    asked = by_region(few.unionByName(many).join(nodes.select("node", "n_shingles", "signature"), "node").select(*_ASKED))
    asked = scratch.save(asked.mapInArrow(_candidates(percent, low, depth), asked.schema), "asked")
    sets = texts.join(asked.select("node").distinct(), "node", "left_semi").mapInArrow(_hashes(shingle), "node long, hashes binary")
    asked = by_region(asked.join(scratch.save(sets, "sets"), "node"))
    more = scratch.save(asked.mapInArrow(_links(percent, low), "a long, b long"), "more")
    if not more.isEmpty():
        # The first components are stars, so that the new links only join stars.
        so_far = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        groups = scratch.save(components(so_far, scratch, "cc-2"), "groups-2")
    scratch.drop("regions", "met", "pairs", "links", "apart", "asked", "sets", "more", "texts", "nodes")

    whole = classes.join(groups, "node", "left").select("set_1", "set_2", F.coalesce("component", "node").alias("component"))
    whole = scratch.save(whole, "components")
    whole = whole.withColumnRenamed("set_1", "w_1").withColumnRenamed("set_2", "w_2")
    same = (F.col("set_1") == F.col("w_1")) & (F.col("set_2") == F.col("w_2")) & (F.col("n_shingles") > 0) & F.col("key").isNotNull()
    return sketch.join(whole, same, "left").select(
        F.col("key").alias(key), "n_shingles",
        F.coalesce("component", "key").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op8_lsh_forest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, percent=85)
