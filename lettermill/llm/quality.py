r"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are trained on the driver from a bounded sample of labelled documents, under monotonic
constraints, and flattened into node arrays that score a batch of documents level by level.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.scratch import small_batches
from lettermill.llm.words import SPACE, U, mix, pieces

#: Labelled documents that are fitted on at most; chosen by the hash of their id, so the sample is the same each time.
SAMPLE = 20_000
SAMPLE_BYTES = 20_000 * 8 * 16

#: Statistic and the direction that quality must not go against: -1 falls, 1 rises, 0 is free.
FEATURES = (
    ("words", 0), ("word_length", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1),
    ("upper_share", -1), ("shout_share", -1), ("digit_share", 0), ("comma_share", 0), ("wide_share", 0), ("words_a_line", 0), ("distinct_share", 1),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5


def _flag(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_BYTES = np.arange(256)
_CHAR = (_BYTES & 0xC0) != 0x80
_FLAGS = {
    "chars": _CHAR & ~SPACE, "symbols": _flag("#*$%&|<>"), "upper": _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "shout": _flag("!"), "digit": _flag("0123456789"), "comma": _flag(",.;:"), "wide": _CHAR & (_BYTES >= 0x80), "breaks": _flag("\n"),
}


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is met more than once in its row, is the first of its kind in its row); rows are told apart inside the hash."""
    key = mix(h + doc.astype(U) * U(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    group = np.cumsum(new) - 1
    many, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order] = np.bincount(group)[group] > 1 if len(key) else False
    first[order] = new
    return many, first


def statistics(texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(counts, features) of some rows of text."""
    texts.words()
    count = {}
    for name, table in _FLAGS.items():
        sums = np.concatenate([[0], np.cumsum(table[texts.data], dtype=np.int64)])
        count[name] = sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]
    doc, line, filled = texts.lines()
    doc, line = doc[filled], line[filled]
    _, first = _repeats(doc, line)
    lines = np.bincount(doc, minlength=texts.n)
    dup = np.bincount(doc[~first], minlength=texts.n)
    at, h = texts.windows(WINDOW)
    many, _ = _repeats(texts.doc[at], h)
    cover = np.zeros(len(texts.word) + 1, np.int64)
    np.add.at(cover, at[many], 1)
    np.add.at(cover, at[many] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    repeat = np.bincount(texts.doc[covered], minlength=texts.n)
    _, once = _repeats(texts.doc, texts.word)
    distinct = np.bincount(texts.doc[once], minlength=texts.n)
    n = texts.n_words
    counts = {"n_words": n, "word_chars": count["chars"], "n_symbols": count["symbols"], "n_dup_lines": dup, "n_repeat_words": repeat}
    per = lambda a, b: a / np.maximum(b, 1)
    features = np.stack([
        np.log1p(n), per(count["chars"], n), per(count["symbols"], count["chars"]), per(dup, lines), per(repeat, n),
        per(count["upper"], count["chars"]), per(count["shout"], count["chars"]), per(count["digit"], count["chars"]), per(count["comma"], count["chars"]),
        per(count["wide"], count["chars"]), np.log1p(per(n, lines)), per(distinct, n),
    ], axis=1)
    return counts, features


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in flat arrays. A leaf points to itself; ``roots`` has the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds; every level moves all (row, tree) cursors at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def _best_split(bins, g, h, edges, monotone, low, high, penalty, least):
    """(gain, feature, bin, left value, right value) of the best split that keeps to the constraints; gain 0 if none."""
    top = (0.0, -1, -1, 0.0, 0.0)
    total_g, total_h = g.sum(), h.sum()
    whole = total_g**2 / (total_h + penalty)
    for f in range(bins.shape[1]):
        n = len(edges[f])
        if not n:
            continue
        gl = np.cumsum(np.bincount(bins[:, f], g, n + 1))[:-1]
        hl = np.cumsum(np.bincount(bins[:, f], h, n + 1))[:-1]
        cl = np.cumsum(np.bincount(bins[:, f], minlength=n + 1))[:-1]
        gr, hr = total_g - gl, total_h - hl
        vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
        gain = -(2 * gl * vl + (hl + penalty) * vl**2) - (2 * gr * vr + (hr + penalty) * vr**2) - whole
        good = (cl >= least) & (len(bins) - cl >= least) & ((vr - vl) * monotone[f] >= 0)
        gain = np.where(good, gain, 0.0)
        b = int(np.argmax(gain))
        if gain[b] > top[0] + 1e-12:
            top = (float(gain[b]), f, b, float(vl[b]), float(vr[b]))
    return top


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, penalty: float = 1.0, least: int = 5, monotone=None) -> Trees:
    """Boosted trees for the log odds of y; without two classes, no tree and the prior alone.

    Monotonic constraints: a split on such a feature keeps its children's values in order, and both sides are
    then held to their side of the middle between them, so the whole ensemble is monotonic in that feature.
    """
    monotone = monotone or [m for _, m in FEATURES]
    n1 = float(y.sum())
    base = float(np.log((n1 + 1) / (len(y) - n1 + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] if len(x) else e for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    nodes: list[list[float]] = []
    roots = []
    margin = np.full(len(y), base)
    for _ in range(trees if 0 < n1 < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), float(-g.sum() / (h.sum() + penalty))])
        todo = [(len(nodes) - 1, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            gain, f, b, vl, vr = _best_split(binned[rows], g[rows], h[rows], edges, monotone, low, high, penalty, least) if level < depth else (0, -1, -1, 0, 0)
            if gain <= 1e-9:
                margin[rows] += rate * nodes[node][4]
                continue
            middle = (vl + vr) / 2
            goes = binned[rows, f] <= b
            kids = []
            for side, value in ((rows[goes], vl), (rows[~goes], vr)):
                kids.append(len(nodes))
                nodes.append([0, np.inf, len(nodes), len(nodes), value])
                first = len(kids) == 1
                bound = (low, high)
                if monotone[f]:
                    below = (monotone[f] > 0) == first
                    bound = (low, middle) if below else (middle, high)
                todo.append((kids[-1], side, level + 1, *bound))
            nodes[node][:4] = [f, edges[f][b], *kids]
    flat = np.array(nodes, float).reshape(-1, 5)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), rate * flat[:, 4], np.array(roots, int), depth, base)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in pieces(batch.column("text")):
            _, x = statistics(texts)
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents: those with the least hash of their id, a bound of ``SAMPLE_BYTES`` at the driver.

    Null ids, null labels and null texts are left out; a document with several labels counts once for each. Where ids repeat
    in ``docs``, the bound is kept by the hash of the statistics.
    """
    chosen = labels.select(F.col(key).alias("key"), F.col("quality").cast("int").alias("quality")).where("key is not null and quality is not null")
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "quality").limit(sample)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "key").select("quality", "text")
    small_batches(docs.sparkSession)
    made = rows.mapInArrow(_features, "quality int, x array<double>")
    got = made.orderBy(F.xxhash64("x", "quality"), "x", "quality").limit(sample).toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    y = (got["quality"].to_numpy(int) > 0).astype(float)
    order = np.lexsort([*x.T, y])  # the order in which rows arrive must not matter
    return fit(x[order], y[order])


def _judge(trees: Trees, text: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if keep_text or c != text]
            for a, b, texts in pieces(batch.column(text)):
                counts, x = statistics(texts)
                n = counts["n_words"]
                failed = (n < 10) | (100 * counts["n_repeat_words"] > 20 * n)
                score = trees.score(x)
                own = [batch.column(c).slice(a, b - a) for c in names]
                made = [pa.array(counts[c].astype(np.int64)) for c in COUNTS] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= 0))]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*names, *COUNTS, "base_failed", "score", "kept"])

    return run


def judge_quality(df: DataFrame, trees: Trees, text: str = "text", keep_text: bool = True) -> DataFrame:
    r"""``df`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    - Null and empty texts have no words and so fail the base rules (fewer than 10 words).
    - ``base_failed``: n_words < 10, or more than a fifth of the words lie in 5-word windows that are found twice or more.
    - ``kept``: not base_failed, and the trees' log odds of good quality are 0 or more.
    - Columns of these names are replaced, all others (of any type) are kept, but for the text without ``keep_text``.
      Repeated rows are judged alike; an empty table gives no rows. No shuffle.
    """
    made = {*COUNTS, "base_failed", "score", "kept"}
    own = df.select(*[c for c in df.columns if c not in made])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if keep_text or f.name != text)
    schema += ", " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    small_batches(df.sparkSession)
    return own.mapInArrow(_judge(trees, text, keep_text), schema)


def op3_boosted_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = judge_quality(docs, trees, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
