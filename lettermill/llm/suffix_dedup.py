r"""Substring dedup by prefix-partitioned suffix trees over words.

Every word of a text begins a suffix. Suffixes are split by a prefix of 1, 2, 3 or all 13 words, as long as it must be for
the group to fit a task's memory; how many suffixes each prefix has is counted first, over all texts. A group's suffixes in
the order of their next words are its subtree: neighbours that agree in 13 words hang below one internal node of that
depth. Such a deep node with suffixes of two documents is a repeat, and windows that follow one another in a text join to
maximal repeats. Nodes between prefix and window decide nothing, so they are not made: a suffix carries its group and
56 bits of its window's hash. Suffixes of less than 13 words have no deep node above them and are left out.

A task holds a chunk of whole texts and decides within it first, so that of each window it sends one suffix, however often
the chunk repeats it. A passage that stands in a third of all documents is one suffix a chunk.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.scratch import Scratch, small_batches
from lettermill.llm.words import U, Texts, mix, pieces

#: Words of a window.
WINDOW = 13
#: A word of a prefix is a digit of BITS bits, hashed with the words before it; prefixes of up to LEVELS words are counted.
BITS, LEVELS = 6, 3
#: Suffixes a group may have before those of one chunk are joined; larger groups take a longer prefix.
GROUP = 1 << 19
#: Bytes of text of one chunk. A longer text is a chunk of its own.
CHUNK = 16 << 20
#: Bytes of a window's hash that a suffix carries. Only suffixes of one group are compared, which a prefix has parted by other bits before.
HASH = 7
#: Bytes of spans that may be broadcast to the texts; beyond it, texts and spans are joined by shuffle.
BROADCAST_BYTES = 32 << 20
_NONE = np.int64(2**63 - 1)


def _digits(texts: Texts, at: np.ndarray) -> np.ndarray:
    """The prefix of LEVELS words of each suffix as a number of LEVELS digits; ``at`` are the first words of windows."""
    h, out = np.zeros(len(at), U), np.zeros(len(at), np.int64)
    for i in range(LEVELS):
        h = mix(h * U(0x9E3779B97F4A7C15) + texts.word[at + i])
        out = (out << BITS) | (h >> U(64 - BITS)).astype(np.int64)
    return out


def prefix_counts(docs: DataFrame, text: str, window: int) -> np.ndarray:
    """How many suffixes begin with each prefix of LEVELS words (as digits). Counted per task, then added up; the result has 2^18 numbers whatever the input."""
    size = 1 << (BITS * LEVELS)

    def work(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, texts in pieces(batch.column(0)):
                texts.words()
                at, _ = texts.windows(window)
                n += np.bincount(_digits(texts, at), minlength=size)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["prefix", "n"])

    out = np.zeros(size, np.int64)
    for r in docs.select(text).mapInArrow(work, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).collect():
        out[r["prefix"]] = r["n"]
    return out


def choose_prefixes(counts: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, bits) of each prefix of LEVELS words.

    From one word on, a prefix of at most ``group`` suffixes is a group, a larger one is parted by its next word. What is larger even
    with LEVELS words is parted by the whole window: by as many leading bits of its hash as it takes.
    """
    first, bits, n = np.full(len(counts), -1, np.int64), np.zeros(len(counts), np.int64), 0
    for level in range(1, LEVELS + 1):
        below = 1 << (BITS * (LEVELS - level))
        sums = counts.reshape(-1, below).sum(1)
        for node in np.flatnonzero(sums):
            own = slice(node * below, (node + 1) * below)
            if first[own.start] >= 0 or (sums[node] > group and level < LEVELS):
                continue
            k = max(0, int(-(-sums[node] // group) - 1).bit_length())
            first[own], bits[own], n = n, k, n + (1 << k)
    return first, bits


def _chunk_rows(number: str, ids: np.ndarray, keys: np.ndarray, parts: list[tuple], first: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
    """Rows of one chunk: (chunk, group, a, b, c, d). ``parts``: per piece of text (words a row, first words of windows, digits, window hashes).

    Group -1 keeps what the chunk has decided itself; the others are its suffixes of a group with their documents, in the order of the text.
    """
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([p[0] for p in parts]))])
    at, digits, h = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    parts.clear()
    doc = (np.searchsorted(bounds, at, side="right") - 1).astype(np.int32)
    group = first[digits].astype(np.int32)
    deep = np.flatnonzero(bits[digits])
    group[deep] += (h[deep] >> (U(64) - bits[digits[deep]].astype(U))).astype(np.int32)
    del digits, deep
    # The order of a subtree: by window, then by document.
    order = np.lexsort((at, ids[doc], h))
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else order
    later = ids[doc[order]] > ids[doc[lead]]
    follow = ~new & ~later
    gone = np.zeros(bounds[-1] + 1, bool)
    gone[at[order[later]]] = True
    yield number, -1, np.packbits(gone).tobytes(), at[order[follow]].tobytes() + at[lead[follow]].tobytes(), bounds.astype(np.uint32).tobytes(), np.concatenate([ids, keys]).tobytes()
    del lead, later, follow, gone
    own = np.sort(order[new])
    own = own[np.argsort(group[own], kind="stable")]
    h, at, doc, group = h[own], at[own], doc[own], group[own]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        # Positions and ids as differences, byte by byte: the high bytes are zeros, which the shuffle's compression takes away.
        next_doc = np.diff(doc[a:b], prepend=doc[a]) > 0
        mine = ids[doc[a:b][np.concatenate([[True], next_doc[1:]])]]
        yield number, int(group[a]), _planes(h[a:b])[: HASH * (b - a)], _planes(np.diff(at[a:b], prepend=np.uint32(0))), np.packbits(next_doc).tobytes(), _planes(np.diff(mine, prepend=np.int64(0)))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all lowest ones first."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _numbers(data: bytes, kind, size: int | None = None) -> np.ndarray:
    """Numbers of ``_planes``; with ``size`` that many bytes of each are there, the others are zeros."""
    size, whole = size or np.dtype(kind).itemsize, np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], whole), np.uint8)
    out[:, :size] = planes.T
    return out.view(kind).ravel()


def suffixes(docs: DataFrame, key: str, text: str, window: int, first: np.ndarray, bits: np.ndarray) -> DataFrame:
    """(chunk, group, a, b, c, d) of all chunks, see ``_chunk_rows``."""
    shared = docs.sparkSession.sparkContext.broadcast((first, bits))

    def work(batches):
        first, bits = shared.value
        task, done = TaskContext.get().partitionId(), 0
        ids, keys, parts, size, words = [], [], [], 0, 0

        def flush():
            nonlocal ids, keys, parts, size, words, done
            if ids:
                rows = list(_chunk_rows(f"{task}-{done}", np.concatenate(ids), np.concatenate(keys), parts, first, bits))
                done += 1
                ids, keys, parts, size, words = [], [], [], 0, 0
                for a in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64], strict=True), [pa.string(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=["chunk", "group", "a", "b", "c", "d"])

        for batch in batches:
            id_, key_ = batch.column(0).cast(pa.int64()).fill_null(int(_NONE)).to_numpy(), batch.column(1).to_numpy()
            for a, b, texts in pieces(batch.column(2)):
                if size and size + len(texts.data) > CHUNK:
                    yield from flush()
                texts.words()
                at, h = texts.windows(window)
                ids.append(id_[a:b])
                keys.append(key_[a:b])
                parts.append((texts.n_words, (at + words).astype(np.uint32), _digits(texts, at).astype(np.int32), h))
                words += len(texts.word)
                size += len(texts.data)
        yield from flush()

    rows = docs.select(F.col(key).cast("long"), F.xxhash64(text), F.col(text))
    return rows.mapInArrow(work, "chunk string, group long, a binary, b binary, c binary, d binary")


def _subtree(table: pa.Table) -> Iterator[tuple[str, bytes]]:
    """(chunk, words): the first words of windows of one group that stand in a document before, by chunk."""
    rows = table.to_pylist()
    h, at, ids, chunk = [], [], [], []
    for i, r in enumerate(rows):
        h.append(_numbers(r["a"], np.uint64, HASH))
        at.append(np.cumsum(_numbers(r["b"], np.uint32), dtype=np.uint32))
        ids.append(np.cumsum(_numbers(r["d"], np.int64))[np.cumsum(np.unpackbits(np.frombuffer(r["c"], np.uint8), count=len(at[-1])), dtype=np.int32)])
        chunk.append(np.full(len(at[-1]), i, np.int32))
    h, at, ids, chunk = map(np.concatenate, (h, at, ids, chunk))
    # Leaves in the order of the subtree; a change of the window's hash ends a deep node.
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = order[ids > least]
    gone = gone[np.lexsort((at[gone], chunk[gone]))]
    cuts = np.searchsorted(chunk[gone], np.arange(len(rows) + 1))
    for i, r in enumerate(rows):
        if cuts[i] < cuts[i + 1]:
            yield r["chunk"], at[gone[cuts[i] : cuts[i + 1]]].tobytes()


def _spans(table: pa.Table, window: int) -> Iterator[tuple[int, int, list[int]]]:
    """(id, text's hash, [start, end, ...]) of the texts of one chunk that have words to remove: maximal runs of words."""
    own, replies = None, []
    for r in table.to_pylist():
        if r["group"] == -1:
            own = r
        else:
            replies.append(np.frombuffer(r["a"], np.uint32))
    bounds = np.frombuffer(own["c"], np.uint32).astype(np.int64)
    ids, keys = np.frombuffer(own["d"], np.int64).reshape(2, -1)
    starts = np.unpackbits(np.frombuffer(own["a"], np.uint8), count=int(bounds[-1]) + 1).astype(bool)
    for r in replies:
        starts[r] = True
    follow, lead = np.frombuffer(own["b"], np.uint32).reshape(2, -1)
    starts[follow] |= starts[lead]
    at = np.flatnonzero(starts)
    if not len(at):
        return
    # Windows join to a run if they touch within one text; a window never passes its text's end.
    doc = np.searchsorted(bounds, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] > at[:-1] + window) | (doc[1:] != doc[:-1])
    begin, end = at[new], at[np.concatenate([new[1:], [True]])] + window
    doc = doc[new]
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        d = int(doc[a])
        yield int(ids[d]), int(keys[d]), (np.stack([begin[a:b], end[a:b]], 1).ravel() - int(bounds[d])).tolist()


def repeat_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int | None = None) -> DataFrame:
    """(id, text_hash, spans): the word spans [start, end, ...] of each text that repeat one of a smaller id, as maximal runs; texts without any have no row.

    ``docs`` is read twice and must give the same rows again, as a table does. A null id is past all others (as 2^63 - 1).
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    first, bits = choose_prefixes(prefix_counts(docs, text, window), group or GROUP)
    # What chunks keep for themselves goes along, dealt by chunk; negative groups are no subtrees.
    rows = suffixes(docs, key, text, window, first, bits)
    rows = rows.withColumn("deal", F.when(F.col("group") < 0, -1 - F.pmod(F.xxhash64("chunk"), F.lit(1 << 40))).otherwise(F.col("group")))

    def resolve(table: pa.Table) -> pa.Table:
        if table.column("group")[0].as_py() < 0:
            return table.drop_columns(["deal"])
        found = list(_subtree(table))
        empty = pa.nulls(len(found), pa.binary())
        return pa.table([pa.array([c for c, _ in found], pa.string()), pa.array([0] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary()), empty, empty, empty], names=["chunk", "group", "a", "b", "c", "d"])

    def gather(table: pa.Table) -> pa.Table:
        found = list(_spans(table, window))
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64()))], names=["id", "text_hash", "spans"])

    answers = rows.groupBy("deal").applyInArrow(resolve, "chunk string, group long, a binary, b binary, c binary, d binary")
    spans = answers.groupBy("chunk").applyInArrow(gather, "id long, text_hash long, spans array<long>")
    # Rows equal in id and text have the same spans.
    return scratch.save(spans.dropDuplicates(["id", "text_hash"]), "spans")


def _without(texts: Texts, spans: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words, removed words, kept words joined by one space) of some rows; ``spans`` a row, or None."""
    texts.words()
    base = np.concatenate([[0], np.cumsum(texts.n_words)])
    edge = np.zeros(len(texts.word) + 1, np.int64)
    for i, s in enumerate(spans):
        if s is not None:
            s = np.asarray(s) + base[i]
            edge[s[0::2]] += 1
            edge[s[1::2]] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    starts, ends, doc = texts.starts[keep], texts.ends[keep], texts.doc[keep]
    lengths = ends - starts + 1
    out = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    data = np.concatenate([texts.data, np.zeros(1, np.uint8)])[np.arange(total) - np.repeat(out - starts, lengths)]
    data[out + lengths - 1] = 0x20
    # No space behind a text's last word.
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    inner = np.ones(total, bool)
    inner[(out + lengths - 1)[last]] = False
    sizes = np.bincount(doc, lengths, texts.n).astype(np.int64) - np.bincount(doc[last], minlength=texts.n)
    joined = pa.Array.from_buffers(pa.large_string(), texts.n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inner]))])
    return texts.n_words, texts.n_words - np.bincount(doc, minlength=texts.n), joined


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int | None = None) -> DataFrame:
    r"""``docs`` with ``n_words, n_removed, n_repeats`` and ``kept``, the words that stay, joined by one space.

    - Words are ``[^\x20\x09-\x0D]+``, unchanged. A window is ``window`` consecutive words of one text. A word goes if a window
      over it also begins in a document with a smaller ``key``; windows are judged on the input. ``n_repeats`` counts the
      maximal runs that go.
    - Null and empty texts have no words: 0, 0, 0 and ''. Texts shorter than a window lose nothing.
    - Rows of one key do not take words from each other; rows equal in key and text get the same result. A null key is past all
      others. ``key`` must be a whole number.
    - A text of any length is one piece of work: its words are numbers of 8 bytes in some arrays, linear in its length.
    - An empty table gives no rows. Columns of these names are replaced, all others are kept.

    Windows of one group are equal if 56 bits of their hashes are. Spans are joined to the texts by key and the text's hash.
    """
    made = ["n_words", "n_removed", "n_repeats", "kept"]
    spans = repeat_spans(docs, key, text, window, group).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    own = docs.drop(*[c for c in made if c not in (key, text)])
    own = own.withColumns({"__key": F.coalesce(F.col(key).cast("long"), F.lit(int(_NONE))), "__text": F.xxhash64(text)})
    size = spans.agg(F.coalesce(F.sum(F.size("__spans") * 8 + 64), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    joined = own.join(spans, (F.col("__key") == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left").drop("__key", "__text", "__id", "__hash")
    columns = [c for c in joined.columns if c != "__spans"]

    def work(batches):
        for batch in batches:
            for a, b, texts in pieces(batch.column(text)):
                part = batch.slice(a, b - a)
                n, gone, kept = _without(texts, part.column("__spans").to_pylist())
                spans = pc.fill_null(pc.list_value_length(part.column("__spans")), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(n.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array(spans), kept], names=[*columns, *made])

    schema = joined.drop("__spans", *made).schema
    for c in made[:3]:
        schema = schema.add(c, "long")
    return joined.mapInArrow(work, schema.add("kept", "string"))


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT row, doc_id, r.i AS at, array_to_string(words[r.i:r.i + {WINDOW - 1}], ' ') AS said FROM texts, unnest(range(1, len(words) - {WINDOW - 2})) r(i)),
least AS (SELECT said, min(doc_id) AS first FROM windows GROUP BY said),
gone AS (SELECT DISTINCT w.row, w.at + r.k AS at FROM windows w JOIN least USING (said), range({WINDOW}) r(k) WHERE w.doc_id > least.first),
words AS (SELECT row, r.i AS at, words[r.i] AS word FROM texts, unnest(range(1, len(words) + 1)) r(i)),
kept AS (SELECT w.row, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.at) AS kept FROM words w ANTI JOIN gone g ON w.row = g.row AND w.at = g.at GROUP BY w.row)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(len(t.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (row)
"""
