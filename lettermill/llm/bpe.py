"""BPE encoding and decoding over a trie of the distinct words.

The distinct words of a batch go into one trie, walked depth first. Every node gets the last token of the
encoding of its path: the one token that ends the path and may stand behind the last token of the rest.
So a prefix that many words share is encoded once; the walk keeps only the nodes from the root to where it is.
"""

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.scratch import small_batches

#: Words, and runs of words and marks, of one generation whose encodings a task remembers (see ``Recent``). Bounds memory, changes no result.
REMEMBERED = 60_000
#: Bytes of text that are held as Python strings at once.
BATCH_BYTES = 1 << 19

_SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RUN = regex.compile(f"[{_SPACES}]+")
_NO_SPACES = regex.compile(r"[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    letter = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [letter[b] for b in range(256)]


class Recent:
    """Encodings by word, in two generations: what is not asked for while one fills up is forgotten with it."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def unknown(self, words: set) -> set:
        """The words that are not known; the others are young from now on."""
        unknown = {w for w in words if w not in self.young}
        known = {w: self.old[w] for w in unknown if w in self.old}
        self.young.update(known)
        return unknown - known.keys()

    def age(self) -> None:
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young


@dataclass(slots=True)
class Suffix:
    """The longest end of a path that some token starts with, and the tokens that are an end of it, longest first."""

    text: str
    inside: list[tuple[int, int]]
    last: list[tuple[int, int]]
    onward: dict[str, "Suffix"]


class WordBpe:
    """Encoder of one tokenizer file: BPE with word ends, lower case, white space dropped, no decoder."""

    def __init__(self, spec: str):
        file = json.loads(spec)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACES}"))
        letters = _byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        #: (left id, right id) to (rank, id of the whole); and how each id was made.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank.setdefault((a, b), r)
            self.made.setdefault(whole, (a, b, r))
        self.raw = {i: i.to_bytes(4, "little") for i in self.vocab.values()}
        self.starts = {t[:k] for whole in self.vocab for t in [whole.removesuffix(self.end)] for k in range(len(t) + 1)}
        self.suffixes: dict[str, Suffix] = {}
        self.root = self._suffix("")
        self.right_edges: dict[int, list] = {}
        self.left_edges: dict[int, list] = {}
        #: By the second token: which tokens it may follow.
        self.fits: dict[int, dict[int, bool]] = {i: {} for i in self.vocab.values()}

    def _suffix(self, text: str) -> Suffix:
        while text not in self.starts:
            text = text[1:]
        known = self.suffixes.get(text)
        if known is None:
            ends = [(k, text[len(text) - k :]) for k in range(len(text), 0, -1)]
            inside = [(self.vocab[t], k) for k, t in ends if t in self.vocab]
            last = [(self.vocab[t + self.end], k) for k, t in ends if t + self.end in self.vocab]
            known = self.suffixes[text] = Suffix(text, inside, last, {})
        return known

    def _onward(self, suffix: Suffix, letter: str) -> Suffix:
        found = suffix.onward[letter] = self._suffix(suffix.text + letter)
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(part, rank it is made at, rank it is used up at) of the parts that are ever at one edge of a token, largest first."""
        out, used = [], 1 << 60
        while True:
            made = self.made.get(token)
            out.append((token, made[2] if made else -1, used))
            if not made:
                return out
            used, token = made[2], made[side]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when their joint text is encoded.

        They do not if some part at a's right edge and some part at b's left edge, which are there at the
        same time, merge at a rank before either is used up inside its own token. At equal ranks the
        leftmost merge comes first: a's own merge before the joint one, the joint one before b's own.
        """
        right = self.right_edges.get(a) or self.right_edges.setdefault(a, self._edge(a, 1))
        left = self.left_edges.get(b) or self.left_edges.setdefault(b, self._edge(b, 0))
        apart = True
        for x, x_from, x_to in right:
            for y, y_from, y_to in left:
                r = self.rank.get((x, y))
                if r is not None and r < x_to and r <= y_to and x_from < y_to and y_from < x_to:
                    apart = False
        self.fits[b][a] = apart
        return apart

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Token ids of distinct words, given in byte letters; all over one trie, in depth-first order since sorted words share their path."""
        fits, raw, may_follow, onward = self.fits, self.raw, self.may_follow, self._onward
        deepest = max(map(len, words), default=0) + 1
        # By depth on the path: its suffix, its last token (-1 if no token can end there) and that token's length. The root is before all
        # tokens. A word's ids are read back from its end, so that memory is linear in the longest word.
        suffix, token, length = [self.root] * deepest, [-1] * deepest, [0] * deepest
        before = ""
        out: dict[str, bytes] = {}
        for w in sorted(words):
            n = len(w)
            depth, most = 0, min(len(before), n) - 1
            while depth < most and before[depth] == w[depth]:
                depth += 1
            here, last, begun = suffix[depth], -1, 0
            while depth < n:
                letter = w[depth]
                here = here.onward.get(letter) or onward(here, letter)
                depth += 1
                last = -1
                for t, size in here.inside if depth < n else here.last:
                    a = token[depth - size]
                    if a < 0:
                        apart = size == depth
                    else:
                        apart = fits[t].get(a)
                        if apart is None:
                            apart = may_follow(a, t)
                    if apart:
                        last, begun = t, size
                        break
                if depth < n:
                    suffix[depth], token[depth], length[depth] = here, last, begun
            own = []
            while last >= 0:
                own.append(raw[last])
                depth -= begun
                last, begun = token[depth], length[depth]
            out[w] = b"".join(reversed(own))
            before = w
        return out

    def runs(self, text: str) -> list[str]:
        """The text's runs without white space, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower case letter by letter: a final sigma is not special.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        # Python also splits at these four, which are no white space here.
        return text.split() if not _NO_SPACES.search(text) else _SPACE_RUN.sub(" ", text).split(" ")

    def parts(self, text: str) -> list[str | int]:
        """Runs without white space, and ids of special tokens that stand in the text."""
        if not any(t in text for t in self.special):
            return self.runs(text)
        out: list[str | int] = []
        for piece in self.special_cut.split(text):
            out += [self.special[piece]] if piece in self.special else self.runs(piece)
        return out

    def words_of(self, run: str) -> list[str]:
        """The words of a run, in byte letters."""
        return [run] if run.isascii() and run.isalpha() else [self.as_letters(w) for w in self.word.findall(run)]

    def encode_texts(self, texts: list[str], memory: Recent, words: Recent) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; ``memory`` and ``words`` keep runs and words already encoded."""
        split = [self.parts(t) for t in texts]
        new = memory.unknown(set().union(*split))
        runs = {p: self.words_of(p) for p in new if isinstance(p, str)}
        words.young.update(self.encode_words(words.unknown({w for run in runs.values() for w in run})))
        memory.young.update({p: words.young[run[0]] if len(run) == 1 else b"".join([words.young[w] for w in run]) for p, run in runs.items()})
        memory.young.update({p: p.to_bytes(4, "little") for p in new if not isinstance(p, str)})
        out = [b"".join([memory.young[p] for p in parts]) for parts in split]
        memory.age()
        words.age()
        return out

    def as_letters(self, word: str) -> str:
        if word.isascii():
            return word if word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return "".join([self.letters[b] for b in word.encode()])


class WordDecoder:
    """Decoder of the same files, which name no decoder: tokens are joined by spaces, ids that name no token are left out."""

    def __init__(self, spec: str):
        file = json.loads(spec)
        named = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        #: Tokens by id; null where an id names none.
        self.tokens = pa.array([named.get(i) for i in range(max(named, default=-1) + 1)], pa.string())

    def decode(self, ids: list[bytes]) -> pa.Array:
        """The texts of some rows of ids."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        ends = np.cumsum([len(r) // 4 for r in ids])
        taken = self.tokens.take(pa.array(np.where(flat < len(self.tokens), flat, 0)))
        good = (flat < len(self.tokens)) & taken.is_valid().to_numpy(zero_copy_only=False)
        if not good.all():
            ends = np.append(0, np.cumsum(good))[ends]
            taken = taken.filter(pa.array(good))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), taken)
        return pc.binary_join(lists, " ")


class Held:
    """What the tasks of one Python process share: encoder, decoder and remembered encodings of the tokenizer last used."""

    def __init__(self, spec: str):
        self.bpe, self.decoder, self.memory, self.words = WordBpe(spec), WordDecoder(spec), Recent(), Recent()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.bpe.encode_texts(texts, self.memory, self.words)


@lru_cache(maxsize=1)
def held(spec: str) -> Held:
    return Held(spec)


def load_spec(path: str) -> str:
    """A tokenizer file as text; its size is fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _runs(column: pa.Array, null: str | bytes = "") -> Iterator[tuple[int, list]]:
    """(first row, values) of runs of rows of a bounded number of bytes; nulls are empty."""
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        b = max(int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_BYTES, side="right")), a + 1)
        yield a, [t or null for t in column.slice(a, b - a).to_pylist()]
        a = b


def _mapped(df: DataFrame, made: dict[str, str], work) -> DataFrame:
    """``df`` with more columns (replaced if they are there) that ``work`` makes batch by batch."""
    own = df.select(*[c for c in df.columns if c not in made])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema] + [f"`{name}` {kind}" for name, kind in made.items()])
    small_batches(df.sparkSession)
    return own.mapInArrow(work, schema)


def encode(df: DataFrame, spec: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: the tokens of the whole text as little-endian unsigned 32-bit integers (binary).

    - Special tokens' strings in a text become their ids; none are added. Null and empty texts have no tokens.
    - Rows come out as they came in, repeated rows repeated; a column named ``ids`` is replaced. No shuffle.
    - A Python process holds one batch of rows and at most twice ``REMEMBERED`` encoded runs and words, besides those of the batch.
    """
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def work(batches):
        own = held(shared.value)
        for batch in batches:
            for a, texts in _runs(batch.column(text)):
                got = pa.array(own.encode(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(texts)).columns, got], names=[*batch.schema.names, ids])

    return _mapped(df, {ids: "binary"}, work)


def decode(df: DataFrame, spec: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` (as ``encode`` makes them); null ids give an empty text. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def work(batches):
        tokens = WordDecoder(shared.value)
        for batch in batches:
            for a, rows in _runs(batch.column(ids), b""):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(rows)).columns, tokens.decode(rows)], names=[*batch.schema.names, text])

    return _mapped(df, {text: "string"}, work)


def round_trip(df: DataFrame, spec: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` with one Python process a task in place of two."""
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def work(batches):
        own = held(shared.value)
        for batch in batches:
            for a, texts in _runs(batch.column(text)):
                got = own.encode(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(texts)).columns, pa.array(got, pa.binary()), own.decoder.decode(got)], names=[*batch.schema.names, ids, decoded])

    return _mapped(df, {ids: "binary", decoded: "string"}, work)


def digests(df: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``n_tokens, ids_sha256, decoded_sha256``."""
    return df.withColumns({"n_tokens": (F.octet_length(ids) / F.lit(4)).cast("long"), "ids_sha256": F.sha2(ids, 256), "decoded_sha256": F.sha2(F.col(text).cast("binary"), 256)})


def op4_trie_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spec = load_spec(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs, spec)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
