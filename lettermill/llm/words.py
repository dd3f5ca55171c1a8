r"""Word, line and shingle hashes of Arrow text columns in numpy.

A word is ``[^\x20\x09-\x0D]+``. Hashes have 64 bits; equality of words, lines and shingles is
equality of hashes. All work is on the UTF-8 bytes; every separator is an ASCII byte, so no
character is ever cut. Texts are handled whole; pieces only bound the size of temporary arrays.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text whose per-byte arrays are held at once. A longer text or word just makes a longer piece.
PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.arange(ord("A"), ord("Z") + 1)

_WORD = np.where(SPACE, U(0), _VALUES)
_WORD_LOWER = _WORD.copy()
_WORD_LOWER[_UPPER] = _WORD[_UPPER + 32]
_LINE = _VALUES.copy()
_LINE[0x0A] = 0

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for n bytes at least."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_P, _P_INVERSE)):
                steps = np.full(max(n, PIECE), base, U)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=U)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which near values part."""
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(33))


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; bytes between spans must have value 0 in ``table``."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(starts, starts[a] + PIECE)), a + 1)
        low, high = int(starts[a]), int(ends[b - 1])
        power, inverse = _tables(high - low)
        sums = np.add.reduceat(table[data[low:high]] * power[: high - low], starts[a:b] - low)
        out[a:b] = sums * inverse[starts[a:b] - low]
        a = b
    return mix(out ^ U(0x5851F42D4C957F2D))


class Texts:
    """Some rows of a text column: bytes and offsets, words on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def _word_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(self.data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(self.data), bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def words(self, lower: bool = False) -> None:
        """Sets ``starts, ends, doc`` (row of each word) and ``word`` (its hash)."""
        self.starts, self.ends = self._word_bounds()
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.word = _spans(self.data, self.starts, self.ends, _WORD_LOWER if lower else _WORD)
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""(row, hash, has a word) of every \n-split line that is not empty."""
        inside = self.data != 0x0A
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(self.data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(self.data), bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        if not len(starts):
            return np.zeros(0, int), np.zeros(0, U), np.zeros(0, bool)
        filled = np.add.reduceat((~SPACE[self.data]).astype(np.int64), starts) > 0
        return np.searchsorted(self.offsets, starts, side="right") - 1, _spans(self.data, starts, ends, _LINE), filled

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words within a row."""
        last = len(self.word) - k + 1
        if last <= 0:
            return np.zeros(0, int), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:last] == self.doc[k - 1 :])
        h = np.zeros(len(at), U)
        for i in range(k):
            h = mix(h * U(_P) + self.word[at + i])
        return at, h

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, hashes): per row the sorted distinct k-word shingles; with 1 to k - 1 words the whole sequence as one."""
        at, h = self.windows(k)
        doc = self.doc[at]
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < k))
        if len(short):
            first = np.searchsorted(self.doc, short)
            own = np.zeros(len(short), U)
            for i in range(k - 1):
                more = self.n_words[short] > i
                own[more] = mix(own[more] * U(_P) + self.word[first[more] + i] + U(i + 1))
            order = np.argsort(np.concatenate([doc, short]), kind="stable")
            doc, h = np.concatenate([doc, short])[order], np.concatenate([h, own])[order]
        bounds = np.searchsorted(doc, np.arange(self.n + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return np.searchsorted(doc[new], np.arange(self.n + 1)), h[new]


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of runs of rows of about ``size`` bytes; nulls are empty texts."""
    for chunk, base in _chunks(column):
        chunk = chunk.cast(pa.large_string()).fill_null("")
        _, offsets, data = chunk.buffers()
        offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1] if offsets else np.zeros(len(chunk) + 1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        a = 0
        while a < len(chunk):
            b = max(int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1, a + 1)
            yield base + a, base + b, Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b


def _chunks(column) -> Iterator[tuple[pa.Array, int]]:
    base = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield chunk, base
        base += len(chunk)
