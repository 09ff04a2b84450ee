"""Vectorised text kernels over Arrow buffers, shared by the operators.

Words are byte runs; every kernel works on the UTF-8 bytes of a whole batch
with numpy, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from textsieve.session import share_package

U64 = np.uint64
#: Bytes of text handled at once; a longer document forms a slice of its own.
SLICE_BYTES = 1 << 21

_rng = np.random.default_rng(20240229)
#: Random value of each byte, so that a word's hash mixes all 64 bits.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}

#: ASCII lower-casing of bytes; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, mod 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values, each times a power of the base."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUE[data] * up[:-1], out=sums[1:])
    return sums


def _range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice: byte ranges, document of each, first word of each document."""

    data: np.ndarray  #: lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  #: words before each document, one more than documents
    sums: np.ndarray | None = None

    def range_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range.

        It comes from running sums of weighted bytes.  Those of a long text are
        made piece by piece, in the order of the ranges, so that memory stays
        bounded; a hash does not depend on where the sums begin.
        """
        if len(self.data) > 2 * SLICE_BYTES and len(start):
            out, order, at = np.empty(len(start), dtype=np.uint64), np.argsort(start, kind="stable"), 0
            ordered = start[order]
            while at < len(order):
                to = int(np.searchsorted(ordered, ordered[at] + SLICE_BYTES, side="right"))
                own = order[at:to]
                low = int(ordered[at])
                out[own] = _range_hashes(_sums(self.data[low : int(end[own].max())]), start[own] - low, end[own] - low)
                at = to
            return out
        if self.sums is None:
            self.sums = _sums(self.data)
        return _range_hashes(self.sums, start, end)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.range_hashes(self.start, self.end)


def words_of(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, more: np.ndarray | None = None) -> Words:
    """Split lower-cased texts (bytes, offsets from 0) into maximal runs of word bytes.

    more: further bytes, by position, that belong to words.
    """
    data = LOWER[data]
    n, docs = len(data), len(offsets) - 1
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word_byte[data] if more is None else word_byte[data] | more
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] |= inside[1:-1][cut]
    ends[cut - 1] |= inside[1:-1][cut - 1]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets, side="left")
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(data, start, end, doc, first)


_SHINGLE_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): distinct k-word shingles of each document, ascending.

    A document of 1 to k-1 words has its whole word sequence as its one
    shingle; one without words has none.
    """
    h = words.hashes()
    docs = len(words.first) - 1
    counts = np.diff(words.first)
    with np.errstate(over="ignore"):
        n = max(len(h) - k + 1, 0)
        sums = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            sums += h[j : j + n] * _SHINGLE_FACTORS[j]
        whole = words.doc[:n] == words.doc[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
        values, doc = mix64(sums[whole]), words.doc[:n][whole]
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            short = np.empty(len(few), dtype=np.uint64)
            for i, d in enumerate(few):
                own = h[words.first[d] : words.first[d + 1]]
                short[i] = (own * _SHINGLE_FACTORS[: len(own)]).sum(dtype=np.uint64) + U64(len(own))
            values, doc = np.concatenate([values, mix64(short)]), np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            values, doc = values[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], np.searchsorted(doc[keep], np.arange(docs + 1))


def segment_reduce(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each segment; ``empty`` where a segment has no values."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    has = offsets[1:] > offsets[:-1]
    if has.any():
        out[has] = ufunc.reduceat(values, offsets[:-1][has])
    return out


def hash_words(text: str, word_byte: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return words_of(data, np.array([0, len(data)]), word_byte).hashes()


#: Most rows of an Arrow batch, so that a batch of long texts fits a worker.
BATCH_ROWS = 1000


def tune(spark) -> None:
    """Workers that find this package, and Arrow batches of BATCH_ROWS rows at most; a session that asks for fewer keeps them.

    Results are lazy, so the setting has to stay in force for as long as they are read.
    """
    share_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key, "10000"))
    if not 0 < held <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
