"""Words, shingles and their 64-bit hashes over Arrow text columns, by numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text. Texts are worked on in
chunks of about a megabyte, so the memory used does not depend on how many
rows an Arrow batch has; one longer text makes one longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD1B54A32D192ED03
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_STEP))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table of a base only grows."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        full[0] = 1
        _powers[base] = have = np.multiply.accumulate(full)
    return have[:n]


class Words:
    """The words of some consecutive texts.

    data: the bytes; start, end: byte offsets of each word; doc: the text of
    each word; first: index of each text's first word, with one entry more;
    h: a hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, hashed: bool = True):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        inside = ~_SPACE[data]
        before = np.empty(len(data) + 1, bool)
        before[0] = before[-1] = True
        before[1:-1] = ~inside[:-1]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        before[cut] = True
        self.start = np.flatnonzero(inside & before[:-1])
        self.end = np.flatnonzero(inside & (before[1:] | np.append(~inside[1:], True))) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        if hashed:
            n = len(data) + 1
            run = np.zeros(n, np.uint64)
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(_BASE, n)[1:], out=run[1:])
            self.h = mix((run[self.end] - run[self.start]) * powers(_BASE_INV, n)[self.start] + (self.end - self.start).astype(np.uint64))

    def bytes_of(self, i: int) -> bytes:
        """Text i as bytes."""
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on; see within() for which of them stay in one text."""
        out, width = self.h, 1
        made = {1: out}
        while width * 2 <= k:
            out = _joined(out, width, out, width)
            width *= 2
            made[width] = out
        for step in sorted(made, reverse=True):
            if width + step <= k:
                out = _joined(out, width, made[step], step)
                width += step
        return mix(out + _U(k))

    def within(self, k: int) -> np.ndarray:
        """For each word, whether the k words from it on are in one text."""
        ok = np.zeros(len(self.start), bool)
        if len(ok) >= k:
            ok[: len(ok) - k + 1] = self.doc[: len(ok) - k + 1] == self.doc[k - 1 :]
        return ok


def _joined(left: np.ndarray, a: int, right: np.ndarray, b: int) -> np.ndarray:
    """Hashes of a+b words from hashes of a words and of b words."""
    out = left * _U(pow(_STEP, b, 1 << 64))
    if len(out) > a:
        out[:-a] += right[a:]
    return out


def chunks(text: pa.Array, lower: bool = False, hashed: bool = True, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of texts; a null text is an empty one."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if n == 0:
        return
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower, hashed)
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary a row: values cut into consecutive pieces of the given lengths."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.asarray(lengths, np.int64) * width, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal keys; the batches come sorted by the key."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        ends = tuple(c[-1] for c in cols)
        same = np.ones(b.num_rows, bool)
        for c, v in zip(cols, ends, strict=True):
            same &= c == v
        cut = int(np.argmax(same))
        if cut or (last is not None and last != ends):
            head = held + ([b.slice(0, cut)] if cut else [])
            if head:
                yield pa.Table.from_batches(head)
            held = []
        held.append(b.slice(cut))
        last = ends
    if held:
        yield pa.Table.from_batches(held)
