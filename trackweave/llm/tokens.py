"""Vectorised words and word hashes over Arrow text columns (numpy).

A batch of texts is handled as one byte array; no Python object is made per
word.  Words are runs of bytes other than 0x20 and 0x09-0x0D, which never occur
inside a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at a time; bounds the temporary arrays whatever a text's length.
SPAN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def keyed(x: np.ndarray, key: int) -> np.ndarray:
    """mix() under a key: independent hash functions from one."""
    return mix(x + U((key * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = keyed(np.arange(256, dtype=U), 77)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0..base**(n-1) modulo 2**64, kept between calls."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, SPAN + 1), base, U)
        p[0] = 1
        p = np.multiply.accumulate(p)
        _powers[base] = p
    return p[:n]


@dataclass
class Words:
    """Words of a batch: document number, hash, byte bounds; data is the batch's bytes."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    first: np.ndarray  # of each document, its first word; one more than documents
    bounds: np.ndarray | None = None  # of each document, its first byte; one more than documents

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE) -> Words:
    """Words and their 64-bit hashes; ``lower`` folds A-Z first, ``separators`` marks the bytes between words."""
    data, offsets = as_bytes(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    cut_before = np.zeros(n + 1, bool)
    cut_before[offsets] = True
    starts, ends, hashes = [], [], []
    at = 0
    while at < n:
        to = min(n, at + SPAN)
        while to < n:  # move the end of the span to a gap between words
            ahead = data[to : to + 4096]
            gap = np.flatnonzero(separators[ahead] | cut_before[to : to + len(ahead)])
            if len(gap):
                to += int(gap[0])
                break
            to += len(ahead)
        b = data[at:to]
        inside = ~separators[b]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut_before[at + 1 : to]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:] | cut_before[at + 1 : to]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        total = np.zeros(len(b) + 1, U)
        np.cumsum(_BYTE[b] * powers(_BASE, len(b)), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * powers(_INV, len(b) + 1)[s] + (e - s).astype(U)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    start, end = cat(starts, np.int64), cat(ends, np.int64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(doc, cat(hashes, U), start, end, data, first, offsets)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of adjoining byte ranges, a span of them at a time."""
    out = np.zeros(len(start), U)
    k = 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(end, start[k] + SPAN, "right")))
        a, b = start[k:to], end[k:to]
        part = data[a[0] : b[-1]]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * powers(_BASE, len(part)), out=total[1:])
        a, b = a - start[k], b - start[k]
        out[k:to] = mix((total[b] - total[a]) * powers(_INV, len(part) + 1)[a] + (b - a).astype(U))
        k = to
    return out


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of n words inside one document."""
    h, doc = words.hash, words.doc
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * _long_powers(_BASE, len(h)), out=total[1:])
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    return at, mix((total[at + n] - total[at]) * _long_powers(_INV, len(h))[at] + U(n))


def _long_powers(base: int, n: int) -> np.ndarray:
    return powers(base, n)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` bytes of text, or of one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0))
        total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as one value, byte plane by byte plane.

    High bytes that are alike then lie together and compress away in shuffles.
    """
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)


def unpack(value: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(value) // sum(widths)
    out, at = [], 0
    for k, w in zip(kinds, widths, strict=True):
        planes = np.frombuffer(value, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * w
    return out


def unpack_all(values, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The same columns of many values, one after the other."""
    parts = [unpack(v.as_py() if hasattr(v, "as_py") else v, kinds) for v in values]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def by_bucket(sorted_keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys by their top bits; empty buckets are left out."""
    if not bits:
        if len(sorted_keys):
            yield 0, slice(0, len(sorted_keys))
        return
    edges = np.searchsorted(sorted_keys, np.arange(1, 1 << bits, dtype=U) << U(64 - bits))
    edges = np.concatenate([[0], edges, [len(sorted_keys)]])
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), slice(int(edges[b]), int(edges[b + 1]))


def bucket_bits(total: int, per_bucket: int, least: int = 6, most: int = 20) -> int:
    """Bits for so many buckets that each gets about ``per_bucket`` of ``total``."""
    return max(least, min(most, int(np.ceil(np.log2(max(1, total / per_bucket))))))
