"""Hierarchical packing of token sequences into windows of several lengths.

Each task packs its own documents, a bounded number of tokens at a time: long
documents give full windows, the rest of each document is routed to the least
tier that holds it, tiers are packed from the longest window on, and the gaps
of longer windows are filled from shorter tiers.  Nothing is shuffled; a lost
executor costs its own tasks only, and running them again gives the same rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_batches

#: Windows, longest first; powers of two, so that a full window needs no padding.
TIERS = (2048, 1024, 512, 256)
#: Tokens that are packed together; bounds a task's memory, and the padding to one window for each so many tokens.
GROUP = 1 << 22
#: Tokens of a training step: windows of one tier.
STEP = 1 << 15
#: Token that ends each document.
END = 1
#: Known words of a Python worker's encoder; beyond it the oldest knowledge is dropped, which costs time only.
KNOWN = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of the wide characters that count as white space.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of whole texts, each distinct word encoded once.

    A byte-level tokenizer's pattern never joins what stands before a single
    space to what follows it, so texts are cut there (not where wide white
    space is near); the pieces are told apart by 64-bit hashes, and only unknown ones go
    through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Adds unknown pieces; keys are sorted."""
        if len(self.keys) + len(keys) > KNOWN:
            self.forget()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a batch of texts; null counts as empty."""
        data, offsets = tokens.as_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        before, here, after = data[:-2], data[1:-1], data[2:]
        cut[1:-1] = (here == 32) & ~_SPACES[before] & ~_SPACES[after] & ((before < 128) | ~_WIDE[after])
        inner = offsets[:-1][np.diff(offsets) > 0]
        cut[inner] = True
        start = np.flatnonzero(cut)
        key = tokens.hash_ranges(data, start, np.append(start[1:], len(data)))
        distinct, one = np.unique(key, return_index=True)
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > KNOWN:
                self.forget()
                new[:] = True
            end = np.append(start[1:], len(data))
            self.learn(distinct[new], [data[start[i] : end[i]].tobytes().decode("utf-8") for i in one[new].tolist()])
        at = np.searchsorted(self.keys, key)
        count, first = self.count[at], self.first[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - first, count)]
        return ids, total[np.searchsorted(start, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Window:
    """A sequence: its size once padded, and its pieces (document, start, length)."""

    size: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(p[2] for p in self.pieces)


class Pool:
    """Pieces of documents by length; takes the longest that fits, or a part of the shortest one."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def add(self, doc: int, start: int, length: int) -> None:
        insort(self.items, (length, doc, start))

    def within(self, low: int, high: int) -> list[tuple[int, int, int]]:
        """Takes out all pieces longer than ``low`` and no longer than ``high``."""
        a, b = bisect_right(self.items, (low, 1 << 62, 0)), bisect_right(self.items, (high, 1 << 62, 0))
        out, self.items[a:b] = self.items[a:b], []
        return out

    def fill(self, window: Window, below: int) -> None:
        """Fills a window's gap by pieces no longer than ``below``: whole ones first, at last a part of one."""
        gap = window.size - window.used
        while gap and self.items and self.items[0][0] <= below:
            at = bisect_right(self.items, (min(gap, below), 1 << 62, 0)) - 1
            if at >= 0:
                length, doc, start = self.items.pop(at)
                window.pieces.append((doc, start, length))
                gap -= length
            else:  # all are longer than the gap
                length, doc, start = self.items.pop(0)
                window.pieces.append((doc, start, gap))
                self.add(doc, start + gap, length - gap)
                gap = 0


def pack_group(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[Window]:
    """Windows of a group of documents with these numbers of tokens.

    All but one are full: what a tier can't fill from shorter ones is cut into
    windows of the longest size, and the last of these is padded unless its
    tokens are a power of two.
    """
    longest = tiers[0]
    out: list[Window] = []
    pool = Pool()
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(sizes):
        whole = n - n % longest
        out += [Window(longest, [(doc, start, longest)]) for start in range(0, whole, longest)]
        if n > whole:
            rest.append((n - whole, doc, whole))
    pool.items = sorted(rest)
    loose: list[tuple[int, int, int]] = []
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        for length, doc, start in reversed(pool.within(below, tier)) if below else ():
            window = Window(tier, [(doc, start, length)])
            pool.fill(window, below)
            if window.used == tier:
                out.append(window)
            else:
                loose += window.pieces
        while not below and pool.items:  # the shortest tier's pieces among themselves
            window = Window(tier)
            pool.fill(window, tier)
            if window.used == tier:
                out.append(window)
            else:
                loose += window.pieces
    window = Window(longest)
    for doc, start, length in loose:
        while length:
            part = min(length, longest - window.used)
            window.pieces.append((doc, start, part))
            start, length = start + part, length - part
            if window.used == longest:
                out.append(window)
                window = Window(longest)
    if window.pieces:
        used = window.used
        window.size = used if used & (used - 1) == 0 else longest
        out.append(window)
    return out


def steps_of(windows: list[Window], step: int = STEP) -> list[int]:
    """Step of each window: one tier each, dealt in turns by cost so that steps of a tier cost alike.

    A window's cost is the sum of the squares of its pieces, as attention
    within documents takes.
    """
    out, base = [0] * len(windows), 0
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by_size.setdefault(w.size, []).append(i)
    for size in sorted(by_size, reverse=True):
        mine = sorted(by_size[size], key=lambda i: (-sum(p[2] ** 2 for p in windows[i].pieces), i))
        n = -(-len(mine) // max(1, step // size))
        for k, i in enumerate(mine):
            turn, at = divmod(k, n)
            out[i] = base + (at if turn % 2 == 0 else n - 1 - at)
        base += n
    return out


COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint, step_id bigint"


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, its place in the document and in its sequence, the window's size, step and ids.

    ``path`` is the vocabulary file of a byte-level tokenizer.  Sequences hold
    ``window`` tokens once padded; step_id groups windows of one size, about
    STEP tokens a step.  Sequence and step numbers hold the task's number in
    their high bits.  Each row of ``docs`` is a document of its own, repeated
    and null ids too; null and empty texts have their end token only; other
    columns are not read.  A document longer than GROUP tokens is packed by
    itself: memory grows with the longest text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 36
        sequences = steps = 0
        names, ids, ends, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences, steps, names, ids, ends, held
            all_ids = np.concatenate(ids).astype("<u4")
            end = np.concatenate(ends)
            size = np.diff(end, prepend=0)
            windows = pack_group(size.tolist(), tiers)
            step = steps_of(windows)
            raw = memoryview(all_ids.tobytes())
            first = (end - size).tolist()
            rows, crc, parts = [], [], []
            for i, w in enumerate(windows):
                at = 0
                for doc, start, length in w.pieces:
                    a = first[doc] + start
                    rows.append((doc, start, length, task + sequences + i, at, w.size, task + steps + step[i]))
                    crc.append(zlib.crc32(raw[4 * a : 4 * (a + length)]))
                    if with_ids:
                        parts.append(all_ids[a : a + length])
                    at += length
            t = np.array(rows, np.int64).reshape(-1, 7)
            columns = [pa.concat_arrays(names).take(pa.array(t[:, 0])), *map(pa.array, (t[:, 1], t[:, 2], np.array(crc, np.int64), size[t[:, 0]].astype(np.int64), *t[:, 3:].T))]
            labels = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
            if with_ids:
                at = np.concatenate([[0], np.cumsum(t[:, 2])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).astype(np.int32))))
                labels.append("ids")
            sequences, steps = sequences + len(windows), steps + max(step) + 1
            names, ids, ends, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=labels)

        for batch in tokens.slices(batches):
            got, offsets = encoder(path).encode(batch.column(1))
            closed = np.insert(got, offsets[1:], END)  # an end after each document
            offsets = offsets + np.arange(len(offsets))
            at, n = 0, batch.num_rows
            while at < n:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP - held, "right")) - 1)
                if held and offsets[to] - offsets[at] + held > GROUP:
                    yield flush()
                    continue
                names.append(batch.column(0).slice(at, to - at))
                ids.append(closed[offsets[at] : offsets[to]])
                ends.append(offsets[at + 1 : to + 1] - offsets[at] + held)
                held += int(offsets[to] - offsets[at])
                at = to
        if names:
            yield flush()

    with arrow_batches(docs.sparkSession, 2000):
        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COLUMNS}" + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame, pad: int = 0) -> DataFrame:
    """Whole sequences of pack(): sequence_id, step_id, window, n_tokens, ids padded to the window, bounds where documents begin."""
    parts = pieces.groupBy("sequence_id").agg(F.first("step_id").alias("step_id"), F.first("window").alias("window"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten("p.ids")
    return parts.select(
        "sequence_id", "step_id", "window", F.size(ids).cast("long").alias("n_tokens"),
        F.concat(ids, F.array_repeat(F.lit(pad), (F.col("window") - F.size(ids)).cast("int"))).alias("ids"), F.col("p.offset").alias("bounds"),
    )


def report(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, with the window's size and the step."""
    return pack(docs, path, with_ids=False)
