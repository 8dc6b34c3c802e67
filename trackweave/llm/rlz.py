"""Substring deduplication by relative Lempel-Ziv factors.

The corpus is cut into blocks of documents, and every block is an indexed
reference for all others: its runs of ``n`` words are listed by hash in buckets,
each with the first place in the corpus that has it.  A document is then parsed
from left to right: where a listed run begins, the match is followed for as long
as the runs after it lie on in the same reference, and the reference's block
sends its words, which are compared one by one.  Factors of ``n`` words or more
are duplicate spans.  A factor's end is a boundary: runs that cross it are
matched by themselves, so a copy pieced together from several documents leaves
no gap, and what is removed is exactly what the definition by windows removes.

Blocks meet only in hash buckets.  A cheap pass first finds content-chosen
anchors that more than one block has; only windows with such an anchor are
exchanged in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .tokens import U

#: Words in a window; shorter factors are literals.
WINDOW = 13
#: Words in an anchor: each window's smallest-hash anchor stands for it.
ANCHOR = 7
#: Bytes of text in a reference block.
BLOCK_BYTES = 4 << 20
#: A missing document number: larger than any id, so nothing is earlier because of it.
NO_DOC = np.iinfo(np.int64).max


def _ordered(table: pa.Table) -> pa.Table:
    """A block's rows in the one order that all passes number them by; equal rows are alike."""
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")])) if table.num_rows else table


def _block_words(table: pa.Table) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, starts and hashes of windows, and each window's anchor."""
    w = tk.split_words(table.column("text"))
    at, h = tk.windows(w, WINDOW)
    a_at, a_h = tk.windows(w, ANCHOR)
    if not len(at):
        return w, at, h, np.zeros(0, U)
    # Anchors of a window are consecutive in a_at: the window's start is one of them.
    first = np.searchsorted(a_at, at)
    best = a_h[first]
    for k in range(1, WINDOW - ANCHOR + 1):
        best = np.minimum(best, a_h[first + k])
    return w, at, h, tk.mix(best)


def _doc_ids(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("doc_id").combine_chunks().fill_null(NO_DOC) if table.num_rows else [], np.int64)


def _rows(rows: list[tuple], names: list[str]) -> pa.Table:
    c = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(x, pa.binary() if n == "value" else pa.int32()) for x, n in zip(c, names, strict=True)], names)


def _in_sorted(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x


def with_blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """doc_id, text and block; the block is a hash of id and text, so no key can fill one."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"))


def _anchors(bits: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, _, _, anchor = _block_words(table)
        a = np.unique(anchor)
        return _rows([(b, block, tk.pack(a[s])) for b, s in tk.by_bucket(a, bits)], ["bucket", "block", "value"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's anchors, those that two blocks or more have, back to each of them."""
    block = np.asarray(table.column("block"))
    parts = [tk.unpack(v.as_py(), ("u8",))[0] for v in table.column("value")]
    keys, n = np.unique(np.concatenate(parts), return_counts=True)
    keys = keys[n > 1]
    rows = [(int(b), tk.pack(p[_in_sorted(p, keys)])) for b, p in zip(block, parts, strict=True)]
    return _rows([r for r in rows if r[1]], ["block", "value"])


def _candidates(bits: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return _rows([], ["bucket", "block", "value"])
        block = docs.column("block")[0].as_py()
        w, at, h, anchor = _block_words(docs)
        keys = np.sort(tk.unpack_all(list(shared.column("value")), ("u8",))[0])
        take = _in_sorted(anchor, keys)
        at, h = at[take], h[take]
        owner = _doc_ids(docs)[w.doc[at]]
        place = at - w.first[w.doc[at]]
        order = np.lexsort((place, owner, h))
        h, owner, place = h[order], owner[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        h, owner, place = h[first], owner[first], place[first].astype(np.uint32)
        return _rows([(b, block, tk.pack(h[s], owner[s], place[s])) for b, s in tk.by_bucket(h, bits)], ["bucket", "block", "value"])

    return run


_KINDS = ("u8", "i8", "u4")


_FOUND = ("u8", "i8", "u4", "u4")


def _first_places(table: pa.Table) -> pa.Table:
    """For each window of the bucket its first place in the corpus (document, place, block), to the blocks that have a later one."""
    block = np.asarray(table.column("block"))
    parts = [tk.unpack(v.as_py(), _KINDS) for v in table.column("value")]
    h, owner, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
    home = np.repeat(block, [len(p[0]) for p in parts]).astype(np.uint32)
    order = np.lexsort((home, place, owner, h))
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    best = order[first]
    keys, best_doc, best_place, best_home = h[best], owner[best], place[best], home[best]
    rows = []
    for b, (ph, po, _) in zip(block, parts, strict=True):
        at = np.searchsorted(keys, ph)
        later = best_doc[at] < po
        if later.any():
            rows.append((int(b), tk.pack(ph[later], best_doc[at][later], best_place[at][later], best_home[at][later])))
    return _rows(rows, ["block", "value"])


#: Rows that travel between blocks: 0, a block's own matches; 1, a request for words; 2, the words.
_PASSED = "block int, kind int, other int, value binary, text binary"
_MATCH = ("u4", "u4", "u4", "i8", "u4", "u4")  # row, start, length, and of the reference: document, start, block
_SPAN = ("i8", "u4", "u4")  # document, start, length


def _passed(rows: list[tuple]) -> pa.Table:
    c = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
    return pa.table([pa.array(x, k) for x, k in zip(c, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "kind", "other", "value", "text"])


def _matches(docs: pa.Table, found: pa.Table) -> pa.Table:
    """A block's matches, where windows and their first earlier places run on together, and requests for the words there."""
    if not docs.num_rows:
        return _passed([])
    own = docs.column("block")[0].as_py()
    docs = _ordered(docs)
    w, at, h, _ = _block_words(docs)
    if not len(at):
        return _passed([])
    ids = _doc_ids(docs)
    owner, place = ids[w.doc[at]], at - w.first[w.doc[at]]
    # First places inside the block itself.
    order = np.lexsort((place, owner, h))
    hs = h[order]
    head = np.concatenate([[True], hs[1:] != hs[:-1]])
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    ref_doc, ref_place, ref_home = np.empty(len(at), np.int64), np.empty(len(at), np.int64), np.full(len(at), own, np.int64)
    ref_doc[order], ref_place[order] = owner[lead], place[lead]
    if found.num_rows:
        fh, fd, fp, fb = tk.unpack_all(list(found.column("value")), _FOUND)
        order = np.argsort(fh, kind="stable")
        fh, fd, fp, fb = fh[order], fd[order], fp[order].astype(np.int64), fb[order].astype(np.int64)
        pos = np.minimum(np.searchsorted(fh, h), len(fh) - 1)
        better = (fh[pos] == h) & (fd[pos] < ref_doc)
        ref_doc[better], ref_place[better], ref_home[better] = fd[pos][better], fp[pos][better], fb[pos][better]
    dup = np.flatnonzero(ref_doc < owner)
    if not len(dup):
        return _passed([])
    d, r, p, q, b = w.doc[at[dup]], place[dup], ref_doc[dup], ref_place[dup], ref_home[dup]
    on = (r[1:] == r[:-1] + 1) & (d[1:] == d[:-1]) & (p[1:] == p[:-1]) & (q[1:] == q[:-1] + 1) & (b[1:] == b[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~on]))
    tail = np.concatenate([head[1:], [len(dup)]]) - 1
    length = (tail - head + WINDOW).astype(np.uint32)
    row, start, doc, ref, home = d[head].astype(np.uint32), r[head].astype(np.uint32), p[head], q[head].astype(np.uint32), b[head].astype(np.uint32)
    rows = [(own, 0, own, tk.pack(row, start, length, doc, ref, home), None)]
    far = np.flatnonzero(home != own)
    spans = np.unique(np.rec.fromarrays([home[far], doc[far], ref[far], length[far]], names="b,d,s,n")) if len(far) else []
    edges = np.flatnonzero(np.concatenate([[True], spans["b"][1:] != spans["b"][:-1]])) if len(spans) else []
    for i, e in zip(edges, [*edges[1:], len(spans)][: len(edges)], strict=True):
        rows.append((int(spans["b"][i]), 1, own, tk.pack(np.ascontiguousarray(spans["d"][i:e]), np.ascontiguousarray(spans["s"][i:e]), np.ascontiguousarray(spans["n"][i:e])), None))
    return _passed(rows)


class _Words:
    """Spans of a block's documents by id, as bytes: each word with a blank behind it."""

    def __init__(self, docs: pa.Table):
        self.w = tk.split_words(docs.column("text"))
        self.rows: dict[int, list[int]] = {}
        for i, d in enumerate(_doc_ids(docs)):
            self.rows.setdefault(int(d), []).append(i)

    def of_row(self, row: int, start: int, length: int) -> bytes:
        lo = self.w.first[row] + start
        hi = min(lo + length, self.w.first[row + 1])
        return _join(self.w.data, self.w.start[lo:hi], self.w.end[lo:hi])

    def of_doc(self, doc: int, start: int, length: int) -> list[bytes]:
        """One per row that has the id and so many words."""
        return [self.of_row(r, start, length) for r in self.rows.get(doc, ()) if self.w.first[r] + start + length <= self.w.first[r + 1]]


def _answers(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """Passes a block's own matches on and sends the words that other blocks ask for."""
    rows, words = [], None
    own_docs = None
    for kind, other, value in zip(asked.column("kind").to_pylist(), asked.column("other").to_pylist(), asked.column("value"), strict=True):
        if kind == 0:
            rows.append((other, 0, other, value.as_py(), None))
            continue
        if words is None:
            own_docs = _ordered(docs)
            words = _Words(own_docs)
        doc, start, length = tk.unpack(value.as_py(), _SPAN)
        keep, texts = [], []
        for i, span in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
            for t in words.of_doc(*span):
                keep.append(i)
                texts.append(t)
        k = np.array(keep, np.int64)
        rows.append((other, 2, other, tk.pack(doc[k], start[k], length[k]), b"\n".join(texts)))  # words have no line feeds
    return _passed(rows)


def _parse_block(docs: pa.Table, passed: pa.Table, each) -> None:
    """Calls each(row, words, spans) per document; spans are (start, length, ref_doc, ref_start), verified word by word."""
    words = _Words(docs)
    own = docs.column("block")[0].as_py() if docs.num_rows else -1
    sent: dict[tuple[int, int, int], list[bytes]] = {}
    matches = []
    for kind, value, text in zip(passed.column("kind").to_pylist(), passed.column("value"), passed.column("text"), strict=True):
        if kind == 0:
            matches.append(tk.unpack(value.as_py(), _MATCH))
        elif kind == 2:
            spans = tk.unpack(value.as_py(), _SPAN)
            for *key, t in zip(*[x.tolist() for x in spans], text.as_py().split(b"\n"), strict=True):
                sent.setdefault(tuple(key), []).append(t)
    row, start, length, doc, ref, home = (np.concatenate([m[i] for m in matches]) if matches else np.zeros(0, np.int64) for i in range(6))
    order = np.lexsort((start, row))
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    for i in order:
        r, s, n, d, q = int(row[i]), int(start[i]), int(length[i]), int(doc[i]), int(ref[i])
        texts = words.of_doc(d, q, n) if home[i] == own else sent.get((d, q, n), [])
        mine = words.of_row(r, s, n)
        if mine in texts:
            spans.setdefault(r, []).append((s, n, d, q))
            continue
        # Two windows of one hash: only what agrees is a factor.
        a = mine.split(b" ")
        for t in texts:
            same = [x == y for x, y in zip(a, t.split(b" "), strict=True)]
            k = 0
            while k < n:
                e = k
                while e < n and same[e]:
                    e += 1
                if e - k >= WINDOW:
                    spans.setdefault(r, []).append((s + k, e - k, d, q + k))
                k = e + 1
    for i in range(docs.num_rows):
        f = np.array(spans.get(i, []), np.int64).reshape(-1, 4)
        each(i, words.w, f[:, 0], f[:, 1], f[:, 2], f[:, 3])


def covered(n: int, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lens, -1)
    return np.cumsum(edge[:-1]) > 0


def _exchange(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents by block, the matches of each block and the words that they were found in)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(64, -(-size // BLOCK_BYTES))
    bits = tk.bucket_bits(size // 6, 500_000)
    blocks = with_blocks(docs, n_blocks)
    grouped = blocks.groupBy("block")
    anchors = grouped.applyInArrow(_anchors(bits), "bucket int, block int, value binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared, "block int, value binary")
    cands = grouped.cogroup(shared.groupBy("block")).applyInArrow(_candidates(bits), "bucket int, block int, value binary")
    firsts = cands.groupBy("bucket").applyInArrow(_first_places, "block int, value binary")
    asked = grouped.cogroup(firsts.groupBy("block")).applyInArrow(_matches, _PASSED)
    return blocks, grouped.cogroup(asked.groupBy("block")).applyInArrow(_answers, _PASSED)


def factors(docs: DataFrame) -> DataFrame:
    """Duplicate spans: doc_id, start, length, ref_doc, ref_start (in words).

    Each is a factor of WINDOW words or more that also stands in the document
    ref_doc, which has a smaller id.  Null texts and ids give none, and rows of
    one id are not earlier than each other.
    """
    blocks, found = _exchange(docs)

    def run(table: pa.Table, refs: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]

        def each(i, w, starts, lens, ref, rp):
            for col, x in zip(out, (np.full(len(starts), ids[i]), starts, lens, ref, rp), strict=True):
                col.append(x)

        table = _ordered(table)
        ids = _doc_ids(table)
        _parse_block(table, refs, each)
        cat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(c.astype(np.int64)) for c in cat], ["doc_id", "start", "length", "ref_doc", "ref_start"])

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "doc_id long, start long, length long, ref_doc long, ref_start long")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row.

    kept_text: the words outside all duplicate spans, joined by one space.  Null
    and empty texts have no words; a row without an id is never a reference but
    loses what others have; repeated rows of one id keep their words, each in a
    row of its own.  Of places in one document the first is the reference.  A
    long text is a block of its own.  Extra columns are not read; an empty table
    gives no rows.
    """
    blocks, found = _exchange(docs)

    def run(table: pa.Table, refs: pa.Table) -> pa.Table:
        n_words, n_removed, kept_text = [], [], []

        def each(i, w, starts, lens, ref, rp):
            lo, hi = w.first[i], w.first[i + 1]
            gone = covered(hi - lo, starts, lens) if len(starts) else np.zeros(hi - lo, bool)
            n_words.append(hi - lo)
            n_removed.append(int(gone.sum()))
            # Kept words are copied as bytes: each with the space after it.
            s, e = w.start[lo:hi][~gone], w.end[lo:hi][~gone]
            kept_text.append(_join(w.data, s, e))

        table = _ordered(table)
        _parse_block(table, refs, each)
        return pa.table(
            [table.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _join(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    if not len(s):
        return b""
    size = e - s + 1
    total = int(size.sum())
    first = np.cumsum(size) - size
    at = np.arange(total) - np.repeat(first - s, size)
    out = data[np.minimum(at, len(data) - 1)]
    out[first + size - 1] = 32
    return out[:-1].tobytes()


def report(docs: DataFrame) -> DataFrame:
    """The digest per document: doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


