"""Periodic runs of words: a suffix automaton whose end positions are merged small to large.

Two neighbouring end positions of a state, no farther apart than the state is
long, end a square; the state's length says how far the repetition reaches to
the left, and the last such pair how far it reaches to the right.  Texts are
handled one by one inside Arrow batches, so nothing is shuffled and a lost
executor costs its own batches only.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_batches, words

#: Least words of a run.
LEAST = 12
#: A run holds two equal stretches of so many words, a period apart: its length less its period is LEAST / 2 at least.
SEED = LEAST // 2
#: Rounds in which words outside repeated stretches are left out; more rounds save time only.
ROUNDS = 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def automaton(w: list[int]) -> tuple[array, array, array]:
    """(length, link, end) of each state of the words' suffix automaton; end is -1 for a copied state.

    Most states have one transition, kept in two arrays; only forks have a
    dictionary, so a state costs some 30 bytes.
    """
    room = bytes(8 * (2 * len(w) + 2))
    length, link, end, word, to = (array("q", room) for _ in range(5))
    link[0], end[0], word[0] = -1, -1, -1
    forks: dict[int, dict[int, int]] = {}
    size, last = 1, 0
    for i, c in enumerate(w):
        new = size
        size += 1
        length[new], end[new], word[new] = i + 1, i, -1
        p, q = last, -1
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = c, new
            else:
                f = forks.get(p)
                if f is None:
                    forks[p] = {c: new}
                elif c in f:
                    q = f[c]
                    break
                else:
                    f[c] = new
            p = link[p]
        if q >= 0 and length[q] != length[p] + 1:
            copy = size
            size += 1
            length[copy], link[copy], end[copy], word[copy], to[copy] = length[p] + 1, link[q], -1, word[q], to[q]
            if q in forks:
                forks[copy] = dict(forks[q])
            while p >= 0:
                if word[p] == c:
                    if to[p] != q:
                        break
                    to[p] = copy
                else:
                    f = forks.get(p, {})
                    if f.get(c) != q:
                        break
                    f[c] = copy
                p = link[p]
            link[q] = q = copy
        link[new] = max(q, 0)
        last = new
    return length[:size], link[:size], end[:size]


def squares(length: array, link: array, end: array) -> Iterator[tuple[int, int, int]]:
    """(first word, period, last word) of the repetitions that neighbouring end positions show.

    States are taken from the longest; each hands its end positions to its
    link, the smaller set going into the larger one.  Pairs that become
    neighbours are judged once all sets of a state have met.  Positions are
    kept negated: repetitions add them from the right, at the end of a list.
    """
    sets: dict[int, list[int]] = {}
    fresh: dict[int, list[tuple[int, int]]] = {}
    for v in np.argsort(np.asarray(length), kind="stable")[::-1].tolist():
        size = length[v]
        if size < SEED:
            break
        mine = sets.pop(v, None)
        if mine is None:
            mine = [-end[v]]
        for low, high in fresh.pop(v, ()):
            at = bisect_left(mine, low)
            if mine[at + 1] == high:
                yield -high - size + 1, high - low, -low
        p = link[v]
        reach = length[p]
        if reach < SEED:
            continue
        other = sets.get(p)
        if other is None:
            if end[p] < 0:
                sets[p] = mine
                continue
            other = [-end[p]]
        if len(other) > len(mine):
            mine, other = other, mine
        pairs = fresh.setdefault(p, [])
        k = 0
        while k < len(other):  # stretches of the smaller set between two neighbours of the larger one
            first = other[k]
            at = bisect_left(mine, first)
            above = mine[at] if at < len(mine) else None
            to = len(other) if above is None else bisect_left(other, above, k)
            if at and first - mine[at - 1] <= reach:
                pairs.append((mine[at - 1], first))
            if above is not None and above - other[to - 1] <= reach:
                pairs.append((other[to - 1], above))
            k = to
        if 8 * len(other) < len(mine):
            for x in other:
                insort(mine, x)
        else:
            mine = sorted(mine + other)  # two ascending lists, or few of them: merged in linear time
        sets[p] = mine


def find_runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words, by start and period."""
    last: dict[tuple[int, int], int] = {}
    for start, period, to in squares(*automaton(w)):
        key = start, period
        if last.get(key, -1) < to:
            last[key] = to
    return sorted((s, e - s + 1, q) for (s, q), e in last.items() if e - s + 1 >= max(LEAST, 2 * q))


def _spread(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks of n words: those that stretches of ``size`` words from ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def islands(w: tokens.Words) -> Iterator[tuple[int, int]]:
    """(first, past the last) word of the stretches outside which no run can lie.

    Every word of a run is in a stretch of SEED words that comes again inside
    the run, so words in no repeated stretch part a text into islands.  Hashes
    decide here; one that is shared by unlike stretches only costs time.
    """
    places, group = np.arange(len(w.doc)), w.doc
    for _ in range(ROUNDS):
        if len(places) < LEAST:
            return
        at, key = tokens.windows(tokens.Words(group, w.hash[places], *[places] * 4), SEED)
        key = tokens.mix(key ^ tokens.mix(group[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        keep = _spread(at[again], len(places), SEED)
        gone = len(places) - int(keep.sum())
        places, group = places[keep], group[keep]
        if not len(places):
            return
        new = np.concatenate([[True], (np.diff(places) != 1) | (np.diff(group) != 0)])
        group = np.cumsum(new) - 1
        long = np.bincount(group)[group] >= LEAST
        gone += int((~long).sum())
        places, group = places[long], group[long]
        if not gone:
            break
    if len(places):
        first = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        yield from zip(places[first].tolist(), (places[np.append(first[1:], len(places)) - 1] + 1).tolist(), strict=True)


def _collapsed(w: tokens.Words, dropped: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of the words not dropped, joined by one space."""
    keep = np.flatnonzero(~dropped)
    data = w.data.copy()
    edge = np.zeros(len(data) + 1, np.int8)
    last = np.append(w.doc[keep][1:] != w.doc[keep][:-1], True) if len(keep) else np.zeros(0, bool)
    after = np.where(last, 0, 1)  # the byte past a word becomes its space
    data[w.end[keep[~last]]] = 32
    np.add.at(edge, w.start[keep], 1)
    np.add.at(edge, w.end[keep] + after, -1)
    mark = np.cumsum(edge[:-1], dtype=np.int8) > 0
    total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(data[mark])])


def _of_batch(texts: pa.Array) -> tuple[list[int], list[list[tuple[int, int, int]]], pa.Array]:
    w = tokens.split_words(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    dropped = np.zeros(len(w.doc), bool)
    for a, b in islands(w):
        names: dict[bytes, int] = {}
        raw = w.data[w.start[a] : w.end[b - 1]].tobytes()
        base = int(w.start[a])
        ids = [names.setdefault(raw[s - base : e - base], len(names)) for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
        doc = int(w.doc[a])
        for s, size, q in find_runs(ids):
            found[doc].append((a + s - int(w.first[doc]), size, q))
            dropped[a + s + q : a + s + size] = True
    return np.diff(w.first).tolist(), [sorted(x) for x in found], _collapsed(w, dropped, w.bounds)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed text.

    A run is a stretch of LEAST words or more, twice its smallest period or
    more, that no neighbouring word extends.  ``collapsed`` drops what follows
    a run's first period; its words are joined by one space.  Null and empty
    texts have no runs and an empty text; repeated rows and null ids keep a row
    each; other columns are not read.  Memory grows with the longest text (some
    200 bytes a word of its repeated stretches), not with the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in tokens.slices(batches):
            n, found, texts = _of_batch(batch.column(1))
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
            inner = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), inner), texts.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    with arrow_batches(docs.sparkSession, 2000):
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text; the words of texts whose crc32(doc_id) is divisible by ten repeat from a place of theirs on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.expr("h div 10")
    some = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words(F.col("text"))).alias("w"))
    n = F.size("w").cast("long")
    some = some.select("doc_id", "text", "w", g.alias("g"), n.alias("n")).select("doc_id", "text", "w", "g", "n", F.when(F.col("n") > 0, F.expr("g % n")).alias("a"))
    some = some.select("doc_id", "text", "w", "n", "a", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a + p - 1) div p))), 1, int(n - a))")
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.expr("slice(w, 1, int(a))"), tail), " ")).otherwise(F.col("text"))
    return some.select("doc_id", text.alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns of find() over the planted texts; documents without a run have nulls for the longest one."""
    found = find(planted(docs))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("q"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    return out.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.q")).alias("period"),
        F.expr("1000 * b.length div (-b.q)").alias("exponent_milli"), _digest(F.col("lines")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
