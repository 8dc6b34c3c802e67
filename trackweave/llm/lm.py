"""Language-model scoring from a log-frequency Bloom filter.

Counts of token pairs are quantised to logarithmic levels and a count at level
q is stored as the memberships (pair, 1) .. (pair, q) of a Bloom filter (Talbot
and Osborne, 2007).  Scoring reads a count back by probing level after level
until one is missing, so no pair is stored.  Counting is distributed: blocks
of text send distinct keys with counts to hash buckets, every bucket fills its
own part of the filter.  Parts are broadcast, in groups where they are large,
so texts stay where they are; only where the tokens that came twice or more are
too many to broadcast, probes are sent to the parts.

The scores are probabilities: over all types, and one for what is unknown,
those that follow a token sum to one.  So a token keeps the exact sum of what
its stored pairs take, pairs that came once take nothing and aren't stored,
and the filter is so much finer, the more types there are, that all false
pairs of a token together take next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import arrow_batches, crc_mod, materialize
from .tokens import U

#: Quantisation base: level q stands for counts about LEVEL_BASE**(q-1).
LEVEL_BASE = 1.35
#: Discount of stored pairs, which came twice or more; pairs that came once are discounted whole.
DISCOUNT = 0.75
#: Stored pairs have this level or a higher one: that of two occurrences.
LEAST_LEVEL = 3
#: False pairs of a token to be expected, at most, among all types.
FALSE_PAIRS = 0.01
#: The filters are broadcast up to so many bytes at once.
BROADCAST_BYTES = 256 << 20
#: The exact token counts are broadcast up to so many tokens; beyond, tokens that came once go with the groups of the filter's parts.
#: With more tokens that came twice or more, counts are joined by shuffle, and so are the filters.
BROADCAST_TOKENS = 8_000_000

#: Bytes of text whose keys are counted together before they are sent.
COUNT_BYTES = 8 << 20

#: Rows of an Arrow batch while texts are scored beside the broadcast tables.
BATCH_ROWS = 1000

#: Keys that stand for the end of a text and for the place before its first word.
END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
_KIND = {"pair": 12}


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised log counts: 1 for 1, then one more for each factor LEVEL_BASE, rounded."""
    return 1 + np.rint(np.log(np.maximum(counts, 1)) / np.log(LEVEL_BASE)).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for; level 0 is none."""
    return np.where(level > 0, LEVEL_BASE ** (np.maximum(level, 1) - 1.0), 0.0)


def _places(keys: np.ndarray, level: int | np.ndarray, probe: int, n_bits: np.ndarray | int) -> np.ndarray:
    h = tk.mix(keys + np.asarray(level).astype(U) * U(0xD1342543DE82EF95))
    step = tk.mix(h ^ U(0xA0761D6478BD642F)) | U(1)
    return (h + U(probe) * step) % np.asarray(n_bits).astype(U)


def shape(types: int) -> tuple[int, int]:
    """(bits, probes) of a membership: a pair that isn't stored reads as one where LEAST_LEVEL memberships are false."""
    share = (FALSE_PAIRS / max(types, 1000)) ** (1 / LEAST_LEVEL)
    bits = int(np.ceil(-np.log(share) / np.log(2) ** 2))
    return bits, max(1, round(bits * np.log(2)))


def fill(keys: np.ndarray, counts: np.ndarray, per_entry: int, probes: int) -> np.ndarray:
    """The filter part that holds the quantised counts of distinct keys."""
    q = levels(counts)
    rep = np.repeat(np.arange(len(keys)), q)
    lv = np.arange(len(rep)) - np.repeat(np.cumsum(q) - q, q) + 1
    n_bits = max(64, int(len(rep)) * per_entry)
    n_bits += -n_bits % 8
    flags = np.zeros(n_bits, bool)
    for p in range(probes):
        flags[_places(keys[rep], lv, p, n_bits).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


class LogFrequencyFilter:
    """All parts of the filter, ready for probing."""

    def __init__(self, sizes: np.ndarray, data: np.ndarray, bits: int, probes: int):
        self.bits, self.probes = bits, probes
        self.first = (np.cumsum(sizes) - sizes) * 8
        self.n_bits = np.maximum(sizes * 8, 1)
        self.empty = sizes == 0
        self.data = data

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The stored level of each key: probes level 1, 2, .. until one is missing."""
        return self._probe(keys, self._bucket(keys))

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def _probe(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(~self.empty[bucket])
        q = 1
        while len(live):
            k, b = keys[live], bucket[live]
            for p in range(self.probes):
                at = self.first[b] + _places(k, q, p, self.n_bits[b]).astype(np.int64)
                hit = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                live, k, b = live[hit], k[hit], b[hit]
            out[live] = q
            q += 1
        return out

    def levels_of(self, keys: np.ndarray) -> np.ndarray:
        """level() of keys that repeat; each distinct key is probed once."""
        distinct, back = np.unique(keys, return_inverse=True)
        return self.level(distinct)[back]


def word_keys(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, key of the token before) of every token; each text ends with one end token."""
    n_docs = len(w.first) - 1
    last = w.first[1:] + np.arange(n_docs)
    n = len(w.hash) + n_docs
    is_end = np.zeros(n, bool)
    is_end[last] = True
    key = np.empty(n, U)
    key[is_end] = END
    key[~is_end] = w.hash
    doc = np.empty(n, np.int64)
    doc[is_end] = np.arange(n_docs)
    doc[~is_end] = w.doc
    before = np.empty(n, U)
    if n:
        before[1:] = key[:-1]
        before[w.first[:-1] + np.arange(n_docs)] = START
    return doc, key, before


def top_half(keys: np.ndarray) -> np.ndarray:
    """The upper 32 bits: what is known of a token's pairs is kept by them."""
    return (keys >> U(32)).astype(np.uint32)


def kind_key(kind: str, *keys: np.ndarray) -> np.ndarray:
    out = tk.keyed(keys[0], _KIND[kind])
    for k in keys[1:]:
        out = tk.mix(out * U(3) + k)
    return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays put together; the list is emptied."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def count_blocks(docs: DataFrame, bits: int) -> DataFrame:
    """Per batch of texts and bucket: distinct tokens and token pairs with counts.

    Rows (bucket, kind, value).  Words go by their own bucket, pairs by the
    pair's, with the first token's key beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=COUNT_BYTES):
            words, pairs, halves = [], [], []
            for part in tk.slices(iter([batch])):
                _, key, before = word_keys(tk.split_words(part.column(0), lower=True))
                words.append(key)
                pairs.append(kind_key("pair", before, key))
                halves.append(top_half(before))
                del key, before
            # The tokens go before the pairs are put together: a worker holds one of both at its peak.
            k, n = np.unique(_joined(words), return_counts=True)
            rows = [(b, 0, tk.pack(k[s], n[s].astype(np.uint32))) for b, s in tk.by_bucket(k, bits)]
            k, h = _joined(pairs), _joined(halves)
            order = np.argsort(k)
            k, h = k[order], h[order]
            del order
            first = np.flatnonzero(np.concatenate([k[:1] == k[:1], k[1:] != k[:-1]]))
            n = np.diff(np.concatenate([first, [len(k)]])).astype(np.uint32)
            k, h = k[first], h[first]
            rows += [(b, 1, tk.pack(k[s], h[s], n[s])) for b, s in tk.by_bucket(k, bits)]
            del k, h, n, first
            for i in range(0, len(rows), 64):
                c = list(zip(*rows[i : i + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int8()), pa.array(c[2], pa.binary())], ["bucket", "kind", "value"])

    return docs.select("text").mapInArrow(run, "bucket int, kind tinyint, value binary")


def merge_buckets(blocks: DataFrame, bits: int, per_entry: int, probes: int) -> DataFrame:
    """Per bucket: the filter part of its pairs (those that came twice or more),
    its words with exact counts, and what its pairs take by first token, cut by
    that token's bucket."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        value = table.column("value")
        bucket = table.column("bucket")[0].as_py()
        rows = []
        w = tk.merge_counts(*tk.unpack_all([value[int(i)] for i in np.flatnonzero(kind == 0)], ("u8", "u4")))
        if len(w[0]):
            rows.append((bucket, 0, tk.pack(w[0], w[1].astype(np.uint64))))
        k, h, n = tk.unpack_all([value[int(i)] for i in np.flatnonzero(kind == 1)], ("u8", "u4", "u4"))
        if len(k):
            order = np.argsort(k, kind="stable")
            k, h, n = k[order], h[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            k, h, n = k[first], h[first], np.add.reduceat(n, first)
            k, h, n = k[n > 1], h[n > 1], n[n > 1]
        if len(k):
            rows.append((bucket, 2, fill(k, n, per_entry, probes).tobytes()))
            hk, back = np.unique(h, return_inverse=True)
            taken = np.bincount(back, level_count(levels(n)) - DISCOUNT)
            rows += [(b, 1, tk.pack(hk[s], taken[s])) for b, s in tk.by_bucket(hk.astype(U) << U(32), bits)]
        c = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int8()), pa.array(c[2], pa.binary())], ["bucket", "kind", "value"])

    return blocks.groupBy("bucket").applyInArrow(run, "bucket int, kind tinyint, value binary")


def finish_words(merged: DataFrame) -> DataFrame:
    """Per bucket: words that came twice or more with exact counts and what their pairs take (kind 0), words that came once (kind 5), and what the pairs at the beginnings of texts take (kind 4).

    A word that came once has no stored pair, so none that begins with it takes anything.
    """
    start = int(top_half(np.array([START]))[0])

    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        value = table.column("value")
        bucket = table.column("bucket")[0].as_py()
        k, n = tk.merge_counts(*tk.unpack_all([value[int(i)] for i in np.flatnonzero(kind == 0)], ("u8", "u8")))
        h, m = tk.merge_counts(*tk.unpack_all([value[int(i)] for i in np.flatnonzero(kind == 1)], ("u4", "f8")))
        once = n == 1
        rows = [(bucket, 5, tk.pack(k[once])), (bucket, 0, tk.pack(k[~once], n[~once], of_sorted(h, m, top_half(k[~once]))))]
        rows += [(bucket, 4, tk.pack(x)) for x in (m[h == start],) if len(x)]
        c = list(zip(*rows, strict=True))
        return pa.table([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int8()), pa.array(c[2], pa.binary())], ["bucket", "kind", "value"])

    return merged.filter("kind < 2").groupBy("bucket").applyInArrow(run, "bucket int, kind tinyint, value binary")


def of_sorted(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the asked keys among sorted ones; 0 for others."""
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0).astype(values.dtype)


class Model:
    """A bigram model with absolute discounting whose pair counts are read from the filter.

    P(w|h) = max(q(hw) - D, 0) / t(h) + (1 - s(h) / t(h)) * P(w), where q is a
    stored pair's quantised count, s(h) the sum of q - D over h's stored pairs,
    t(h) the larger of c(h) and s(h) + D, and P(w) = (c(w) + 1) / (N + V + 1).
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, taken: np.ndarray, pairs: LogFrequencyFilter, n: int, v: int, n_texts: int, start: float):
        self.keys, self.counts, self.taken = keys, counts, taken
        self.pairs, self.n, self.v, self.n_texts, self.start = pairs, n, v, float(max(1, n_texts)), start

    def log_probs(self, key: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 P of each token after the one before it, the token's exact count)."""
        uniq, back = np.unique(np.concatenate([key, before]), return_inverse=True)
        c, s = (of_sorted(self.keys, x, uniq)[back].astype(float) for x in (self.counts, self.taken))
        n = len(key)
        ch, sh = np.where(before == START, self.n_texts, c[n:]), np.where(before == START, self.start, s[n:])
        level = np.zeros(n, np.int64)
        ask = (sh > 0) & (c[:n] > 1)
        level[ask] = self.pairs.levels_of(kind_key("pair", before[ask], key[ask]))
        return log_prob(c[:n], ch, sh, level, self.n, self.v), c[:n]


def log_prob(c: np.ndarray, ch: np.ndarray, sh: np.ndarray, level: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 P from the counts of the token and of the one before, what the latter's pairs take, and the pair's level."""
    base = (c + 1.0) / (n + v + 1.0)
    total = np.maximum(np.maximum(ch, sh + DISCOUNT), 1.0)
    level = np.minimum(level, levels(np.minimum(c, ch)))  # a pair comes no more often than its tokens
    seen = np.where((level >= LEAST_LEVEL) & (sh > 0), level_count(level) - DISCOUNT, 0.0)
    return np.log10(np.minimum(seen / total + (1.0 - sh / total) * base, 1.0))


@dataclass
class Trained:
    """What training leaves: tables in the shared folder and a few totals."""

    merged: DataFrame
    finished: DataFrame
    bits: int
    n_tokens: int
    n_types: int
    n_texts: int
    filter_bytes: int
    probes: int
    start: float
    n_once: int


def train(docs: DataFrame) -> Trained:
    """Counts tokens and token pairs of all texts (null: empty) and fills the filter."""
    total = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    bits = tk.bucket_bits((total[0] or 0) // 6, 1_500_000)
    per_entry, probes = shape((total[0] or 0) // 2)  # there are no more types than that
    merged = materialize(merge_buckets(count_blocks(docs, bits), bits, per_entry, probes), "lm-pairs")
    finished = materialize(finish_words(merged), "lm-words")

    def sums(batches):
        for b in batches:
            parts = [tk.unpack(v.as_py(), ("u8", "u8", "f8")) for v in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(p[0]) for p in parts)], pa.int64()), pa.array([sum(int(p[1].sum()) for p in parts)], pa.int64())], ["v", "n"])

    v, n = (x or 0 for x in finished.filter("kind = 0").select("value").mapInArrow(sums, "v long, n long").agg(F.sum("v"), F.sum("n")).first())
    once = (finished.filter("kind = 5").agg(F.sum(F.octet_length("value"))).first()[0] or 0) // 8
    size = merged.filter("kind = 2").agg(F.sum(F.octet_length("value"))).first()[0]
    start = sum(float(tk.unpack(bytes(r[0]), ("f8",))[0][0]) for r in finished.filter("kind = 4").select("value").collect())  # one row
    return Trained(merged, finished, bits, int(n) + once, int(v) + once, int(total[1]), int(size or 0), probes, start, once)


def _parts(df: DataFrame) -> dict[int, np.ndarray]:
    """Values by bucket, a partition at a time; callers check the size first."""
    return {r[0]: np.frombuffer(bytes(r[1]), np.uint8) for r in df.select("bucket", "value").toLocalIterator()}


def filter_arrays(df: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of each bucket's part, all parts' bytes and one more) of a filter."""
    parts = _parts(df)
    sizes = np.array([len(parts.get(b, ())) for b in range(1 << bits)], np.int64)
    return sizes, np.concatenate([*(parts[b] for b in sorted(parts)), np.zeros(1, np.uint8)])


def once_words(trained: Trained, first: int, stop: int) -> np.ndarray:
    """Keys in order of the tokens that came once, of the buckets from ``first`` to before ``stop``."""
    parts = _parts(trained.finished.filter((F.col("kind") == 5) & F.col("bucket").between(first, stop - 1)))
    return np.concatenate([np.zeros(0, U), *(tk.unpack(parts.pop(b), ("u8",))[0] for b in sorted(parts))])


def exact_counts(trained: Trained, once: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys in order, their exact counts and what their pairs take, with or without tokens that came once (callers check their number first)."""
    parts = _parts(trained.finished.filter("kind = 0"))
    size = trained.n_types - trained.n_once
    keys, counts, taken = np.zeros(size, U), np.zeros(size, np.uint32 if trained.n_tokens < 2**32 else U), np.zeros(size, np.float32)
    at = 0
    for b in sorted(parts):
        k, n, t = tk.unpack(parts.pop(b), ("u8", "u8", "f8"))
        keys[at : at + len(k)], counts[at : at + len(k)], taken[at : at + len(k)] = k, n, t
        at += len(k)
    if not once:
        return keys, counts, taken
    more = once_words(trained, 0, 1 << trained.bits)
    at = np.searchsorted(keys, more)
    return np.insert(keys, at, more), np.insert(counts, at, 1), np.insert(taken, at, 0)


SCORED = "doc_id long, row_key long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, trained: Trained, broadcast_bytes: int = BROADCAST_BYTES, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """doc_id, row_key, n_tokens, n_known, base_score and score of every row.

    A filter within its bound is broadcast; of a larger one the parts are
    broadcast in groups within the bound, and each group gives the sum of the
    tokens whose pairs are its own, so only sums move.  With more tokens than
    are broadcast, those that came once go with these groups.  With more that
    came twice or more nothing is gathered in one place: see _by_shuffle().
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    if trained.n_types - trained.n_once > broadcast_tokens:
        return _by_shuffle(keyed, trained)
    apart = trained.n_types > broadcast_tokens
    exact = docs.sparkSession.sparkContext.broadcast(exact_counts(trained, not apart))
    if trained.filter_bytes + (8 * trained.n_once if apart else 0) <= broadcast_bytes:
        return _by_group(keyed, trained, exact, 0, 1 << trained.bits, apart)
    held_by = trained.merged.filter("kind = 2").select("bucket", F.octet_length("value").alias("_n"))
    if apart:
        held_by = held_by.unionByName(trained.finished.filter("kind = 5").select("bucket", F.octet_length("value").alias("_n")))
    sizes = {r[0]: r[1] for r in held_by.groupBy("bucket").agg(F.sum("_n")).collect()}
    firsts, held = [0], 0
    for b in range(1 << trained.bits):
        if held and held + sizes.get(b, 0) > broadcast_bytes:
            firsts.append(b)
            held = 0
        held += sizes.get(b, 0)
    sums = [materialize(_by_group(keyed, trained, exact, a, z, apart), "lm-sums") for a, z in zip(firsts, [*firsts[1:], 1 << trained.bits])]
    every = reduce(DataFrame.unionByName, sums)
    # Rows alike in id and text are summed together: each has its share, as all are equal.
    c = F.col("_rows") / len(sums)
    added = every.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    whole = [(F.col(x) / c).cast("long").alias(x) for x in ("n_tokens", "n_known")]
    return added.select("doc_id", "row_key", *whole, (F.col("base_score") / c).alias("base_score"), (F.col("score") / c).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), c.cast("long"))).alias("_copy")).drop("_copy")


def _by_group(keyed: DataFrame, trained: Trained, exact, first: int, stop: int, apart: bool) -> DataFrame:
    """What score() sums over the tokens whose pairs lie in the buckets from ``first`` to before ``stop``.

    Where the tokens that came once are apart, they count as unknown there; the
    group whose buckets have them adds the rest.  No pair of theirs is stored,
    so that is the same for any token before: log10 of (1 + 1) over (0 + 1).
    """
    bits = trained.bits
    pairs = keyed.sparkSession.sparkContext.broadcast(filter_arrays(trained.merged.filter((F.col("kind") == 2) & F.col("bucket").between(first, stop - 1)), bits))
    n, v, n_texts, probes, start = trained.n_tokens, trained.n_types, trained.n_texts, trained.probes, trained.start
    every = (first, stop) == (0, 1 << bits)
    rare = keyed.sparkSession.sparkContext.broadcast(once_words(trained, first, stop) if apart else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*exact.value, LogFrequencyFilter(*pairs.value, bits, probes), n, v, n_texts, start)
        for batch in tk.slices(batches, size=4 << 20):
            doc, key, before = word_keys(tk.split_words(batch.column(2), lower=True))
            m = batch.num_rows
            single = np.zeros(m, np.int64)
            if apart:
                bucket = model.pairs._bucket(key)
                own = (bucket >= first) & (bucket < stop)
                asked = key[own]
                once = of_sorted(rare.value, np.ones(len(rare.value), np.int64), asked)
                single = np.bincount(doc[own], once, m).astype(np.int64)
            if not every:
                bucket = model.pairs._bucket(kind_key("pair", before, key))
                mine = (bucket >= first) & (bucket < stop)
                doc, key, before = doc[mine], key[mine], before[mine]
            logp, c = model.log_probs(key, before)
            score = np.bincount(doc, logp, m).astype(float) + single * np.log10(2.0)
            base = np.bincount(doc, np.log10((c + 1.0) / (n + v + 1.0)), m).astype(float) + single * np.log10(2.0)
            known = np.bincount(doc, c > 0, m).astype(np.int64) + single
            tokens = np.bincount(doc, minlength=m).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "row_key", "n_tokens", "n_known", "base_score", "score"])

    return keyed.mapInArrow(run, SCORED)


def _by_shuffle(keyed: DataFrame, trained: Trained) -> DataFrame:
    """score() for a model of any size: counts meet probes in the bucket of the filter part that has them.

    Each distinct token and each distinct pair is probed once, however many
    texts have it; the probabilities of pairs are then joined with the texts'
    own pairs, where adaptive execution splits the frequent ones.
    """
    bits, n, v, n_texts = trained.bits, trained.n_tokens, trained.n_types, float(max(1, trained.n_texts))
    probes, start = trained.probes, trained.start
    bucket_of = lambda k: (k >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(k), np.int32)
    signed = lambda k: pa.array(k.view(np.int64))

    def pairs_of(batches):
        for batch in tk.slices(batches, size=4 << 20):
            doc, key, before = word_keys(tk.split_words(batch.column(2), lower=True))
            if not len(key):
                continue
            order = np.lexsort((key, before, doc))
            d, b, k = doc[order], before[order], key[order]
            head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1])]))
            m = np.diff(np.concatenate([head, [len(d)]]))
            at = pa.array(d[head])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), signed(b[head]), signed(k[head]), pa.array(m.astype(np.int64))], ["doc_id", "row_key", "before", "token", "m"])

    def probe_words(asked: pa.Table, parts: pa.Table) -> pa.Table:
        """The token's exact count and what its pairs take."""
        k = np.asarray(asked.column("token").combine_chunks()).view(U)
        c, taken = np.zeros(len(k), np.int64), np.zeros(len(k))
        for kind, value in zip(parts.column("kind").to_pylist() if parts.num_rows else [], parts.column("value") if parts.num_rows else []):
            if kind == 5:
                keys = tk.unpack(value.as_py(), ("u8",))[0]
                c += of_sorted(keys, np.ones(len(keys), np.int64), k)
                continue
            keys, counts, sums = tk.unpack(value.as_py(), ("u8", "u8", "f8"))
            c += of_sorted(keys, counts, k).astype(np.int64)
            taken = of_sorted(keys, sums.astype(np.float32), k).astype(float)
        return pa.table([asked.column("token"), pa.array(c), pa.array(taken)], ["token", "c", "taken"])

    def probe_pairs(asked: pa.Table, parts: pa.Table) -> pa.Table:
        k = np.asarray(asked.column("pair").combine_chunks()).view(U)
        out = np.zeros(len(k), np.int64)
        for value in parts.column("value"):
            out = _one_part(value.as_py(), probes)._probe(k, np.zeros(len(k), np.int64))
        return pa.table([asked.column("pair"), pa.array(out)], ["pair", "level"])

    def with_bucket(batches):
        for batch in batches:
            k = np.asarray(batch.column(0)).view(U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bucket_of(k))], [batch.schema.names[0], "bucket"])

    def with_pair(batches):
        for batch in batches:
            b, k = (np.asarray(batch.column(i)).view(U) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(kind_key("pair", b, k))], ["before", "token", "pair"])

    def probability(batches):
        for batch in batches:
            before = np.asarray(batch.column(0)).view(U)
            c, ch, sh = (np.asarray(batch.column(i), np.float64) for i in range(2, 5))
            ch, sh = np.where(before == START, n_texts, ch), np.where(before == START, start, sh)
            level = np.asarray(batch.column(5), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log_prob(c, ch, sh, level, n, v))], ["before", "token", "logp"])

    own = materialize(keyed.mapInArrow(pairs_of, "doc_id long, row_key long, before long, token long, m long"), "lm-probes")
    distinct = own.select("before", "token").distinct().mapInArrow(with_pair, "before long, token long, pair long")
    distinct = materialize(distinct, "lm-distinct")
    asked = distinct.select("token").unionByName(distinct.select(F.col("before").alias("token"))).distinct().mapInArrow(with_bucket, "token long, bucket int")
    words = asked.groupBy("bucket").cogroup(trained.finished.filter("kind in (0, 5)").groupBy("bucket")).applyInArrow(probe_words, "token long, c long, taken double")
    words = materialize(words, "lm-counts")
    pairs = distinct.select("pair").distinct().mapInArrow(with_bucket, "pair long, bucket int")
    pairs = pairs.groupBy("bucket").cogroup(trained.merged.filter("kind = 2").groupBy("bucket")).applyInArrow(probe_pairs, "pair long, level long")
    first = words.select(F.col("token").alias("before"), F.col("c").alias("ch"), F.col("taken").alias("sh"))
    counts = distinct.join(pairs, "pair").join(words.select("token", "c"), "token").join(first, "before")
    logp = counts.select("before", "token", "c", "ch", "sh", "level").mapInArrow(probability, "before long, token long, logp double")
    base = words.select("token", "c", F.log10((F.col("c") + 1.0) / F.lit(n + v + 1.0)).alias("logb"))
    m = F.col("m")
    sums = own.join(logp.join(base, "token"), ["before", "token"]).groupBy("doc_id", "row_key").agg(
        F.sum("m").alias("n_tokens"), F.sum(F.when(F.col("c") > 0, m).otherwise(0)).alias("n_known"), F.sum(m * F.col("logb")).alias("base_score"), F.sum(m * F.col("logp")).alias("score")
    )
    # Rows alike in id and text are summed together: each has its share, as all are equal.
    copies = keyed.groupBy(F.col("doc_id").alias("c_id"), F.col("row_key").alias("c_key")).agg(F.count(F.lit(1)).alias("copies"))
    both = sums.join(copies, (F.col("row_key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")))
    c = F.col("copies")
    whole = lambda x: (F.col(x) / c).cast("long").alias(x)
    return both.select("doc_id", "row_key", whole("n_tokens"), whole("n_known"), (F.col("base_score") / c).alias("base_score"), (F.col("score") / c).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), c)).alias("_copy")).drop("_copy")


def _one_part(value: bytes, probes: int) -> LogFrequencyFilter:
    """A single part of a filter, as bucket 0."""
    data = np.frombuffer(bytes(value), np.uint8)
    return LogFrequencyFilter(np.array([len(data)], np.int64), np.concatenate([data, np.zeros(1, np.uint8)]), 0, probes)


def report(docs: DataFrame, held_out: int = 2, folds: int = 7, **limits) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose crc32(doc_id) modulo ``folds`` is not
    ``held_out``.  A null text is an empty one and scores its end token only; a
    long text is scored whole, in slices of words.  Repeated rows score alike,
    each with a row of its own, and ties can't occur.  Extra columns are not
    read, whatever their names.  An empty table gives no rows, and a table
    without training rows scores every token as unknown.
    """
    fold = crc_mod(F.col("doc_id"), folds)
    trained = train(docs.filter(fold != held_out).select("text"))
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        scored = materialize(score(docs, trained, **limits), "lm-scores")
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(trained.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
