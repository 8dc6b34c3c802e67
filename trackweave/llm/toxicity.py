"""Toxicity scores from a lexicon that tolerates misspellings.

A lexicon of terms and word beginnings is learned from labelled texts and kept
as a trie.  A Levenshtein automaton of each word is run along the trie, so a
word counts as a term if one edit makes it one.  The words around a hit then
tell quotation from abuse: their learned weights raise or lower its score.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import crc_mod
from .tokens import U

#: Labelled rows that the lexicon and weights are fitted on: a bounded sample, smallest hash of the id first.
TRAIN_ROWS = 8_000
#: Terms that the lexicon may hold.
MOST_TERMS = 2000
#: Texts of the positive class that a term must stand in, and its least precision.
SUPPORT, PRECISION = 8, 0.8
#: Shortest beginning of a word that can be a term, and shortest term that may be misspelled.
PREFIX, FUZZY = 5, 5
#: Words on each side of a hit that are its context.
CONTEXT = 3

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = frozenset("\"'“”„«»")


#: Words that a quotation may have after its mark; one that isn't closed ends there.
QUOTED = 12


def text_words(text: str | None) -> list[tuple[str, bool]]:
    """(lower-cased word, stands in a quotation) of a text.

    A mark opens a quotation before a word and no letter, and closes it after
    one; an apostrophe inside a word does neither.
    """
    text = text or ""
    out, opened = [], None
    for i, m in enumerate(_WORD.finditer(text)):
        a, z = m.start(), m.end()
        if a and text[a - 1] in _QUOTES and not (a > 1 and _WORD.match(text[a - 2])):
            opened = i
        out.append((m.group().lower(), opened is not None and i - opened < QUOTED))
        if z < len(text) and text[z] in _QUOTES and not (z + 1 < len(text) and _WORD.match(text[z + 1])):
            opened = None
    return out


@dataclass
class Trie:
    """Terms as nested nodes; a term that ends in * accepts every longer word.

    The forms of an open term are full words that it covers; misspelled ones are its misspellings.
    """

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    term: list[tuple[int, bool]] = field(default_factory=lambda: [(-1, False)])
    form: list[int] = field(default_factory=lambda: [-1])  # term that the node's full word may be a misspelling of

    def add(self, word: str, number: int) -> None:
        open_end = word.endswith("*")
        node = self._node(word.rstrip("*"))
        if self.term[node][0] < 0:
            self.term[node] = (number, open_end)
        if not open_end:
            self.add_form(word, number)

    def add_form(self, word: str, number: int) -> None:
        node = self._node(word)
        if len(word) >= FUZZY and (self.form[node] < 0 or number < self.form[node]):
            self.form[node] = number

    def _node(self, word: str) -> int:
        node = 0
        for c in word:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.term.append((-1, False))
                self.form.append(-1)
            node = self.next[node][c]
        return node

    def find(self, word: str, edits: int = 1) -> tuple[int, int]:
        """(term, edits) of the closest term, (-1, 0) if none is within reach.

        The word's Levenshtein automaton is stepped along the trie from its
        root: a state is a node, a place in the word and the edits so far.
        Fewer edits win, then lower terms.  Terms of fewer than FUZZY letters
        must match exactly; an open term is misspelled in its forms.
        """
        exact = self._exact(word)
        if exact >= 0 or edits == 0 or len(word) < FUZZY - 1:
            return (exact, 0)
        best = (edits + 1, -1)
        n = len(word)
        stack = [(0, 0, 0)]
        while stack:
            node, i, cost = stack.pop()
            if i == n and self.form[node] >= 0:
                best = min(best, (cost, self.form[node]))
            if cost < edits:
                if i < n:
                    stack.append((node, i + 1, cost + 1))
                for c, child in self.next[node].items():
                    stack.append((child, i, cost + 1))
                    if i < n and word[i] != c:
                        stack.append((child, i + 1, cost + 1))
            if i < n and word[i] in self.next[node]:
                stack.append((self.next[node][word[i]], i + 1, cost))
        return (best[1], best[0]) if best[1] >= 0 else (-1, 0)

    def _exact(self, word: str) -> int:
        node, found = 0, -1
        for i, c in enumerate(word):
            node = self.next[node].get(c, -1)
            if node < 0:
                return found
            number, open_end = self.term[node]
            if number >= 0 and (open_end or i == len(word) - 1):
                return number
        return found


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    fuzzy: list[float]  # weights of misspellings
    context: dict[str, float]
    bias: float
    forms: dict[str, int] = field(default_factory=dict)  # full words of toxic texts that an open term covers, and its number

    def trie(self) -> Trie:
        t = Trie()
        for i, w in enumerate(self.terms):
            t.add(w, i)
        for w, i in self.forms.items():
            t.add_form(w, i)
        return t


def _stems(word: str) -> list[str]:
    return [word[:k] + "*" for k in range(PREFIX, min(len(word), 8))]


def _copies(texts: list[str | None]) -> list[int]:
    """A number per text that near copies share: texts with a common smallest 3-word hash, in any of four hashings."""
    owner: dict[tuple[int, int], int] = {}
    group = list(range(len(texts)))

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, text in enumerate(texts):
        words = text_words(text)
        if len(words) < 3:
            continue
        grams = np.array([zlib.crc32(f"{a[0]} {b[0]} {c[0]}".encode()) for a, b, c in zip(words, words[1:], words[2:], strict=False)], U)
        for k in range(4):
            key = (k, int(tk.keyed(grams, 700 + k).min()))
            j = top(owner.setdefault(key, i))
            group[max(j, top(i))] = min(j, top(i))
    return [top(i) for i in range(len(texts))]


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """The model from (text, toxic) rows.

    Terms are words, and beginnings of words, that stand in SUPPORT groups of
    toxic texts or more and seldom in others; near copies are one group.  A
    beginning is taken only if several words share it, and a word only if no
    term covers it; the words that a beginning covers are kept as its forms.  Weights are smoothed log odds.  With one class only, or no
    rows, the share of toxic rows is scored.
    """
    group = _copies([text for text, _ in rows])
    n = [0, 0]
    inside: dict[str, set[int]] = {}
    for (text, label), g in zip(rows, group, strict=True):  # texts are split anew in each pass, not kept split
        n[label] += 1
        if label:
            for w in {w for w, _ in text_words(text)}:
                inside.setdefault(w, set()).add(g)
    beginnings: dict[str, list[str]] = {}
    for w in inside:
        for f in _stems(w):
            beginnings.setdefault(f, []).append(w)
    groups = {w: gs for w, gs in inside.items() if len(gs) >= SUPPORT}
    for f, ws in beginnings.items():
        gs = set().union(*(inside[w] for w in ws))
        if len(gs) >= SUPPORT and len(ws) >= 3:
            groups[f] = gs
    outside: dict[str, set[int]] = {f: set() for f in groups}
    for (text, label), g in zip(rows, group, strict=True):
        if not label:
            for w in {w for w, quoted in text_words(text) if not quoted}:  # a clean text that quotes a word says nothing against it
                for f in (w, *_stems(w)):
                    if f in outside:
                        outside[f].add(g)
    good = {}
    for f, gs in groups.items():
        k, m = len(gs), len(outside[f] - gs)
        if k / (k + m) >= PRECISION:
            good[f] = math.log((k + 0.5) / (n[1] + 1)) - math.log((m + 0.5) / (n[0] + 1))
    chosen: list[str] = []
    stems: set[str] = set()
    for f in sorted(good, key=lambda f: (not f.endswith("*"), len(f), f)):
        if not any(f[:k] in stems for k in range(PREFIX, len(f.rstrip("*")) + 1)):
            chosen.append(f)
            if f.endswith("*"):
                stems.add(f[:-1])
    chosen = sorted(chosen, key=lambda f: (-good[f], f))[:MOST_TERMS]
    prior = math.log((n[1] + 1) / (n[0] + 1))
    weights = [good[f] for f in chosen]
    number = {f: i for i, f in enumerate(chosen)}
    forms = {w: min(number[f] for f in beginning) for w in inside if (beginning := [w[:k] + "*" for k in range(PREFIX, len(w) + 1) if w[:k] + "*" in number])}
    return Model(chosen, weights, _fuzzy(rows, group, chosen, weights, n, forms), _context(rows, chosen, weights, n), prior, forms)


def _fuzzy(rows, group, terms: list[str], weights: list[float], n: list[int], forms: dict[str, int]) -> list[float]:
    """Weight of each term's misspellings: log odds of the words that one edit makes the term.

    Pulled towards the term's own weight less a charge, as if seen in one toxic text.
    """
    trie = Model(terms, weights, [], {}, 0.0, forms).trie()
    found: list[tuple[set[int], set[int]]] = [(set(), set()) for _ in terms]
    for (text, label), g in zip(rows, group, strict=True):
        for w in {w for w, _ in text_words(text)}:
            term, edits = trie.find(w)
            if term >= 0 and edits:
                found[term][label].add(g)
    out = []
    for (other, toxic), weight in zip(found, weights, strict=True):
        k, m = len(toxic), len(other - toxic)
        own = math.log((k + 1.0) / (n[1] + 1)) - math.log((m + 0.5) / (n[0] + 1))
        out.append(min(weight - 1.0, own))
    return out


def _context(rows, terms: list[str], weights: list[float], n: list[int]) -> dict[str, float]:
    """Weights of the words near hits, and of quotation, by the label of the text.

    Without hits enough in texts of either class nothing can be told apart and
    no word weighs anything.  Quotation brings a term of the usual weight down
    (or up) to the log odds of texts with a quoted hit.
    """
    exact, stems = {t for t in terms if not t.endswith("*")}, {t for t in terms if t.endswith("*")}
    near, hits, quoting = [Counter(), Counter()], [0, 0], [0, 0]
    for text, label in rows:
        words = text_words(text)
        quotes = False
        for i, (w, quoted) in enumerate(words):
            if w in exact or any(f in stems for f in _stems(w)):
                hits[label] += 1
                quotes = quotes or quoted
                near[label].update(context_words(words, i) - {"<quoted>"})
        quoting[label] += quotes
    out = {}
    if sum(quoting) >= SUPPORT:
        odds = math.log((quoting[1] + 0.5) / (n[1] + 1)) - math.log((quoting[0] + 0.5) / (n[0] + 1))
        out["<quoted>"] = max(-12.0, min(2.0, odds - sum(weights) / len(weights)))
    if min(hits) < 20:
        return out
    share = hits[1] / sum(hits)
    for c in near[0].keys() | near[1].keys():
        if near[0][c] + near[1][c] >= SUPPORT:
            value = math.log((near[1][c] + 10 * share) / (near[0][c] + 10 * (1 - share))) - math.log(share / (1 - share))
            if abs(value) >= 0.7:
                out[c] = max(-2.0, min(2.0, value))
    return out


def context_words(words: list[tuple[str, bool]], i: int) -> set[str]:
    near = {w for w, _ in words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]}
    return near | ({"<quoted>"} if words[i][1] else set())


def odds_of(found: list[float], bias: float) -> float:
    """Probability from a text's hits: its best two, or their absence."""
    odds = bias + sum(sorted(found, reverse=True)[:2]) - (0.0 if found else 1.0)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def hit_value(words: list[tuple[str, bool]], i: int, hit: tuple[int, int], model: Model) -> float:
    """Worth of one hit: the weight of the term or of its misspellings, with its context."""
    value = (model.fuzzy if hit[1] else model.weights)[hit[0]] + sum(model.context.get(c, 0.0) for c in context_words(words, i))
    return value * 0.5 if words[i][1] and "<quoted>" not in model.context else value


#: Bytes that are no part of a word: all ASCII but letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


@functools.cache
def _separators() -> np.ndarray:
    """Whether each code point stands between words, by the rule of text_words()."""
    table = np.ones(0x110000, bool)
    for m in _WORD.finditer("".join(map(chr, range(0x110000)))):
        table[m.start() : m.end()] = False
    return table


def spaced(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of the same length, with blanks for longer characters that are no letters; longer quotation marks begin and end in an ASCII one."""
    out = data.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    marks = [ord(c) for c in _QUOTES if ord(c) > 127]
    for at in range(0, len(data), tk.SPAN):
        lead = at + np.flatnonzero(data[at : at + tk.SPAN] >= 0xC0)
        b = [padded[lead + k].astype(np.int64) for k in range(4)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        cp = b[0] & (0xFF >> (size + 1))
        for k in range(1, 4):
            cp = np.where(size > k, cp << 6 | b[k] & 0x3F, cp)
        between = _separators()[np.minimum(cp, 0x10FFFF)]
        for k in range(4):
            gone = lead[between & (size > k)] + k
            out[gone[gone < len(out)]] = 32
        found = np.isin(cp, marks)
        for at_edge in (lead[found], (lead + size - 1)[found]):
            out[at_edge[at_edge < len(out)]] = 34
    return out


class Scorer:
    """Scores texts by batch: the trie sees each distinct word once."""

    def __init__(self, model: Model):
        self.model, self.trie = model, model.trie()
        self.keys, self.hits = np.zeros(0, U), np.zeros((0, 2), np.int32)

    def lookup(self, w: tk.Words) -> np.ndarray:
        """(term, edits) of every word of a batch."""
        distinct, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        pos = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[pos] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        out = np.full((len(distinct), 2), -1, np.int32)
        out[known] = self.hits[pos[known]]
        new = np.flatnonzero(~known)
        for j in new:
            out[j] = self.trie.find(w.text(at[j]).lower())
        if len(new) and len(self.keys) < 2_000_000:
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.hits = keys[order], np.concatenate([self.hits, out[new]])[order]
        return out[back]

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = tk.as_bytes(texts)
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(spaced(data)))
        w = tk.split_words(texts, separators=NOT_LETTER)
        n = len(w.first) - 1
        out = np.full(n, odds_of([], self.model.bias))
        if not len(w.hash):
            return out
        hit, quoted = self.lookup(w), self._quoted(w)
        found: dict[int, list[float]] = {}
        for i in np.flatnonzero(hit[:, 0] >= 0):
            d = int(w.doc[i])
            lo, hi = max(w.first[d], i - CONTEXT), min(w.first[d + 1], i + CONTEXT + 1)
            near = [(w.text(j).lower(), bool(quoted[j])) for j in range(lo, hi)]
            found.setdefault(d, []).append(hit_value(near, int(i - lo), tuple(hit[i]), self.model))
        for d, values in found.items():
            out[d] = odds_of(values, self.model.bias)
        return out

    @staticmethod
    def _quoted(w: tk.Words) -> np.ndarray:
        """Whether each word stands in a quotation, by the rule of text_words()."""
        mark = np.isin(np.arange(256), [ord(c) for c in _QUOTES if ord(c) < 128])
        n, number = len(w.data), np.arange(len(w.start))
        first, stop = w.first[w.doc], w.first[w.doc + 1]
        lo, hi = w.bounds[w.doc], w.bounds[w.doc + 1]
        is_mark = lambda i: mark[w.data[np.clip(i, 0, n - 1)]] & (i >= lo) & (i < hi)
        # A mark between letters joins them: the word before ends, or the word after begins, right beside it.
        joins_before = (number > first) & (np.concatenate([[-9], w.end[:-1]]) == w.start - 1)
        joins_after = (number + 1 < stop) & (np.concatenate([w.start[1:], [-9]]) == w.end + 1)
        opens = is_mark(w.start - 1) & ~joins_before
        closes = is_mark(w.end) & ~joins_after
        last_open = np.maximum.accumulate(np.where(opens, number, -1))
        last_close = np.concatenate([[-1], np.maximum.accumulate(np.where(closes, number, -1))[:-1]])
        return (last_open >= first) & (number - last_open < QUOTED) & (last_open > last_close)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled rows; rows without a label teach nothing."""
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)
    used = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))  # rows of known: at most ``rows``
    found = used.select("text", "toxic").collect()
    return fit(sorted(((r[0], int(r[1] > 0)) for r in found), key=lambda x: (x[1], x[0] or "")))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row; null and empty texts score by the prior alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.fuzzy, model.context, model.bias, model.forms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in tk.slices(batches, size=4 << 20):
            s = scorer.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from the other folds only.

    Null and empty texts score by the prior alone; a long text is read whole,
    and its best two hits count.  Repeated rows score alike, each with a row of
    its own; a score of one half (a tie) predicts 1.  Labels without a value or
    a document teach nothing, and without labels of both classes the share of
    toxic ones is scored.  Extra columns are not read; an empty table gives no
    rows.
    """
    model = train(docs, labels.filter(crc_mod(F.col("doc_id"), folds) != held_out))
    fold = crc_mod(F.col("doc_id"), folds)
    return predict(docs, model).select("doc_id", (fold == held_out).alias("held_out"), "score", "predicted")
