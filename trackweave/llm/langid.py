"""Language identification of whole texts and of spans of mixed texts.

The script of a word narrows its candidate languages; each word gets a score
per candidate from character n-grams; and a Viterbi pass with a penalty for
switching labels the words, so that a mixed text falls into spans.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import crc_mod
from .tokens import U

#: Hashed n-gram features per order and language.
FEATURES = 1 << 15
#: Orders of the byte n-grams of a word with a mark on each side.
ORDERS = (2, 3, 4)
#: Cost, in natural log units, of a change of language between two words.
SWITCH = 6.0
#: Bound of a word's score, so that one odd word does not open a span.
WORD_BOUND = 12.0
#: Languages that can be learned: one table of features each is broadcast.
MOST_LANGUAGES = 256
#: A script serves a language if so large a share of the language's lettered words is in it.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"

#: Script blocks by first and last code point (public Unicode block ranges).
SCRIPTS: dict[str, tuple[tuple[int, int], ...]] = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
#: Letters of blocks not listed count as one more script.
_NAMES = ["none", *SCRIPTS, "other"]


def _lead_table() -> np.ndarray:
    """Script number by the first two bytes of a character (1-byte characters: any second byte)."""
    table = np.zeros((256, 256), np.uint8)
    for number, name in enumerate(SCRIPTS, 1):
        for lo, hi in SCRIPTS[name]:
            for cp in range(lo, hi + 1, 1 if lo < 0x800 else 32):
                b = chr(cp).encode()
                if len(b) == 1:
                    table[b[0], :] = number
                else:
                    table[b[0], b[1]] = number
    return table


_LEAD = _lead_table()
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter, by the rule of has_letter()."""
    table = np.zeros(0x110000, bool)
    for m in re.finditer(_LETTER.pattern + "+", "".join(map(chr, range(0x110000)))):
        table[m.start() : m.end()] = True
    return table


def _other_letters(data: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Places of the letters beyond ASCII whose script ``s`` is none."""
    lead = np.flatnonzero((data >= 0xC2) & (s == 0))
    if not len(lead):
        return lead
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    b = [padded[lead + k].astype(np.int64) for k in range(4)]
    size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    cp = b[0] & (0xFF >> (size + 1))
    for k in range(1, 4):
        cp = np.where(size > k, cp << 6 | b[k] & 0x3F, cp)
    return lead[_letters()[np.minimum(cp, 0x10FFFF)]]


def word_scripts(w: tk.Words) -> np.ndarray:
    """Script number of each word: that of its first lettered character, 0 for none."""
    nxt = np.concatenate([w.data[1:], [0]]).astype(np.uint8)
    s = _LEAD[w.data, nxt]
    s[_other_letters(w.data, s)] = len(_NAMES) - 1
    hit = np.flatnonzero(s)
    if not len(hit):
        return np.zeros(len(w.start), np.uint8)
    at = np.searchsorted(hit, w.start)
    ok = (at < len(hit)) & (hit[np.minimum(at, len(hit) - 1)] < w.end)
    return np.where(ok, s[hit[np.minimum(at, len(hit) - 1)]], 0).astype(np.uint8)


def grams(w: tk.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, word of the gram, feature) for the byte n-grams of all words."""
    n = len(w.start)
    if not n:
        return
    size = w.end - w.start + 2
    first = np.cumsum(size) - size
    total = int(size.sum())
    word = np.repeat(np.arange(n), size)
    at = np.arange(total) - first[word]
    b = w.data[np.clip(w.start[word] + at - 1, 0, len(w.data) - 1)]
    b[(at == 0) | (at == size[word] - 1)] = 32
    x = b.astype(np.uint32)
    for k in ORDERS:
        if total < k:
            continue
        h = x[: total - k + 1].copy()
        for j in range(1, k):
            h = h * np.uint32(0x01000193) ^ x[j : total - k + 1 + j] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        inside = at[: total - k + 1] + k <= size[word[: total - k + 1]]
        yield k, word[: total - k + 1][inside], (h[inside] % np.uint32(FEATURES)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # orders x features x languages, log ratios against the mean language
    allowed: np.ndarray  # scripts x languages


def _words(texts: pa.Array) -> tk.Words:
    w = tk.split_words(texts)
    w.data = _FOLD[w.data]
    return w


def train(rows: DataFrame, sample_rows: int | None = None) -> Model:
    """Learns from (text, lang); rows without a text or a language teach nothing.

    Feature counts are summed on the workers and come to the driver as one
    table per language, of fixed size.  At most MOST_LANGUAGES languages.
    """
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    if sample_rows is not None:
        rows = rows.limit(sample_rows)
    width = len(ORDERS) * FEATURES + len(_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in tk.slices(batches, size=2 << 20):
            lang = pc.dictionary_encode(batch.column(1))
            names, code = lang.dictionary.to_pylist(), np.asarray(lang.indices)
            w = _words(batch.column(0))
            per_word = code[w.doc]
            n = len(names)
            out = np.zeros((n, width), np.int64)
            for o, (_, word, feature) in enumerate(grams(w)):
                flat = np.bincount(per_word[word] * FEATURES + feature, minlength=n * FEATURES)
                out[:, o * FEATURES : (o + 1) * FEATURES] += flat.reshape(n, FEATURES)
            s = np.bincount(per_word * len(_NAMES) + word_scripts(w), minlength=n * len(_NAMES))
            out[:, len(ORDERS) * FEATURES :] += s.reshape(n, len(_NAMES))
            for name, v in zip(names, out, strict=True):
                sums[name] = sums[name] + v if name in sums else v
        for name, v in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tobytes()], pa.binary())], ["lang", "value"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py(), np.int64) for v in table.column("value")], axis=0)
        return pa.table([table.column("lang").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["lang", "value"])

    parts = rows.mapInArrow(run, "lang string, value binary")
    sums = parts.groupBy("lang").applyInArrow(add, "lang string, value binary")
    found = sorted((r[0], np.frombuffer(bytes(r[1]), np.int64)) for r in sums.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = [x[0] for x in found]
    if not langs:
        return Model([], np.zeros((len(ORDERS), FEATURES, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    counts = np.stack([x[1][: len(ORDERS) * FEATURES] for x in found]).reshape(len(langs), len(ORDERS), FEATURES).astype(np.float64) + 0.5
    logp = np.log(counts / counts.sum(2, keepdims=True))
    logp -= logp.mean(0, keepdims=True)
    script = np.stack([x[1][len(ORDERS) * FEATURES :] for x in found]).astype(np.float64)
    lettered = np.maximum(script[:, 1:].sum(1, keepdims=True), 1)
    allowed = (script / lettered >= SCRIPT_SHARE).T
    allowed[0] = allowed[-1] = True  # other letters are of many scripts, and of signs like µ: the n-grams tell
    allowed[~allowed.any(1)] = True  # a script that nothing was learned from narrows nothing
    return Model(langs, np.ascontiguousarray(logp.transpose(1, 2, 0)).astype(np.float32), allowed)


def word_scores(w: tk.Words, model: Model) -> np.ndarray:
    """Score of every word and language: bounded sums of log ratios; barred scripts at the bound below."""
    n, k = len(w.start), len(model.langs)
    out = np.zeros((n, k), np.float32)
    for o, (_, word, feature) in enumerate(grams(w)):
        for j in range(k):
            out[:, j] += np.bincount(word, model.scores[o, :, j][feature], n)
    out /= len(ORDERS)
    out -= out.max(1, keepdims=True) if n else 0
    script = word_scripts(w)
    out[script == 0] = 0  # numbers and signs say nothing
    np.maximum(out, -WORD_BOUND, out=out)
    out[~model.allowed[script]] = -2 * WORD_BOUND
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; texts are the runs between ``first`` bounds.

    All texts of a batch advance together, longest first; one step costs the
    number of texts still running.
    """
    n_docs = len(first) - 1
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    start, lens = first[:-1][order], lens[order]
    k = scores.shape[1]
    label = np.zeros(len(scores), np.int16)
    if not len(scores) or not k:
        return label
    came = np.zeros(scores.shape, np.int8 if k < 128 else np.int16)
    live = int((lens > 0).sum())
    best = scores[start[:live]].astype(np.float64)
    for t in range(1, int(lens[0]) if n_docs else 0):
        live = int(np.searchsorted(-lens, -t, "left"))
        best = best[:live]
        top = best.argmax(1)
        other = best[np.arange(live), top] - switch
        stay = best >= other[:, None]
        came[start[:live] + t] = np.where(stay, np.arange(k)[None, :], top[:, None])
        best_next = np.where(stay, best, other[:, None]) + scores[start[:live] + t]
        ends = np.flatnonzero(lens[:live] == t + 1)
        label[start[ends] + t] = best_next[ends].argmax(1)
        best = best_next
    ones = np.flatnonzero(lens == 1)
    label[start[ones]] = scores[start[ones]].argmax(1)
    for t in range(int(lens[0]) - 1 if n_docs else 0, 0, -1):
        live = int(np.searchsorted(-lens, -t, "left"))
        at = start[:live] + t
        label[at - 1] = came[at, label[at]]
    return label


def _labelled(texts: pa.Array, model: Model) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    w = _words(texts)
    scores = word_scores(w, model)
    return w, scores, viterbi(scores, w.first)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, second_lang of every row.

    lang_pred: the language with the most bytes of lettered words in the
    labelled spans; ties go to the better total score, then to the first by
    name.  score: its share of those bytes.  Texts that are null or have no
    letter are ``und`` with score 0, and so is every text when nothing was
    learned.  second_lang: the next language where a text is mixed, else null.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores, model.allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        k = len(m.langs)
        for batch in tk.slices(batches, size=4 << 20):
            n = batch.num_rows
            texts = batch.column(1)
            letters = np.array([has_letter(t) for t in texts.to_pylist()], bool)
            pred, second, score = [UNKNOWN] * n, [None] * n, np.zeros(n)
            if k:
                w, scores, label = _labelled(texts, m)
                size = np.where(word_scripts(w) > 0, w.end - w.start, 0)
                weight = np.bincount(w.doc * k + label, size, n * k).reshape(n, k)
                total = np.stack([np.bincount(w.doc, scores[:, j], n) for j in range(k)], 1)
                rank = np.lexsort((np.broadcast_to(np.arange(k), (n, k)), -total, -weight), axis=1)
                all_bytes = weight.sum(1)
                for i in np.flatnonzero(letters):
                    a = rank[i, 0]
                    pred[i] = m.langs[a]
                    score[i] = weight[i, a] / all_bytes[i] if all_bytes[i] else 1.0 / k
                    if k > 1 and weight[i, rank[i, 1]] > 0:
                        second[i] = m.langs[rank[i, 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score), pa.array(second, pa.string())], ["doc_id", "lang_pred", "score", "second_lang"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, second_lang string")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, n_words, lang: the labelled spans of every text, in words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores, model.allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in tk.slices(batches, size=4 << 20):
            if not m.langs:
                continue
            w, _, label = _labelled(batch.column(1), m)
            if not len(label):
                continue
            head = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])]))
            size = np.diff(np.concatenate([head, [len(label)]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(w.doc[head])), pa.array(head - w.first[w.doc[head]]), pa.array(size), pa.array([m.langs[i] for i in label[head]])], ["doc_id", "start", "n_words", "lang"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, n_words long, lang string")


def report(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, second_lang; learns from the other folds only.

    Null texts and texts without a letter (empty ones too) are ``und`` with
    score 0; a long text is labelled whole, in slices.  Ties go to the better
    total score, then to the first name; repeated rows are judged alike, each
    with a row of its own.  Extra columns are not read; an empty table gives no
    rows, and without a labelled row every text is ``und``.
    """
    fold = crc_mod(F.col("doc_id"), folds)
    model = train(docs.filter(fold != held_out))
    return predict(docs, model).select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score", "second_lang")
