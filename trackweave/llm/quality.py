"""Quality rules combined by weak supervision (built-in functions only).

Each rule votes good, bad or abstains.  Expectation-maximisation over the
counts of vote patterns estimates how far each rule can be trusted, and a
document stays if its posterior probability of being good is at least one half.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

#: Bits for a word's place in the packed window keys: texts of up to 2**27 words.
PLACE_BITS = 27


def _count(text: Column, pattern: str) -> Column:
    """Number of characters of a class: the pieces between them, less one."""
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def _repeated_places(w: Column, shift) -> Column:
    """Places of 3-word windows whose key occurs twice or more.

    The key is a part of the window's hash with the place in the low bits, so
    one sort of longs brings equal windows together.
    """
    top = F.greatest(F.size(w) - 3, F.lit(0))
    keys = F.transform(
        F.sequence(F.lit(0), top),
        lambda i: F.shiftleft(shift(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), PLACE_BITS).bitwiseOR(i.cast("long")),
    )
    ordered = F.sort_array(keys)
    part = lambda x: F.shiftrightunsigned(x, PLACE_BITS)
    return ordered, part


def features(docs: DataFrame) -> DataFrame:
    """Counts per document that the rules read.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_upper, n_marks, n_bare (words without a letter), n_odd (words
    that end in two signs or more).  A null text is an empty one.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", t.alias("t"), words(t).alias("w"))
    base = base.select("doc_id", "t", "w", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    w = F.col("w")
    # Two independent parts of the hash: a window counts only if both say so.
    sorted_a, part = _repeated_places(w, lambda h: h)
    sorted_b, _ = _repeated_places(w, lambda h: F.shiftrightunsigned(h, PLACE_BITS))

    def places(col: Column) -> Column:
        twice = F.filter(col, lambda x, i: (part(x) == part(F.get(col, i + 1))) | ((i > 0) & (part(x) == part(F.get(col, i - 1)))))
        return F.transform(twice, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))

    base = base.withColumn("a", sorted_a).withColumn("a", places(F.col("a")))
    none = F.array().cast("array<bigint>")
    base = base.withColumn("b", F.when((F.size("w") >= 3) & (F.size("a") > 0), sorted_b).otherwise(none)).withColumn("b", places(F.col("b")))
    both = F.array_intersect("a", "b")
    base = base.withColumn("p", F.when(F.size("w") >= 3, both).otherwise(none))
    covered = F.size(F.array_distinct(F.flatten(F.array(F.col("p"), F.transform("p", lambda x: x + 1), F.transform("p", lambda x: x + 2)))))
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("t"), r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count(F.col("t"), r"\p{Lu}").alias("n_upper"),
        _count(F.col("t"), r"[!?]").alias("n_marks"),
        _count(F.array_join("w", "\n"), r"(?m)^[^\p{L}\n]+$").alias("n_bare"),
        _count(F.col("t"), r"[\p{P}\p{S}]{2,}(?=[\x20\x09-\x0D]|\z)").alias("n_odd"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad above (or below) one bound, good on the far side of the other, else abstains."""

    name: str
    value: Column
    good: Column
    bad: Column


def rules() -> list[Rule]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def high_is_bad(name: str, value: Column, good: float, bad: float) -> Rule:
        return Rule(name, value, value <= good, value > bad)

    length = F.col("word_chars") / n
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return [
        Rule("words", n, F.col("n_words") >= 60, F.col("n_words") < 20),
        Rule("word_length", length, length.between(2.5, 12.0), (length < 1.8) | (length > 20.0)),
        high_is_bad("symbols", F.col("n_symbols") / n, 0.05, 0.2),
        high_is_bad("dup_lines", F.col("n_dup_lines") / lines, 0.15, 0.4),
        high_is_bad("repeats", F.col("n_repeat_words") / n, 0.2, 0.4),
        high_is_bad("capitals", F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), 0.15, 0.4),
        high_is_bad("marks", F.col("n_marks") / n, 0.1, 0.3),
        high_is_bad("bare_words", F.col("n_bare") / n, 0.15, 0.3),
        high_is_bad("odd_ends", F.col("n_odd") / n, 0.05, 0.2),
    ]


def votes(feats: DataFrame) -> DataFrame:
    """Adds v0..vk: 1 good, -1 bad, 0 abstains."""
    return feats.withColumns({f"v{i}": F.when(r.bad, -1).when(r.good, 1).otherwise(0) for i, r in enumerate(rules())})


@dataclass(frozen=True)
class VoteModel:
    """prior of good; per rule P(votes good | good) and P(votes bad | bad), given a vote."""

    prior: float
    when_good: tuple[float, ...]
    when_bad: tuple[float, ...]

    def log_odds(self, pattern) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(pattern, self.when_good, self.when_bad, strict=True):
            if v:
                odds += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b)
        return odds


#: Weight of the belief about rules, as a share of all documents, so that it weighs the same at every size.
BELIEF = 0.02
#: The belief: share of good documents; of good votes about good ones; of bad votes about bad ones.
BELIEVED = (0.9, 0.99, 0.3)
#: P(good) at the start by the number of bad votes: none, one, more.
START = (0.95, 0.5, 0.05)


def fit(counts: list[tuple[tuple[int, ...], int]], steps: int = 200) -> VoteModel:
    """EM over (pattern, number of documents); at most 3**rules patterns.

    Starts from the number of bad votes: a single one tells nothing yet, and
    those that agree with others gain weight.  Only shares of documents enter,
    so a corpus of any size with the same shares has the same model.  Without
    documents the belief is returned.
    """
    k = len(counts[0][0]) if counts else len(rules())
    total = float(sum(n for _, n in counts))
    prior, when_good, when_bad = BELIEVED
    model = VoteModel(prior, (when_good,) * k, (when_bad,) * k)
    for step in range(steps if total else 0):
        good = bad = 0.0
        gg, gn, bb, bn = [0.0] * k, [0.0] * k, [0.0] * k, [0.0] * k
        for pattern, n in counts:
            if step:
                odds = model.log_odds(pattern)
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            else:
                p = START[min(2, sum(v < 0 for v in pattern))]
            share = n / total
            good += p * share
            bad += (1 - p) * share
            for i, v in enumerate(pattern):
                if v:
                    gn[i] += p * share
                    bn[i] += (1 - p) * share
                    gg[i] += p * share * (v > 0)
                    bb[i] += (1 - p) * share * (v < 0)
        new = VoteModel(
            (good + BELIEF * prior) / (1 + BELIEF),
            tuple((a + BELIEF * when_good) / (c + BELIEF) for a, c in zip(gg, gn, strict=True)),
            tuple((a + BELIEF * when_bad) / (c + BELIEF) for a, c in zip(bb, bn, strict=True)),
        )
        moved = max(abs(x - y) for x, y in zip((new.prior, *new.when_good, *new.when_bad), (model.prior, *model.when_good, *model.when_bad), strict=True))
        model = new
        if moved < 1e-9:
            break
    return model


def fit_votes(voted: DataFrame) -> VoteModel:
    """The model from the counts of vote patterns over all documents."""
    names = [f"v{i}" for i in range(len(rules()))]
    rows = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # 3**rules rows at most
    return fit(sorted((tuple(r[:-1]), r[-1]) for r in rows))


def posterior(model: VoteModel) -> Column:
    """P(good | votes) as a column over v0..vk."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for i, (g, b) in enumerate(zip(model.when_good, model.when_bad, strict=True)):
        v = F.col(f"v{i}")
        odds = odds + F.when(v > 0, F.lit(math.log(g / (1 - b)))).when(v < 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def score(docs: DataFrame) -> DataFrame:
    """Features, votes, p_good, base_failed and kept for every row.

    Null and empty texts have no words and fail the base rules.  Ties (a
    posterior of one half) are kept; repeated rows are judged alike, each with a
    row of its own, and count as often in the model.  Long texts are read whole
    (up to 2**27 words).  Extra columns are not read; an empty table gives no
    rows.
    """
    voted = materialize(votes(features(docs)), "quality")
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return voted.withColumn("p_good", posterior(fit_votes(voted))).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def report(docs: DataFrame) -> DataFrame:
    """The digest of score() for every row; cases as there."""
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns unchanged.

    Rows and their votes are written to the shared folder once; the model is
    fitted on the votes and the verdict read off beside each row.  Cases as in
    score(): null and empty texts go, repeated rows stay or go together, columns
    may have any name, and an empty table gives no rows.
    """
    cols = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc_id"), "text")
    voted = materialize(votes(features(tagged)), "quality")
    n = F.col("n_words")
    kept = (n >= 50) & (100 * F.col("n_repeat_words") <= 50 * n) & (posterior(fit_votes(voted)) >= 0.5)
    return voted.filter(kept).select("doc_id.*")
