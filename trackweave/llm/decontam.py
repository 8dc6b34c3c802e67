"""Benchmark decontamination by hashed n-grams (built-in functions only).

Test n-grams are normalised and hashed into a broadcast set.  Every window of
every document is probed; each hit is verified word by word before it counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: Characters that separate normalised words (after lower-casing A-Z).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The window set is broadcast up to so many bytes of words; beyond, it is joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: On the shuffle path each window is met in so many places, so a common one fills no single task.
SALTS = 8
#: Keys of documents to leave out that are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def norm_words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, runs of letters, digits and non-ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def window_hash(words: Column, at: Column, n: int) -> Column:
    """Hash of the n words from ``at``; elements are read in place, never copied."""
    return F.xxhash64(F.lit(1), *[F.get(words, at + F.lit(k)) for k in range(n)])


def windows(words: Column, n: int) -> Column:
    """(at, len, h) of every window of n words."""
    last = F.size(words) - n
    one = lambda i: F.struct(i.cast("int").alias("at"), F.lit(n).alias("len"), window_hash(words, i, n).alias("h"))
    empty = F.array().cast("array<struct<at:int,len:int,h:bigint>>")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(empty)


def item_windows(items: DataFrame, n: int = 10) -> DataFrame:
    """One row per distinct window of the items: its words, hash and item ids.

    An item shorter than n words, but not empty, is one window; items without
    words have none.
    """
    ws = items.select("item_id", norm_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    ws = ws.withColumn("n", F.least(F.size("w"), F.lit(n)))
    each = ws.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.slice(F.col("w"), i + 1, F.col("n")))).alias("b_words"))
    by_len = F.coalesce(*[F.when(F.col("b_len") == k, window_hash(F.col("b_words"), F.lit(0), k)) for k in range(1, n + 1)])
    return (
        each.groupBy("b_words")
        .agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("b_items"))
        .select("b_words", "b_items", F.size("b_words").alias("b_len"))
        .select("*", by_len.alias("b_h"))
    )


def _probe_broadcast(base: DataFrame, grams: DataFrame, lens: list[int]) -> DataFrame:
    """scan() against a broadcast window set: documents are read once and verified in place."""
    marker = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("h")))
    every = reduce(F.concat, [windows(F.col("w"), k) for k in lens], marker)
    rows = base.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "w", every.alias("every"))
    rows = rows.select("doc_id", "text_hash", "n_words", "w", F.inline_outer("every"))  # outer: never empty, and no filter on its size is pushed below the words
    same = (F.col("h") == F.col("b_h")) & (F.slice("w", F.greatest(F.col("at") + 1, F.lit(1)), F.col("len")) == F.col("b_words"))
    hit = F.when(F.col("at") >= 0, F.struct("at", "len"))
    return (
        rows.join(F.broadcast(grams.select("b_h", "b_words", "b_items")), same, "left")
        .filter((F.col("at") < 0) | F.col("b_items").isNotNull())
        .groupBy("doc_id", "text_hash", "n_words")
        .agg(F.count(F.when(F.col("at") < 0, 1)).alias("copies"), F.collect_set(hit).alias("hits"), F.collect_set("b_items").alias("lists"))
    )


def _probe_shuffle(base: DataFrame, grams: DataFrame, lens: list[int]) -> DataFrame:
    """scan() against a window set of any size: hashes meet by shuffle, and those that agree are verified beside the document's words."""
    key = [F.col("doc_id").isNull().alias("d_null"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d_id"), "text_hash"]
    base = base.select("*", *key[:2])
    names = ["d_null", "d_id", "text_hash"]
    each = base.select(*names, F.explode(reduce(F.concat, [windows(F.col("w"), k) for k in lens], F.array().cast("array<struct<at:int,len:int,h:bigint>>"))).alias("x"))
    each = each.select(*names, "x.*", F.pmod(F.xxhash64(*names), F.lit(SALTS)).alias("salt"))
    salted = grams.select(F.col("b_h").alias("h"), F.col("b_len").alias("len"), "b_words", "b_items", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    agree = each.join(salted, ["h", "len", "salt"]).select(*names, "at", "len", "b_words", "b_items")
    texts = base.groupBy(*names).agg(F.first("doc_id").alias("doc_id"), F.first("w").alias("w"), F.count(F.lit(1)).alias("copies"))
    verified = agree.join(texts.select(*names, "w"), names).filter(F.slice("w", F.col("at") + 1, F.col("len")) == F.col("b_words"))
    found = verified.groupBy(*names).agg(F.collect_set(F.struct("at", "len")).alias("hits"), F.collect_set("b_items").alias("lists"))
    none = F.array().cast("array<struct<at:int,len:int>>")
    out = texts.select(*names, "doc_id", "copies", F.size("w").cast("long").alias("n_words")).join(found, names, "left")
    return out.select("doc_id", "text_hash", "n_words", "copies", F.coalesce("hits", none).alias("hits"), F.coalesce("lists", F.array().cast("array<array<string>>")).alias("lists"))


def scan(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, text_hash, copies, n_words, hits, items.

    hits: (at, len) of the windows whose words, not only whose hashes, are an
    item's; items: the ids, as sorted strings, of the items that they come from
    (a null id is the empty string).  Rows alike in id and text are one row
    here, counted by copies.  Null and empty texts have no words and no hits; a
    long text has as many windows as words.  Extra columns are not read.  Empty
    tables give no rows or no hits.
    """
    grams = item_windows(items, n)
    lens = sorted(r[0] for r in grams.select("b_len").distinct().collect())  # n numbers at most
    size = grams.agg(F.sum(F.octet_length(F.array_join("b_words", " ")) + 8 * F.size("b_items"))).first()[0] or 0
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), norm_words(F.col("text")).alias("w"))
    found = (_probe_broadcast if size <= broadcast_bytes else _probe_shuffle)(base, grams, lens)
    return found.select("doc_id", "text_hash", "copies", "n_words", F.array_sort("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))


def hit_words(hits: Column) -> Column:
    """Positions of the words that the hits cover, each once."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1))))


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The digest per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Cases as in scan(); repeated rows have a row each.
    """
    found = scan(docs, items, n)
    return (
        found.withColumn("n_hit", F.size(hit_words(F.col("hits"))).cast("long"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, n: int = 10, max_share: float = 0.0) -> DataFrame:
    """The documents whose share of hit words is at most ``max_share``.

    All columns of the input stay, whatever their names; texts are not changed.
    Null, empty and repeated rows stay as they are if they have no hit; a long
    text goes by its share of hit words like any other.  Without items nothing
    goes; an empty table gives no rows.
    """
    bad = scan(docs, items, n).filter(F.size(hit_words(F.col("hits"))) > F.lit(max_share) * F.col("n_words"))
    bad = materialize(bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")), "contaminated")
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), "doc_id", F.xxhash64("text").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.col("_hash") == F.col("_bad_hash"))
    small = bad.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(bad) if small else bad.hint("merge"), same, "left_anti").select("doc.*")
