"""Mixing sources to target weights (built-in functions only).

Each source's words form one stream, cut into blocks of fixed length.  Output
slots are dealt to sources in the target proportions: the counts of an output
shard are multinomial draws under the condition that the totals come out at the
targets.  A source's n-th slot takes the block that a pseudorandom permutation
of the source's block numbers names, and blocks are joined by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words in a block.
BLOCK = 256
#: Output slots in a shard.
SLOTS_PER_SHARD = 1024
#: Each source's documents are numbered in so many buckets, so no task sorts a whole source.
BUCKETS = 1024
#: Rounds of the swap-or-not permutation.
ROUNDS = 24
#: No source is drawn more than so many times.
MOST = 3
#: Slots per row while slots are being made.
CHUNK = 4096


def permute(i: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap-or-not shuffle, Hoang, Morris and Rogaway, 2012)."""

    def step(x, r):
        other = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("k")), n) - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``most`` times its source's size and the excess
    is shared again by weight.  The cut-off is found in closed form: sources in
    the order of size per weight fill up first.  One row per source meets in one
    task.
    """
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").isNull(), "source")
    by_ratio = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    upto = by_ratio.rowsBetween(W.unboundedPreceding, 0)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    s = sizes.withColumn("weight", weight.cast("double"))
    s = (
        s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full", most * F.sum("source_size").over(upto))
        .withColumn("w_after", F.sum("weight").over(everything) - F.sum("weight").over(upto))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
    )
    # Level before a source fills: what the fuller ones leave, per unit of the weight that is left.
    left = F.col("total") - (F.col("full") - F.col("cap"))
    level = left / (F.col("w_after") + F.col("weight"))
    s = s.withColumn("level", level).withColumn("fills", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("nth", F.row_number().over(by_ratio))
    s = s.withColumn("open", F.min(F.when(~F.col("fills"), F.struct("nth", "level"))).over(everything))
    target = F.when(F.col("open").isNull() | (F.col("nth") < F.col("open.nth")), F.col("cap").cast("double")).otherwise(F.col("open.level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def named(source: Column) -> Column:
    """A source as a key that is never null: the null source sorts last, others by code point."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def row_key() -> list[Column]:
    """k_id, k_null, tie: what tells a row of ``docs`` (doc_id, text) from all but its repeats."""
    low = F.lit(-1).cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), low).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), F.xxhash64("doc_id", "text").alias("tie")]


KEY = ("src", "k_id", "k_null", "tie")


def lay_out(docs: DataFrame, size: Column, buckets: int = BUCKETS) -> DataFrame:
    """Each row's place in its source's stream: src, row key, copy (among its repeats, from 1), size, start.

    Rows are numbered inside hash buckets of their source and buckets follow
    each other, so a source of any size is spread over many tasks.  Only keys
    and sizes travel; texts stay where they are.
    """
    rows = docs.select(named(F.col("source")).alias("src"), *row_key(), size.alias("size")).withColumn("bucket", F.pmod("tie", F.lit(buckets)))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("src", "bucket").orderBy("tie", "k_null", "k_id")
    own = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(inside) - F.rank().over(inside) + 1
    return rows.withColumn("own", own).withColumn("copy", nth).join(sums, ["src", "bucket"]).select(*KEY, "copy", "size", (F.col("first") + F.col("own")).alias("start"))


def draws(plan: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per output slot: source, block, words, out (the slot's number), shard, slot.

    plan: source, source_size, target.  A source's slots run through its blocks
    in a new permuted order each time, the short last block at the end of each
    round; the last slot takes only the words that its target still lacks.  The
    slots of all sources are then dealt over the output by one more permutation,
    so a shard's source counts are drawn without replacement.
    """
    want = F.round("target").cast("long")
    p = plan.filter(F.col("source_size") > 0).select("source", F.col("source_size").alias("n"), want.alias("want"))
    p = p.filter(F.col("want") > 0)
    p = (
        p.withColumn("full", F.floor(F.col("n") / block))
        .withColumn("per_round", F.ceil(F.col("n") / block))
        .withColumn("rounds", F.floor(F.col("want") / F.col("n")))
        .withColumn("rest", F.col("want") - F.col("rounds") * F.col("n"))
        .withColumn("slots", F.col("rounds") * F.col("per_round") + F.ceil(F.col("rest") / block))
    )
    everything = W.partitionBy(F.lit(0))
    p = p.withColumn("all_slots", F.sum("slots").over(everything)).withColumn(
        "first", F.coalesce(F.sum("slots").over(everything.orderBy(F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    chunks = p.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK)))).repartition("source", "chunk")
    base = F.col("chunk") * CHUNK
    each = chunks.withColumn("nth", F.explode(F.sequence(base, F.least(base + CHUNK, F.col("slots")) - 1)))
    each = each.withColumn("round", F.floor(F.col("nth") / F.col("per_round"))).withColumn("at", F.col("nth") - F.col("round") * F.col("per_round"))
    key = F.xxhash64(F.lit(seed), "source", "round")
    number = F.when(F.col("at") < F.col("full"), permute(F.col("at"), F.greatest("full", F.lit(1).cast("long")), key)).otherwise(F.col("full"))
    length = F.least(F.lit(block).cast("long"), F.col("n") - number * block)
    in_rest = F.col("round") >= F.col("rounds")
    taken = F.when(in_rest, F.least(length, F.col("rest") - F.col("at") * block)).otherwise(length)
    out = permute(F.col("first") + F.col("nth"), F.col("all_slots"), F.xxhash64(F.lit(seed), F.lit("out")))
    return each.select("source", "round", number.alias("block"), taken.alias("words"), out.alias("out")).select(
        "source", "round", "block", "words", "out", F.floor(F.col("out") / SLOTS_PER_SHARD).alias("shard"), F.pmod("out", F.lit(SLOTS_PER_SHARD)).alias("slot")
    )


def pieces(laid: DataFrame, block: int = BLOCK) -> DataFrame:
    """The parts of each row by block: at (in the row's words), lo and hi (in the block)."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    first = F.floor(F.col("start") / block)
    cut = laid.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    return cut.select(*KEY, "copy", "size", "block", lo.alias("lo"), hi.alias("hi"), (F.col("block") * block + lo - F.col("start")).alias("at"))


def mix(docs: DataFrame, size: Column, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(laid out rows, plan by source, taken pieces).

    A taken piece: src, row key, copy, size, at, n (words taken from ``at``),
    round and the output slot that it goes to.  The layout is written once, as
    keys and sizes; the plan and the pieces are made from it.
    """
    from .common import materialize

    laid = materialize(lay_out(docs, size), "layout")
    plan = targets(laid.groupBy(F.col("src").alias("source")).agg(F.sum("size").alias("source_size")))
    drawn = draws(plan, seed, block).withColumnRenamed("source", "src")
    n = F.least("hi", "words") - F.col("lo")
    # Both sides grow with the corpus, so neither is broadcast.
    taken = pieces(laid, block).join(drawn.hint("merge"), ["src", "block"]).withColumn("n", n).filter(F.col("n") > 0)
    return laid, plan, taken.select(*KEY, "copy", "size", "at", "n", "round", "out", "shard", "slot")


def report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    A null text has no words and a null source is a source of its own, the last;
    empty texts, being without words, take nothing.  A long text is cut into as
    many blocks as it needs.  Repeated rows have places of their own in the
    stream; ties in the order are told apart by hash and id.  Extra columns are
    not read, whatever their names.  An empty table gives no rows.
    """
    from .common import n_words

    laid, plan, taken = mix(docs, n_words(F.col("text")), seed)
    none = F.lit(0).cast("long")
    both = laid.select(*KEY, "copy", "size", none.alias("n")).unionByName(taken.select(*KEY, "copy", "size", "n"))
    by_row = both.groupBy(*KEY, "copy", "size").agg(F.sum("n").alias("taken"))
    doc_id = F.when(~F.col("k_null"), F.col("k_id"))
    return by_row.join(plan.withColumnRenamed("source", "src"), "src").select(doc_id.alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents: a row per row of ``docs`` and round, with the words that the round took.

    Columns of the input stay as they are, but text holds the words taken,
    joined by one space (the text itself where a round took all of it), and
    n_chars, where there is one, its length.  Texts move once, to the list of
    what was taken of them.  Rows of null or empty texts have no words to take
    and give no row; nor do those that the draw leaves out.  Repeated rows are
    taken one by one; which of several rows alike in id, text and source gives
    which words is decided by a hash of their other columns.  A long text gives
    its words in one row a round; extra columns may have any name.  An empty
    table gives none.
    """
    from .common import n_words, words

    cols = docs.columns
    _, _, taken = mix(docs, n_words(F.col("text")), seed)
    rounds = taken.groupBy(*KEY, "copy", "size", "round").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("spans"), F.sum("n").alias("n"))
    by_copy = rounds.groupBy(*KEY, "copy").agg(F.collect_list(F.struct("size", "n", "spans")).alias("rounds"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), named(F.col("source")).alias("src"), *row_key())
    # Rows and rounds of a key move together, once; then each copy meets its own rounds only.
    blank = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    side = rows.select(*KEY, blank(by_copy, "copy"), "doc", blank(by_copy, "rounds")).unionByName(by_copy.select(*KEY, "copy", blank(rows, "doc"), "rounds"))
    nth = F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("copy").isNotNull(), F.xxhash64("doc")))
    side = side.withColumn("nth", F.coalesce(F.col("copy").cast("int"), nth))
    mine = F.first("rounds", True).over(W.partitionBy(*KEY, "nth").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    both = side.withColumn("rounds", mine).filter("doc is not null and rounds is not null").select("doc", "rounds")
    # The words of a row are split once, whatever the number of its rounds and spans.
    w, r = F.col("w"), F.col("r")
    part = F.array_join(F.flatten(F.transform("r.spans", lambda x: F.slice(w, (x["at"] + 1).cast("int"), x["n"].cast("int")))), " ")
    text = F.when(r["n"] == r["size"], F.col("doc.text")).otherwise(part)
    split = both.select("doc", "rounds", F.explode_outer(F.array(words(F.col("doc.text")))).alias("w"))
    out = split.select("doc", "w", F.explode("rounds").alias("r")).select("doc", text.alias("new_text"))
    pick = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return out.select(*[pick.get(c, F.col(f"doc.`{c}`")).alias(c) for c in cols])
