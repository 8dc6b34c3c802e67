"""N-gram Jaccard self-join by chosen paths.

Texts become sets of word n-grams.  Each set is embedded as a fixed number of
minhash tokens; a node of the recursion samples some of the token places and
sends each set on to one child per sampled place and token, so sets stay
together along paths of shared tokens (Christiani, Pagh and Sivertsen's
CPSJoin).  Small nodes are compared at once, large nodes split again, and the
whole is repeated until a similar pair is missed with negligible chance.

Pairs that look similar, and nodes that stay large because their sets are alike,
are joined into candidate groups.  Every group is then compared set by set,
exactly and in blocks, so links are counted without being listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import discard, inner_tables, materialize
from .graph import components
from .tokens import U

#: Words in a shingle; a text of fewer words, but not none, is one shingle.
SHINGLE = 5
#: Similarity from which two texts are linked, as a fraction.
SIM_NUM, SIM_DEN = 4, 5
#: Minhash tokens per set.
TOKENS = 64
#: Expected number of places that a node samples.
PLACES = 1.8
#: A node of at most so many sets is compared at once.
SMALL = 64
#: Levels of splitting; nodes still large after them are candidate groups as they are.
DEPTH = 3
#: Share of equal minhash tokens from which a pair is a candidate (four deviations below the bound).
CANDIDATE = 0.6
#: Runs are repeated until a pair at the bound that is parted only after all levels is found with so large a chance.
TARGET_RECALL = 0.99975
#: Sets in a block of the exact comparison.
BLOCK = 3072
#: Bytes of sets (eight a shingle) in a block, on average, so that long texts fill no worker.
BLOCK_BYTES = 48 << 20
#: Keys of texts to fetch that are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000



def miss_chance(runs: int, levels: int = DEPTH) -> float:
    """Chance that a pair at the bound shares no node of the last of ``levels`` in any run, or is no candidate.

    The pair has the same equal places in all runs and nodes, so the chance is
    taken for each number of equal places; its shared nodes are a branching
    process, which must live through every level.
    """
    share, places = SIM_NUM / SIM_DEN, PLACES / TOKENS
    out = 0.0
    for equal in range(TOKENS + 1):
        gone = 0.0
        for _ in range(levels):
            gone = (1 - places + places * gone) ** equal
        out += math.comb(TOKENS, equal) * share**equal * (1 - share) ** (TOKENS - equal) * (gone**runs if equal >= CANDIDATE * TOKENS else 1.0)
    return out


RUNS = next(n for n in range(1, 100) if miss_chance(n) <= 1 - TARGET_RECALL)

_A = tk.keyed(np.arange(TOKENS, dtype=U), 501) | U(1)
_B = tk.keyed(np.arange(TOKENS, dtype=U), 502)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), sorted and distinct, of a text column."""
    w = tk.split_words(texts)
    at, h = tk.windows(w, SHINGLE)
    doc = w.doc[at] if len(at) else at
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        one = np.zeros(len(short), U)
        for k in range(SHINGLE - 1):
            has = n[short] > k
            one[has] = tk.mix(one[has] * U(31) + w.hash[w.first[short[has]] + k])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, one])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        doc, h = doc[keep], h[keep]
    return doc, h


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (of the set), n_set and sig (minhash tokens); fp is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=4 << 20):
            doc, h = shingle_sets(batch.column(2))
            n_docs = batch.num_rows
            first = np.searchsorted(doc, np.arange(n_docs + 1))
            n = np.diff(first)
            has = np.flatnonzero(n)
            fp, sig = [None] * n_docs, [None] * n_docs
            if len(has):
                lo = first[has]
                a = np.add.reduceat(tk.keyed(h, 1), lo)
                b = np.bitwise_xor.reduceat(tk.keyed(h, 2), lo)
                mins = np.empty((len(has), TOKENS), np.uint32)
                for i in range(TOKENS):
                    mins[:, i] = np.minimum.reduceat((h * _A[i] + _B[i]) >> U(32), lo)
                ab = np.stack([a, b], 1)
                for j, i in enumerate(has):
                    fp[i], sig[i] = ab[j].tobytes(), mins[j].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.binary()), pa.array(n.astype(np.int32)), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "fp", "n_set", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp binary, n_set int, sig binary")


def children(rows: DataFrame) -> DataFrame:
    """(node, no) of the next level for rows (node, no, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(TOKENS, dtype=U)
        bound = U(int(PLACES / TOKENS * 2**64))
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                node = np.asarray(part.column(0)).view(U)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS)
                chosen = tk.mix(tk.keyed(node, 601)[:, None] ^ tk.keyed(places, 602)[None, :]) < bound
                r, c = np.nonzero(chosen)
                child = tk.mix(tk.mix(node[r] + (c.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)) ^ sig[r, c].astype(U))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), part.column(1).take(pa.array(r))], ["node", "no"])

    return rows.select("node", "no", "sig").mapInArrow(run, "node long, no long")


def roots(reps: DataFrame) -> DataFrame:
    run = F.explode(F.transform(F.sequence(F.lit(1), F.lit(RUNS)), lambda r: F.xxhash64(F.lit("run"), r)))
    return reps.select(run.alias("node"), "no", "sig")


def equal_share(a, b):
    """Share of equal minhash tokens of two sketches (binary columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, TOKENS) for i in (2, 3))
            keep = pa.array((x == y).mean(1) >= CANDIDATE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(u, v): candidate pairs of small nodes, and the star of each node that stays large."""
    rows = children(roots(reps))
    sigs = reps.select("no", "sig")
    pairs, stars = [], []
    for depth in range(1, DEPTH + 1):
        rows = materialize(rows, f"paths-{depth}")
        size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("u")).filter("n > 1")
        size = materialize(size, f"nodes-{depth}")
        small, large = size.filter(F.col("n") <= SMALL).select("node"), size.filter(F.col("n") > SMALL).select("node", "u")
        held = rows.join(small, "node")
        lists = held.groupBy("node").agg(F.array_sort(F.collect_set("no")).alias("nos"))  # SMALL at most
        left = lists.select(F.posexplode("nos").alias("i", "u"), "nos").select("u", F.explode(F.slice("nos", F.col("i") + 2, SMALL)).alias("v"))
        pairs.append(left)
        n_large = large.limit(1).count()
        if not n_large:
            break
        inside = rows.join(large, "node")
        if depth == DEPTH:
            stars.append(inside.select("u", F.col("no").alias("v")))
        else:
            rows = children(inside.join(sigs, "no"))
    found = pairs[0]
    for p in pairs[1:]:
        found = found.unionByName(p)
    found = found.distinct()
    a, b = sigs.withColumnsRenamed({"no": "u", "sig": "sig_u"}), sigs.withColumnsRenamed({"no": "v", "sig": "sig_v"})
    alike = found.join(a, "u").join(b, "v").select("u", "v", "sig_u", "sig_v").mapInArrow(equal_share("sig_u", "sig_v"), "u long, v long")
    for s in stars:
        alike = alike.unionByName(s)
    return alike


def with_sets(docs: DataFrame) -> DataFrame:
    """Adds value: the shingle set as packed hashes, in place of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, size=4 << 20):
            at = batch.schema.get_field_index("text")
            doc, h = shingle_sets(batch.column(at))
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sets = [h[first[i] : first[i + 1]].tobytes() for i in range(batch.num_rows)]
            cols = [pa.array(sets, pa.binary()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, ["value" if n == "text" else n for n in batch.schema.names])

    cols = ", ".join("value binary" if c == "text" else f"{c} {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, cols)


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None, step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets (b: the same list if None)."""
    sets = a + (b or [])
    tokens = np.concatenate(sets) if sets else np.zeros(0, U)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, n = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[token]
    row, token = row[keep], number[token[keep]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    na = len(a)
    out = np.zeros((na, na if b is None else len(b)), np.float32)
    for lo in range(0, int(shared.sum()), step):
        s = slice(*np.searchsorted(token, [lo, lo + step]))
        m = np.zeros((len(sets), step), np.float32)
        m[row[s], token[s] - lo] = 1
        out += m[:na] @ (m[:na] if b is None else m[na:]).T
    return out


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest number in the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(table: pa.Table) -> pa.Table:
    """One pair of blocks of a candidate group: links and local root of each set."""
    block = np.asarray(table.column("own"))
    nos = table.column("no").to_pylist()
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    order = sorted(range(len(nos)), key=lambda i: (block[i] != lo, nos[i]))
    order = [i for k, i in enumerate(order) if k == 0 or nos[i] != nos[order[k - 1]]]
    values, copies = table.column("value"), np.asarray(table.column("copies"))
    sets = [np.frombuffer(values[i].as_py(), U) for i in order]
    n = np.array([len(s) for s in sets])
    weight = copies[order].astype(np.float64)
    na = len(order) if lo == hi else int(sum(block[i] == lo for i in order))
    same = lo == hi
    inter = overlaps(sets[:na], None if same else sets[na:])
    nb = n if same else n[na:]
    # inter / union >= NUM / DEN, in whole numbers
    linked = inter * (SIM_DEN + SIM_NUM) >= SIM_NUM * (n[:na, None] + nb[None, :])
    if same:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(order))
    links[:na] = linked @ (weight if same else weight[na:])
    if not same:
        links[na:] = linked.T @ weight[:na]
    u, v = np.nonzero(linked)
    root = local_roots(len(order), u, v if same else v + na)
    return pa.table([pa.array([nos[i] for i in order], pa.int64()), pa.array([nos[order[r]] for r in root], pa.int64()), pa.array(links.astype(np.int64))], ["no", "root", "links"])


def links_of_groups(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(no, root, links) per set and pair of blocks.

    members: no, grp, n_blocks, copies and the row (doc_id, text_hash) whose
    text has the set.
    """
    keys = members.withColumnsRenamed({"doc_id": "m_id", "text_hash": "m_hash"})
    if members.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(keys, same)
    sets = with_sets(texts.select("no", "grp", "n_blocks", "copies", "text"))
    own = F.pmod(F.xxhash64("no"), F.col("n_blocks")).cast("int")
    spread = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))))
    spread = spread.select("no", "copies", "value", "own", "grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return spread.groupBy("grp", "lo", "hi").applyInArrow(compare, "no long, root long, links long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_no, class_id, n_links of every row.

    class_no: a number of the texts linked with each other, directly or through
    others, null for texts without words, which link to nothing; class_id: the
    smallest doc_id of the class; n_links: rows whose shingle sets are at least
    SIM_NUM / SIM_DEN similar to this row's, itself left out.  Repeated rows and
    equal sets link to each other.  Ids that are null take the smallest id of
    their class, or stay null; rows that share an id are classed by their texts.
    A text of any length is one set; extra columns are not read, whatever their
    names.  An empty table gives no rows.
    """
    base = materialize(sketch(docs), "sketches")
    reps = base.filter(F.col("fp").isNotNull()).groupBy("fp").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("sig").alias("sig"), F.first("n_set").alias("n_set")
    )
    reps = reps.withColumn("no", F.monotonically_increasing_id())  # kept with the table, so set up once
    reps = materialize(reps, "sets")
    with inner_tables() as paths:
        found = candidate_edges(reps)
    edges = materialize(found, "candidates")
    discard(*paths)
    groups = components(edges).withColumnsRenamed({"node": "no", "root": "grp"})
    by_count, by_bytes = F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_set") * 8 / BLOCK_BYTES)
    size = groups.join(reps.select("no", "n_set"), "no").groupBy("grp").agg(F.greatest(by_count, by_bytes).cast("int").alias("n_blocks"))
    members = groups.join(size, "grp").join(reps.select("no", "copies", "row.doc_id", "row.text_hash"), "no")
    links = materialize(links_of_groups(docs, materialize(members, "members")), "links")
    classes = components(links.select(F.col("no").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "no")
    total = links.groupBy("no").agg(F.sum("links").alias("links"))
    lows = classes.join(reps.select("no", "low"), "no").groupBy("root").agg(F.min("low").alias("class_low"))
    known = classes.join(lows, "root").join(total, "no").select("no", "root", "class_low", "links")
    out = reps.select("no", "fp", "copies", "low").join(known, "no", "left")
    out = out.select(
        "fp", F.coalesce("root", "no").alias("class_no"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("class_low")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    rows = base.select("doc_id", "text_hash", "fp").join(out, "fp", "left")
    class_id = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select("doc_id", "text_hash", "class_no", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every row, as join() gives them: nulls, empty and long texts, ties, repeats, extra columns and empty tables as there."""
    return join(docs).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns unchanged.

    Ties of one id go to the smaller hash of the text; null ids come after all
    others.  A text without words (null, empty, white space) is a class of its
    own with its id.  Of rows alike in id and text one stays, chosen by a hash of
    all columns.  Long texts and extra columns are as any other; an empty table
    gives no rows.
    """
    joined = join(docs).select(F.col("doc_id").isNull().alias("k_null"), F.coalesce("doc_id", F.lit(-1)).alias("k_id"), F.col("text_hash").alias("k_hash"), "class_no")
    key = ["k_null", "k_id", "k_hash"]
    first = joined.filter(F.col("class_no").isNotNull()).groupBy("class_no").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    stay = materialize(first.unionByName(joined.filter(F.col("class_no").isNull()).select(*key)).distinct(), "stay")
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), F.col("doc_id").isNull().alias("k_null"), F.coalesce("doc_id", F.lit(-1)).alias("k_id"), F.xxhash64("text").alias("k_hash"))
    # The keys of the join are those of the grouping, so texts move once.
    return rows.join(stay.hint("merge"), key).groupBy(*key).agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc.*")
