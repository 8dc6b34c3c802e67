"""Repair of conversation structure: the cheapest edits that make roles follow s?(ua)+.

Rows are sorted over the whole cluster and cut into blocks, so that a long
conversation is spread over tasks.  A block is summed up by what a Viterbi pass
over the four grammar states gives from each state to each; the blocks of a
conversation are then chained, the path is traced back, and the blocks' rows
are edited along it in a stream.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_batches

#: Most rows of a block, and bytes of text after which it ends.
ROWS, BYTES = 4096, 4 << 20

#: Grammar states: nothing yet, after the system's turn, after the user's, after the assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

Best = tuple[int, str] | None
_SPACE = " \t\n\x0b\x0c\r"


def _least(a: Best, b: Best) -> Best:
    return b if a is None else a if b is None else min(a, b)


def _plus(a: Best, cost: int, edit: str) -> Best:
    return None if a is None else (a[0] + cost, a[1] + edit)


def close(v: list[Best]) -> list[Best]:
    """Inserted turns after a layer: one user's turn, then one assistant's, is all that can be of use."""
    v[USER] = _least(v[USER], _plus(_least(_least(v[EMPTY], v[SYSTEM]), v[ASSISTANT]), INSERT, "I"))
    v[ASSISTANT] = _least(v[ASSISTANT], _plus(v[USER], INSERT, "I"))
    return v


def advance(v: list[Best], initial: str, must_go: bool, truncated: bool) -> list[Best]:
    """The next layer: the row is kept, gets another role, or goes.

    Equal costs are told apart by the audit string.  Of two equal costs in one
    state no audit is a beginning of the other, so what follows can't turn them.
    """
    new = [_plus(x, DELETE, "D") for x in v]
    if not must_go:
        extra = TRUNCATED if truncated else 0
        before_user = _least(_least(v[EMPTY], v[SYSTEM]), v[ASSISTANT])
        keep, other = extra + KEEP, extra + REROLE
        if initial == "s":
            new[SYSTEM] = _least(new[SYSTEM], _plus(v[EMPTY], keep, "K"))
        new[USER] = _least(new[USER], _plus(before_user, *((keep, "K") if initial == "u" else (other, "R"))))
        new[ASSISTANT] = _least(new[ASSISTANT], _plus(v[USER], *((keep, "K") if initial == "a" else (other, "R"))))
    return close(new)


def edited(piece: str, state: int, rows: list[tuple[str, str | None, int]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that an audit string leaves; rows are (role, text, copies)."""
    each = ((role, text) for role, text, n in rows for _ in range(n))
    for edit in piece:
        role, text = (None, "") if edit == "I" else next(each)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
            if edit != "K":
                role = "assistant" if state == ASSISTANT else "user"
        yield role, text or ""


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows dropped (no copy), emptied, stripped of ends, repeated or given to the user, by crc32(conv_id:turn) % 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), k.alias("k")).select(
        "conv_id", "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation, turn (nulls first), role and text, equal ones once with their number; with the marks of their faults.

    Equal rows are counted before anything is shuffled by conversation.  A
    first place is looked up only for texts that come at several turns of a
    conversation; Spark splits that join's skewed keys.  Rows without a copy
    only stand for their conversation.
    """
    gone = F.col("copies") == 0
    alike = rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(gone, "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"), "copies"
    ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    alike = alike.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("place", F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("at")))
    # Rows without a copy are left out inside the sums, so that both sides read one shuffle.
    there = F.col("copies") > 0
    firsts = alike.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.when(there, F.col("place"))).alias("first"), F.count(F.when(there, 1)).alias("n")).where("n > 1")
    # Null-safe on all keys: else "is not null" goes down one side only, which then reads a shuffle of its own.
    joined = alike.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("role").eqNullSafe(F.col("r")) & F.col("digest").eqNullSafe(F.col("d")), "left")
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    return (
        joined.select(
            "conv_id", "turn", "role", "text", "copies", (trimmed == "").alias("blank"), F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("seen"),
            (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"),
        )
        .repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


class Block:
    """Rows of one conversation that follow each other, and the passes from each state over them."""

    def __init__(self, conv, first: bool) -> None:
        self.conv, self.first = conv, first
        start = close([(0, ""), None, None, None]) if first else None
        self.passes: list[list[Best] | None] = [start, None, None, None] if first else [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
        self.rows: list[tuple[str, str | None, int]] = []
        self.n = self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.head = self.tail = None

    def add(self, turn, role: str, text: str, copies: int, blank: bool, seen: bool, open_: bool) -> None:
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - (not seen)
        self.truncated += not blank and not seen and open_
        initial = role[:1]
        if self.n:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        else:
            self.head = initial
        self.illegal += copies - 1
        self.tail = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        for k in range(copies):
            must_go = blank or seen or k > 0
            self.passes = [p and advance(p, initial, must_go, open_) for p in self.passes]
        self.n += copies
        kept = None if blank or seen else text
        self.bytes += len(kept or "")
        if kept is not None and copies > 1:
            self.rows += [(role, kept, 1), (role, None, copies - 1)]
        else:
            self.rows.append((role, kept, copies))


_BLOCK = pa.schema(
    [("part", pa.int64()), ("no", pa.int64()), ("phase", pa.int32()), ("first", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    + [(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")] + [("head", pa.string()), ("tail", pa.string())]
    + [("rows", pa.binary())]
)
_BLOCK_SQL = (
    "part bigint, no bigint, phase int, first boolean, costs array<bigint>, audits array<string>, n bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, turns bigint, low bigint, high bigint, head string, tail string, rows binary"
)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Each block twice: its passes (phase 0), and its passes and rows (phase 1)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    made: list[dict] = []
    held = no = 0
    block: Block | None = None
    kind = None

    def record(b: Block) -> None:
        nonlocal held, no
        flat = [x for p in b.passes for x in (p or [None] * 4)]
        one = {"conv_id": b.conv, "part": part, "no": no, "first": b.first, "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat]}
        more = {k: getattr(b, k) for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail")}
        made.extend((one | {"phase": 0}, one | {"phase": 1} | more | {"rows": zlib.compress(json.dumps(b.rows, ensure_ascii=False).encode(), 3)}))
        held += b.bytes + 40 * b.n
        no += 1

    def out() -> pa.RecordBatch:
        nonlocal made, held
        batch = pa.RecordBatch.from_pylist(made, schema=pa.schema([("conv_id", kind), *_BLOCK]))
        made, held = [], 0
        return batch

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, turn, role, text, copies, blank, seen, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block is None or block.conv != conv or block.n >= most or block.bytes >= BYTES:
                first = block is not None and block.conv != conv
                if block is not None:
                    record(block)
                    if held > BYTES:
                        yield out()
                block = Block(conv, first)
            while copies > most - block.n > 0:  # a row repeated many times goes on in the next block
                now = most - block.n
                block.add(turn, role, text, now, blank, seen, open_)
                record(block)
                block, seen, copies = Block(conv, False), True, copies - now
                if held > BYTES:
                    yield out()
            if copies:
                block.add(turn, role, text, copies, blank, seen, open_)
    if block is not None:
        record(block)
        yield out()


class Chain:
    """One conversation's blocks, first their passes and then their rows."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.v: list[Best] | None = None
        self.back: list[list[int | None]] = []
        self.path: list[tuple[int, int]] = []
        self.audit = ""
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.tail = None
        self.k = self.turns_out = 0
        self.began = False
        self.digest = hashlib.sha256()

    def link(self, b: dict) -> None:
        if self.v is None:
            self.v = [(0, ""), None, None, None] if b["first"] else close([(0, ""), None, None, None])
        costs, audits, new, back = b["costs"], b["audits"], [None] * 4, [None] * 4
        for i, x in enumerate(self.v):
            for j in range(4) if x else ():
                if costs[4 * i + j] is not None:
                    y = (x[0] + costs[4 * i + j], x[1] + audits[4 * i + j])
                    if new[j] is None or y < new[j]:
                        new[j], back[j] = y, i
        self.v = new
        self.back.append(back)

    def trace(self) -> None:
        """The cheapest way that ends with nothing or after the assistant."""
        best, state = min((x, s) for s, x in enumerate(self.v) if x and s in (EMPTY, ASSISTANT))
        self.cost, self.audit = best
        for back in reversed(self.back):
            self.path.append((back[state], state))
            state = back[state]
        self.path.reverse()
        self.v, self.back = None, []

    def follow(self, b: dict) -> list[tuple[str, str]]:
        i, j = self.path[self.k]
        self.k += 1
        for c in self.sums:
            self.sums[c] += b[c]
        if b["n"]:
            self.sums["illegal"] += self.tail is not None and self.tail + b["head"] not in ("su", "ua", "au")
            self.tail = b["tail"]
        if b["low"] is not None:
            self.sums["turns"] -= b["low"] == self.high
            self.low, self.high = b["low"] if self.low is None else self.low, b["high"]
        return list(edited(b["audits"][4 * i + j], i, json.loads(zlib.decompress(b["rows"]))))

    def hash(self, lines: list[tuple[str, str]]) -> None:
        for role, text in lines:
            self.digest.update(f"{chr(10) if self.began else ''}{role}:{text}".encode())
            self.began = True

    def result(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        faults = {c: self.sums[c] for c in ("blank", "duplicate", "truncated", "illegal")}
        return {"conv_id": self.conv, "gaps": gaps, **faults, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.digest.hexdigest()}


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _chained(rows: DataFrame, columns: str, emit, block_rows: int) -> DataFrame:
    """emit(chain, block's lines or None at a conversation's end) gives the rows of the result."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = to_arrow_schema(StructType.fromDDL(f"conv_id {kind}, {columns}"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain | None = None
        made: list[dict] = []
        for batch in batches:
            for b in batch.to_pylist():
                if chain is None or chain.conv != b["conv_id"]:
                    if chain is not None:
                        made += emit(chain, None)
                    chain = Chain(b["conv_id"])
                if b["phase"] == 0:
                    chain.link(b)
                    continue
                if chain.v is not None:
                    chain.trace()
                made += emit(chain, chain.follow(b))
            yield pa.RecordBatch.from_pylist(made, schema=schema)
            made = []
        if chain is not None:
            yield pa.RecordBatch.from_pylist(emit(chain, None), schema=schema)

    source = rows if "copies" in rows.columns else rows.select("conv_id", "turn", "role", "text", F.lit(1).cast("long").alias("copies"))
    with arrow_batches(spark, 1000):
        blocks = ordered(source).mapInArrow(lambda batches: _blocks(batches, block_rows), f"conv_id {kind}, {_BLOCK_SQL}")
    with arrow_batches(spark, 64):
        return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "phase", "part", "no").mapInArrow(finish, f"conv_id {kind}, {columns}")


def repair(rows: DataFrame, block_rows: int = ROWS) -> DataFrame:
    """A row per conversation: its faults, the least cost and audit of its repair, the digest of the repaired turns.

    Null conv_ids form one conversation; a null role or text is one space;
    null turns come first and leave no gap; rows of one turn are ordered by
    role and text; repeated rows are duplicates of each other.  Other columns
    are not read.  A conversation's digest has to be computed in order, so its
    blocks pass through one task, as a stream: that task holds a block, the
    audit strings of four states and four numbers a block.
    """

    def emit(chain: Chain, lines: list | None) -> list[dict]:
        if lines is None:
            return [chain.result()]
        chain.hash(lines)
        return []

    return _chained(rows, SUMMARY, emit, block_rows)


def repaired(rows: DataFrame, block_rows: int = ROWS) -> DataFrame:
    """conv_id, turn (from 0), role, text of the repaired conversations; see repair()."""

    def emit(chain: Chain, lines: list | None) -> list[dict]:
        out = []
        for role, text in lines or ():
            out.append({"conv_id": chain.conv, "turn": chain.turns_out, "role": role, "text": text})
            chain.turns_out += 1
        return out

    return _chained(rows, "turn bigint, role string, text string", emit, block_rows)


def report(conversations: DataFrame) -> DataFrame:
    """repair() of the damaged conversations, by the contract."""
    return repair(damaged(conversations))
