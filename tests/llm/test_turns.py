"""Repair of conversations against uniform-cost search over whole edit strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def search(rows):
    """(cost, audit, roles and texts): the first whole repair that leaves the queue."""
    queue = [(0, "", 0, ())]
    while True:
        cost, audit, i, out = heapq.heappop(queue)
        roles = "".join(r[:1] or "-" for r, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        if cost < 40:
            for r in ("user", "assistant"):
                heapq.heappush(queue, (cost + 2, audit + "I", i, (*out, (r, ""))))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, out))
            if not must_go:
                heapq.heappush(queue, (cost + truncated, audit + "K", i + 1, (*out, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 2 + truncated, audit + "R", i + 1, (*out, (r, text))))


def expected(rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv, rs in by.items():
        rs = sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, judged, n = set(), [], [0, 0, 0]
        for _, _, role, text in rs:
            bare = text.strip(SPACE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                n[fault] += 1
            judged.append((role, text, fault < 2, fault == 2))
        turns = {r[1] for r in rs} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit, left = search(judged)
        out[conv] = (gaps, *n, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left)))
    return out


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None])
            text = rng.choice(["Yes.", "No!", "open", " \n", "", None, "x. \t", "é?", f"own {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


EXTRA = [(None, 1, "user", "a."), (None, None, "user", "a."), (900, 0, "user", "q?"), (900, 0, "user", "q?"), (900, 0, "assistant", "q?"), *[(901, 5, "user", "same.")] * 9, *[(902, t, "system", "s.") for t in range(4)]]


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_least_edits(spark):
    from trackweave.llm import turns

    rows = sample(400, 1) + EXTRA
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA + ", n long, blank boolean")
    found = turns.report(docs)
    assert found.count() == len({r[0] for r in rows})
    assert got(found) == expected(rows)
    assert turns.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_of_any_size_agree(spark, size):
    from trackweave.llm import turns

    rows = sample(60, 2) + EXTRA
    want = expected(rows)
    assert got(turns.repair(turns.damaged(spark.createDataFrame(rows, SCHEMA)), size)) == want


def test_long_conversation_over_many_tasks(spark):
    from trackweave.llm import turns

    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"t {t % 900}.") for t in range(3000)] + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = got(turns.repair(docs))
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(turns.repair(docs, 64)) == want
        out = turns.repaired(docs.where("conv_id = 7"), 64).orderBy("turn").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert re.fullmatch("(ua)+", "".join(r.role[0] for r in out))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in out).encode()).hexdigest() == want[7][-1]
