"""Periodic runs against plain search over all periods."""

import hashlib
import random
import zlib

import pytest


def plain_runs(w):
    """Every maximal stretch for every period, kept under its smallest one."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def samples():
    rng = random.Random(7)
    for letters in (1, 2, 3, 5):
        for _ in range(60):
            yield [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
    for _ in range(60):  # repeated stretches inside unlike words, and repetitions of repetitions
        w = [rng.randrange(1000) for _ in range(rng.randint(0, 30))]
        block = [rng.randrange(4) for _ in range(rng.randint(1, 15))]
        for _ in range(rng.randint(1, 3)):
            w += block * rng.randint(1, 5) + [rng.randrange(1000) for _ in range(rng.randint(0, 3))]
        yield w + w[: rng.randint(0, len(w))]


def test_automaton_finds_all_runs():
    from trackweave.llm.runs import find_runs

    for w in samples():
        assert find_runs(w) == plain_runs(w), w


def expected(doc_id, text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, size, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (len(found), s, size, q, size and 1000 * size // q, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def rows():
    out = [(i, " \n".join(map(str, w)) + "\t" * (i % 3)) for i, w in enumerate(samples())]
    return out + [(1000, None), (1001, ""), (1002, " \n"), (None, "a b c"), (None, None), (3, "x " * 40), (3, "x " * 40), (1003, "é ß " * 9 + "x" * 9000), (1004, "line one\nline two\n" * 30)]


def test_report_equals_search(spark, rows):
    from trackweave.llm import runs

    docs = spark.createDataFrame([(*r, 5, "w") for r in rows], "doc_id long, text string, n long, w string")
    got = [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in runs.report(docs).collect()]
    want = [(i, expected(i, t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert runs.report(docs.limit(0)).count() == 0


def test_long_repetitions_take_little():
    from trackweave.llm.runs import find_runs

    assert find_runs([0] * 100_000) == [(0, 100_000, 1)]
    assert find_runs(list(range(30_000)) * 3) == [(0, 90_000, 30_000)]
    shorter, w = [0], [0, 1]
    for _ in range(8):  # Fibonacci words hold many runs
        shorter, w = w, w + shorter
    assert find_runs(w) == plain_runs(w)


def test_collapsed_text_keeps_one_period(spark):
    from trackweave.llm import runs

    (row,) = runs.find(spark.createDataFrame([(1, "start " + "a b c d " * 6 + "end")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 24, 4)]
    assert row.collapsed == "start a b c d end"
