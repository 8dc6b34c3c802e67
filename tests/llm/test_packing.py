"""Packing: ids of whole texts, each id in one piece, windows without gaps, little padding, even steps."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "a", "é", "'s", "'", "12", "!?", "中", "🙂", " b", "word", " ", "​", "â", "<|endoftext|>"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", None, " ", "a" * 5000, "x y " * 4000]


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    from trackweave.llm import packing

    texts = odd_texts()
    want = plain_ids(texts)
    for known in (packing.KNOWN, 50):
        monkeypatch.setattr(packing, "KNOWN", known)
        enc = packing.Encoder(PATH)
        for part in (slice(0, 700), slice(700, None), slice(0, 300)):
            ids, at = enc.encode(pa.array(texts[part], pa.string()))
            assert [ids[a:b].tolist() + [1] for a, b in zip(at[:-1], at[1:])] == want[part]


@pytest.mark.parametrize("sizes", [[1], [2048], [256], [1500] * 40, [300] * 70, [5] * 1000, [5000, 1, 700, 2047, 1025, 1024, 513, 256, 255], [], "random"])
def test_each_token_in_one_window(sizes):
    from trackweave.llm.packing import pack_group, steps_of

    rng = random.Random(5)
    sizes = [int(rng.lognormvariate(6, 1.3)) + 1 for _ in range(3000)] if sizes == "random" else sizes
    windows = pack_group(sizes)
    seen = [np.zeros(n, int) for n in sizes]
    for w in windows:
        assert 0 < w.used <= w.size <= 2048
        for doc, start, length in w.pieces:
            assert length > 0
            seen[doc][start : start + length] += 1
    assert all((s == 1).all() for s in seen)
    assert sum(w.used != w.size for w in windows) <= 1
    steps = steps_of(windows)
    groups = {}
    for w, s in zip(windows, steps, strict=True):
        groups.setdefault(s, []).append(w)
    for ws in groups.values():
        assert len({w.size for w in ws}) == 1 and sum(w.size for w in ws) <= 1 << 15
    if len(sizes) == 3000:
        assert len(windows) > 100
        pieces = sum(len(w.pieces) for w in windows)
        assert pieces < 1.3 * sum(-(-n // 2048) for n in sizes)  # few documents are cut
        for size in (2048, 1024, 512, 256):
            mine = [ws for ws in groups.values() if ws[0].size == size]
            assert len({len(ws) for ws in mine}) <= 2
            cost = [np.mean([sum(p[2] ** 2 for p in w.pieces) for w in ws]) for ws in mine]
            assert not cost or max(cost) < 1.25 * min(cost)


def test_pieces_of_a_table(spark, monkeypatch):
    from trackweave.llm import packing

    texts = odd_texts()
    rows = [(i % 2900 if i else None, t, 7, 9) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, window long").coalesce(2)
    pieces = packing.pack(docs, PATH)
    got = pieces.collect()
    by_sequence = {}
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append(r)
    pads = 0
    for ps in by_sequence.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= ps[0].window <= 2048
        pads += ps[0].window - at
    assert pads <= 2 * 2047
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = plain_ids(texts)
    alone = [(rows[i][0], want[i]) for i in range(len(rows)) if i % 2900 >= 105 or i >= 2900 + 105]
    for doc, ids in alone:
        ps = sorted(by_doc[doc, len(ids)], key=lambda r: r.start)
        assert [x for r in ps for x in r.ids] == ids
    assert sum(r.length for r in got) == sum(map(len, want))
    whole = packing.sequences(pieces, pad=0).collect()
    assert len(whole) == len(by_sequence) and all(len(r.ids) == r.window and r.bounds[0] == 0 for r in whole)
    assert {r.doc_id for r in packing.report(docs, PATH).collect()} == {r[0] for r in rows}
    assert packing.report(docs.limit(0), PATH).count() == 0
