"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, block int, w string, fp string"


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    base = [word() for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    out = [" ".join(base), " ".join(near), " ".join(base), None, "", " \n\t ", "one", "one two", "é ß Straße", "12 34 !!", "x" * 5000, " ".join(word() for _ in range(30_000))]
    return out + [" ".join(word() for _ in range(80)) for _ in range(6)]


def rows():
    out = [(i, t, ["en", "de", None][i % 3], ["a", None, "b"][i % 3], 1, 7, 7, 7, "w", "fp") for i, t in enumerate(texts())]
    return out + [out[0], (None, "null id words here", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    t = texts()
    return spark.createDataFrame([(1, " ".join(t[12].split()[5:30])), (2, "one two"), (3, None), (4, ""), (5, "É only")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(18)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def ops(items, labels):
    from trackweave.llm import cpjoin, decontam, langid, licenses, lm, mixing, quality, rlz, sharding, toxicity

    return {
        "op1": langid.report, "op2": lambda d: decontam.report(d, items), "op3": rlz.report, "op4": lm.report, "op5": licenses.report, "op6": mixing.report, "op7": cpjoin.report,
        "op8": lambda d: toxicity.report(d, labels), "op9": lambda d: sharding.shard(d, 24), "op10": quality.report,
    }


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_every_row_has_a_result(name, docs, none, items, labels):
    f = ops(items, labels)[name]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in f(docs).select("doc_id").collect())
    assert got == sorted((r[0] is None, r[0] or 0) for r in rows())
    assert f(none).count() == 0


def test_stages(docs, none, spark, monkeypatch, items):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(corpus_pipeline, "read", lambda *a: items)
    for table in (docs, none):
        step = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, step, "unused")
            n = out.count()
            assert n or table is none
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns
                step = corpus_pipeline.materialize(out, "test")


def test_repeated_rows_agree(docs):
    from trackweave.llm import cpjoin, rlz

    got = [r for r in cpjoin.report(docs).collect() if r.doc_id in (0, 1, 2)]
    assert {r.class_id for r in got} == {0}
    assert {r.n_links for r in got} == {3}
    removed = {r.doc_id: r.n_removed for r in rlz.report(docs).collect() if r.doc_id in (0, 1, 2)}
    assert removed == {0: 0, 1: 119, 2: 120}
