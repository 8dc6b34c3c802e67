"""Cases in which an operator once did less than the whole job."""

import collections
import random

import numpy as np


def test_pairs_meet_on_the_last_level(spark):
    """op7: of pairs at the bound that nodes part only after all levels, hardly one is missed."""
    from trackweave.llm import cpjoin

    rng = np.random.default_rng(3)
    n = 3000
    a = rng.integers(0, 1 << 32, (n, cpjoin.TOKENS), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < cpjoin.SIM_NUM / cpjoin.SIM_DEN, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    sets = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(np.concatenate([a, b]))], "no long, sig binary").cache()
    rows = cpjoin.children(cpjoin.roots(sets))
    for _ in range(cpjoin.DEPTH - 1):
        rows = cpjoin.children(rows.join(sets, "no"))
    left, right = rows.filter(f"no < {n}"), rows.filter(f"no >= {n}").selectExpr("node", f"no - {n} AS no")
    met = left.join(right, ["node", "no"]).select("no").distinct().count()
    assert n - met <= 3  # 5 runs miss about 26
    assert cpjoin.miss_chance(cpjoin.RUNS) <= 1 - cpjoin.TARGET_RECALL


def test_terms_next_to_typographic_signs():
    """op8: scoring splits words as training does, next to signs outside ASCII too, and sees their quotation marks."""
    import pyarrow as pa

    from trackweave.llm.toxicity import Model, Scorer, text_words

    model = Model(["idiot", "größter"], [6.0, 6.0], [3.0, 3.0], {"<quoted>": -1.0}, -2.0)
    plain, quoted, clean = Scorer(model).scores(pa.array(["an idiot here", 'an "idiot" here', "nothing here"]))
    assert plain > quoted > clean
    signs = ["“idiot”", "„idiot“", "«idiot»", "a—idiot—b", " idiot ", "¿idiot?", "¡idiot!", "愚、idiot。", "idiot…", "‘idiot’", "𝟙idiot😀", "x idiot y"]
    texts = [*signs, "ends in “", "idiot", "größter—", "ends in \"", "idiot", None, ""]
    want = [quoted if any(q for w, q in text_words(t) if w in model.terms) else plain if any(w in model.terms for w, _ in text_words(t)) else clean for t in texts]
    assert want[0] == want[1] == want[2] == quoted and want[3] == want[4] == plain
    assert list(Scorer(model).scores(pa.array(texts))) == want
    assert list(Scorer(model).scores(pa.array(["skipped“", *texts]).slice(1))) == want


def test_misspelled_forms_of_a_beginning():
    """op8: words that a learned beginning covers are found misspelled, in the first letter too."""
    from trackweave.llm.toxicity import fit

    forms = ["idiot", "idiots", "idiotic", "idiotically"]
    rng = random.Random(2)
    filler = lambda: " ".join("".join(rng.choice("pqrstuvwxyz") for _ in range(7)) for _ in range(6))
    rows = [(f"{filler()} {forms[i % 4]} {filler()}", 1) for i in range(80)] + [(filler(), 0) for _ in range(80)]
    model = fit(rows)
    assert any(t.endswith("*") and "idiot".startswith(t[:-1]) for t in model.terms)
    trie = model.trie()
    for word in ("idot", "idiat", "adiot", "xidiot", "diot", "idoits", "idiotc", "idotically", "jdiots"):
        term, edits = trie.find(word)
        assert (term >= 0 and model.terms[term].startswith("idiot"[:5]) and edits <= 1) == (word != "idoits"), word  # two edits
    assert trie.find("house") == (-1, 0)


def test_automaton_finds_what_a_table_finds():
    """op8: the automaton agrees with edit distances by table."""
    from trackweave.llm.toxicity import FUZZY, Model

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 7)))
    terms = sorted({word() for _ in range(40)})
    trie = Model(terms, [1.0] * len(terms), [0.5] * len(terms), {}, 0.0).trie()
    for w in {word() for _ in range(600)}:
        want = (terms.index(w), 0) if w in terms else (-1, 0)
        near = [i for i, t in enumerate(terms) if len(t) >= FUZZY and distance(w, t) == 1]
        if w not in terms and len(w) >= FUZZY - 1 and near:
            want = (min(near), 1)
        assert trie.find(w) == want


def test_languages_of_unlisted_scripts(spark):
    """op1: words of scripts without a listed block tell their language; words without letters tell none."""
    from trackweave.llm import langid

    lines = {"te": "ఇది ఒక మంచి ఇల్లు మరియు తోట", "kn": "ಇದು ಒಂದು ಒಳ್ಳೆಯ ಮನೆ ಮತ್ತು ತೋಟ", "km": "នេះ គឺជា ផ្ទះ ល្អ និង សួន", "am": "ይህ ጥሩ ቤት እና የአትክልት ስፍራ ነው", "en": "this is a good house and a garden"}
    rows = [(i, " ".join([t] * 4), lang) for i in range(10) for lang, t in lines.items()]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [*lines.values(), lines["te"] + " " + lines["en"], "12 — 34 € …", "𠀀𠀁 𠀂"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), m).collect()}
    assert [got[i].lang_pred for i in range(len(lines))] == list(lines)
    assert all(got[i].score == 1.0 for i in range(len(lines)))
    assert {got[5].lang_pred, got[5].second_lang} == {"te", "en"}
    assert (got[6].lang_pred, got[6].score) == ("und", 0.0) and got[7].score == 1.0
    stray = langid.predict(spark.createDataFrame([(1, "a good µm house ½ garden")], "doc_id long, text string"), m).first()
    assert (stray.lang_pred, stray.second_lang) == ("en", None)


def test_whole_licenses(spark):
    """op5: whole originals are known, however wrapped, with and without a title; only real claims are left out."""
    import textwrap

    from trackweave.llm import licenses

    wrap = lambda t, n: "\n\n".join(textwrap.fill(x, n) for x in t.split("\n"))
    mit, isc = licenses.KNOWN[0][1], licenses.KNOWN[1][1]
    want, rows = {}, []
    for name, text in [("MIT", mit), ("ISC", isc), ("MIT", mit.split("\n", 1)[1]), ("ISC", isc.split("\n", 1)[1])]:
        for n in range(50, 90, 3):
            rows.append((len(rows), f"Copyright (c) 2020, Some Body\nCopyright Other Body\n© 2021 Third\nAll rights reserved.\n\n{wrap(text, n)}"))
            want[rows[-1][0]] = name
    for path in licenses.TEXTS.glob("*.txt"):
        rows.append((len(rows), path.read_text().upper() if path.stem.startswith("BSD") else path.read_text()))
        want[rows[-1][0]] = path.stem
    rows.append((len(rows), "permission notice appear in all copies."))
    want[rows[-1][0]] = None
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MPL-2.0"} <= set(want.values())
    got = {r.doc_id: r.license for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_lines_of_a_wider_table(spark):
    """op5: a known line needs no word that the default table has."""
    from trackweave.llm import licenses

    docs = spark.createDataFrame([(1, "text\nDo what you want.\nmore")], "doc_id long, text string")
    for known in (licenses.known_digests(spark, (("X", "do what you want"),)), licenses.known_digests(spark, (("X", "do what you want"),)).drop("hint")):
        assert licenses.scan(docs, known).first().line_licenses == "X"


def test_one_of_each_class_stays_whatever_the_ids(spark):
    """op7 and the pipeline: texts that share an id, or have none, are classed by themselves."""
    from trackweave.llm import cpjoin

    rng = random.Random(9)
    t = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(5)]
    rows = [(None, t[0]), (None, t[1]), (5, t[2]), (5, t[3]), (6, t[4]), (7, t[4]), (6, t[4]), (8, t[0]), (None, None), (None, ""), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, x, n) for n, (i, x) in enumerate(rows)], "doc_id long, text string, n int")
    got = sorted(((r.doc_id, r.text) for r in cpjoin.keep_one(docs).collect()), key=str)
    assert got == sorted([(8, t[0]), (None, t[1]), (5, t[2]), (5, t[3]), (6, t[4]), (None, None), (None, ""), (9, None), (9, "")], key=str)


def test_equal_hashes_of_unlike_windows(spark, monkeypatch):
    """op3: words are compared, so windows that only share a hash are kept."""
    import pandas as pd
    import pyarrow as pa

    from trackweave.llm import rlz, tokens

    rng = random.Random(8)
    text = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    a, b = text(60), text(60)
    c = b[:10] + a[5:40] + b[10:30]
    docs = rlz._ordered(pa.Table.from_pandas(pd.DataFrame({"doc_id": [1, 2, 3], "text": [" ".join(x) for x in (a, b, c)], "block": [0, 0, 0]})))
    real = tokens.windows
    monkeypatch.setattr(tokens, "windows", lambda w, n: (real(w, n)[0], real(w, n)[1] % np.uint64(4)))  # hardly any hash tells windows apart
    m = rlz._matches(docs, pa.table({"block": pa.array([], pa.int32()), "value": pa.array([], pa.binary())}))
    out = {}
    rlz._parse_block(docs, m, lambda i, w, s, n, d, q: out.setdefault(i, list(zip(s.tolist(), n.tolist(), d.tolist(), q.tolist(), strict=True))))
    words = {1: a, 2: b, 3: c}
    for i, spans in out.items():
        assert all(words[i + 1][s : s + n] == words[d][q : q + n] and n >= rlz.WINDOW and d < i + 1 for s, n, d, q in spans)
    assert not out[0] and not out[1]


def test_mixed_documents_by_hand(spark):
    """The rows of the mix hold the words that report() says were taken, also of many equal rows, whose rounds are their own."""
    from trackweave.llm import mixing

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(3)) for _ in range(n))
    same = (7, "one and the same text here", "a")
    rows = [(100 + i, text(rng.randint(0, 60)), rng.choice("abc")) for i in range(200)] + [same] * 3000 + [(8, None, "a"), (9, "", None), (10, text(5000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = collections.Counter()
    for r in mixing.report(docs).collect():
        taken[r.doc_id] += r.taken
    got = collections.Counter()
    whole = {}
    for r in rows:
        whole.setdefault(r[0], collections.Counter()).update((r[1] or "").split())
    for r in mixing.mixed_documents(docs).collect():
        words = r.text.split()
        got[r.doc_id] += len(words)
        assert words and not collections.Counter(set(words)) - whole[r.doc_id]
    assert +got == +taken and got[7] > 0


def test_a_stored_map_is_used_and_edited(spark, tmp_path):
    """op9: a second call uses the stored map; drifted rows move few bytes as the next version; new slots find a shard."""
    from trackweave.llm import sharding

    rng = random.Random(12)
    rows = [(i, "x" * rng.randint(1, 200)) for i in range(3000)]
    path = str(tmp_path / "map")
    placed = lambda rs: {r.doc_id: r for r in sharding.shard(spark.createDataFrame(rs, "doc_id long, text string"), 6, 256, path).collect()}
    first = placed(rows)
    again = placed(rows)
    assert {i: (r.shard, r.slot) for i, r in first.items()} == {i: (r.shard, r.slot) for i, r in again.items()}
    assert spark.read.parquet(path).select("version").distinct().count() == 1
    # Shard 0 grows by a half.
    grown = [(i, t * 2 if first[i].shard == 0 and i % 2 else t) for i, t in rows]
    slot_of = {r.doc_id: r.vslot for r in sharding.with_slots(spark.createDataFrame(grown, "doc_id long, text string"), 256).collect()}
    after = placed(grown)
    was = {r.vslot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    newest = {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()}
    loads, stay, moved = collections.Counter(), collections.Counter(), 0
    for i, r in after.items():
        loads[r.shard] += r.size
        stay[was.get(slot_of[i], newest[slot_of[i]])] += r.size
        moved += r.size if slot_of[i] in was and was[slot_of[i]] != newest[slot_of[i]] else 0
    mean = sum(loads.values()) / 6
    assert max(stay.values()) > 1.05 * mean >= max(loads.values()) and loads.keys() == set(range(6))
    excess = sum(max(0, v - mean) for v in stay.values())
    assert 0 < moved <= 1.3 * excess
    assert spark.read.parquet(path).agg({"version": "max"}).first()[0] == 2
    places = collections.defaultdict(list)
    for r in after.values():
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
