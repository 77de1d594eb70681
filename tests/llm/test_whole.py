"""Cases where a part of the job used to be left out."""

import math
import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from corpuslens.llm import _shared, apportion, license_join, mih, queries, toxic_grammar

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module", autouse=True)
def _ready(spark):
    _shared.ready(spark)


def test_near_duplicates_are_five_words_and_eight_tenths(spark):
    body = [f"b{i}" for i in range(104)]
    tails = {1: 0, 2: 20, 3: 22, 4: 25, 5: 27, 6: 40}
    docs = [(d, " ".join(body + [f"t{d}_{i}" for i in range(n)])) for d, n in tails.items()] + [(7, "other words"), (8, None)]
    want = {d for d, _, c in brute.op9(docs, 5, 80, 100) if d == c}
    assert want == {1, 5, 6, 7, 8} and {d for d, _, c in brute.op9(docs) if d == c} != want
    left = STAGE["near_duplicates"](spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in left.collect()} == want


def test_near_duplicates_over_the_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in STAGE["near_duplicates"](spark, docs, small).collect()} == {d for d, _, c in brute.op9(pairs, 5, 80, 100) if d == c}


def licenses(text, containment=0.8):
    """labels, score by every line and every window of the text."""
    def holds(block, phrase):
        p = brute.words(phrase)
        return any(block[i : i + len(p)] == p for i in range(len(block) - len(p) + 1))

    w, best = brute.words(text), {}
    lines = [brute.words(x) for x in (text or "").split("\n")]
    for label, template, must in license_join.TEMPLATES:
        t = brute.words(template)
        size, want = math.ceil(len(t) / containment), set(t)
        need = math.ceil(containment * len(want)) if must or len(want) >= license_join.SHORT else len(want)
        for block in lines + [w[i : i + size] for i in range(len(w))]:
            n = len(want & set(block))
            if n >= need and all(any(holds(block, p) for p in group.split("|")) for group in must):
                best[label] = max(best.get(label, 0.0), n / len(want))
    base = {label for phrase, label in license_join.PHRASES.items() if holds(w, phrase)}
    return ",".join(sorted(base | set(best))), 1.0 if base else max(best.values(), default=0.0)


def wrapped(text, width):
    import textwrap

    return "\n".join(" * " + x for x in textwrap.wrap(text, width, break_long_words=False))


def test_licenses_across_lines_and_only_their_own(spark):
    texts = [(wrapped("Some words before. " + t + " and words after", width), label) for label, t, _ in license_join.TEMPLATES for width in (20, 40, 72, 80)]
    texts += [(x, "") for x in (
        "Released under the BSD License.", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Affero General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the Academic License, Version 2.0.", "", None,
    )]
    texts += [("Released under the terms of the MIT License.", "mit"), ("This work is licensed under the GNU General Public License v3.", "gpl-3")]
    rng = random.Random(7)
    vocabulary = [w for _, t, _ in license_join.TEMPLATES for w in t.split()] + ["BSD", "Lesser", "\n", "\n", "other"]
    noise = []
    for _ in range(150):
        w = rng.choice(license_join.TEMPLATES)[1].split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w)), rng.choice(vocabulary))
        noise.append(" ".join(rng.choices(vocabulary, k=rng.randrange(30)) + w))
    docs = spark.createDataFrame(list(enumerate([t for t, _ in texts] + noise)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.labels, r.score) for r in license_join.scan(docs, license_join.Templates(docs)).collect()}
    for i, (text, label) in enumerate(texts):
        assert got[i][0] == label, text
    for i, text in enumerate([t for t, _ in texts] + noise):
        assert got[i] == ((want := licenses(text))[0], pytest.approx(want[1])), text


def test_licenses_of_the_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    text = dict(map(tuple, docs.collect()))
    got = {r.doc_id: (r.labels, r.score) for r in license_join.scan(docs, license_join.Templates(docs)).collect()}
    assert {d: x[0] for d, x in got.items()} == {d: licenses(t)[0] for d, t in text.items()}
    assert all(got[d][1] == pytest.approx(licenses(t)[1]) for d, t in text.items())


def test_outliers_get_all_their_neighbours(spark):
    rng = np.random.default_rng(8)
    groups = [rng.normal(size=16) + 0.01 * rng.normal(size=(n, 16)) for n in [1000] + [60] * 30]
    v = np.concatenate(groups)[rng.permutation(2800)].astype(np.float32)
    v[:200:20] = 4 * rng.normal(size=(10, 16))
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>")
    got = {}
    for r in mih.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, 2800, 20)) and {len(x) for x in got.values()} == {20}
    want = brute.op10(list(enumerate(v)))
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9


def test_radius_is_fitted_to_the_vectors_that_are_kept(spark, monkeypatch):
    rng, seen, learn = np.random.default_rng(9), [], mih.learn
    monkeypatch.setattr(mih, "learn", lambda x, n_all, *a: seen.append((len(x), n_all)) or learn(x, n_all, *a))
    v = np.concatenate([rng.normal(size=(200, 8)), np.ones((1500, 8))])
    mih.search(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>"))
    assert seen == [(221, 221)]


def test_terms_of_rare_toxic_rows(spark):
    """2 % toxic; zorp in 40 % of toxic and 1 % of clean rows, much in all toxic and 6 % of clean rows, slur in few toxic and no clean rows."""
    rows = []
    for i in range(6000):
        toxic, j = i % 50 == 0, i // 50
        words = ["well", "then", "zorp" * (j % 5 < 2 if toxic else i % 100 == 1), "much" * (toxic or i % 50 in (2, 3, 4)), "slur" * (toxic and j % 6 == 0)]
        rows.append((i, " ".join(w for w in words if w), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels, key = table.drop("toxic"), table.drop("text"), lambda w: toxic_grammar._hash([w])[0]
    model = toxic_grammar.fit(docs, labels)
    assert set(model.terms) == {key("zorp"), key("much"), key("slur")} and 45 * model.n_toxic < model.n_clean < 53 * model.n_toxic
    score = {r.doc_id: r.score for r in toxic_grammar.score(spark.createDataFrame([(1, "well then"), (2, "well zorp then")], "doc_id long, text string"), model).collect()}
    assert score[2] > 10 * score[1]


def test_held_out_labels(spark):
    """op 7 on the labelled rows that nothing was learned from; some labels contradict the texts, so neither figure can be 1."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    rows = [(r.predicted, r.score, truth[r.doc_id]) for r in queries.op7_toxic_grammar(spark, sf).where("held_out").collect() if r.doc_id in truth]
    hit, said, toxic = sum(p and y for p, _, y in rows), sum(p for p, _, _ in rows), sum(y for _, _, y in rows)
    above = sum((a > b) + 0.5 * (a == b) for _, a, y in rows if y for _, b, z in rows if not z)
    figures = hit / said, hit / toxic, above / toxic / (len(rows) - toxic)
    assert figures[0] >= 0.97 and figures[1] >= 0.88 and figures[2] >= 0.95, figures


@pytest.mark.parametrize("shard_rows", [1, 4, 50])
def test_rare_sources_of_short_documents_reach_their_target(spark, shard_rows):
    docs = [(i, "big", " ".join(["w"] * (40 + i % 30))) for i in range(400)] + [(1000 + i, "rare", " ".join(["r"] * 10)) for i in range(30)] + [(2000 + i, None, "n" * (i % 2)) for i in range(90)]
    size, target = brute.op5(docs)
    source, own = {d: s for d, s, _ in docs}, {}
    for r in apportion.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), shard_rows=shard_rows).collect():
        assert 0 <= r.taken <= 2 * r.size == 2 * size[r.doc_id]
        own[source[r.doc_id]] = own.get(source[r.doc_id], 0) + r.taken
    assert all(abs(own[s] - t) <= 48 for s, (_, t) in target.items()), (own, target)


def test_sources_of_a_few_words_reach_their_target(spark):
    docs = [(i, "big", " ".join(["w"] * 120)) for i in range(100)] + [(500, "tiny", " ".join(["t"] * 8)), (501, "", "one two three"), (502, None, "four five six"), (502, None, "four five six")]
    size, target = brute.op5(docs[:-1] + [(503, *docs[-1][1:])])
    own = {}
    for r in apportion.mix(spark.createDataFrame([(*d[:2], d[2], 1) for d in docs], "doc_id long, source string, text string, step long")).collect():
        assert 0 <= r.taken <= 2 * r.size
        s = next(s for d, s, _ in docs if d == r.doc_id)
        own[s] = own.get(s, 0) + r.taken
    assert target["tiny"][1] == 16 and all(abs(own[s] - t) <= 1 for s, (_, t) in target.items()), (own, target)


def test_near_duplicates_go_by_row(spark):
    one, two, three, four = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    docs = [(1, one), (1, one), (5, one + " tail"), (5, two), (None, one), (None, two), (None, three), (None, three), (None, four), (7, four), (8, ""), (8, ""), (8, None), (9, "")]
    left = STAGE["near_duplicates"](spark, spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string").repartition(3), "")
    assert left.columns == ["doc_id", "text", "source"]
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(str(x) for x in spark.createDataFrame([(1, one), (5, two), (None, three), (7, four), (8, ""), (8, None), (9, "")], "doc_id long, text string").collect())


def test_source_mix_takes_rows_without_id(spark):
    docs = [(i if i % 2 else None, "ab"[i % 3 == 0], " ".join(["w"] * (50 + i))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    times = {}
    for r in STAGE["source_mix"](spark, df, "").collect():
        times[r.text] = times.get(r.text, 0) + 1
    want = {r.size: int(r.taken / r.size + 0.5) for r in apportion.mix(df).collect()}
    assert {len(t.split()): n for t, n in times.items()} == {n: t for n, t in want.items() if t} and any(d is None and t in times for d, _, t in docs)


ODD = "doc_id long, text string, lang string, source string, n_chars long, doc string, row string, text_hash long, size int, n long, fp long, carried string, tokens string"


def test_stages_on_odd_tables(spark, small):
    """Nulls anywhere, empty and long texts, repeated rows, columns with names that the stages use: none fails, rows go out as they came."""
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [(1, "clean words of no harm at all"), (1, "clean words of no harm at all"), (2, None), (None, None), (None, "some other words that stand here"), (None, "some other words that stand here"), (3, ""), (4, " \n\t"), (5, long), (6, long + " tail"), (6, "same id with other words in it"), (7, "one")]
    rows = [(d, t, None, "ab"[i % 2] if i % 3 else None, None, f"d{i}", None, i, None, i, None, "c", "t") for i, (d, t) in enumerate(texts)]
    table = spark.createDataFrame(rows, ODD).repartition(3)
    for docs in (table, table.limit(0), spark.createDataFrame([(None,) * 13], ODD)):
        for name, stage in STAGE.items():
            got = stage(spark, docs, small)
            if name == "token_files":
                assert got.count() == docs.count()
                continue
            assert got.columns == docs.columns
            came, gone = map(lambda df: sorted(map(repr, df.collect())), (docs, got))
            if name == "source_mix":
                assert set(gone) <= set(came)
            elif name == "near_duplicates":
                assert set(gone) <= set(came) and len(gone) == len(set(gone))
            else:
                assert gone == came
    left = STAGE["near_duplicates"](spark, table, small)
    assert sorted(str(r.doc_id) + ":" + str(r.text)[:4] for r in left.collect()) == ["1:clea", "2:None", "3:", "4: \n\t", "5:w0 w", "6:same", "7:one", "None:None", "None:some"]
