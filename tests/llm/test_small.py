"""Odd tables: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpuslens.llm import _shared, _words, apportion, chat_tree, decontaminate, huffman, license_join, line_dedup, mih, ngram_join, queries, toxic_grammar, warc_index

LINE = "this line is long enough to count"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG = " ".join(f"w{i % 997} x{i}" for i in range(60_000))
DOCS = [
    (1, None, "a"), (2, "", None), (3, " \t\n ", "b"), (4, f"{LINE}\nA\n{LINE.upper()} ", "a"), (5, f"{LINE}\n", "a"), (6, f" {LINE}", "c"), (7, PASSAGE, "b"), (8, f"x {PASSAGE.title()} y", "b"),
    (9, "same words as the other one here", "a"), (10, "same words as the other one here", "a"), (11, LONG, "a"), (12, LONG + " tail", None), (13, "one", "a"), (14, "Released under the MIT License. Apache License, Version 2.0 CC BY-NC", "c"),
    (15, "trailing space \nand  two  spaces ", "a"), (16, "été ÉTÉ   \U0001f600", "a"), (17, "This work is licensed under the GNU General Public License, version 3.", "b"),
]
SCHEMA = "doc_id long, text string, source string, n_words long, score string, key int"


@pytest.fixture(scope="session")
def docs(spark):
    _shared.ready(spark)
    rows = [(*d, 1, "x", None) for d in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], SCHEMA)


PAIRS = [d[:2] for d in DOCS]


def rows(df, columns):
    return {tuple(r) for r in df.select(*columns.split()).collect()}


def test_decontaminate(spark, docs, none):
    bench = [(1, PASSAGE), (2, "same words"), (3, None), (4, ""), (None, "one"), (5, PASSAGE)]
    table = spark.createDataFrame(bench, "item_id long, text string")
    want = brute.op2(PAIRS, [("" if i is None else i, t) for i, t in bench])
    for blocks in (50_000, 2):  # one block, and several
        index = decontaminate.Index(spark, table, docs, block_items=blocks)
        got = decontaminate.annotate(docs, index)
        assert rows(got, "doc_id n_words n_hit n_items items_sha256 contaminated") == want
    left = decontaminate.clean(docs, index)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {w[0] for w in want if not w[5]}
    assert decontaminate.annotate(none, decontaminate.Index(spark, table, none)).count() == 0
    assert decontaminate.annotate(docs, decontaminate.Index(spark, table.limit(0), docs)).where("n_hit > 0").count() == 0


def test_partial_containment(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE.replace("fourteen", "xiv"))], "item_id long, text string")
    got = decontaminate.annotate(docs, decontaminate.Index(spark, bench, docs, window=14, containment=0.9)).where("n_hit > 0")
    assert {r.doc_id for r in got.collect()} == {7, 8}


def test_containment_is_of_sets(spark):
    """Against all stretches of a text that are as long as an item's window."""
    rng, vocabulary = random.Random(11), [f"v{i}" for i in range(9)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 14))) for _ in range(12)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(40)]
    texts += [" ".join((w := items[i % 12].split())[:4] + [rng.choice(vocabulary)] + w[5:]) for i in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    size, k, share = 8, 2, 0.6

    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for d, t in enumerate(texts):
        w, hit, found = t.split(), set(), set()
        for item, own in enumerate(items):
            own = own.split()
            m = min(size, len(own))
            for s in range(len(own) - m + 1):
                need = grams(own[s : s + m], min(k, m))
                for i in range(len(w) - m + 1):
                    if len(need & grams(w[i : i + m], min(k, m))) >= math.ceil(share * len(need) - 1e-9):
                        hit |= set(range(i, i + m))
                        found.add(item)
        want[d] = (len(w), len(hit), len(found))
    got = decontaminate.annotate(docs, decontaminate.Index(spark, bench, docs, window=size, shingle=k, containment=share, block_items=5))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got.collect()} == want and any(w[2] for w in want.values())


def test_license(spark, docs, none):
    got = license_join.scan(docs, license_join.Templates(docs))
    assert rows(got, "doc_id n_words n_base first_word last_word base_labels") == brute.op6(PAIRS)
    label = {r.doc_id: (r.labels, r.score) for r in got.collect()}
    assert label[17][0] == "gpl-3" and label[14][0] == "apache-2,cc-by-nc,mit" and label[1] == ("", 0.0) and all(0 <= s <= 1 for _, s in label.values())
    assert license_join.scan(none, license_join.Templates(none)).count() == 0


def test_lines(spark, docs, none):
    store = line_dedup.LineStore(spark)
    store.insert(docs)
    want = brute.op8(PAIRS)
    digest = lambda df: rows(df.withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256)), "doc_id n_lines n_dropped h")
    assert digest(line_dedup.dedup(docs, store)) == want and any(w[2] for w in want)
    assert digest(line_dedup.dedup(docs, store, filter_limit=-1)) == want  # lines dealt to the filters' shards
    store.delete(docs.where("doc_id = 6"))
    assert digest(line_dedup.dedup(docs, store)) == {(*w, ) for w in brute.op8([p for p in PAIRS if p[0] != 6])} | {w for w in brute.op8([p for p in PAIRS if p[0] == 6])}
    empty = line_dedup.LineStore(spark)
    empty.insert(none)
    assert line_dedup.dedup(none, empty).count() == 0


def test_lines_come_and_go(spark, docs):
    """Filters follow insertions and deletions; results are as if the store had been made at once."""
    some = [f"line number {i} of those that many texts have" for i in range(40)]
    rng = random.Random(3)
    texts = [(i, "\n".join(rng.choice([" ", "", "\t"]) + rng.choice([str.upper, str])(rng.choice(some)) + rng.choice([" ", "\x0b", ""]) for _ in range(rng.randrange(12)))) for i in range(60)] + [(None, some[0]), (None, some[1]), (7, "\n\n" + some[0]), (8, some[0] + "\n")]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    store = line_dedup.LineStore(spark, shard_keys=7)
    held = []
    for part, sign in ((range(0, 20), 1), (range(20, 60), 1), (range(5, 30), -1), (range(5, 12), 1)):
        own = table.where(F.col("doc_id").isin(*part))
        (store.insert if sign > 0 else store.delete)(own)
        held = [x for x in held if x not in part] + (list(part) if sign > 0 else [])
        now = [t for t in texts if t[0] in held]
        got = line_dedup.dedup(table.where(F.col("doc_id").isin(*held)), store).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256))
        assert sorted(map(tuple, got.collect())) == sorted(brute_op8_rows(now))
    files = store._made.files
    assert len(files) > 1 and store.filters(3).files == files  # nothing changed


def brute_op8_rows(texts):
    """Like brute.op8, with a row for each of the rows that repeat an id."""
    whole, out = {}, []
    for d, t in texts:
        whole.setdefault(d, []).append(t or "")
    for d, own in whole.items():
        others = [(e, "\n".join(x)) for e, x in whole.items()]
        kept = {w[0]: w for w in brute.op8(others)}
        if len(own) == 1:
            out.append(kept[d])
        else:
            held = [(e, t) for e, t in others if e != d] + [(d, "\n".join(own))]
            for t in own:
                out += [w for w in brute_one(held, d, t)]
    return out


def brute_one(held, doc, text):
    """What op 8 leaves of one text of a document, judged by all texts."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    has = {}
    for d, t in held:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                has.setdefault(key(x), set()).add(d)
    own = text.split("\n")
    kept = [x for x in own if not (len(has.get(key(x), ())) >= 3 and max(has[key(x)]) != doc)]
    return [(doc, len(own), len(own) - len(kept), brute.sha("\n".join(kept)))]


def test_cuckoo():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    made = line_dedup._built(keys)
    assert made.contains(keys).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    assert made.contains(other).mean() < 0.01
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01


def test_ngrams(spark, docs, none, monkeypatch):
    words = [f"v{i}" for i in range(200)]
    family = [(100 + i, " ".join(words[: 200 - i] + [f"n{i}_{j}" for j in range(i)])) for i in range(0, 60, 3)]
    copies = [(200 + i, " ".join(words)) for i in range(5)]
    more = spark.createDataFrame(family + copies, "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(more).persist()
    want = brute.op9(PAIRS + family + copies)
    for rule, part in ((ngram_join.Sets(), 512), (ngram_join.Sets(crowd=2), 512), (ngram_join.Sets(crowd=2, common=2), 3)):  # pairs, blocks, blocks of bands and parts
        monkeypatch.setattr(ngram_join, "PART", part)
        assert rows(ngram_join.join(whole, rule), "doc_id n_shingles component_id") == want
    again = spark.createDataFrame([(5, "a b c d e"), (5, "f g h i j"), (1, "a b c d e"), (5, "a b c d e"), (None, "f g h i j"), (None, "x")], "doc_id long, text string")
    assert sorted(map(str, ngram_join.join(again).collect())) == sorted(str(Row(doc_id=d, n_shingles=n, component_id=c)) for d, n, c in [(5, 2, 1), (5, 2, 5), (1, 2, 1), (5, 2, 1), (None, 2, 5), (None, 1, None)])
    assert ngram_join.join(none).count() == 0


def test_tree_join_is_exact():
    rng, rule = np.random.default_rng(3), ngram_join.Sets()
    base = rng.choice(10_000, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(200, 300)), replace=False), rng.choice(20_000, int(rng.integers(0, 40))).astype(np.uint64)])) for _ in range(40)]
    want = {frozenset((i, j)) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    links = ngram_join.tree_join(sets, rule)
    assert all(frozenset(p) in want for p in links)

    def classes(pairs):
        root = list(range(40))
        find = lambda i: i if root[i] == i else find(root[i])
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return [find(i) for i in range(40)]

    assert classes(links) == classes([tuple(p) for p in want])


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.fp: r.root for r in ngram_join.components(chain).collect()}
    assert all(got.get(i, 0) == 0 for i in range(51)) and got.get(101) == 100


def test_tokens(spark, docs, none):
    path = queries.tokenizer_path()
    files = huffman.write(docs, path, file_tokens=50_000, block_bytes=2000)
    assert rows(files.read(), "doc_id start n_tokens ids_crc32") == brute.op4(PAIRS, path)
    special = [(100 + i, t) for i, t in enumerate(["x <|endoftext|> y", "<|endoftext|>", " <|endoftext|> a b", "a  b ", " ", "a \n b", "a\u00a0 b \u3000c", "\u00ab a \u00bb", "it's 'll\tno"])]
    files = huffman.write(spark.createDataFrame(special, "doc_id long, text string").repartition(2), path)
    assert rows(files.read(), "doc_id start n_tokens ids_crc32") == brute.op4(special, path)
    repeated = spark.createDataFrame([(7, "a b"), (7, "a b"), (7, "c"), (None, "d e f"), (None, None), (1, "g")], "doc_id long, text string").repartition(3)
    got = sorted(huffman.write(repeated, path, file_tokens=1, block_bytes=1).read().collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 7, 7, 7] and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(6)]
    assert huffman.write(none, path).read().count() == 0


def test_huffman_codes():
    rng = np.random.default_rng(4)
    counts = np.concatenate([[0], (2.0 ** np.arange(40)).astype(np.int64), [0, 1, 1]])
    length = huffman.code_lengths(counts)
    assert length.max() <= 16 and (length[counts == 0] == 0).all() and np.sum(0.5 ** length[length > 0].astype(float)) <= 1
    codes = huffman.canonical(length)
    ids = rng.choice(np.flatnonzero(counts), 5000)
    n = np.array([0, 1, 1234, 3765])
    data, size, marks = huffman.pack(ids, n, codes)
    rows_ = [(i, int(n[i]), data[a : a + s], marks[i].astype("<u4").tobytes()) for i, (a, s) in enumerate(zip(np.cumsum(size) - size, size))]
    assert (huffman.read_block(huffman._block(rows_), codes)[2] == ids).all()


def test_pieces_are_the_texts_own_tokens(monkeypatch):
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(), random.Random(1)
    monkeypatch.setattr(huffman, "CACHED", 50)  # what is remembered is dropped time and again
    made = Tokenizer.from_file(path)
    some = [" ", " ", " ", "a", "bc", "\u00e9", "\n", "\t", "1", "'s", ".", "\u00a0", "\u3000", "\u2003", "\x1c", "\u0120", "<|endoftext|>", "\U0001f600", "\u180e", "\u200b", "\x85", "\x00"]
    for _ in range(30):
        texts = ["".join(rng.choices(some, k=rng.randrange(30))) for _ in range(60)]
        ids, n = huffman.encode_texts(pa.array([*texts, None]), path)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids + [0] for e in made.encode_batch([*texts, ""], add_special_tokens=False)]


def test_codes_of_many_symbols():
    rng = np.random.default_rng(5)
    counts = np.concatenate([rng.integers(1, 50, 100_000), [10**9, 10**7]])
    limit = huffman.widest(counts)
    length = huffman.code_lengths(counts, limit)
    codes = huffman.canonical(length, limit)
    assert 16 < length.max() <= limit <= 24
    ids = np.concatenate([rng.integers(0, 100_002, 3000), np.full(500, 100_000)])
    data, size, marks = huffman.pack(ids, np.array([3500]), codes)
    assert (huffman.read_block(huffman._block([(1, 3500, data, marks[0].astype("<u4").tobytes())]), codes)[2] == ids).all()


def test_words_that_a_polynomial_takes_for_one():
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    data = f"{a} {a.translate(str.maketrans('ab', 'ba'))} {a[:1024]} {a[1024:2048]} {a * 5}".encode()
    hashed = _words.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _words.ALNUM)[0]
    assert len(set(hashed.tolist())) == 5


def test_mix(spark, docs, none):
    table = [(d, s, t) for d, t, s in DOCS]
    size, target = brute.op5(table)
    got = apportion.mix(docs, shard_rows=4).collect()
    own = {}
    source = {d: s for d, s, _ in table}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == target[s][0] and r.target == pytest.approx(target[s][1]) and 0 <= r.taken <= 2 * r.size
        own[s] = own.get(s, 0) + r.taken
    for s, (n, t) in target.items():
        assert abs(own[s] - t) <= 32 * 6
    again = apportion.mix(docs.repartition(5), shard_rows=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert apportion.mix(none).count() == 0


def test_highest_quotients(spark):
    votes = [53, 24, 23, 0, 7, 7]
    for seats in (0, 1, 7, 30, 101):
        won = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[i] += 1
        df = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "tie long, v double, seats long")
        assert [r.quota for r in apportion.sainte_lague(df, ["seats"], "v", "seats").orderBy("tie").collect()] == won


def test_toxic(spark, docs, none):
    bad = [(1000 + i, "you are an idiot and a total loser. fine words" if i % 2 else "calm words of no harm here", i % 2) for i in range(60)]
    table = spark.createDataFrame([(d, t) for d, t, _ in bad], "doc_id long, text string").union(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(d, y) for d, _, y in bad] + [(None, 1), (1000, None)], "doc_id long, toxic int")
    model = toxic_grammar.fit(table, labels)
    score = {r.doc_id: r.score for r in toxic_grammar.score(table, model).collect()}
    assert all((score[d] >= 0.5) == bool(y) for d, _, y in bad) and score[1] < 0.5 and all(0 <= s <= 1 for s in score.values())
    left = toxic_grammar.reject(table, model)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {d for d, s in score.items() if s < 0.5}
    assert toxic_grammar.score(none, toxic_grammar.fit(none, labels.limit(0))).count() == 0


def clause(text):
    """Score of a clause without learned terms."""
    none = np.zeros(0, np.int64)
    model = toxic_grammar.Model(none.astype(np.uint64), none, none, 0, 0, (0.0, 0.0, 0.0, 0.0), 2.5)
    data = text.encode()
    return toxic_grammar._clauses(model, np.frombuffer(data, np.uint8), np.array([0, len(data)]), None)[3].sum()


def test_grammar():
    plain = clause("what an idiot")
    assert clause("not an idiot") < clause("said what an idiot") < plain < clause("you are an idiot") and clause("idiot idiot") == pytest.approx(2 * plain)
    assert clause("not one two three idiot") == plain and clause("they never one two idiot") < plain
    assert clause("kill time") < plain < clause("kill you") and clause("i will not kill you") < plain and clause("he said he would kill you") < clause("he would kill you")
    assert clause("shut up") == clause("oh shut shut up now") == plain and clause("shut it up") == clause("go to to hell") == 0 and clause("go to hell") == plain
    assert clause("nobody likes you") > 0 and clause("nobody is an idiot") < plain  # a phrase's word alone is what it is by itself


def test_composition_is_one_after_the_other():
    """The composed table against the transducers run one by one."""
    rng, parts, whole = np.random.default_rng(7), toxic_grammar.transducers(), toxic_grammar.grammar()
    common = [toxic_grammar.TARGET, toxic_grammar.NEGATION, toxic_grammar.REPORT, toxic_grammar.THREAT, toxic_grammar.TERM + 10, *range(toxic_grammar.WORD, toxic_grammar.SYMBOLS)]
    runs = [rng.choice([toxic_grammar.OTHER, *common], int(rng.integers(1, 40))) for _ in range(200)]
    want = []
    for run in runs:
        for t in parts:
            state, written = 0, []
            for x in run:
                written.append(t.out[state, x])
                state = t.next[state, x]
            run = written
        value = {toxic_grammar.DIRECT: toxic_grammar.DIRECT_WEIGHT} | {toxic_grammar.TERM + i: toxic_grammar.LOWEST * toxic_grammar.RATIO**i for i in range(toxic_grammar.LEVELS)}
        want.append(sum(value.get(int(x), 0.0) for x in run))
    assert whole.scores(np.concatenate(runs), np.array([len(r) for r in runs])) == pytest.approx(want, rel=1e-5)


def test_matched_clauses(spark, docs):
    model = toxic_grammar.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    table = spark.createDataFrame([(1, "Fine words. You are an Idiot, I say! Done\nshut up"), (2, None), (3, "nothing")], "doc_id long, text string")
    assert rows(toxic_grammar.clauses(table, model), "doc_id clause") == {(1, "You are an Idiot, I say"), (1, "shut up")}


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (2, 0, "user", "hi"), (2, 1, "assistant", "other [/INST] \\l <s>"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo </s>"), (4, 0, None, None), (4, 0, "assistant", ""), (5, 2, "system", "x" * 100_000), (5, 1, "ro\nle\\", "a\\"), (6, 0, "assistant", "é\U0001f600"), (7, 0, "user", None), (7, 0, "user", None)]


def test_chat(spark, docs):
    table = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, start string")
    for options in ({}, {"pack_chars": 40, "pack_leaves": 1}):
        packs = chat_tree.write(table, **options)
        assert rows(chat_tree.read(packs), "conv_id n_turns turns_sha256 loss_chars loss_sha256") == brute.op3(TURNS)
    whole = chat_tree.pack(table).collect()
    assert sum(len(r.text) for r in whole) < sum(r.formatted_chars for r in chat_tree.read(packs).collect())  # shared turns stand once
    for r in whole:
        for i, parent in enumerate(r.parent):
            if parent >= 0:
                assert r.attend[i][-1] == r.end[parent] and r.position[i] == r.position[parent] + r.end[parent] - r.start[parent]
        assert len(chat_tree.position_ids(r.asDict())) == len(r.text)
    assert chat_tree.read(chat_tree.write(table.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<s>", "</s>[INST] ok [/INST]", "\\l\\b", "<", "[INST", "a\nb\\n", "<</s>>"])
@pytest.mark.parametrize("role", ["user", "assistant", "", "a\nb\\n<s>"])
def test_turns_come_back(role, text):
    formatted, a, b = chat_tree.format_turn(role, text)
    assert chat_tree.parse_turn(formatted) == (role, text) and formatted.count("<s>") == formatted.count("</s>") == 1
    assert chat_tree.unescape(formatted[a:b]) == (text if role == "assistant" else "")


def test_warc(spark, docs):
    big = "<p>" + "x" * 200
    pages = [(1, "http://a.example.com/x", big), (2, "HTTP://User@A.example.com:80/y?q#f", big), (3, None, big), (4, "", None), (5, "http://b.org/ \n", ""), (6, "http://b.org", "short"), (7, "x", "short"), (8, "http://c.net/é", "é" * 60), (9, "http://c.net/é", "é" * 60)]
    table = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string")
    path = _shared.shared_dir(spark, "t")
    index = warc_index.CaptureIndex(spark, path, warc_index.write_archives(table, path, file_bytes=300), block_lines=2, shard_lines=3)
    got = warc_index.fetch(index.lookup(warc_index.keys_of(table)))
    assert rows(got, "page_id payload_bytes payload_digest record_type refers_to") == brute.op1([(p, h) for p, _, h in pages])
    assert index.lookup(spark.createDataFrame([("zz 1",), ("",)], "key string")).count() == 0
    none = warc_index.CaptureIndex(spark, path, warc_index.write_archives(table.limit(0), path))
    assert warc_index.fetch(none.lookup(warc_index.keys_of(table))).count() == 0
    assert warc_index.reversed_host_key("HTTP://User@A.Example.com:80/y?q#f") == "com,example,a)/y?q"


def test_probes_find_what_is_within_the_radius():
    """Inverted lists against all pairs, with few and many candidates."""
    rng = np.random.default_rng(10)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    q = codes[:40] ^ (np.uint16(1) << rng.integers(0, 16, (40, 4)).astype(np.uint16))
    dist = np.bitwise_count(q[:, None] ^ codes[None]).sum(2)
    block = mih.Block(codes)
    for radius in (0, 3, 4, 9, 20, 64):
        want = set(zip(*(x.tolist() for x in np.nonzero(dist <= radius))))
        assert set(zip(*(x.tolist() for x in block.within(q, radius)))) == want
        i, r = block.candidates(q, radius)
        assert len(want) <= len(i) == len(set(zip(i.tolist(), r.tolist())))
    assert len(block.candidates(q, 4)[0]) < 40 * 30  # lists are what decides which codes are compared


def test_neighbours(spark, docs):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 8)).tolist()
    v[40] = v[20]
    for i in range(60, 160):
        v[i] = v[60]
    table = [(i, x, "e") for i, x in enumerate(v)] + [(1000, None, "e"), (1020, [0.0] * 8, "e"), (1040, [None] * 8, "e"), (1060, [float("nan")] * 8, "e"), (1080, [], "e")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, score string")
    good = [(i, np.array(x, np.float32)) for i, x, _ in table[:300]]
    want, got = brute.op10(good), {}
    for r in sorted(mih.search(df).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9
    assert [a for a, _ in got[60]] == [a for a, _ in want[60]]
    assert mih.search(df.limit(0)).count() == 0
    assert mih.search(spark.createDataFrame(table[20:22], df.schema)).count() == 1


def test_repeated_rows_and_missing_ids(spark, docs):
    """Row-wise operators give each row its own result, whatever its id; counts follow the defined cases."""
    some = docs.where("doc_id IN (4, 7, 9, 14, 16)")
    odd = some.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, "same words")], "item_id long, text string")
    model = toxic_grammar.fit(odd, spark.createDataFrame([(4, 1), (4, 1), (7, 0)], "doc_id long, toxic int"))
    results = {
        "decontaminate": lambda d: decontaminate.annotate(d, decontaminate.Index(spark, bench, odd)),
        "license": lambda d: license_join.scan(d, license_join.Templates(odd)),
        "toxic": lambda d: toxic_grammar.score(d, model),
        "tokens": lambda d: huffman.write(d, queries.tokenizer_path()).read().drop("start"),
    }
    for name, run in results.items():
        by_id = {}
        for r in run(odd).collect():
            by_id.setdefault(r.doc_id, []).append(str(r[1:]))
        once = {r.doc_id: str(r[1:]) for r in run(some).collect()}
        assert all(by_id[i] == [x] * 2 for i, x in once.items()), name
        assert len(by_id[None]) == 6 and set(once.values()) <= set(by_id[None]), name
    got = apportion.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    store = line_dedup.LineStore(spark)
    store.insert(odd)
    left = line_dedup.dedup(odd, store).collect()
    assert len(left) == odd.count() and {r.text for r in left if r.doc_id == 7} == {PASSAGE}


def test_pages_without_ids_and_repeated(spark):
    big = "x" * 200
    table = spark.createDataFrame([(None, "http://a.b/", big), (3, "http://a.b/", big), (3, "http://a.b/", big), (1, None, None), (None, None, "")], "page_id long, url string, html string")
    path = _shared.shared_dir(spark, "t")
    index = warc_index.CaptureIndex(spark, path, warc_index.write_archives(table, path))
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc_index.fetch(index.lookup(warc_index.keys_of(table))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, "response", None), (3, "response", None), (3, "response", None), (1, "response", None), (None, "response", None)]))


def test_conversations_and_vectors_repeated(spark):
    turns = [(None, 0, "user", "hi"), (None, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.n_turns) for r in chat_tree.read(chat_tree.write(table)).collect()} == {(None, 2), (1, 2)}
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.5]), (None, [1.0, 1.0]), (2, [0.5, 1.0])]
    got = mih.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(20, 1, 1), (20, 2, 2)]
