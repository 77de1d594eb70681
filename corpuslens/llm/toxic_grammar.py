"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: terms of a level (learned from labels, beside a small general list), words of phrases, threat verbs,
targets, negations, words of reported speech; all others are one symbol. Five transducers rewrite the symbols one after the other:

- insult: phrases of several words ("shut up") become a term of the phrases' level at their last word;
- threat: a threat verb becomes a term of low level, and a target that follows it within four words a direct threat;
- negation: terms within three words after a negation go down seven levels, direct threats become targets;
- target: terms within four words after a target go up one level;
- report: terms and direct threats within twelve words after a word of reported speech go down three levels.

Levels are a geometric scale, so going up and down multiplies a term's weight. Each transducer is a table of (state, symbol) -> state, symbol;
their composition is a table, too, and with the last symbols' weights one weighted automaton, through which all clauses that hold a
term, a verb or a phrase's key word go in step. A clause's score adds up the weights on its path. A document's features are its best
clause, all clauses, and how many of them there are, and a logistic model gives the probability.

Learning reads the texts of a bounded sample of labelled rows (``max_labelled``, those with the smallest hashes of
doc_id). Terms are words and their first four and five letters, counted by label over the sample;
a term's weight is its log-odds, and while fitting each row is scored without its own count. Terms under ``floor`` tell
nothing; all others are kept. Rows whose crc32(doc_id) mod 5 is 0 are held out and never learned from.

Defined cases: null or empty texts have no clause and get the model's lowest score; without labels of both kinds the general
list and fixed coefficients remain; labels that contradict each other count as toxic; repeated rows are scored one
by one; a very long text is worked on alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _words

#: General lists in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown dumb trottel abschaum widerlich connard ordure idiota imbécil basura".split()
PHRASES = ["shut up", "go to hell", "drop dead", "piece of garbage", "piece of dirt", "waste of space", "nobody likes you", "halt die klappe", "halt den mund", "fahr zur hölle", "ta gueule", "ferme ta gueule", "va te faire", "vete al infierno", "cierra la boca"]
THREATS = "kill destroy hurt beat smash töten umbringen zerstören tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours u he she they him his her their du dich dein ihr euch sie er tu toi ton vous votre il elle ils tú te tus usted ustedes él ella ellos".split()
NEGATIONS = "not no never none nobody isn't aren't don't won't without nicht nie kein keine ohne pas jamais aucun sans ni nunca sin ningún".split()
REPORTS = "said says say told claimed claims quoted quote wrote called alleged reported according sagte schrieb zitiert laut dit déclaré selon écrit dijo dice según escribió".split()
#: Words of phrases that are too common to look at every clause that holds one.
COMMON = set("up to of go die den te ta la al va zur you nobody".split())
STOPS = np.isin(np.arange(256), np.frombuffer(b".!?;\n", np.uint8))
PRIOR, SEED_WEIGHT, THREAT_WEIGHT, DIRECT_WEIGHT = 0.1, 4.0, 1.0, 5.0
#: Weight of a level is LOWEST * RATIO ** level.
LOWEST, RATIO, LEVELS = 0.1, 1.25, 28
OTHER, TARGET, NEGATION, REPORT, THREAT, DIRECT, TERM = range(7)
#: Words before a clause's first hit and after its last one that can matter.
BEFORE, AFTER = 16, 4

_phrases = [p.split() for p in PHRASES]
_lexicon = sorted({w for p in _phrases for w in p})
#: Symbols: the classes, the levels of terms, the words of phrases.
WORD = TERM + LEVELS
SYMBOLS = WORD + len(_lexicon)
_CLASSES = [(TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)]
_plain = {w: c for c, ws in _CLASSES for w in ws}


def level(weight: np.ndarray) -> np.ndarray:
    """The level whose weight is nearest."""
    return np.clip(np.rint(np.log(np.maximum(weight, 1e-9) / LOWEST) / np.log(RATIO)), 0, LEVELS - 1).astype(np.int64)


class Transducer(NamedTuple):
    """Deterministic letter transducer: tables of the next state and the symbol written, by state and symbol read. State 0 is the first."""

    next: np.ndarray
    out: np.ndarray

    @classmethod
    def copying(cls, states: int) -> Transducer:
        """Writes what it reads and goes back to state 0."""
        return cls(np.zeros((states, SYMBOLS), np.int64), np.tile(np.arange(SYMBOLS), (states, 1)))

    def compose(self, other: Transducer) -> Transducer:
        """other reads what self writes; its states are pairs."""
        n, symbols = len(other.next), self.out[:, None, :]
        inner = np.arange(n)[None, :, None]
        both = self.next[:, None, :] * n + other.next[inner, symbols]
        return Transducer(both.reshape(-1, SYMBOLS), other.out[inner, symbols].reshape(-1, SYMBOLS))


def _phrases_to_terms() -> Transducer:
    """An automaton of all phrases' beginnings; the symbol of a word that ends a phrase becomes a term, others what the word is by itself."""
    of = {w: WORD + i for i, w in enumerate(_lexicon)}
    wanted = [tuple(of[w] for w in p) for p in _phrases]
    starts = sorted({p[:i] for p in wanted for i in range(len(p))}, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(starts)}
    made = Transducer.copying(len(starts))
    made.out[:, WORD:] = [_plain.get(w, OTHER) for w in _lexicon]
    for state, start in enumerate(starts):
        for symbol in range(WORD, SYMBOLS):
            read = (*start, symbol)
            ends = [read[i:] for i in range(len(read))]
            if any(e in wanted for e in ends):
                made.out[state, symbol] = TERM + level(np.array(SEED_WEIGHT))
            made.next[state, symbol] = next((number[e] for e in ends if e in number), 0)
    return made


def _threats_to_terms(window: int = 4) -> Transducer:
    made = Transducer.copying(window + 1)
    made.next[1:] = np.arange(window)[:, None]
    made.out[:, THREAT] = TERM + level(np.array(THREAT_WEIGHT))
    made.next[:, THREAT] = window
    made.out[1:, TARGET] = DIRECT
    return made


def _after(trigger: list[int], window: int, shift: int, direct: int | None) -> Transducer:
    """Moves the levels of terms within so many words after a trigger; direct: what direct threats become there."""
    made = Transducer.copying(window + 1)
    made.next[1:] = np.arange(window)[:, None]
    moved = np.arange(LEVELS) + shift
    made.out[1:, TERM:WORD] = np.where(moved < 0, OTHER, TERM + np.minimum(moved, LEVELS - 1))
    made.next[:, trigger] = window
    if direct is not None:
        made.out[1:, DIRECT] = direct
    return made


class Automaton(NamedTuple):
    """What the composition does to a clause: next state and weight by state and symbol."""

    next: np.ndarray
    weight: np.ndarray

    def scores(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Weight of the path of each run of so many symbols."""
        out = np.zeros(len(size))
        order = np.argsort(-size, kind="stable")
        first = (np.cumsum(size) - size)[order]
        state = np.zeros(len(size), np.int64)
        for step, n in enumerate(np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")):
            read = symbols[first[:n] + step]
            out[order[:n]] += self.weight[state[:n], read]
            state[:n] = self.next[state[:n], read]
        return out


def transducers() -> list[Transducer]:
    """Insult, threat, negation, target, report."""
    report = _after([REPORT], 12, -3, TERM + int(level(np.array(DIRECT_WEIGHT))) - 3)
    return [_phrases_to_terms(), _threats_to_terms(), _after([NEGATION], 3, -7, TARGET), _after([TARGET, DIRECT], 4, 1, None), report]


@cache
def grammar() -> Automaton:
    whole, *rest = transducers()
    for t in rest:
        whole = whole.compose(t)
    value = np.zeros(SYMBOLS, np.float32)
    value[DIRECT] = DIRECT_WEIGHT
    value[TERM:WORD] = LOWEST * RATIO ** np.arange(LEVELS)
    return Automaton(whole.next.astype(np.int32), value[whole.out])


def _hash(words: list[str]) -> np.ndarray:
    """Words with a sign inside (isn't) stand in texts as two; their first part is taken."""
    found = []
    for w in words:
        data = w.encode()
        found.append(_words.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _words.ALNUM)[0][0])
    return np.array(found, np.uint64)


_symbol_of = {int(h): c for c, ws in _CLASSES for h in _hash(ws)} | {int(h): WORD + i for i, h in enumerate(_hash(_lexicon))}
_SYMBOL_KEY = np.array(sorted(_symbol_of), np.uint64)
_SYMBOL_OF = np.array([_symbol_of[int(h)] for h in _SYMBOL_KEY])
_SEED_KEY = np.unique(_hash(INSULTS))
#: Symbols that make a clause worth reading.
_TELLING = np.zeros(SYMBOLS, bool)
_TELLING[[THREAT, *range(TERM, WORD), *(WORD + i for i, w in enumerate(_lexicon) if w not in COMMON)]] = True


def _at(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    where = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[where] == values, where, -1)


def _stems(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hash of the first n letters of each word; 0 for words that aren't longer."""
    b = _words.LOWER[data]
    lead = (b & 0xC0) != 0x80
    chars = np.flatnonzero(lead)
    nth = np.cumsum(lead)[start] - 1 + n
    stop = chars[np.minimum(nth, len(chars) - 1)] if len(chars) else nth
    long = (nth < len(chars)) & (stop < end)
    out = np.zeros(len(start), np.uint64)
    out[long] = _words.mix(_words.hash_spans(_words._BYTE[b], start[long], stop[long]) + np.uint64(n))
    return out


def _terms(data: np.ndarray, at: np.ndarray) -> tuple:
    hashed, start, end, bounds = _words.words(data, at, _words.ALNUM)
    if not len(hashed):
        return [hashed] * 3, start, end, bounds
    return [hashed, _stems(data, start, end, 5), _stems(data, start, end, 4)], start, end, bounds


class Model(NamedTuple):
    """Sorted term hashes with the counts of toxic and other documents, the documents of each kind, and the coefficients."""

    terms: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: int
    n_clean: int
    beta: tuple[float, ...]
    floor: float


def _odds(model: Model, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    return np.log((toxic + PRIOR) / (n_toxic + 2 * PRIOR)) - np.log((clean + PRIOR) / (n_clean + 2 * PRIOR))


def _clauses(model: Model, data: np.ndarray, at: np.ndarray, labels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte, byte after the last, and score of each clause that scores; with labels, each text's own count is taken out first."""
    terms, start, end, bounds = _terms(data, at)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    weight = np.where(_at(_SEED_KEY, terms[0]) >= 0, SEED_WEIGHT, 0.0)
    for h in terms:
        where = _at(model.terms, h)
        hit = np.flatnonzero((where >= 0) & (h != 0))
        w, gone = where[hit], 0 if labels is None else 1
        y = 0 if labels is None else labels[text[hit]]
        toxic, clean = model.toxic[w] - gone * y, model.clean[w] - gone * (1 - y)
        odds = _odds(model, toxic, clean, model.n_toxic, model.n_clean)
        weight[hit] = np.maximum(weight[hit], np.where((toxic >= 3) & (odds >= model.floor), odds, 0.0))
    symbol = np.full(len(weight), OTHER)
    known = np.flatnonzero((where := _at(_SYMBOL_KEY, terms[0])) >= 0)
    symbol[known] = _SYMBOL_OF[where[known]]
    hits = np.flatnonzero(weight > 0)
    symbol[hits] = TERM + level(weight[hits])
    telling = np.flatnonzero(_TELLING[symbol])
    if not len(telling):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    clause = np.searchsorted(np.flatnonzero(STOPS[data]), start) + text  # grows at every stop and every new text
    first = np.flatnonzero(np.diff(clause, prepend=-1))
    last = np.append(first[1:], len(clause))
    of = np.searchsorted(first, telling, "right") - 1
    head = np.flatnonzero(np.diff(of, prepend=-1))
    own = of[head]
    lo = np.maximum(first[own], telling[head] - BEFORE)
    hi = np.minimum(last[own], telling[np.append(head[1:], len(of)) - 1] + 1 + AFTER)
    size = hi - lo
    score = grammar().scores(symbol[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size)
    some = score > 0
    own = own[some]
    return text[first[own]], start[first[own]], end[last[own] - 1], score[some]


def features(model: Model, column: pa.Array, labels: np.ndarray | None = None) -> np.ndarray:
    """(best clause, log of all clauses, log of their number) of each text."""
    out = np.zeros((len(column), 3))
    for lo, hi, data, at in _words.pieces(column):
        text, _, _, score = _clauses(model, data, at, None if labels is None else labels[lo:hi])
        np.maximum.at(out[:, 0], lo + text, score)
        out[lo:hi, 1] = np.bincount(text, score, hi - lo)
        out[lo:hi, 2] = np.bincount(text, minlength=hi - lo)
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1]), grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 40_000, floor: float = 2.5) -> Model:
    """Learn terms and coefficients from at most max_labelled labelled rows that aren't held out."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "_id").select("t", "_y")
    with _shared.scope(docs.sparkSession):
        return _learn(_shared.saved(sample, "labelled"), floor)


def _learn(sample: DataFrame, floor: float) -> Model:
    """The model of texts (t) with labels (_y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            keys, tallies = [], []
            for lo, _, data, at in _words.pieces(batch.column(0)):
                terms, _, _, bounds = _terms(data, at)
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for h in terms:
                    pair = np.unique(np.stack([h[h != 0], text[h != 0].astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                    keys.append(pair[0])
                    tallies.append(y[lo + pair[1].astype(np.int64)])
            key, at_ = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_inverse=True)
            label = np.concatenate([*tallies, np.zeros(0, np.int64)])
            n1 = np.bincount(at_, label, len(key)).astype(np.int64)
            n = np.bincount(at_, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n1), pa.array(n - n1)], names=["term", "toxic", "clean"])

    tallies = sample.mapInArrow(_shared.lean(count), "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    of = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    n_toxic, n_clean = of.get(1, 0), of.get(0, 0)
    rate = F.log((F.col("toxic") + PRIOR) / (n_toxic + 2 * PRIOR))
    odds = lambda clean: rate - F.log((clean + PRIOR) / (n_clean + 2 * PRIOR))
    # a term under the floor isn't needed, not even while a clean row is scored without its own count; as many are left as the sample has words at most
    kept = tallies.where("toxic >= 3").where(odds(F.greatest(F.col("clean") - 1, F.lit(0))) >= floor - 1e-9).toArrow()
    term, toxic, clean = kept["term"].to_numpy().view(np.uint64), kept["toxic"].to_numpy().astype(np.int64), kept["clean"].to_numpy().astype(np.int64)
    order = np.argsort(term)
    model = Model(term[order], toxic[order], clean[order], n_toxic, n_clean, (-4.0, 1.0, 0.5, 0.5), floor)
    if model.n_toxic < 3 or model.n_clean < 3:
        return model

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy().astype(np.int64)
            x = features(model, batch.column(0), y)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), pa.array(y, pa.int32())], names=["a", "b", "c", "y"])

    seen = sample.mapInArrow(_shared.lean(observe), "a double, b double, c double, y int").groupBy("a", "b", "c", "y").count().toArrow()
    x = np.column_stack([seen[c].to_numpy() for c in "abc"])
    n, y = seen["count"].to_numpy(), seen["y"].to_numpy()
    order = np.lexsort((y, *x.T))  # the same sums whatever order the rows come in
    return model._replace(beta=_logistic(np.repeat(x[order], n[order], axis=0), np.repeat(y[order], n[order])))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    x = features(model, column)
    return 1 / (1 + np.exp(-np.clip(model.beta[0] + x @ np.array(model.beta[1:]), -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_shared.lean(run), f"doc_id {kind}, score double")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) < threshold))

    return docs.mapInArrow(_shared.lean(run), docs.schema)


def clauses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, clause, score of the clauses that the grammar matched."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in _words.pieces(batch.column(1)):
                text, start, end, score = _clauses(model, data, at, None)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + text)), pa.array([data[a:b].tobytes().decode() for a, b in zip(start, end)], pa.string()), pa.array(score)], names=["doc_id", "clause", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_shared.lean(run), f"doc_id {kind}, clause string, score double")
