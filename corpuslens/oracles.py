"""The registered queries in SQL, which DuckDB can run over the same tables."""

from __future__ import annotations

from .functions import constants as C
from .operators import metrics
from .queries import _FLAT, EVIDENCE_HEADS, HEADS


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tok(e: str) -> str:
    w = r"[\p{L}\p{N}_]"
    parts = rf"string_split_regex(regexp_replace(lower({e}), '({w})-({w})', '\1_\2', 'g'), '[^\p{{L}}\p{{N}}_]+')"
    return f"list_filter(list_transform(list_filter({parts}, lambda x: regexp_full_match(x, '[a-z0-9_]{{2,}}')), lambda x: replace(x, '_', '-')), lambda x: length(x) <= 3 OR NOT list_contains({_list(C.DROPPED)}, x))"


_ABBR = "MAP {" + ", ".join(f"'{k}': {_list([t for t in v.split() if len(t) > 1])}" for k, v in C.ABBREVIATIONS.items()) + "}"


def _exp(tokens: str) -> str:
    return f"list_sort(list_distinct(list_concat({tokens}, flatten(list_transform({tokens}, lambda t: coalesce(map_extract_value({_ABBR}, t), CAST([] AS VARCHAR[])))))))"


_WS = r"[\s\x{00a0}\x{0085}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0B]"


def _clean(e: str) -> str:
    w = r"[\p{L}\p{N}_]"
    for pattern, to in [(f"{_WS}+", " "), (rf"({w})-{_WS}+({w})", r"\1\2"), (r"\[\d+\]", ""), (rf"([A-Za-z%])\.\d{{1,3}}(?:,\d{{1,3}})*({_WS}+[A-Za-z])", r"\1.\2"), (rf"([A-Za-z])(?:,\d{{1,3}})+({_WS}+[a-z])", r"\1\2"), (r"([.)]) \d{1,3}(?: , \d{1,3})* ([A-Za-z])", r"\1 \2"), (r" \d{1,3}(?: , \d{1,3}){2,} ([A-Za-z])", r" \1"), (r"([A-Za-z]), \d{1,3}(?: , \d{1,3})* ([a-z])", r"\1 \2"), (f"{_WS}+", " ")]:
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return f"trim({e})"


def _sent(e: str) -> str:
    guards = "|".join(g.replace(".", r"\.") for g in C.SENTENCE_GUARDS)
    safe = rf"regexp_replace({e}, '({guards})\.', '\1<DOT>', 'g')"
    cut = rf"regexp_replace({safe}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(replace(s, '<DOT>', '.'))), lambda s: s <> '')"


def _intent(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower({e}), '{t}')" for t in triggers)} THEN '{name}'" for name, triggers in C.INTENTS.items()) + " ELSE 'general' END"


def _distinct(e: str) -> str:
    """Distinct entries of a list, first places kept."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def _index(chunks: str) -> str:
    """Index tables of chunks c (id, ord, tokens): lengths, postings, vocabulary with first places, sizes."""
    return f"""c AS ({chunks}), dl AS (SELECT id, ord, len(tokens) AS dl FROM c),
tp AS (SELECT id, ord, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM c), p AS (SELECT id, term, count(*) AS tf FROM tp GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
vf AS (SELECT v.term, df, left(v.term, {C.PREFIX_LEN}) AS prefix, row_number() OVER (PARTITION BY left(v.term, {C.PREFIX_LEN}) ORDER BY first) AS nth FROM v JOIN (SELECT term, min((ord, pos)) AS first FROM tp GROUP BY term) USING (term))"""


def _hits(out: str, k: int, terms: str = "q") -> str:
    """The k best chunks for the terms of each question, with stand-ins for those that no chunk has."""
    return f"""lk AS (SELECT item_id, term, 1.0::DOUBLE AS w, term AS shown FROM {terms} WHERE term IN (SELECT term FROM v)
  UNION ALL SELECT item_id, vf.term, {C.PREFIX_WEIGHT}::DOUBLE, '~' || vf.term FROM {terms} t JOIN vf ON left(t.term, {C.PREFIX_LEN}) = prefix AND nth <= {C.PREFIX_TERMS} WHERE length(t.term) >= {C.PREFIX_MIN} AND t.term NOT IN (SELECT term FROM v)),
h AS (SELECT item_id, id, ord, round(sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, array_to_string(list_slice(list_sort(list_distinct(list(shown))), 1, 8), ' ') AS match_terms
  FROM lk JOIN v USING (term) JOIN p USING (term) JOIN dl USING (id), s GROUP BY ALL),
{out} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord) AS rank FROM h QUALIFY rank <= {k})"""


_QUESTIONS = f"""qa AS (SELECT item_id, {_tok("text")} AS tokens, text FROM benchmark), qe AS (SELECT item_id, text, tokens, {_exp("tokens")} AS expanded, {_intent("text")} AS intent FROM qa),
q AS (SELECT item_id, unnest(expanded) AS term FROM qe)"""
#: Documents as chunks of one.
_DOCS = _index(f"SELECT doc_id AS id, doc_id AS ord, {_tok("coalesce(text, '')")} AS tokens, 'Body' AS section, coalesce(text, '') AS text FROM documents")
_BM25 = f"{_DOCS}, {_QUESTIONS}, {_hits('b', 15)}"
_HASH = r"""hw AS (SELECT 'q' AS side, item_id AS id, unnest(string_split_regex(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS w FROM benchmark
  UNION ALL SELECT 'd', doc_id, unnest(string_split_regex(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) FROM documents),
hc AS (SELECT side, id, ('0x' || right(md5(w), 2))::INT % 64 AS bucket, count(*)::DOUBLE AS c FROM hw WHERE w <> '' GROUP BY ALL),
hv AS (SELECT side, id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY side, id)) AS weight FROM hc)"""


def _hashed(out: str, k: int) -> str:
    return f"""{_HASH},
hs AS (SELECT a.id AS item_id, b.id AS id, round(sum(a.weight * b.weight), 6) AS score FROM hv a JOIN hv b ON a.bucket = b.bucket AND a.side = 'q' AND b.side = 'd' GROUP BY ALL),
{out} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM hs QUALIFY rank <= {k})"""


def _fused(one: str, two: str, out: str, k: int) -> str:
    return f"""{out}_all AS (SELECT coalesce(x.item_id, y.item_id) AS item_id, coalesce(x.id, y.id) AS id, x.rank AS r1, y.rank AS r2, round(coalesce(1.0 / ({C.RRF_K} + x.rank), 0) + coalesce(1.0 / ({C.RRF_K} + y.rank), 0), 9) AS score
  FROM {one} x FULL JOIN {two} y ON x.item_id = y.item_id AND x.id = y.id),
{out} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST, id) AS rank FROM {out}_all QUALIFY rank <= {k})"""


def _weights() -> str:
    named = ", ".join(f"'{i}'" for i in C.SECTION_WEIGHTS if i != "general")
    same = lambda i: f"intent NOT IN ({named})" if i == "general" else f"intent = '{i}'"
    return "CASE " + " ".join(f"WHEN {same(i)} AND section = '{part}' THEN {w}" for i, weights in C.SECTION_WEIGHTS.items() for part, w in weights.items() if w != 1.0) + " ELSE 1.0 END"


def _reranked(of: str, out: str, k: int = 5) -> str:
    return f"""{out}_in AS (SELECT x.item_id, x.id, x.rank AS first_rank, x.score, intent, section, expanded, list_distinct(c.tokens) AS own, list_filter(expanded, lambda t: NOT list_contains({_list(C.GENERIC_TERMS)}, t)) AS telling FROM {of} x JOIN qe USING (item_id) JOIN c USING (id)),
{out}_sc AS (SELECT item_id, id, first_rank, round(score * {_weights()} * (1 + CASE WHEN len(own) > 0 THEN len(list_intersect(expanded, own)) / len(own) ELSE 0 END * 0.4) * (1 + 0.05 / greatest(first_rank, 1))
  * CASE WHEN len(telling) = 0 THEN 1.0 WHEN len(list_intersect(telling, own)) = 0 THEN {C.MISSED_FACTOR} ELSE {C.MATCH_BASE} + {C.MATCH_SHARE} * len(list_intersect(telling, own)) / len(telling) END, 6) AS score FROM {out}_in),
{out} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first_rank) AS rank FROM {out}_sc QUALIFY rank <= {k})"""


_RERANK = _reranked("b", "rt")
_QRELS = "qr AS (SELECT item_id, doc_id, 2 AS grade FROM benchmark, documents WHERE contains(documents.text, benchmark.text))"


def _support(e: str) -> str:
    any_of = lambda patterns: " OR ".join(f"regexp_matches(lower({e}), '{p}')" for p in patterns)
    return f"CASE WHEN {any_of(C.CONTRADICTORY)} THEN 'contradictory' WHEN {any_of(C.DIRECT)} THEN 'direct' ELSE 'indirect' END"


def _pick(words: list[str], key: str) -> str:
    return f"list_extract({_list(words)}, CAST({key} % {len(words)} + 1 AS BIGINT))"


def _section(e: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, '(?i)^(?:{p})') THEN '{name}'" for p, name in C.SECTIONS) + " ELSE 'Body' END"


def _follow() -> str:
    ask = lambda kind: "[" + ", ".join(f"replace('{q}', '{{entity}}', subject)" for q in C.FOLLOW_UPS[kind]) + "]"
    cases = " ".join(f"WHEN intent = '{k}' THEN {ask(k)}" for k in C.FOLLOW_UPS if k != "general")
    return f"CASE {cases} ELSE {ask('general')} END"


def _entities(e: str) -> str:
    e = rf"regexp_replace({e}, '[^\x00-\x7F]', '_', 'g')"  # RE2's \b doesn't know other letters; _ is one to it
    return f"list_filter(regexp_extract_all({e}, '{C.ENTITY}'), lambda x: NOT list_contains({_list(C.NOT_ENTITIES)}, x))"


def _key_terms(text: str, tokens: str) -> str:
    """At most six of four names, two statistics and three terms of the question."""
    plain = rf"regexp_replace({text}, '[^\x00-\x7F]', '_', 'g')"  # RE2's \b doesn't know other letters
    names, numbers = f"list_slice(regexp_extract_all({plain}, '{C.KEY_ENTITY}'), 1, 4)", f"list_slice(regexp_extract_all({text}, '{C.STATISTICS}'), 1, 2)"
    terms = f"list_slice(list_filter({tokens}, lambda t: length(t) > 3 AND contains(lower({text}), t)), 1, 3)"
    return f"list_slice({_distinct(f'list_concat(list_concat({names}, {numbers}), {terms})')}, 1, 6)"


def _relevance(score: str) -> str:
    return f"round(least(1.0, {score} / greatest(first_value({score}) OVER (PARTITION BY item_id ORDER BY rank), 0.01)), 3)"


def _cut(text: str, parts: str, most: int) -> str:
    """The longest run of first sentences within so many characters; the raw beginning where not even one fits."""
    fit = f"len(list_filter(range(1, len({parts}) + 1), lambda i: length(array_to_string(list_slice({parts}, 1, i), ' ')) <= {most}))"
    return f"CASE WHEN length({text}) <= {most} THEN {text} WHEN {fit} > 0 THEN array_to_string(list_slice({parts}, 1, {fit}), ' ') ELSE left({text}, {most}) END"


#: Sentence windows, a sentence of each document at a time. pre: characters before each sentence, without blanks.
_CHUNKS = f"""sn AS (SELECT doc_id, {_sent(_clean("text"))} AS l FROM documents WHERE text IS NOT NULL),
sm AS (SELECT doc_id, l, list_transform(l, lambda x: length(x)) AS n, list_transform(l, lambda x: {_section("trim(string_split(x, chr(10))[1])")}) AS sec FROM sn WHERE len(l) > 0),
sx AS (SELECT *, list_transform(range(0, len(l) + 1), lambda i: coalesce(CAST(list_sum(list_slice(n, 1, i)) AS BIGINT), 0)) AS pre FROM sm),
wd(doc_id, i, first, used, section, position, a, z, u, at_, sect) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 'Body', 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM sx
  UNION ALL SELECT doc_id, i + 1, CASE WHEN cut THEN back ELSE first END, CASE WHEN cut THEN pre[i + 1] - pre[back + 1] ELSE used END + coalesce(n[i + 1], 0), now_, position + coalesce(n[i + 1], 0) + 1,
    CASE WHEN cut OR i = len(l) THEN first END, CASE WHEN cut OR i = len(l) THEN i END, used, position, now_
  FROM (SELECT *, CASE WHEN cut THEN coalesce(list_min(list_filter(range(first, i), lambda b: pre[i + 1] - pre[b + 1] + i - b - 1 <= 64)), i) END AS back
    FROM (SELECT wd.doc_id, i, first, used, position, l, n, pre, CASE WHEN i < len(l) AND sec[i + 1] <> 'Body' THEN sec[i + 1] ELSE section END AS now_, i < len(l) AND used + n[i + 1] > 512 AND i > first AS cut FROM wd JOIN sx ON wd.doc_id = sx.doc_id WHERE i <= len(l)))),
ck AS (SELECT wd.*, row_number() OVER (PARTITION BY wd.doc_id ORDER BY z) AS no_, array_to_string(list_slice(l, a + 1, z), ' ') AS text FROM wd JOIN sx ON wd.doc_id = sx.doc_id WHERE z > a AND pre[z + 1] - pre[a + 1] + z - a - 1 >= 80),
ch AS (SELECT left(md5(doc_id || ':' || at_), 12) AS id, CAST(doc_id AS VARCHAR) AS doc_id, (CAST(doc_id AS VARCHAR), no_) AS ord, sect AS section, CAST(greatest(1, at_ // 2500 + 1) AS INTEGER) AS page, CAST(at_ - u AS INTEGER) AS char_start, CAST(at_ AS INTEGER) AS char_end, text, {_tok("text")} AS tokens, CAST(doc_id AS VARCHAR) AS title FROM ck)"""


def _common(of: str) -> str:
    """Of each question's six most frequent key terms of rows (item_id, terms) those in two rows or more."""
    return f"""ct AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(terms) AS term FROM {of}) GROUP BY ALL),
co AS (SELECT item_id, list(term ORDER BY n DESC, term) FILTER (WHERE n >= 2 AND r <= 6) AS common FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS r FROM ct) GROUP BY item_id)"""


def _excerpt(most: int) -> str:
    cut = _cut("excerpt", "parts", most)
    return f"({cut}) || CASE WHEN length({cut}) < length(excerpt) THEN '...' ELSE '' END"


def _listed(kind: str, most: int) -> str:
    """Up to three rows of a kind, numbered."""
    return f"string_agg('[' || r || '] ' || title || ' (' || section || '): ' || {_excerpt(most)}, chr(10) || chr(10) ORDER BY r) FILTER (WHERE kind = '{kind}' AND r <= 3)"


_GAPS = f"""list_slice(list_concat(list_transform(list_filter(entities, lambda x: NOT contains(coalesce(covered, ''), lower(x))), lambda x: 'The indexed documents hold no direct evidence on ' || chr(39) || x || chr(39)), list_filter([
    CASE WHEN intent IN ({", ".join(f"'{i}'" for i in C.QUANTITATIVE)}) AND NOT coalesce(numbers, false) THEN 'No quantitative data (effect sizes, p-values, intervals) in the evidence found' END,
    CASE WHEN coalesce(against, 0) > 0 THEN against || ' source(s) contradict: the answer may not be a consensus' END,
    CASE WHEN best < 1.5 * ln((greatest(total, 1) + 0.5) / 1.5 + 1) THEN 'The evidence scores low: the documents may not address this question' END,
    CASE WHEN coalesce(n, 0) > 0 AND old >= n // 2 THEN 'The evidence may be old: check it against recent publications' END], lambda x: x IS NOT NULL)), 1, 5)"""
#: The whole plan on chunks: hits, reranked rows, evidence, gaps.
_DECISION = f"""{_CHUNKS}, {_index("SELECT * FROM ch")}, {_QUESTIONS}, {_hits("b", 15)}, {_RERANK},
e0 AS (SELECT item_id, rank, id, section, title, {_relevance("score")} AS relevance, c.text AS text, {_sent("c.text")} AS all_parts, {_support("c.text")} AS kind, {_key_terms("c.text", "qt.tokens")} AS terms FROM rt JOIN c USING (id) JOIN (SELECT item_id, tokens FROM qe) qt USING (item_id)),
e1 AS (SELECT *, {_cut("text", "all_parts", 400)} AS excerpt FROM e0), ev AS (SELECT *, {_sent("excerpt")} AS parts, row_number() OVER (PARTITION BY item_id, kind ORDER BY rank) AS r FROM e1), {_common("ev")},
eg AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE kind = 'direct') AS direct, count(*) FILTER (WHERE kind = 'indirect') AS indirect, count(*) FILTER (WHERE kind = 'contradictory') AS against, count(DISTINCT title) AS titles,
  lower(string_agg(excerpt, ' ' ORDER BY rank)) AS covered, bool_or(regexp_matches(lower(excerpt), '{C.HAS_NUMBERS}')) AS numbers, count(*) FILTER (WHERE regexp_matches(excerpt, '{C.OLD_YEAR}')) AS old, list(struct_pack(id := id, section := section, kind := kind, excerpt := excerpt, terms := terms) ORDER BY rank) AS evs,
  {_listed("direct", 300)} AS for_, {_listed("indirect", 280)} AS near_, string_agg(title || ': ' || ({_cut("excerpt", "parts", 150)}) || '...', '; ' ORDER BY r) FILTER (WHERE kind = 'contradictory' AND r <= 2) AS but_ FROM ev GROUP BY item_id),
qd AS (SELECT qe.item_id, intent, {_entities("qe.text")} AS entities, s.n AS total, b.score AS best FROM qe CROSS JOIN s LEFT JOIN b ON b.item_id = qe.item_id AND b.rank = 1),
gs AS (SELECT item_id, intent, entities, total, coalesce(n, 0) AS n, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect, coalesce(against, 0) AS against, coalesce(titles, 0) AS titles, coalesce(evs, []) AS evs, coalesce(common, []) AS common, for_, near_, but_, {_GAPS} AS gaps
  FROM qd LEFT JOIN eg USING (item_id) LEFT JOIN co USING (item_id)),
g AS (SELECT *, CASE WHEN n > 0 THEN greatest(0.05e0, least(0.95e0, 0.3e0 + least(0.4e0, n * 0.08e0) + least(0.2e0, direct * 0.07e0) - len(gaps) * 0.05e0)) ELSE 0e0 END AS sure, coalesce(entities[1], 'this target') AS subject FROM gs)"""
_ANSWER = """CASE WHEN n = 0 THEN 'The indexed documents hold nothing on this question.' ELSE
  CASE WHEN direct > 0 THEN direct || ' source(s) speak to this question directly:' || chr(10) || chr(10) || for_ WHEN indirect > 0 THEN 'No source speaks to this question directly; these bear on it:' || chr(10) || chr(10) || near_ ELSE 'Little of what was found bears on this question.' END
  || CASE WHEN against > 0 THEN chr(10) || chr(10) || against || ' source(s) contradict: ' || but_ ELSE '' END
  || CASE WHEN n >= 2 AND len(common) > 0 THEN chr(10) || chr(10) || 'Several sources share: ' || array_to_string(list_slice(common, 1, 4), ', ') ELSE '' END END"""
_TWO = _distinct("flatten(list_transform(list_slice(evs, 1, 2), lambda e: list_slice(e.terms, 1, 2)))")
_ASK = f"list_slice(list_concat({_follow()}, CASE WHEN len({_TWO}) > 0 THEN ['What is the clinical significance of ' || array_to_string(list_slice({_TWO}, 1, 2), ' and ') || '?'] ELSE [] END), 1, 4)"


def _joined(field: str) -> str:
    return f"array_to_string(list_transform(evs, lambda e: {field}), '|')"


def _evaluated(modes: str) -> str:
    """Rankings of documents by mode from (mode, item_id, id, score), and the reciprocal rank of each question."""
    return f"""al AS ({modes}), ar AS (SELECT mode, item_id, id AS doc_id, row_number() OVER (PARTITION BY mode, item_id ORDER BY greatest(score, 0.0) DESC, id) AS rank FROM al), ms AS (SELECT DISTINCT mode FROM al), qi AS (SELECT DISTINCT item_id FROM qr),
gr AS (SELECT mode, item_id, 1.0 / min(rank) AS rr FROM ar JOIN qr USING (item_id, doc_id) WHERE rank <= 5 GROUP BY mode, item_id)"""


_FIVE = f"""{_DOCS}, {_QUESTIONS}, {_hits("b", 60)}, {_hashed("ht", 60)}, {_fused("b", "ht", "fu", 60)}, {_reranked("b", "rb")}, {_reranked("fu", "rf")}, {_QRELS},
{_evaluated("SELECT 'bm25' AS mode, item_id, id, score FROM b UNION ALL SELECT 'reranked', item_id, id, score FROM rb UNION ALL SELECT 'dense', item_id, id, score FROM ht UNION ALL SELECT 'hybrid', item_id, id, score FROM fu UNION ALL SELECT 'hybrid_reranked', item_id, id, score FROM rf")}"""
_values = ", ".join(str(r) for r in _FLAT)
_RUBRIC = f"r(system, query_id, {', '.join(metrics.RUBRIC)}) AS (VALUES {_values})"
_total = " + ".join(metrics.RUBRIC)
_USERS = "u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"

ORACLES = {
    "tokenize_counts": f"WITH d AS (SELECT doc_id, {_tok("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM d",
    "clean_text_hash": f"SELECT doc_id, md5({_clean('text')}) AS clean_md5 FROM documents",
    "sentence_split": f"WITH c AS (SELECT doc_id, {_clean('text')} AS c FROM documents), s AS (SELECT doc_id, {_sent('c')} AS s FROM c) SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM s",
    "truncate_excerpt": f"""WITH c AS (SELECT doc_id, {_clean('text')} AS c FROM documents), s AS (SELECT doc_id, c, {_sent('c')} AS s FROM c),
e AS (SELECT doc_id, c, s, list_filter(range(1, len(s) + 1), lambda i: length(array_to_string(list_slice(s, 1, i), ' ')) <= 400) AS fit FROM s),
t AS (SELECT doc_id, CASE WHEN length(c) <= 400 THEN c WHEN len(fit) > 0 THEN array_to_string(list_slice(s, 1, len(fit)), ' ') ELSE left(c, 400) END AS t FROM e)
SELECT doc_id, md5(t) AS excerpt_md5, CAST(length(t) AS BIGINT) AS n_chars FROM t""",
    "section_detect": f"""WITH s AS (SELECT {_section(f"trim(string_split({_pick(HEADS, 'doc_id')} || ' ' || coalesce(text, ''), chr(10))[1])")} AS section FROM documents) SELECT section, count(*) AS n FROM s GROUP BY section""",
    "chunk_documents": f"WITH RECURSIVE {_CHUNKS} SELECT id AS chunk_id, doc_id, section, page, char_start, char_end, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(tokens) AS BIGINT) AS n_tokens FROM ch",
    "term_freq_top": f"WITH {_BM25} SELECT term, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY term ORDER BY 2 DESC, 1 LIMIT 100",
    "doc_freq": f"WITH {_BM25} SELECT term, df FROM v",
    "vocab_stats": f"WITH {_BM25} SELECT n AS n_chunks, round(avgdl, 1) AS avg_length, (SELECT count(*) FROM v) AS n_terms FROM s",
    "corpus_stats_by_lang": f"SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len({_tok('text')})) AS BIGINT) AS n_tokens FROM documents GROUP BY lang",
    "intent_classify": f"WITH {_USERS} SELECT conv_id, turn, {_intent('text')} AS intent FROM u",
    "entity_extract": f"WITH {_USERS}, e AS (SELECT conv_id, turn, {_entities('text')} AS e FROM u) SELECT conv_id, turn, CAST(len(e) AS BIGINT) AS n_entities, array_to_string(e, '|') AS entities FROM e",
    "abbrev_expand": f"WITH {_USERS}, t AS (SELECT conv_id, turn, {_tok('text')} AS t FROM u) SELECT conv_id, turn, array_to_string({_exp('t')}, ' ') AS expanded FROM t",
    "bm25_topk": f"WITH {_BM25} SELECT item_id, id AS doc_id, rank, score, match_terms FROM b",
    "bm25_prefix_fallback": f"WITH {_DOCS}, {_QUESTIONS}, qq AS (SELECT item_id, term || 'qq' AS term FROM q), {_hits('b', 10, 'qq')} SELECT item_id, id AS doc_id, rank, score, match_terms FROM b",
    "dense_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 5) AS score FROM c QUALIFY rank <= 10""",
    "hash_embed": f"WITH {_HASH} SELECT id AS item_id, CAST(bucket AS BIGINT) AS bucket, round(weight, 6) AS weight FROM hv WHERE side = 'q'",
    "hash_dense_topk": f"WITH {_hashed('ht', 15)} SELECT item_id, id AS doc_id, rank, score FROM ht",
    "rrf_fusion": f"WITH {_BM25}, {_hashed('ht', 15)}, {_fused('b', 'ht', 'fu', 15)} SELECT item_id, id AS doc_id, rank, score FROM fu",
    "rerank_scores": f"WITH {_BM25}, {_RERANK} SELECT item_id, id AS doc_id, rank, first_rank, score FROM rt",
    "support_type": f"WITH m AS (SELECT doc_id, {_pick(EVIDENCE_HEADS, 'doc_id')} || coalesce(text, '') AS t FROM documents) SELECT doc_id, {_support('t')} AS support_type FROM m",
    "key_terms": f"WITH m AS (SELECT doc_id, {_pick(EVIDENCE_HEADS, 'doc_id')} || coalesce(text, '') AS t FROM documents) SELECT doc_id, array_to_string({_key_terms('m.t', "['alpha', 'the', 'results']")}, '|') AS key_terms FROM m",
    "relevance_norm": f"WITH {_BM25} SELECT item_id, id AS doc_id, {_relevance('score')} AS relevance FROM b",
    "confidence_scores": f"""WITH {_BM25}, {_RERANK}, e AS (SELECT item_id, {_support('c.text')} AS kind, {_relevance('score')} AS relevance FROM rt JOIN c USING (id)),
g AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE kind = 'direct') AS direct, count(*) FILTER (WHERE kind = 'indirect') AS indirect, count(*) FILTER (WHERE kind = 'contradictory') AS against, avg(relevance) AS average FROM e GROUP BY item_id),
a AS (SELECT *, greatest(0.05e0, least(0.95e0, 0.3e0 + least(0.4e0, n * 0.08e0) + least(0.2e0, direct * 0.07e0))) AS overall FROM g)
SELECT item_id, n, direct, CAST(round(least(1.0, (direct * 0.3 + indirect * 0.15) / n + 0.4), 4) AS DOUBLE) AS assessment, CAST(round(greatest(0.0, least(1.0, average * 0.5 + direct / n * 0.5 - against * 0.1)), 4) AS DOUBLE) AS synthesis, CAST(round(overall, 3) AS DOUBLE) AS overall, CASE WHEN overall >= 0.75 THEN 'High' WHEN overall >= 0.5 THEN 'Moderate' WHEN overall >= 0.25 THEN 'Low' ELSE 'Insufficient' END AS label FROM a""",
    "common_terms": f"WITH {_BM25}, {_RERANK}, ev AS (SELECT item_id, {_key_terms('c.text', 'qt.tokens')} AS terms FROM rt JOIN c USING (id) JOIN (SELECT item_id, tokens FROM qe) qt USING (item_id)), {_common('ev')} SELECT item_id, coalesce(array_to_string(common, '|'), '') AS common FROM co",
    "knowledge_gaps": f"WITH RECURSIVE {_DECISION} SELECT item_id, CAST(len(gaps) AS BIGINT) AS n_gaps, array_to_string(gaps, '|') AS gaps FROM g",
    "decision_output": f"""WITH RECURSIVE {_DECISION} SELECT item_id, intent, {_ANSWER} AS answer, CAST(round(sure, 3) AS DOUBLE) AS confidence,
  CASE WHEN sure >= 0.75 THEN 'High' WHEN sure >= 0.5 THEN 'Moderate' WHEN sure >= 0.25 THEN 'Low' ELSE 'Insufficient' END AS confidence_label, {_joined("e.id")} AS sources, {_joined("e.section")} AS sections, {_joined("e.kind")} AS support_types, md5({_joined("e.excerpt")}) AS excerpts_md5,
  {_joined("array_to_string(e.terms, ',')")} AS key_terms, array_to_string(gaps, '|') AS gaps, array_to_string({_ASK}, '|') AS questions, CAST(CASE WHEN n = 0 THEN 2 WHEN len(gaps) > 0 THEN 4 ELSE 3 END AS BIGINT) AS n_steps,
  CASE WHEN n = 0 THEN 'No evidence was found.' ELSE n || ' row(s): ' || direct || ' direct, ' || indirect || ' indirect, ' || against || ' contradictory, from ' || titles || ' document(s).' END AS second_step,
  CAST(CASE WHEN n = 0 THEN 0.0 ELSE round(least(1.0, (direct * 0.3 + indirect * 0.15) / n + 0.4), 6) END AS DOUBLE) AS second_confidence, titles AS sources_used, total AS total_chunks_searched FROM g""",
    "followups": f"WITH {_USERS}, e AS (SELECT conv_id, turn, {_intent('text')} AS intent, coalesce(({_entities('text')})[1], 'this target') AS subject FROM u) SELECT conv_id, turn, array_to_string(list_append({_follow()}, 'What is the clinical significance of alpha and beta?'), '|') AS questions FROM e",
    "doc_maxpool": f"WITH {_BM25}, m AS (SELECT item_id, lang, greatest(max(score), 0.0) AS score FROM b JOIN documents ON doc_id = id GROUP BY ALL) SELECT item_id, lang, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lang) AS rank FROM m",
    "mrr_at_k": f"WITH {_BM25}, {_QRELS}, g AS (SELECT b.item_id, 1.0 / min(rank) AS rr FROM b JOIN qr ON qr.item_id = b.item_id AND qr.doc_id = b.id WHERE rank <= 5 GROUP BY b.item_id) SELECT item_id, CAST(round(coalesce(rr, 0.0), 6) AS DOUBLE) AS rr FROM (SELECT DISTINCT item_id FROM qr) LEFT JOIN g USING (item_id)",
    "ndcg_at_k": f"""WITH {_BM25}, {_QRELS}, ks AS (SELECT unnest([1, 3, 5])::BIGINT AS k), ir AS (SELECT item_id, grade, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS r FROM qr),
i AS (SELECT item_id, k, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM ir, ks WHERE r <= k GROUP BY ALL), g AS (SELECT b.item_id, k, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM b JOIN qr ON qr.item_id = b.item_id AND qr.doc_id = b.id, ks WHERE rank <= k GROUP BY b.item_id, k)
SELECT item_id, k, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM i LEFT JOIN g USING (item_id, k)""",
    "eval_by_mode": f"""WITH {_FIVE}, ks AS (SELECT unnest([1, 3, 5]) AS k), ir AS (SELECT item_id, grade, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS r FROM qr),
i AS (SELECT item_id, k, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM ir, ks WHERE r <= k GROUP BY ALL), cg AS (SELECT mode, item_id, k, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM ar JOIN qr USING (item_id, doc_id), ks WHERE rank <= k GROUP BY mode, item_id, k),
mt AS (SELECT mode, 'mrr@5' AS metric, CAST(round(avg(coalesce(rr, 0)), 6) AS DOUBLE) AS value FROM ms CROSS JOIN qi LEFT JOIN gr USING (mode, item_id) GROUP BY mode
UNION ALL SELECT mode, 'ndcg@' || k, round(avg(round(coalesce(dcg, 0) / idcg, 6)), 6) FROM ms CROSS JOIN i LEFT JOIN cg USING (mode, item_id, k) GROUP BY mode, k)
SELECT x.mode, x.metric, x.value, round(x.value - y.value, 6) AS delta FROM mt x JOIN mt y ON y.mode = 'bm25' AND x.metric = y.metric""",
    "eval_by_intent": f"WITH {_FIVE} SELECT mode, intent, CAST(round(avg(coalesce(rr, 0)), 6) AS DOUBLE) AS rr, count(*) AS n FROM ms CROSS JOIN qi JOIN (SELECT item_id, intent FROM qe) USING (item_id) LEFT JOIN gr USING (mode, item_id) GROUP BY mode, intent",
    "rubric_means": f"WITH {_RUBRIC}, l AS (" + " UNION ALL ".join(f"SELECT system, '{c}' AS dimension, {e} AS points FROM r" for c, e in [*((c, c) for c in metrics.RUBRIC), ("total", _total)]) + ") SELECT system, dimension, round(avg(points), 6) AS mean FROM l GROUP BY ALL",
    "rubric_compare": f"WITH {_RUBRIC}, t AS (SELECT system, query_id, CAST({_total} AS BIGINT) AS total FROM r) SELECT t.system, t.query_id, t.total, t.total - o.total AS delta FROM t JOIN t o ON t.query_id = o.query_id AND o.system = 'rules'",
    "upsert_new_docs": "WITH k AS (SELECT doc_id, md5(text) AS k FROM documents) SELECT k, min(doc_id) AS doc_id, count(*) AS n FROM k WHERE doc_id % 2 = 1 AND k NOT IN (SELECT k FROM k WHERE doc_id % 2 = 0) GROUP BY k",
    "corpus_stats": f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS n_documents, count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0) AS n_full_text, count(*) FILTER (WHERE doc_id % 5 = 0 OR doc_id % 3 <> 0) AS n_abstract_only, (SELECT count(*) FROM ch) AS n_chunks FROM documents",
    "corpus_documents": f"WITH RECURSIVE {_CHUNKS}, cc AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY doc_id) SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, 'T' || d.doc_id AS title, coalesce(n, 0) AS n_chunks, d.doc_id % 5 = 0 OR d.doc_id % 3 = 0 AS has_full_text FROM documents d LEFT JOIN cc ON cc.doc_id = CAST(d.doc_id AS VARCHAR)",
    "html_extract": r"""WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages) SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading, CAST(len(regexp_extract_all(html, '<a\s[^>]*href=')) AS BIGINT) AS n_links,
md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_md5 FROM h""",
    "json_links": "SELECT event_id, CASE WHEN event_type = 'pmc' THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS pmcid, CAST(NULL AS VARCHAR) AS error FROM events",
    "stream_ingest_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
