"""The queries of this package in SQL, where SQL can say them on whole tables."""

from __future__ import annotations

import math

from . import license_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    """Words of a text with A-Z in lower case."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


ALNUM, SOLID = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE octet_length(body) >= 100 GROUP BY digest)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest"""

OP2 = f"""
WITH d AS (SELECT doc_id, {_words("text", ALNUM)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", ALNUM)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(list_slice(w, s, s + 12), ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, ms WHERE len(w) >= m)),
h AS (SELECT doc_id, s, m, item FROM dw JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""


def _many(text: str, part: str) -> str:
    return f"(length({text}) - length(replace({text}, '{part}', ''))) // {len(part)}"


def _escaped(text: str) -> str:
    """Length of a text with its control strings escaped: one character more for each."""
    return f"length({text}) + " + " + ".join(_many(text, x) for x in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))


OP3 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (SELECT *, 8 + {_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")} + CASE WHEN role = 'user' THEN 15 ELSE 0 END AS chars FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id"""


def _seeded(*columns: str) -> str:
    return f"CAST('0x' || left(md5(concat_ws(':', 17, {', '.join(columns)})), 15) AS BIGINT)"


def _quotients(parties: str, group: str, votes: str, seats: str, tie: str) -> str:
    """Seats by highest quotients, one by one."""
    return f"""SELECT *, (SELECT count(*) FROM (SELECT {group} AS grp, me, row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (2 * seat + 1) DESC, {tie}, seat) AS r, {seats} AS n FROM
  (SELECT *, unnest(range(0, CAST({seats} AS BIGINT))) AS seat FROM {parties} WHERE {votes} > 0)) q WHERE q.r <= q.n AND q.me = p.me) AS quota FROM {parties} p"""


OP5 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_words("text", SOLID)}) AS BIGINT) AS size FROM documents),
sz AS (SELECT source, sum(size) AS size, CAST(ceil(count(*) / 4000) AS BIGINT) AS shards FROM d GROUP BY source),
wt AS (SELECT *, list_extract([3.0, 1.0, 2.0], (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, CAST(size * 2 AS DOUBLE) AS cap FROM sz),
lv AS (SELECT *, cap / weight AS ratio, (1.5 * sum(size) OVER () - coalesce(sum(cap) OVER o, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level FROM wt
  WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fr AS (SELECT *, (SELECT level FROM lv WHERE ratio > level ORDER BY ratio, level LIMIT 1) AS free FROM lv),
tg AS (SELECT source, size AS source_size, shards, CASE WHEN free IS NULL OR ratio <= free THEN cap ELSE free * weight END AS target FROM fr),
st AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS me, greatest(1, least(32, floor(min(target) FILTER (WHERE target > 0) OVER () / 64)))::BIGINT AS step, sum(target) OVER () AS total FROM tg),
se AS (SELECT *, CAST(round(total / step) AS BIGINT) AS seats FROM st),
gv AS ({_quotients("se", "1", "target", "seats", "me")}),
r AS (SELECT d.*, {_seeded("doc_id", "d.size")} AS place, {_seeded("doc_id", "d.size")} % shards AS shard FROM d JOIN sz ON d.source IS NOT DISTINCT FROM sz.source),
ce AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell FROM r GROUP BY source, shard),
jo AS (SELECT ce.source, shard, cell, source_size, target, step, quota AS blocks, gv.me AS src, row_number() OVER () AS me FROM ce JOIN gv ON ce.source IS NOT DISTINCT FROM gv.source),
qu AS ({_quotients("jo", "src", "cell", "blocks", "shard")}),
wo AS (SELECT *, least(quota * step, cell * 2) AS words, cell * 2 - least(quota * step, cell * 2) AS room FROM qu),
ov AS (SELECT *, sum(quota * step - words) OVER (PARTITION BY src) - coalesce(sum(room) OVER (PARTITION BY src ORDER BY room DESC, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM wo),
wd AS (SELECT *, CAST(words + greatest(0, least(over_, room)) AS BIGINT) AS w FROM ov),
fi AS (SELECT *, CASE WHEN cell > 0 THEN w // cell ELSE 0 END AS whole, CASE WHEN cell > 0 THEN w % cell ELSE w END AS rest, CASE WHEN cell > 0 THEN {_seeded("source", "shard")} % greatest(1, cell // step) * step ELSE 0 END AS lo FROM wd),
pl AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS z FROM r)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(whole * size + greatest(0, least(z, least(lo + rest, cell)) - greatest(z - size, lo)) + greatest(0, least(z, greatest(0, lo + rest - cell)) - (z - size)) AS BIGINT) AS taken
FROM pl JOIN fi ON pl.source IS NOT DISTINCT FROM fi.source AND pl.shard = fi.shard"""


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def op6() -> str:
    """Lines, and windows from each of a template's words on, against every template; base places by phrases."""
    import re

    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    share = license_join.CONTAINMENT
    phrases = ", ".join(f"({_list(words(p))}, '{label}')" for p, label in license_join.PHRASES.items())
    templates, musts = [], []
    for n, (label, text, *must) in enumerate(license_join.TEMPLATES):
        own, groups = words(text), must[0] if must else []
        tokens = sorted(set(own))
        need = len(tokens) if not groups and len(tokens) < license_join.SHORT else math.ceil(share * len(tokens))
        templates.append(f"({n}, '{label}', {_list(tokens)}, {need}, {math.ceil(len(own) / share)}, {len(groups)})")
        musts += [f"({n}, {g}, {_list(words(p))})" for g, group in enumerate(groups) for p in group.split("|")]
    return f"""
WITH t(t, label, tokens, need, width, groups) AS (VALUES {", ".join(templates)}), must(t, g, phrase) AS (VALUES {", ".join(musts)}), ph(phrase, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, {_words("text", ALNUM)} AS w, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: len({_words("x", ALNUM)})) AS sizes FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
ln AS (SELECT doc_id, CAST(list_sum(list_slice(sizes, 1, i - 1)) AS BIGINT) AS a, n FROM (SELECT doc_id, sizes, unnest(sizes) AS n, generate_subscripts(sizes, 1) AS i FROM d) WHERE n > 0),
bp AS (SELECT doc_id, pos, label FROM p JOIN ph ON p.word = phrase[1] JOIN d USING (doc_id) WHERE list_slice(w, pos + 1, pos + len(phrase)) = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS found FROM bp GROUP BY doc_id),
tok AS (SELECT t, unnest(tokens) AS word FROM t), hit AS (SELECT doc_id, t, pos, word FROM p JOIN tok USING (word)),
rich AS (SELECT doc_id, t FROM hit JOIN t USING (t) GROUP BY doc_id, t, need HAVING count(DISTINCT word) >= need),
bl AS (SELECT doc_id, t, pos AS a, pos + width AS z FROM hit JOIN rich USING (doc_id, t) JOIN t USING (t) UNION SELECT doc_id, t, coalesce(a, 0), coalesce(a, 0) + n FROM rich JOIN ln USING (doc_id)),
full_ AS (SELECT bl.doc_id, bl.t, a, z, count(DISTINCT word) AS n FROM bl JOIN hit ON hit.doc_id = bl.doc_id AND hit.t = bl.t AND hit.pos >= a AND hit.pos < z GROUP BY ALL),
mp AS (SELECT doc_id, must.t, g, pos, len(phrase) AS k FROM must JOIN rich ON rich.t = must.t JOIN p USING (doc_id) JOIN d USING (doc_id) WHERE word = phrase[1] AND list_slice(w, pos + 1, pos + len(phrase)) = phrase),
ok AS (SELECT f.doc_id, f.t, f.a, f.z, f.n, count(DISTINCT g) AS have FROM full_ f JOIN t USING (t) LEFT JOIN mp ON mp.doc_id = f.doc_id AND mp.t = f.t AND mp.pos >= a AND mp.pos + mp.k <= z WHERE f.n >= need GROUP BY ALL),
more AS (SELECT doc_id, list_distinct(list(label)) AS found, max(n / len(tokens)) AS best FROM ok JOIN t USING (t) WHERE have = groups GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.found), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(more.found, [])))), ','), '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


OP8 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, n, line, coalesce(k.doc_id <> last_doc, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", SOLID)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

ORACLES = {"op1_capture_index": OP1, "op2_decontaminate": OP2, "op3_chat_tree": OP3, "op5_sainte_lague": OP5, "op6_license_join": op6(), "op8_line_dedup": OP8, "op9_ngram_join": OP9}
