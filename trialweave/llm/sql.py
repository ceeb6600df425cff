"""SQL twins of the queries that SQL can express, for DuckDB. The others are held against brute force in tests/llm."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text='text')} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
held AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
bad AS (SELECT win.doc_id, win.i FROM win JOIN held ON win.h = held.h WHERE held.first < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM bad)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_SHINGLES = """SELECT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM {src}"""
_NORMAL = r"list_filter(list_transform({words}, lambda w: regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '')"

OP4 = f"""
WITH dw AS (SELECT doc_id AS id, {_NORMAL.format(words=_WORDS.format(text='text'))} AS ws FROM documents),
iw AS (SELECT item_id AS id, {_NORMAL.format(words=_WORDS.format(text='text'))} AS ws FROM benchmark),
ds AS (SELECT DISTINCT * FROM ({_SHINGLES.format(src='dw')})), bs AS (SELECT DISTINCT * FROM ({_SHINGLES.format(src='iw')})),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
hit AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS found FROM ds JOIN bs ON ds.s = bs.s GROUP BY ALL)
SELECT doc_id, item_id, n.n AS n_shingles, found AS n_found, found::DOUBLE / n.n AS containment FROM hit JOIN n ON n.id = hit.item_id WHERE found >= ceil(0.8 * n.n - 1e-9)
"""

OP5 = f"""
WITH RECURSIVE dw AS (SELECT doc_id AS id, {_WORDS.format(text=_ASCII_LOWER)} AS ws FROM documents),
c AS (SELECT id, s, count(*) AS n FROM ({_SHINGLES.format(src='dw')}) GROUP BY ALL), t AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
pair AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
link AS (SELECT pair.a, pair.b FROM pair JOIN t x ON x.id = pair.a JOIN t y ON y.id = pair.b WHERE m::DOUBLE / (x.n + y.n - m)::DOUBLE >= 0.8),
reach(v, c) AS (SELECT id, id FROM dw UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.v),
least_ AS (SELECT v, min(c) AS class_id FROM reach GROUP BY v)
SELECT dw.id AS doc_id, class_id, dw.id = class_id AS kept, len(dw.ws)::BIGINT AS n_words FROM dw JOIN least_ ON least_.v = dw.id
"""

OP6 = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.v),
comp AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v = component_id AS kept FROM comp LEFT JOIN n ON n.a = comp.v
"""

_ESCAPED = r"length(regexp_replace(replace({x}, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g'))"

OP7 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(3 + {_ESCAPED.format(x='role')} + length(role) - length(replace(role, chr(10), '')) + 1 + {_ESCAPED.format(x='text')} + 5)::BIGINT AS formatted_chars FROM t GROUP BY conv_id
"""

_WORDS_11 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(w)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)), lambda c, b: {steps}), 4294967295::BIGINT)"
_STEPS = "xor(c, b)"
for _ in range(8):  # a bit of the CRC's polynomial division
    _STEPS = f"list_transform([{_STEPS}], lambda v: xor(v >> 1, (v & 1) * 3988292384::BIGINT))[1]"

OP11 = f"""
WITH dw AS (SELECT doc_id, {_WORDS_11} AS ws FROM documents), f AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM dw) GROUP BY ALL),
g AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS_11}) AS w FROM benchmark) GROUP BY w), words AS (SELECT w FROM f UNION SELECT w FROM g),
h AS MATERIALIZED (SELECT w, {_CRC.format(steps=_STEPS)} % 10000 AS b FROM words),
s AS (SELECT b, sum(n) AS s FROM f JOIN h USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM g JOIN h USING (w) GROUP BY b),
gain AS (SELECT s.b, floor(1000.0::DOUBLE * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t ON s.b = t.b),
weight AS (SELECT doc_id, sum(n * gain) AS weight FROM f JOIN h USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT dw.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || dw.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM dw LEFT JOIN weight ON weight.doc_id = dw.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
"""

_ROUND_12 = """
d{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, dist * 256 + entry) AS entry, min(dist) AS dist FROM (SELECT vec_id, p.part, entry, (list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c))::BIGINT AS dist FROM p JOIN c{k} c ON c.part = p.part) GROUP BY ALL)"""
_NEXT_12 = """,
m{k} AS (SELECT part, entry, list(v ORDER BY i) AS v FROM (SELECT p.part, entry, i, floor(sum(q[i]) / count(*)) AS v FROM p JOIN d{k} USING (vec_id, part), range(1, 17) r(i) GROUP BY ALL) GROUP BY ALL),
c{n} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry),"""

OP12 = (
    """
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, rn, part, e[16 * part + 1 : 16 * part + 16] AS q FROM kept, range(4) r(part)),
c0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, q AS c FROM p WHERE rn <= 256),"""
    + "".join(_ROUND_12.format(k=k) + _NEXT_12.format(k=k, n=k + 1) for k in range(4))
    + _ROUND_12.format(k=4)
    + """,
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM d4 GROUP BY vec_id),
named AS (SELECT coded.*, label FROM coded JOIN kept USING (vec_id)), by_label AS (SELECT label, sum(error)::BIGINT AS label_error FROM named GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256 FROM named JOIN by_label ON by_label.label IS NOT DISTINCT FROM named.label
"""
)

ORACLE_SQL = {
    "op3_substring_dedup": OP3,
    "op4_decontaminate": OP4,
    "op5_near_dup": OP5,
    "op6_embedding_dedup": OP6,
    "op7_format_chats": OP7,
    "op11_resample": OP11,
    "op12_vector_codes": OP12,
}
