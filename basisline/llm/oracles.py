"""DuckDB SQL for the training-data queries whose results SQL can express, each written without regard to the Spark path.

Rows are told apart by a row number, so repeated keys are no special case. The SQL reads whole tables and whole texts.
"""

from __future__ import annotations

from basisline.llm.quality_rules import N_SETTINGS, RULES, RiskBudget

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    """Lower-cased words of a text column."""
    return f"[x FOR x IN string_split_regex(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_NON_WORD}') IF x <> '']"


OP4 = f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS words FROM benchmark),
items AS (SELECT item, words, least(len(words), 10) AS size FROM item_words WHERE len(words) > 0),
starts AS (SELECT item, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM items),
grams AS (SELECT DISTINCT item, size, array_to_string(words[i : i + size - 1], ' ') AS gram FROM starts),
sizes AS (SELECT DISTINCT size FROM grams),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text")} AS words FROM documents),
places AS (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM docs CROSS JOIN sizes WHERE len(words) >= size),
found AS (SELECT p.rid, p.i, p.size, g.item FROM (SELECT rid, i, size, array_to_string(words[i : i + size - 1], ' ') AS gram FROM places) p JOIN grams g USING (size, gram)),
covered AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""

_B = RiskBudget()
_SETTING = f"least({', '.join('CASE ' + ' '.join(f'WHEN {rule} > {c} THEN {j}' for j, c in enumerate(cuts)) + f' ELSE {N_SETTINGS} END' for rule, cuts in RULES.items())})"

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, coalesce(lang, '') AS lang, t, [x FOR x IN string_split_regex(t, '[ \x09-\x0D]+') IF x <> ''] AS words,
 [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^ \x09-\x0D]')] AS lines FROM d),
places AS (SELECT rid, unnest(words) AS a, unnest(range(1, len(words) + 1)) AS i FROM w),
grams AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, c IS NOT NULL AND count(*) OVER (PARTITION BY rid, a, b, c) > 1 AS rep FROM grams),
spread AS (SELECT rid, rep OR coalesce(lag(rep, 1) OVER o, false) OR coalesce(lag(rep, 2) OVER o, false) AS rep FROM twice WINDOW o AS (PARTITION BY rid ORDER BY i)),
repeats AS (SELECT rid, count(*) FILTER (WHERE rep) AS n FROM spread GROUP BY rid),
counts AS (SELECT rid, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim,
 len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN repeats USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 coalesce(CAST(n_symbols AS DOUBLE) / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(CAST(n_upper AS DOUBLE) / nullif(word_chars, 0), 0) AS upper_ratio,
 coalesce(CAST(n_exclaim AS DOUBLE) / nullif(n_words, 0), 0) AS exclaim_ratio, coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 0) AS dup_line_ratio,
 coalesce(CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0), 0) AS repeat_word_ratio FROM counts),
placed AS (SELECT *, {_SETTING} AS setting FROM judged),
held AS (SELECT lang, setting FROM placed WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
sizes AS (SELECT lang, count(*) AS n FROM held GROUP BY lang),
ranks AS (SELECT lang, n, row_number() OVER (ORDER BY n DESC, lang) AS r FROM sizes),
tried AS (SELECT lang, n, j, {_B.error} / (r * (r + 1)) AS level, (SELECT count(*) FROM held h WHERE h.lang = ranks.lang AND h.setting <= j) AS k
 FROM ranks CROSS JOIN (SELECT unnest(range(0, {N_SETTINGS})) AS j)),
tails AS (SELECT lang, n, j, k, level,
 list_sum([exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({_B.max_false_rejection}) + (n - x) * ln(1 - {_B.max_false_rejection})) FOR x IN range(0, k + 1)]) AS tail FROM tried),
stops AS (SELECT lang, j, bool_and(k < n AND tail <= level) OVER (PARTITION BY lang ORDER BY j) AS good FROM tails),
chosen AS (SELECT lang, max(j) AS j FROM stops WHERE good GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND setting > coalesce(chosen.j, -1) AS kept
FROM placed LEFT JOIN chosen USING (lang)"""

OP7 = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text")} AS words FROM documents),
starts AS (SELECT rid, words, least(len(words), 5) AS size, unnest(range(1, len(words) - least(len(words), 5) + 2)) AS i FROM docs WHERE len(words) > 0),
sets AS (SELECT DISTINCT rid, array_to_string(words[i : i + size - 1], ' ') AS s FROM starts),
ids AS (SELECT rid, md5(string_agg(s, chr(10) ORDER BY s)) AS node, count(*) AS size FROM sets GROUP BY rid),
nodes AS (SELECT node, min(rid) AS rid, any_value(size) AS size, count(*) AS docs, min(doc_id) AS rep FROM ids JOIN docs USING (rid) GROUP BY node),
own AS (SELECT node, size, s FROM nodes JOIN sets USING (rid)),
common AS (SELECT a.node AS a, b.node AS b, any_value(a.size) + any_value(b.size) AS total, count(*) AS n FROM own a JOIN own b ON a.s = b.s AND a.node < b.node GROUP BY a.node, b.node),
half AS (SELECT a, b FROM common WHERE 10 * n >= 8 * (total - n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT r.a AS node, min(n.rep) AS class_id, CAST(sum(n.docs) AS BIGINT) AS class_size FROM reach r JOIN nodes n ON n.node = r.b GROUP BY r.a),
linked AS (SELECT l.a AS node, count(*) AS texts, CAST(sum(n.docs) AS BIGINT) AS linked FROM links l JOIN nodes n ON n.node = l.b GROUP BY l.a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_size, 1) AS class_size,
 CAST(coalesce(docs - 1, 0) + coalesce(linked, 0) AS BIGINT) AS n_links, coalesce(texts, 0) AS n_text_links
FROM docs LEFT JOIN ids USING (rid) LEFT JOIN nodes n ON n.node = ids.node LEFT JOIN classes c ON c.node = ids.node LEFT JOIN linked k ON k.node = ids.node"""

OP8 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT DISTINCT rid, doc_id, site, line FROM (SELECT rid, doc_id, site, unnest(parts) AS line FROM docs) WHERE regexp_matches(line, '[^ \x09-\x0D]')),
spread AS (SELECT line, min(doc_id) AS keeper FROM lines GROUP BY line HAVING count(DISTINCT site) >= CASE WHEN len([w FOR w IN string_split_regex(line, '[ \x09-\x0D]+') IF w <> '']) >= 20 THEN 3 ELSE 10 END),
cut AS (SELECT rid, list(line) AS gone FROM lines JOIN spread USING (line) WHERE doc_id IS DISTINCT FROM keeper GROUP BY rid),
rest AS (SELECT rid, doc_id, text, parts, [x FOR x IN parts IF NOT list_contains(coalesce(gone, []), x)] AS kept FROM docs LEFT JOIN cut USING (rid))
SELECT doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(parts) - len(kept), 0) AS BIGINT) AS n_removed,
 CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM rest"""

SQL = {"op4_benchmark_windows": OP4, "op6_risk_controlled_rules": OP6, "op7_bayesian_jaccard_join": OP7, "op8_site_spread_lines": OP8}
