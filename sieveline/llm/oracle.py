"""SQL of the training-data queries that SQL can express: the decision rules of problems 2, 5 and 6 by brute force."""

from __future__ import annotations

from ..plans import sqltext as S


def _key(x: str) -> str:
    """Letters and digits without width and case; the case folding that lower() lacks is spelled out."""
    return f"replace({S.alnum(x)}, 'ß', 'ss')"


def _copies(tbl: str, key: str, fields: list[str]) -> str:
    """Groups of equal fields, by name; empty fields add nothing."""
    parts = " || ".join(f"CASE WHEN k_{f} <> '' THEN chr(1) || '{f}' || chr(2) || k_{f} ELSE '' END" for f in sorted(fields))
    keys = ", ".join(f"coalesce({_key(f)}, '') AS k_{f}" for f in fields)
    return f"SELECT DISTINCT '{tbl}' AS tbl, {key} AS id, {parts} AS k FROM (SELECT {key}, {keys} FROM {tbl} WHERE {key} IS NOT NULL)"


_JSON = f"""SELECT 'raw_lines' AS tbl, line_id AS id, coalesce(string_agg(CASE WHEN v <> '' THEN chr(1) || name || chr(2) || v END, '' ORDER BY name), '') AS k FROM
(SELECT line_id, name, coalesce({_key('raw')}, '') AS v FROM (SELECT line_id, name, json_extract_string(payload, '$."' || name || '"') AS raw FROM
(SELECT line_id, payload, unnest(json_keys(payload)) AS name FROM raw_lines WHERE line_id IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'))) GROUP BY line_id"""

_GROUPS = f"""c AS MATERIALIZED ({_copies('sft_raw', 'record_id', ['instruction', 'input', 'output'])} UNION ALL {_copies('pref_raw', 'pref_id', ['question', 'response_chosen', 'response_rejected'])} UNION ALL {_JSON}),
g AS (SELECT tbl, k, min(id) AS keep_id, count(*) AS copies FROM c GROUP BY tbl, k HAVING count(*) > 1)"""

_TEXTS = f"""t AS MATERIALIZED (SELECT DISTINCT tbl, row_id, {_key('text')} AS k FROM (SELECT 'documents' AS tbl, doc_id AS row_id, text FROM documents UNION ALL SELECT 'sft_raw', record_id, instruction FROM sft_raw) WHERE text IS NOT NULL),
i AS MATERIALIZED (SELECT item_id, {_key('text')} AS k FROM (SELECT item_id, question AS text FROM mcq UNION ALL SELECT item_id, text FROM heldout_texts) WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT DISTINCT item_id, substr(k, p, (length(k) + 1) // 2) AS part FROM (SELECT item_id, k, unnest(range(1, length(k) - (length(k) + 1) // 2 + 2)) AS p FROM i WHERE k <> ''))"""

# levenshtein() counts bytes, and an edit of a letter takes at most four: what that leaves is compared again with every
# letter of the two texts as one byte, by its place among their letters.
_BYTES = "array_to_string(list_transform(string_split({0}, ''), lambda c: chr(1 + list_position(al, c)::INT % 126)), '')"
_NEAR = f"""SELECT tbl, ek, tk FROM (SELECT *, list_distinct(string_split(ek || tk, '')) AS al FROM
(SELECT a.tbl, a.k AS ek, b.k AS tk, floor(0.08 * greatest(a.n, b.n) + 1e-9) AS most FROM d a JOIN d b ON b.tbl = a.tbl AND NOT a.tr AND b.tr AND abs(a.n - b.n) <= floor(0.08 * greatest(a.n, b.n) + 1e-9)
WHERE CASE WHEN a.k = b.k THEN true ELSE levenshtein(a.k, b.k) <= 4 * floor(0.08 * greatest(a.n, b.n) + 1e-9) END)) WHERE CASE WHEN ek = tk THEN true ELSE levenshtein({_BYTES.format('ek')}, {_BYTES.format('tk')}) <= most END"""
_TURNS = f"""u AS MATERIALIZED (SELECT DISTINCT tbl, id, split, source, {_key('text')} AS k FROM (SELECT 'sft_chat' AS tbl, conv_id AS id, split, source, c.value AS text FROM (SELECT conv_id, split, source, unnest(conversations) AS c FROM sft_chat) WHERE c.role IN ('human', 'user')
UNION ALL SELECT 'pref_raw', pref_id, split, source, question FROM pref_raw) WHERE text IS NOT NULL AND split IS NOT NULL),
d AS MATERIALIZED (SELECT DISTINCT tbl, k, split = 'train' AS tr, length(k) AS n FROM u WHERE length(k) >= 20),
near AS MATERIALIZED ({_NEAR})"""

SQL: dict[str, str] = {
    "p2_found": f"WITH {_GROUPS} SELECT c.tbl, g.keep_id, c.id AS copy_id FROM c JOIN g ON g.tbl = c.tbl AND g.k = c.k WHERE c.id <> g.keep_id",
    "p2_copy_counts": f"WITH {_GROUPS} SELECT tbl, keep_id, copies FROM g",
    "p5_found": f"WITH {_TEXTS} SELECT DISTINCT t.tbl, t.row_id, w.item_id FROM t JOIN w ON contains(t.k, w.part)",
    "p6_found": f"WITH {_TURNS} SELECT DISTINCT e.tbl, least(e.id, t.id) AS id_a, greatest(e.id, t.id) AS id_b FROM near JOIN u e ON e.tbl = near.tbl AND e.k = near.ek AND e.split <> 'train' JOIN u t ON t.tbl = near.tbl AND t.k = near.tk AND t.split = 'train' WHERE e.id <> t.id",
    "p6_overlap_counts": f"""WITH {_TURNS}, x AS (SELECT e.tbl, e.id, e.split, e.source, bool_or(n.tk IS NOT NULL AND n.tk = e.k) AS x, bool_or(n.tk IS NOT NULL AND n.tk <> e.k) AS m FROM u e LEFT JOIN near n ON n.tbl = e.tbl AND n.ek = e.k WHERE e.split <> 'train' AND length(e.k) >= 20 GROUP BY ALL)
SELECT tbl, split, source, count(*) AS records, count(*) FILTER (WHERE x) AS exact, count(*) FILTER (WHERE m) AS near FROM x GROUP BY ALL""",
    "p6_overlap_classes": f"""WITH {_TURNS}, e AS (SELECT tbl, k, split, min(id) AS class_id, count(DISTINCT id) AS records FROM u WHERE split <> 'train' AND length(k) >= 20 GROUP BY ALL), x AS (SELECT tbl, k, count(DISTINCT id) AS n FROM u WHERE split = 'train' GROUP BY ALL),
m AS (SELECT tbl, ek, count(*) AS n FROM near WHERE ek <> tk GROUP BY ALL)
SELECT e.tbl, e.class_id, e.split, e.records, coalesce(x.n, 0)::BIGINT AS exact, coalesce(m.n, 0)::BIGINT AS near FROM e LEFT JOIN x ON x.tbl = e.tbl AND x.k = e.k LEFT JOIN m ON m.tbl = e.tbl AND m.ek = e.k WHERE coalesce(x.n, 0) + coalesce(m.n, 0) > 0""",
}
