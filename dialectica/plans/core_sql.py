"""SQL of the core queries, for an engine that reads the same Parquet tables as views."""

from __future__ import annotations

from dialectica.functions.text import ARGUMENT_PROMPT, ATTRIBUTE_LABELS, SCORING_PROMPT
from dialectica.operators import graph

_W = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def clean(x: str) -> str:
    v = f"regexp_replace(replace({strip(x)}, 'u''', ''''), '^''+|''+$', '', 'g')"
    return f"CASE WHEN lower({v}) <> 'none' THEN {v} END"


def whole(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def attributes(m: str) -> str:
    """label=value texts of the shown attributes, as a list without nulls."""
    each = ", ".join(f"{quoted(label + '=')} || ({clean(f'{m}[{quoted(key)}]')})" for key, label in ATTRIBUTE_LABELS.items())
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


def attribute_text(m: str) -> str:
    a = attributes(m)
    return f"CASE WHEN len({a}) > 0 THEN array_to_string({a}, '; ') ELSE 'none' END"


E = "e AS (SELECT * FROM sample_input QUALIFY row_number() OVER (PARTITION BY idx ORDER BY ingested_at) = 1)"
R = 'r AS (SELECT * FROM generation_results QUALIFY row_number() OVER (PARTITION BY "index" ORDER BY generated_at) = 1)'
B = f"""b AS (
  SELECT business_id, coalesce(name, '') AS name, cats AS categories, attributes, stars, review_count
  FROM (SELECT *, list_transform(string_split(categories, ','), lambda c: {strip('c')}) AS cats FROM raw_business)
  WHERE list_contains(cats, 'Restaurants') QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY snapshot_at DESC) = 1
)"""
V = f"""v AS (
  SELECT user_id, business_id, stars AS user_stars, {strip('text')} AS review_text, coalesce(date, '') AS date, ord
  FROM raw_review WHERE length({strip('text')}) >= 30 AND user_id IS NOT NULL AND stars IS NOT NULL AND business_id IN (SELECT business_id FROM b)
)"""
U = "u AS (SELECT user_id, count(*) AS n FROM v GROUP BY user_id)"
SA = "s AS (SELECT * FROM u WHERE n BETWEEN 6 AND 50)"
S = """s AS (
  SELECT * FROM (SELECT * FROM u WHERE n BETWEEN 5 AND 50 ORDER BY md5('42:' || user_id), user_id LIMIT 100) WHERE n >= 6
)"""
H = """w1 AS (
  SELECT v.*, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, ord DESC) AS rn FROM v WHERE user_id IN (SELECT user_id FROM s)
), w2 AS (
  SELECT *, CASE WHEN user_stars >= 4 THEN 0 WHEN user_stars <= 2 THEN 1 ELSE 9 END AS bk FROM w1 WHERE rn > 1
), w3 AS (
  SELECT *, bk < 9 AND row_number() OVER (PARTITION BY user_id, bk ORDER BY rn) <= 2 AS sel FROM w2
), w4 AS (
  SELECT *, bool_or(sel) OVER (PARTITION BY user_id, business_id, date, review_text) AS ksel,
    row_number() OVER (PARTITION BY user_id, business_id, date, review_text ORDER BY rn) AS krn, count(*) FILTER (sel) OVER (PARTITION BY user_id) AS ns FROM w3
), w5 AS (
  SELECT *, NOT ksel AND krn = 1 AS cand, row_number() OVER (PARTITION BY user_id, NOT ksel AND krn = 1 ORDER BY rn) AS frn FROM w4
), hist AS (
  SELECT user_id, business_id, user_stars, date, ord,
    row_number() OVER (PARTITION BY user_id ORDER BY date, CASE WHEN sel THEN bk ELSE 2 END, CASE WHEN sel THEN -rn ELSE rn END) AS pos
  FROM w5 WHERE sel OR cand AND frn <= 5 - ns
)"""


def history(h: str) -> str:
    a = attribute_text("x.attributes")
    line = (
        f"CAST(i AS VARCHAR) || '. ' || coalesce(x.name, 'Unknown') || ' | categories: ' || coalesce(array_to_string(x.categories, ', '), '') || ' | rating: ' || coalesce({whole('x.user_stars')}, 'N/A')"
        f" || CASE WHEN {a} = 'none' THEN '' ELSE ' | attributes: ' || {a} END"
    )
    return f"coalesce(array_to_string(list_transform(list_filter({h}, lambda y: y IS NOT NULL), lambda x, i: {line}), chr(10)), '')"


def target(t: str) -> str:
    return (
        f"coalesce({t}.name, 'Unknown') || ' | categories: ' || coalesce(array_to_string({t}.categories, ', '), '') || ' | attributes: ' || {attribute_text(t + '.attributes')}"
        f" || ' | global_rating: ' || coalesce(CAST({t}.global_stars AS VARCHAR), 'N/A')"
    )


def fill(template: str, **slots: str) -> str:
    out, rest = [], template
    while True:
        at = min(((rest.find("{" + k + "}"), k) for k in slots if "{" + k + "}" in rest), default=None)
        if at is None:
            return " || ".join([*out, quoted(rest)])
        i, k = at
        out += [quoted(rest[:i]), f"coalesce({slots[k]}, '')"]
        rest = rest[i + len(k) + 2 :]


def norm(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - 1) / 4)) END"


MF = """m AS (
  SELECT DISTINCT e.user_id, h.business_id, h.user_stars AS rating FROM (SELECT user_id, unnest(history) AS h FROM e) e
  WHERE coalesce(e.user_id, '') <> '' AND coalesce(h.business_id, '') <> '' AND h.user_stars IS NOT NULL
)"""
BIAS = """mu AS (SELECT avg(rating) AS mu FROM m),
bi AS (SELECT business_id, sum(rating - mu) / (5 + count(*)) AS b_i FROM m, mu GROUP BY business_id),
bu AS (SELECT user_id, sum(rating - mu - b_i) / (5 + count(*)) AS b_u FROM m JOIN bi USING (business_id), mu GROUP BY user_id),
pr AS (
  SELECT idx, e.user_id, e.target_item.business_id AS business_id, greatest(1.0, least(5.0, mu + coalesce(b_i, 0) + coalesce(b_u, 0))) AS p
  FROM e LEFT JOIN bi ON bi.business_id = e.target_item.business_id LEFT JOIN bu ON bu.user_id = e.user_id, mu
  WHERE e.user_id IS NOT NULL AND e.target_item.business_id IS NOT NULL
)"""
#: The arguments of all records with readable JSON and a known example: every element of their list, with the reason why it can't be used.
AA = """aa AS (
  SELECT "index", target_name, pos, j->>'id' AS id, j->>'type' AS arg_type, j->>'text' AS text, json_type(j->'evidence') = 'VARCHAR' AS bare,
    CASE json_type(j->'evidence') WHEN 'ARRAY' THEN list_transform(CAST(j->'evidence' AS JSON[]), lambda x: x->>'$') WHEN 'VARCHAR' THEN [j->>'evidence'] END AS evidence,
    CASE WHEN json_type(j) <> 'OBJECT' THEN 'not an object' ELSE 'missing ' || nullif(array_to_string([k FOR k IN ['id', 'type', 'text', 'evidence'] IF NOT json_exists(j, k)], ', '), '') END AS reason
  FROM (SELECT "index", target_name, generate_subscripts(js, 1) - 1 AS pos, unnest(js) AS j
    FROM (SELECT "index", e.target_item.name AS target_name, CASE WHEN json_type(CAST(parsed_json AS JSON)->'arguments') = 'ARRAY' THEN CAST(CAST(parsed_json AS JSON)->'arguments' AS JSON[]) END AS js FROM r JOIN e ON e.idx = r."index"))
)"""
A = f"{AA}, a AS (SELECT * FROM aa WHERE reason IS NULL)"
_N = '(("index" * 31 + pos * 17) % 121)'
LLM = f"""
  CASE WHEN ("index" + pos) % 7 = 0 OR ("index" + pos) % 11 = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, {_N} / 100.0::DOUBLE) END"""
REASON = """CASE WHEN ("index" + pos) % 7 = 0 OR ("index" + pos) % 11 = 0 THEN 'No valid scoring explanation returned by the LLM.' ELSE 'r' || pos END"""
C = f"""c AS (
  SELECT a.*, {LLM} AS llm, coalesce({norm('e.target_item.global_stars')}, 0.5) AS mf FROM a JOIN e ON e.idx = a."index"
), k AS (SELECT *, 0.5 * llm + 0.5 * mf AS comb FROM c)"""
N = """n AS (
  SELECT "index", id AS node_id, 'argument' AS node_type, text, comb AS base_score FROM k QUALIFY row_number() OVER (PARTITION BY "index", id ORDER BY pos DESC) = 1
  UNION ALL SELECT "index", 'ROOT', 'root', 'Recommend item: ' || coalesce(nullif(arg_min(target_name, pos), ''), 'target_item'), 0.5 FROM k GROUP BY "index" HAVING count(*) FILTER (id = 'ROOT') = 0
)"""
REL = "CASE WHEN arg_type = 'support' THEN 'support' ELSE 'attack' END"
D = f"""l AS (SELECT k."index", pos, {REL} AS rel, base_score AS s FROM k JOIN n ON n."index" = k."index" AND n.node_id IS NOT DISTINCT FROM k.id),
d AS (
  SELECT "index", 1 - coalesce(product(1 - s) FILTER (rel = 'support'), 1) AS sup, 1 - coalesce(product(1 - s) FILTER (rel = 'attack'), 1) AS att FROM l GROUP BY "index"
)"""


#: Places of the nodes: of the places of its arguments a node has the last one, those of attacks being later.
P = f"""f AS (SELECT "index", id, pos, {REL} AS rel, row_number() OVER (PARTITION BY "index", {REL} ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY "index", {REL}) AS c FROM k),
p AS (
  SELECT "index", id AS node_id, CASE WHEN rel = 'support' THEN 260.0 ELSE 1140.0 END::DOUBLE AS x, (CASE WHEN c = 1 THEN 450.0 ELSE 140 + i * (620.0::DOUBLE / (c - 1)) END)::DOUBLE AS y
  FROM f QUALIFY row_number() OVER (PARTITION BY "index", id ORDER BY rel, pos DESC) = 1
  UNION ALL SELECT "index", 'ROOT', 700.0, 450.0 FROM k GROUP BY "index" HAVING count(*) FILTER (id = 'ROOT') = 0
)"""


def esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


def shown(x: str) -> str:
    return esc(f"coalesce(CAST({x} AS VARCHAR), 'None')")


def _line(label: str, x: str) -> str:
    return f"'<strong>{label}:</strong> ' || {shown(x)}"


T = f"""t AS (
  SELECT "index", 'ROOT' AS node_id, {_line('ID', "'ROOT'")} || '<br>' || {_line('Type', "'root'")} || '<br>' || {_line('Base score', '0.5')} || '<br>' || {_line('Target item', 'name')} || '<br>' || {_line('Text', "'Recommend item: ' || name")} AS tooltip
  FROM (SELECT "index", coalesce(nullif(arg_min(target_name, pos), ''), 'target_item') AS name FROM k GROUP BY "index" HAVING count(*) FILTER (id = 'ROOT') = 0)
  UNION ALL SELECT "index", id, {_line('ID', 'id')} || '<br>' || {_line('Type', 'arg_type')} || '<br>' || {_line('Base score', 'comb')} || '<br>' || {_line('Text', 'text')}
    || CASE WHEN len(evidence) > 0 THEN '<br><strong>Evidence:</strong><br>' || array_to_string(list_transform(evidence, lambda x: '- ' || {shown('x')}), '<br>') ELSE '' END
    || '<br>' || {_line('LLM score', 'llm')} || '<br>' || {_line('LLM reason', REASON)} || '<br>' || {_line('MF score', 'mf')} || '<br>' || {_line('Combined score', 'comb')}
  FROM k QUALIFY row_number() OVER (PARTITION BY "index", id ORDER BY pos DESC) = 1
)"""


_ITEMS = "items AS (SELECT idx, 0 AS item_pos, target_item.attributes AS m FROM e UNION ALL SELECT idx, generate_subscripts(history, 1), unnest(history).attributes FROM e)"
_PICKS = " UNION ALL ".join(f"SELECT idx, item_pos, {quoted(label)} AS label, {clean(f'm[{quoted(key)}]')} AS value FROM items" for key, label in ATTRIBUTE_LABELS.items())
_CARD = (
    "'<div class=\"history-card\"><div class=\"history-title\">' || " + esc("coalesce(x.name, 'Unknown item')") + " || '</div><div><strong>User rating:</strong> ' || coalesce(" + whole("x.user_stars") + ", 'N/A') || '</div><div><strong>Categories:</strong> ' || "
    "coalesce(nullif(" + esc("array_to_string(x.categories, ', ')") + ", ''), 'N/A') || '</div><div><strong>Attributes:</strong> ' || CASE WHEN len(" + attributes("x.attributes") + ") > 0 THEN array_to_string(list_sort(" + f"list_transform({attributes('x.attributes')}, lambda t: {esc('t')})" + "), '; ') ELSE 'N/A' END || '</div></div>'"
)

ORACLE = {
    "business_clean": f"WITH {B} SELECT business_id, name, array_to_string(categories, '|') AS categories, coalesce(len(map_keys(attributes)), 0)::BIGINT AS n_attributes, stars, review_count FROM b",
    "review_semi_join": f"WITH {B}, {V} SELECT * FROM v",
    "user_activity": f"WITH {B}, {V}, {U} SELECT * FROM u WHERE n BETWEEN 5 AND 50",
    "user_activity_tight": f"WITH {B}, {V}, {U} SELECT * FROM u WHERE n BETWEEN 7 AND 12",
    "user_sample": f"WITH {B}, {V}, {U}, {S} SELECT * FROM s",
    "target_item": f"WITH {B}, {V}, {U}, {S}, {H} SELECT user_id, business_id, name, ord, date, user_stars AS user_target_stars, stars AS global_stars, review_count FROM w1 JOIN b USING (business_id) WHERE rn = 1",
    "history_items": f"WITH {B}, {V}, {U}, {S}, {H} SELECT user_id, pos, business_id, name, ord, date, user_stars FROM hist JOIN b USING (business_id)",
    "examples_built": f"WITH {B}, {V}, {U}, {S}, {H}, g AS (SELECT user_id, count(*) AS n, string_agg(business_id, '|' ORDER BY pos) AS h FROM hist GROUP BY user_id) SELECT w1.user_id, coalesce(n, 0) AS n_history, coalesce(h, '') AS history, business_id AS target FROM w1 LEFT JOIN g USING (user_id) WHERE rn = 1",
    "example_summary": f"""WITH {E}, t AS (
  SELECT list_filter(coalesce(history, []), lambda h: h IS NOT NULL) AS hs, coalesce(target_item.user_target_stars, 0) AS st, length(coalesce(target_item.target_review_text, '')) AS len FROM e
), c AS (SELECT *, list_transform(hs, lambda h: coalesce(h.user_stars, 0)) AS ss FROM t)
SELECT count(*) AS n, round(avg(len(hs)) + 1e-9, 6) AS avg_history, round(avg(len) + 1e-9, 6) AS avg_target_length, min(len)::BIGINT AS min_target_length, max(len)::BIGINT AS max_target_length,
  count(*) FILTER (st >= 4) AS targets_positive, count(*) FILTER (st <= 2) AS targets_negative, count(*) FILTER (st < 4 AND st > 2) AS targets_neutral,
  round(avg(len(list_filter(ss, lambda s: s >= 4))) + 1e-9, 6) AS avg_positive, round(avg(len(list_filter(ss, lambda s: s <= 2))) + 1e-9, 6) AS avg_negative, round(avg(len(list_filter(ss, lambda s: s = 3))) + 1e-9, 6) AS avg_neutral FROM c""",
    "attribute_clean": f"WITH {E}, {_ITEMS}, p AS ({_PICKS}) SELECT * FROM p WHERE value IS NOT NULL",
    "attribute_text": f"WITH {E} SELECT idx, {attribute_text('target_item.attributes')} AS attributes FROM e",
    "history_prompt": f"WITH {E} SELECT idx, {history('history')} AS history FROM e",
    "target_prompt": f"WITH {E} SELECT idx, {target('target_item')} AS target FROM e",
    "argument_prompt": f"WITH {E} SELECT idx, {fill(ARGUMENT_PROMPT, history=history('history'), target=target('target_item'))} AS prompt FROM e",
    "json_extract": f"""WITH {R}, j AS (SELECT "index", CAST(parsed_json AS JSON) AS v FROM r)
SELECT "index", v IS NOT NULL AS is_object, CASE WHEN json_type(v->'arguments') = 'ARRAY' THEN json_array_length(v->'arguments')::BIGINT END AS n_arguments FROM j""",
    "validation_errors": f'WITH {R} SELECT "index", generate_subscripts(validation.errors, 1) AS pos, unnest(validation.errors).code AS code FROM r',
    "validation_status": f'WITH {R} SELECT "index", validation.is_valid AS is_valid, len(validation.errors)::BIGINT AS n_errors FROM r',
    "error_counts": f"WITH {R}, x AS (SELECT unnest(validation.errors).code AS code FROM r) SELECT code, count(*) AS n FROM x GROUP BY code",
    "valid_split": f"WITH {R} SELECT count(*) AS n, count(*) FILTER (validation.is_valid) AS valid, count(*) FILTER (NOT validation.is_valid) AS invalid FROM r",
    "invalid_records": f'WITH {R} SELECT "index", target_name FROM r WHERE NOT validation.is_valid',
    "record_report": f"""WITH {R} SELECT "index", 'Index: ' || coalesce(CAST("index" AS VARCHAR), 'None') || chr(10) || 'User: ' || coalesce(user_id, 'None') || chr(10) || 'Target: ' || coalesce(target_name, 'None') || chr(10)
  || 'Valid: ' || CASE WHEN validation.is_valid THEN 'True' WHEN NOT validation.is_valid THEN 'False' ELSE 'None' END
  || CASE WHEN len(validation.errors) > 0 THEN chr(10) || 'Errors:' || chr(10) || array_to_string(list_transform(validation.errors, lambda x: '  - ' || x.code || ': ' || x.message), chr(10)) ELSE '' END AS report FROM r""",
    "mf_rows": f"WITH {E}, {MF} SELECT * FROM m",
    "mf_rows_with_target": f"""WITH {E}, {MF} SELECT * FROM m UNION SELECT user_id, target_item.business_id, target_item.user_target_stars FROM e
WHERE coalesce(user_id, '') <> '' AND coalesce(target_item.business_id, '') <> '' AND target_item.user_target_stars IS NOT NULL""",
    "mf_summary": f"WITH {E}, {MF} SELECT count(*) AS num_rows, count(DISTINCT user_id) AS num_users, count(DISTINCT business_id) AS num_items FROM m",
    "mf_bias_predictions": f"WITH {E}, {MF}, {BIAS} SELECT idx, user_id, business_id, round(p + 1e-9, 6) AS predicted_rating, round((p - 1) / 4 + 1e-9, 6) AS score FROM pr",
    "score_gate": f"""WITH {R}, {E}, o AS (SELECT CASE WHEN NOT coalesce(validation.is_valid, false) THEN 'invalid' WHEN parsed_json IS NULL THEN 'no_json' WHEN "index" NOT IN (SELECT idx FROM e) THEN 'no_example' ELSE 'scored' END AS outcome FROM r)
SELECT outcome, count(*) AS n FROM o GROUP BY outcome""",
    "arguments": f"WITH {R}, {E}, {A} SELECT \"index\", pos, id, arg_type, text, array_to_string(evidence, '|') AS evidence FROM a",
    "argument_quarantine": f'WITH {R}, {E}, {A} SELECT "index", pos, reason FROM aa WHERE reason IS NOT NULL',
    "scoring_prompt": f"""WITH {R}, {E}, {A} SELECT "index", pos, {fill(SCORING_PROMPT, history=history('e.history'), target=target('e.target_item'), id='id', type='arg_type', text='text', evidence="CASE WHEN bare THEN CAST(to_json(evidence[1]) AS VARCHAR) ELSE '[' || array_to_string(list_transform(evidence, lambda x: coalesce(CAST(to_json(x) AS VARCHAR), 'null')), ', ') || ']' END")} AS prompt FROM a JOIN e ON e.idx = a."index" """,
    "llm_score_parse": f'WITH {R}, {E}, {A} SELECT "index", pos, round({LLM} + 1e-9, 6) AS llm_score, {REASON} AS llm_score_reason FROM a',
    "mf_fallback_score": f'WITH {E} SELECT idx AS "index", round(coalesce({norm("target_item.global_stars")}, 0.5) + 1e-9, 6) AS mf_score FROM e',
    "mf_precomputed_score": f"""WITH {E}, {MF}, {BIAS}, q AS (SELECT user_id, business_id, arg_max((p - 1) / 4, idx) AS score FROM pr GROUP BY 1, 2)
SELECT idx AS "index", round(coalesce(score, 0.5) + 1e-9, 6) AS mf_score FROM e LEFT JOIN q ON q.user_id = e.user_id AND q.business_id = e.target_item.business_id""",
    "score_arguments": f'WITH {R}, {E}, {A}, {C} SELECT "index", pos, id, arg_type, round(llm + 1e-9, 6) AS llm_score, round(mf + 1e-9, 6) AS mf_score, round(comb + 1e-9, 6) AS combined_score FROM k',
    "score_summary": f"""WITH {R}, {E}, {A}, {C} SELECT count(DISTINCT "index") AS num_records, count(*) AS num_arguments, round(avg(llm) + 1e-9, 6) AS avg_llm, round(avg(mf) + 1e-9, 6) AS avg_mf, round(avg(comb) + 1e-9, 6) AS avg_combined,
  round(avg(comb) FILTER (arg_type = 'support') + 1e-9, 6) AS avg_support, round(avg(comb) FILTER (arg_type = 'attack') + 1e-9, 6) AS avg_attack FROM k""",
    "graph_nodes": f'WITH {R}, {E}, {A}, {C}, {N} SELECT "index", node_id, node_type, text, round(base_score + 1e-9, 6) AS base_score FROM n',
    "graph_edges": f"WITH {R}, {E}, {A} SELECT \"index\", pos, id AS source_id, 'ROOT' AS target_id, {REL} AS relation_type FROM a",
    "graph_supporters": f'WITH {R}, {E}, {A}, {C}, {N} SELECT k."index", pos, id AS source_id, {REL} AS relation_type, round(base_score + 1e-9, 6) AS base_score FROM k JOIN n ON n."index" = k."index" AND n.node_id IS NOT DISTINCT FROM k.id',
    "dfquad_root": f"""WITH {R}, {E}, {A}, {C}, {N}, {D} SELECT d."index", n.text AS root_text, 0.5::DOUBLE AS root_base_score, round(sup + 1e-9, 6) AS aggregated_support, round(att + 1e-9, 6) AS aggregated_attack,
  round(CASE WHEN sup >= att THEN 0.5 + 0.5 * (sup - att) ELSE 0.5 - 0.5 * (att - sup) END + 1e-9, 6) AS final_score FROM d JOIN n ON n."index" = d."index" AND node_id = 'ROOT'""",
    "context_summary": f"""WITH {E} SELECT idx, user_id, target_item.name AS target, round({norm('target_item.user_target_stars')} + 1e-9, 6) AS target_score, coalesce(CASE WHEN target_item.attributes IS NULL THEN 0 ELSE len({attributes('target_item.attributes')}) END, 0)::BIGINT AS n_attributes,
  array_to_string(list_transform(list_filter(history, lambda h: h IS NOT NULL), lambda h: coalesce(h.name, 'NULL')), '|') AS history FROM e""",
    "graph_layout": f"""WITH {R}, {E}, {A}, {C}, {P} SELECT "index", node_id, round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y FROM p""",
    "tooltip_html": f'WITH {R}, {E}, {A}, {C}, {T} SELECT "index", node_id, tooltip FROM t',
    "history_html": f"""WITH {E}, c AS (SELECT idx, array_to_string(list_transform(list_filter(history, lambda y: y IS NOT NULL), lambda x: {_CARD}), '') AS html FROM e)
SELECT idx, CASE WHEN coalesce(html, '') = '' THEN '<div class=''history-empty''>No history available.</div>' ELSE html END AS html FROM c""",
    "select_slice": f"WITH {E} SELECT idx, user_id FROM e WHERE idx BETWEEN 10 AND 34",
    "record_lookup": f'WITH {R} SELECT "index", user_id, target_name FROM r WHERE "index" = 17',
    "template_validation": f'WITH {E} SELECT idx AS "index", 0::BIGINT AS n_errors FROM e',
    "predictions_parsed": f"""WITH {E}, q AS (SELECT idx, user_id, target_item.business_id AS business_id FROM e WHERE user_id IS NOT NULL AND target_item.business_id IS NOT NULL)
SELECT user_id, business_id, (idx % 100) / 100.0::DOUBLE AS score FROM q WHERE idx % 2 = 0 UNION ALL SELECT user_id, business_id, 1.0 FROM q WHERE idx % 2 = 0
UNION ALL SELECT user_id, business_id, (idx % 100)::DOUBLE FROM q WHERE idx % 2 = 1 AND idx % 3 <> 0""",
}

def _quote(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def _row(label: str, x: str) -> str:
    return f"'<div><strong>{label}:</strong> ' || {x} || '</div>'"


def _or_na(x: str) -> str:
    return f"coalesce(nullif({x}, ''), 'N/A')"


def _view(m: str) -> str:
    a = attributes(m)
    return f"CASE WHEN len({a}) > 0 THEN array_to_string(list_sort(list_transform({a}, lambda t: {esc('t')})), '; ') ELSE 'N/A' END"


_HISTORY = f"array_to_string(list_transform(list_filter(history, lambda y: y IS NOT NULL), lambda x: {_CARD}), '')"
_PANEL = (
    """'<div class="side-panel"><h2>Context</h2><div class="target-box"><div class="target-title">' || """ + esc("coalesce(target_item.name, 'Unknown target')") + " || '</div>' || "
    + " || ".join([_row("User target rating", f"coalesce({whole('target_item.user_target_stars')}, 'N/A')"), _row("User target score [0,1]", f"coalesce(CAST({norm('target_item.user_target_stars')} AS VARCHAR), 'N/A')"), _row("Global rating", "coalesce(CAST(target_item.global_stars AS VARCHAR), 'N/A')"), _row("Categories", _or_na(esc("array_to_string(target_item.categories, ', ')"))), _row("Attributes", _view("target_item.attributes"))])
    + f""" || '</div><h3>User history</h3><div class="history-list">' || CASE WHEN coalesce({_HISTORY}, '') = '' THEN '<div class=''history-empty''>No history available.</div>' ELSE {_HISTORY} END || '</div></div>'"""
)


def _three(x: str) -> str:
    return f"format('{{:.3f}}', {x} + 1e-9)"


def _attribute(name: str, x: str) -> str:
    return f"' {name}=\"' || {x} || '\"'"


_FIRST = "first_pos AS (SELECT \"index\", id AS node_id, min(pos) AS first FROM k GROUP BY 1, 2)"
_PAGES = f"""WITH {R}, {E}, {A}, {C}, {N}, {D}, {P}, {T}, {_FIRST}, z AS (
  SELECT d."index", n.text AS root_text, sup, att, CASE WHEN sup >= att THEN n.base_score + (1 - n.base_score) * (sup - att) ELSE n.base_score - n.base_score * (att - sup) END AS final FROM d JOIN n ON n."index" = d."index" AND node_id = 'ROOT'
), ln AS (
  SELECT k."index", string_agg('<line class="' || {REL} || '"' || {_attribute('x1', 'a.x')} || {_attribute('y1', 'a.y')} || {_attribute('x2', 'b.x')} || {_attribute('y2', 'b.y')} || '/>', '' ORDER BY pos) AS lines
  FROM k JOIN p a ON a."index" = k."index" AND a.node_id IS NOT DISTINCT FROM k.id JOIN p b ON b."index" = k."index" AND b.node_id = 'ROOT' GROUP BY 1
), ci AS (
  SELECT n."index", string_agg('<g data-id="' || {shown('n.node_id')} || '"><circle r="46"' || {_attribute('cx', 'x')} || {_attribute('cy', 'y')} || '/><text' || {_attribute('x', 'x')} || {_attribute('y', 'y')} || '>' || {shown('n.node_id')} || ' ' || {_three("CASE WHEN n.node_id = 'ROOT' THEN final ELSE n.base_score END")} || '</text></g>', '' ORDER BY n.node_id IS DISTINCT FROM 'ROOT', first) AS circles,
    string_agg({_quote("coalesce(n.node_id, 'None')")} || ':' || {_quote('tooltip')}, ',' ORDER BY n.node_id IS DISTINCT FROM 'ROOT', first) AS tips
  FROM n JOIN p ON p."index" = n."index" AND p.node_id IS NOT DISTINCT FROM n.node_id JOIN t ON t."index" = n."index" AND t.node_id IS NOT DISTINCT FROM n.node_id JOIN z ON z."index" = n."index"
  LEFT JOIN first_pos ON first_pos."index" = n."index" AND first_pos.node_id IS NOT DISTINCT FROM n.node_id GROUP BY 1
)
SELECT z."index", {quoted(graph.PAGE_HEAD)} || {_PANEL} || '<main><h1>' || {esc('root_text')} || '</h1><p>Record ' || z."index" || ', user ' || {esc("coalesce(e.user_id, 'N/A')")} || ', final score ' || {_three('final')} || ', support ' || {_three('sup')} || ', attack ' || {_three('att')}
  || {quoted(graph.PAGE_SVG)} || lines || circles || {quoted(graph.PAGE_TIPS)} || '{{' || replace(tips, '<', '\\u003c') || '}}' || {quoted(graph.PAGE_TAIL)} AS html
FROM z JOIN ln ON ln."index" = z."index" JOIN ci ON ci."index" = z."index" JOIN e ON e.idx = z."index" """
_SEEN = "CASE WHEN len(hs) > 0 THEN coalesce(hs[1].name, 'Unknown') ELSE 'previous visits' END"
_ANSWER = " || ', ' || ".join(f"""'{{"id": "{i}", "type": "{t}", "text": ' || {_quote(x)} || ', "evidence": [' || {_quote(y)} || ']}}'""" for i, t, x, y in (("A1", "support", "name || ' resembles ' || seen || '.'", "seen"), ("A2", "support", "'The history fits ' || name || '.'", "'history with ' || seen"), ("A3", "attack", "name || ' may disappoint.'", "name"), ("A4", "attack", "'Nothing else speaks for ' || name || '.'", "name")))
ORACLE |= {
    "context_html": f"WITH {E} SELECT idx, {_PANEL} AS html FROM e",
    "graph_pages": _PAGES,
    "template_answers": f"""WITH {E}, h AS (SELECT *, list_filter(coalesce(history, []), lambda h: h IS NOT NULL) AS hs FROM e), x AS (SELECT idx, coalesce(target_item.name, 'Unknown') AS name, {_SEEN} AS seen FROM h)
SELECT idx AS "index", '' AS user_id, '{{"arguments": [' || {_ANSWER} || ']}}' AS raw_output FROM x""",
    "generated_scores": f"WITH {R}, {E}, {A} SELECT \"index\", pos, 0.5::DOUBLE AS llm_score, 'template' AS reason FROM a",
}
#: The same over all users with enough reviews.
ORACLE |= {f"{n}_all": ORACLE[n].replace(S, SA) for n in ("target_item", "history_items", "examples_built")}
