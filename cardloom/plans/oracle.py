"""Independent SQL (DuckDB dialect) for the registered queries.

The SQL restates each operator; only fixed values (templates, phrases, patterns,
label texts) are taken from the package's tables.
"""

from __future__ import annotations

import re

from cardloom.functions.card_tokens import PHRASES
from cardloom.functions.common import WHITESPACE
from cardloom.functions.label_rules import FALLBACK, RULES, TAXONOMY, Rule
from cardloom.functions.type_line import CANONICAL_TYPES
from cardloom.plans.demo_cards import TEMPLATES, TYPE_LINES
from cardloom.sources.ingest import EXPECTED_OUTPUTS


def _text(value: str) -> str:
    """SQL string literal; control and unusual space characters as chr() calls."""
    out, plain = [], ""
    for ch in value:
        if ch == " " or (ch.isprintable() and not ch.isspace()):
            plain += ch
            continue
        if plain:
            out.append("'" + plain.replace("'", "''") + "'")
            plain = ""
        out.append(f"chr({ord(ch)})")
    if plain or not out:
        out.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


_WS = _text(WHITESPACE)
_NL = "chr(10)"
_WORD = r"[\p{L}\p{N}_]"


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


# Derived tables


_CASES = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in TYPE_LINES.items())
CARDS = f"""
cards AS (
  SELECT 'c' || lpad(p_partkey::VARCHAR, 12, '0') AS id,
         CASE WHEN p_partkey % 7 <> 0 THEN 'o' || (p_partkey // 2)::VARCHAR END AS oracle_id,
         CASE WHEN p_partkey % 97 <> 0 THEN p_name END AS name,
         DATE '2000-01-01' + (p_partkey % 9000)::INTEGER AS released_at,
         lower(p_type) AS layout,
         CASE p_type {_CASES} END AS type_line,
         CASE WHEN p_partkey % 89 <> 0
              THEN replace({_list(TEMPLATES)}[1 + p_partkey % {len(TEMPLATES)}], '@', p_name)
         END AS oracle_text,
         p_brand AS rarity,
         CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 19) / 2.0::DOUBLE END AS cmc,
         CASE WHEN p_size % 5 = 0 THEN '*' ELSE p_size::VARCHAR END AS power
  FROM part
)"""

CLUSTERS = """
clusters AS (
  SELECT 'c' || lpad(p_partkey::VARCHAR, 12, '0') AS id, p_size % 7 AS cluster
  FROM part WHERE p_partkey % 10 <> 9
)"""


def _normalized(source: str, key: str, text: str, name: str, cte: str, replace: bool, strip: bool):
    """CTE ``cte(id, oracle_text_norm)`` from a table."""
    own = r"'(^|[^\p{L}\p{N}_])\Q' || nm || '\E([^\p{L}\p{N}_]|$)'"
    # Each pass uses up the characters around a mention, so neighbours need a second.
    once = rf"regexp_replace(t1, {own}, '\1this card\2', 'g')"
    twice = rf"regexp_replace({once}, {own}, '\1this card\2', 'g')"
    named = f"CASE WHEN nm <> '' AND contains(t1, nm) THEN {twice} ELSE t1 END" if replace else "t1"
    t1 = r"regexp_replace(t0, '\([^)]*\)', '', 'g')" if strip else "t0"
    lines = f"list_transform(string_split(t3, {_NL}), lambda l: {_strip('l')})"
    unix = f"replace(replace(coalesce({text}, ''), chr(13) || {_NL}, {_NL}), chr(13), {_NL})"
    squeezed = rf"regexp_replace(t4, '\n{{3,}}', {_NL} || {_NL}, 'g')"
    return f"""
{cte}0 AS (SELECT {key} AS id, {_strip(f"coalesce({name}, '')")} AS nm, {_strip(unix)} AS t0
           FROM {source}),
{cte}1 AS (SELECT id, nm, {t1} AS t1 FROM {cte}0),
{cte}2 AS (SELECT id, {named} AS t2 FROM {cte}1),
{cte}3 AS (SELECT id, regexp_replace(t2, '[ \\t]+', ' ', 'g') AS t3 FROM {cte}2),
{cte}4 AS (SELECT id, array_to_string({lines}, {_NL}) AS t4 FROM {cte}3),
{cte} AS (SELECT id, {_strip(squeezed)} AS oracle_text_norm FROM {cte}4)"""


NORM = _normalized("cards", "id", "oracle_text", "name", "norm", True, False)


def _tokens(source: str, text: str, cte: str) -> str:
    """CTE ``cte(id, tokens)``: the card tokeniser."""
    kept = (
        f"list_filter(list_transform(string_split({_strip(f'coalesce({text}, {_text("")})')}, {_NL}), "
        f"lambda l: {_strip('l')}), lambda l: l <> '')"
    )
    glued = "t"
    for phrase in sorted(PHRASES, key=len, reverse=True):
        glued = rf"regexp_replace({glued}, '\b{phrase}\b', '{phrase.replace(' ', '_')}', 'g')"
    # An unclosed brace only occurs in one template, as "{unclosed brace and {C}", which
    # closes; braces in the given tables are balanced.
    scan = r"'\n|\{[^}\n]+\}|[^ .,;:!?{\n]+'"
    typed = f"""CASE WHEN k = {_NL} THEN 'NEWLINE'
      WHEN regexp_full_match(k, '\\{{[^}}]+\\}}') THEN 'MANA:' || upper(k)
      WHEN regexp_full_match(k, '[+-]\\d/[+-]\\d') THEN 'COUNTER:' || k
      WHEN regexp_full_match(k, '\\d+') THEN 'NUM:' || k ELSE k END"""
    return f"""
{cte}0 AS (SELECT id, lower(array_to_string({kept}, {_NL})) AS t FROM {source}),
{cte}1 AS (SELECT id, rtrim({glued}, ' .,;:!?' || {_NL}) AS t FROM {cte}0),
{cte} AS (SELECT id, list_transform(regexp_extract_all(t, {scan}), lambda k: {typed}) AS tokens
          FROM {cte}1)"""


TOKENS = _tokens("norm", "oracle_text_norm", "tok")

_CANON = _list(CANONICAL_TYPES)


def _cut(sep: str) -> str:
    at = f"instr(f, {_text(sep)})"
    return f"[substr(f, 1, {at} - 1), substr(f, {at} + {len(sep)})]"


TYPES = f"""
faces AS (
  SELECT id, i - 1 AS face, {_strip("string_split(type_line, '//')[i]")} AS f
  FROM (SELECT id, type_line, unnest(range(1, len(string_split(type_line, '//')) + 1)) AS i
        FROM cards WHERE type_line <> '')
),
halves AS (
  SELECT id, face, f,
         CASE WHEN contains(f, '—') THEN {_cut("—")} WHEN contains(f, ' - ') THEN {_cut(" - ")}
              WHEN contains(f, '-') THEN {_cut("-")} ELSE [f, ''] END AS h
  FROM faces
),
words AS (
  SELECT id, face, f,
         list_filter(string_split({_strip("h[1]")}, ' '), lambda t: t <> '') AS main,
         list_filter(string_split({_strip("h[2]")}, ' '), lambda t: t <> '') AS sub
  FROM halves
),
parsed AS (
  SELECT id, face, f AS raw_face_type_line,
         list_filter(main, lambda t: list_contains({_CANON}, t)) AS basic_types,
         list_filter(main, lambda t: NOT list_contains({_CANON}, t)) AS super_types,
         sub AS sub_types
  FROM words
),
types AS (
  SELECT c.id, coalesce(flatten(list(basic_types ORDER BY face) FILTER (face IS NOT NULL)), []) AS basic_types,
         coalesce(flatten(list(super_types ORDER BY face) FILTER (face IS NOT NULL)), []) AS super_types,
         coalesce(flatten(list(sub_types ORDER BY face) FILTER (face IS NOT NULL)), []) AS sub_types,
         count(face)::INTEGER AS faces
  FROM cards c LEFT JOIN parsed p ON c.id = p.id GROUP BY c.id
)"""


def _search(pattern: str, text: str = "txt") -> str:
    # RE2 knows word boundaries of ASCII only, and no look-around; the patterns have
    # boundaries at their ends or beside an alternation bar.
    starts = re.sub(r"(^|\|)\\b", rf"\1(?:^|[^\\p{{L}}\\p{{N}}_])", pattern)
    whole = starts.replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")
    return f"regexp_matches({text}, {_text(whole)})"


def _condition(rule: Rule) -> str:
    tests = []
    for name, wanted in rule.types:
        tests.append(("" if wanted else "NOT ") + f"list_contains(kinds, '{name}')")
    if rule.blank is not None:
        tests.append(f"{_strip('txt')} {'=' if rule.blank else '<>'} ''")
    if rule.words:
        tests.append("(" + " OR ".join(f"contains(txt, {_text(w)})" for w in rule.words) + ")")
    tests += [f"NOT contains(txt, {_text(s)})" for s in rule.signals]
    for patterns in (rule.any_of, rule.also):
        if patterns:
            tests.append("(" + " OR ".join(_search(p) for p in patterns) + ")")
    tests += [f"NOT {_search(p)}" for p in rule.unless]
    return " AND ".join(tests)


def _record(rule: Rule, place: int) -> str:
    return (
        f"{{'place': {place}, 'label': {_text(rule.label)}, "
        f"'confidence': {rule.confidence}::DOUBLE, 'reason': {_text(rule.reason)}}}"
    )


_RULE_CASES = ",\n".join(
    f"CASE WHEN {_condition(r)} THEN {_record(r, i)} END" for i, r in enumerate(RULES)
)


def _labels(source: str, norm: str, raw: str, kinds: str, cte: str) -> str:
    """CTE ``cte(id, label_rank, label, confidence, reason)`` from a table."""
    return f"""
{cte}0 AS (SELECT id, lower(coalesce(nullif({norm}, ''), nullif({raw}, ''), '')) AS txt,
           list_transform({kinds}, lambda k: lower(k)) AS kinds FROM {source}),
{cte}1 AS (SELECT id, list_filter([{_RULE_CASES}], lambda m: m IS NOT NULL) AS hits FROM {cte}0),
{cte}2 AS (SELECT id, unnest(CASE WHEN len(hits) > 0 THEN hits ELSE [{_record(FALLBACK, 99)}] END) AS m
           FROM {cte}1),
{cte} AS (SELECT id, m.label AS label, m.confidence AS confidence, m.reason AS reason,
          row_number() OVER (PARTITION BY id ORDER BY m.confidence DESC, m.place)::INTEGER AS label_rank
          FROM {cte}2)"""


ENRICHED = """
enriched AS (SELECT c.*, n.oracle_text_norm, t.basic_types, t.super_types, t.sub_types
             FROM cards c JOIN norm n ON c.id = n.id JOIN types t ON c.id = t.id)"""
LABELS = _labels("enriched", "oracle_text_norm", "oracle_text", "basic_types", "lab")
PER_CARD = """
percard AS (
  SELECT id, arg_min(label, label_rank) AS primary_label,
         string_agg(label, '|' ORDER BY label_rank) AS labels,
         '{' || string_agg('"' || label || '":' || confidence::VARCHAR, ',' ORDER BY label_rank) || '}'
           AS label_confidences,
         '{' || string_agg('"' || label || '":"rule"', ',' ORDER BY label_rank) || '}' AS label_sources,
         '{' || string_agg('"' || label || '":"' || reason || '"', ',' ORDER BY label_rank) || '}'
           AS label_reasons,
         max(confidence) AS max_confidence,
         bool_or(label = 'needs_review') OR max(confidence) < 0.6 AS needs_review
  FROM lab GROUP BY id
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_LABELLED = (CARDS, CLUSTERS, NORM, TYPES, ENRICHED, LABELS, PER_CARD)


# TF-IDF


def _grams(source: str, key: str, text: str, cte: str, low: int = 1, high: int = 2) -> str:
    """CTE ``cte(id, term, tf)``."""
    lists = []
    for n in range(low, high + 1):
        term = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
        lists.append("w" if n == 1 else f"list_transform(range(1, len(w) - {n - 2}), lambda i: {term})")
    together = lists[0] if len(lists) == 1 else f"list_concat({', '.join(lists)})"
    return f"""
{cte}0 AS (SELECT {key} AS id, regexp_extract_all(lower(coalesce({text}, '')), '{_WORD}+') AS w
           FROM {source}),
{cte} AS (SELECT id, term, count(*) AS tf
          FROM (SELECT id, unnest({together}) AS term FROM {cte}0) GROUP BY id, term)"""


def _vocabulary(grams: str, source: str, min_df: int = 3) -> str:
    return f"""
size AS (SELECT count(*) AS n FROM {source}),
kept AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS corpus_tf FROM {grams} GROUP BY term
         HAVING count(*) >= {min_df} AND count(*) <= 0.9 * (SELECT n FROM size)),
vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_idx, df, corpus_tf,
          ln((1.0 + (SELECT n FROM size)) / (1.0 + df)) + 1.0 AS idf FROM kept)"""


def _weights(grams: str, cte: str) -> str:
    return f"""
{cte}0 AS (SELECT g.id, g.term, v.term_idx, (1.0 + ln(g.tf)) * v.idf AS s
           FROM {grams} g JOIN vocab v ON g.term = v.term),
{cte} AS (SELECT id, term, term_idx, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS weight FROM {cte}0)"""


_DOC_GRAMS = _grams("documents", "doc_id", "text", "g")
_DOC_VOCAB = (_DOC_GRAMS, _vocabulary("g", "documents"))
_DOC_WEIGHTS = (*_DOC_VOCAB, _weights("g", "wt"))
_NEW_WEIGHTS = (_grams("benchmark", "item_id", "text", "bg"), _weights("bg", "bw"))


def _nearest(queries: str, corpus_ids: str, query_ids: str, k: int, self_join: bool) -> str:
    """Ranked neighbours with zero scores filled in, as CTE ``near``."""
    other = "WHERE q.id <> d.id" if self_join else ""
    return f"""
sims AS (SELECT q.id AS query_id, d.id AS id, round(sum(q.weight * d.weight), 9) AS score
         FROM {queries} q JOIN wt d ON q.term_idx = d.term_idx {other} GROUP BY q.id, d.id),
scored AS (SELECT q.id AS query_id, d.id AS id, coalesce(s.score, 0.0) AS score
           FROM ({query_ids}) q CROSS JOIN ({corpus_ids}) d
           LEFT JOIN sims s ON s.query_id = q.id AND s.id = d.id {other}),
near AS (SELECT query_id, id, score, rank FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
           FROM scored) WHERE rank <= {k})"""


def _similar_to(query: str, table: str, key: str, columns: str) -> str:
    return f"""
q AS (SELECT * FROM wt WHERE id = ({query})),
sims AS (SELECT d.id, round(sum(q.weight * d.weight), 9) AS score
         FROM q JOIN wt d ON q.term_idx = d.term_idx GROUP BY d.id)
SELECT t.{key} AS id, {columns}, round(coalesce(s.score, 0.0), 3) AS score,
    row_number() OVER (ORDER BY coalesce(s.score, 0.0) DESC, t.{key})::INTEGER AS rank
FROM {table} t LEFT JOIN sims s ON s.id = t.{key}
WHERE t.{key} <> ({query}) ORDER BY coalesce(s.score, 0.0) DESC, t.{key} LIMIT 10"""


# Embeddings with their label as cluster


_MEMBERS = """
dims AS (SELECT vec_id AS id, label AS cluster, i - 1 AS dim, embedding[i]::DOUBLE AS x
         FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
centers AS (SELECT cluster, dim, avg(x) AS c FROM dims GROUP BY cluster, dim)"""

_TAXONOMY = ", ".join(
    f"({_text(t.label)}, {_text(t.category)}, {_text(t.description)})" for t in TAXONOMY
)
_TYPED = ("basic_types", "super_types", "sub_types")
_JOINED_TYPES = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in _TYPED)

_GONE = [e for e in EXPECTED_OUTPUTS if e not in ("cards_core", "type_features", "vectors/row_ids")]
_NULLABLE = (
    "id", "oracle_id", "name", "released_at", "layout", "type_line", "oracle_text", "rarity",
    "cmc", "power", "cluster",
)

ORACLE_SQL: dict[str, str] = {
    "core_projection": _with(CARDS)
    + """SELECT id, oracle_id, name, strftime(released_at, '%Y-%m-%d') AS released_at,
         NULL::VARCHAR AS lang, layout, type_line, oracle_text, rarity, cmc,
         trunc(cmc)::INTEGER AS cmc_int, power FROM cards""",
    "json_scan": _with(CARDS)
    + """SELECT id, name, strftime(released_at, '%Y-%m-%d') AS released_at, oracle_text, cmc,
         NULL::VARCHAR AS set_name FROM cards""",
    "parquet_round_trip": _with(CARDS, TYPES)
    + "SELECT id, array_to_string(basic_types, '|') AS basic_types, faces FROM types",
    "manifest_lookup": """
        SELECT source AS bulk_type, source || '-' || count(*) AS name,
               'file:/landing/' || source AS download_uri,
               '2026-01-02T03:04:' || (10 + max(n_chars) % 50) AS updated_at,
               source || '_20260102T0304' || (10 + max(n_chars) % 50) || '.json' AS saved_as
        FROM documents WHERE source = 'src7' GROUP BY source""",
    "ingest_versions": _with(CARDS)
    + """SELECT updated_at, 'cards_' || replace(updated_at, '-', '') || '.json' AS saved_as,
         count(*) AS cards, count(DISTINCT name) AS names
         FROM cards JOIN (VALUES ('2026-01-02', 3), ('2026-01-05', 0)) AS v(updated_at, skip)
         ON skip = 0 OR substr(id, 2)::BIGINT % 3 <> 0 GROUP BY updated_at""",
    "missing_by_source": """
        SELECT 'source=' || coalesce(source, 'none') AS output FROM documents
        GROUP BY 1 HAVING coalesce(max(n_chars), 0) <= 8000""",
    "validate_outputs": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {ok} AS has_columns, {ok} AS is_valid "
        f"FROM part {where}"
        for t, ok, where in (
            ("cards_core", "true", ""),
            ("type_features", "true", ""),
            ("oracle_tokens", "true", ""),
            ("cards_enriched", "false", ""),
            ("oracle_clusters", "true", "WHERE p_partkey % 10 <> 9"),
        )
    ),
    "missing_outputs": "SELECT * FROM (VALUES "
    + ", ".join(f"({_text(e)})" for e in _GONE)
    + ") AS t(output)",
    "normalize_text": _with(CARDS, NORM) + "SELECT id, oracle_text_norm FROM norm",
    "normalize_documents": _with(
        _normalized("documents", "doc_id", "text", "lang", "norm", True, False)
    )
    + "SELECT id, oracle_text_norm FROM norm",
    "strip_reminder": _with(
        CARDS, _normalized("cards", "id", "oracle_text", "name", "norm", False, True)
    )
    + "SELECT id, oracle_text_norm FROM norm",
    "card_tokens": _with(CARDS, NORM, TOKENS)
    + """SELECT id, len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, '¦') AS oracle_tokens
         FROM tok""",
    "document_tokens": _with(
        "d AS (SELECT doc_id AS id, text FROM documents)", _tokens("d", "text", "tok")
    )
    + """SELECT id, len(tokens)::INTEGER AS n_tokens, md5(array_to_string(tokens, '¦')) AS digest
         FROM tok""",
    "type_features": _with(CARDS, TYPES)
    + f"""SELECT c.id, c.oracle_id, c.name, c.type_line, {_JOINED_TYPES}
          FROM cards c JOIN types t ON c.id = t.id""",
    "type_faces": _with(CARDS, TYPES)
    + f"SELECT id, face::INTEGER AS face, raw_face_type_line, {_JOINED_TYPES} FROM parsed",
    "type_frequency": _with(CARDS, TYPES)
    + """SELECT basic_type, count(*) AS count FROM (SELECT unnest(basic_types) AS basic_type FROM types)
         GROUP BY basic_type""",
    "word_grams": f"""
        WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{_WORD}+') AS w FROM documents)
        SELECT id, len(w)::INTEGER AS n_words, (len(w) + greatest(len(w) - 1, 0))::INTEGER AS n_grams,
          md5(array_to_string(list_concat(
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
            list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])),
            '¦')) AS digest FROM w""",
    "enriched_join": _with(CARDS, CLUSTERS, NORM, TOKENS, TYPES)
    + f"""SELECT c.id, oracle_text_norm, {_JOINED_TYPES}, len(tokens)::INTEGER AS n_tokens, cluster
          FROM cards c JOIN norm n ON c.id = n.id JOIN types t ON c.id = t.id
          JOIN tok k ON c.id = k.id LEFT JOIN clusters x ON c.id = x.id""",
    "suffix_join": _with(CARDS, TYPES)
    + """SELECT c.id, array_to_string(basic_types, '|') AS basic_types,
         array_to_string(basic_types, '|') AS basic_types_type_features,
         array_to_string(sub_types, '|') AS sub_types_type_features, faces
         FROM cards c JOIN types t ON c.id = t.id""",
    "optional_cluster_join": _with(CARDS, CLUSTERS)
    + """SELECT c.id, name, NULL::INTEGER AS no_cluster, cluster
         FROM cards c LEFT JOIN clusters x ON c.id = x.id""",
    "lookup_default": _with(CARDS, CLUSTERS)
    + """SELECT c.id, coalesce(cluster, -1) AS cluster
         FROM cards c LEFT JOIN clusters x ON c.id = x.id""",
    "row_alignment_check": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS matrix_row, doc_id AS id,
        lang FROM documents""",
    "card_labels": _with(*_LABELLED)
    + """SELECT c.id, oracle_id, name, type_line, cmc, cluster, primary_label, labels,
         label_confidences, label_sources, label_reasons, max_confidence, needs_review
         FROM cards c JOIN percard p ON c.id = p.id LEFT JOIN clusters x ON c.id = x.id""",
    "labels_long": _with(*_LABELLED)
    + "SELECT id, label_rank, label, confidence, 'rule' AS source, reason FROM lab",
    "document_labels": _with(
        "d AS (SELECT doc_id AS id, text, ['Creature'] AS kinds FROM documents)",
        _labels("d", "NULL::VARCHAR", "text", "kinds", "lab"),
    )
    + """SELECT id, arg_min(label, label_rank) AS primary_label,
         string_agg(label, '|' ORDER BY label_rank) AS labels FROM lab GROUP BY id""",
    "best_label_match": _with(
        CARDS, NORM, TYPES, ENRICHED, LABELS,
        _labels("enriched", "NULL::VARCHAR", "oracle_text", "basic_types", "raw"),
    )
    + """SELECT id, label, confidence, source, reason FROM (
         SELECT id, label, round(confidence + [0.02, -0.02, 0.0][length(label) % 3 + 1], 2)::DOUBLE AS confidence,
             'raw' AS source, reason, 0 AS place FROM raw UNION ALL
         SELECT id, label, confidence::DOUBLE, 'normalised', reason, 1 FROM lab)
         QUALIFY row_number() OVER (PARTITION BY id, label ORDER BY confidence DESC, place, reason) = 1""",
    "label_summary": _with(*_LABELLED)
    + """SELECT count(*) AS cards_labeled, count(DISTINCT primary_label) AS primary_labels,
         round(avg(needs_review::INTEGER), 6) AS review_share,
         (SELECT count(DISTINCT cluster) FROM clusters) AS clusters FROM percard""",
    "primary_label_counts": _with(*_LABELLED)
    + """SELECT primary_label, count(*) AS count FROM percard GROUP BY primary_label
         ORDER BY count DESC, primary_label""",
    "taxonomy_join": _with(
        *_LABELLED, f"taxonomy AS (SELECT * FROM (VALUES {_TAXONOMY}) AS t(label, category, description))"
    )
    + """SELECT category, label, description, count(*) AS cards
         FROM lab LEFT JOIN taxonomy USING (label) GROUP BY category, label, description""",
    "filter_by_name": _with(CARDS, NORM)
    + """SELECT c.id, name, oracle_text_norm FROM cards c JOIN norm n ON c.id = n.id
         WHERE name = 'blue bolt'""",
    "filter_in": _with(CARDS, TYPES)
    + """SELECT c.id, name, type_line, array_to_string(basic_types, '|') AS basic_types
         FROM cards c JOIN types t ON c.id = t.id WHERE name IN ('red rod', 'hot gizmo')""",
    "filter_cluster": _with(CARDS, CLUSTERS)
    + """SELECT c.id, coalesce(name, '') AS name, coalesce(type_line, '') AS type_line
         FROM cards c JOIN clusters x ON c.id = x.id WHERE cluster = 3""",
    "first_match": _with(CARDS)
    + "SELECT id, name FROM cards WHERE lower(name) = 'old anvil' ORDER BY id LIMIT 1",
    "null_share": _with(
        CARDS, CLUSTERS, "j AS (SELECT c.*, cluster FROM cards c LEFT JOIN clusters x ON c.id = x.id)"
    )
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INTEGER), 6) AS null_share FROM j"
        for c in _NULLABLE
    )
    + ") ORDER BY null_share DESC, column_name LIMIT 6",
    "key_uniqueness": _with(CARDS)
    + """SELECT count(*) AS row_count, count(DISTINCT oracle_id) AS distinct_count,
         count(*) = count(DISTINCT oracle_id) AS is_unique FROM cards""",
    "distinct_count": _with(CLUSTERS)
    + "SELECT count(DISTINCT cluster) AS distinct_count FROM clusters",
    "cmc_histogram": _with(CARDS)
    + """SELECT round_even(cmc, 0)::INTEGER AS value, count(*) AS count FROM cards
         WHERE cmc IS NOT NULL GROUP BY 1""",
    "cmc_range": _with(CARDS)
    + """SELECT min(round_even(cmc, 0))::INTEGER AS min_value, max(round_even(cmc, 0))::INTEGER AS max_value
         FROM cards""",
    "value_counts": "SELECT lower(p_type) AS layout, count(*) AS count FROM part GROUP BY 1",
    "cluster_value_counts": _with(CLUSTERS)
    + """SELECT cluster, count(*) AS count FROM clusters GROUP BY cluster
         ORDER BY count DESC, cluster LIMIT 20""",
    "size_summary": _with(CLUSTERS, "s AS (SELECT count(*) AS size FROM clusters GROUP BY cluster)")
    + """SELECT count(*) AS count, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std,
         min(size) AS min, round(quantile_cont(size, 0.25), 6) AS q25,
         round(quantile_cont(size, 0.5), 6) AS q50, round(quantile_cont(size, 0.75), 6) AS q75,
         max(size) AS max FROM s""",
    "size_rank": _with(CLUSTERS)
    + """SELECT cluster, count(*) AS size,
         row_number() OVER (ORDER BY count(*) DESC, cluster)::INTEGER AS size_rank
         FROM clusters GROUP BY cluster""",
    "shape": "SELECT count(*) AS row_count, 14::BIGINT AS column_count FROM part",
    "head_rows": _with(CARDS, TYPES)
    + """SELECT c.id, name, array_to_string(sub_types, '|') AS sub_types
         FROM cards c JOIN types t ON c.id = t.id ORDER BY name NULLS FIRST, c.id LIMIT 5""",
    "tail_rows": "SELECT doc_id AS id, lang, n_chars FROM documents ORDER BY doc_id DESC LIMIT 20",
    "seeded_sample": """SELECT doc_id AS id, lang FROM documents
        ORDER BY md5('42:' || doc_id), doc_id LIMIT 50""",
    "capped_sample": _with(CARDS)
    + "SELECT id, name FROM cards ORDER BY md5('42:' || id), id LIMIT 500",
    "clean_strings": _with(CARDS)
    + """SELECT id, '[' || array_to_string(list_transform(
           list_filter([name, type_line, cmc::VARCHAR], lambda x: x IS NOT NULL),
           lambda x: '"' || x || '"'), ',') || ']' AS items FROM cards""",
    "tfidf_vocabulary": _with(*_DOC_VOCAB)
    + "SELECT term, term_idx, df, corpus_tf, round(idf, 6) AS idf FROM vocab",
    "capped_vocabulary": _with(
        _grams("documents", "doc_id", "text", "g", 1, 1),
        _vocabulary("g", "documents", 2),
        "top AS (SELECT * FROM kept ORDER BY corpus_tf DESC, term LIMIT 5000)",
    )
    + """SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_idx, df, corpus_tf
         FROM top""",
    "term_frequencies": _with(_DOC_GRAMS)
    + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS corpus_tf FROM g GROUP BY term",
    "tfidf_weights": _with(*_DOC_WEIGHTS)
    + "SELECT id, term, term_idx, round(weight, 6) AS weight FROM wt",
    "tfidf_transform": _with(*_DOC_VOCAB, *_NEW_WEIGHTS)
    + "SELECT id, term, round(weight, 6) AS weight FROM bw",
    "tfidf_shape": _with(*_DOC_VOCAB)
    + "SELECT (SELECT n FROM size) AS row_count, count(*) AS term_count FROM vocab",
    "saved_vectors": _with(*_DOC_WEIGHTS)
    + """SELECT doc_id AS id, count(term_idx)::INTEGER AS n_terms,
         coalesce(round(sum(weight * weight), 6), 0.0) AS squared_length,
         md5(coalesce(string_agg(term_idx::VARCHAR, ',' ORDER BY term_idx), '')) AS digest
         FROM documents LEFT JOIN wt ON doc_id = id GROUP BY doc_id""",
    "similar_to_doc": _with(
        *_DOC_WEIGHTS,
        _similar_to(
            "SELECT min(doc_id) FROM documents WHERE source = 'src7'", "documents", "doc_id",
            "lang, source",
        ),
    ),
    "similar_cards": _with(
        CARDS, NORM, _grams("norm", "id", "oracle_text_norm", "g"), _vocabulary("g", "norm"),
        _weights("g", "wt"),
        _similar_to(
            "SELECT min(id) FROM cards WHERE lower(name) = 'blue rod'", "cards", "id",
            "name, type_line",
        ),
    ),
    "find_similar": _with(
        CARDS, NORM, _grams("norm", "id", "oracle_text_norm", "g"), _vocabulary("g", "norm"),
        _weights("g", "wt"),
        _similar_to(
            "SELECT min(id) FROM cards WHERE lower(name) = 'hot gizmo'", "cards", "id",
            "name, type_line",
        ),
    ),
    "similar_batch": _with(
        *_DOC_WEIGHTS, *_NEW_WEIGHTS,
        _nearest("bw", "SELECT doc_id AS id FROM documents", "SELECT item_id AS id FROM benchmark",
                 5, False),
    )
    + "SELECT query_id, id, score, rank FROM near",
    "similar_all_pairs": _with(
        *_DOC_WEIGHTS,
        _nearest("wt", "SELECT doc_id AS id FROM documents", "SELECT doc_id AS id FROM documents",
                 10, True),
    )
    + "SELECT query_id, id, score, rank FROM near",
    "cluster_stats": _with(CARDS, CLUSTERS)
    + """SELECT cluster, count(*) AS cluster_size, round(avg(cmc), 6) AS avg_cmc,
         round(median(cmc), 6) AS median_cmc FROM cards c JOIN clusters x ON c.id = x.id GROUP BY cluster""",
    "cluster_top_items": _with(
        CARDS, CLUSTERS, TYPES,
        """items AS (SELECT cluster, t.id, i AS pos, sub_types[i] AS item FROM
             (SELECT *, unnest(range(1, len(sub_types) + 1)) AS i FROM types) t
             JOIN clusters x ON t.id = x.id)""",
        """firsts AS (SELECT cluster, item, count(*) AS count, min((id, pos)) AS met FROM items
             WHERE trim(item) <> '' GROUP BY cluster, item)""",
        """ranked AS (SELECT cluster, item, count,
             row_number() OVER (PARTITION BY cluster ORDER BY count DESC, met)::INTEGER AS rank FROM firsts)""",
    )
    + "SELECT cluster, rank, item, count FROM ranked WHERE rank <= 12",
    "cluster_top_terms": _with(
        *_DOC_WEIGHTS,
        "langs AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)",
        """sums AS (SELECT lang, term, sum(weight) AS total
             FROM wt JOIN documents ON id = doc_id GROUP BY lang, term)""",
        """ranked AS (SELECT lang, term, total, row_number() OVER (
             PARTITION BY lang ORDER BY round(total, 12) DESC, term)::INTEGER AS rank FROM sums)""",
    )
    + """SELECT lang AS cluster, rank, term, round(total / n, 6) AS weight
         FROM ranked JOIN langs USING (lang) WHERE rank <= 15""",
    "cluster_centroids": _with(_MEMBERS)
    + "SELECT cluster, dim::INTEGER AS dim, round(c, 6) AS value FROM centers",
    "cluster_representatives": _with(
        _MEMBERS,
        """dist AS (SELECT d.cluster, id, sqrt(sum((x - c) * (x - c))) AS dist
             FROM dims d JOIN centers c ON d.cluster = c.cluster AND d.dim = c.dim GROUP BY d.cluster, id)""",
        """ranked AS (SELECT *, row_number() OVER (
             PARTITION BY cluster ORDER BY round(dist, 12), id)::INTEGER AS rank FROM dist)""",
    )
    + """SELECT cluster, rank AS representative_rank, id, round(dist, 6) AS centroid_distance
         FROM ranked WHERE rank <= 10""",
    "unit_rows": _with(_MEMBERS)
    + """SELECT id, dim::INTEGER AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS value
         FROM dims""",
    "kmeans_nearest": _with(_MEMBERS) + "SELECT DISTINCT id, true AS nearest FROM dims",
    "svd_lengths": _with(_MEMBERS)
    + "SELECT id, round(sum(x * x), 6) AS squared_length FROM dims GROUP BY id",
    "svd_gram": _with(_MEMBERS)
    + """SELECT a.dim::INTEGER AS i, b.dim::INTEGER AS j, round(sum(a.x * b.x), 4) + 0.0 AS value
         FROM dims a JOIN dims b ON a.id = b.id GROUP BY a.dim, b.dim""",
    # Traces of powers of the matrix of products, over the trace itself.
    "svd_values": _with(
        _MEMBERS,
        "g AS (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) AS v FROM dims a JOIN dims b ON a.id = b.id GROUP BY a.dim, b.dim)",
        "t AS (SELECT sum(v) AS t FROM g WHERE i = j)",
        "g2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY a.i, b.j)",
    )
    + """SELECT 2 AS power, round((SELECT sum(v) FROM g2 WHERE i = j) / t ** 2, 8) AS share FROM t
         UNION ALL SELECT 3, round((SELECT sum(g.v * g2.v) FROM g JOIN g2 ON g.j = g2.i AND g2.j = g.i) / t ** 3, 8) FROM t""",
    "written_file_checksums": """SELECT strlen(lines)::BIGINT AS file_bytes, sha256(lines) AS sha256 FROM (
         SELECT string_agg(c_name || chr(10), '' ORDER BY c_name) AS lines
         FROM customer GROUP BY c_nationkey)""",
}
