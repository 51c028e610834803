"""The same results in relational SQL (DuckDB): windows, islands and anti-joins.

Nothing here shares logic with the package; only patterns, word lists and the
derived relations are the same text. RE2 knows no look-around, so the two
insurance-number patterns filter their prefix afterwards, and the name label is
taken as a group.
"""

from __future__ import annotations

from quillmask import catalogue as cat
from quillmask.catalogue import DEFAULT_CATALOGUE, Detector
from suite.comments import COMMENTS_SQL
from suite.relations import (
    ALLOWED_SQL,
    CUSTOMER_NOTES_SQL,
    DICTIONARY_SQL,
    ENTITIES_SQL,
    EVENT_MESSAGE_SQL,
    FAULTY_LINES_SQL,
    FORMS,
    FORMS_NOTES_SQL,
    LARGE_DICTIONARY_SQL,
    MEASURES_SQL,
    NA_SQL,
    OVERLAP_SQL,
    TOKEN_POS_SQL,
)

_BANNED = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
_LOOKAHEAD = "(?!" + "|".join(_BANNED) + ")"
_LOOKBEHIND = "(?<=Name: )"
DETECTORS = {d.name: d for d in DEFAULT_CATALOGUE.detectors}


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def qs(values) -> str:
    return ", ".join(q(v) for v in values)


def places(source: str, pattern: str, keys: str, text: str = "t", group: int = 0) -> str:
    """All matches with offsets; the text before the i-th match gives its start."""
    return f"""
      SELECT {keys}, {text},
        sum(length(gap)) OVER w + sum(length(whole)) OVER w - length(said) AS "start",
        sum(length(gap)) OVER w + sum(length(whole)) OVER w AS "end", said, gap, i
      FROM (
        SELECT {keys}, {text}, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS whole,
          unnest(groups) AS said, unnest(gaps[1:len(found)]) AS gap
        FROM (SELECT {keys}, {text}, regexp_extract_all({text}, {q(pattern)}, 0) AS found,
                regexp_extract_all({text}, {q(pattern)}, {group}) AS groups,
                regexp_split_to_array({text}, {q(pattern)}) AS gaps
              FROM {source} WHERE regexp_matches({text}, {q(pattern)}))
      ) WINDOW w AS (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING)"""


def matches(source: str, pattern: str, keys: str, text: str = "t", ignore_case: bool = True) -> str:
    """Matches of one catalogue pattern."""
    flags = "(?i)" if ignore_case else ""
    if _LOOKBEHIND in pattern:
        return places(source, flags + pattern.replace(_LOOKBEHIND, "Name: (") + ")", keys, text, 1)
    if _LOOKAHEAD in pattern:
        inner = places(source, flags + pattern.replace(_LOOKAHEAD, ""), keys, text)
        return f"SELECT * FROM ({inner}) WHERE upper(said[1:2]) NOT IN ({qs(_BANNED)})"
    return places(source, flags + pattern.replace(cat.EMAIL_START, "").replace("]*+@", "]*@"), keys, text)


CELLS = f"""
  comments AS ({COMMENTS_SQL.format(orders="orders")}),
  cells AS (SELECT row_id, 'notes' AS source_column, coalesce(notes, '') AS t FROM comments
            UNION ALL SELECT row_id, 'description', coalesce(description, '') FROM comments)"""
CELL_KEYS = "row_id, source_column"


def detector_query(names: list[str], source: str = "cells", keys: str = CELL_KEYS, ctes: str = CELLS) -> str:
    parts = [
        f"SELECT {keys}, {q(n)} AS detector, \"start\", \"end\", said AS text FROM "
        f"({matches(source, DETECTORS[n].pattern, keys)})"
        for n in names
    ]
    return f"WITH {ctes} {' UNION ALL '.join(parts)}"


def scored(detectors: list[Detector], source: str, keys: str, forms: dict[str, str] | None = None) -> str:
    """All spans with their lifted scores (context words before the match, with their lemmas)."""
    parts = []
    lemma = "CASE x " + " ".join(f"WHEN {q(f.lower())} THEN {q(' ' + l)}" for f, l in forms.items()) + " ELSE '' END" if forms else "''"
    for d in detectors:
        lifted = " OR ".join(f"contains(around, {q(w)})" for w in d.context if " " not in w) or "false"
        parts.append(f"""
          SELECT {keys}, {q(d.entity_type)} AS entity_type, "start", "end",
            CASE WHEN {lifted} THEN round(least(1.0, greatest({d.score} + {cat.CONTEXT_BOOST}, {cat.CONTEXT_MIN_SCORE})), 3)::DOUBLE ELSE {d.score!r}::DOUBLE END AS score, text
          FROM (SELECT *, array_to_string(list_transform(
                  list_filter(regexp_extract_all(lower(t[1:CAST("start" AS BIGINT)]), {q(cat.WORD)}, 0),
                    lambda x: x NOT IN ({qs(cat.STOPWORDS)}))[-5:], lambda x: x || {lemma}), ' ')
                  || ' ' || regexp_extract(lower(said), '[^ \t\r\n]+', 0) AS around, said AS text
                FROM ({matches(source, d.pattern, keys, ignore_case=d.ignore_case)}))""")
    return " UNION ALL ".join(parts)


def detectors_of(entity_types) -> list[Detector]:
    return [d for d in DEFAULT_CATALOGUE.detectors if d.entity_type in entity_types]


def span_steps(
    entity_types=cat.DEFAULT_ENTITY_TYPES,
    threshold: float = 0.45,
    style: str = cat.STYLE_ENTITY_TAGS,
    source: str = "cells",
    keys: str = CELL_KEYS,
    extra: str | None = None,
    allowed=cat.ALLOW_LIST,
) -> str:
    """CTEs from scored spans to redacted text."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    by = keys
    if style == cat.STYLE_GENERIC:
        tag = q(cat.GENERIC_TAG)
    else:
        cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in cat.ENTITY_TAGS.items())
        tag = f"CASE entity_type {cases} ELSE {q(cat.GENERIC_TAG)} END"
    model = f" UNION ALL {extra}" if extra else ""
    return f"""
  scored AS ({scored(detectors_of(entity_types), source, keys)}{model}),
  deduped AS (
    SELECT DISTINCT * FROM scored a WHERE NOT EXISTS (
      SELECT 1 FROM scored b WHERE {same} AND a.entity_type = b.entity_type
        AND b."start" <= a."start" AND b."end" >= a."end"
        AND (b.score > a.score OR (b.score = a.score AND (b."start" < a."start" OR b."end" > a."end"))))),
  reached AS (SELECT * FROM deduped WHERE score >= {threshold}),
  detections AS (SELECT * FROM reached WHERE text NOT IN ({qs(allowed)})),
  flagged AS (
    SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY {by}, entity_type ORDER BY "start", "end" DESC, score DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM detections),
  islands AS (
    SELECT *, sum(fresh) OVER (PARTITION BY {by}, entity_type ORDER BY "start", "end" DESC, score DESC
      ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
  merged AS (
    SELECT {by}, entity_type, min("start") AS "start", max("end") AS "end", max(score) AS score
    FROM islands GROUP BY {by}, entity_type, island),
  resolved AS (
    SELECT * FROM merged a WHERE NOT EXISTS (
      SELECT 1 FROM merged b WHERE {same} AND b."start" <= a."start" AND b."end" >= a."end"
        AND (b."start" < a."start" OR b."end" > a."end" OR b.score > a.score
             OR (b.score = a.score AND b.entity_type < a.entity_type)))),
  neighbours AS (
    SELECT r.*, c.t, lag(entity_type) OVER w AS type_before, lag("end") OVER w AS end_before
    FROM resolved r JOIN {source} c USING ({by}) WINDOW w AS (PARTITION BY {by} ORDER BY "start")),
  chained AS (
    SELECT *, CASE WHEN type_before = entity_type AND end_before < "start"
        AND regexp_full_match(t[CAST(end_before + 1 AS BIGINT):CAST("start" AS BIGINT)], ' +') THEN 0 ELSE 1 END AS fresh
    FROM neighbours),
  chains AS (
    SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS chain FROM chained),
  joined AS (
    SELECT {by}, entity_type, min("start") AS "start", max("end") AS "end", max(score) AS score
    FROM chains GROUP BY {by}, entity_type, chain),
  pieces AS (
    SELECT j.*, c.t, {tag} AS tag, coalesce(lag("end") OVER w, 0) AS kept_from
    FROM joined j JOIN {source} c USING ({by}) WINDOW w AS (PARTITION BY {by} ORDER BY "start")),
  rebuilt AS (
    SELECT {by}, string_agg(CASE WHEN kept_from < "start" THEN substring(t, CAST(kept_from + 1 AS BIGINT), CAST("start" - kept_from AS BIGINT)) ELSE '' END || tag, '' ORDER BY "start")
      || substring(any_value(t), CAST(max("end") + 1 AS BIGINT)) AS redacted
    FROM pieces GROUP BY {by}),
  redacted AS (
    SELECT {by}, c.t, coalesce(r.redacted, c.t) AS redacted FROM {source} c LEFT JOIN rebuilt r USING ({by}))"""


def residual_ctes(keys: str = CELL_KEYS, patterns=cat.RESIDUAL_PATTERNS, guard: bool = True) -> str:
    """Leftover findings on redacted text."""
    keep = "WHERE NOT regexp_matches(trim(said, ' ' || chr(9) || chr(10) || chr(13)), '^<[A-Z_]+>$')" if guard else ""
    parts = [
        f"SELECT {keys}, {q(p.label)} AS label, said AS text FROM "
        f"({matches('redacted', p.pattern, keys, 'redacted', p.ignore_case)}) {keep}"
        for p in patterns
    ]
    return f"residual AS ({' UNION ALL '.join(parts)})"


def missed_ctes(keys: str = CELL_KEYS, source: str = "cells", tokens: str | None = None, raw: str | None = None) -> str:
    """Name-like words outside all detections, neighbours joined."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    if tokens is None:
        words = f"""SELECT {keys}, "start", "end", said FROM ({places(source, cat.WORD, keys)})
          WHERE i > 1 AND NOT regexp_matches(gap, '[.!?\\r\\n]') AND said <> 'I'"""
    else:
        words = f"""SELECT {keys}, "start", "end", text AS said FROM {tokens} WHERE pos = 'PROPN'"""
    if raw is None:
        label = q(cat.MISSED_NAME_LABEL)
        lookup = ""
    else:
        label = f"{q(cat.MISSED_NAME_LABEL)} || coalesce(' (model tagged ' || e.label || ')', '')"
        lookup = f"""LEFT JOIN (SELECT {keys}, "start", "end", max(label) AS label FROM {raw} GROUP BY {keys}, "start", "end") e
          USING ({keys}, "start", "end")"""
    return f"""
  name_words AS ({words}),
  name_like AS (
    SELECT * FROM name_words WHERE regexp_matches(said, '^\\p{{Lu}}')
      AND (length(said) = 1 OR regexp_matches(said, '[\\p{{Ll}}\\p{{Lt}}]')) AND said NOT IN ({qs(cat.ALLOW_LIST)})),
  outside AS (
    SELECT * FROM name_like a WHERE NOT EXISTS (
      SELECT 1 FROM detections b WHERE {same} AND a."start" >= b."start" AND a."end" <= b."end")),
  name_marks AS (
    SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY {keys} ORDER BY "start") <= 1 THEN 0 ELSE 1 END AS fresh FROM outside),
  name_runs AS (
    SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM name_marks),
  missed_spans AS (
    SELECT {keys}, min("start") AS "start", max("end") AS "end" FROM name_runs GROUP BY {keys}, run),
  missed AS (
    SELECT {keys}, m."start", m."end", {label} AS label,
      substring(c.t, CAST(m."start" + 1 AS BIGINT), CAST(m."end" - m."start" AS BIGINT)) AS text
    FROM missed_spans m JOIN {source} c USING ({keys}) {lookup})"""


OUTPUT_COLUMN = f"source_column || {q(cat.OUTPUT_SUFFIX)} AS output_column"
ALL_TYPES = tuple(cat.ENTITY_OPTIONS.values())


def _document_cells(table: str, keys: str, column: str = "text") -> str:
    return f"cells AS (SELECT {keys}, coalesce({column}, '') AS t FROM {table})"


def _model_spans() -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in cat.MODEL_LABELS.items())
    return f"""SELECT row_id, source_column, CASE upper(label) {cases} END AS entity_type, "start", "end", {cat.MODEL_SCORE}::DOUBLE,
      substring(t, CAST("start" + 1 AS BIGINT), CAST("end" - "start" AS BIGINT))
      FROM entities JOIN cells USING (row_id, source_column)
      WHERE CASE upper(label) {cases} END IS NOT NULL"""


ENTITIES = f"entities AS ({ENTITIES_SQL})"


BOTH = """SELECT n.row_id, n.redacted AS "notes_Anonymised", d.redacted AS "description_Anonymised"
      FROM redacted n JOIN redacted d ON n.row_id = d.row_id AND n.source_column = 'notes' AND d.source_column = 'description'"""


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    docs = _document_cells("documents", "doc_id")
    for key, name in {
        "detect_email_documents": "email",
        "detect_phone_intl_documents": "phone_international",
        "detect_bare_digits_documents": "code_bare",
    }.items():
        sql[key] = detector_query([name], keys="doc_id", ctes=docs)
    sql["residual_long_digits_documents"] = f"""WITH {docs}
      SELECT doc_id, 'LONG_DIGIT_SEQUENCE' AS label, "start", "end", said AS text
      FROM ({matches('cells', cat.LONG_DIGITS, 'doc_id')})"""
    for key, names in {
        "detect_postcode": ["uk_postcode"],
        "detect_nino_strict": ["nino_strict"],
        "detect_nino_flex": ["nino_flexible"],
        "detect_mobile": ["uk_mobile"],
        "detect_landline": ["uk_landline"],
        "detect_housing_ref": ["ref_bh", "ref_rep", "ref_tenancy", "ref_customer", "ref_job"],
        "detect_access_code": ["code_labelled", "code_bare"],
        "detect_name_label": ["name_label"],
        "detect_title_name": ["title_name"],
        "detect_dates": ["date_iso", "date_numeric", "date_month_name", "date_month_first", "date_month_year", "date_timestamp"],
    }.items():
        sql[key] = detector_query(names)

    span_cols = f'{CELL_KEYS}, entity_type, "start", "end", score'
    low = span_steps(ALL_TYPES, 0.2)
    sql["context_boost"] = f"WITH {CELLS}, {low} SELECT {span_cols}, text FROM scored"
    sql["dedup_same_type"] = f"WITH {CELLS}, {low} SELECT {span_cols}, text FROM deduped"
    sql["threshold_filter"] = f"WITH {CELLS}, {span_steps(ALL_TYPES, 0.6)} SELECT {span_cols}, text FROM reached"
    annotated = span_steps(ALL_TYPES, 0.45, extra=_model_spans())
    sql["allow_list_filter"] = f"WITH {CELLS}, {ENTITIES}, {annotated} SELECT {span_cols}, text FROM detections"
    sql["annotation_join"] = f"""WITH {CELLS}, {ENTITIES}, {annotated}
      SELECT {span_cols}, text FROM detections WHERE score = 0.85"""
    sql["merge_overlaps"] = f"WITH {CELLS}, {low} SELECT {span_cols} FROM merged"
    sql["conflict_resolution"] = f"WITH {CELLS}, {low} SELECT {span_cols} FROM resolved"
    sql["merge_adjacent"] = f"WITH {CELLS}, {ENTITIES}, {annotated} SELECT {span_cols} FROM joined"

    standard = span_steps()
    sql["redact_generic"] = f"""WITH {CELLS}, {span_steps(style=cat.STYLE_GENERIC)} {BOTH}"""
    sql["redact_entity_tags"] = f"WITH {CELLS}, {standard} {BOTH}"
    sql["redact_two_columns"] = f"""WITH {CELLS}, {standard}
      SELECT c.row_id, c.notes, c.description, c.category, n.redacted AS "notes_Anonymised", d.redacted AS "description_Anonymised"
      FROM comments c JOIN redacted n ON c.row_id = n.row_id AND n.source_column = 'notes'
      JOIN redacted d ON c.row_id = d.row_id AND d.source_column = 'description'"""
    sql["outputs_data"] = sql["redact_two_columns"]
    sql["changed_rows"] = f"""SELECT * FROM ({sql["redact_two_columns"]})
      WHERE "notes_Anonymised" <> notes OR "description_Anonymised" <> description"""
    sql["redact_low_threshold"] = f"""WITH {CELLS}, {span_steps(ALL_TYPES, 0.2)}
      SELECT {CELL_KEYS}, redacted FROM redacted"""
    sql["redact_annotated"] = f"WITH {CELLS}, {ENTITIES}, {annotated} {BOTH}"

    report = f"""WITH {CELLS}, {standard}
      SELECT source_column, {OUTPUT_COLUMN}, row_id AS row_index, entity_type, round(score, 3) AS score,
        text AS original_text, "start", "end" FROM detections"""
    sql["detection_report"] = report
    sql["outputs_detection_report"] = report
    everything = f"{CELLS}, {standard}, {residual_ctes()}, {missed_ctes()}"
    findings = f"""findings AS (SELECT {CELL_KEYS}, label, text FROM residual
      UNION ALL SELECT {CELL_KEYS}, label, text FROM missed)"""
    flags = f"""WITH {everything}, {findings}
      SELECT source_column, {OUTPUT_COLUMN}, row_id AS row_index, label, text FROM findings"""
    sql["residual_flags"] = flags
    sql["outputs_residual_flags"] = flags
    sql["flagged_rows"] = f"""SELECT row_index, source_column, count(*) AS n_findings FROM ({flags})
      GROUP BY row_index, source_column"""
    own = ("Mr Brown", *(f"0191 {a} {b}" for a in range(100, 110) for b in range(1000, 1010)))
    sql["residual_own_allow_list"] = f"""WITH {CELLS}, {span_steps(allowed=own)}, {residual_ctes()}
      SELECT {CELL_KEYS}, label, text FROM residual"""
    sql["run_stats"] = f"""WITH {everything}, {findings}
      SELECT (SELECT count(*) FROM comments) AS records_processed, CAST(2 AS BIGINT) AS columns_anonymised,
        (SELECT count(*) FROM detections) AS pii_entities_detected,
        (SELECT count(*) FROM (SELECT DISTINCT {CELL_KEYS} FROM findings)) AS rows_with_possible_residual_items,
        (SELECT count(*) FROM cells) AS processed_cells, (SELECT count(*) FROM cells) AS total_cells"""
    few = span_steps(("EMAIL_ADDRESS",), 0.45)
    sql["residual_tag_guard"] = f"""WITH {CELLS}, {few}, {residual_ctes()}
      SELECT {CELL_KEYS}, label, text FROM residual"""
    sql["missed_names"] = f"""WITH {CELLS}, {standard}, {missed_ctes()}
      SELECT {CELL_KEYS}, "start", "end", label, text FROM missed"""
    sql["missed_names_off_label"] = f"""WITH {CELLS}, {ENTITIES}, tokens AS ({TOKEN_POS_SQL}),
      {span_steps(threshold=0.45, extra=_model_spans() + " AND label IN ('PERSON', 'PER')")}, {missed_ctes(tokens='tokens', raw='entities')}
      SELECT {CELL_KEYS}, "start", "end", label, text FROM missed"""

    grams = f"""notes AS ({CUSTOMER_NOTES_SQL}), cells AS (SELECT c_custkey, note AS t FROM notes),
      dictionary AS ({DICTIONARY_SQL}),
      words AS (
        SELECT c_custkey, list(lower(said) ORDER BY i) AS w, list("start" ORDER BY i) AS s, list("end" ORDER BY i) AS e
        FROM ({places('cells', cat.WORD, 'c_custkey')}) GROUP BY c_custkey),
      starts AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words),
      grams AS (
        SELECT c_custkey, s[i] AS "start", e[i + n - 1] AS "end", array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT *, unnest(range(1, 10)) AS n FROM starts) WHERE i + n - 1 <= len(w))"""
    sql["gazetteer_detect"] = f"""WITH {grams}
      SELECT c_custkey, 'note' AS source_column, "start", "end", label, 0.85::DOUBLE AS score
      FROM grams JOIN (SELECT DISTINCT array_to_string(regexp_extract_all(lower(term), {q(cat.WORD)}, 0), ' ') AS gram, label FROM dictionary) d USING (gram)"""
    sql["gazetteer_large"] = f"""WITH {grams.replace(DICTIONARY_SQL, LARGE_DICTIONARY_SQL.replace("FROM ids", "FROM range(200000) r(id)")).replace("range(1, 10)", "range(1, 4)")}
      SELECT c_custkey, 'note' AS source_column, "start", "end", label, 0.85::DOUBLE AS score
      FROM grams JOIN (SELECT lower(term) AS gram, label FROM dictionary) d USING (gram)"""
    sql["context_lemmas"] = f"""WITH notes AS ({FORMS_NOTES_SQL}), cells AS (SELECT c_custkey, note AS t FROM notes)
      SELECT c_custkey, entity_type, "start", "end", score, text FROM ({scored(detectors_of(ALL_TYPES), "cells", "c_custkey", FORMS)})"""
    sql["sql_redact"] = f"""WITH {everything}, {findings},
      found AS (SELECT {CELL_KEYS}, count(*) AS n FROM detections GROUP BY ALL),
      listed AS (SELECT {CELL_KEYS}, string_agg(label || '=' || text, '|' ORDER BY label || '=' || text) AS items FROM findings GROUP BY ALL)
      SELECT {CELL_KEYS}, redacted, coalesce(n, 0) AS n_spans, coalesce(items, '') AS leftovers
      FROM redacted LEFT JOIN found USING ({CELL_KEYS}) LEFT JOIN listed USING ({CELL_KEYS})"""
    sql["csv_quarantine"] = f"""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index,
        CASE WHEN o_orderkey % 8 NOT IN (1, 2, 6) THEN o_orderkey END AS row_id,
        CASE o_orderkey % 8 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 6 THEN NULL WHEN 3 THEN 7 WHEN 4 THEN 8 WHEN 5 THEN 9 ELSE o_custkey END AS amount,
        CASE o_orderkey % 8 WHEN 1 THEN line WHEN 2 THEN line WHEN 6 THEN line WHEN 3 THEN NULL WHEN 5 THEN NULL
          WHEN 4 THEN 'two' || chr(10) || 'lines, "quoted"' ELSE 'plain' END AS remark,
        CASE o_orderkey % 8 WHEN 1 THEN 'more fields than the header' WHEN 6 THEN 'more fields than the header' WHEN 2 THEN 'no amount' END AS reason
      FROM orders JOIN ({FAULTY_LINES_SQL}) ON k = o_orderkey"""

    # Sources and sinks
    sql["csv_na_normalise"] = f"""SELECT row_id, n_items, CASE WHEN remark IN ({qs(cat.CSV_NA_TOKENS)}) THEN NULL ELSE remark END AS remark
      FROM ({NA_SQL})"""
    sql["nan_to_null"] = f"""SELECT o_orderkey, CASE WHEN isnan(ratio) THEN NULL ELSE ratio END AS ratio FROM ({MEASURES_SQL.format(nan="CAST('NaN' AS DOUBLE)")})"""
    sql["row_index_csv"] = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders"
    sql["row_index_by_file"] = "SELECT o_orderkey, o_orderkey AS row_index FROM orders"
    sql["row_index_by_order"] = """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders"""

    # Whole texts
    doc_steps = span_steps(ALL_TYPES, 0.45, keys="doc_id")
    sql["redact_documents"] = f"""WITH {docs}, {doc_steps}
      SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.redacted AS "text_Anonymised" FROM documents d JOIN redacted r USING (doc_id)"""
    sql["detections_documents"] = f"""WITH {docs}, {doc_steps}
      SELECT doc_id, entity_type, score, "start", "end", text AS original_text FROM detections"""
    conv = _document_cells("conversations", "conv_id, turn")
    sql["redact_conversations"] = f"""WITH {conv}, {span_steps(ALL_TYPES, 0.45, keys="conv_id, turn")}
      SELECT conv_id, turn, c.role, c.text, redacted AS "text_Anonymised" FROM redacted JOIN conversations c USING (conv_id, turn)"""
    pages = _document_cells("pages", "page_id", "html")
    sql["redact_pages_html"] = f"""WITH {pages}, {span_steps(keys="page_id")}
      SELECT page_id, p.url, p.html, redacted AS "html_Anonymised" FROM redacted JOIN pages p USING (page_id)"""
    fallback = "cells AS (SELECT page_id, CAST(page_id AS VARCHAR) AS t FROM pages)"
    sql["redact_pages_fallback"] = f"""WITH {fallback}, {span_steps(keys="page_id")}
      SELECT page_id, url, html, redacted AS "page_id_Anonymised" FROM pages JOIN redacted USING (page_id)"""
    doc_all = f"""{docs}, {span_steps(keys="doc_id")}, {residual_ctes("doc_id")}, {missed_ctes("doc_id")}"""
    sql["residuals_documents"] = f"""WITH {doc_all}
      SELECT doc_id, label, text FROM residual UNION ALL SELECT doc_id, label, text FROM missed"""

    # Review aids and streams
    sql["threshold_sweep"] = f"""WITH {CELLS}, {span_steps(ALL_TYPES, 0.1)}
      SELECT entity_type, round(0.1 + 0.05 * s, 2)::DOUBLE AS threshold, count(*) AS detections
      FROM detections, (SELECT unnest(range(0, 17)) AS s) WHERE score >= round(0.1 + 0.05 * s, 2)
      GROUP BY entity_type, s"""
    sql["qa_sample"] = f"""WITH {CELLS} SELECT row_id, notes FROM comments
      ORDER BY md5('0|' || row_id::VARCHAR), row_id LIMIT 500"""
    every_type = f"""WITH {CELLS}, {span_steps(ALL_TYPES)}
      SELECT source_column, row_id AS row_index, entity_type, round(score, 3) AS score, text AS original_text, "start", "end" FROM detections"""
    sql["qa_sample_strata"] = f"""SELECT * FROM ({every_type}) QUALIFY row_number() OVER (PARTITION BY entity_type
      ORDER BY md5('7|' || source_column || '|' || row_index::VARCHAR || '|' || "start"::BIGINT::VARCHAR || '|' || "end"::BIGINT::VARCHAR), source_column, row_index, "start", "end", score) <= 25"""
    gold = f"""gold AS (SELECT {CELL_KEYS}, 'PERSON' AS entity_type, "start", "end" FROM entities WHERE label IN ('PERSON', 'PER')
      UNION ALL SELECT {CELL_KEYS}, 'PHONE_NUMBER', "start", "end" FROM ({matches("cells", cat.UK_MOBILE, CELL_KEYS)}))"""
    sql["span_eval"] = f"""WITH {CELLS}, {ENTITIES}, {standard}, {gold},
      found AS (SELECT DISTINCT {CELL_KEYS}, entity_type, "start", "end" FROM detections),
      sides AS (SELECT entity_type, f.hit IS NOT NULL AS f, g.hit IS NOT NULL AS g FROM
        (SELECT *, 1 AS hit FROM found) f FULL JOIN (SELECT DISTINCT *, 1 AS hit FROM gold) g USING ({CELL_KEYS}, entity_type, "start", "end"))
      SELECT entity_type, count(*) FILTER (f AND g) AS true_positives, count(*) FILTER (f AND NOT g) AS false_positives,
        count(*) FILTER (g AND NOT f) AS false_negatives,
        round(count(*) FILTER (f AND g) / nullif(count(*) FILTER (f), 0), 4) AS "precision",
        round(count(*) FILTER (f AND g) / nullif(count(*) FILTER (g), 0), 4) AS recall
      FROM sides GROUP BY entity_type"""
    events = f"""cells AS (SELECT event_id, {EVENT_MESSAGE_SQL} AS t FROM events)"""
    sql["stream_window_counts"] = f"""WITH {events}, {span_steps(keys="event_id")}
      SELECT date_trunc('hour', e.ts) AS window_start, entity_type, count(*) AS detections
      FROM detections JOIN events e USING (event_id)
      WHERE date_trunc('hour', e.ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
      GROUP BY 1, 2"""
    sql["stream_anonymise"] = sql["redact_conversations"]
    sql["stream_outputs"] = f"""WITH {everything}, {findings}
      SELECT 'data' AS output, source_column, row_id, NULL::VARCHAR AS label, redacted AS text FROM redacted
      UNION ALL SELECT 'detection', source_column, row_id, entity_type, text FROM detections
      UNION ALL SELECT 'finding', source_column, row_id, label, text FROM findings
      UNION ALL SELECT 'counters', NULL, (SELECT count(*) FROM comments), NULL, (SELECT count(*) FROM detections)::VARCHAR"""
    sql["islands_relational"] = sql["merge_overlaps"]
    sql["range_anti_join"] = f"""WITH {CELLS}, {ENTITIES}, {low},
      words AS (SELECT {CELL_KEYS}, "start", "end" FROM ({places("cells", cat.WORD, CELL_KEYS)})),
      named AS (SELECT {CELL_KEYS}, "start", "end", max(label) AS label FROM entities GROUP BY ALL)
      SELECT {CELL_KEYS}, "start", "end", label FROM words a LEFT JOIN named USING ({CELL_KEYS}, "start", "end")
      WHERE NOT EXISTS (SELECT 1 FROM detections b WHERE a.row_id = b.row_id AND a.source_column = b.source_column
        AND a."start" >= b."start" AND a."end" <= b."end")"""
    listed = f"(SELECT {ALLOWED_SQL} FROM range(100000) r(id))"
    allowing = standard.replace("detections AS (SELECT * FROM reached WHERE", f"detections AS (SELECT * FROM reached WHERE text NOT IN (SELECT term FROM {listed}) AND")
    sql["allow_list_table"] = f"""WITH {CELLS}, {allowing}
      SELECT c.row_id, c.notes, c.description, c.category, n.redacted AS "notes_Anonymised", d.redacted AS "description_Anonymised"
      FROM comments c JOIN redacted n ON c.row_id = n.row_id AND n.source_column = 'notes'
      JOIN redacted d ON c.row_id = d.row_id AND d.source_column = 'description'"""
    sql["redact_partial_overlap"] = f"""WITH notes AS ({OVERLAP_SQL}), cells AS (SELECT c_custkey, note AS t FROM notes),
      {span_steps(ALL_TYPES, 0.45, keys="c_custkey")}
      SELECT c_custkey, t AS note, redacted AS "note_Anonymised" FROM redacted"""
    return sql
