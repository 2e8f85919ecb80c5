"""SQL for DuckDB that gives the rows of the queries; {tables} are recipes of the fixtures or DUCK."""

from __future__ import annotations

from factloom.functions.normalize import SCALES, UNITS

_SCALE = " ".join(f"WHEN '{w}' THEN {v}" for w, v in SCALES.items())
_UNIT = " ".join(f"WHEN regexp_matches(ctx, '{p}', 'i') THEN '{u}'" for p, u in UNITS)
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _tokens(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+'))"


def _jaccard(x: str, y: str) -> str:
    both = f"len(list_intersect({x}, {y}))"
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE {both} / CAST(len({x}) + len({y}) - {both} AS DOUBLE) END)"


DUCK: dict[str, str] = {}
DUCK["d_parsed"] = r"""SELECT *, CASE WHEN neg AND num > 0 THEN -num ELSE num END AS parsed FROM (SELECT *, TRY_CAST(replace(nullif(regexp_extract(trim(regexp_replace(body, '[₹$€£]|Rs\.?|INR|USD|EUR', '', 'gi')), '[-+]?\d{1,3}(?:,\d{2,3})*(?:\.\d+)?|\d+(?:\.\d+)?'), ''), ',', '') AS DOUBLE) AS num
    FROM (SELECT *, bracket OR minus AS neg, CASE WHEN bracket THEN regexp_extract(t, '\(([^)]+)\)', 1) WHEN minus THEN trim(substr(t, 2)) ELSE t END AS body
    FROM (SELECT *, regexp_matches(t, '\([^)]*\d+[^)]*\)') AS bracket, regexp_matches(t, '^[-−]') AND NOT regexp_matches(t, '\([^)]*\d+[^)]*\)') AS minus FROM (SELECT *, trim(raw_value_text) AS t, concat(coalesce(unit, ''), ' ', raw_value_text) AS ctx FROM {fx_facts}))))"""
DUCK["d_scaled"] = rf"""SELECT *, CASE WHEN regexp_matches(lower(ctx), '\b(lakh|lac|lakhs|lacs)\s*(crore|crores|cr|crs)\b') THEN 1e12 WHEN regexp_matches(lower(ctx), '\b(thousand|thousands|k)\s*(crore|crores|cr|crs)\b') THEN 1e10
    ELSE coalesce(CASE list_filter(regexp_extract_all(lower(ctx), '[a-z]+'), lambda w: w IN ({", ".join(f"'{w}'" for w in SCALES)}))[1] {_SCALE} END, 1.0) END AS factor,
    CASE {_UNIT} ELSE nullif(upper(trim(regexp_replace(coalesce(unit, ''), '[^A-Za-z0-9_ ]', '', 'g'))), '') END AS normalized_unit,
    CASE WHEN value_numeric IS NULL THEN parsed WHEN neg AND value_numeric > 0 THEN -value_numeric ELSE value_numeric END AS scalar,
    regexp_extract(period_text, '(?i)\bQ([1-4])\s*(?:FY)?\s*(\d{{2,4}})\b', ['q', 'qy']) AS quarter, regexp_extract(period_text, '(?i)(?:FY\s*)?(\d{{4}})[-/](\d{{2,4}})', ['hs', 'he']) AS hyphen,
    regexp_extract(period_text, '(?i)\bFY\s*(\d{{2,4}})\b', 1) AS single, regexp_extract(period_text, '(?i)(March)\s+(\d{{1,2}}),?\s*(\d{{4}})', ['m', 'd', 'yy']) AS exact, regexp_extract(period_text, '\b(\d{{4}})\b', 1) AS calendar FROM {{d_parsed}}"""
_YEAR = "(CASE WHEN TRY_CAST({0} AS INT) < 70 THEN 2000 + TRY_CAST({0} AS INT) WHEN TRY_CAST({0} AS INT) < 100 THEN 1900 + TRY_CAST({0} AS INT) ELSE TRY_CAST({0} AS INT) END)"
_Q = "TRY_CAST(quarter.q AS INT)"
DUCK["d_facts"] = f"""SELECT id, dataset_id, document_id, subject, predicate, raw_claim, raw_value_text, value_numeric, unit, fact_type, period_text, scope, status, page_number, created_at, bn, y, k, p, confidence, parsed, neg, factor, normalized_unit,
    CASE WHEN factor > 1 AND abs(scalar) < 1e9 THEN scalar * factor ELSE scalar END AS nv,
    CASE WHEN quarter.q <> '' THEN (CASE WHEN {_Q} = 4 THEN make_date({_YEAR.format("quarter.qy")}, 1, 1) ELSE make_date({_YEAR.format("quarter.qy")} - 1, {_Q} * 3 + 1, 1) END)
      WHEN hyphen.hs <> '' THEN make_date(TRY_CAST(hyphen.hs AS INT), 4, 1) WHEN single <> '' THEN make_date({_YEAR.format("single")} - 1, 4, 1) WHEN exact.m <> '' THEN make_date(TRY_CAST(exact.yy AS INT), 3, TRY_CAST(exact.d AS INT)) WHEN calendar <> '' THEN make_date(TRY_CAST(calendar AS INT), 1, 1) END AS period_start,
    CASE WHEN quarter.q <> '' THEN (CASE WHEN {_Q} = 4 THEN make_date({_YEAR.format("quarter.qy")}, 3, 31) ELSE last_day(make_date({_YEAR.format("quarter.qy")} - 1, {_Q} * 3 + 3, 1)) END)
      WHEN hyphen.hs <> '' THEN make_date({_YEAR.format("hyphen.he")}, 3, 31) WHEN single <> '' THEN make_date({_YEAR.format("single")}, 3, 31) WHEN exact.m <> '' THEN make_date(TRY_CAST(exact.yy AS INT), 3, TRY_CAST(exact.d AS INT)) WHEN calendar <> '' THEN make_date(TRY_CAST(calendar AS INT), 12, 31) END AS period_end
    FROM {{d_scaled}}"""
_SIDE = "id, dataset_id, document_id, subject, predicate, raw_claim, raw_value_text, value_numeric, unit, normalized_unit, fact_type, period_text, period_start, period_end, scope, status, page_number, nv"
DUCK["d_raw_pairs"] = """SELECT e.fact_a_id, e.fact_b_id, e.relationship_type, e.confidence, e.created_at AS edge_created, a, b, abs(a.nv - b.nv) / nullif(greatest(abs(a.nv), abs(b.nv)), 0) AS v0 FROM {fx_edges} e JOIN {d_facts} a ON a.id = e.fact_a_id JOIN {d_facts} b ON b.id = e.fact_b_id"""
DUCK["d_pairs"] = """SELECT *, CASE WHEN a.nv = b.nv THEN 0.0 ELSE v0 END AS v,
    CASE WHEN ok_t0 THEN (CASE WHEN a.period_start = b.period_start AND a.period_end = b.period_end THEN 'identical_period_range' ELSE 'overlapping_period_range' END) ELSE 'disjoint_period_range' END AS why_t, ok_t0 AS ok_t,
    a.normalized_unit IS NULL OR b.normalized_unit IS NULL OR a.normalized_unit = b.normalized_unit OR (a.normalized_unit IN ('INR', 'USD', 'EUR', 'GBP') AND b.normalized_unit IN ('INR', 'USD', 'EUR', 'GBP')) AS ok_m,
    CASE WHEN a.normalized_unit = b.normalized_unit THEN concat('identical_unit_', a.normalized_unit) WHEN a.normalized_unit IN ('INR', 'USD', 'EUR', 'GBP') AND b.normalized_unit IN ('INR', 'USD', 'EUR', 'GBP') THEN 'currency_conversion_needed'
      WHEN a.normalized_unit IS NOT NULL AND b.normalized_unit IS NOT NULL THEN concat('incompatible_units_', a.normalized_unit, '_vs_', b.normalized_unit) WHEN a.fact_type = 'SEMANTIC' OR b.fact_type = 'SEMANTIC' THEN 'semantic_fact' ELSE 'unit_unspecified' END AS why_m
    FROM (SELECT *, greatest(a.period_start, b.period_start) <= least(a.period_end, b.period_end) AS ok_t0 FROM {d_raw_pairs})"""
DUCK["d_rules"] = """SELECT *, CASE WHEN a.status <> b.status THEN 'CONTEXTUAL_DIFFERENCE' WHEN num AND ok_t AND v <= 0.015 THEN 'CORROBORATES' WHEN num AND ok_t AND v > 0.05 AND a.scope <> b.scope THEN 'CONTEXTUAL_DIFFERENCE' WHEN num AND ok_t AND v > 0.05 THEN 'CONTRADICTS' WHEN num AND NOT ok_t THEN 'CONTEXTUAL_DIFFERENCE' END AS rule_type,
    CASE WHEN a.status <> b.status THEN 0.92 WHEN num AND ok_t AND v <= 0.015 THEN 0.96 WHEN num AND ok_t AND v > 0.05 AND a.scope <> b.scope THEN 0.90 WHEN num AND ok_t AND v > 0.05 THEN 0.92 WHEN num AND NOT ok_t THEN 0.95 END AS rule_confidence
    FROM (SELECT *, a.nv IS NOT NULL AND b.nv IS NOT NULL AND ok_m AS num FROM {d_pairs})"""
DUCK["d_first"] = "SELECT fact_id, quote, page_id, page_number AS evidence_page FROM {fx_evidence} QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY created_at, id) = 1"
DUCK["d_rich"] = "SELECT f.*, g.filename, e.quote, coalesce(e.evidence_page, f.page_number) AS page FROM {fx_facts} f LEFT JOIN {d_first} e ON e.fact_id = f.id LEFT JOIN {fx_filings} g ON g.id = f.document_id"
DUCK["d_detailed"] = "SELECT e.*, a, b FROM {fx_edges} e JOIN {d_rich} a ON a.id = e.fact_a_id JOIN {d_rich} b ON b.id = e.fact_b_id"
DUCK["d_picks"] = """SELECT * FROM (SELECT f.*, lower(subject) AS subject_key, lower(predicate) AS predicate_key FROM {d_facts} f) QUALIFY row_number() OVER (PARTITION BY subject_key, predicate_key, document_id
    ORDER BY nv IS NULL, CASE WHEN nv IS NOT NULL THEN created_at END, CASE WHEN nv IS NULL THEN created_at END DESC, CASE WHEN nv IS NOT NULL THEN id END, CASE WHEN nv IS NULL THEN id END DESC) = 1"""
DUCK["d_compared"] = """SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY list_position(['INCREASED', 'DECREASED', 'CONTEXT_CHANGED', 'UNCHANGED', 'ADDED', 'NOT_FOUND'], category), abs(coalesce(percent, 0)) DESC, predicate, subject_key, predicate_key) AS position FROM (
    SELECT *, CASE WHEN NOT has_b THEN 'NOT_FOUND' WHEN NOT has_a THEN 'ADDED' WHEN sa <> sb THEN 'CONTEXT_CHANGED' WHEN percent > 0.5 THEN 'INCREASED' WHEN percent < -0.5 THEN 'DECREASED' WHEN percent IS NOT NULL THEN 'UNCHANGED' WHEN raw_a = raw_b THEN 'UNCHANGED' ELSE 'CONTEXT_CHANGED' END AS category,
      CASE WHEN NOT has_b THEN concat('Not found in ', file_b) WHEN NOT has_a THEN concat('Added in ', file_b) WHEN sa <> sb THEN concat('Scope changed: ', upper(sa[1]), sa[2:], ' → ', upper(sb[1]), sb[2:]) WHEN percent > 0.5 THEN printf('+%.2f%% ↑', percent)
        WHEN percent < -0.5 THEN printf('%.2f%% ↓', percent) WHEN percent IS NOT NULL THEN '0.00% (No change)' WHEN raw_a = raw_b THEN 'Identical claim' ELSE 'Qualitative claim variance' END AS change FROM (
    SELECT *, round(CASE WHEN value_a IS NOT NULL AND value_b IS NOT NULL AND (sa <> sb) IS NOT TRUE THEN (CASE WHEN abs(value_a) > 1e-9 THEN (value_b - value_a) / abs(value_a) * 100 WHEN abs(value_b) > 1e-9 THEN 100.0 ELSE 0.0 END) END, 2) AS percent,
      round(CASE WHEN (sa <> sb) IS NOT TRUE THEN value_b - value_a END, 2) AS difference FROM (
    SELECT s.comparison_id, subject_key, predicate_key, any_value(subject) AS subject, CASE predicate_key WHEN 'shipment volume' THEN 'Shipment Volume' ELSE 'Revenue From Operations' END AS predicate, arg_min(coalesce(normalized_unit, '-'), ordinal) AS unit, arg_min(coalesce(scope, '-'), ordinal) AS scope,
      max(nv) FILTER (ordinal = 1) AS value_a, max(nv) FILTER (ordinal = 2) AS value_b, max(scope) FILTER (ordinal = 1) AS sa, max(scope) FILTER (ordinal = 2) AS sb, max(raw_claim) FILTER (ordinal = 1) AS raw_a, max(raw_claim) FILTER (ordinal = 2) AS raw_b,
      count(*) FILTER (ordinal = 1) > 0 AS has_a, count(*) FILTER (ordinal = 2) > 0 AS has_b, concat(coalesce(max(p.id) FILTER (ordinal = 1), '-'), '|', coalesce(max(p.id) FILTER (ordinal = 2), '-')) AS points,
      concat(coalesce(max(spot) FILTER (ordinal = 1), '-'), '|', coalesce(max(spot) FILTER (ordinal = 2), '-')) AS timeline, any_value(file_b) AS file_b
    FROM (SELECT p.*, s.comparison_id AS of_comparison, concat_ws('/', s.filename, p.period_text, coalesce(e.evidence_page, p.page_number), e.quote) AS spot FROM {d_picks} p JOIN {fx_selection} s ON s.document_id = p.document_id LEFT JOIN {d_first} e ON e.fact_id = p.id) p
    JOIN (SELECT *, max(CASE WHEN ordinal = 2 THEN filename END) OVER (PARTITION BY comparison_id) AS file_b FROM {fx_selection}) s ON s.document_id = p.document_id AND s.comparison_id = p.of_comparison GROUP BY 1, 2, 3)))"""
DUCK["d_similar"] = "SELECT query_id, vec_id AS id, 1 - list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])), vec_id) AS rank FROM {fx_queries} CROSS JOIN {embeddings}"

SQL: dict[str, str] = {}
SQL["validate_files"] = "SELECT page_id, CASE WHEN strlen(html) = 0 THEN 'empty' WHEN strlen(html) > 52428800 THEN 'too large' WHEN NOT coalesce(starts_with(html, '<html'), false) THEN 'wrong type' END AS problem FROM {pages}"
SQL["sanitize_filename"] = r"SELECT page_id, CASE WHEN ends_with(lower(f), '.pdf') THEN f ELSE concat(f, '.pdf') END AS filename FROM (SELECT page_id, regexp_replace(regexp_replace(list_extract(string_split(replace(url, '\', '/'), '/'), -1), '[^\p{L}\p{N}_.\-]', '_', 'g'), '^\.+', '') AS f FROM {pages})"
SQL["file_hash"] = "SELECT page_id, sha256(html) AS file_hash FROM {pages}"
SQL["dedup_documents"] = """SELECT d.doc_id AS id, CASE WHEN EXISTS (SELECT 1 FROM documents s WHERE s.lang = 'fr' AND s.source = d.source AND s.text = d.text) OR row_number() OVER (PARTITION BY source, text ORDER BY concat('f', d.doc_id), d.doc_id) > 1 THEN 'ALREADY_EXISTS' ELSE 'NEW' END AS state FROM documents d WHERE lang <> 'fr'"""
SQL["register_datasets"] = "SELECT DISTINCT n_name AS name, concat('Dataset: ', n_name) AS description FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)"
SQL["storage_path"] = "SELECT id, concat(dataset_id, '/', document_id, '/', id) AS path FROM {fx_pages}"
SQL["page_table"] = r"SELECT document_id, page_number, CAST(length(t) AS INT) AS char_count, CAST(len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS INT) AS word_count FROM (SELECT doc_id AS document_id, generate_subscripts(string_split(text, chr(10)), 1) AS page_number, unnest(string_split(text, chr(10))) AS t FROM documents)"
SQL["upsert_relationships"] = """WITH o AS (SELECT * FROM {fx_edges} WHERE confidence >= 0.7), n AS (SELECT * FROM {fx_edges} WHERE confidence < 0.8)
SELECT coalesce(o.fact_a_id, n.fact_a_id) AS fact_a_id, coalesce(o.fact_b_id, n.fact_b_id) AS fact_b_id, coalesce(n.relationship_type, o.relationship_type) AS relationship_type, CASE WHEN n.fact_a_id IS NULL THEN o.confidence ELSE 0.5 END AS confidence,
concat(CASE WHEN o.fact_a_id IS NULL THEN '' ELSE 'old-' END, coalesce(o.fact_a_id, n.fact_a_id), '/', coalesce(o.fact_b_id, n.fact_b_id)) AS id FROM o FULL JOIN n ON o.fact_a_id = n.fact_a_id AND o.fact_b_id = n.fact_b_id"""
SQL["append_facts_evidence"] = "SELECT f.id, f.dataset_id, f.fact_type, e.quote, f.page_number, length(e.quote) > 0 AND regexp_matches(e.quote, '\\S') AS sound FROM {fx_facts} f JOIN {d_first} e ON e.fact_id = f.id"
SQL["delete_dataset_cascade"] = """SELECT 'filings' AS part, count(*) AS n FROM {fx_filings} WHERE dataset_id <> 'ASIA' UNION ALL SELECT 'facts', count(*) FROM {fx_facts} WHERE dataset_id <> 'ASIA'
UNION ALL SELECT 'evidence', count(*) FROM {fx_evidence} WHERE NOT starts_with(fact_id, 'ASIA-') UNION ALL SELECT 'edges', count(*) FROM {fx_edges} WHERE NOT starts_with(fact_a_id, 'ASIA-') AND NOT starts_with(fact_b_id, 'ASIA-')
UNION ALL SELECT 'pages', count(*) FROM {fx_pages} WHERE page_number % 3 > 0 UNION ALL SELECT 'chunks', count(*) FROM {fx_pages} WHERE page_number % 3 > 0 UNION ALL SELECT 'runs', count(*) FROM {fx_runs} WHERE document_id % 3 > 0
UNION ALL SELECT 'evidence with a chunk', count(*) FROM {fx_evidence} WHERE NOT starts_with(fact_id, 'ASIA-') AND page_number % 3 > 0"""
SQL["select_pages"] = """SELECT page_id, CAST(turn AS INT) AS turn FROM (SELECT page_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_id) AS turn FROM (SELECT p.id AS page_id, p.document_id, p.page_number, d.page_id IS NULL AS fresh, count(*) FILTER (d.page_id IS NULL) OVER (PARTITION BY p.document_id) AS remaining
FROM {fx_pages} p LEFT JOIN (SELECT DISTINCT page_id FROM {fx_evidence}) d ON d.page_id = p.id) WHERE fresh OR remaining = 0) WHERE turn <= 10"""
SQL["nonblank_pages"] = r"SELECT id FROM {fx_pages} WHERE regexp_matches(text, '\S')"
SQL["facts_by_dataset"] = "SELECT id, created_at FROM {fx_facts} WHERE dataset_id = 'ASIA' ORDER BY created_at, id"
SQL["facts_search"] = "SELECT id, created_at, count(*) OVER () AS total FROM {fx_facts} WHERE dataset_id = 'EUROPE' AND bn % 2 = 0 AND subject ILIKE '%brand#%' AND (subject ILIKE '%REVENUE%' OR predicate ILIKE '%REVENUE%' OR raw_claim ILIKE '%REVENUE%') ORDER BY created_at DESC, id LIMIT 50 OFFSET 10"
SQL["fact_view"] = "SELECT f.id, f.subject, f.predicate, e.quote, coalesce(e.evidence_page, f.page_number) AS page, coalesce(f.nv, f.value_numeric) AS value, coalesce(f.normalized_unit, f.unit) AS shown_unit FROM {d_facts} f LEFT JOIN {d_first} e ON e.fact_id = f.id"
SQL["relationship_filters"] = "SELECT fact_a_id, fact_b_id, confidence FROM {d_detailed} WHERE relationship_type = 'CONTRADICTS' AND confidence >= 0.6 AND a.document_id <> b.document_id AND a.dataset_id = 'EUROPE'"
SQL["relationship_filters_pages"] = "SELECT relationship_type, count(*) AS n FROM {d_detailed} WHERE a.document_id <> b.document_id OR a.page <> b.page OR a.page IS NULL OR b.page IS NULL GROUP BY 1"
SQL["purge_same_page"] = "SELECT fact_a_id, fact_b_id, NOT coalesce(a.document_id = b.document_id AND a.page = b.page, false) AS kept FROM {d_detailed}"
SQL["relationship_search"] = "SELECT fact_a_id, fact_b_id FROM {d_detailed} WHERE confidence >= 0.55 AND a.document_id <> b.document_id AND contains(lower(concat_ws(' ', a.filename, a.predicate, a.raw_claim, a.subject, b.filename, b.predicate, b.raw_claim, b.subject)), 'brand#2')"
SQL["document_search"] = "SELECT id, filename FROM {fx_filings} WHERE contains(lower(filename), 'am')"
SQL["validate_facts"] = """SELECT id, concat_ws(',', CASE WHEN value_numeric IS NULL AND NOT (bn % 9 = 6 AND k = 5) AND bn % 9 <> 7 THEN 'value' END, CASE WHEN period_end < period_start THEN 'period' END, CASE bn % 9 WHEN 1 THEN 'subject' WHEN 2 THEN 'predicate' WHEN 3 THEN 'claim' WHEN 4 THEN 'confidence' WHEN 5 THEN 'type' END) AS violations FROM {d_facts}"""
SQL["validate_evidence"] = r"SELECT id, concat_ws(',', CASE WHEN NOT regexp_matches(quote, '\S') THEN 'text' END, CASE WHEN length(quote) < 20 THEN 'order' END, CASE WHEN length(quote) > 40 THEN 'confidence' END) AS violations FROM {fx_evidence}"
SQL["validate_relationships"] = "SELECT fact_b_id AS fact_a_id, fact_a_id AS fact_b_id, concat_ws(',', 'order', CASE WHEN confidence * 1.3 > 1 THEN 'confidence' END, CASE WHEN relationship_type = 'RELATED' THEN 'reason' END) AS violations FROM {fx_edges}"
SQL["validate_vectors"] = "SELECT vec_id, CAST(CASE WHEN len(embedding) = 64 THEN 0 ELSE 1 END AS BIGINT) AS n FROM {embeddings}"
SQL["confidence_band"] = "SELECT id, CASE WHEN s >= 90 THEN 'HIGH' WHEN s >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT id, CASE WHEN bn % 3 = 0 THEN bn * 4 ELSE round(confidence * 100) END AS s FROM {fx_facts})"
SQL["first_evidence"] = "SELECT * FROM {d_first}"
SQL["facts_for_matching"] = "SELECT id, page AS page_number, quote FROM {d_rich}"
SQL["facts_with_evidence"] = "SELECT f.id, f.quote, (SELECT count(*) FROM {fx_evidence} e WHERE e.fact_id = f.id) AS n_evidence FROM {d_rich} f"
SQL["relationships_basic"] = "SELECT fact_a_id, fact_b_id, a.raw_claim AS claim_a, b.raw_claim AS claim_b FROM {d_detailed} WHERE a.dataset_id = 'ASIA' AND b.dataset_id = 'ASIA'"
SQL["relationships_detailed"] = "SELECT fact_a_id, fact_b_id, a.filename AS file_a, b.filename AS file_b, a.page AS page_a, b.quote AS quote_b FROM {d_detailed}"
SQL["pair_filters"] = "SELECT fact_a_id, fact_b_id, true AS flt_dataset, a.id <> b.id AS flt_non_self, a.document_id <> b.document_id AS flt_cross_document, NOT (a.document_id = b.document_id AND a.page_number = b.page_number) AS flt_not_same_page FROM {d_pairs}"
SQL["temporal_compat"] = "SELECT fact_a_id, fact_b_id, ok_t AS ok, why_t AS reason FROM {d_pairs}"
SQL["metric_compat"] = "SELECT fact_a_id, fact_b_id, ok_m AS ok, why_m AS reason FROM {d_pairs}"
SQL["is_candidate_pair"] = "SELECT fact_a_id, fact_b_id, a.document_id <> b.document_id AND ok_m AS ok, CASE WHEN a.document_id = b.document_id THEN 'same_document' WHEN NOT ok_m THEN why_m ELSE concat_ws(',', 'cross_document', why_m, CASE WHEN ok_t THEN why_t END, 'predicate_aligned_1.00') END AS reasons FROM {d_pairs}"
SQL["parse_number"] = "SELECT id, parsed AS value, neg AS is_negative FROM {d_facts}"
SQL["scale_multiplier"] = "SELECT id, factor FROM {d_facts}"
SQL["normalize_number"] = "SELECT id, nv AS value FROM {d_facts}"
SQL["normalize_unit"] = "SELECT id, normalized_unit FROM {d_facts}"
SQL["normalize_period"] = "SELECT id, CAST(period_start AS DATE) AS period_start, CAST(period_end AS DATE) AS period_end FROM {d_facts}"
SQL["normalize_facts"] = "SELECT id, nv AS normalized_value_numeric, normalized_unit, CASE WHEN bn % 2 = 0 THEN make_date(y, 1, 1) ELSE CAST(period_start AS DATE) END AS period_start, CAST(period_end AS DATE) AS period_end FROM {d_facts}"
SQL["predicate_alignment"] = "SELECT fact_a_id, fact_b_id, true AS aligned, CAST(1.0 AS DOUBLE) AS score FROM {d_pairs}"
SQL["token_jaccard"] = f"SELECT fact_a_id, fact_b_id, round({_jaccard('x', 'y')}, 4) AS similarity FROM (SELECT fact_a_id, fact_b_id, {_tokens('a.raw_claim')} AS x, {_tokens('b.raw_claim')} AS y FROM {{d_pairs}})"
SQL["cosine_similarity"] = "SELECT query_id, vec_id, round(greatest(least(list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 1.0), 0.0), 4) AS similarity FROM {fx_queries} CROSS JOIN {embeddings}"
SQL["hybrid_score"] = f"""SELECT fact_a_id, fact_b_id, round(CASE WHEN va.embedding IS NOT NULL AND vb.embedding IS NOT NULL THEN 0.65 * greatest(least(list_cosine_similarity(CAST(va.embedding AS DOUBLE[]), CAST(vb.embedding AS DOUBLE[])), 1.0), 0.0) + 0.35
ELSE 0.50 * {_jaccard(_tokens('a.raw_claim'), _tokens('b.raw_claim'))} + 0.5 END, 4) AS score FROM {{d_pairs}} JOIN {{fx_vectors}} va ON va.id = fact_a_id JOIN {{fx_vectors}} vb ON vb.id = fact_b_id"""
SQL["fact_embedding_text"] = "SELECT id, concat_ws(' | ', concat('Entity: ', subject), concat('Metric: ', predicate), concat('Claim: ', raw_claim), concat('Period: ', period_text), CASE WHEN normalized_unit IS NOT NULL THEN concat('Unit: ', normalized_unit) END) AS text FROM {d_facts}"
SQL["printed_page_number"] = r"SELECT doc_id, coalesce(nullif(regexp_extract(lines[-1], '(?i)^(?:page|p\.|-)?\s*(\d{1,4})(?:\s*-)?$', 1), ''), nullif(regexp_extract(lines[1], '(?i)^(?:page|p\.|-)?\s*(\d{1,4})(?:\s*-)?$', 1), ''), CAST(n_chars AS VARCHAR)) AS printed FROM (SELECT doc_id, n_chars, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)"
SQL["format_value"] = """SELECT id, CASE WHEN nv IS NULL THEN '—' ELSE concat(CASE WHEN normalized_unit = 'INR' THEN '₹' WHEN normalized_unit = 'USD' THEN '$' ELSE '' END,
CASE WHEN normalized_unit = 'INR' AND abs(nv) >= 1e7 THEN concat(CAST(CAST(CAST(nv / 1e7 AS DECIMAL(38,9)) AS DECIMAL(38,2)) AS VARCHAR), ' Cr') WHEN normalized_unit = 'INR' AND abs(nv) >= 1e5 THEN concat(CAST(CAST(CAST(nv / 1e5 AS DECIMAL(38,9)) AS DECIMAL(38,2)) AS VARCHAR), ' Lakh') WHEN abs(nv) >= 1e9 THEN concat(CAST(CAST(CAST(nv / 1e9 AS DECIMAL(38,9)) AS DECIMAL(38,2)) AS VARCHAR), 'B') WHEN abs(nv) >= 1e6 THEN concat(CAST(CAST(CAST(nv / 1e6 AS DECIMAL(38,9)) AS DECIMAL(38,2)) AS VARCHAR), 'M') WHEN abs(nv) >= 1e3 THEN concat(CAST(CAST(CAST(nv / 1e3 AS DECIMAL(38,9)) AS DECIMAL(38,2)) AS VARCHAR), 'K') ELSE concat(CAST(CAST(CAST(nv AS DECIMAL(38,9)) AS DECIMAL(38,2)) AS VARCHAR), '') END) END AS shown FROM {d_facts}"""
SQL["dataset_counts"] = """SELECT d.id, (SELECT count(*) FROM {fx_filings} g WHERE g.dataset_id = d.id) AS documents, (SELECT count(*) FROM {fx_facts} f WHERE f.dataset_id = d.id) AS facts, (SELECT count(*) FROM {fx_edges} e JOIN {fx_facts} f ON f.id = e.fact_a_id WHERE f.dataset_id = d.id) AS relationships FROM {fx_datasets} d"""
SQL["extracted_pages"] = "SELECT document_id, count(DISTINCT page_number) AS n_pages, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS pages FROM (SELECT page_document AS document_id, page_number FROM {fx_evidence} UNION ALL SELECT document_id, page_number FROM {fx_pages}) GROUP BY 1"
SQL["relationship_stats"] = "SELECT scope, relationship_type, count(*) AS n FROM (SELECT *, CASE WHEN a.document_id <> b.document_id THEN 'cross' ELSE 'same' END AS scope FROM {d_detailed}) GROUP BY CUBE (scope, relationship_type)"
SQL["overview_totals"] = "SELECT (SELECT count(*) FROM {fx_filings}) AS documents, (SELECT count(*) FROM {fx_facts}) AS facts, (SELECT count(*) FROM {fx_edges}) AS relationships, (SELECT count(*) FROM {fx_pages}) AS pages"
SQL["document_fact_counts"] = "SELECT comparison_id, ordinal, s.document_id, count(f.id) AS facts FROM {fx_selection} s LEFT JOIN {fx_facts} f ON f.document_id = s.document_id GROUP BY 1, 2, 3"
SQL["run_counters"] = "SELECT id, CAST(facts_extracted + CASE WHEN facts_extracted > 50 THEN 2 ELSE 0 END AS BIGINT) AS facts_extracted, CAST(CASE WHEN facts_extracted > 50 THEN 1 ELSE 0 END AS BIGINT) AS facts_rejected, CAST(CASE WHEN facts_extracted > 50 THEN 3 ELSE 0 END AS BIGINT) AS chunks_created, CASE WHEN facts_extracted > 50 THEN 'COMPLETED' ELSE status END AS status FROM {fx_runs}"
SQL["document_status"] = "SELECT document_id AS id, CASE WHEN status = 'PROCESSING' AND started_at < CAST('2024-01-30 23:55:00' AS TIMESTAMP) THEN 'failed' ELSE lower(status) END AS shown_status, CAST(CASE WHEN document_id % 3 > 0 THEN document_id % 7 ELSE 0 END AS INT) AS page_count, CAST(CASE WHEN document_id % 2 = 0 THEN document_id * 10 ELSE 0 END AS BIGINT) AS file_size_bytes FROM {fx_runs} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC NULLS FIRST, id) = 1"
SQL["stale_runs"] = "SELECT id, CASE WHEN s THEN 'FAILED' ELSE status END AS status, s AS changed FROM (SELECT *, status = 'PROCESSING' AND started_at < CAST('2024-01-30 23:55:00' AS TIMESTAMP) AS s FROM {fx_runs})"
SQL["active_run"] = "SELECT document_id, id FROM {fx_runs} WHERE status = 'PROCESSING' AND started_at >= CAST('2024-01-14 12:00:00' AS TIMESTAMP) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC, id) = 1"
SQL["extraction_batches"] = "SELECT document_id, batch_no, sha256(string_agg(concat('[chunk_', i % 2 + 1, ']', chr(10), text), concat(chr(10), chr(10)) ORDER BY i)) AS prompt, count(*) AS n_chunks FROM (SELECT document_id, text, page_number - 1 AS i, CAST((page_number - 1) // 2 AS BIGINT) AS batch_no FROM {fx_pages}) GROUP BY 1, 2"
SQL["similar_chunks"] = "SELECT query_id, id, round(distance, 4) AS distance, CAST(rank AS INT) AS rank FROM {d_similar} WHERE rank <= 5"
SQL["nearest_facts"] = """SELECT query_id, id, round(1 - distance, 4) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS id, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id AND q.vec_id % 2 = e.vec_id % 2 AND q.vec_id % 5 <> e.vec_id % 5)
WHERE 1 - distance >= 0.2) WHERE rank <= 10"""
SQL["best_case_per_type"] = "SELECT relationship_type, fact_a_id, fact_b_id, confidence FROM {d_detailed} QUALIFY row_number() OVER (PARTITION BY relationship_type ORDER BY (a.document_id <> b.document_id AND relationship_type <> 'UNCERTAIN') DESC, confidence DESC, created_at DESC, fact_a_id, fact_b_id) = 1"
SQL["metric_pick"] = "SELECT document_id, subject_key, predicate_key, id FROM {d_picks}"
SQL["numeric_variance"] = "SELECT fact_a_id, fact_b_id, round(v, 4) AS variance FROM {d_pairs}"
SQL["deterministic_relationship"] = """SELECT fact_a_id, fact_b_id, rule_type AS "type", CAST(rule_confidence AS DOUBLE) AS confidence, CASE rule_confidence WHEN 0.96 THEN 'temporal_overlap,variance' WHEN 0.90 THEN 'scope_factor,variance' WHEN 0.95 THEN 'temporal_difference' WHEN 0.92 THEN (CASE rule_type WHEN 'CONTRADICTS' THEN 'period,variance' ELSE 'status_factor' END) END AS factors FROM {d_rules}"""
SQL["classify_pairs"] = """SELECT fact_a_id, fact_b_id, CASE WHEN rule_type IS NOT NULL THEN rule_type WHEN given THEN relationship_type ELSE 'UNCERTAIN' END AS relationship_type, CAST(CASE WHEN rule_type IS NOT NULL THEN rule_confidence WHEN given THEN round(confidence, 3) ELSE 0.5 END AS DOUBLE) AS confidence,
CASE WHEN rule_type IS NOT NULL THEN 'deterministic_rules' WHEN given THEN 'llm_contextual_reasoning' ELSE 'fallback_uncertain' END AS reasoning_method FROM (SELECT *, edge_created >= CAST('2024-01-05' AS TIMESTAMP) AND relationship_type <> 'RELATED' AS given FROM {d_rules})"""
SQL["compare_documents"] = "SELECT comparison_id, subject_key, predicate_key, subject, predicate, nullif(unit, '-') AS unit, nullif(scope, '-') AS scope, category, change, percent, difference, value_a, value_b, raw_a, raw_b, position, points, timeline FROM {d_compared}"
SQL["comparison_summary"] = "SELECT comparison_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c.lower()}" for c in ("INCREASED", "DECREASED", "CONTEXT_CHANGED", "UNCHANGED", "ADDED", "NOT_FOUND")) + " FROM {d_compared} GROUP BY 1"
SQL["metric_filters"] = "SELECT comparison_id, subject_key, predicate_key, category FROM {d_compared} WHERE category <> 'UNCHANGED' AND contains(lower(concat_ws(' ', predicate_key, subject_key, raw_a, raw_b)), 'earned in 199')"
SQL["fact_confidence"] = r"""SELECT id, CAST(greatest(least(score, 100), 0) AS INT) AS score, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS level, CAST(len(list_filter(s, lambda x: ends_with(x, 'pass'))) AS INT) AS positive_count,
CAST(len(list_filter(s, lambda x: NOT ends_with(x, 'pass'))) AS INT) AS negative_count, array_to_string(s, ', ') AS signals FROM (
SELECT id, s, 40 + list_sum(list_transform(s, lambda x: CAST(regexp_extract(x, '(-?\d+) \w+$', 1) AS INT))) AS score FROM (
SELECT id, list_filter([CASE WHEN len >= 20 THEN 'quote 20 pass' WHEN len > 0 THEN 'short quote 10 warn' ELSE 'no quote -20 fail' END, CASE WHEN page > 0 THEN 'page 15 pass' ELSE 'no page -10 warn' END, 'period 10 pass',
  CASE WHEN hasunit THEN 'unit 10 pass' WHEN num OR digit THEN 'no unit -5 warn' ELSE 'in words 5 pass' END, CASE WHEN hasscope THEN 'scope 5 pass' ELSE 'no scope 0 warn' END, CASE WHEN num THEN 'number 5 pass' END, CASE WHEN bn % 7 = 0 THEN 'table -15 fail' END], lambda x: x IS NOT NULL) AS s FROM (
SELECT f.id, f.bn, length(coalesce(regexp_replace(coalesce(nullif(e.quote, ''), CASE WHEN f.bn % 9 = 0 THEN 'A quote that stands here alone.' END), '^\s+|\s+$', '', 'g'), '')) AS len,
  CASE WHEN f.bn % 5 > 0 AND f.bn % 2 = 0 THEN coalesce(e.evidence_page, f.page_number) WHEN e.evidence_page IS NOT NULL THEN e.evidence_page WHEN f.bn % 5 = 0 THEN f.page_number END AS page,
  f.normalized_unit IS NOT NULL AS hasunit, nv IS NOT NULL OR value_numeric IS NOT NULL AS num, regexp_matches(f.raw_value_text, '\d') AS digit, f.scope IS NOT NULL OR f.bn % 4 = 0 AS hasscope FROM {d_facts} f LEFT JOIN {d_first} e ON e.fact_id = f.id)))"""
SQL["rag_context"] = """SELECT q.query_id, sha256(coalesce(c, 'No relevant document chunks found.')) AS context FROM {fx_queries} q LEFT JOIN (SELECT query_id, string_agg(concat('[Source ', rank, '] (', id, ', ', printf('%.3f', 1 - distance), ')', chr(10), text), concat(chr(10), chr(10)) ORDER BY rank) AS c
FROM {d_similar} JOIN documents ON doc_id = id WHERE rank <= 3 AND query_id % 300 > 0 GROUP BY 1) h ON h.query_id = q.query_id"""
SQL["parse_model_answers"] = """SELECT doc_id AS batch_id, CAST(i AS BIGINT) AS position, source AS subject, CAST(n_chars AS DOUBLE) AS value_numeric, CASE WHEN doc_id % 7 > 0 THEN (CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END) END AS value_boolean,
CASE WHEN doc_id % 2 > 0 THEN 'DERIVED' ELSE 'NUMERICAL' END AS fact_type, CASE WHEN doc_id % 3 > 0 THEN 'forecast' ELSE 'actual' END AS status, CASE WHEN doc_id % 5 > 0 THEN 0.25::DOUBLE ELSE 0.9::DOUBLE END AS confidence, lang AS geography,
CASE WHEN doc_id % 4 > 0 THEN source END AS segment, CASE WHEN doc_id % 6 > 0 THEN 'a board' END AS attribution FROM documents CROSS JOIN (SELECT unnest([0, 1]) AS i) WHERE lang <> 'es' AND NOT (doc_id % 2 > 0 AND doc_id % 11 = 0)"""
SQL["candidate_pairs"] = f"""WITH f AS (SELECT f.*, v.embedding, {_tokens('predicate')} AS tp, {_tokens('subject')} AS ts, {_tokens('raw_claim')} AS tc FROM {{d_facts}} f LEFT JOIN {{fx_vectors}} v ON v.id = f.id)
SELECT * FROM (SELECT a.id AS fact_a_id, b.id AS fact_b_id, a.dataset_id, round(CASE WHEN a.embedding IS NOT NULL AND b.embedding IS NOT NULL THEN 0.65 * greatest(least(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 1.0), 0.0) + 0.20 * CASE WHEN a.p = b.p THEN 1.0 ELSE 0.0 END + 0.15 * {_jaccard('a.ts', 'b.ts')}
ELSE 0.50 * {_jaccard('a.tc', 'b.tc')} + 0.30 * CASE WHEN a.p = b.p THEN 1.0 ELSE 0.0 END + 0.20 * {_jaccard('a.ts', 'b.ts')} END, 4) AS score
FROM f a JOIN f b ON a.dataset_id = b.dataset_id AND a.id < b.id AND a.document_id <> b.document_id AND (a.normalized_unit IS NULL OR b.normalized_unit IS NULL OR a.normalized_unit = b.normalized_unit OR (a.normalized_unit IN ('INR', 'USD') AND b.normalized_unit IN ('INR', 'USD')))) WHERE score >= 0.45"""

_TRIMMED = _TRIM.format("quote")
DUCK["d_items"] = """SELECT *, CASE WHEN page_number % 4 < 2 THEN spot END AS named, CASE WHEN page_number % 5 = 0 THEN 'nothing of the kind' ELSE substring(text, 11, 30) END AS quote
    FROM (SELECT *, concat(document_id, '/', (page_number - 1) // 2) AS batch_id, (page_number - 1) % 2 + 1 AS spot FROM {fx_pages})"""
DUCK["d_resolved"] = """SELECT i.batch_id, i.page_number AS position, i.quote, CASE WHEN tier < 2 THEN c.id END AS chunk_id, CASE WHEN tier < 2 THEN c.text END AS chunk_text FROM (SELECT i.*, c.id AS c_id, CASE WHEN c.spot = i.named THEN 0 WHEN i.quote <> '' AND contains(c.text, i.quote) THEN 1 ELSE 2 END AS tier, c.spot AS c_spot
    FROM {d_items} i JOIN {d_items} c ON c.batch_id = i.batch_id) i JOIN {d_items} c ON c.id = i.c_id QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY tier, c_spot) = 1"""
SQL["chunk_of_fact"] = "SELECT batch_id, position, chunk_id FROM {d_resolved}"
SQL["rejection_counts"] = rf"SELECT batch_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM (SELECT batch_id, coalesce(chunk_id IS NOT NULL AND {_TRIMMED} <> '' AND contains(chunk_text, {_TRIMMED}), false) AS ok FROM {{d_resolved}}) GROUP BY 1"
SQL["ground_facts"] = rf"""SELECT id, CASE WHEN c > 0 THEN c - 1 WHEN p > 0 THEN p - 1 END AS start, CASE WHEN c > 0 THEN 'chunk' WHEN p > 0 THEN 'page' END AS offset_base, c > 0 OR p > 0 AS grounded
    FROM (SELECT id, CASE WHEN q = '' OR q IS NULL THEN 0 WHEN page_number % 2 = 1 THEN coalesce(strpos(text, q), 0) ELSE coalesce(strpos(substring(text, 1, 12), q), 0) END AS c, CASE WHEN q = '' OR q IS NULL OR page_number % 3 = 0 THEN 0 ELSE coalesce(strpos(text, q), 0) END AS p
    FROM (SELECT *, {_TRIM.format("substring(text, 11, 30)")} AS q FROM {{fx_pages}}))"""
SQL["build_facts"] = """SELECT id AS page_id, CAST(page_number AS VARCHAR) AS pdf_page, dataset_id AS subject, concat('page ', page_number) AS raw_claim, 'q' AS quote, v AS value_text, coalesce(r, v, CASE WHEN n <> 0 THEN concat(page_number, '.0') ELSE '' END) AS raw_value_text, n AS value_numeric,
    CASE WHEN page_number % 4 = 1 THEN 'true' END AS value_boolean, 'NUMERICAL' AS fact_type, concat('geography ', dataset_id) AS geography, concat('segment ', dataset_id) AS segment, concat('attribution ', dataset_id) AS attribution, CASE WHEN page_number % 8 > 0 THEN least(page_number / 10.0, 1.0)::DOUBLE ELSE 0.9::DOUBLE END AS confidence
    FROM (SELECT *, CASE WHEN page_number % 3 = 0 THEN 'v' WHEN n IS NULL AND page_number % 4 <> 1 THEN coalesce(r, concat('page ', page_number, ' ')) END AS v FROM (SELECT *, CASE WHEN page_number % 5 = 0 THEN 'raw' END AS r, CASE WHEN page_number % 2 = 0 THEN CAST(page_number AS DOUBLE) END AS n FROM {fx_pages} WHERE page_number % 7 > 0))"""
SQL["chunk_index"] = "SELECT id, i - 1 AS chunk_index, length(l[i]) AS n_chars FROM (SELECT id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT id, string_split(text, chr(10)) AS l FROM {fx_pages}))"
SQL["upsert_chunks"] = "SELECT id AS page_id, 0 AS chunk_index, CASE WHEN page_number < 3 THEN 'old' WHEN page_number % 2 = 0 THEN 'x' END AS note, CASE WHEN page_number <= 4 THEN concat('old-', id) ELSE id END AS id, CASE WHEN page_number >= 3 THEN -1 ELSE length(text) END AS n_chars FROM {fx_pages}"
SQL["validate_chunks"] = r"SELECT id, concat_ws(',', CASE WHEN page_number % 3 = 0 OR NOT coalesce(regexp_matches(text, '\S'), false) THEN 'text' END, CASE WHEN page_number < 2 THEN 'start' END, CASE WHEN page_number % 5 < page_number - 2 THEN 'order' END) AS violations FROM {fx_pages}"
SQL["update_normalization"] = "SELECT f.id, CASE WHEN f.k <= 2 THEN d.nv END AS normalized_value_numeric, CASE WHEN f.k <= 2 THEN d.normalized_unit END AS normalized_unit FROM {fx_facts} f JOIN {d_facts} d ON d.id = f.id"
SQL["update_embeddings"] = "SELECT f.id, coalesce(len(v.embedding), 0) AS n FROM {fx_facts} f LEFT JOIN {fx_vectors} v ON v.id = f.id"
_COUNTED = "length({0}) AS n_chars, length(regexp_replace({0}, '[^0-9]', '', 'g')) AS n_digits"
SQL["unembedded_facts"] = f"SELECT t.id, {_COUNTED.format('t.text')} FROM ({SQL['fact_embedding_text']}) t JOIN {{fx_vectors}} v ON v.id = t.id WHERE v.embedding IS NULL"
SQL["reindex_chunks"] = f"SELECT id, {_COUNTED.format('text')} FROM {{fx_pages}}"
SQL["reset_runs"] = "SELECT id, CASE WHEN s THEN 'FAILED' ELSE status END AS status, s AS changed FROM (SELECT *, status = 'PROCESSING' AND document_id % 7 = 0 AS s FROM {fx_runs})"
_OWNER = "concat(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][{0} % 5 + 1], '-d', {0} % 3 + 1)"
SQL["document_detail"] = f"""WITH r AS (SELECT *, {_OWNER.format('document_id')} AS d FROM {{fx_runs}} QUALIFY row_number() OVER (PARTITION BY d ORDER BY started_at DESC NULLS FIRST, id) <= 10),
    c AS (SELECT {_OWNER.format('page_number')} AS d, page_number FROM {{fx_pages}}), p AS (SELECT f.document_id AS d, e.page_number FROM {{fx_evidence}} e JOIN {{fx_facts}} f ON f.id = e.fact_id UNION ALL SELECT * FROM c)
    SELECT g.id, coalesce((SELECT arg_min(CASE WHEN status = 'PROCESSING' AND started_at < CAST('2024-01-30 23:55:00' AS TIMESTAMP) THEN 'failed' ELSE lower(status) END, t) FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC NULLS FIRST, id) AS t FROM r WHERE d = g.id)), 'ingested') AS shown_status,
    (SELECT count(*) FROM {{fx_facts}} WHERE document_id = g.id) AS facts, (SELECT count(*) FROM c WHERE d = g.id) AS chunks, (SELECT count(DISTINCT page_number) FROM p WHERE d = g.id) AS n_pages, (SELECT string_agg(id, ',' ORDER BY started_at DESC NULLS FIRST, id) FROM r WHERE d = g.id) AS runs FROM {{fx_filings}} g"""
for _name in ("flt_dataset", "flt_non_self", "flt_cross_document", "flt_not_same_page"):
    SQL[_name] = f"SELECT fact_a_id, fact_b_id, {_name} AS ok FROM ({SQL['pair_filters']})"
SQL["pair_flags"] = "SELECT fact_a_id, fact_b_id, true AS subject_match, true AS predicate_match, ok_t AS temporal_match FROM {d_pairs}"
SQL["card_variance"] = """SELECT fact_a_id, fact_b_id, CASE WHEN relationship_type IN ('RELATED', 'UNCERTAIN') OR x IS NULL OR y IS NULL THEN NULL WHEN x = y OR abs(y - x) / greatest(abs(x), abs(y)) < 0.005 THEN 'Exact match (~0% variance)' WHEN x = 0 THEN NULL
    ELSE concat(CASE WHEN y > x THEN '+' ELSE '' END, CAST(round(CAST(CAST(pct AS VARCHAR) AS DECIMAL(38, 18)), 1) AS DECIMAL(38, 1)), '% variance') END AS variance, (sa IS NOT NULL)::INT + (sb IS NOT NULL)::INT + 1 AS n_factors
    FROM (SELECT *, (y - x) / nullif(abs(x), 0) * 100 AS pct FROM (SELECT *, a.nv AS x, b.nv AS y, a.scope AS sa, b.scope AS sb FROM {d_pairs}))"""
SQL["max_candidates"] = f"SELECT dataset_id, fact_a_id, fact_b_id, score FROM ({SQL['candidate_pairs']}) QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, fact_a_id, fact_b_id) <= 20"
SQL["candidates_for_fact"] = f"""SELECT query_id, id, score FROM (SELECT q AS query_id, id, score FROM (SELECT fact_a_id AS q, fact_b_id AS id, score FROM ({SQL['candidate_pairs']}) UNION ALL SELECT fact_b_id, fact_a_id, score FROM ({SQL['candidate_pairs']})))
    WHERE query_id IN (SELECT id FROM {{fx_facts}} WHERE (bn + 25 * (y + 7 * k) + p) % 100 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"""
SQL["format_misc"] = """SELECT o_orderkey, CASE WHEN n <= 0 THEN '0 B' ELSE concat(regexp_replace(printf('%.1f', floor(n / pow(1024.0, i) * 10 + 0.5) / 10), '[.]0$', ''), ' ', ['B', 'KB', 'MB', 'GB'][i + 1]) END AS size, strftime(o_orderdate, '%b %-d, %Y') AS day, concat(CAST(o_orderkey % 101 AS BIGINT), '%') AS confidence
    FROM (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS i FROM (SELECT *, CAST(trunc(o_totalprice * (o_orderkey % 1000)) AS BIGINT) AS n FROM orders))"""
# What hides a secret, in order, as text of its own.
_MASKS = (
    (r"""(?i)([?&]key=)[^&\s'"]+""", r"\1[REDACTED_KEY]"), (r"""(?i)(x-goog-api-key["'\s:=]+)[a-zA-Z0-9_\-\.]{12,}""", r"\1[REDACTED_KEY]"), (r"(?i)(bearer\s+)[a-zA-Z0-9_\-\.]{15,}", r"\1[REDACTED_TOKEN]"),
    (r"""(?i)(api[_-]?key["'\s:=]+)[a-zA-Z0-9_\-\.]{12,}""", r"\1[REDACTED_KEY]"), (r"(?i)(postgresql(?:ql|\+asyncpg)?://[^:]+:)[^@]+(@)", r"\1[REDACTED_PASSWORD]\2"), (r"\bAQ\.[a-zA-Z0-9_\-]{20,}\b", "[REDACTED_GEMINI_KEY]"),
    (r"\bgsk_[a-zA-Z0-9_\-]{20,}\b", "[REDACTED_GROQ_KEY]"), (r"\bjina_[a-zA-Z0-9_\-]{20,}\b", "[REDACTED_JINA_KEY]"), (r"\beyJ[a-zA-Z0-9_\-]{20,}\.[a-zA-Z0-9_\-]{20,}\.[a-zA-Z0-9_\-]{20,}\b", "[REDACTED_JWT]"),
)
_MASKED = """concat(coalesce(text, ''), ' https://x/?key=k', doc_id, '&b=1 X-Goog-Api-Key: ', repeat('k', doc_id % 30), ' bearer ', repeat('b', doc_id % 33), ' API_KEY="', repeat('q', doc_id % 25), '" postgresql://u:pw', doc_id,
    '@h/db AQ.', repeat('z', doc_id % 40), ' gsk_', repeat('g', doc_id % 41), ' jina_', repeat('j', doc_id % 42), ' eyJ', repeat('e', doc_id % 43), '.', repeat('f', doc_id % 44), '.', repeat('h', doc_id % 45))"""
for _pattern, _shown in _MASKS:
    _MASKED = "regexp_replace(" + _MASKED + ", '" + _pattern.replace("'", "''") + f"', '{_shown}', 'g')"
SQL["redact_secrets"] = "SELECT doc_id, sha256(" + _MASKED + ") AS redacted FROM documents"
