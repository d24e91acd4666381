"""The engine's queries in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from ..operators import kg, rbac
from ..operators.structure import LABELS
from ..sources import manual

LINES = """lines AS (SELECT document_id, pos, regexp_replace(raw, '[^\\x00-\\x7F]', 'x', 'g') AS line FROM (
 SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS raw, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents))"""
ELEMENTS = "el AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in manual.element_exprs("duckdb").items()) + " FROM lines)"
PAGES = (
    "pg AS (SELECT " + ", ".join(manual.PAGE_EXPRS) + " FROM (SELECT document_id, pos // 5 + 1 AS page_number, CAST(sum(length(line)) AS BIGINT) AS char_count FROM lines GROUP BY ALL))"
)
FLAGS = """fl AS (SELECT *, CASE WHEN char_count < 40 OR char_count / greatest(width * height, 1.0) < 0.0005 THEN 'low_text_confidence' ELSE 'text_normal' END AS f1,
 CASE WHEN drawings >= 50 THEN 'vector_diagram' END AS f2, CASE WHEN images > 0 THEN 'raster_image' END AS f3 FROM pg)"""
TASKS = """tk AS (
 SELECT document_id, 'table_reparse' AS task_type, page_number, element_id, NULL AS reason FROM el WHERE element_type = 'table' AND (confidence IS NULL OR confidence < 0.9)
 UNION ALL SELECT e.document_id, 'visual_description', e.page_number, e.element_id, 'page flags: ' || concat_ws(', ', f2, f3) FROM el e JOIN fl p USING (document_id, page_number)
 WHERE e.element_type IN ('figure', 'icon') AND (f2 IS NOT NULL OR f3 IS NOT NULL)
 UNION ALL SELECT document_id, 'full_page_ocr', page_number, -1, NULL FROM fl WHERE parse_score IS NULL OR parse_score < 0.6)"""
#: Heading paths by recursion over a document's headings; an element has the path of the last heading up to it.
PATHS = """hd AS (SELECT document_id, seq, text, greatest(coalesce(nullif(level, 0), 1) - 1, 0) AS keep, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS k FROM el WHERE element_type = 'heading' AND coalesce(text, '') <> ''),
 hp AS (SELECT document_id, k, seq, [text] AS path FROM hd WHERE k = 1 UNION ALL
  SELECT hd.document_id, hd.k, hd.seq, list_append(list_slice(hp.path, 1, hd.keep), hd.text) FROM hp JOIN hd ON hd.document_id = hp.document_id AND hd.k = hp.k + 1),
 st AS (SELECT e.*, coalesce(last_value(h.path IGNORE NULLS) OVER (PARTITION BY e.document_id ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST([] AS VARCHAR[])) AS path,
  CASE WHEN element_type = 'icon' THEN coalesce(
   last_value(CASE WHEN element_type IN ('paragraph', 'list', 'heading') THEN element_id END IGNORE NULLS) OVER (PARTITION BY e.document_id, page_number ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
   last_value(CASE WHEN element_type IN ('paragraph', 'list', 'heading') THEN element_id END IGNORE NULLS) OVER (PARTITION BY e.document_id ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS parent_id
  FROM el e LEFT JOIN hp h ON h.document_id = e.document_id AND h.seq = e.seq)"""


def base(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((LINES, *parts)) + "\n"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def entity_sql(text: str, vlm: bool) -> list[str]:
    """SELECTs of document_id, element_id, page_number, name, entity_type, confidence, method, anchored over el's column `text`."""
    end = "_vlm_description" if vlm else ""
    words = "(VALUES " + ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in kg.KEYWORDS.items()) + ") kw(k, t)"
    hit = f"regexp_matches({text}, '(?i)\\b' || k || '\\b')"
    out = [
        f"SELECT document_id, element_id, page_number, k AS name, t AS entity_type, CASE WHEN count(*) OVER (PARTITION BY element_id) > 5 THEN 0.2 ELSE 0.5 END AS confidence, 'dict_keyword{end}' AS method, CAST(NULL AS BOOLEAN) AS anchored FROM st, {words} WHERE {hit}"
    ]
    for pattern, kind, method in ((kg.SENSOR_TH, "Sensor", "regex_sensor_id"), (kg.SENSOR_RT, "Sensor", "regex_sensor_id_daikin"), (kg.CONNECTOR, "Connector", "regex_connector_id"), (kg.TERMINAL, "Terminal", "regex_terminal_id")):
        out.append(f"SELECT document_id, element_id, page_number, unnest(regexp_extract_all({text}, {quoted(pattern)})), '{kind}', 0.7, '{method}{end}', CAST(NULL AS BOOLEAN) FROM st")
    anchor = f"regexp_matches(coalesce({text}, '') || ' ' || array_to_string(path, ' '), {quoted('(?i)' + kg.ANCHOR)})"
    tier = f"CASE WHEN {anchor} AND element_type = 'table' THEN 0.75 WHEN {anchor} THEN 0.6 ELSE 0.3 END"
    out.append(f"SELECT document_id, element_id, page_number, unnest(regexp_extract_all({text}, {quoted(kg.ERROR_MAIN)}, 1)), 'ErrorCode', {tier}, 'regex_error_code{end}', {anchor} FROM st")
    pairs = f"unnest(list_transform(list_zip(regexp_extract_all({text}, {quoted(kg.ERROR_SUB)}, 1), regexp_extract_all({text}, {quoted(kg.ERROR_SUB)}, 2)), lambda x: x[1] || '-' || x[2]))"
    out.append(f"SELECT document_id, element_id, page_number, {pairs}, 'ErrorCode', {tier}, 'regex_error_code_subcode{end}', {anchor} FROM st")
    return out


ENTITIES = "en AS (" + " UNION ALL ".join(
    ["SELECT document_id, element_id, page_number, component AS name, 'Component' AS entity_type, CAST(0.6 AS DOUBLE) AS confidence, 'vlm_component' AS method, CAST(NULL AS BOOLEAN) AS anchored FROM el WHERE component IS NOT NULL", *entity_sql("description", True), *entity_sql("text", False)]
) + ")"
SIDES = """rl AS (SELECT document_id, element_id, trim(regexp_extract(connection, '(?i)^(.*?)\\s*(?:->|-{1,2}>|\\bto\\b)\\s*(.*)$', 1)) AS subject,
 trim(regexp_extract(connection, '(?i)^(.*?)\\s*(?:->|-{1,2}>|\\bto\\b)\\s*(.*)$', 2)) AS object FROM el WHERE connection IS NOT NULL),
 re AS (SELECT * FROM rl WHERE subject <> '' AND object <> '')"""
AGREE = """ag AS (SELECT *, vlm_ AS is_vlm, CASE WHEN vlm_ THEN sum(CASE WHEN vlm_ THEN 0 ELSE 1 END) OVER w ELSE sum(CASE WHEN vlm_ THEN 1 ELSE 0 END) OVER w END AS other
 FROM (SELECT *, starts_with(method, 'vlm_') OR ends_with(method, '_vlm_description') AS vlm_ FROM en) WINDOW w AS (PARTITION BY document_id, page_number, entity_type, lower(trim(name))))"""
PAGE_TEXT = "pt AS (SELECT document_id, pos // 5 + 1 AS page_number, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY ALL)"
HASHES = "ph AS (SELECT document_id, page_number, sha256(text || '|' || CAST(drawings AS VARCHAR) || '|' || CAST(images AS VARCHAR)) AS page_hash FROM pt JOIN pg USING (document_id, page_number))"
PLAN = """pl AS (SELECT document_id, page_number, CASE WHEN s.h IS NULL THEN 'insert' WHEN f.h IS NULL THEN 'gone' WHEN s.h = f.h THEN 'skip' ELSE 'replace' END AS action
 FROM (SELECT document_id, page_number, CASE WHEN page_number % 3 = 0 THEN 'x' || page_hash ELSE page_hash END AS h FROM ph WHERE page_number % 4 <> 1) s
 FULL JOIN (SELECT document_id, page_number, page_hash AS h FROM ph WHERE page_number % 7 <> 2) f USING (document_id, page_number))"""
#: The chunk fold as a recursion along each document. An icon's parent here is always the element before it.
FOLD = """nx AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS k FROM st),
 fo AS (
  SELECT document_id, k, element_id, 0 AS chunk, 0 AS last_chunk, CASE WHEN element_type IN ('paragraph', 'heading') THEN 0 ELSE -1 END AS t, path AS tp, length(trim(coalesce(text, ''), E' \\t\\n\\r\\x0b\\x0c')) AS tl,
   CASE WHEN element_type = 'list' THEN 0 ELSE -1 END AS p, path AS pp, CASE WHEN element_type = 'list' THEN 'procedure' WHEN element_type IN ('table', 'figure') THEN element_type ELSE 'text' END AS chunk_type
  FROM nx WHERE k = 1
  UNION ALL
  SELECT n.document_id, n.k, n.element_id,
   CASE WHEN n.element_type = 'icon' THEN f.chunk WHEN n.element_type = 'list' AND f.p >= 0 AND f.pp = n.path THEN f.p
    WHEN n.element_type IN ('paragraph', 'heading') AND f.t >= 0 AND f.tp = n.path AND f.tl < 2000 THEN f.t ELSE f.last_chunk + 1 END AS c,
   greatest(f.last_chunk, c),
   CASE WHEN n.element_type = 'icon' THEN f.t WHEN n.element_type IN ('paragraph', 'heading') THEN c ELSE -1 END,
   CASE WHEN n.element_type IN ('paragraph', 'heading') THEN n.path ELSE f.tp END,
   CASE WHEN n.element_type = 'icon' AND f.chunk <> f.t OR n.element_type IN ('table', 'figure', 'list') THEN f.tl
    WHEN c = f.chunk OR c = f.t THEN f.tl + CASE WHEN coalesce(n.text, '') = '' THEN 0 ELSE 1 + length(n.text) END ELSE length(n.text) END,
   CASE WHEN n.element_type = 'icon' THEN f.p WHEN n.element_type = 'list' THEN c ELSE -1 END,
   CASE WHEN n.element_type = 'list' THEN n.path ELSE f.pp END,
   CASE WHEN c <= f.last_chunk THEN (CASE WHEN n.element_type = 'icon' THEN f.chunk_type WHEN n.element_type = 'list' THEN 'procedure' ELSE 'text' END) WHEN n.element_type = 'list' THEN 'procedure' WHEN n.element_type IN ('table', 'figure') THEN n.element_type ELSE 'text' END
  FROM fo f JOIN nx n ON n.document_id = f.document_id AND n.k = f.k + 1)"""
LIST = lambda names: "[" + ", ".join(map(quoted, names)) + "]"
CONN = quoted(kg.CONNECTOR)
COS = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6)"
SAMPLE_CLASS = """CASE WHEN {trouble} THEN 'troubleshooting' WHEN f2 IS NOT NULL AND d4 >= 300 THEN 'electrical_diagram' WHEN f3 IS NOT NULL THEN 'screenshot_ui'
 WHEN f1 = 'text_normal' AND f2 IS NULL AND page_number % 2 = 0 THEN 'table' WHEN f1 = 'text_normal' AND f2 IS NULL THEN 'text_normal' END"""
TROUBLE = "regexp_matches(tx, '(?i)troubleshooting|malfunction|error code|check code|symptom|abnormal')"
STRICT = f"{TROUBLE} AND page_number >= 3 AND regexp_matches(tx, '(?i)cause|remedy|countermeasure|corrective action')"

ORACLES: dict[str, str] = {
    "probe_flags": base(PAGES, FLAGS) + "SELECT document_id, page_number, concat_ws(',', f1, f2, f3) AS flags FROM fl",
    "probe_flag_counts": base(PAGES, FLAGS) + "SELECT flag, count(f) AS n FROM (VALUES ('text_normal'), ('low_text_confidence'), ('vector_diagram'), ('raster_image')) v(flag) LEFT JOIN (SELECT f1 AS f FROM fl UNION ALL SELECT f2 FROM fl UNION ALL SELECT f3 FROM fl) ON f = flag GROUP BY flag",
    "cascade_tasks": base(ELEMENTS, PAGES, FLAGS, TASKS) + "SELECT document_id, task_type, page_number, CAST(element_id AS BIGINT) AS element_id FROM tk",
    "cascade_task_counts": base(ELEMENTS, PAGES, FLAGS, TASKS) + "SELECT v.t AS task_type, count(tk.task_type) AS n FROM (VALUES ('table_reparse'), ('visual_description'), ('full_page_ocr')) v(t) LEFT JOIN tk ON tk.task_type = v.t GROUP BY v.t",
    "cascade_region_reasons": base(ELEMENTS, PAGES, FLAGS, TASKS) + "SELECT reason, count(*) AS n FROM tk WHERE task_type = 'visual_description' GROUP BY reason",
    "canonical_override": base(ELEMENTS) + "SELECT document_id, element_id, CASE WHEN element_type = 'table' AND seq % 3 <> 0 THEN 'reparsed ' || CAST(seq AS VARCHAR) ELSE text END AS text, CASE element_type WHEN 'figure' THEN 'paddle_vlm' WHEN 'table' THEN 'docling+paddle_table' ELSE 'docling' END AS extraction_method, description AS visual_description FROM el",
    "heading_paths": base(ELEMENTS, PATHS) + "SELECT document_id, element_id, array_to_string(path, '>') AS path FROM st",
    "icon_parents": base(ELEMENTS, PATHS) + "SELECT document_id, element_id, CAST(coalesce(parent_id, -1) AS BIGINT) AS parent_id FROM st WHERE element_type = 'icon'",
    "caption_retag": base(ELEMENTS) + "SELECT e.document_id, e.element_id, CASE WHEN o.owner IS NULL THEN element_type ELSE 'figure_caption' END AS element_type, CAST(coalesce(o.owner, -1) AS BIGINT) AS parent_id FROM el e LEFT JOIN (SELECT document_id, element_id + CASE WHEN element_type = 'figure' THEN 1 ELSE 2 END AS cap, arg_max(element_id, seq) AS owner FROM el WHERE element_type IN ('figure', 'table') GROUP BY ALL) o ON o.document_id = e.document_id AND o.cap = e.element_id",
    "element_confidence": base(ELEMENTS, PAGES) + "SELECT document_id, element_id, coalesce(CASE WHEN element_type = 'table' THEN table_score WHEN element_type IN ('figure', 'icon') THEN layout_score ELSE parse_score END, mean_score) AS confidence FROM el LEFT JOIN pg USING (document_id, page_number)",
    "label_types": base() + f"SELECT label, CASE WHEN label IN ('title', 'section_header') THEN 'heading' WHEN label = 'list_item' THEN 'list' WHEN label = 'table' THEN 'table' WHEN label IN ('picture', 'chart') THEN 'figure' WHEN label = 'caption' THEN 'figure_caption' ELSE 'paragraph' END AS element_type, count(*) AS n FROM (SELECT ({LIST((*LABELS, 'checkbox', 'marker'))})[pos % {len(LABELS) + 2} + 1] AS label FROM lines) GROUP BY ALL",
    "icon_sized": base(ELEMENTS, PAGES) + "SELECT document_id, element_id, coalesce(w * h / nullif(width * height, 0) < 0.02 AND w < 80 AND h < 80, false) AS is_icon FROM (SELECT *, (seq * 7) % 120 AS w, (seq * 11) % 120 AS h FROM el WHERE element_type = 'figure') LEFT JOIN pg USING (document_id, page_number)",
    "element_labels": base(ELEMENTS) + "SELECT document_id, element_id, CASE WHEN coalesce(text, '') = '' THEN '[' || element_type || ']' WHEN length(t) > 80 THEN regexp_replace(substr(t, 1, 80), '\\s+$', '') || '...' ELSE t END AS label FROM (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM el)",
    "kg_keywords": base(ELEMENTS, PATHS, ENTITIES) + "SELECT document_id, element_id, name, entity_type, CAST(confidence AS DOUBLE) AS confidence, method AS extraction_method FROM en WHERE method LIKE 'dict_keyword%'",
    "kg_identifiers": base(ELEMENTS, PATHS, ENTITIES) + "SELECT document_id, element_id, name, entity_type, CAST(confidence AS DOUBLE) AS confidence, method AS extraction_method FROM en WHERE entity_type IN ('Sensor', 'Connector', 'Terminal') AND method LIKE 'regex%'",
    "kg_error_codes": base(ELEMENTS, PATHS, ENTITIES) + "SELECT document_id, element_id, name, CAST(confidence AS DOUBLE) AS confidence, method AS extraction_method, anchored FROM en WHERE entity_type = 'ErrorCode'",
    "kg_spans": base(ELEMENTS) + f"SELECT document_id, element_id, name, CAST(start AS BIGINT) AS start, CAST(start + length(name) AS BIGINT) AS stop FROM (SELECT document_id, element_id, m[i] AS name, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT document_id, element_id, regexp_extract_all(text, {CONN}) AS m, string_split_regex(text, {CONN}) AS parts, unnest(generate_series(1, len(regexp_extract_all(text, {CONN})))) AS i FROM el WHERE text IS NOT NULL))",
    "kg_relations": base(ELEMENTS, SIDES) + "SELECT document_id, element_id, subject, 'CONNECTED_TO' AS predicate, object, CAST(0.5 AS DOUBLE) AS confidence FROM re",
    "kg_agreement": base(ELEMENTS, PATHS, ENTITIES, AGREE) + "SELECT document_id, page_number AS page, entity_type, method AS extraction_method, count(*) AS n, CAST(sum(other) AS BIGINT) AS corroborations, count(*) FILTER (WHERE other > 0) AS corroborated FROM ag GROUP BY ALL",
    "kg_entity_rollup": base(ELEMENTS, PATHS, ENTITIES) + "SELECT document_id, name, entity_type, count(*) AS occurrences, string_agg(DISTINCT CAST(page_number AS VARCHAR), ',' ORDER BY CAST(page_number AS VARCHAR)) AS pages, count(DISTINCT element_id) AS n_elements, CAST(max(confidence) AS DOUBLE) AS confidence, '' AS content_text FROM en GROUP BY ALL",
    "kg_reextract_summary": base(ELEMENTS, PATHS, ENTITIES, SIDES) + "SELECT document_id, count(*) AS n_elements, count(*) FILTER (WHERE n > 0 OR r > 0) AS n_with_candidates, CAST(sum(n) AS BIGINT) AS n_entities, CAST(sum(r) AS BIGINT) AS n_relations FROM (SELECT e.document_id, coalesce(a.n, 0) AS n, coalesce(b.r, 0) AS r FROM el e LEFT JOIN (SELECT element_id, count(*) AS n FROM en GROUP BY 1) a USING (element_id) LEFT JOIN (SELECT element_id, count(*) AS r FROM re GROUP BY 1) b USING (element_id)) GROUP BY 1",
    "kg_write_back": base(ELEMENTS, PATHS, ENTITIES, SIDES) + "SELECT e.document_id, e.element_id, coalesce(a.n, 0) AS n_entities, coalesce(b.r, 0) AS n_relations FROM el e LEFT JOIN (SELECT element_id, count(*) AS n FROM en GROUP BY 1) a USING (element_id) LEFT JOIN (SELECT element_id, count(*) AS r FROM re GROUP BY 1) b USING (element_id)",
    "table_markdown_rows": base(ELEMENTS) + "SELECT document_id, element_id, CAST(r AS BIGINT) AS row_no, trim(h[c]) AS \"column\", trim(v[c]) AS value FROM (SELECT *, unnest(generate_series(1, least(len(h), len(v)))) AS c FROM (SELECT document_id, element_id, r, string_split(trim(t[1], '|'), '|') AS h, string_split(trim(t[r + 3], '|'), '|') AS v FROM (SELECT document_id, element_id, t, unnest(generate_series(0, len(t) - 3)) AS r FROM (SELECT document_id, element_id, string_split(text, chr(10)) AS t FROM el WHERE element_type = 'table'))))",
    "table_html_rows": "SELECT doc_id, CAST(0 AS BIGINT) AS row_no, c AS \"column\", 'T' || CAST(doc_id AS VARCHAR) AS value FROM documents, (VALUES ('col_0'), ('col_1')) v(c) UNION ALL SELECT doc_id, 1, 'col_0', source FROM documents UNION ALL SELECT doc_id, 1, 'col_1', lang || ' & ' || CAST(n_chars AS VARCHAR) FROM documents",
    "chunk_assignment": base(ELEMENTS, PATHS, FOLD) + "SELECT document_id, CAST(chunk AS BIGINT) AS chunk_no, chunk_type, element_id FROM fo",
    "chunk_procedure_steps": base(ELEMENTS, PATHS, FOLD) + "SELECT f.document_id, CAST(f.chunk AS BIGINT) AS chunk_no, row_number() OVER (PARTITION BY f.document_id, f.chunk ORDER BY n.seq) AS step_number, f.element_id, coalesce(n.text, '') AS step_text FROM fo f JOIN nx n USING (element_id) WHERE n.element_type = 'list'",
    "graph_nodes": base(ELEMENTS, PATHS) + """SELECT * FROM (
 SELECT 'document:' || CAST(document_id AS VARCHAR) AS node_id, 'Document' AS node_type, 'Manual ' || CAST(document_id AS VARCHAR) AS label, document_id, CAST(-1 AS BIGINT) AS page_number FROM el GROUP BY document_id
 UNION ALL SELECT 'page:' || CAST(document_id AS VARCHAR) || ':' || CAST(p AS VARCHAR), 'Page', 'Page ' || CAST(p AS VARCHAR), document_id, p FROM (SELECT document_id, unnest(generate_series(1, max(page_number))) AS p FROM el GROUP BY document_id)
 UNION ALL SELECT DISTINCT 'section:' || CAST(document_id AS VARCHAR) || ':' || CAST(to_json(path[1:i]) AS VARCHAR), 'Section', path[i], document_id, -1 FROM (SELECT document_id, path, unnest(generate_series(1, len(path))) AS i FROM st)
 UNION ALL SELECT 'element:' || CAST(element_id AS VARCHAR), 'Element', CASE WHEN coalesce(text, '') = '' THEN '[' || element_type || ']' WHEN length(t) > 80 THEN regexp_replace(substr(t, 1, 80), '\\s+$', '') || '...' ELSE t END, document_id, page_number FROM (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM el))""",
    "graph_edges": base(ELEMENTS, PATHS) + """SELECT 'HAS_PAGE' AS relation, 'document:' || CAST(document_id AS VARCHAR) AS from_node_id, 'page:' || CAST(document_id AS VARCHAR) || ':' || CAST(p AS VARCHAR) AS to_node_id FROM (SELECT document_id, unnest(generate_series(1, max(page_number))) AS p FROM el GROUP BY document_id)
 UNION ALL SELECT DISTINCT CASE WHEN i = 1 THEN 'HAS_SECTION' ELSE 'HAS_SUBSECTION' END, CASE WHEN i = 1 THEN 'document:' || CAST(document_id AS VARCHAR) ELSE 'section:' || CAST(document_id AS VARCHAR) || ':' || CAST(to_json(path[1:i - 1]) AS VARCHAR) END, 'section:' || CAST(document_id AS VARCHAR) || ':' || CAST(to_json(path[1:i]) AS VARCHAR) FROM (SELECT document_id, path, unnest(generate_series(1, len(path))) AS i FROM st)
 UNION ALL SELECT 'CONTAINS_ELEMENT', CASE WHEN len(path) > 0 THEN 'section:' || CAST(document_id AS VARCHAR) || ':' || CAST(to_json(path) AS VARCHAR) ELSE 'page:' || CAST(document_id AS VARCHAR) || ':' || CAST(page_number AS VARCHAR) END, 'element:' || CAST(element_id AS VARCHAR) FROM st
 UNION ALL SELECT 'HAS_CHILD', 'element:' || CAST(parent_id AS VARCHAR), 'element:' || CAST(element_id AS VARCHAR) FROM st WHERE parent_id IS NOT NULL""",
    "doc_dedupe": "SELECT doc_id AS id, coalesce(o, n) AS document_id, o IS NULL AND n = doc_id AS created FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS n FROM documents WHERE doc_id % 10 <> 0) LEFT JOIN (SELECT text, min(doc_id) AS o FROM documents WHERE doc_id % 10 = 0 GROUP BY text) USING (text)",
    "page_change_plan": base(PAGES, PAGE_TEXT, HASHES, PLAN) + "SELECT document_id, page_number, action FROM pl",
    "store_summary": base(ELEMENTS, PAGES, PAGE_TEXT, HASHES, PLAN) + """SELECT document_id, pages_stored, pages_skipped, coalesce(e, 0) AS elements_stored, coalesce(c, 0) AS crops_stored FROM (SELECT document_id, count(*) FILTER (WHERE action IN ('insert', 'replace')) AS pages_stored, count(*) FILTER (WHERE action = 'skip') AS pages_skipped FROM pl GROUP BY 1)
 LEFT JOIN (SELECT el.document_id, count(*) AS e, count(*) FILTER (WHERE element_type IN ('figure', 'icon') AND seq % 4 <> 2) AS c FROM el JOIN pl USING (document_id, page_number) WHERE action IN ('insert', 'replace') GROUP BY 1) USING (document_id)""",
    "page_hashes": base(PAGES, PAGE_TEXT, HASHES) + "SELECT * FROM ph",
    "element_ids": base(ELEMENTS, PATHS) + ", ids AS (SELECT element_id, row_number() OVER (ORDER BY document_id, seq) AS id FROM el) SELECT s.document_id, s.element_id, i.id, coalesce(p.id, -1) AS parent_id FROM st s JOIN ids i USING (element_id) LEFT JOIN ids p ON p.element_id = s.parent_id",
    "orphan_labels": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)",
    "object_keys": base(PAGES) + "SELECT document_id, page_number, 'manuals' AS bucket, 'documents/' || CAST(document_id AS VARCHAR) || '/pages/' || CAST(page_number AS VARCHAR) || '/page.png' AS key FROM pg",
    "vector_topk": f"SELECT vec_id AS id, {COS} AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10",
    "vector_topk_filtered": f"SELECT vec_id AS id, label, {COS} AS score FROM embeddings WHERE label = 3 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10",
    "vector_stats": "SELECT count(*) AS vector_count, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM embeddings",
    "vector_upsert": "SELECT id, label FROM (SELECT vec_id AS id, CAST(label + CASE WHEN vec_id % 5 = 0 THEN 100 ELSE 0 END AS BIGINT) AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 7 = 0) WHERE id % 11 <> 4 AND id NOT IN (1, 2, 3)",
    "users_search": "SELECT c_custkey AS id, c_name AS username, coalesce(r_name, '') AS role FROM customer LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 2) ON r_regionkey = c_nationkey % 3 WHERE c_custkey % 2 = 0 AND c_name ILIKE '%7_%'",
    "role_scopes": "SELECT r_name AS role, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS codes FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 5) ON n_regionkey = r_regionkey GROUP BY r_name",
    "scopes_missing": "SELECT n_name AS code FROM nation WHERE NOT (n_regionkey = 1 AND n_nationkey % 6 <> 5)",
    "unknown_codes": "SELECT DISTINCT 'NO ' || n_name AS code FROM nation WHERE n_nationkey % 4 = 0 AND 'NO ' || n_name NOT IN (SELECT n_name FROM nation)",
    "authz_missing": f"SELECT id, array_to_string(list_filter(req, lambda r: NOT list_contains(held, r)), ',') AS missing, CASE WHEN id % 3 = 0 THEN list_has_all(held, req) ELSE list_has_any(held, req) END AS visible FROM (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN {LIST(rbac.SCOPES)} ELSE {LIST(rbac.USER_SCOPES)} END AS held, CASE WHEN c_custkey % 2 = 0 THEN ['admin:rbac:write', 'chat:read', 'documents:write'] ELSE ['chat:read'] END AS req FROM customer)",
    "login_rate_limit": """WITH RECURSIVE a AS (SELECT user_id AS key, event_id AS seq, ts, event_type IN ('error', 'click') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT key, k, seq, CASE WHEN failed THEN 1 ELSE 0 END AS n, CASE WHEN failed THEN ts END AS opened, false AS blocked, CAST(NULL AS BIGINT) AS retry FROM a WHERE k = 1 UNION ALL
  SELECT key, k, seq, CASE WHEN b THEN n0 WHEN failed THEN n0 + 1 ELSE 0 END, CASE WHEN b THEN o0 WHEN failed THEN coalesce(o0, ts) END, b, CASE WHEN b THEN (epoch_us(o0) + 129600000000 - epoch_us(ts) + 500000) // 1000000 END FROM (
   SELECT *, n0 >= 3 AS b FROM (SELECT a.*, CASE WHEN r.opened IS NOT NULL AND a.ts >= r.opened + INTERVAL 36 HOUR THEN 0 ELSE r.n END AS n0, CASE WHEN r.opened IS NOT NULL AND a.ts >= r.opened + INTERVAL 36 HOUR THEN NULL ELSE r.opened END AS o0 FROM r JOIN a ON a.key = r.key AND a.k = r.k + 1)))
 SELECT key, seq, CAST(n AS BIGINT) AS failures, blocked, coalesce(retry, -1) AS retry_after FROM r""",
    "job_status": """WITH e AS (SELECT *, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
 SELECT user_id AS document_id, event_type AS stage, CAST(run AS BIGINT) AS run, CASE arg_max(event_id, (ts, event_id)) % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'failed' END AS status,
  coalesce((epoch_us(max(ts) FILTER (WHERE event_id % 3 <> 0)) - epoch_us(min(ts) FILTER (WHERE event_id % 3 = 0))) // 1000, -1) AS duration_ms, CASE WHEN arg_max(event_id, (ts, event_id)) % 3 = 2 THEN 'E' || CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) ELSE '' END AS error_message FROM e GROUP BY user_id, event_type, run""",
    "document_status": """SELECT document_id, CASE WHEN bool_or(s = 2) THEN 'failed' WHEN bool_or(s = 0) THEN 'processing' ELSE 'ready' END AS status FROM (SELECT user_id AS document_id, event_type, arg_max(event_id, (ts, event_id)) % 3 AS s FROM events GROUP BY ALL) GROUP BY document_id""",
    "token_rotation": """WITH RECURSIVE t AS (SELECT conv_id AS family, turn AS seq, 't' || CAST(CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn END AS VARCHAR) AS token, 't' || CAST(turn + 1 AS VARCHAR) AS new_token, turn % 5 = 4 AS expired, conv_id % 7 = 3 AND turn % 3 = 2 AS inactive, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 r AS (SELECT family, k, seq, token, CASE WHEN expired THEN 'expired' WHEN inactive THEN 'inactive' ELSE 'rotated' END AS outcome, false AS dead, CASE WHEN expired OR inactive THEN token ELSE new_token END AS live, CASE WHEN expired OR inactive THEN [] ELSE [token] END AS spent, CASE WHEN NOT (expired OR inactive) THEN new_token END AS replaced FROM t WHERE k = 1
  UNION ALL SELECT t.family, t.k, t.seq, t.token, o, r.dead OR o = 'reuse', CASE WHEN o = 'rotated' THEN t.new_token ELSE r.live END, CASE WHEN o = 'rotated' THEN list_append(r.spent, t.token) ELSE r.spent END, CASE WHEN o = 'rotated' THEN t.new_token END
  FROM (SELECT r.*, t.family AS f2, CASE WHEN list_contains(r.spent, t.token) OR r.dead AND t.token = r.live THEN 'reuse' WHEN t.token <> r.live THEN 'unknown' WHEN t.expired THEN 'expired' WHEN t.inactive THEN 'inactive' ELSE 'rotated' END AS o FROM r JOIN t ON t.family = r.family AND t.k = r.k + 1) r JOIN t ON t.family = r.family AND t.k = r.k + 1)
 SELECT family, seq, token, outcome, dead AS family_revoked, coalesce(replaced, '') AS replaced_by FROM r""",
    "sample_pages": base(PAGES, FLAGS, PAGE_TEXT) + f""", sp AS (SELECT fl.*, 4 * drawings AS d4, text || CASE WHEN page_number % 6 = 0 THEN ' abnormal' WHEN page_number % 6 = 1 THEN ' Symptom and remedy' ELSE '' END AS tx FROM fl JOIN pt USING (document_id, page_number)),
 s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY document_id, page_number) AS c FROM (SELECT document_id, page_number, {SAMPLE_CLASS.format(trouble=STRICT)} AS category, row_number() OVER (PARTITION BY category, document_id ORDER BY page_number) AS i FROM sp) WHERE category IS NOT NULL AND i <= 3) WHERE c <= 10),
 s2 AS (SELECT document_id, page_number, {SAMPLE_CLASS.format(trouble=TROUBLE)} AS category FROM sp WHERE (document_id, page_number) NOT IN (SELECT (document_id, page_number) FROM s1)),
 s3 AS (SELECT *, row_number() OVER (PARTITION BY category, document_id ORDER BY page_number) + (SELECT count(*) FROM s1 WHERE s1.category = s2.category AND s1.document_id = s2.document_id) AS i FROM s2 WHERE category IS NOT NULL),
 s4 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY document_id, page_number) + (SELECT count(*) FROM s1 WHERE s1.category = s3.category) AS c FROM s3 WHERE i <= 3)
 SELECT category, document_id, page_number, 'strict' AS "pass" FROM s1 UNION ALL SELECT category, document_id, page_number, 'relaxed' FROM s4 WHERE c <= 10""",
    "visual_audit": base(ELEMENTS, PATHS) + "SELECT element_type, count(description) AS described, count(*) FILTER (WHERE element_type = 'icon' AND parent_id IS NULL) AS orphan_icons, round(avg(confidence), 6) AS mean_confidence, min(confidence) AS min_confidence FROM st GROUP BY element_type",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

ORACLES["kg_entity_rollup"] = base(ELEMENTS, PATHS, ENTITIES) + """SELECT document_id, name, entity_type, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS pages, count(DISTINCT element_id) AS n_elements, CAST(max(confidence) AS DOUBLE) AS confidence,
 name || ' (' || entity_type || ') — referenced on page(s) ' || array_to_string(list_sort(list(DISTINCT page_number)), ', ') || '.' AS content_text FROM en GROUP BY document_id, name, entity_type"""
ORACLES["chunk_entities"] = base(ELEMENTS, PATHS, ENTITIES) + """SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY name, entity_type) - 1 AS chunk_no, name || ' (' || entity_type || ') — referenced on page(s) ' || array_to_string(list_sort(list(DISTINCT page_number)), ', ') || '.' AS content_text, min(page_number) AS page_start, max(page_number) AS page_end FROM en GROUP BY document_id, name, entity_type"""

ORACLES["ingest_summary"] = base(ELEMENTS, PATHS, PAGES, FLAGS, TASKS, ENTITIES) + """SELECT e.document_id, n_elements, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_entities, 0) AS n_entities FROM (SELECT document_id, count(*) AS n_elements FROM el GROUP BY 1) e
 LEFT JOIN (SELECT document_id, count(*) AS n_tasks FROM tk GROUP BY 1) t USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n_entities FROM en GROUP BY 1) n USING (document_id)"""

BLANK = "E' \\t\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f'"
#: A chunk's text: alone in it, a table or figure keeps its own; others are joined by lines, blanks going at every step.
CHUNKS = f"""ch AS (SELECT f.document_id, f.chunk, f.chunk_type, any_value(n.path) AS path, arg_min(n.page_number, f.k) AS page_start, arg_max(n.page_number, f.k) AS page_end,
  CASE WHEN f.chunk_type IN ('table', 'figure') THEN any_value(coalesce(nullif(n.text, ''), CASE WHEN f.chunk_type = 'figure' THEN n.description END, ''))
   ELSE coalesce(ltrim(string_agg(rtrim(n.text, {BLANK}), chr(10) ORDER BY f.k) FILTER (WHERE rtrim(n.text, {BLANK}) <> ''), {BLANK}), '') END AS body,
  string_agg(CAST(f.element_id AS VARCHAR), ',' ORDER BY f.k) AS ids FROM fo f JOIN nx n USING (element_id) GROUP BY f.document_id, f.chunk, f.chunk_type)"""
ORACLES["chunk_summary"] = base(ELEMENTS, PATHS, FOLD, CHUNKS) + """SELECT document_id, CAST(chunk AS BIGINT) AS chunk_no, chunk_type, array_to_string(path, '>') AS path, page_start, page_end, length(body) AS n_chars,
 sha256(concat(chunk_type, '|', array_to_string(path, '>'), '|', body, '|', ids)) AS content_hash FROM ch"""
ORACLES["chunk_content"] = base(ELEMENTS, PATHS, FOLD) + """SELECT f.document_id, CAST(f.chunk AS BIGINT) AS chunk_no, 'table' AS kind, CAST(2 AS BIGINT) AS n, 'open' AS last FROM fo f WHERE chunk_type = 'table'
 UNION ALL SELECT f.document_id, f.chunk, 'figure', 1, n.description FROM fo f JOIN nx n USING (element_id) WHERE chunk_type = 'figure'
 UNION ALL SELECT f.document_id, f.chunk, 'procedure', count(*), arg_max(coalesce(n.text, ''), n.seq) FROM fo f JOIN nx n USING (element_id) WHERE n.element_type = 'list' GROUP BY f.document_id, f.chunk"""
ORACLES["ingest_summary"] = base(ELEMENTS, PATHS, FOLD, PAGES, FLAGS, TASKS, ENTITIES) + """SELECT e.document_id, n_elements, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_entities, 0) AS n_entities, coalesce(n_chunks, 0) + coalesce(n_names, 0) AS n_chunks FROM (SELECT document_id, count(*) AS n_elements FROM el GROUP BY 1) e
 LEFT JOIN (SELECT document_id, count(*) AS n_tasks FROM tk GROUP BY 1) t USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n_entities, count(DISTINCT (name, entity_type)) AS n_names FROM en GROUP BY 1) n USING (document_id)
 LEFT JOIN (SELECT document_id, count(DISTINCT chunk) AS n_chunks FROM fo GROUP BY 1) c USING (document_id)"""
ORACLES |= {
    "crop_rectangles": base(ELEMENTS, PAGES) + "SELECT document_id, element_id, seq % 4 <> 2 AS cropped, coalesce(10 * 200 / 72.0::DOUBLE * (seq % 4 <> 2)::INT, 0) AS x0, coalesce((height - 100) * (200 / 72.0::DOUBLE) * (seq % 4 <> 2)::INT, 0) AS y0 FROM el JOIN pg USING (document_id, page_number) WHERE element_type IN ('figure', 'icon')",
    "first_boxes": base(ELEMENTS) + "SELECT document_id, element_id, CASE WHEN seq % 4 <> 2 THEN 50.0 * (seq % 7) ELSE -1 END AS area, CASE WHEN seq % 4 <> 2 THEN page_number ELSE 1 END AS page FROM el",
    "cascade_reasons": base(ELEMENTS, PAGES) + """SELECT document_id, page_number, element_id, reason FROM (
 SELECT document_id, page_number, element_id, 'table_score ' || coalesce(printf('%.4f', confidence), 'None') || ' < 0.9000' AS reason FROM el WHERE element_type = 'table' AND (confidence IS NULL OR confidence < 0.9)
 UNION ALL SELECT document_id, page_number, -1, 'parse_score ' || coalesce(printf('%.4f', parse_score), 'None') || ' < 0.6000' FROM pg WHERE parse_score IS NULL OR parse_score < 0.6)""",
    "dense_scores": base(PAGES) + "SELECT document_id, page_number, coalesce(s, -1) AS score FROM (SELECT document_id, unnest(generate_series(1, max(page_number) + 1)) AS page_number FROM pg GROUP BY document_id) LEFT JOIN (SELECT document_id, page_number, CASE WHEN page_number % 5 <> 0 THEN parse_score END AS s FROM pg) USING (document_id, page_number)",
    "text_layers": base(PAGES, PAGE_TEXT) + "SELECT document_id, page_number, length(trim(text, E' \\t\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f')) > 0 AS present FROM pt",
    "nav_groups": "SELECT DISTINCT c_custkey AS id, g AS \"group\" FROM customer, (VALUES ('Admin', 1), ('Roles', 1), ('Work', 2)) v(g, k) WHERE CASE WHEN c_nationkey % 3 = 0 THEN true ELSE k = 2 END",
    "element_hashes": base(ELEMENTS) + "SELECT document_id, count(*) AS n, count(DISTINCT (element_type, text, page_number)) AS n_distinct FROM el GROUP BY document_id",
    "csv_lists": "SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(lang || ' ,, ' || source || ',', ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS parts FROM documents",
    "revoked_tokens": "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 0 OR event_type = 'error') AS revoked FROM events GROUP BY user_id",
    "refresh_validity": """SELECT event_id AS id, CASE WHEN event_id % 5 = 4 THEN 'unknown' WHEN event_type = 'error' THEN 'revoked' WHEN ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) THEN 'expired' WHEN user_id % 3 = 0 THEN 'inactive' ELSE 'valid' END AS status FROM events""",
    "missing_ids": "SELECT n AS id, n NOT IN (SELECT c_custkey FROM customer) AS missing, coalesce((SELECT c_name FROM customer WHERE c_custkey = n), '') AS username FROM (SELECT unnest(generate_series(1, (SELECT max(c_custkey) + 50 FROM customer), 7)) AS n)",
    "insert_if_absent": "SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0",
    "replaced_grants": "SELECT n_regionkey AS role_id, n_nationkey AS scope_id FROM nation WHERE n_nationkey % 6 <> 5 AND n_regionkey <> 1 UNION ALL SELECT 1, n_nationkey FROM nation WHERE n_nationkey IN (2, 3)",
    "chunk_union": base(ELEMENTS, PATHS, FOLD, ENTITIES) + "SELECT document_id, chunk_type, count(*) AS n FROM (SELECT DISTINCT document_id, chunk, chunk_type FROM fo) GROUP BY ALL UNION ALL SELECT document_id, 'entity', count(DISTINCT (name, entity_type)) FROM en GROUP BY document_id",
    "section_order": base(ELEMENTS, PATHS) + """SELECT document_id, array_to_string(p, '>') AS path, row_number() OVER (PARTITION BY document_id ORDER BY seq, len(p)) AS place FROM (SELECT document_id, path[1:i] AS p, min(seq) AS seq FROM (SELECT document_id, path, seq, unnest(generate_series(1, len(path))) AS i FROM st) GROUP BY ALL)""",
    "stored_reextraction": base(ELEMENTS, PATHS, ENTITIES, SIDES) + "SELECT document_id, count(*) AS n_elements, count(*) FILTER (WHERE n > 0 OR r > 0) AS n_with_candidates, CAST(sum(n) AS BIGINT) AS n_entities, CAST(sum(r) AS BIGINT) AS n_relations FROM (SELECT e.document_id, coalesce(a.n, 0) AS n, coalesce(b.r, 0) AS r FROM el e LEFT JOIN (SELECT element_id, count(*) AS n FROM en GROUP BY 1) a USING (element_id) LEFT JOIN (SELECT element_id, count(*) AS r FROM re GROUP BY 1) b USING (element_id)) GROUP BY 1",
    "embedding_lifecycle": "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'embedded' WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'embedded' END AS embedding_status, CASE WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 0 THEN '' ELSE 'old' END AS vector_id, CASE WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN CAST(length(coalesce(text, '')) AS DOUBLE) WHEN doc_id % 3 = 0 THEN -1 ELSE 0 END AS first FROM documents",
    "response_defaults": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS description, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_components, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN source WHEN 2 THEN 'x' ELSE '' END AS markdown FROM documents",
    "idf_weights": "SELECT w AS word, round(ln(((SELECT count(*) FROM documents) - n + 0.5) / (n + 0.5) + 1), 6) AS idf FROM (SELECT source AS w, count(*) AS n FROM documents GROUP BY 1)",
}

STORED = """cs AS (SELECT document_id, page_number, CASE WHEN page_number % 7 <> 2 AND (page_number % 4 = 1 OR page_number % 3 = 0) THEN 2 ELSE 1 END AS stored_run,
  CASE WHEN page_number % 7 = 2 AND page_number % 3 = 0 THEN 'x' || page_hash ELSE page_hash END AS page_hash FROM ph WHERE page_number % 7 <> 2 OR page_number % 4 <> 1)"""
#: The live points of the collection after all its writes.
POINTS = """lp AS (SELECT * FROM (
  SELECT vec_id AS id, vec_id % 11 AS document_id, CASE WHEN vec_id % 14 = 3 THEN 'third' WHEN vec_id % 5 = 0 THEN 'second' ELSE CAST(label AS VARCHAR) END AS content_hash,
   CAST(CASE WHEN vec_id % 14 <> 3 AND vec_id % 5 = 0 THEN list_reverse(embedding) ELSE embedding END AS DOUBLE[]) AS dense FROM embeddings WHERE vec_id % 14 = 3 OR vec_id % 7 <> 3 AND vec_id % 11 <> 4
  UNION ALL SELECT vec_id + 1000000, vec_id % 11, CAST(label AS VARCHAR), CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 9 = 1) WHERE id NOT IN (1, 2, 12, 1000001))"""
LENGTHS = """cl AS (SELECT length(body) AS n FROM ch UNION ALL SELECT length(name || ' (' || entity_type || ') — referenced on page(s) ' || string_agg(DISTINCT CAST(page_number AS VARCHAR), ', ' ORDER BY CAST(page_number AS VARCHAR)) || '.') FROM en GROUP BY document_id, name, entity_type)"""


def measured(name: str, table: str, measure: str | None) -> str:
    m = f"CAST({measure} AS DOUBLE)" if measure else "CAST(NULL AS DOUBLE)"
    return f"SELECT '{name}' AS table_name, count(*) AS n, min({m}) AS least, round(avg({m}), 6) AS mean, max({m}) AS most FROM {table}"


ORACLES |= {
    "canonical_pages": base(ELEMENTS, PAGES, PAGE_TEXT, HASHES, STORED) + "SELECT document_id, page_number, CAST(stored_run AS BIGINT) AS stored_run, page_hash, count(element_id) AS n_elements FROM cs LEFT JOIN el USING (document_id, page_number) GROUP BY ALL",
    "canonical_elements": base(ELEMENTS, PAGES, PAGE_TEXT, HASHES, STORED) + "SELECT document_id, page_number, CAST(stored_run AS BIGINT) AS stored_run, element_id AS id, element_type, md5(CASE stored_run WHEN 1 THEN 'old ' ELSE '' END || text) AS text_md5 FROM cs JOIN el USING (document_id, page_number)",
    "vector_collection_points": f"WITH {POINTS} SELECT id, document_id, content_hash, round(dense[1], 6) AS first FROM lp",
    "vector_collection_topk": f"WITH {POINTS} SELECT id, round(list_cosine_similarity(dense, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM lp WHERE document_id = 3 ORDER BY score DESC, id LIMIT 20",
    "vector_collection_stats": f"WITH {POINTS} SELECT count(*) AS vector_count, CAST(max(len(dense)) AS BIGINT) AS dimension FROM lp",
    "embedding_states": "SELECT id, document_id, CASE WHEN e THEN CAST(id AS VARCHAR) ELSE '' END AS vector_id, CASE WHEN e THEN 'embedded' ELSE 'pending' END AS embedding_status FROM (SELECT doc_id AS id, doc_id % 4 AS document_id, doc_id % 4 = 1 OR doc_id % 4 = 2 AND doc_id % 3 <> 0 AS e FROM documents)",
    "embedding_counts": "SELECT CAST(c AS BIGINT) AS call, count(doc_id) AS n FROM (VALUES (0), (1), (2), (3)) v(c) LEFT JOIN documents ON CASE c WHEN 0 THEN doc_id % 4 = 1 WHEN 1 THEN doc_id % 4 = 2 WHEN 2 THEN doc_id % 4 = 1 AND doc_id % 3 = 0 ELSE false END GROUP BY c",
    "vector_payloads": "SELECT doc_id AS id, doc_id AS chunk_id, CAST(2 AS BIGINT) AS document_id, 'text' AS chunk_type, 'M' AS model_family, md5(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 4 = 2",
    "login_rate_limit_live": ORACLES["login_rate_limit"],
    "token_rotation_live": ORACLES["token_rotation"],
    "ingested_documents": "SELECT DISTINCT sha256(text) AS source_hash, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
    "ledger_results": base(ELEMENTS, PAGES, FLAGS, TASKS) + "SELECT tk.document_id, task_type, tk.page_number, CAST(tk.element_id AS BIGINT) AS element_id, CASE task_type WHEN 'visual_description' THEN 'figure of ' || coalesce(nullif(text, ''), 'nothing') WHEN 'table_reparse' THEN 'table ' || CAST(length(text) AS VARCHAR) ELSE '' END AS result FROM tk LEFT JOIN el ON el.document_id = tk.document_id AND el.element_id = tk.element_id",
    "object_contents": "SELECT doc_id, doc_id % 5 <> 2 AS found, CASE WHEN doc_id % 5 <> 2 THEN CAST(strlen(coalesce(text, '')) AS BIGINT) ELSE -1 END AS length, CASE WHEN doc_id % 5 <> 2 THEN sha256(coalesce(text, '')) ELSE '' END AS sha256 FROM documents",
    "ingest_metrics": base(ELEMENTS, PATHS, FOLD, PAGES, FLAGS, TASKS, ENTITIES, CHUNKS, LENGTHS) + " UNION ALL ".join((measured("pages", "pg", "parse_score"), measured("tasks", "tk", None), measured("elements", "el", "confidence"), measured("entities", "en", "confidence"), measured("chunks", "cl", "n"))),
    "first_tasks": base(ELEMENTS, PAGES, FLAGS, TASKS) + "SELECT document_id, task_type, page_number, CAST(element_id AS BIGINT) AS element_id FROM tk ORDER BY document_id, CASE task_type WHEN 'table_reparse' THEN 1 WHEN 'visual_description' THEN 2 ELSE 3 END, page_number, element_id LIMIT 40",
    "role_responses": "SELECT r_regionkey AS id, r_name AS name, r_name || ' role' AS description FROM region",
    "user_responses": """SELECT c_custkey AS id, c_name AS username, c_nationkey % 3 AS role_id, coalesce(r_name, '') AS role_name, c_custkey % 2 = 0 AS is_active, strftime(DATE '2024-01-01' + CAST(c_custkey AS INTEGER), '%Y-%m-%d') AS created_at,
 CASE WHEN c_custkey % 3 = 0 THEN strftime(DATE '2024-01-01' + CAST(c_custkey AS INTEGER), '%Y-%m-%d') ELSE '' END AS last_login_at FROM customer LEFT JOIN region ON r_regionkey = c_nationkey % 3 AND r_regionkey < 2""",
    "login_preconditions": "SELECT c_custkey AS attempt, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey END AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'allowed' ELSE 'inactive' END AS status FROM customer",
    "strict_zips": "SELECT doc_id, count(*) AS n, CAST(sum(length(w) * k) AS BIGINT) AS weighed, CAST(0 AS BIGINT) AS apart FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents WHERE text IS NOT NULL) GROUP BY doc_id",
    "job_listing": "SELECT event_id AS id, user_id AS document_id, event_type AS stage, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS started_at, CASE WHEN event_id % 2 = 0 THEN strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S.%f') ELSE '' END AS finished_at FROM events WHERE user_id = 7",
    "stored_chunks": base(ELEMENTS, PATHS, FOLD) + "SELECT DISTINCT document_id, CAST(chunk AS BIGINT) AS chunk_no, chunk_type, 'pending' AS embedding_status, '' AS vector_id FROM fo WHERE document_id % 3 <> 1 OR chunk < 2",
    "seeded_grants": "WITH t AS (SELECT CASE n_nationkey WHEN 1 THEN 'chat:read' WHEN 3 THEN 'chat:write' WHEN 5 THEN 'documents:read' ELSE n_name END AS code FROM nation WHERE n_nationkey < 6) SELECT code, true AS was_there FROM t UNION ALL SELECT code, false FROM (SELECT unnest(" + LIST(rbac.SCOPES) + ") AS code) WHERE code NOT IN (SELECT code FROM t)",
    "guarded_counts": "SELECT CAST(r AS BIGINT) AS role_id, CASE WHEN count(c_custkey) > 0 THEN CAST(count(c_custkey) AS VARCHAR) || ' users have the role' ELSE '' END AS said FROM (VALUES (0), (1), (2), (3)) v(r) LEFT JOIN customer ON c_nationkey % 3 = r GROUP BY r",
    "upload_plans": """WITH f AS (SELECT doc_id, sha256(text) AS h, (len(string_split(text, chr(10))) - 1) // 5 + 1 AS pages FROM documents WHERE text IS NOT NULL), k AS (SELECT h, min(doc_id) AS known FROM f WHERE doc_id % 10 = 0 GROUP BY h),
 n AS (SELECT h, (SELECT max(doc_id) FROM f WHERE doc_id % 10 = 0) + row_number() OVER (ORDER BY h) AS made FROM (SELECT DISTINCT h FROM f WHERE h NOT IN (SELECT h FROM k)))
 SELECT CAST(doc_id AS VARCHAR) || '.pdf' AS filename, CAST(pages AS BIGINT) AS page_count, coalesce(known, made) AS document_id, known IS NULL AS created FROM f LEFT JOIN k USING (h) LEFT JOIN n USING (h)""",
    "element_hash_paths": base(ELEMENTS, PATHS) + "SELECT document_id, count(DISTINCT (element_type, text, path, page_number)) AS n_distinct FROM st GROUP BY document_id",
}

#: BM25 in whole numbers: postings (sc) of documents, terms of benchmark items (qt).
BM25 = """WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents),
 av AS (SELECT avg(len(ts)) AS avgdl, count(*) AS n_docs FROM t),
 tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sc AS (SELECT id, term, CAST(floor(1000000.0::DOUBLE * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS BIGINT) AS s FROM tf JOIN df USING (term), av),
 qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
 lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, CAST(sum(s) AS BIGINT) AS score FROM qt JOIN sc USING (term) GROUP BY ALL) WHERE score > 0)"""
SECTIONS = """se AS (SELECT document_id, p AS path, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_chars FROM (SELECT document_id, length(body) AS n, path, unnest(list_transform(generate_series(1, len(path)), lambda i: path[1:i])) AS p FROM ch WHERE len(path) > 0) GROUP BY ALL)"""
ORACLES |= {
    "bm25_topk": BM25 + " SELECT query_id, id, score, rank FROM lx WHERE rank <= 10",
    "bm25_short_topk": BM25 + " SELECT term, id, score, rank FROM (SELECT term, id, s AS score, row_number() OVER (PARTITION BY term ORDER BY s DESC, id) AS rank FROM sc WHERE s > 0 AND term IN (SELECT term FROM qt)) WHERE rank <= 10",
    "hybrid_topk": BM25 + """,
 e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT item_id AS query_id, e.id, round(list_cosine_similarity(e.v, q.v), 9) AS score FROM benchmark JOIN e q ON q.id = item_id, e)),
 fu AS (SELECT query_id, id, CAST(sum(1000000000000 // (60 + rank)) AS BIGINT) AS score FROM (SELECT query_id, id, rank FROM lx WHERE rank <= 30 UNION ALL SELECT query_id, id, rank FROM dn WHERE rank <= 30) GROUP BY ALL)
 SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= 10""",
    "container_sections": base(ELEMENTS, PATHS, FOLD, CHUNKS, SECTIONS) + "SELECT document_id, array_to_string(path, '>') AS path, array_to_string(path[1:len(path) - 1], '>') AS parent, len(path) AS level, n_chunks, n_chars, n_chars <= 1500 AS fits FROM se",
    "container_assignment": base(ELEMENTS, PATHS, FOLD, CHUNKS, SECTIONS) + """SELECT c.document_id, CAST(c.chunk AS BIGINT) AS chunk_no, coalesce(array_to_string(arg_min(s.path, len(s.path)), '>'), '') AS container
 FROM ch c LEFT JOIN se s ON s.document_id = c.document_id AND s.n_chars <= 1500 AND c.path[1:len(s.path)] = s.path GROUP BY ALL""",
    "stale_elements": base(ELEMENTS, PATHS, ENTITIES) + "SELECT e.document_id, e.element_id, e.element_id % 10 = 3 OR regexp_matches(coalesce(e.text, '') || ' | ' || coalesce(e.description, ''), '(?i)\\bmuffler\\b') AS extracted, coalesce(n, 0) AS n_entities, true AS stamped FROM el e LEFT JOIN (SELECT element_id, count(*) AS n FROM en GROUP BY 1) USING (element_id)",
}
