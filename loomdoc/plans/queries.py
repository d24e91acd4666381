"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import canonical, cascade, chunking, collection, containers, graph, hybrid, kg, ledger, probe, rbac, sampling, sessions, store, structure, tables, vectors
from ..sources import files, manual, runs
from ..sources.objects import Objects
from ..streaming import ingest
from ..streaming import sessions as live
from . import lifecycle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(path: str) -> Column:
    return F.array_join(path, ">")


def structured(spark: SparkSession, d: str) -> DataFrame:
    """Manual elements with heading paths and icon parents."""
    return structure.icon_parents(structure.heading_paths(manual.elements(spark, d)))


def visual(e: DataFrame) -> DataFrame:
    """Elements in the shape that kg.extract takes."""
    none = F.array().cast("array<string>")
    return e.select(
        "document_id", "element_id", "page_number", "element_type", "text", "description", "section_path",
        F.when(F.col("component").isNotNull(), F.array("component")).otherwise(none).alias("components"), F.when(F.col("connection").isNotNull(), F.array("connection")).otherwise(none).alias("connections"),
    )


def extracted(spark: SparkSession, d: str) -> DataFrame:
    return kg.extract(visual(structure.heading_paths(manual.elements(spark, d))))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """document_id, title, page_count."""
    return manual.elements(spark, d).groupBy("document_id").agg(F.max("page_number").alias("page_count")).withColumn("title", F.concat(F.lit("Manual "), F.col("document_id").cast("string")))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    per = manual.lines(spark, d).withColumn("page_number", F.expr("pos div 5 + 1")).groupBy("document_id", "page_number")
    return per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def boxed(spark: SparkSession, d: str) -> DataFrame:
    """Manual elements with the first box of their provenance; some have none."""
    box = F.expr("named_struct('l', 10.0D, 't', 100.0D, 'r', CAST(10 + seq % 7 AS double), 'b', 50.0D, 'page_no', page_number)")
    none = F.array().cast("array<struct<l:double,t:double,r:double,b:double,page_no:bigint>>")
    e = manual.elements(spark, d).withColumn("prov", F.when(F.col("seq") % 4 != 2, F.array(box, box)).otherwise(none))
    return e.withColumn("first", structure.first_box(F.col("prov"))).withColumn("bbox", F.col("first.bbox"))


# probes and the cascade


@query
def probe_flags(spark: SparkSession, d: str) -> DataFrame:
    return probe.probe(manual.pages(spark, d)).select("document_id", "page_number", F.array_join("flags", ",").alias("flags"))


@query
def probe_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return probe.flag_counts(probe.probe(manual.pages(spark, d)))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return cascade.plan(manual.elements(spark, d), probe.probe(manual.pages(spark, d)))


@query
def cascade_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).select("document_id", "task_type", "page_number", F.coalesce("element_id", F.lit(-1)).cast("bigint").alias("element_id"))


@query
def cascade_task_counts(spark: SparkSession, d: str) -> DataFrame:
    return cascade.task_counts(tasks(spark, d))


@query
def cascade_region_reasons(spark: SparkSession, d: str) -> DataFrame:
    return cascade.of_type(tasks(spark, d), "visual_description").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def canonical_override(spark: SparkSession, d: str) -> DataFrame:
    e = manual.elements(spark, d)
    again = e.where("element_type = 'table'").select("document_id", "element_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("task_order"), F.expr("CASE WHEN seq % 3 = 0 THEN '' ELSE 'reparsed ' || CAST(seq AS string) END").alias("m"))
    t = again.select("document_id", "element_id", "task_order", F.when(F.col("task_order") == 1, F.lit("old")).otherwise(F.col("m")).alias("table_markdown"), F.lit(None).cast("string").alias("visual_text"))
    v = e.where("element_type = 'figure'").select("document_id", "element_id", F.lit(1).alias("task_order"), F.lit(None).cast("string").alias("table_markdown"), F.col("description").alias("visual_text"))
    return cascade.override(e.select("document_id", "element_id", "text"), t.unionByName(v))


# structure


@query
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return structure.heading_paths(manual.elements(spark, d)).select("document_id", "element_id", joined("section_path").alias("path"))


@query
def icon_parents(spark: SparkSession, d: str) -> DataFrame:
    return structure.icon_parents(manual.elements(spark, d)).where("element_type = 'icon'").select("document_id", "element_id", F.coalesce("parent_id", F.lit(-1)).cast("bigint").alias("parent_id"))


@query
def caption_retag(spark: SparkSession, d: str) -> DataFrame:
    e = manual.elements(spark, d).select("document_id", "element_id", "seq", "element_type")
    owns = e.where("element_type in ('figure', 'table')")
    c = owns.select("document_id", F.col("element_id").alias("owner_id"), F.col("seq").alias("owner_seq"), F.expr("element_id + CASE WHEN element_type = 'figure' THEN 1 ELSE 2 END").alias("caption_id"))
    return structure.retag_captions(e, c).select("document_id", "element_id", "element_type", F.coalesce("parent_id", F.lit(-1)).cast("bigint").alias("parent_id"))


@query
def element_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = manual.elements(spark, d).join(manual.pages(spark, d), ["document_id", "page_number"], "left")
    return e.select("document_id", "element_id", structure.confidence(F.col("element_type"), F.col("table_score"), F.col("layout_score"), F.col("parse_score"), F.col("mean_score")).alias("confidence"))


@query
def label_types(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (*structure.LABELS, "checkbox", "marker")])
    label = F.element_at(names, (F.col("pos") % (len(structure.LABELS) + 2) + 1).cast("int"))
    return manual.lines(spark, d).withColumn("label", label).groupBy("label", structure.element_type(F.col("label")).alias("element_type")).agg(F.count(F.lit(1)).alias("n"))


@query
def icon_sized(spark: SparkSession, d: str) -> DataFrame:
    e = manual.elements(spark, d).where("element_type = 'figure'").join(manual.pages(spark, d), ["document_id", "page_number"], "left")
    e = e.selectExpr("document_id", "element_id", "CAST((seq * 7) % 120 AS double) AS w", "CAST((seq * 11) % 120 AS double) AS h", "width", "height")
    return e.select("document_id", "element_id", structure.is_icon(F.col("w"), F.col("h"), F.col("width"), F.col("height")).alias("is_icon"))


@query
def element_labels(spark: SparkSession, d: str) -> DataFrame:
    return manual.elements(spark, d).select("document_id", "element_id", tx.element_label(F.col("text"), F.col("element_type")).alias("label"))


# knowledge graph candidates


def entities(spark: SparkSession, d: str) -> DataFrame:
    return kg.exploded(extracted(spark, d))


@query
def kg_keywords(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("extraction_method like 'dict_keyword%'").select("document_id", "element_id", "name", "entity_type", "confidence", "extraction_method")


@query
def kg_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("entity_type in ('Sensor', 'Connector', 'Terminal') and extraction_method like 'regex%'").select("document_id", "element_id", "name", "entity_type", "confidence", "extraction_method")


@query
def kg_error_codes(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where("entity_type = 'ErrorCode'").select("document_id", "element_id", "name", "confidence", "extraction_method", F.col("context_anchor_matched").alias("anchored"))


@query
def kg_spans(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).where("extraction_method = 'regex_connector_id'")
    return e.select("document_id", "element_id", "name", F.get("justification_span", F.lit(0)).cast("bigint").alias("start"), F.get("justification_span", F.lit(1)).cast("bigint").alias("stop"))


@query
def kg_relations(spark: SparkSession, d: str) -> DataFrame:
    return extracted(spark, d).select("document_id", F.explode("relations").alias("r")).select("document_id", "r.element_id", "r.subject", "r.predicate", "r.object", "r.confidence")


@query
def kg_agreement(spark: SparkSession, d: str) -> DataFrame:
    a = kg.agree(entities(spark, d))
    return a.groupBy("document_id", "page", "entity_type", "extraction_method").agg(F.count(F.lit(1)).alias("n"), F.sum("corroboration_count").alias("corroborations"), F.count_if("cross_source_corroborated").alias("corroborated"))


@query
def kg_entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = kg.rollup(entities(spark, d))
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    return r.select("document_id", "name", "entity_type", "occurrences", pages.alias("pages"), F.size("element_ids").cast("bigint").alias("n_elements"), "confidence", "content_text")


@query
def kg_reextract_summary(spark: SparkSession, d: str) -> DataFrame:
    return kg.reextract_summary(extracted(spark, d), manual.elements(spark, d))


@query
def kg_write_back(spark: SparkSession, d: str) -> DataFrame:
    x = extracted(spark, d)
    rows = kg.regroup(manual.elements(spark, d).select("document_id", "element_id"), kg.agree(kg.exploded(x)), x)
    zero = F.lit(0)
    return rows.select("document_id", "element_id", F.coalesce(F.size("kg_candidate_entities"), zero).cast("bigint").alias("n_entities"), F.coalesce(F.size("kg_candidate_relations"), zero).cast("bigint").alias("n_relations"))


# graph, tables, chunks


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = graph.nodes(documents(spark, d), structured(spark, d))
    return n.select("node_id", "node_type", "label", "document_id", F.coalesce("page_number", F.lit(-1)).cast("bigint").alias("page_number"))


@query
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(documents(spark, d), structured(spark, d))


@query
def table_markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    t = manual.elements(spark, d).where("element_type = 'table'").withColumn("rows", tables.markdown_rows(F.col("text")))
    r = t.select("document_id", "element_id", F.posexplode("rows").alias("row_no", "row"))
    return r.select("document_id", "element_id", F.col("row_no").cast("bigint").alias("row_no"), F.explode("row").alias("column", "value"))


@query
def table_html_rows(spark: SparkSession, d: str) -> DataFrame:
    html = F.expr("'<div>t</div><table><tr><td colspan=\"2\">T' || CAST(doc_id AS string) || '</td></tr><tr><th>' || source || '</th><td>' || lang || ' &amp; ' || CAST(n_chars AS string) || '</td></tr></table>'")
    t = tables.table_rows(manual.read(spark, d, "documents").select("doc_id", html.alias("text")))
    return t.select("doc_id", F.posexplode("rows").alias("row_no", "row")).select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), F.explode("row").alias("column", "value"))


@query
def chunk_assignment(spark: SparkSession, d: str) -> DataFrame:
    return chunking.build(structured(spark, d)).select("document_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk_type", F.explode("element_ids").alias("element_id"))


@query
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.hashed(chunking.build(structured(spark, d)))
    return c.select("document_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk_type", joined("section_path").alias("path"), "page_start", "page_end", F.length("content_text").cast("bigint").alias("n_chars"), "content_hash")


@query
def chunk_procedure_steps(spark: SparkSession, d: str) -> DataFrame:
    e = structured(spark, d)
    return chunking.steps(chunking.build(e), e).select("document_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("step_number").cast("bigint").alias("step_number"), "element_id", "step_text")


@query
def chunk_entities(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.entity_chunks(kg.rollup(entities(spark, d)))
    return c.select("document_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "content_text", "page_start", "page_end")


# storage


@query
def doc_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = manual.read(spark, d, "documents").select(F.col("doc_id").alias("id"), store.content_hash(F.encode("text", "UTF-8")).alias("source_hash"))
    return store.dedupe(rows.where("id % 10 <> 0"), rows.where("id % 10 = 0")).select("id", "document_id", "created")


def change_plan(spark: SparkSession, d: str) -> DataFrame:
    fresh = page_texts(spark, d).join(manual.pages(spark, d), ["document_id", "page_number"])
    fresh = fresh.withColumn("page_hash", tx.page_hash(F.col("text"), F.col("drawings"), F.col("images")))
    stored = fresh.where("page_number % 4 <> 1").withColumn("page_hash", F.when(F.col("page_number") % 3 == 0, F.concat(F.lit("x"), "page_hash")).otherwise(F.col("page_hash")))
    return store.change_plan(stored, fresh.where("page_number % 7 <> 2"))


@query
def page_change_plan(spark: SparkSession, d: str) -> DataFrame:
    return change_plan(spark, d)


@query
def store_summary(spark: SparkSession, d: str) -> DataFrame:
    return store.store_summary(change_plan(spark, d), boxed(spark, d))


@query
def page_hashes(spark: SparkSession, d: str) -> DataFrame:
    p = page_texts(spark, d).join(manual.pages(spark, d), ["document_id", "page_number"])
    return p.select("document_id", "page_number", tx.page_hash(F.col("text"), F.col("drawings"), F.col("images")).alias("page_hash"))


@query
def element_ids(spark: SparkSession, d: str) -> DataFrame:
    e = structure.number(structure.icon_parents(manual.elements(spark, d)))
    up = e.select("document_id", F.col("element_id").alias("parent_id"), F.col("local_id").alias("parent_local_id"))
    drafts = e.join(up, ["document_id", "parent_id"], "left").select("document_id", "element_id", "local_id", "parent_local_id")
    out = store.assign_ids(drafts)
    return out.select("document_id", "element_id", F.col("id").cast("bigint").alias("id"), F.coalesce("parent_id", F.lit(-1)).cast("bigint").alias("parent_id"))


@query
def orphan_labels(spark: SparkSession, d: str) -> DataFrame:
    some = manual.read(spark, d, "documents").where("doc_id % 3 <> 0")
    return store.orphans(manual.read(spark, d, "labels"), "doc_id", some, "doc_id").select("doc_id")


@query
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    p = manual.pages(spark, d)
    key = tx.page_object_key(F.col("document_id"), F.col("page_number"), "page.png")
    uri = tx.parse_uri(F.concat(F.lit("s3://manuals/"), key))
    return p.select("document_id", "page_number", uri["bucket"].alias("bucket"), uri["key"].alias("key"))


# vectors


def points(spark: SparkSession, d: str) -> DataFrame:
    return manual.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")


def target(spark: SparkSession, d: str) -> list[float]:
    return list(points(spark, d).where("id = 0").first().dense)


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.query(points(spark, d), target(spark, d), 10).select("id", F.round("score", 6).alias("score"))


@query
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vectors.query(points(spark, d), target(spark, d), 10, {"label": 3}).select("id", "label", F.round("score", 6).alias("score"))


@query
def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return vectors.stats(points(spark, d))


@query
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    new = p.where("id % 5 = 0").withColumn("label", F.col("label") + 100).unionByName(p.where("id % 7 = 0").select((F.col("id") + 1_000_000).alias("id"), "dense", "label"))
    kept = vectors.delete_by_document(vectors.upsert(p, new).withColumn("document_id", F.col("id") % 11), 4)
    return vectors.delete(kept, [1, 2, 3]).select("id", F.col("label").cast("bigint").alias("label"))


# roles and sessions


def users(spark: SparkSession, d: str) -> DataFrame:
    return manual.read(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS username", "c_nationkey % 3 AS role_id", "c_custkey % 2 = 0 AS is_active")


def grants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions as roles, nations as scopes."""
    n = manual.read(spark, d, "nation")
    return manual.read(spark, d, "region").selectExpr("r_regionkey AS id", "r_name AS name"), n.selectExpr("n_nationkey AS id", "n_name AS code"), n.where("n_nationkey % 6 <> 5").selectExpr("n_regionkey AS role_id", "n_nationkey AS scope_id")


@query
def users_search(spark: SparkSession, d: str) -> DataFrame:
    roles = grants(spark, d)[0].where("id < 2")
    return rbac.list_users(users(spark, d), roles, search="7_", is_active=True).select("id", "username", "role")


@query
def role_scopes(spark: SparkSession, d: str) -> DataFrame:
    roles, scopes, rs = grants(spark, d)
    return rbac.role_codes(roles, rs, scopes).select("role", F.array_join("codes", ",").alias("codes"))


@query
def scopes_missing(spark: SparkSession, d: str) -> DataFrame:
    _, scopes, rs = grants(spark, d)
    return rbac.ungranted(scopes, rs, 1).select("code")


@query
def unknown_codes(spark: SparkSession, d: str) -> DataFrame:
    _, scopes, _ = grants(spark, d)
    wanted = manual.read(spark, d, "nation").selectExpr("CASE WHEN n_nationkey % 4 = 0 THEN 'NO ' || n_name ELSE n_name END AS code")
    return rbac.unknown_codes(wanted, scopes)


@query
def authz_missing(spark: SparkSession, d: str) -> DataFrame:
    array = lambda names: F.array(*[F.lit(n) for n in names])
    held = F.when(F.col("role_id") == 0, array(rbac.SCOPES)).otherwise(array(rbac.USER_SCOPES))
    required = F.when(F.col("id") % 2 == 0, array(("admin:rbac:write", "chat:read", "documents:write"))).otherwise(array(("chat:read",)))
    return users(spark, d).select("id", F.array_join(rbac.missing(required, held), ",").alias("missing"), rbac.visible(required, held, F.when(F.col("id") % 3 == 0, "all").otherwise("any")).alias("visible"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return manual.read(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click").alias("failed"))


@query
def login_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return sessions.login_limits(attempts(spark, d), limit=3, window=36 * 3600).select("key", "seq", "failures", "blocked", F.coalesce("retry_after", F.lit(-1)).cast("bigint").alias("retry_after"))


@query
def token_rotation(spark: SparkSession, d: str) -> DataFrame:
    c = manual.read(spark, d, "conversations")
    e = c.selectExpr("conv_id AS family", "turn AS seq", "'t' || CAST(CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn END AS string) AS token", "'t' || CAST(turn + 1 AS string) AS new_token", "turn % 5 = 4 AS expired", "conv_id % 7 = 3 AND turn % 3 = 2 AS inactive")
    return sessions.rotate_tokens(e).fillna("", ["replaced_by"])


def job_log(spark: SparkSession, d: str) -> DataFrame:
    e = manual.read(spark, d, "events")
    return e.selectExpr("user_id AS document_id", "event_type AS stage", "CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'failed' END AS status", "ts", "event_id AS seq", "'E' || CAST(event_id AS string) AS error_message")


@query
def job_status(spark: SparkSession, d: str) -> DataFrame:
    j = sessions.job_states(job_log(spark, d))
    return j.select("document_id", "stage", "run", "status", F.coalesce("duration_ms", F.lit(-1)).cast("bigint").alias("duration_ms"), F.coalesce("error_message", F.lit("")).alias("error_message"))


@query
def document_status(spark: SparkSession, d: str) -> DataFrame:
    return sessions.document_states(sessions.job_states(job_log(spark, d)))


# sampling, audits, extensions


@query
def sample_pages(spark: SparkSession, d: str) -> DataFrame:
    p = probe.probe(manual.pages(spark, d)).join(page_texts(spark, d), ["document_id", "page_number"])
    p = p.select("document_id", "page_number", F.concat("text", F.expr("CASE WHEN page_number % 6 = 0 THEN ' abnormal' WHEN page_number % 6 = 1 THEN ' Symptom and remedy' ELSE '' END")).alias("text"), "flags", (4 * F.col("drawings")).alias("drawings"), (F.col("page_number") % 2 == 0).alias("has_table"))
    return sampling.sample(p, min_page=3).select("category", "document_id", "page_number", "pass")


@query
def visual_audit(spark: SparkSession, d: str) -> DataFrame:
    e = structure.icon_parents(manual.elements(spark, d))
    return e.groupBy("element_type").agg(F.count_if(F.col("description").isNotNull()).alias("described"), F.count_if((F.col("element_type") == "icon") & F.col("parent_id").isNull()).alias("orphan_icons"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("confidence").alias("min_confidence"))


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ingest.windowed_counts(manual.read(spark, d, "events"), "1 day")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def ingested(spark: SparkSession, d: str) -> lifecycle.Ingested:
    e = manual.elements(spark, d)
    none = F.array().cast("array<string>")
    drafts = e.withColumn("components", F.when(F.col("component").isNotNull(), F.array("component")).otherwise(none)).withColumn("connections", F.when(F.col("connection").isNotNull(), F.array("connection")).otherwise(none))
    return lifecycle.ingest(drafts, manual.pages(spark, d))


@query
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.summary(ingested(spark, d))


# what the queries above do not reach


@query
def crop_rectangles(spark: SparkSession, d: str) -> DataFrame:
    e = boxed(spark, d).where("element_type in ('figure', 'icon')").join(manual.pages(spark, d), ["document_id", "page_number"])
    c = cascade.crop_rectangle(F.col("bbox"), F.col("height"))
    zero = F.lit(0.0)
    return e.select("document_id", "element_id", store.crop_eligible(F.col("element_type"), F.col("bbox")).alias("cropped"), F.coalesce(c["x0"], zero).alias("x0"), F.coalesce(c["y0"], zero).alias("y0"))


@query
def first_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxed(spark, d).select("document_id", "element_id", F.coalesce(structure.box_size(F.col("bbox"))["area"], F.lit(-1.0)).alias("area"), F.col("first.page_number").alias("page"))


@query
def cascade_reasons(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).where("task_type <> 'visual_description'").select("document_id", "page_number", F.coalesce("element_id", F.lit(-1)).cast("bigint").alias("element_id"), "reason")


@query
def dense_scores(spark: SparkSession, d: str) -> DataFrame:
    p = manual.pages(spark, d)
    n = p.groupBy("document_id").agg((F.max("page_number") + 1).alias("page_count"))
    score = F.when(F.col("page_number") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("parse_score"))
    rows = structure.dense_pages(n, p.select("document_id", "page_number", structure.clean_score(score).alias("score")))
    return rows.select("document_id", "page_number", F.coalesce("score", F.lit(-1.0)).alias("score"))


@query
def text_layers(spark: SparkSession, d: str) -> DataFrame:
    return page_texts(spark, d).select("document_id", "page_number", probe.text_layer_present(F.col("text")).alias("present"))


#: A menu: two groups in one another for administrators, one for all.
MENU = [
    {"isGroup": True, "label": "Admin", "children": [{"isGroup": True, "label": "Roles", "children": [{"route": "/roles", "label": "Roles", "requiredScopes": ["admin:rbac:read", "admin:rbac:write"], "match": "all"}]}]},
    {"isGroup": True, "label": "Work", "children": [{"route": "/chat", "label": "Chat", "requiredScopes": ["chat:read"]}, {"label": "no route"}]},
    {"route": "/home", "label": "Home"},
]


@query
def nav_groups(spark: SparkSession, d: str) -> DataFrame:
    leaves = spark.createDataFrame(rbac.flatten_routes(MENU), "route string, label string, required_scopes array<string>, match string, group_path array<string>")
    array = lambda names: F.array(*[F.lit(n) for n in names])
    u = users(spark, d).select("id", F.when(F.col("role_id") == 0, array(rbac.SCOPES)).otherwise(array(rbac.USER_SCOPES)).alias("held"))
    # a menu has a few leaves
    shown = u.crossJoin(F.broadcast(leaves)).where(rbac.visible(F.col("required_scopes"), F.col("held"), F.col("match")))
    return shown.select("id", F.explode("group_path").alias("group")).distinct()


@query
def element_hashes(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    h = tx.element_hash(F.col("element_type"), F.col("text"), none, F.col("page_number"), F.lit("docling"))
    return manual.elements(spark, d).select("document_id", h.alias("h")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("n_distinct"))


@query
def csv_lists(spark: SparkSession, d: str) -> DataFrame:
    return manual.read(spark, d, "documents").select("doc_id", F.coalesce(F.array_join(tx.csv_list(F.expr("lang || ' ,, ' || source || ','")), "|"), F.lit("")).alias("parts"))


@query
def revoked_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = manual.read(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("revoked_at"))
    out = sessions.revoke(t, F.col("event_type") == "error", F.lit("2030-01-01").cast("timestamp"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("revoked_at").alias("revoked"))


@query
def refresh_validity(spark: SparkSession, d: str) -> DataFrame:
    e = manual.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    least, most = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    now = F.timestamp_micros(F.lit(least + (most - least) // 2))
    raw = F.col("event_id").cast("string")
    stored = e.where("event_id % 5 <> 4").select(F.sha2(raw, 256).alias("token_hash"), F.col("user_id").cast("bigint").alias("user_id"), F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), F.col("ts").alias("expires_at"))
    people = e.select(F.col("user_id").alias("id")).distinct().withColumn("is_active", F.col("id") % 3 != 0)
    return sessions.refresh_status(e.select(raw.alias("raw")), stored, people, now).select(F.col("raw").cast("bigint").alias("id"), "status")


@query
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d).select("id", "username")
    top = u.agg((F.max("id") + 50).alias("top")).select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("top"), F.lit(7).cast("bigint"))).alias("id"))
    return store.look_up(top, u).select("id", "missing", F.coalesce("username", F.lit("")).alias("username"))


@query
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    u = users(spark, d).select("id", "username")
    return store.insert_missing(u.where("id % 2 = 0"), u.where("id % 3 = 0").withColumn("username", F.concat(F.lit("new "), "username")), ["id"])


@query
def replaced_grants(spark: SparkSession, d: str) -> DataFrame:
    _, scopes, rs = grants(spark, d)
    return rbac.replace_grants(rs, 1, scopes.where("id in (2, 3)").select("code"), scopes)


@query
def chunk_union(spark: SparkSession, d: str) -> DataFrame:
    both = chunking.all_chunks(chunking.build(structured(spark, d)), chunking.entity_chunks(kg.rollup(entities(spark, d))))
    return both.groupBy("document_id", "chunk_type").agg(F.count(F.lit(1)).alias("n"))


@query
def chunk_content(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.with_content(chunking.build(structured(spark, d))).where("content_structured is not null")
    s = F.col("content_structured")
    n = F.when(F.col("chunk_type") == "table", F.size(s["rows"])).when(F.col("chunk_type") == "figure", 1).otherwise(F.size(s["steps"]))
    last = F.when(F.col("chunk_type") == "table", F.element_at(F.map_values(F.element_at(s["rows"], -1)), -1)).when(F.col("chunk_type") == "figure", s["description"]).otherwise(F.element_at(s["steps"], -1)["step_text"])
    return c.select("document_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("chunk_type").alias("kind"), n.cast("bigint").alias("n"), last.alias("last"))


@query
def section_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.section_order(structure.heading_paths(manual.elements(spark, d))).select("document_id", joined("path").alias("path"), F.col("place").cast("bigint").alias("place"))


@query
def stored_reextraction(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from the engine's own store of elements and pages, as a second extraction reads them."""
    e = structure.heading_paths(manual.elements(spark, d))
    none = F.array().cast("array<string>")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(none)
    seen = F.when(F.coalesce("component", "connection", "description").isNotNull(), F.struct(one("component").alias("components"), one("connection").alias("connections"), "description"))
    page_id = F.col("document_id") * 100_000 + F.col("page_number")
    stored = e.select(F.col("element_id").alias("id"), "document_id", page_id.alias("page_id"), "element_type", "text", F.lit(None).cast("bigint").alias("parent_id"), "section_path", F.lit("").alias("extraction_method"), F.col("confidence").alias("extraction_confidence"), seen.alias("visual_description"))
    pages = e.select(page_id.alias("id"), "page_number").distinct()
    drafts = store.stored_drafts(stored, pages)
    return kg.reextract_summary(kg.extract(drafts), drafts)


def length_model() -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a dense model: a text's length."""
    return lambda texts: [[float(len(t))] for t in texts]


@query
def embedding_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """One document's pending chunks embedded and upserted; the others stay as they are."""
    docs = manual.read(spark, d, "documents").withColumn("document_id", F.col("doc_id") % 4)
    status = F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("embedded")
    chunks = docs.select(F.col("doc_id").alias("id"), "document_id", F.coalesce("text", F.lit("")).alias("content_text"), status.alias("embedding_status"), F.when(F.col("doc_id") % 3 != 0, "old").alias("vector_id"))
    held = chunks.where("embedding_status = 'embedded'").select("id", "document_id", F.array(F.lit(0.0).cast("float")).alias("dense"))
    held = held.withColumn("sparse", F.lit(None).cast("struct<indices:array<int>,values:array<float>>"))
    marked, points = vectors.embed_and_upsert(chunks, held, length_model, 1)
    return marked.join(points.select("id", "dense"), "id", "left").select("id", "embedding_status", F.coalesce("vector_id", F.lit("")).alias("vector_id"), F.coalesce(F.get("dense", F.lit(0)).cast("double"), F.lit(-1.0)).alias("first"))


@query
def response_defaults(spark: SparkSession, d: str) -> DataFrame:
    docs = manual.read(spark, d, "documents")
    none = F.lit(None)
    body = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("description"), F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).alias("components")))
    k = F.col("doc_id") % 4
    texts = F.to_json(F.struct(F.struct(F.when(k == 0, F.col("lang")).when(k == 1, F.lit("")).alias("markdown_texts"), F.when(k == 1, F.col("source")).alias("text")).alias("markdown")))
    plain = F.to_json(F.struct(F.when(k == 2, F.lit("x")).otherwise(F.lit("")).alias("markdown"), F.lit("never").alias("text")))
    r = cascade.parse_response(body)
    return docs.select("doc_id", r["description"].alias("description"), F.size(r["components"]).cast("bigint").alias("n_components"), cascade.markdown_text(F.when(k < 2, texts).otherwise(plain)).alias("markdown"), none.alias("_")).drop("_")


@query
def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = manual.read(spark, d, "documents")
    sparse = vectors.sparse_terms(docs.select(F.col("source").alias("content_text")))
    words = docs.select(F.col("source").alias("word")).distinct().withColumn("content_text", F.col("word"))
    code = vectors.sparse_terms(words).select("word", F.explode("sparse.indices").alias("index"))
    return code.join(vectors.idf(sparse), "index").groupBy("word").agg(F.round(F.max("idf"), 6).alias("idf"))


# what is stored and changed


def hashed_pages(spark: SparkSession, d: str) -> DataFrame:
    p = page_texts(spark, d).join(manual.pages(spark, d), ["document_id", "page_number"])
    return p.select("document_id", "page_number", tx.page_hash(F.col("text"), F.col("drawings"), F.col("images")).alias("page_hash"), probe.text_layer_present(F.col("text")).alias("text_layer_present"))


def canonical_store(spark: SparkSession, d: str) -> canonical.CanonicalStore:
    """A store after two runs: of three pages in four, a third of them older; then of six pages in seven."""
    fresh = hashed_pages(spark, d)
    e = boxed(spark, d).select("document_id", "page_number", F.col("element_id").alias("id"), "element_type", "text", "bbox", "confidence")
    old = fresh.where("page_number % 4 <> 1").withColumn("page_hash", F.when(F.col("page_number") % 3 == 0, F.concat(F.lit("x"), "page_hash")).otherwise(F.col("page_hash")))
    out = canonical.CanonicalStore(spark, runs.workspace(spark, "canonical"), buckets=8)
    out.store(old, e.withColumn("text", F.concat(F.lit("old "), "text")))
    out.store(fresh.where("page_number % 7 <> 2"), e)
    return out


@query
def canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    """The stored pages after both runs: unchanged ones keep their run, pages that the second run does not name stay."""
    return canonical_store(spark, d).pages().select("document_id", "page_number", "stored_run", "page_hash", F.size("elements").cast("bigint").alias("n_elements"))


@query
def canonical_elements(spark: SparkSession, d: str) -> DataFrame:
    return canonical_store(spark, d).elements().select("document_id", "page_number", "stored_run", "id", "element_type", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def vector_collection(spark: SparkSession, d: str) -> collection.Collection:
    """A collection after upserts, both deletes, a compaction and upserts after it."""
    p = points(spark, d).select("id", (F.col("id") % 11).alias("document_id"), "dense", F.col("label").cast("string").alias("content_hash"))
    c = collection.Collection(spark, runs.workspace(spark, "collection"), 64)
    c.upsert_vectors(p)
    c.upsert_vectors(p.where("id % 5 = 0").withColumn("content_hash", F.lit("second")).withColumn("dense", F.reverse("dense")))
    c.delete(p.where("id % 7 = 3").select("id"))
    c.delete_by_document(4)
    c.compact()
    c.upsert_vectors(p.where("id % 14 = 3").withColumn("content_hash", F.lit("third")))
    c.upsert_vectors(p.where("id % 9 = 1").select((F.col("id") + 1_000_000).alias("id"), "document_id", "dense", "content_hash"))
    c.delete([1, 2, 12, 1_000_001])
    return c


@query
def vector_collection_points(spark: SparkSession, d: str) -> DataFrame:
    """The live points: of each id the last write, deleted ones gone."""
    return vector_collection(spark, d).points().select("id", "document_id", "content_hash", F.round(F.get("dense", F.lit(0)).cast("double"), 6).alias("first"))


@query
def vector_collection_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector_collection(spark, d).query(target(spark, d), 20, {"document_id": 3}).select("id", F.round("score", 6).alias("score"))


@query
def vector_collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return vector_collection(spark, d).get_collection_stats()


def letters_model() -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a dense model: how often a text holds each of eight letters, one more in the first."""
    return lambda texts: [[float(t.count(c) + (c == "a")) for c in "abcdefgh"] for t in texts]


def embedded(spark: SparkSession, d: str) -> tuple[DataFrame, collection.Collection, list[int]]:
    """Chunks whose documents 1 and 2 were embedded, then changed in part, and 1 embedded again; the counts of each call."""
    docs = manual.read(spark, d, "documents")
    first = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("document_id"), F.coalesce("text", F.lit("")).alias("content_text"), F.lit("text").alias("chunk_type"), F.lit("M").alias("model_family"))
    hashed = lambda c: c.withColumn("content_hash", F.md5(F.encode("content_text", "UTF-8")))
    out = collection.Collection(spark, runs.workspace(spark, "embedded"), 8)
    counts = [collection.embed_and_upsert(hashed(first), out, letters_model, 1), collection.embed_and_upsert(hashed(first), out, letters_model, 2)]
    now = hashed(first.withColumn("content_text", F.when(F.col("id") % 3 == 0, F.concat("content_text", F.lit(" a"))).otherwise(F.col("content_text"))))
    counts.append(collection.embed_and_upsert(now, out, letters_model, 1))
    counts.append(collection.embed_and_upsert(now, out, letters_model, 1))
    return now, out, counts


@query
def embedding_states(spark: SparkSession, d: str) -> DataFrame:
    """What of the chunks is embedded: a changed chunk is pending until it is embedded again."""
    chunks, held, _ = embedded(spark, d)
    return collection.states(chunks, held).select("id", "document_id", F.coalesce("vector_id", F.lit("")).alias("vector_id"), "embedding_status")


@query
def embedding_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks each call embedded: all of a document's, then the changed ones, then none."""
    return spark.createDataFrame(list(enumerate(embedded(spark, d)[2])), "call bigint, n bigint")


@query
def vector_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The payload that a point carries of its chunk."""
    _, held, _ = embedded(spark, d)
    p = F.col("payload")
    return held.points({"document_id": 2}).select("id", p["chunk_id"].alias("chunk_id"), p["document_id"].alias("document_id"), p["chunk_type"].alias("chunk_type"), p["model_family"].alias("model_family"), p["content_hash"].alias("content_hash"))


# streams


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files, one for a batch. A pattern, as the path may be one file."""
    return spark.readStream.schema(manual.read(spark, d, name).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def landed(rows: DataFrame) -> DataFrame:
    """What a stream gives for all that is there, written and read again."""
    spark, at = rows.sparkSession, runs.workspace(rows.sparkSession, "stream")
    with live.rocksdb(spark):
        rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


@query
def login_rate_limit_live(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream through keyed state: row by row what the fold over the whole log gives."""
    e = streamed(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click").alias("failed"))
    return landed(live.limited(e, limit=3, window=36 * 3600, late="60 days")).withColumn("retry_after", F.coalesce("retry_after", F.lit(-1)).cast("bigint"))


@query
def token_rotation_live(spark: SparkSession, d: str) -> DataFrame:
    c = streamed(spark, d, "conversations")
    e = c.selectExpr("conv_id AS family", "timestamp_seconds(1700000000 + turn) AS ts", "turn AS seq", "'t' || CAST(CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn END AS string) AS token", "'t' || CAST(turn + 1 AS string) AS new_token", "turn % 5 = 4 AS expired", "conv_id % 7 = 3 AND turn % 3 = 2 AS inactive")
    return landed(live.rotated(e)).fillna("", ["replaced_by"])


@query
def ingested_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream into a store, told apart by the hash of their text."""
    at = runs.workspace(spark, "ingest")
    ingest.ingest(streamed(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")), at).awaitTermination()
    return spark.read.parquet(at).select("source_hash", F.length("content").cast("bigint").alias("n_bytes"))


# paid calls, objects, metrics


class Reader:
    """A stand-in for the OCR client; what it has no answer for is an error until `answers` says otherwise."""

    def __init__(self, answers: bool = True):
        self.answers = answers

    def describe_figure(self, row: dict) -> str:
        return f"figure of {row['text'] or 'nothing'}"

    def reparse_table(self, row: dict) -> str:
        if not self.answers and "3" in row["key"][:2]:
            raise ValueError("no answer")
        return f"table {len(row['text'])}"

    def ocr_page(self, row: dict) -> str:
        return ""


@query
def ledger_results(spark: SparkSession, d: str) -> DataFrame:
    """Tasks answered over two runs, the first of which fails in part: each distinct question is asked once more at most."""
    t = tasks(spark, d).join(manual.elements(spark, d).select("document_id", "element_id", "text"), ["document_id", "element_id"], "left")
    t = t.select("document_id", "task_type", "page_number", "element_id", "text", ledger.key_of(F.col("task_type"), F.coalesce(F.col("text"), F.concat_ws("/", "document_id", "page_number"))).alias("key"))
    # two runs and the result read them: found once
    at, once = runs.workspace(spark, "ledger"), runs.workspace(spark, "ledger-tasks")
    runs.write(t, once)
    t = spark.read.schema(t.schema).parquet(once)
    try:
        ledger.run(t, lambda: Reader(False), at)
    except ledger.OpenCalls:
        pass
    out = ledger.run(t, Reader, at)
    return out.select("document_id", "task_type", "page_number", F.coalesce("element_id", F.lit(-1)).cast("bigint").alias("element_id"), "result")


@query
def object_contents(spark: SparkSession, d: str) -> DataFrame:
    """Documents put as objects, all but every fifth; then all of them asked for."""
    docs = manual.read(spark, d, "documents").select("doc_id", F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit("/source.txt")).alias("key"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    store_ = Objects(spark, runs.workspace(spark, "objects"))
    store_.put_all(docs.where("doc_id % 5 <> 2")).write.format("noop").mode("overwrite").save()
    got = store_.contents(docs.select("doc_id", F.concat(F.lit(f"{store_.root}/"), "key").alias("uri")))
    return got.select("doc_id", "found", F.coalesce("length", F.lit(-1)).alias("length"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"))


@query
def ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts, minima, means and maxima of the whole ingest, observed as it is written."""
    seen = lifecycle.write(ingested(spark, d), runs.workspace(spark, "ingested"))
    rows = [(k, v["n"], *(None if v[c] is None else float(v[c]) for c in ("least", "mean", "most"))) for k, v in seen.items()]
    return spark.createDataFrame(rows, "table_name string, n bigint, least double, mean double, most double").withColumn("mean", F.round("mean", 6))


# listings, projections, guards


@query
def first_tasks(spark: SparkSession, d: str) -> DataFrame:
    return cascade.first_tasks(tasks(spark, d), 40).select("document_id", "task_type", "page_number", F.coalesce("element_id", F.lit(-1)).cast("bigint").alias("element_id"))


@query
def role_responses(spark: SparkSession, d: str) -> DataFrame:
    return rbac.role_responses(manual.read(spark, d, "region").selectExpr("r_regionkey AS id", "r_name AS name", "r_name || ' role' AS description"))


@query
def user_responses(spark: SparkSession, d: str) -> DataFrame:
    at = "CAST(date_add(DATE '2024-01-01', CAST(id AS int)) AS string)"
    u = users(spark, d).selectExpr("*", f"{at} AS created_at", f"CASE WHEN id % 3 = 0 THEN {at} ELSE '' END AS last_login_at")
    return rbac.user_responses(u, grants(spark, d)[0].where("id < 2"))


@query
def login_preconditions(spark: SparkSession, d: str) -> DataFrame:
    asked = manual.read(spark, d, "customer").selectExpr("c_custkey AS attempt", "CASE WHEN c_custkey % 5 = 0 THEN 'nobody' ELSE c_name END AS username")
    return sessions.login_status(asked, users(spark, d)).select("attempt", F.coalesce("user_id", F.lit(-1)).cast("bigint").alias("user_id"), "status")


@query
def strict_zips(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, dense and sparse parts of one length, put together by place."""
    words = F.split("text", " ", -1)
    docs = manual.read(spark, d, "documents").where("text is not null").select("doc_id", words.alias("a"), F.transform(words, lambda w: F.length(w)).alias("b"))
    z = docs.select("doc_id", F.posexplode(tx.strict_zip(F.col("a"), F.col("b"))).alias("at", "z"))
    return z.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z.b") * (F.col("at") + 1)).cast("bigint").alias("weighed"), F.count_if(F.length("z.a") != F.col("z.b")).alias("apart"))


@query
def job_listing(spark: SparkSession, d: str) -> DataFrame:
    """A document's jobs by id, with times as text."""
    e = manual.read(spark, d, "events").selectExpr("event_id AS id", "user_id AS document_id", "event_type AS stage", "CAST(ts AS timestamp) AS started_at", "CASE WHEN event_id % 2 = 0 THEN CAST(ts AS timestamp) + INTERVAL 90 SECONDS END AS finished_at")
    j = sessions.list_jobs(e, 7)
    return j.select("id", "document_id", "stage", "started_at", F.coalesce("finished_at", F.lit("")).alias("finished_at"))


@query
def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The stored chunks after some documents were chunked anew: theirs are replaced, the others' stay."""
    at = runs.workspace(spark, "chunks")
    chunks = chunking.build(structured(spark, d))
    chunking.store(chunks, at)
    chunking.store(chunks.where("document_id % 3 = 1 AND chunk_no < 2"), at)
    return spark.read.parquet(at).select("document_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk_type", "embedding_status", F.coalesce("vector_id", F.lit("")).alias("vector_id"))


@query
def seeded_grants(spark: SparkSession, d: str) -> DataFrame:
    """Seeds laid over what is there, twice: what exists stays, what lacks comes once."""
    roles, scopes, rs = rbac.seed(spark)
    there = manual.read(spark, d, "nation").where("n_nationkey < 6").selectExpr("CAST(100 + n_nationkey AS int) AS id", "CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE element_at(array('chat:read', 'chat:write', 'documents:read'), CAST(n_nationkey div 2 + 1 AS int)) END AS code")
    out = store.insert_missing(store.insert_missing(there, scopes, ["code"]), scopes, ["code"])
    return out.select("code", (F.col("id") >= 100).alias("was_there"))


@query
def guarded_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many users stand against the removal of each role; a removal with any is an error."""
    u = users(spark, d)
    rows = []
    for role in range(4):
        try:
            store.require_none(u.where(F.col("role_id") == role), "users have the role")
            rows.append((role, ""))
        except ValueError as e:
            rows.append((role, str(e)))
    return spark.createDataFrame(rows, "role_id bigint, said string")


@query
def upload_plans(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploaded files, some known before: page counts, one document for each distinct content."""
    docs = manual.read(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.sha2(F.encode("text", "UTF-8"), 256).alias("source_hash"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"))
    files_ = docs.select("filename", F.col("filename").alias("uri"), "source_hash")
    facts = docs.select("source_hash", F.expr("(n_lines - 1) div 5 + 1").alias("page_number"))
    known = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), "source_hash")
    out = files.upload_plan(files_, known, facts)
    return out.select("filename", "page_count", "document_id", "created")


@query
def element_hash_paths(spark: SparkSession, d: str) -> DataFrame:
    """Distinct element hashes of each document, their section paths counted in."""
    e = structure.heading_paths(manual.elements(spark, d))
    h = tx.element_hash(F.col("element_type"), F.col("text"), F.col("section_path"), F.col("page_number"), F.lit("docling"))
    return e.select("document_id", h.alias("h")).groupBy("document_id").agg(F.countDistinct("h").alias("n_distinct"))


# search, containers, second extractions


def indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings as written, their maxima, the number of documents, the terms of each benchmark item)."""
    docs = manual.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    at = runs.workspace(spark, "postings")
    hybrid.write(hybrid.postings(docs), at)
    rows = spark.read.schema("term string, id bigint, r double, band int").parquet(at)
    asked = manual.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(hybrid.terms_of(F.col("text")))).alias("term"))
    return rows, hybrid.maxima(rows, asked), docs.agg(F.count(F.lit(1)).alias("n_docs")), asked


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each benchmark item by BM25, from the bands that can hold them."""
    rows, bands, n, asked = indexed(spark, d)
    return hybrid.lexical(rows, bands, asked, n, 10).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def bm25_short_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each term of a benchmark item by itself."""
    rows, bands, n, asked = indexed(spark, d)
    one = asked.select("term").distinct().select(F.col("term").alias("query_id"), "term")
    return hybrid.lexical(rows, bands, one, n, 10).select(F.col("query_id").alias("term"), "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def bm25_share_read(spark: SparkSession, d: str) -> DataFrame:
    """How many postings of the queries' terms a search reads, whole items and single terms: the read ones never exceed the whole."""
    _, bands, n, asked = indexed(spark, d)
    one = asked.select("term").distinct().select(F.col("term").alias("query_id"), "term")
    out = lambda kind, a: hybrid.wanted(a, bands, n, 10).agg(F.sum("n").alias("n_postings"), F.sum(F.when(F.col("needed"), F.col("n"))).alias("n_read")).select(F.lit(kind).alias("queries"), "n_postings", "n_read")
    return out("items", asked).unionByName(out("terms", one))


@query
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal-rank fusion of BM25 and of the cosine to the vector of the item's number."""
    rows, bands, n, asked = indexed(spark, d)
    p = points(spark, d).select("id", "dense")
    vectors_ = manual.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(p.select(F.col("id").alias("query_id"), F.col("dense").alias("vector")), "query_id")
    both = hybrid.fused(hybrid.lexical(rows, bands, asked, n, 30), hybrid.dense(p, vectors_, 30), k=10)
    return both.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def container_sections(spark: SparkSession, d: str) -> DataFrame:
    tree = containers.sections(chunking.build(structured(spark, d)), 1500)
    return tree.select("document_id", joined("section_path").alias("path"), F.coalesce(joined("parent_path"), F.lit("")).alias("parent"), F.col("level").cast("bigint").alias("level"), "n_chunks", F.col("n_chars").cast("bigint").alias("n_chars"), "fits")


@query
def container_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The widest section around each chunk that fits the budget."""
    chunks = chunking.build(structured(spark, d))
    out = containers.assigned(chunks, containers.sections(chunks, 1500))
    return out.select("document_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.coalesce(joined("container_path"), F.lit("")).alias("container"))


@query
def stale_elements(spark: SparkSession, d: str) -> DataFrame:
    """A second extraction with one keyword more: its elements alone are read again, and all have what a whole extraction gives."""
    before = kg.Words({k: t for k, t in kg.KEYWORDS.items() if k != "muffler"})
    e = visual(structure.heading_paths(manual.elements(spark, d)))
    stored = kg.extract(e, before).withColumn("kg_stamp", F.when(F.col("element_id") % 10 != 3, F.lit(before.stamp)))
    out = kg.reextract(stored, kg.WORDS, [before])
    return out.select("document_id", "element_id", "extracted", F.size("entities").cast("bigint").alias("n_entities"), (F.col("kg_stamp") == kg.WORDS.stamp).alias("stamped"))
