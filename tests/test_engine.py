"""Rules of the engine on tiny tables, with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import text as tx
from loomdoc.operators import cascade, chunking, graph, kg, probe, rbac, sampling, sessions, store, structure, tables, vectors

ELEMENT = "document_id bigint, element_id bigint, page_number bigint, element_type string, text string, section_path array<string>, components array<string>, connections array<string>, description string"


def elements(spark, *rows):
    return spark.createDataFrame([(1, i + 1, r.get("page", 1), r.get("kind", "paragraph"), r.get("text"), r.get("path", []), r.get("components"), r.get("connections"), r.get("description")) for i, r in enumerate(rows)], ELEMENT)


def names(spark, **row):
    e = kg.exploded(kg.extract(elements(spark, row))).orderBy("no").collect()
    return [(r.name, r.entity_type, r.confidence, r.context_anchor_matched) for r in e]


def test_error_code_tiers(spark):
    assert ("P8", "ErrorCode", 0.6, True) in names(spark, text="With error code P8 on the panel, look at the pump first.")
    assert names(spark, text="Panels of size P8 fit this frame.") == [("P8", "ErrorCode", 0.3, False)]
    assert names(spark, kind="table", text="P8", path=["Error code list"]) == [("P8", "ErrorCode", 0.75, True)]
    assert names(spark, text="The AC unit") == []
    assert [x[0] for x in names(spark, text="abnormal: A6-01 and E7 - 12")] == ["A6", "E7", "A6-01", "E7-12"]


def test_keywords_and_glossary(spark):
    assert names(spark, text="The Inverter PCB and pcbs") == [("pcb", "PCB", 0.5, None), ("inverter pcb", "PCB", 0.5, None)]
    many = "compressor condenser evaporator accumulator strainer muffler"
    assert {x[2] for x in names(spark, text=many)} == {0.2}


def test_spans_count_code_points(spark):
    text = "😀 Measure the resistance of TH3 connected via CN105."
    e = kg.exploded(kg.extract(elements(spark, {"text": text}))).collect()
    assert {text[r.justification_span[0] : r.justification_span[1]] for r in e} == {"TH3", "CN105"}
    seen = kg.exploded(kg.extract(elements(spark, {"kind": "figure", "description": "Printed Circuit Board seen beside plug CN105", "text": ""}))).collect()
    assert {r.extraction_method for r in seen} == {"dict_keyword_vlm_description", "regex_connector_id_vlm_description"} and all(r.justification_span is None for r in seen)


def test_unicode_borders(spark):
    assert names(spark, text="éTH3") == [] and names(spark, text="R 1T X2M")[0][0] == "R 1T"


def test_connections(spark):
    r = kg.extract(elements(spark, {"kind": "figure", "connections": ["compressor -> TH3", "TH3 to PCB", " -> TH3", "TH3 -> ", "a --> b -> c"]})).select(F.explode("relations").alias("r")).select("r.*").collect()
    assert [(x.subject, x.object) for x in r] == [("compressor", "TH3"), ("TH3", "PCB"), ("a", "b -> c")] and {x.confidence for x in r} == {0.5}


def test_agreement_is_by_page_and_mechanism(spark):
    e = kg.exploded(kg.extract(elements(spark, {"kind": "figure", "components": ["th3 "], "description": "TH3"}, {"text": "TH3 and TH3"}, {"text": "TH3", "page": 2})))
    a = {(r.element_id, r.extraction_method): r.corroboration_count for r in kg.agree(e).where("entity_type = 'Sensor'").collect()}
    assert a == {(1, "regex_sensor_id_vlm_description"): 2, (2, "regex_sensor_id"): 1, (3, "regex_sensor_id"): 0}


def test_rollup_text(spark):
    r = kg.rollup(kg.exploded(kg.extract(elements(spark, {"text": "TH3"}, {"text": "TH3", "page": 3})))).first()
    assert r.content_text == "TH3 (Sensor) — referenced on page(s) 1, 3." and r.occurrences == 2 and r.confidence == 0.7


def test_probe_flags(spark):
    rows = [(1, 1000, 609.0, 793.0, 0, 0), (2, 39, 609.0, 793.0, 50, 1), (3, 40, 600.0, 800.0, 49, 0), (4, 40, 0.0, 0.0, 0, 2)]
    p = probe.probe(spark.createDataFrame(rows, "page_number int, char_count int, width double, height double, drawings int, images int"))
    got = {r.page_number: r.flags for r in p.collect()}
    assert got == {1: ["text_normal"], 2: ["low_text_confidence", "vector_diagram", "raster_image"], 3: ["low_text_confidence"], 4: ["text_normal", "raster_image"]}
    assert {r.flag: r.n for r in probe.flag_counts(p.where("page_number = 1")).collect()} == {"text_normal": 1, "low_text_confidence": 0, "vector_diagram": 0, "raster_image": 0}


def test_cascade_plan(spark):
    e = spark.createDataFrame([(1, 1, "table", 1, 0.9), (1, 2, "table", 1, None), (1, 3, "table", 1, 0.89), (1, 4, "figure", 1, 0.9), (1, 5, "icon", 9, 0.9), (1, 6, "paragraph", 1, 0.1)], "document_id int, element_id bigint, element_type string, page_number int, confidence double")
    p = spark.createDataFrame([(1, 1, ["text_normal", "vector_diagram", "raster_image"], 0.6), (1, 2, ["text_normal"], None), (1, 3, ["text_normal"], 0.59)], "document_id int, page_number int, flags array<string>, parse_score double")
    t = cascade.plan(e, p)
    assert {(r.task_type, r.page_number, r.element_id) for r in t.collect()} == {("table_reparse", 1, 2), ("table_reparse", 1, 3), ("visual_description", 1, 4), ("full_page_ocr", 2, None), ("full_page_ocr", 3, None)}
    reasons = {r.element_id: r.reason for r in t.collect()}
    assert reasons[2] == "table_score None < 0.9000" and reasons[4] == "page flags: vector_diagram, raster_image"


class Client:
    calls = 0

    def describe_figure(self, row):
        Client.calls += 1
        if Client.calls == 1:
            raise ConnectionError
        return "seen"

    def reparse_table(self, row):
        return None

    ocr_page = reparse_table


def test_run_tasks_retries_transport_errors(spark):
    t = spark.createDataFrame([(1, 1, 1, "visual_description", ""), (1, 2, 1, "table_reparse", ""), (1, 3, 1, "other", "")], "document_id bigint, element_id bigint, page_number bigint, task_type string, reason string").coalesce(1)
    e = spark.createDataFrame([(1, 1, "a")], "document_id bigint, element_id bigint, text string")
    assert {(r.task_type, r.result) for r in cascade.run_tasks(t, e, Client).collect()} == {("visual_description", "seen"), ("table_reparse", "")}


def test_responses(spark):
    df = spark.createDataFrame([('{"description": "d"}', '{"markdown": {"text": "m"}, "text": "t"}'), ('{"components": ["a"]}', '{"text": "t"}')], "a string, b string")
    r = df.select(cascade.parse_response(F.col("a")).alias("p"), cascade.markdown_text(F.col("b")).alias("m")).collect()
    assert r[0].p.components == [] and r[0].p.description == "d" and r[1].p.components == ["a"] and [x.m for x in r] == ["m", "t"]


def test_crop_rectangle(spark):
    df = spark.createDataFrame([((10.0, 90.0, 20.0, 80.0),), (None,)], "b struct<l:double,t:double,r:double,b:double>")
    r = df.select(cascade.crop_rectangle(F.col("b"), F.lit(100.0), 72).alias("c")).collect()
    assert tuple(r[0].c) == (10.0, 10.0, 20.0, 20.0) and r[1].c is None


def test_heading_levels_are_sliced_not_padded(spark):
    rows = [(1, 1, "paragraph", "a", None), (1, 2, "heading", "H1", 1), (1, 3, "heading", "H2", 2), (1, 4, "heading", "H5", 5), (1, 5, "paragraph", "b", None), (1, 6, "heading", "", 1), (1, 7, "heading", "N", None)]
    e = spark.createDataFrame(rows, "document_id int, seq bigint, element_type string, text string, level int")
    got = {r.seq: r.section_path for r in structure.heading_paths(e).collect()}
    assert got == {1: [], 2: ["H1"], 3: ["H1", "H2"], 4: ["H1", "H2", "H5"], 5: ["H1", "H2", "H5"], 6: ["H1", "H2", "H5"], 7: ["N"]}


def test_icon_parents(spark):
    rows = [(1, 1, 1, 1, "icon"), (1, 2, 2, 1, "paragraph"), (1, 3, 3, 2, "icon"), (1, 4, 4, 2, "list"), (1, 5, 5, 2, "table"), (1, 6, 6, 2, "icon")]
    e = spark.createDataFrame(rows, "document_id int, element_id int, seq int, page_number int, element_type string")
    assert {r.element_id: r.parent_id for r in structure.icon_parents(e).where("element_type = 'icon'").collect()} == {1: None, 3: 2, 6: 4}


def test_small_figures_are_icons(spark):
    df = spark.createDataFrame([(79.0, 79.0, 600.0, 800.0), (80.0, 10.0, 600.0, 800.0), (10.0, 10.0, None, None), (10.0, 10.0, 0.0, 0.0), (70.0, 70.0, 100.0, 100.0)], "w double, h double, pw double, ph double")
    assert [r[0] for r in df.select(structure.is_icon(F.col("w"), F.col("h"), F.col("pw"), F.col("ph"))).collect()] == [True, False, False, False, False]


def test_scores_and_pages(spark):
    d = spark.createDataFrame([(1, 3), (2, 0)], "document_id int, page_count int")
    s = spark.createDataFrame([(1, 2, 0.5)], "document_id int, page_number bigint, parse_score double")
    assert {(r.document_id, r.page_number, r.parse_score) for r in structure.dense_pages(d, s).collect()} == {(1, 1, None), (1, 2, 0.5), (1, 3, None)}
    assert spark.range(1).select(structure.clean_score(F.lit(float("nan"))), structure.clean_score(F.lit(0.5))).first()[:] == (None, 0.5)


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("|A|B|\n|---|---|\n|1|2|\n|3|4|", [{"A": "1", "B": "2"}, {"A": "3", "B": "4"}]),
        ("|A|B|\n|1|2|", [{"A": "1", "B": "2"}]),
        ("|A|A|\n|1|2|3|", [{"A": "2"}]),
        ("|A|B|\n||\n|1|", [{"A": "1"}]),
        ("no table", []), ("|A|", []), (None, []), ("", []),
    ],
)
def test_markdown(spark, text, rows):
    assert spark.createDataFrame([(text,)], "t string").select(tables.markdown_rows(F.col("t")).alias("r")).first().r == rows


@pytest.mark.parametrize(
    ("html", "rows"),
    [
        ('<table><tr><td colspan="3">Merged</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>', [["Merged"] * 3, ["a", "b", "c"]]),
        ('<table><tr><td colspan="auto">x</td></tr></table>', [["x"]]),
        ("<table><tr><td>left open", []),
        ("<table><tr><td>lost<td>kept</td></tr><tr></tr><tr><th>h &amp; i</th><td></td></tr></table>", [["kept", ""], ["h & i", ""]]),
    ],
)
def test_html(html, rows):
    assert [list(r.values()) for r in tables.parse_html_table(html)] == rows


def test_table_dispatch(spark):
    df = spark.createDataFrame([("x <TABLE><tr><td>1</td></tr></TABLE>",), ("|A|\n|1|",), (None,)], "text string")
    assert sorted(map(str, (r.rows for r in tables.table_rows(df).collect()))) == sorted(["[{'col_0': '1'}]", "[{'A': '1'}]", "[]"])


def element(i, kind, text="x", page=1, parent=None, path=("Ch",), description=None):
    return {"element_id": i, "element_type": kind, "text": text, "page_number": page, "parent_id": parent, "section_path": list(path), "description": description}


def kinds(*rows):
    return [(c.kind, c.ids) for c in chunking.fold(list(rows))]


def test_chunk_rules():
    p, long = "paragraph", "y" * 2010
    assert kinds(element(1, p, long), element(2, p)) == [("text", [1]), ("text", [2])]
    assert kinds(element(1, p, long), element(2, "icon", parent=1)) == [("text", [1, 2])]
    assert kinds(element(1, p), element(2, "table"), element(3, p)) == [("text", [1]), ("table", [2]), ("text", [3])]
    assert kinds(element(1, p), element(2, "diagram"), element(3, p)) == [("text", [1, 3]), ("text", [2])]
    assert kinds(element(1, "list"), element(2, "list"), element(3, "list", path=("B",))) == [("procedure", [1, 2]), ("procedure", [3])]
    assert kinds(element(1, p), element(2, p, path=("B",))) == [("text", [1]), ("text", [2])]
    assert kinds(element(1, "figure", ""), element(2, "figure_caption", parent=1), element(3, "icon", parent=2)) == [("figure", [1, 2, 3])]
    c = chunking.fold([element(1, p, " a "), element(2, p, None, 5), element(3, p, "b", 2)])[0]
    assert c.text == "a\nb" and (c.page, c.end) == (1, 2)
    assert chunking.fold([element(1, "figure", "", description="d")])[0].text == "d"


def test_chunk_hash_and_store(spark, tmp_path):
    e = spark.createDataFrame([(d, d * 10 + i, i, "paragraph", "t", 1, ["s"], None, None) for d in (1, 2) for i in (1, 2)], "document_id bigint, element_id bigint, seq bigint, element_type string, text string, page_number bigint, section_path array<string>, parent_id bigint, description string")
    chunks = chunking.build(e)
    r = chunking.hashed(chunks).where("document_id = 1").first()
    import hashlib

    assert r.content_hash == hashlib.sha256(b"text|s|t\nt|11,12").hexdigest()
    path = str(tmp_path / "chunks")
    chunking.store(chunks, path)
    chunking.store(chunks.where("document_id = 1").withColumn("content_text", F.lit("new")), path)
    assert {(x.document_id, x.content_text) for x in spark.read.parquet(path).collect()} == {(1, "new"), (2, "t\nt")}


def test_structure_graph_totals(spark):
    d = spark.createDataFrame([(1, "M", 2), (2, "E", 0)], "document_id bigint, title string, page_count bigint")
    e = spark.createDataFrame([(1, 1, 1, 1, "paragraph", "front", [], None), (1, 2, 2, 1, "paragraph", "p", ["A", "B"], None), (1, 3, 3, 2, "icon", None, ["A", "B"], 2), (1, 4, 4, 9, "note", "lost", [], 5)], "document_id bigint, element_id bigint, seq bigint, page_number bigint, element_type string, text string, section_path array<string>, parent_id bigint")
    n = {r.relation: r["count"] for r in graph.edges(d, e).groupBy("relation").count().collect()}
    assert n == {"HAS_PAGE": 2, "HAS_SECTION": 1, "HAS_SUBSECTION": 1, "CONTAINS_ELEMENT": 3, "HAS_CHILD": 1}
    kinds_ = {r.node_type: r["count"] for r in graph.nodes(d, e).groupBy("node_type").count().collect()}
    assert kinds_ == {"Document": 2, "Page": 2, "Section": 2, "Element": 4}
    assert {r.label for r in graph.nodes(d, e).where("node_type = 'Element'").collect()} == {"front", "p", "[icon]", "lost"}


def test_change_plan_and_parents(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "d")], "document_id int, page_number int, page_hash string")
    f = spark.createDataFrame([(1, 1, "a"), (1, 2, "B"), (1, 3, "c")], "document_id int, page_number int, page_hash string")
    plan = store.change_plan(s, f)
    assert {(r.page_number, r.action) for r in plan.collect()} == {(1, "skip"), (2, "replace"), (3, "insert"), (4, "gone")}
    old = spark.createDataFrame([(1, 1, "old"), (1, 2, "old"), (1, 4, "old")], "document_id int, page_number int, v string")
    new = spark.createDataFrame([(1, 1, "new"), (1, 2, "new"), (1, 3, "new")], "document_id int, page_number int, v string")
    assert {(r.page_number, r.v) for r in store.apply_plan(old, new, plan).collect()} == {(1, "old"), (2, "new"), (3, "new")}
    drafts = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 4), (1, 4, None), (2, 1, None), (2, 2, 1)], "document_id int, local_id int, parent_local_id int")
    assert {(r.id, r.parent_id) for r in store.assign_ids(drafts, 100).collect()} == {(101, None), (102, 101), (103, None), (104, None), (105, None), (106, 105)}


def test_dedupe_and_seed(spark):
    rows = spark.createDataFrame([(3, "h1"), (4, "h1"), (5, "h2")], "id int, source_hash string")
    known = spark.createDataFrame([(1, "h2")], "id int, source_hash string")
    assert {(r.id, r.document_id, r.created) for r in store.dedupe(rows, known).collect()} == {(3, 3, True), (4, 3, False), (5, 1, False)}
    roles, scopes, grants = rbac.seed(spark)
    again = store.insert_missing(roles, roles, ["name"])
    assert again.count() == 2 and grants.count() == 13 and rbac.ungranted(scopes, grants, 2).count() == 7
    assert {r.role: len(r.codes) for r in rbac.role_codes(roles, grants, scopes).collect()} == {"admin": 10, "user": 3}
    assert rbac.replace_grants(grants, 2, ["chat:read"], scopes).where("role_id = 2").count() == 1


def test_navigation(spark):
    leaves = spark.createDataFrame([("/a", [], None, ["g0"]), ("/b", ["x", "y"], "any", ["g1", "g2"]), ("/c", ["x", "z"], "all", ["g3"])], "route string, required_scopes array<string>, match string, group_path array<string>")
    assert {r.group for r in rbac.visible_groups(leaves, F.array(F.lit("x"))).collect()} == {"g0", "g1", "g2"}
    assert spark.range(1).select(rbac.missing(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.array(F.lit("a")))).first()[0] == ["b", "b"]


def test_login_window_is_fixed_from_the_first_failure(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [("k", t0 + timedelta(seconds=s), i, f) for i, (s, f) in enumerate([(0, True), (800, True), (850, False), (860, True), (861, True), (862, False), (1759, False), (1761, True)])]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq bigint, failed boolean")
    got = [(r.failures, r.blocked) for r in sessions.login_limits(df, 2, 900).orderBy("seq").collect()]
    assert got == [(1, False), (2, False), (2, True), (2, True), (2, True), (2, True), (0, False), (1, False)]


def test_token_reuse_revokes_the_family(spark):
    e = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "b", "c"), (1, 3, "a", "x"), (1, 4, "c", "d"), (2, 1, "q", "r"), (2, 2, "z", "s")], "family bigint, seq bigint, token string, new_token string")
    assert [r.outcome for r in sessions.rotate_tokens(e).orderBy("family", "seq").collect()] == ["rotated", "rotated", "reuse", "reuse", "rotated", "unknown"]


def test_refresh_status_and_revocation(spark):
    import hashlib
    from datetime import datetime

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    now, later = datetime(2024, 1, 2), datetime(2024, 1, 3)
    tokens = spark.createDataFrame([(h("a"), 1, later, None), (h("b"), 1, now, None), (h("c"), 1, later, now), (h("d"), 2, later, None)], "token_hash string, user_id int, expires_at timestamp, revoked_at timestamp")
    users = spark.createDataFrame([(1, True), (2, False)], "id int, is_active boolean")
    raw = spark.createDataFrame([(x,) for x in "abcde"], "raw string")
    got = {r.raw: r.status for r in sessions.refresh_status(raw, tokens, users, F.lit(now)).collect()}
    assert got == {"a": "valid", "b": "expired", "c": "revoked", "d": "inactive", "e": "unknown"}
    assert sessions.revoke(tokens, F.col("user_id") == 1, F.lit(later)).where(F.col("revoked_at") == F.lit(later)).count() == 2


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.0, 1.0], 7), (3, [0.0, 0.0], 7), (4, [2.0, 0.0], 8)], "id int, dense array<float>, document_id int")
    assert [(r.id, r.score) for r in vectors.query(v, [1.0, 0.0], 2).collect()] == [(1, 1.0), (4, 1.0)]
    assert [r.id for r in vectors.query(v, [1.0, 0.0], 5, {"document_id": 8}).collect()] == [4]
    assert vectors.stats(v).first()[:] == (4, 2) and vectors.stats(v.limit(0)).first()[:] == (0, 0)
    assert vectors.upsert(v, v.where("id = 1").withColumn("document_id", F.lit(9))).where("document_id = 9").count() == 1 and vectors.delete_by_document(v, 7).count() == 1 and vectors.delete(v, [1, 2]).count() == 2
    c = spark.createDataFrame([(1, "a b a", "pending"), (2, "c", "embedded")], "id int, content_text string, embedding_status string")
    e = vectors.embed(c, lambda: lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [(r.id, r.dense) for r in e] == [(1, [5.0])] and sorted(vectors.sparse_terms(c).first().sparse["values"]) == [1.0, 2.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("  x ",)], "t string")
    assert df.select(tx.strip(F.col("t"))).first()[0] == "x"
    one = spark.range(1)
    assert one.select(tx.csv_list(F.lit(" a, ,b "))).first()[0] == ["a", "b"] and one.select(tx.csv_list(F.lit(" "))).first()[0] is None
    assert one.select(tx.splitlines(F.lit("a\r\nb c\n"))).first()[0] == ["a", "b", "c"]
    assert one.select(tx.element_label(F.lit("w" * 79 + " zz"), F.lit("note"))).first()[0] == "w" * 79 + "..."
    for bad in ("ftp://host/file", "s3://lonely", "s3:///nobody"):
        with pytest.raises(Exception, match="not an object URI"):
            one.select(tx.parse_uri(F.lit(bad))).collect()
    u = one.select(tx.parse_uri(F.lit("s3://b/k/x")).alias("u"), tx.parse_uri(F.lit("file://k")).alias("f")).first()
    assert (u.u.bucket, u.u.key, u.f.key) == ("b", "k/x", "k")
    h = one.select(tx.element_hash(F.lit("a"), F.lit(None).cast("string"), F.array(), F.lit(1), F.lit("m")), tx.element_hash(F.lit("a"), F.lit(""), F.array(), F.lit(1), F.lit("m"))).first()
    assert h[0] != h[1]


def test_sample_caps(spark):
    rows = [(d, p, "malfunction remedy" if p % 2 else "plain", ["text_normal"], 0, False) for d in range(5) for p in range(1, 11)]
    df = spark.createDataFrame(rows, "document_id int, page_number int, text string, flags array<string>, drawings int, has_table boolean")
    s = sampling.sample(df, per_category=4, per_document=3, min_page=1).collect()
    trouble = [(r.document_id, r.page_number) for r in s if r.category == "troubleshooting"]
    assert sorted(trouble) == [(0, 1), (0, 3), (0, 5), (1, 1)] and sum(r.category == "text_normal" for r in s) == 4


def test_incremental_stream(spark, tmp_path):
    from loomdoc.streaming import ingest

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("one")
    for _ in range(2):
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(str(src))
        ingest.ingest(stream, out, str(tmp_path / "check")).awaitTermination()
        (src / "c.txt").write_text("two")
    assert spark.read.parquet(out).count() == 2


def test_windows(spark):
    from datetime import datetime

    from loomdoc.streaming import ingest

    e = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), 1, "a", 1.0), (datetime(2024, 1, 1, 0, 50), 1, "a", 2.0), (datetime(2024, 1, 1, 2, 0), 1, "a", 4.0)], "ts timestamp, user_id int, event_type string, value double")
    assert sorted(r.total for r in ingest.windowed_counts(e).collect()) == [3.0, 4.0]
    assert sorted(r.n for r in ingest.session_counts(e, "1 hour").collect()) == [1, 2]


def test_files(spark, tmp_path):
    from loomdoc.sources import files

    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "c.pdf").write_bytes(b"old")
    (tmp_path / "d.txt").write_bytes(b"no")
    f = files.scan(spark, str(tmp_path))
    parse = lambda: lambda content: [{"text": t, "width": 1, "height": 2} for t in content.decode().split("\f")]
    facts = files.parse_pages(f, parse)
    assert facts.count() == 5
    import hashlib

    known = spark.createDataFrame([(7, hashlib.sha256(b"old").hexdigest())], "id bigint, source_hash string")
    assert {(r.filename, r.page_count, r.document_id, r.created) for r in files.upload_plan(f, known, facts).collect()} == {("a.pdf", 2, 8, True), ("b.pdf", 2, 8, True), ("c.pdf", 1, 7, False)}
    files.export_json(known, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().id == 7


def test_objects_are_put_read_and_deleted(spark, tmp_path):
    from loomdoc.sources.objects import Objects

    o = Objects(spark, f"file://{tmp_path}/store")
    uri = o.put("documents/1/pages/2/page.png", b"\x00\x01pixels")
    assert uri == f"file://{tmp_path}/store/documents/1/pages/2/page.png" and o.exists(uri) and o.get(uri) == b"\x00\x01pixels"
    o.put("documents/1/pages/2/page.png", b"new")
    assert o.get(uri) == b"new" and [(r.key, r.length) for r in o.listing("documents").collect()] == [("documents/1/pages/2/page.png", 3)]
    wanted = spark.createDataFrame([(uri,), (o.uri("documents/9/none"),)], "uri string")
    assert {r.uri: (r.found, r.content and bytes(r.content)) for r in o.contents(wanted).collect()} == {uri: (True, b"new"), o.uri("documents/9/none"): (False, None)}
    o.delete(uri)
    o.delete(uri)
    assert not o.exists(uri)
    for bad in ("../x", "", "/x"):
        with pytest.raises(ValueError):
            o.put(bad, b"")
    with pytest.raises(ValueError):
        o.get("file:///etc/hostname")


def test_html_cells_by_their_events():
    rows = tables.parse_html_table
    assert rows('<table><tr><td colspan="2">T</td></tr><tr><th>a</th></tr></table>') == [{"col_0": "T", "col_1": "T"}, {"col_0": "a", "col_1": ""}]
    assert rows('<tr><td colspan="²">x</td><td colspan=" 2 ">y</td><td colspan="0">z</td></tr>') == [{"col_0": "x", "col_1": "y", "col_2": "y", "col_3": "z"}]
    assert rows("<table><tr></td><td>b</td></tr>") == [{"col_0": "", "col_1": "b"}] and rows("<table><tr><td>never closed") == [] and rows("<tr></tr>") == []
    assert rows("<tr><td>lost<td>kept</td></tr>") == [{"col_0": "kept"}]


def test_table_chunks_keep_their_text():
    (c,) = chunking.fold([element(1, "table", " |a|\n|b| \n")])
    assert c.text == " |a|\n|b| \n" and c.own_text == c.text
    (c,) = chunking.fold([element(1, "figure", "", description=" seen ")])
    assert c.text == " seen "


def test_content_of_chunks(spark):
    rows = [(1, 1, 1, "list", "one", 1, ["S"], None, None), (1, 2, 2, "list", None, 1, ["S"], None, None), (1, 3, 3, "table", "|a|b|\n|-|-|\n|1|2|\n|3|", 1, ["S"], None, None), (1, 4, 4, "paragraph", "p", 2, ["S"], None, None)]
    e = spark.createDataFrame(rows, "document_id bigint, element_id bigint, seq bigint, element_type string, text string, page_number bigint, section_path array<string>, parent_id bigint, description string")
    got = [r.content_structured for r in chunking.with_content(chunking.build(e)).orderBy("chunk_no").collect()]
    assert [(x.step_number, x.step_text, x.element_id) for x in got[0].steps] == [(1, "one", 1), (2, "", 2)] and got[1].rows == [{"a": "1", "b": "2"}, {"a": "3"}] and got[2] is None


def test_chunks_are_replaced_by_document(spark, tmp_path):
    def rows(document, text):
        e = spark.createDataFrame([(document, 1, 1, "paragraph", text, 1, ["S"], None, None)], "document_id bigint, element_id bigint, seq bigint, element_type string, text string, page_number bigint, section_path array<string>, parent_id bigint, description string")
        return chunking.build(e)

    path = str(tmp_path / "chunks")
    for d in range(5):
        chunking.store(rows(d, "old"), path)
    chunking.store(rows(3, "new"), path)
    assert sorted((r.document_id, r.content_text) for r in spark.read.parquet(path).collect()) == [(d, "new" if d == 3 else "old") for d in range(5)]


def test_markdown_is_preferred(spark):
    bodies = ['{"markdown": "", "text": "t"}', '{"markdown": "{x", "text": "t"}', '{"markdown": {"markdown_texts": "", "text": "m"}, "text": "t"}', '{"markdown": {}, "text": "t"}', '{"text": "t"}', "{}"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    assert [r.m for r in df.select("i", cascade.markdown_text(F.col("b")).alias("m")).orderBy("i").collect()] == ["", "{x", "m", "t", "t", ""]


def test_nothing_required_is_visible(spark):
    df = spark.createDataFrame([(None, ["a"]), ([], ["a"]), (["b"], ["a"])], "r array<string>, h array<string>")
    assert [x.v for x in df.select(rbac.visible(F.col("r"), F.col("h"), F.lit("any")).alias("v")).collect()] == [True, True, False]


def test_crops_reach_the_client(spark):
    class Sees(Client):
        def describe_figure(self, row):
            return str(tuple(row["crop"].values()) if isinstance(row["crop"], dict) else row["crop"] and tuple(row["crop"]))

    t = spark.createDataFrame([(1, 1, 1, "visual_description", ""), (1, 2, 1, "visual_description", "")], "document_id bigint, element_id bigint, page_number bigint, task_type string, reason string")
    e = spark.createDataFrame([(1, 1, "a", (10.0, 90.0, 20.0, 80.0)), (1, 2, "b", None)], "document_id bigint, element_id bigint, text string, bbox struct<l:double,t:double,r:double,b:double>")
    p = spark.createDataFrame([(1, 1, 100.0)], "document_id bigint, page_number bigint, height double")
    got = {r.element_id: r.result for r in cascade.run_tasks(t, e, Sees, pages=p).collect()}
    assert got[1].startswith("(27.7") and got[2] in ("None", "")


def test_ids_run_on_over_many_documents(spark):
    d = spark.createDataFrame([(d * 5000, i, None) for d in range(6) for i in range(1, d + 2)], "document_id bigint, local_id bigint, parent_local_id bigint")
    assert [r.id for r in store.assign_ids(d).orderBy("document_id", "local_id").collect()] == list(range(1, 22))


def test_guard_names_what_stands_against_it(spark):
    u = spark.createDataFrame([(1, 1)], "id int, role_id int")
    assert store.require_none(u.where("role_id = 2"), "users have a seed role") == 0
    with pytest.raises(ValueError, match="1 users"):
        store.require_none(u.where("role_id = 1"), "users have a seed role")


def test_runs_of_a_job_stand_by_themselves(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    log = [("running", 0), ("failed", 5), ("running", 100), ("done", 101)]
    df = spark.createDataFrame([(1, "parse", s, t0 + timedelta(seconds=k), i, "boom") for i, (s, k) in enumerate(log)], "document_id bigint, stage string, status string, ts timestamp, seq bigint, error_message string")
    jobs = sessions.job_states(df)
    assert [(r.run, r.status, r.duration_ms, r.error_message) for r in jobs.orderBy("run").collect()] == [(1, "failed", 5000, "boom"), (2, "done", 1000, None)]
    assert [r.status for r in sessions.document_states(jobs).collect()] == ["ready"]


def test_refused_tokens(spark):
    e = spark.createDataFrame([(1, 1, "a", "b", False, True), (1, 2, "a", "c", True, False), (1, 3, "a", "d", False, False), (1, 4, "a", "e", False, False), (1, 5, "d", "f", False, False)], "family bigint, seq bigint, token string, new_token string, expired boolean, inactive boolean")
    got = [(r.outcome, r.replaced_by, r.family_revoked) for r in sessions.rotate_tokens(e).orderBy("seq").collect()]
    assert got == [("inactive", None, False), ("expired", None, False), ("rotated", "d", False), ("reuse", None, True), ("reuse", None, True)]


def test_texts_that_cannot_match_are_not_matched(monkeypatch):
    """What is looked for before a pattern runs changes nothing: the patterns alone give the same."""
    import random
    import re

    r = random.Random(5)
    parts = ["TH", "th 4", "TH-12", "R1T", "R 2T", "CN105", "cn 7", "X2M", "XM", "P8", "E7 - 12", "AH", "H٣", "error code", "ERROR  CODE", "Abnormal", "check codes", "malfunction", "pcb", "PCB", "Muffler", "ſtrainer", "four-way valve", "oilK", "thermistors", "x", "é", "-", "->", "\n"]
    texts = ["".join(r.choice(parts) + r.choice(("", " ", ". ")) for _ in range(r.randrange(9))) for _ in range(3000)]
    got = [[*kg.found_in(t, "table", ["abnormal"] if len(t) % 3 == 0 else None, len(t) % 2 == 0)] for t in texts]

    def plainly(words, text):
        return [(k, m) for k, p in words.patterns.items() if (m := p.search(text))]

    with monkeypatch.context() as m:
        m.setattr(kg.Words, "first_matches", plainly)
        m.setattr(kg, "anchored", lambda t: bool(kg._ANCHOR.search(t)))
        m.setattr(kg, "_CODE", re.compile(""))
        m.setattr(kg, "_IDENTIFIERS", tuple((*x[:3], ()) for x in kg._IDENTIFIERS))
        assert got == [[*kg.found_in(t, "table", ["abnormal"] if len(t) % 3 == 0 else None, len(t) % 2 == 0)] for t in texts]
    assert len({x[3] for g in got for x in g}) > 9
