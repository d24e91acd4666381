"""Stores that change by runs, streams over restarts, calls that are paid once: what happens when a writer is killed, a call is repeated, a batch is played again."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import text as tx
from loomdoc.operators import canonical, cascade, collection, graph, ledger, sessions, vectors
from loomdoc.plans import lifecycle, queries
from loomdoc.sources import runs
from loomdoc.sources.objects import Objects
from loomdoc.streaming import ingest
from loomdoc.streaming import sessions as live

SF = "/root/testdata/sf0.001"
PAGE = "document_id bigint, page_number bigint, page_hash string"
ELEMENT = "document_id bigint, page_number bigint, id bigint, element_type string, text string, bbox struct<l:double>"


def pages(spark, *rows):
    return spark.createDataFrame(rows, PAGE)


def elements(spark, text, *keys):
    return spark.createDataFrame([(d, p, d * 100 + p * 10 + i, "figure" if i else "paragraph", text, (1.0,)) for d, p in keys for i in (0, 1)], ELEMENT)


def held(store):
    return {(r.document_id, r.page_number): (r.page_hash, r.stored_run, [e.text for e in r.elements]) for r in store.pages().collect()}


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_canonical_store_writes_what_changes(spark, tmp_path):
    s = canonical.CanonicalStore(spark, str(tmp_path), buckets=4)
    assert s.pages() is None and s.elements() is None
    keys = [(d, p) for d in range(6) for p in (1, 2)]
    out = s.store(pages(spark, *((d, p, "a") for d, p in keys)), elements(spark, "one", *keys))
    assert {tuple(r) for r in out.collect()} == {(d, 2, 0, 4, 2) for d in range(6)}
    before = files_below(tmp_path)
    # a replay finds nothing to do and writes nothing
    out = s.store(pages(spark, *((d, p, "a") for d, p in keys)), elements(spark, "two", *keys))
    assert {tuple(r) for r in out.collect()} == {(d, 0, 2, 0, 0) for d in range(6)} and files_below(tmp_path) == before
    # one page of one document changes, another is new: other buckets keep their files
    out = s.store(pages(spark, (3, 2, "b"), (3, 1, "a"), (3, 9, "c")), elements(spark, "three", (3, 2), (3, 1), (3, 9)))
    assert [tuple(r) for r in out.collect()] == [(3, 2, 1, 4, 2)]
    got = held(s)
    assert got[3, 2] == ("b", 2, ["three"] * 2) and got[3, 9] == ("c", 2, ["three"] * 2) and got[3, 1] == ("a", 1, ["one"] * 2) and len(got) == 13
    assert len(runs.folders(spark, f"{s.root}/run=2", "bucket")) == 1
    assert {r.page_number for r in s.document(3).collect()} == {1, 2, 9} and s.elements().count() == 26
    # a page without elements is a page
    s.store(pages(spark, (9, 1, "z")), elements(spark, "x", (9, 2)))
    assert held(s)[9, 1] == ("z", 3, [])
    s.vacuum()
    assert len(held(s)) == 14 and all(f in files_below(tmp_path) or "run=1" in f for f in before)


def test_a_killed_run_leaves_the_old_pages(spark, tmp_path):
    s = canonical.CanonicalStore(spark, str(tmp_path), buckets=2)
    s.store(pages(spark, (1, 1, "a"), (2, 1, "a")), elements(spark, "one", (1, 1), (2, 1)))
    before = held(s)
    bad = F.udf(lambda t: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        s.store(pages(spark, (1, 1, "b")), elements(spark, "two", (1, 1)).withColumn("text", bad("text")))
    # a run whose job was killed half-way: files, but no mark of its end
    half = f"{s.root}/run=2"
    runs.write(s.pages().withColumn("page_hash", F.lit("half")), half, "bucket")
    os.remove(f"{half}/_SUCCESS")
    assert held(s) == before
    s.store(pages(spark, (1, 1, "b")), elements(spark, "two", (1, 1)))
    assert held(s)[1, 1] == ("b", 3, ["two"] * 2) and held(s)[2, 1] == before[2, 1]
    s.vacuum()
    assert not os.path.exists(half) and held(s)[1, 1][0] == "b"


POINT = "id bigint, document_id bigint, dense array<float>, content_hash string"


def live_points(c):
    return {r.id: (r.document_id, list(r.dense), r.content_hash) for r in c.points().collect()}


def test_collection_keeps_the_last_write(spark, tmp_path):
    c = collection.Collection(spark, str(tmp_path), 2)
    assert c.points().count() == 0 and c.get_collection_stats().first()[:] == (0, 0) and c.delete_by_document(1) == 0
    assert c.upsert_vectors(spark.createDataFrame([(i, i % 2, [1.0, float(i)], "a") for i in range(6)], POINT)) == 6
    assert c.upsert_vectors(spark.createDataFrame([(1, 1, [0.0, 9.0], "b"), (1, 1, [0.0, 8.0], "c")], POINT).withColumn("k", F.when(F.col("content_hash") == "b", 2).otherwise(1)), "k") == 1
    assert live_points(c)[1] == (1, [0.0, 9.0], "b")
    assert c.delete([2, 77]) == 2 and c.delete_by_document(1) == 3
    assert set(live_points(c)) == {0, 4}
    c.upsert_vectors(spark.createDataFrame([(3, 5, [2.0, 0.0], "d")], POINT))
    # each call wrote its own rows alone
    rows = {n: spark.read.parquet(p).count() for n, p in runs.complete(spark, str(tmp_path), "version").items()}
    assert sorted(rows.values()) == [0, 1, 1, 2, 3, 6]
    before, top = live_points(c), [tuple(r)[:2] for r in c.query([1.0, 0.0], 3).collect()]
    c.compact()
    c.compact()
    assert live_points(c) == before and [tuple(r)[:2] for r in c.query([1.0, 0.0], 3).collect()] == top and len(runs.folders(spark, str(tmp_path), "base")) == 1
    c.vacuum()
    assert live_points(c) == before and not runs.folders(spark, str(tmp_path), "version") and [i for i, _ in top] == [0, 3, 4]
    c.upsert_vectors(spark.createDataFrame([(0, 8, [0.0, 1.0], "e")], POINT))
    c.delete([4])
    assert set(live_points(c)) == {0, 3} and [r.id for r in c.query([0.0, 1.0], 5, {"document_id": 8}).collect()] == [0] and c.get_collection_stats().first()[:] == (2, 2)


def test_filters_look_at_the_last_write_and_reach_the_base(spark, tmp_path):
    c = collection.Collection(spark, str(tmp_path), 1)
    c.upsert_vectors(spark.createDataFrame([(1, 7, [1.0], "a"), (2, 7, [1.0], "a")], POINT))
    c.compact()
    c.upsert_vectors(spark.createDataFrame([(1, 8, [1.0], "b")], POINT))
    assert [r.id for r in c.points({"document_id": 7}).collect()] == [2] and [r.id for r in c.points({"document_id": 8}).collect()] == [1]
    assert "EqualTo(document_id,7)" in c.points({"document_id": 7})._jdf.queryExecution().executedPlan().toString()


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    c = collection.Collection(spark, str(tmp_path), 2)
    c.upsert_vectors(spark.createDataFrame([(1, 1, [1.0, 2.0], "a")], POINT))
    for bad in ([1.0], None):
        with pytest.raises(Exception, match="a vector must have 2 components"):
            c.upsert_vectors(spark.createDataFrame([(1, 1, [3.0, 4.0], "b"), (2, 1, bad, "b")], POINT))
    assert live_points(c) == {1: (1, [1.0, 2.0], "a")}


def test_embedding_is_one_commit(spark, tmp_path):
    c = collection.Collection(spark, str(tmp_path), 1)
    chunks = spark.createDataFrame([(i, i % 2, "t" * i, f"h{i}", ["S"]) for i in range(1, 7)], "id bigint, document_id bigint, content_text string, content_hash string, section_path array<string>")

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        collection.embed_and_upsert(chunks, c, broken, 1)
    assert {r.embedding_status for r in collection.states(chunks, c).collect()} == {"pending"}
    assert collection.embed_and_upsert(chunks, c, queries.length_model, 1) == 3 and collection.embed_and_upsert(chunks, c, queries.length_model, 1) == 0
    assert {(r.id, r.vector_id, r.embedding_status) for r in collection.states(chunks, c).collect()} == {(i, str(i), "embedded") if i % 2 else (i, None, "pending") for i in range(1, 7)}
    assert collection.embed_and_upsert(chunks.withColumn("content_hash", F.when(F.col("id") == 3, "new").otherwise(F.col("content_hash"))), c, queries.length_model) == 4
    r = c.points().where("id = 3").first()
    assert (r.payload.chunk_id, r.payload.section_path, r.payload.content_hash, list(r.sparse["values"])) == (3, ["S"], "new", [1.0])


def test_sparse_terms_count(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,), ("b " * 500 + "c",)], "content_text string")
    got = [r.sparse for r in vectors.sparse_terms(rows).collect()]
    assert [sorted(x["values"]) for x in got] == [[1.0, 2.0], [], [], [1.0, 500.0]] and all(list(x.indices) == sorted(x.indices) for x in got)
    vectors.ensure_collection(spark, "made_once", 3)
    vectors.ensure_collection(spark, "made_once", 3)
    assert {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES made_once").collect()}["dimension"] == "3"
    spark.sql("DROP TABLE made_once")


def run_stream(spark, make, source, schema, at):
    with live.rocksdb(spark):
        rows = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source))
        rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def test_live_limits_over_restarts(spark, tmp_path):
    t0, n = datetime(2024, 1, 1), 240
    rows = [("k%d" % (i % 5), str(t0 + timedelta(seconds=37 * i)), i, i % 7 != 3) for i in range(n)]
    schema = "key string, ts timestamp, seq bigint, failed boolean"
    whole = spark.createDataFrame(rows, "key string, ts string, seq bigint, failed boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(map(tuple, sessions.login_limits(whole, 3, 900).collect()))
    src = tmp_path / "in"
    for part in range(3):  # a restart after each part of two batches
        for half in range(2):
            lo = (2 * part + half) * n // 6
            whole.where(F.col("seq").between(lo, lo + n // 6 - 1)).coalesce(1).write.mode("append").json(str(src))
        got = run_stream(spark, lambda s: live.limited(s, 3, 900, "1 minute"), str(src), schema, str(tmp_path))
    assert sorted(map(tuple, got.select("key", "seq", "failures", "blocked", "retry_after").collect())) == want and any(r[3] for r in want)


def test_live_limits_forget_windows_that_are_over(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "key string, ts timestamp, seq bigint, failed boolean"
    for i, (key, second) in enumerate((("a", 0), ("b", 5000), ("c", 9000))):
        spark.createDataFrame([(key, t0 + timedelta(seconds=second), i, True)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run_stream(spark, lambda s: live.limited(s, 3, 900, "1 second"), str(tmp_path / "in"), schema, str(tmp_path))
    left = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "window").load()
    assert {r.key.key for r in left.collect()} <= {"b", "c"}


def test_live_rotation_over_restarts(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    tokens = [("a", "b"), ("b", "c"), ("z", "y"), ("c", "d"), ("b", "x"), ("d", "e"), ("e", "f")]
    rows = [(f, t0 + timedelta(hours=i), i, t, u, i == 3 and f == 1, False) for f in (1, 2, 3) for i, (t, u) in enumerate(tokens[: 3 + 2 * f])]
    schema = "family bigint, ts timestamp, seq bigint, token string, new_token string, expired boolean, inactive boolean"
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, sessions.rotate_tokens(whole).collect()))
    for lo, hi in ((0, 1), (2, 4), (5, 9)):
        whole.where(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        got = run_stream(spark, live.rotated, str(tmp_path / "in"), schema, str(tmp_path))
    assert sorted(map(tuple, got.select("family", "seq", "token", "outcome", "family_revoked", "replaced_by").collect())) == want
    assert {r[3] for r in want} == {"rotated", "reuse", "unknown", "expired"}


class Counted:
    """Notes each call in a file of its own; fails where told to."""

    def __init__(self, folder, fails):
        self.folder, self.fails = folder, fails

    def describe_figure(self, row):
        if row["text"] in self.fails:
            raise RuntimeError("down")
        with open(f"{self.folder}/{row['text']}", "a") as f:
            f.write("x")
        return f"seen {row['text']}"

    reparse_table = ocr_page = describe_figure


def test_a_call_is_paid_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "CALLS", 3)
    calls, at = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    folder = str(calls)
    t = spark.createDataFrame([(d, k, "other" if k == "t9" else "visual_description", k) for d in (1, 2) for k in (f"t{i}" for i in range(10))], "document_id bigint, element_id string, task_type string, text string")
    t = t.withColumn("key", ledger.key_of(F.col("task_type"), F.col("text")))
    with pytest.raises(ledger.OpenCalls, match="4 of 9"):
        ledger.run(t, lambda: Counted(folder, {"t1", "t4", "t5", "t7"}), at)
    assert sorted(os.listdir(folder)) == ["t0", "t2", "t3", "t6", "t8"] and ledger.results(spark, at).count() == 5
    got = ledger.run(t, lambda: Counted(folder, set()), at).collect()
    assert {(r.document_id, r.text): r.result for r in got} == {(d, f"t{i}"): None if i == 9 else f"seen t{i}" for d in (1, 2) for i in range(10)}
    assert all((calls / f).read_text() == "x" for f in os.listdir(folder)) and len(os.listdir(folder)) == 9
    ledger.run(t, lambda: Counted(folder, {f"t{i}" for i in range(9)}), at)  # nothing is open, so nothing is called


def test_transport_errors_are_tried_again(spark, tmp_path):
    class Flaky:
        calls = 0

        def ocr_page(self, row):
            Flaky.calls += 1
            if Flaky.calls % 2:
                raise TimeoutError("slow")
            return None

        describe_figure = reparse_table = ocr_page

    t = spark.createDataFrame([("k", "full_page_ocr")], "key string, task_type string")
    assert ledger.run(t, Flaky, str(tmp_path / "l")).first().result == ""
    row = spark.read.parquet(str(tmp_path / "l")).first()
    assert (row.attempts, row.error) == (2, None)


def test_results_stand_before_their_job_ends(spark, tmp_path):
    """The driver is killed, or a task dies for good: what other tasks have paid for is kept."""
    folder, at = tmp_path / "c", str(tmp_path / "ledger")
    folder.mkdir()
    here = str(folder)

    class Dies(Counted):
        def describe_figure(self, row):
            if row["text"] == "bad":
                os._exit(1)  # the worker itself
            return super().describe_figure(row)

        reparse_table = ocr_page = describe_figure

    t = spark.createDataFrame([(f"{i:03d}", "full_page_ocr", "bad" if i == 0 else f"t{i}") for i in range(40)], "key string, task_type string, text string")
    old, ledger.CALLS = ledger.CALLS, 4
    try:
        with pytest.raises(Exception):
            ledger.run(t, lambda: Dies(here, set()), at)
        paid = ledger.results(spark, at).count()
        out = ledger.run(t.where("text <> 'bad'"), lambda: Counted(here, set()), at)
    finally:
        ledger.CALLS = old
    assert paid and out.where("result is null").count() == 0


def test_ingest_reads_nothing_that_is_stored(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def take():
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(str(src))
        ingest.ingest(stream, out).awaitTermination()

    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("one")
    take()
    stored = files_below(f"{out}/batch=0")
    assert spark.read.parquet(out).count() == 1 and not any("_checkpoint" in f for f in spark.read.parquet(out).inputFiles())
    aside = {f: open(f, "rb").read() for f in stored}
    for f in stored:
        with open(f, "wb") as o:  # whoever opened it would fail
            o.write(b"no parquet")
    (src / "c.txt").write_text("two")
    (src / "d.txt").write_text("one")
    take()
    for f, content in aside.items():
        with open(f, "wb") as o:
            o.write(content)
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert sorted(bytes(r.content) for r in spark.read.parquet(out).collect()) == [b"one", b"two"]
    take()
    assert spark.read.parquet(out).count() == 2


def test_objects_by_the_thousand(spark, tmp_path):
    store = Objects(spark, f"file://{tmp_path}/store")
    rows = spark.range(300).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit("/o.bin")).alias("key"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("content"))
    assert store.put_all(rows).agg(F.sum("length")).first()[0] == sum(range(300))
    wanted = spark.createDataFrame([(store.uri(f"d/{i}/o.bin"),) for i in (0, 7, 7, 299, 1000)] + [(None,)], "uri string")
    got = sorted(((r.uri, r.found, r.length, r.content) for r in store.contents(wanted).collect()), key=str)
    assert [(f, n, c and len(c)) for _, f, n, c in got] == [(False, None, None), (False, None, None), (True, 0, b""), (True, 299, 299), (True, 7, 7), (True, 7, 7)] or {(u and u[len(store.root) :], f, n) for u, f, n, _ in got} == {(None, False, None), ("/d/0/o.bin", True, 0), ("/d/7/o.bin", True, 7), ("/d/299/o.bin", True, 299), ("/d/1000/o.bin", False, None)}
    assert {r.content for r in store.contents(wanted, content=False).collect()} == {None}
    plan = store.contents(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "loomdoc_objects" in plan
    with pytest.raises(Exception, match="not an object of this store"):
        store.contents(spark.createDataFrame([("file:///etc/hostname",)], "uri string")).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_observed_metrics_are_the_summary(spark, tmp_path):
    x = queries.ingested(spark, SF)
    seen = lifecycle.write(x, str(tmp_path))
    total = lifecycle.summary(x).agg(*[F.sum(c).alias(c) for c in ("n_elements", "n_tasks", "n_entities", "n_chunks")]).first()
    assert (seen["elements"]["n"], seen["tasks"]["n"], seen["entities"]["n"], seen["chunks"]["n"]) == tuple(total)
    assert seen["elements"]["least"] == spark.read.parquet(f"{tmp_path}/elements").agg(F.min("confidence")).first()[0] and seen["tasks"]["mean"] is None


def test_zips_are_strict(spark):
    one = spark.range(1)
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit("x"), F.lit("y"))
    assert [tuple(z) for z in one.select(tx.strict_zip(a, b).alias("z")).first().z] == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="arrays of different lengths: 2, 1"):
        one.select(tx.strict_zip(a, F.array(F.lit("x")))).collect()


def test_first_tasks_are_in_order(spark):
    t = spark.createDataFrame([(1, "full_page_ocr", 1, None), (1, "table_reparse", 2, 9), (1, "table_reparse", 1, 5), (0, "visual_description", 7, 3)], "document_id bigint, task_type string, page_number bigint, element_id bigint")
    assert [(r.document_id, r.task_type, r.element_id) for r in cascade.first_tasks(t, 3).collect()] == [(0, "visual_description", 3), (1, "table_reparse", 5), (1, "table_reparse", 9)]


def test_login_precondition(spark):
    users = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", None)], "id int, username string, is_active boolean")
    asked = spark.createDataFrame([(x,) for x in "abcd"], "username string")
    assert {r.username: r.status for r in sessions.login_status(asked, users).collect()} == {"a": "allowed", "b": "inactive", "c": "inactive", "d": "unknown"}


def test_graph_as_json(spark):
    d = spark.createDataFrame([(1, "M", 1)], "document_id bigint, title string, page_count bigint")
    e = spark.createDataFrame([(1, 1, 1, 1, "paragraph", "p", ["A"], None)], "document_id bigint, element_id bigint, seq bigint, page_number bigint, element_type string, text string, section_path array<string>, parent_id bigint")
    import json

    got = [json.loads(r[0]) for r in graph.as_json(graph.nodes(d, e)).collect()]
    assert {x["node_type"] for x in got} == {"Document", "Page", "Section", "Element"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_later_tables_of_an_ingest_read_the_written_ones(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    drafts = queries.ingested(spark, SF).again(lambda name, df: df).elements.drop("section_path", "parent_id")
    own = spark.createDataFrame(drafts.toArrow(), drafts.schema)
    n = own.count()
    lifecycle.write(lifecycle.ingest(own.mapInArrow(noted, own.schema), queries.manual.pages(spark, SF)), str(tmp_path))
    # the tasks' two branches and the elements, no more
    assert read.value == 3 * n


def test_a_ledger_run_has_few_tasks_and_few_files(spark, tmp_path, monkeypatch):
    """Tasks put CALLS results in place at a time; tasks, files and passes over the questions don't grow with the calls by CALLS."""
    monkeypatch.setattr(ledger, "CALLS", 2)
    read, at = spark.sparkContext.accumulator(0), str(tmp_path / "ledger")
    folder = tmp_path / "c"
    folder.mkdir()
    here = str(folder)

    def noted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    t = spark.createDataFrame([(f"{i:04d}", "full_page_ocr", f"t{i % 50}") for i in range(600)], "key string, task_type string, text string")
    out = ledger.run(t.mapInArrow(noted, t.schema), lambda: Counted(here, set()), at)
    assert read.value == 600 and len(files_below(at)) <= 2 * spark.sparkContext.defaultParallelism
    assert out.where("result = concat('seen ', text)").count() == 600 and ledger.results(spark, at).count() == 600


def test_a_task_tried_again_makes_no_call_twice(spark, tmp_path, monkeypatch):
    """A task dies after some of its calls: what it put in place stands, and the next run makes the others alone."""
    monkeypatch.setattr(ledger, "CALLS", 3)
    folder, at = tmp_path / "c", str(tmp_path / "ledger")
    folder.mkdir()
    here = str(folder)

    class Dies(Counted):
        def ocr_page(self, row):
            if row["text"] == "t0150":
                raise SystemExit(1)  # not an error of the call
            return super().ocr_page(row)

    t = spark.createDataFrame([(f"{i:04d}", "full_page_ocr", f"t{i:04d}") for i in range(300)], "key string, task_type string, text string").coalesce(1)
    with pytest.raises(Exception):
        ledger.run(t, lambda: Dies(here, set()), at)
    paid = {r.key for r in ledger.results(spark, at).collect()}
    assert ledger.run(t, lambda: Counted(here, set()), at).where("result is null").count() == 0
    assert all((folder / f"t{k}").read_text() == "x" for k in paid) and len(os.listdir(folder)) == 300
