"""The pipeline's texts get their places in the order of the files without a shuffle."""

from __future__ import annotations

import corpus_pipeline


def test_texts_are_numbered_where_they_are(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id bigint, text string").repartition(4).write.parquet(path)
    docs = corpus_pipeline.in_file_order(spark.read.parquet(path), "place")
    sizes = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in docs._jdf.queryExecution().executedPlan().toString()
        rows = docs.orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sizes)
    assert [r.place for r in rows] == list(range(40))
    in_files = spark.read.parquet(path).select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in in_files]
