"""The pipeline's stages on a small folder, each against brute force on its own input."""

from __future__ import annotations

import collections

import corpus_pipeline
import public_tokenizers
import sentencepiece
from tests.llm.test_operators import SCHEMA, WORD, brute_components, texts, windows_gone


def test_pipeline(spark, tmp_path):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in texts()], columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5 and SCHEMA
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = docs if docs.inputFiles() else spark.read.parquet(str(tmp_path / "documents.parquet"))  # a stage reads what its predecessor wrote
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        after = [(r.doc_id, r.text if "text" in out.columns else None) for r in out.collect()]
        if stage is not corpus_pipeline.encode:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if stage is corpus_pipeline.keep_good:
            assert {i for i, _ in after} >= {0, 1, 2, 3, 11, 15} and not {i for i, _ in after} & {4, 5, 6, 8, 16}
        if stage is corpus_pipeline.keep_one_of_each:
            want = brute_components(before)
            assert sorted(i for i, _ in after if i is not None) == sorted({i for i, t, _ in before if i is not None and want[i, t]["component_id"] == i})
        if stage is corpus_pipeline.drop_passages:
            gone = windows_gone(before)
            kept = {i: len(WORD.findall(t)) for i, t in after}
            assert all(kept.get(i, 0) == gone[i, t]["n_words"] - gone[i, t]["n_removed"] for i, t, _ in before)
        if stage is corpus_pipeline.mix_sources:
            assert max(collections.Counter(i for i, _ in after).values()) <= 3
            # the order of the files and of the rows in them is that of training: a source's schedule rises or falls
            mixed = [r.source for r in out.select("source", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
        if stage is corpus_pipeline.encode:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            rows = out.orderBy("position").collect()
            assert collections.Counter((r.doc_id, tuple(r.ids)) for r in rows) == collections.Counter((i, tuple(sp.encode(t))) for i, t, _ in before)
            source = {i: s for i, _, s in before}
            assert [r.position for r in rows] == list(range(len(rows))) and [source[r.doc_id] for r in rows] == mixed
        docs = out
    assert docs.where("exact").count() == docs.count() > 0 and stages
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_of_nothing(spark, tmp_path):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, rows in (("empty", []), ("nulls", [(None,) * 5] * 3 + [(1, "", None, "a", 0)])):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.count() == 0 and {"doc_id", "ids", "position"} <= set(out.columns)
