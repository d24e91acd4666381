"""The ways of seldom and frequent words in op3."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from loomdoc.llm import sentencepiece_lattice as lattice

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("most", [0, 3, 300_000])
def test_seldom_words_are_packed(spark, monkeypatch, most):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["ab cd ab zyxwvut qqq", "ab cd\nef", "", None, "日本 ab 😀 x", "ab cd ab zyxwvut qqq", " ".join(f"w{i}x" for i in range(700))]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    kept = {}

    def stash(df, name, own=lattice.stash):
        kept[name] = own(df, name)
        return kept[name]

    monkeypatch.setattr(lattice, "FREQUENT", most)
    monkeypatch.setattr(lattice, "stash", stash)
    monkeypatch.setattr(lattice, "discard", lambda *_: None)
    got = lattice.documents(docs, PIECES).collect()
    assert sorted((r.doc_id, list(r.ids), r.exact) for r in got) == sorted((i % 5, sp.encode(t or ""), True) for i, t in enumerate(texts * 2) for i in [i % len(texts)])
    # two bytes an id, and four for the place of a seldom word
    ids = {r.word: bytes(r.ids) for r in kept["lattice-lexicon"].collect()}
    assert all(np.frombuffer(x, "<u2").tolist() == sp.encode(w[1:]) for w, x in ids.items() if w.startswith(" ") and w.strip())
    seldom = [bytes(r.x) for r in kept["lattice-seldom"].select("x").collect()]
    assert all(len(x) > 4 and len(x) % 2 == 0 for x in seldom) and bool(seldom) == (most < 300_000)


def test_frequent_words_are_told_by_more_than_their_hash(monkeypatch):
    kind = lattice.id_type(PIECES)
    monkeypatch.setattr(lattice, "word_hashes", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    f = lattice.Frequent(pa.table({"word": ["a", "b", "cc"], "ids": lattice.packed_lists(np.array([1, 1, 2]), np.array([5, 6, 7, 40_000]), kind)}), kind)
    places = f.places(pa.array(["b", "cc", "a", "dd", "eee", "cc"]))
    assert [f.words[int(p)].as_py() if p >= 0 else None for p in places] == [None, "cc", "a", None, None, "cc"]
    assert f.pool[f.start[places[1]] :][: f.length[places[1]]].tolist() == [7, 40_000]
