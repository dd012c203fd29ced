"""Sentence pieces of whole texts through the chunk table, against the library on whole texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsefleet.llm import pieces, queries

PATH = queries.pieces_path()
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def cut(texts):
    words = pieces.chunks(pa.array(texts, pa.string()))
    listed = [w.decode() for w in words.array().to_pylist()]
    return [listed[a:b] for a, b in zip(words.first, words.first[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab. \n\t▁é日😀'\x00", max_size=14)), max_size=5))
def test_chunks_have_the_ids_and_text_of_the_whole(texts):
    for text, own in zip(texts, cut(texts)):
        assert [i for c in own for i in MODEL.encode(c)] == MODEL.encode(text or "")
        assert "".join(" " + MODEL.decode(MODEL.encode(c)) for c in own)[1:] == MODEL.decode(MODEL.encode(text or ""))


def test_chunk_places():
    assert cut(["a b", " a  b ", "", None, "   ", "a▁ b c", "a "]) == [["a", "b"], [" a", " b "], [], [], ["   "], ["a▁ b", "c"], ["a "]]


def test_models_whose_pieces_reach_over_markers_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.pieces.add(piece="of▁the", score=-1.0)
    (tmp_path / "crossing.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="reaches over"):
        pieces.check_model(str(tmp_path / "crossing.model"))
    del model.pieces[-1]
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "normal.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="white space"):
        pieces.check_model(str(tmp_path / "normal.model"))


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    long_text = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(200_000))
    rows = [(1, "The cat sat. "), (1, "The cat sat. "), (2, None), (3, ""), (4, "  \n\t "), (5, long_text), (6, "x" * 5000), (None, "no id"), (None, None), (7, "Ünïcödé 日本 😀")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS ids", "'b' AS block", "'c' AS `row`", "'d' AS chunks")
    got = pieces.encoded(frame, PATH, keep=["doc_id", "block"]).collect()
    assert len(got) == len(rows) and {r.block for r in got} == {"b"}
    want = [(i, MODEL.encode(t or ""), MODEL.decode(MODEL.encode(t or ""))) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got], key=key) == sorted(want, key=key)
    assert pieces.encoded(frame.where("false"), PATH).count() == 0


def test_query_equals_the_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_sentence_pieces(spark, data).collect()}
    assert len(got) == len(docs)
    for row in docs:
        ids = MODEL.encode(row.text or "")
        mine = got[row.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    table = pieces.ChunkTable(PATH)
    asked = []

    class Counting:
        def encode(self, texts, **options):
            asked.extend(texts)
            return MODEL.encode(texts, **options)

        def decode(self, ids, **options):
            return MODEL.decode(ids, **options)

    table.model = Counting()
    for texts in (["the cat the dog", "cat the"], ["dog", None, "a cat"]):
        ids, decoded = table.encode(pa.array(texts, pa.string()))
        assert ids.to_pylist() == [MODEL.encode(t or "") for t in texts] and decoded.to_pylist() == [t or "" for t in texts]
    assert sorted(asked) == ["a", "cat", "dog", "the"]
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 3)
    ids, _ = table.encode(pa.array(["the end"]))
    assert ids.to_pylist() == [MODEL.encode("the end")] and len(table.place) == 2
