from __future__ import annotations

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from rowrinse.llm import pieces


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public model read as a unigram one, without the pieces whose scores are beyond the library's precision."""
    m = pb.ModelProto()
    with open(pieces.default_model(), "rb") as file:
        m.ParseFromString(file.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.score < -1e8:
            p.type = 5
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_same_as_the_library(unigram, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=unigram)
    ours = pieces.Pieces(unigram)
    texts = [t for r in rows for t in (r[1] or "").split("\n")[:50] if len(t) < 2000]
    ids, ends = ours.encode_all([ours.normal(t) for t in texts])
    for text, s, e in zip(texts, ends, ends[1:]):
        found = ids[s:e].tolist()
        assert found == ours.best(ours.normal(text))[0]
        score = lambda x: sum(ours.score.get(ours.pieces[i], 0.0) for i in x)
        wanted = lib.encode(text)
        assert found == wanted or score(found) == score(wanted)
        assert ours.decode(found) == lib.decode(found)


def value(p, ids):
    return sum(p.score.get(p.pieces[i], p.lowest) for i in ids)


@pytest.mark.parametrize("chunk", [40, 300])
def test_chunks_give_the_path_of_the_whole(docs, rows, chunk):
    p = pieces.Pieces(pieces.default_model())
    found = pieces.encode(docs, chunk=chunk).collect()
    assert len(found) == len(rows)
    by_id = {r["id"]: r["ids"] for r in found}
    for r in rows:
        wanted = p.best(p.normal(r[1] or ""))[0]
        # a text of one repeated letter has several best paths
        assert by_id[r[0]] == wanted or value(p, by_id[r[0]]) == value(p, wanted) and p.decode(by_id[r[0]]) == r[1]


def test_round_trip(docs, rows):
    got = pieces.encode_and_decode(docs, chunk=500)
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in got.collect()) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_matrices_combine_associatively():
    p = pieces.Pieces(pieces.default_model())
    text = p.normal("thethethe withinthe andthere " * 6)
    size = [30, 40, 50, len(text) - 120]
    at, ms = 0, []
    for s in size:
        ms.append(p.transfer(text[at : at + s + p.longest], s))
        at += s
    left = pieces.combine(pieces.combine(pieces.combine(ms[0], ms[1]), ms[2]), ms[3])
    right = pieces.combine(ms[0], pieces.combine(ms[1], pieces.combine(ms[2], ms[3])))
    assert (left == right).all()
    assert left[0, 0] == p.best(text)[1]


def test_empty(empty):
    assert pieces.encode_and_decode(empty).count() == 0


def test_ids_of_any_type(spark):
    rows = [(1, "a b  c"), (2, " x"), (2, None), (3, "▁ mark"), (4, "y " * 20)]
    for kind in ("smallint", "decimal(10,2)", "date", "string"):
        key = "date_add(date'2024-01-01', cast(n as int))" if kind == "date" else f"cast(n as {kind})"
        df = spark.createDataFrame(rows, "n int, text string").selectExpr(f"{key} as doc_id", "text")
        for chunk in (pieces.CHUNK, 8):
            out = pieces.encode_and_decode(df, chunk=chunk)
            assert dict(out.dtypes)["doc_id"] == kind
            assert sorted(r["decoded"] for r in out.collect()) == sorted((t or "").replace("▁", " ") for _, t in rows)


def test_words_at_once_equal_words_one_by_one():
    import pyarrow as pa

    p = pieces.Pieces(pieces.default_model())
    texts = ["", " ", "one two", "a  b", " lead", "trail ", "▁", "été 日本語 ñ 🎉 x", "x" * 90, "one two one"]
    ids, ends = p.encode_texts(pa.array(texts))
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == p.encode_all([p.normal(text)])[0].tolist()
    assert p.decode_all(ids, ends).to_pylist() == [t.replace("▁", " ") for t in texts]
    assert p.decode_all(np.array([p.bytes[0xC3]], np.int32), np.array([0, 1])).to_pylist() == ["�"]
