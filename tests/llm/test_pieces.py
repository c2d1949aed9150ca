"""Streaming Viterbi against all segmentations, against the library on the same scores, and as a round trip."""

import itertools
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from kilnspark.llm import pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.vocabulary_path())


TEXTS = ["Hello world", "  two  spaces ", "日本語テスト", "", "naïve\ttab\nline x", "x" * 700, "a,b.c! (d) don't 'll \"q\" e-mail www.x.com/a_b", "ÀÉ ß 😀 \x00 é", " ", "\n\n", "the " * 50]


def test_round_trip(codec):
    for t in TEXTS:
        assert codec.decode(codec.encode(t)) == t


def test_chunks_give_what_the_whole_gives(codec):
    rng = np.random.default_rng(4)
    for t in [*TEXTS, "aaaaabbbbb" * 90, "the quick brown fox " * 40]:
        marked, out, at = (pieces.BLANK + t.replace(" ", pieces.BLANK)) if t else "", [], 0
        stream = pieces.StreamingViterbi(codec.v)
        longest = 0
        while at < len(marked):
            n = int(rng.integers(1, 90))
            out += stream.push(marked[at : at + n])
            at += n
            longest = max(longest, len(stream.text))
        out += stream.finish()
        assert out == np.frombuffer(codec.encode(t), "<u4").tolist()
        if "the" in t:
            assert longest < 200  # what is final does not stay


def test_best_of_all_segmentations(codec):
    table, unknown = codec.v.table, codec.v.unknown
    for word in ["▁there", "▁ations", "▁日本x", "▁▁▁a", "thing", "▁a\tb"]:
        best = None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            bounds = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            parts = [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            if all(table.get(p) or len(p) == 1 for p in parts):
                score = sum(table[p][0] if table.get(p) else unknown for p in parts)
                best = score if best is None else max(best, score)
        stream = pieces.StreamingViterbi(codec.v)
        stream.push(word)
        stream._advance(len(word))
        assert stream.best[len(word)] == best


def test_equal_to_the_library_on_the_same_scores(spark, tmp_path):
    """The file's blanks weigh a billion, beyond single precision; with finite weights the library's own Viterbi is exact too."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.vocabulary_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000) / 64
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Codec(str(path))
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    lines = [line[:400] for t in texts for line in t.split("\n")] + TEXTS
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in lines] == [library.encode(t) for t in lines]


def test_report(spark, codec):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (3, "", "x"), ((1 << 60) + 1, "big ▁ id", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r["doc_id"], r["n_chars"], r["n_ids"], r["ids_crc32"], r["round_trip"]) for r in pieces.pieces_report(frame).collect()}
    want = set()
    for i, t, _ in rows:
        ids = codec.encode(t or "")
        want.add((i, len(t or ""), len(ids) // 4, zlib.crc32(ids), True))
    assert got == want and pieces.pieces_report(frame).count() == len(rows)
    assert pieces.pieces_report(frame.limit(0)).count() == 0
    encoded = pieces.encode_documents(frame, pieces.vocabulary_path())
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, pieces.vocabulary_path()).where(F.col("doc_id") < 100).collect()}
    assert back == dict(enumerate(TEXTS))
