"""Shared-prefix Viterbi of unigram models against the library, on a unigram model made of the public vocabulary's pieces."""

from __future__ import annotations

from quillmeter.llm import pieces
from quillmeter.llm.queries import TOKENIZERS


def unigram_model() -> bytes:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for rank, piece in enumerate(proto.pieces):  # sums of a few hundred such scores are exact in the library's float32
        piece.score = -4 - rank / 1024
    return proto.SerializeToString()


def test_unigram_scores_equal_the_library(spark):
    import sentencepiece

    data = unigram_model()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Model(data)
    assert own.unigram
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").filter("text <> ''").limit(60).collect()
    texts = [r["text"][:400] for r in rows] + ["é中😀 ﬁ", " two  spaces ", "x" * 300]
    score = lambda ids: sum(own.scores[i] for i in ids)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text)
        # sums tie (scores follow ranks), so ids may differ where sums don't; byte pieces have no score of their own
        plain = [[i for i in x if i not in own.byte_of] for x in (ids, want)]
        assert abs(score(plain[0]) - score(plain[1])) < 1e-3 and len(ids) - len(plain[0]) == len(want) - len(plain[1])
        assert own.decode(ids) == library.decode(want) == text
