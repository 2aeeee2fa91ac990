"""Language ID by compression.

Each language has a zstandard raw-content dictionary made of sample texts. A text is cut into
blocks, every block is compressed with every dictionary, and the language with the smallest
sum wins; it is rejected when its margin over the next one is narrow. Blocks cover the whole
text, so a long text's own content doesn't drown the dictionary's share. Case doesn't count.
Every block, whatever its size, is compressed behind a lead, a piece of the language's own
dictionary, less what the lead takes alone: a short block by itself would be stored as it is,
whatever the dictionary. Sizes are whole bytes, so short texts may tie; a text that ties is
compressed behind LEADS such pieces, and the sizes are added up.

The dictionaries are the only thing learned: at most SAMPLE_TEXTS texts and DICTIONARY_BYTES
bytes a language (the bound of the sample), picked by hash, copies only once. Of a text longer
than its share, pieces of PIECE bytes are taken at even distances over the whole of it.

Defined cases: null text and text without a letter are `und` with score 0, not accepted; a tie that stays
goes to the first language by name, with score 0; with no labelled text every document is
`und`; of rows that repeat a doc_id, the picked text itself is learned, not another of that id's;
very long texts are blocks like any; repeated rows are scored alike; an empty table gives no rows; columns besides doc_id,
text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lean, passed, small_batches

SAMPLE_TEXTS = 64
DICTIONARY_BYTES = 112_000
BLOCK = 4096
LEVEL = 6
#: Bytes of a lead, and of a piece of a sampled text.
PIECE = 512
LEADS = 16
ONE, ALL = slice(LEADS // 2, LEADS // 2 + 1), slice(None)
#: Least accepted margin: 1 - smallest / second smallest.
MARGIN = 0.01
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, usable: Column) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from rows where usable holds. The texts with the least hash in
    each of SAMPLE_TEXTS bins are taken, so at most that many rows a language reach the driver."""
    small_batches(docs.sparkSession)
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    hashed = rows.select("lang", "doc_id", F.xxhash64("text").alias("h")).withColumn("bin", F.pmod("h", F.lit(SAMPLE_TEXTS)))
    picks = hashed.groupBy("lang", "bin").agg(F.min(F.struct("h", "doc_id")).alias("pick")).select("lang", "pick.doc_id", "pick.h").collect()
    if not picks:
        return {}
    wanted = {(r["doc_id"], r["h"]) for r in picks}
    rows = docs.filter(F.col("doc_id").isin(sorted({i for i, _ in wanted}))).select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = rows.filter(F.col("h").isin(sorted({h for _, h in wanted}))).groupBy("doc_id", "h").agg(F.min("text").alias("text"))
    by_key = {(r["doc_id"], r["h"]): r["text"] for r in rows.collect()}
    found: dict[str, list[bytes]] = {}
    for r in sorted(picks, key=lambda r: (r["lang"], r["doc_id"])):
        found.setdefault(r["lang"], []).append(by_key[r["doc_id"], r["h"]].lower().encode())
    return {lang: _fill(x, DICTIONARY_BYTES) for lang, x in sorted(found.items())}


def _fill(texts: list[bytes], room: int) -> bytes:
    """At most room bytes: short texts whole; what they leave of their equal share goes to the longer ones."""
    out = []
    for i, t in enumerate(sorted(texts, key=lambda t: (len(t), t))):
        out.append(_spread(t, room // (len(texts) - i)))
        room -= len(out[-1])
    return b"\n".join(out)


def _spread(text: bytes, share: int) -> bytes:
    """The text, or pieces of it at even distances, from its beginning to its end."""
    if len(text) <= share:
        return text
    n = max(1, share // PIECE)
    size = min(PIECE, share)
    return b"".join(text[at : at + size] for at in (k * (len(text) - size) // max(1, n - 1) for k in range(n)))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names = sorted(dictionaries)
        self.compressors, self.leads = [], []
        for name in self.names:
            data = dictionaries[name]
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
            pieces = [data[at : at + PIECE] for at in (k * len(data) // LEADS for k in range(LEADS))]
            self.leads.append([(x, len(self.compressors[-1].compress(x))) for x in pieces])

    def sizes(self, data: bytes, leads: slice) -> list[int]:
        """By language: what the blocks of data take behind the leads, added up."""
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(lead + b)) - alone for b in blocks for lead, alone in own[leads]) for c, own in zip(self.compressors, self.leads, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        data = text.lower().encode()
        order = sorted(zip(self.sizes(data, ONE), self.names, strict=True))
        if len(order) > 1 and order[0][0] == order[1][0]:
            order = sorted(zip(self.sizes(data, ALL), self.names, strict=True))
        return order[0][1], max(0.0, min(1.0, 1.0 - order[0][0] / max(1, order[1][0]))) if len(order) > 1 else 1.0


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], margin: float = MARGIN) -> DataFrame:
    """The columns keep of docs, with lang_pred, score and accepted. The dictionaries (DICTIONARY_BYTES a language) go along with the tasks."""

    docs = docs.select(*passed(keep, ("lang_pred", "score", "accepted")), _verdict(dictionaries, margin)(F.col("text")).alias("_verdict"))
    return docs.select("*", "_verdict.lang_pred", "_verdict.score", "_verdict.accepted").drop("_verdict")


def _verdict(dictionaries: dict[str, bytes], margin: float):
    """An Arrow function of the text alone: no other column goes to the workers and back."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @lean
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(dictionaries)
        for column in texts:
            found = [model.predict(x.as_py()) for x in column]
            yield pa.array([{"lang_pred": lang, "score": score, "accepted": lang != UNDETERMINED and score >= margin} for lang, score in found], kind)

    return F.arrow_udf(of, "lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose language is not rejected, with their own columns, whatever these are called."""
    return docs.filter(_verdict(dictionaries, margin)(F.col("text"))["accepted"])
