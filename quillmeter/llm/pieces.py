"""SentencePiece encoding and decoding with forward states shared between words.

A text gets its dummy prefix, white space becomes the mark U+2581, and it is cut into marked
words (marks, then what follows up to the next mark); no piece goes beyond one. The distinct
marked words of a slice are sorted, which lists their trie depth-first; going from one word to
the next, the forward states of the common prefix are kept and only the rest is computed.

A forward state says which piece ends here in the encoding of the prefix up to here:
* unigram models: Viterbi, the piece with the best sum of scores.
* BPE models: scores are merge priorities, and their best sum is not what the model encodes to.
  There the state is the piece that ends the prefix's own merge result. It is the one piece whose
  pair with the state before it merges to just these two, so it too depends on the prefix alone.
  This gives the library's ids; the best sum of scores would not.

Characters outside the vocabulary fall back to byte pieces (or to the unknown id without them).

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 in a text
decodes to a space, as in the library; words of any length are one path of the trie; repeated
rows are encoded alike; an empty table gives no rows; only the columns named are read.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, passed, small_batches

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of text whose words are sorted together; pairs kept by a worker between slices.
SLICE_CHARS = 4_000_000
KEPT_PAIRS = 400_000
#: State before the first piece of a word; pieces are below 2 ** PIECE_BITS.
START, PIECE_BITS = 1 << 24, 22

_models: dict[int, Model] = {}


class Model:
    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with an identity normaliser and a dummy prefix are supported")
        self.unigram = proto.trainer_spec.model_type == 1
        if not self.unigram and proto.trainer_spec.model_type != 2:
            raise ValueError("only unigram and BPE models are supported")
        kind = proto.SentencePiece
        self.texts = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece goes beyond a marked word")
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL}
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        #: Every piece and every suffix of one: its id, or None if it is a suffix only.
        self.ends: dict[str, int | None] = {}
        for x, i in self.ids.items():
            for k in range(1, len(x)):
                self.ends.setdefault(x[k:], None)
        self.ends |= self.ids
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.plain = [x.replace(MARK, " ") for x in self.texts]

    def merged(self, text: str) -> list[int]:
        """BPE by its definition: join the neighbours whose joint piece has the best score, leftmost first.
        For the pairs of pieces that states are tested with; ids below 0 are characters outside the vocabulary."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(x, -1 - ord(x[0])) for x in parts]

    def _text(self, i: int) -> str:
        return self.texts[i] if i >= 0 else chr(-1 - i)

    def _adjacent(self, before: int, piece: int) -> bool:
        """Whether piece stays itself behind before."""
        if before == START:
            return self.merged(self._text(piece)) == [piece]
        return self.merged(self._text(before) + self._text(piece)) == [before, piece]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of the sorted distinct words, by a depth-first walk of their trie."""
        ends, pairs, scores, out = self.ends, self.pairs, self.scores, []
        state: list[int] = [START]  # by depth: the piece that ends there,
        start: list[int] = [0]  # where that piece starts,
        total: list[float] = [0.0]  # and (unigram) the best sum of scores
        last = ""
        for word in words:
            common, most = 0, min(len(last), len(word))
            while common < most and last[common] == word[common]:
                common += 1
            del state[common + 1 :], start[common + 1 :], total[common + 1 :]
            for depth in range(common + 1, len(word) + 1):
                begin = depth - 1
                piece = ends.get(word[begin:depth], -1)
                if self.unigram:
                    best, chosen, of = total[begin] + self.worst, -1 - ord(word[begin]), begin
                    while begin >= 0 and (piece is None or piece >= 0):
                        if piece is not None and total[begin] + scores[piece] > best:
                            best, chosen, of = total[begin] + scores[piece], piece, begin
                        begin -= 1
                        piece = ends.get(word[begin:depth], -1) if begin >= 0 else -1
                    total.append(best)
                else:
                    chosen, of = -1 - ord(word[begin]), begin
                    while begin >= 0 and (piece is None or piece >= 0):
                        if piece is not None:
                            key = (state[begin] << PIECE_BITS) + piece
                            fits = pairs.get(key)
                            if fits is None:
                                fits = pairs[key] = self._adjacent(state[begin], piece)
                            if fits:
                                chosen, of = piece, begin
                                break
                        begin -= 1
                        piece = ends.get(word[begin:depth], -1) if begin >= 0 else -1
                state.append(chosen)
                start.append(of)
            found, depth = [], len(word)
            while depth:
                i = state[depth]
                if i >= 0:
                    found.append(i)
                elif self.bytes:
                    found.extend(self.bytes[b] for b in reversed(chr(-1 - i).encode()))
                else:
                    found.append(self.unknown)
                depth = start[depth]
            out.append(tuple(reversed(found)))
            last = word
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; the distinct new words of all of them go through one trie. Words of these texts are kept for
        the next ones, so a word that every slice has is encoded once, and a worker holds the words of two slices at most."""
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        own = set(itertools.chain.from_iterable(cut))
        words = {w: self.words[w] for w in own & self.words.keys()}
        order = sorted(own.difference(words))
        words.update(zip(order, self.encode_words(order), strict=True))
        self.words = words
        get = words.__getitem__
        return [list(itertools.chain.from_iterable(map(get, found))) for found in cut]

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.byte_of and not self.byte_of.keys().isdisjoint(ids):
            out = []
            for is_byte, run in itertools.groupby(ids, self.byte_of.__contains__):
                out.append(bytes(map(self.byte_of.__getitem__, run)).decode("utf-8", "replace") if is_byte else self._join(run))
            text = "".join(out)
        else:
            text = self._join(ids)
        return text.removeprefix(" ")

    def _join(self, ids) -> str:
        if self.silent:
            ids = [i for i in ids if i not in self.silent]
        return "".join(map(self.plain.__getitem__, ids))


def model_of(data: bytes) -> Model:
    """The worker's model of these bytes, with what it has kept from earlier slices."""
    key = hash(data)
    if key not in _models:
        _models[key] = Model(data)
    return _models[key]


def _slices(column) -> list[list[str | None]]:
    out, size = [[]], 0
    for x in column:
        t = x.as_py()
        if size > SLICE_CHARS:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t or "")
    return out


def encode(docs: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with ids, n_tokens and round_trip (decoding gives the text back).
    The model (under 1 MB) goes along with the tasks."""
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches):
        model = model_of(data)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(batch.num_columns - 1)):
                found = model.encode(texts)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, ends[-1])
                same = [model.decode(i) == (t or "").replace(MARK, " ") for i, t in zip(found, texts, strict=True)]
                extra = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends)), pa.array(same, pa.bool_())]
                kept = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*kept, *extra], names=[*batch.schema.names[:-1], "ids", "n_tokens", "round_trip"])

    source = docs.select(*passed(keep, ("ids", "n_tokens", "round_trip")), F.col("text").alias("_encoded"))
    schema = source.drop("_encoded").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "integer").add("round_trip", "boolean")
    return source.mapInArrow(lean(run), schema)


def decode(rows: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """The columns keep of rows, with the text that their ids stand for (null ids: null)."""
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches):
        model = model_of(data)
        for batch in batches:
            texts = pa.array([None if (i := x.as_py()) is None else model.decode(i) for x in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    source = rows.select(*passed(keep, ("text",)), F.col("ids").alias("_ids"))
    return source.mapInArrow(lean(run), source.drop("_ids").schema.add("text", "string"))
