"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters over WIDTH bytes slide over overlapping chunks of CHUNK
bytes that cover the whole document; each filter's largest response in a chunk is kept
(max-pooling), the chunks' pooled responses are averaged by their bytes, and a logistic unit
combines them into one probability.

The network is fitted on a bounded sample of labelled documents (SAMPLE of each label, at
most SAMPLE_CHUNKS chunks of each an epoch); of a text of over SAMPLED characters, PIECES chunks go
to the driver, one from each of PIECES equal parts, so that no part of the text is left out of the
draw, at places picked by hash. The sample's weights restore the labels' frequencies.

Defined cases: null and empty texts are one chunk of zero bytes and get that score; very long
texts are scored in slices of SLICE chunks; repeated rows score alike; documents with several
labels count with the least; with no usable label, or only one, the score is that label's (0.5
if there is none); an empty table gives no rows; only doc_id and text are read from docs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import passed

CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 2
DIM, FILTERS = 8, 32
SAMPLE, SAMPLE_CHUNKS = 1500, 4
PIECES = SAMPLE_CHUNKS * 8
SAMPLED = PIECES * CHUNK
SLICE = 256
THRESHOLD = 0.3


def chunks_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(n, CHUNK) bytes, zero-padded, and each chunk's weight: its own bytes over all chunks' bytes."""
    n = 1 + max(0, -(-(len(data) - CHUNK) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    weight = np.full(n, CHUNK, np.float64)
    weight[-1] = max(1, len(data) - (n - 1) * STEP)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1)), weight / weight.sum()


@dataclass
class Network:
    embed: np.ndarray  # (256, DIM), byte 0 is zero
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    constant: np.ndarray

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        e = np.ascontiguousarray(self.embed[chunks]).reshape(len(chunks), CHUNK * DIM)
        n = (CHUNK - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(e, (len(chunks), n, WIDTH * DIM), (e.strides[0], STRIDE * DIM * 4, 4))

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.windows(chunks)
        r = w @ self.filters
        at = r.argmax(1)
        return np.maximum(np.take_along_axis(r, at[:, None, :], 1)[:, 0] + self.bias, 0), at, w

    def score(self, data: bytes) -> float:
        chunks, weight = chunks_of(data)
        total = np.zeros(FILTERS)
        for i in range(0, len(chunks), SLICE):
            part = self.windows(chunks[i : i + SLICE]) @ self.filters
            total += weight[i : i + SLICE] @ np.maximum(part.max(1) + self.bias, 0)
        return float(1 / (1 + np.exp(-np.clip(total @ self.out + self.constant[0], -50, 50))))


def fit(texts: list[bytes | list[bytes]], labels: list[int], priors: tuple[float, float], seed: int = 7, epochs: int = 10) -> Network:
    """Adam on the weighted log loss, over texts or pieces of them; gradients flow through each filter's largest window alone."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    share = np.array([max(1, (y == v).sum()) / len(y) for v in (0, 1)])
    weights = (np.array(priors) / share)[y.astype(int)]
    net = Network(*(x.astype(np.float32) for x in (rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, FILTERS), np.array([np.log(priors[1] / priors[0])]))))
    net.embed[0] = 0
    params = [net.embed, net.filters, net.bias, net.out, net.constant]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    all_chunks = [np.concatenate([chunks_of(x)[0] for x in ([t] if isinstance(t, bytes) else t)]) for t in texts]
    n = (CHUNK - WIDTH) // STRIDE + 1
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 64):
            ids = order[i : i + 64]
            picked = [c if len(c) <= SAMPLE_CHUNKS else c[rng.choice(len(c), SAMPLE_CHUNKS, replace=False)] for c in (all_chunks[j] for j in ids)]
            x, of = np.concatenate(picked), np.repeat(np.arange(len(ids)), [len(c) for c in picked])
            p, at, w = net.pooled(x)
            size = np.bincount(of, minlength=len(ids))
            feat = np.zeros((len(ids), FILTERS))
            np.add.at(feat, of, p)
            feat /= size[:, None]
            prob = 1 / (1 + np.exp(-np.clip(feat @ net.out + net.constant[0], -50, 50)))
            dz = (prob - y[ids]) * weights[ids] / len(ids)
            dp = (dz[of] / size[of])[:, None] * net.out * (p > 0)
            rows = np.arange(len(x))
            best = w[rows[:, None], at]  # (chunks, FILTERS, WIDTH * DIM)
            d_filters = np.einsum("cf,cfk->kf", dp, best)
            d_windows = np.einsum("cf,kf->cfk", dp, net.filters).reshape(-1, DIM)
            where = (at * STRIDE)[:, :, None] + np.arange(WIDTH)
            seen = x[rows[:, None, None], where].reshape(-1)
            d_embed = np.stack([np.bincount(seen, d_windows[:, k], 256) for k in range(DIM)], 1)
            d_embed[0] = 0
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for q, g, a, b in zip(params, (d_embed, d_filters, dp.sum(0), dz @ feat + 1e-4 * net.out, np.array([dz.sum()])), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    assert n == net.windows(np.zeros((1, CHUNK), np.uint8)).shape[1]
    return net


def _pieces(docs: DataFrame) -> DataFrame:
    """doc_id and pieces: the whole text, or PIECES chunks over all of a longer one; of several texts of a doc_id, those of the least hash."""
    text = F.coalesce("text", F.lit(""))
    raw, n = F.encode(text, "UTF-8"), F.octet_length(text)
    part = F.floor(n / PIECES).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(raw, (F.floor(i * (n.cast("long")) / PIECES) + F.pmod(F.xxhash64("doc_id", i), part - CHUNK + 1) + 1).cast("int"), F.lit(CHUNK)))
    pieces = F.when(F.char_length(text) <= SAMPLED, F.array(raw)).otherwise(drawn)
    return docs.select("doc_id", F.struct(F.xxhash64(text).alias("h"), pieces.alias("pieces")).alias("of")).groupBy("doc_id").agg(F.min("of").alias("of")).select("doc_id", "of.pieces")


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Network | float:
    """Fit on at most sample documents of each label, picked by hash of doc_id; a number if labels don't allow a fit."""
    own = labels.filter(usable & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return 0.5 if not n0 + n1 else float(n1 > 0)
    picked = {}
    for value in (0, 1):
        rows = own.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
        picked |= {r["doc_id"]: value for r in rows}
    rows = sorted((r["doc_id"], [bytes(x) for x in r["pieces"]]) for r in _pieces(docs.filter(F.col("doc_id").isin(list(picked)))).collect())
    return fit([t for _, t in rows], [picked[k] for k, _ in rows], (n0 / (n0 + n1), n1 / (n0 + n1)))


def score(docs: DataFrame, model: Network | float, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with score. The network (about 20 KB) goes along with the tasks."""

    def run(batches):
        for batch in batches:
            found = [model if isinstance(model, float) else model.score((x.as_py() or "").encode()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], schema=pa.schema([*list(batch.schema)[:-1], ("score", pa.float64())]))

    source = docs.select(*passed(keep, ("score",)), F.col("text").alias("_scored"))
    return source.mapInArrow(run, source.drop("_scored").schema.add("score", "double"))
