"""Media columns: content-addressed payloads in tar shards.

A payload is the text as UTF-8, padded with zero bytes to a positive multiple of 64,
stored losslessly as an 8-bit greyscale PNG of 64 samples a row. Payloads are stored in tar shards under their digest as name; rows carry
digest, shard, offset and length. Metadata columns come from range reads of the
PNG's header alone; features come from reading the stored bytes back.

The task that reads texts writes their shard, each payload once under its digest, so no text
or image is shuffled. Copies in several shards get one canonical place (the first by shard and
offset); what no row refers to is for compaction. A task that runs again writes the same bytes
again, to a temporary name that is then renamed. A shard is streamed, never gathered.

Defined cases: null text is the empty text, whose payload is 64 zero bytes; equal texts
share one object; repeated rows stay rows; an empty table gives no rows and no shard;
only doc_id and text are read, whatever the other columns are called.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, scratch, skewed_join

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, length, type and body of the first chunk: enough for all metadata.
HEADER_BYTES = 33


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict[str, int]:
    """Metadata from the first HEADER_BYTES bytes of a stored object."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def from_png(stored: bytes) -> bytes:
    """The samples of a stored object, every chunk's checksum verified."""
    meta, at, data = read_header(stored), 8, b""
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(meta["height"], meta["width"] + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, mean, deviation, share of bytes above 127 and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float((p * np.arange(256)).sum())
    dev = float(np.sqrt(max(0.0, (p * (np.arange(256) - mean) ** 2).sum())))
    used = p[p > 0]
    return f"{WIDTH}x{len(payload) // WIDTH};mean={mean:.4f};dev={dev:.4f};high={float(p[128:].sum()):.4f};entropy={float(-(used * np.log2(used)).sum()):.4f}"


def _filesystem(uri: str):
    """The filesystem of a shared folder and the path in it; local paths need no scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}") if not uri.startswith("file:/") else (fs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:"))


def _write_shards(folder: str):
    def run(batches):
        from pyspark import TaskContext

        fs, root = _filesystem(folder)
        name = f"shard-{TaskContext.get().partitionId():06d}.tar"
        part = f"{root}/.{name}-{uuid.uuid4().hex}"
        out, at, seen = None, 0, set()
        for batch in batches:
            digests, offsets, lengths = [], [], []
            for x in batch.column(0):
                payload = payload_of((x.as_py() or "").encode())
                digest = hashlib.sha256(payload).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(part)
                body = to_png(payload)
                info = tarfile.TarInfo(f"{digest.hex()}.png")
                info.size = len(body)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head)
                out.write(body)
                out.write(b"\0" * (-len(body) % tarfile.BLOCKSIZE))
                digests.append(digest)
                offsets.append(at + len(head))
                lengths.append(len(body))
                at += len(head) + len(body) + (-len(body) % tarfile.BLOCKSIZE)
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "shard": pa.array([name] * len(digests), pa.string()), "offset": pa.array(offsets, pa.int64()), "media_bytes": pa.array(lengths, pa.int64())})
        if out is not None:
            out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            out.close()
            fs.move(part, f"{root}/{name}")

    return run


def store(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of docs as tar shards below folder; returns the index digest, shard, offset, media_bytes."""
    written = docs.select("text").mapInArrow(_write_shards(folder), "digest binary, shard string, offset long, media_bytes long")
    return materialize(spark, written, "media-index")


READ_SCHEMA = "digest binary, shard string, offset long, media_bytes long, width int, height int, bit_depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def _read(folder: str, whole: bool):
    def run(batches):
        fs, root = _filesystem(folder)
        name, f = None, None
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["shard"] != name:
                    f = fs.open_input_file(f"{root}/{r['shard']}")
                    name = r["shard"]
                head = f.read_at(HEADER_BYTES, r["offset"])
                r.update({k: v for k, v in read_header(head).items() if k != "colour_type"})
                if whole:
                    stored = head + f.read_at(r["media_bytes"] - HEADER_BYTES, r["offset"] + HEADER_BYTES)
                    payload = from_png(stored)
                    r.update(payload_bytes=len(payload), payload_sha256=hashlib.sha256(payload).hexdigest(), tail_crc32=zlib.crc32(payload[-WIDTH:]), media_sha256=hashlib.sha256(stored).hexdigest(), feature=feature_of(payload))
                else:
                    r.update(payload_bytes=None, payload_sha256=None, tail_crc32=None, media_sha256=None, feature=None)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())

    return run


def _arrow_schema() -> pa.Schema:
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in READ_SCHEMA.split(", "))])


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """Index rows with width, height and bit depth, from header-only range reads."""
    return index.mapInArrow(_read(folder, False), READ_SCHEMA).drop("payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Index rows with metadata and, from the stored bytes, digests and features."""
    return index.mapInArrow(_read(folder, True), READ_SCHEMA)


def members(folder: str, shard: str) -> list[tuple[str, bytes]]:
    """Names and bytes of one shard, by the tar format alone (for checks)."""
    fs, root = _filesystem(folder)
    with fs.open_input_file(os.path.join(root, shard)) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
        return [(m.name, t.extractfile(m).read()) for m in t.getmembers()]


def media_columns(spark: SparkSession, docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs' doc_id with n_bytes and the media columns of its payload.

    The index is read where it lies, in the order of its shards. Copies join one small index row each; rows of a
    hot digest aren't shuffled."""
    folder = folder or scratch(spark, "media")
    stored = read_back(store(spark, docs, folder), folder)
    place = F.struct("shard", "offset", *[c for c in stored.columns if c not in ("digest", "shard", "offset")])
    features = materialize(spark, stored.groupBy("digest").agg(F.min(place).alias("m")).select("digest", "m.*"), "media-features")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    padding = F.when(F.length("raw") == 0, WIDTH).otherwise(F.pmod(-F.length("raw"), F.lit(WIDTH)))
    zeros = F.expr(f"unhex(repeat('00', {WIDTH}))")
    keyed = docs.select("doc_id", raw.alias("raw")).select("doc_id", F.length("raw").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.concat("raw", F.substring(zeros, F.lit(1), padding)), 256)).alias("digest"))
    keyed = materialize(spark, keyed, "media-digests")
    return skewed_join(keyed, features, ["digest"]).withColumn("digest", F.lower(F.hex("digest")))
