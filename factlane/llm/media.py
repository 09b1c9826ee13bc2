"""Media columns: payloads as lossless images, content-addressed in tar shards of the shared folder.

``store`` pads every text to whole image rows of 64 RGB pixels, encodes it as an 8-bit PNG and appends it, named by
the payload's SHA-256, to its task's tar shard.  A payload that a task has met is not written again, and the index
keeps one location for each digest, so rows carry (digest, shard, offset, length) and equal payloads share them.  A
member that another task wrote as well stays unreferenced.  Shards get their names from task attempts; the index,
committed as a table, only names those of attempts that counted, so a lost executor leaves at most unused files.

``headers`` fills the metadata columns from range reads of 33 bytes; ``read_back`` decodes whole members.  Both go
through the shards in order of offset.  The shared folder is reached through pyarrow's file systems (file, hdfs,
s3, gs).

A null or empty text is one row of pixels (192 spaces).  Null and repeated ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .storage import fresh, partitions, stored

ROW = 192
#: A shard is closed when it has so many bytes.
SHARD_BYTES = 256 << 20
LEVEL = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature, and the IHDR chunk
WRITTEN = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"
_INDEX = ["digest", "shard", "offset", "length"]


def pad(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """The payload as the samples of an RGB image, 64 pixels wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each after its filter type: none
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(start: bytes) -> dict:
    """The metadata in a file's first HEADER bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    width, height, depth, color = struct.unpack(">IIBB", start[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "channels": {0: 1, 2: 3, 4: 2, 6: 4}[color]}


def decode(data: bytes) -> bytes:
    """The samples of an image whose lines are unfiltered, checked by its own checksums."""
    told, at, packed = header(data[:HEADER]), 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != data[at + 8 + n : at + 12 + n]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(told["height"], -1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read here")
    return lines[:, 1:].tobytes()


class Shard:
    """A tar file that grows member by member."""

    def __init__(self, folder: str):
        self.name = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
        files, path = pfs.FileSystem.from_uri(self.name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size = files.open_output_stream(path), 0

    def add(self, name: str, data: bytes) -> int:
        """The offset of the member's data."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        start = info.tobuf(tarfile.GNU_FORMAT)
        whole = start + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE)
        self.out.write(whole)
        self.size += len(whole)
        return self.size - len(whole) + len(start)

    def close(self) -> None:
        self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        self.out.close()


def _write(folder: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        met: dict[bytes, tuple[str, int, int]] = {}
        for batch in W.blocks(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                payload = pad(raw)
                digest = hashlib.sha256(payload)
                if (place := met.get(digest.digest())) is None:
                    if shard is not None and shard.size > most:
                        shard.close()
                        shard, met = None, {}
                    shard = shard or Shard(folder)
                    media = encode(payload)
                    place = met[digest.digest()] = (shard.name, shard.add(digest.hexdigest() + ".png", media), len(media))
                rows.append((doc, len(raw), digest.hexdigest(), *place))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                             names=["doc_id", "n_bytes", *_INDEX])
        if shard is not None:
            shard.close()

    return write


def store(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, digest) of each row, and the index (digest, shard, offset, length) of each payload."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = stored(rows.mapInArrow(_write(fresh(spark, "media"), shard_bytes), WRITTEN), "media-rows")
    place = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return written.select("doc_id", "n_bytes", "digest"), place.select("digest", "place.*")


class _Reader:
    """Range reads; the shard that was read last stays open."""

    def __init__(self) -> None:
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, n: int) -> bytes:
        if shard != self.name:
            files, path = pfs.FileSystem.from_uri(shard)
            self.name, self.file = shard, files.open_input_file(path)
        return self.file.read_at(n, offset)


def _in_order(index: DataFrame) -> DataFrame:
    return index.repartition(partitions(index.sparkSession), "shard").sortWithinPartitions("shard", "offset")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        told = [header(reader.read(r["shard"], r["offset"], min(HEADER, r["length"]))) for r in batch.to_pylist()]
        extra = [pa.array([t[k] for t in told], pa.int64()) for k in ("width", "height", "bit_depth", "channels")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "width", "height", "bit_depth", "channels"])


def headers(index: DataFrame) -> DataFrame:
    """The index with width, height, bit_depth and channels; reads HEADER bytes of each member."""
    return _in_order(index.select(*_INDEX)).mapInArrow(
        _headers, "digest string, shard string, offset bigint, length bigint, width bigint, height bigint, bit_depth bigint, channels bigint")


def features(payload: bytes) -> str:
    """Moments and the commonest values of the samples, as text."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values = np.arange(256)
    mean = float((count * values).sum() / len(payload))
    spread = float(np.sqrt((count * (values - mean) ** 2).sum() / len(payload)))
    p = count[count > 0] / len(payload)
    top = np.argsort(-count, kind="stable")[:3]
    return f"mean={mean:.3f};std={spread:.3f};entropy={abs(float((p * np.log2(p)).sum())):.3f};top={','.join(map(str, top))}"


_BACK = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
                   ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("samples", pa.string())])


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            media = reader.read(r["shard"], r["offset"], r["length"])
            payload = decode(media)
            rows.append({"digest": r["digest"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                         "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                         "samples": features(payload)})
        yield pa.RecordBatch.from_pylist(rows, schema=_BACK)


def read_back(index: DataFrame) -> DataFrame:
    """What the stored bytes hold: sizes, digests and features of each payload and of its media file."""
    return _in_order(index.select(*_INDEX)).mapInArrow(
        _back, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, samples string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = F.concat_ws("x", "width", "height", "channels", "bit_depth")
    told = headers(index).select("digest", "shard", "offset", "length", F.concat(F.lit("png;"), size, F.lit(";")).alias("kind"))
    both = read_back(index).join(told, "digest")
    return rows.join(both, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
                                            F.concat("kind", "samples").alias("feature"))
