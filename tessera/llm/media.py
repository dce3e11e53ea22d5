"""Media columns: payloads in content-addressed tar shards, rows that point into them.

Every text is padded to a payload of 8-bit samples and stored as a grey PNG
picture, 64 samples wide, in a tar shard in the shared folder. A member's name
is the digest of its payload, and a digest has one place: that of the first member
of its name in any shard, to which all rows with that payload point. Rows carry
digest, shard, offset and length. Metadata columns are filled by range reads
of the picture's header alone; features by range reads of the member.

A task writes a shard under a name of its attempt and renames it at the end to
one that depends on the partition only, so a repeated task leaves the same
shards. Payloads are never shuffled, only digests and places. A task writes a
payload that it knows no place of; so copies in several partitions are written by
each, and all but the first are members that no row points to.

Cases: null and empty texts are one block of zeros; repeated rows point to one
member; a null doc_id is kept; an empty table writes nothing; extra columns are
ignored.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches, doc_texts, shared_path, written

WIDTH = 64
KNOWN = 50_000  # payloads whose places a task keeps in memory
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = len(SIGNATURE) + 25  # with the IHDR chunk
INDEX = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
META = T.StructType([*INDEX.fields, T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """Width and height from the first bytes of a picture."""
    if header[:8] != SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("no picture here")
    return struct.unpack(">II", header[16:24])


def from_png(picture: bytes) -> bytes:
    width, height = png_size(picture)
    at, packed = 8, b""
    while at < len(picture):
        size = struct.unpack(">I", picture[at : at + 4])[0]
        if picture[at + 4 : at + 8] == b"IDAT":
            packed += picture[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't stored here")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Range, sum and an average hash: which of 64 equal stretches lie above the mean."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64).reshape(64, -1)
    sums = samples.sum(1)
    bits = sums * 64 > sums.sum()
    return f"{samples.min()}-{samples.max()}:{sums.sum()}:{np.packbits(bits).tobytes().hex()}"


def store(docs: DataFrame, shard_bytes: int = 256 << 20) -> DataFrame:
    """Writes the shards and returns their index, a row for each document."""
    root = shared_path(docs.sparkSession, "media")
    root = root if "://" in root else f"file://{root}"

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(root)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        at: dict[bytes, tuple[str, int, int]] = {}
        out, number, name = None, 0, ""

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(bytes(1024))
                out.close()
                files.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
            out = None

        for keys, texts in batches(items):
            rows: list[tuple] = []
            for key, text in zip(keys, texts, strict=True):
                data = text.encode()
                payload = payload_of(data)
                digest = hashlib.sha256(payload).digest()
                if digest not in at:
                    if len(at) >= KNOWN:
                        at.clear()
                    picture = to_png(payload)
                    if out is not None and out.tell() + len(picture) > shard_bytes:
                        close()
                    if out is None:
                        name = f"{part:06d}-{number:04d}.tar"
                        number += 1
                        files.create_dir(folder, recursive=True)
                        out = files.open_output_stream(f"{folder}/.{name}.{attempt}")
                    member = tarfile.TarInfo(f"{digest.hex()}.png")
                    member.size = len(picture)
                    out.write(member.tobuf(tarfile.USTAR_FORMAT))
                    at[digest] = name, out.tell(), len(picture)
                    out.write(picture + bytes(-len(picture) % 512))
                rows.append((key, len(data), digest.hex(), f"{root}/{at[digest][0]}", *at[digest][1:]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i in (2, 3) else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], names=INDEX.names)
        close()

    index = written(doc_texts(docs).mapInArrow(run, INDEX), "media-index")
    place = F.struct("shard", "offset", "length")
    several = index.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("digest", "first")
    index = index.join(written(several, "media-copies"), "digest", "left")
    return index.select("doc_id", "n_bytes", "digest", *(F.coalesce(F.col(f"first.{c}"), F.col(c)).alias(c) for c in ("shard", "offset", "length")))


class _Reader:
    """Range reads of shards, one open at a time."""

    def __init__(self) -> None:
        self.shard, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        from pyarrow import fs

        if shard != self.shard:
            files, path = fs.FileSystem.from_uri(shard)
            self.shard, self.file = shard, files.open_input_file(path)
        return self.file.read_at(length, offset)


def with_metadata(index: DataFrame) -> DataFrame:
    """The index with the pictures' width and height, from range reads of their headers alone."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in items:
            sizes = [png_size(reader.read(shard, offset, HEADER)) for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in sizes], pa.int64()) for i in (0, 1))], names=META.names)

    return index.mapInArrow(run, META)


def with_features(meta: DataFrame) -> DataFrame:
    """Digests and features of the payloads as read back."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = _Reader(), {}
        for batch in items:
            rows = []
            for row in batch.to_pylist():
                where = row["shard"], row["offset"]
                if where not in known:
                    picture = reader.read(*where, row["length"])
                    payload = from_png(picture)
                    if len(known) >= KNOWN:
                        known.clear()
                    known[where] = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(picture).hexdigest(), feature_of(payload)
                digest, tail, media, feature = known[where]
                rows.append((row["doc_id"], row["n_bytes"], row["width"] * row["height"], digest, tail, row["length"], media, feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if f.dataType == T.StringType() else pa.int64()) for x, f in zip(zip(*rows, strict=True), RESULT, strict=True)], names=RESULT.names)

    return meta.mapInArrow(run, RESULT)
