"""Operator 2: media columns. Payloads lie in tar shards under their digest; rows carry digest, shard, offset, length.

A payload is stored as a greyscale PNG of 8-bit samples, lossless, one row of samples for each 576 bytes. Each task
writes its own shards in the shared folder, under a name that a repeated attempt writes again with the same bytes, and
a payload once. The catalog keeps one place of each digest. Width, height and depth come from reads of the first 33
bytes at an offset; payloads are read by their range only, once for each digest, and never travel through a shuffle.

Defined results: a null text is an empty one; an empty text is 576 bytes 255; equal texts have equal values; repeated
rows are kept as rows and share one stored payload; an empty table gives no rows; no input columns are carried along.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.common import cut, returning, scratch_path, text_of, utf8_rows

UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and the image header chunk
SHARD_BYTES = 64 << 20
PART = 1 << 20
BLOCK = 512
LEVEL = 6


def padded(text: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * ((-len(text)) % UNIT or (0 if text else UNIT))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    height = len(payload) // UNIT
    rows = np.zeros((height, UNIT + 1), np.uint8)  # filter 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, UNIT)
    squeezed = zlib.compress(rows.tobytes(), LEVEL)
    data = b"".join(_chunk(b"IDAT", squeezed[a : a + PART]) for a in range(0, len(squeezed), PART))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, height, 8, 0, 0, 0, 0)) + data + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, parts = HEADER, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, share of each sixteenth of the grey scale in thousandths, and an 8 x 8 average hash of the picture."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    picture = x.reshape(-1, UNIT)
    height = len(picture)
    edge = np.arange(9) * height // 8
    columns = picture.reshape(height, 8, UNIT // 8).sum(2, dtype=np.int64)
    cells = np.array([columns[a : max(b, a + 1)].sum(0) / max(b - a, 1) for a, b in zip(np.minimum(edge[:-1], height - 1), edge[1:])])
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"{UNIT}x{height};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};hist={','.join(map(str, shares))};ahash={bits}"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


class ShardWriter:
    """Tar shards of one task; a payload that the task has met before is not written again."""

    def __init__(self, folder: str, partition: int, attempt: int, most: int = SHARD_BYTES):
        self.fs, self.path = filesystem(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.partition, self.attempt, self.most = partition, attempt, most
        self.number, self.at, self.out = 0, 0, None
        self.places: dict[str, tuple[str, int, int]] = {}

    def name(self) -> str:
        return f"shard-{self.partition:06d}-{self.number:04d}.tar"

    def add(self, digest: str, make) -> tuple[str, int, int]:
        if digest in self.places:
            return self.places[digest]
        data = make()
        if self.out is None:
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.name()}.{self.attempt}"), 0
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        tail = b"\0" * (-len(data) % BLOCK)
        self.out.write(head + data + tail)
        place = (self.name(), self.at + len(head), len(data))
        self.at += len(head) + len(data) + len(tail)
        self.places[digest] = place
        if self.at >= self.most:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * BLOCK))
            self.out.close()
            self.fs.move(f"{self.path}/{self.name()}.{self.attempt}", f"{self.path}/{self.name()}")
            self.number, self.out = self.number + 1, None


STORED = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("digest", T.BinaryType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType())]


def store(df: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes all payloads; (id_column, n_bytes, payload_bytes, digest, shard, offset, length), checkpointed."""
    kind = df.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer = ShardWriter(folder, context.partitionId(), context.taskAttemptId())
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(1))
            raw, edge, rows = raw.tobytes(), offsets.tolist(), []
            for a, b in zip(edge, edge[1:]):
                payload = padded(raw[a:b])
                digest = hashlib.sha256(payload)
                rows.append((b - a, len(payload), digest.digest(), *writer.add(digest.hexdigest(), lambda p=payload: to_png(p))))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[id_column, *[n for n, _ in STORED]])
        writer.close()

    schema = T.StructType([T.StructField(id_column, kind), *[T.StructField(n, t) for n, t in STORED]])
    return cut(df.select(F.col(id_column), text_of(df, text_column).alias("_text")).mapInArrow(returning(run), schema))


def catalog(stored: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): the first place of each digest."""
    first = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    return first.select("digest", "p.shard", "p.offset", "p.length")


def _by_shard(places: DataFrame) -> DataFrame:
    return places.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")


def _ranges(folder: str, batches, limit: int | None):
    """(batch, bytes at each row's range, or its first `limit` bytes); a shard stays open while rows ask for it."""
    fs, path = filesystem(folder)
    name, file = None, None
    for batch in batches:
        shard, offset, length = (batch.column(k).to_pylist() for k in (1, 2, 3))
        data = []
        for s, o, n in zip(shard, offset, length):
            if s != name:
                if file is not None:
                    file.close()
                name, file = s, fs.open_input_file(f"{path}/{s}")
            data.append(file.read_at(min(n, limit) if limit else n, o))
        yield batch, data
    if file is not None:
        file.close()


def probe(places: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, depth), each from a read of HEADER bytes."""

    def run(batches):
        for batch, data in _ranges(folder, batches, HEADER):
            found = [png_header(x) for x in data]
            columns = list(zip(*found)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["digest", "width", "height", "depth"])

    return _by_shard(places).mapInArrow(returning(run), "digest binary, width long, height long, depth long")


def read_payloads(places: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes of each digest hold: (digest, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""

    def run(batches):
        for batch, data in _ranges(folder, batches, None):
            rows = []
            for x in data:
                payload = from_png(x)
                rows.append((hashlib.sha256(payload).digest(), zlib.crc32(payload[-32:]), len(x), hashlib.sha256(x).digest(), feature(payload)))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["digest", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return _by_shard(places).mapInArrow(returning(run), "digest binary, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def media_columns(df: DataFrame, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store, probe and read back: one row for each row of df."""
    folder = folder or scratch_path(df.sparkSession, "media")
    stored = store(df, folder, id_column, text_column)
    places = cut(catalog(stored))
    known = read_payloads(places, folder).join(probe(places, folder), "digest").join(places.select("digest", "shard", "offset"), "digest")
    rows = stored.select(id_column, "n_bytes", "payload_bytes", "digest").join(known, "digest")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select(id_column, "n_bytes", "payload_bytes", text("payload_sha256"), "tail_crc32", "media_bytes", text("media_sha256"), "feature", "shard", "offset", "width", "height", "depth")
