"""Media columns: archives of lossless 8-bit images, read by a Spark data source.

An archive is a file of members one after the other, their directory (doc_id, offset, length, crc32 of
each), and a footer of fixed size. Tasks write archives whole and rename them when they are complete;
a manifest, written by Spark, lists those that count, so what a lost or repeated task left is never read. The
source plans partitions as byte ranges over the archives' sizes alone. A partition reads its archive's
directory, takes the members that begin in its range, reads each by its offset, retries a member alone if
its bytes do not match, and streams Arrow batches.

A member is a greyscale PNG, 64 samples wide; its pixels are the text's UTF-8 bytes, then zeros up to
a positive multiple of 64. Null text: the empty text, one row of zeros. Null doc_id is kept. Equal texts
have equal values; repeated rows are members of their own. An empty table gives no archives and no rows. A very long text is one member, held whole by the task that writes or reads it. Members
of one archive keep the order in which rows came, so ties can't arise. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import documents, new_path, pieces, text_or_empty

WIDTH = 64
RANGE_BYTES, BATCH_BYTES, RETRIES = 8 << 20, 2 << 20, 3
MAGIC = b"ARCH"
#: Fixed values of the PNG format: signature, and chunk names.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ENTRY, FOOTER = "<qBQQI", "<QQ4s"
ENTRY_SIZE, FOOTER_SIZE = struct.calcsize(ENTRY), struct.calcsize(FOOTER)


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, n_bytes: int) -> bytes:
    """8-bit greyscale, no filter; a text chunk has the number of bytes before the padding."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"Bytes\0%d" % n_bytes) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """The samples of an image that to_png made, and how many of them are no padding."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, body, size, n_bytes = 8, [], (0, 0), 0
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + content):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", content)
        elif kind == b"tEXt" and content.startswith(b"Bytes\0"):
            n_bytes = int(content[6:])
        elif kind == b"IDAT":
            body.append(content)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes(), n_bytes


def feature(samples: bytes) -> str:
    """Mean, deviation, step between neighbours, and the shares of eight grey bands, in thousandths; then an 8 x 8 average hash."""
    x = np.frombuffer(samples, np.uint8)
    rows = x.reshape(-1, WIDTH)
    bands = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    # sums of whole numbers, so equal samples give equal text everywhere
    total, squares, steps = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum()), int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    mean, var = 1000 * total // len(x), 1000 * (squares * len(x) - total * total) // len(x) ** 2
    edges = np.linspace(0, len(rows), 9).astype(int)
    cells = np.array([rows[a : max(b, a + 1)].reshape(-1, 8, 8).sum((0, 2)) * 1000 // max(1, max(b, a + 1) - a) for a, b in zip(np.minimum(edges[:-1], len(rows) - 1), edges[1:], strict=True)])
    bits = (cells > cells.sum() // 64).reshape(-1)
    return f"{mean}:{var}:{1000 * steps // len(x)}:{','.join(map(str, bands))}:{int(''.join('01'[int(b)] for b in bits), 2):016x}"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI with a scheme."""
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder without scheme lies in Spark's default file system, here as for Spark's own readers."""
    if urlsplit(folder).scheme:
        return folder
    base = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return f"{base.rstrip('/')}/{os.path.abspath(folder).lstrip('/')}" if not base.startswith("file:") else f"file://{os.path.abspath(folder)}"


def manifest(folder: str) -> pa.Table:
    """archive, size, members; one row for each archive, read as one dataset."""
    files, path = store(f"{folder}/manifest")
    return ds.dataset(path, schema=pa.schema([("archive", pa.string()), ("size", pa.int64()), ("members", pa.int64())]), filesystem=files, format="parquet").to_table()


def write_archives(docs: DataFrame, folder: str) -> None:
    """Archives in folder/archives, and the manifest (archive, size, members) as Parquet in folder/manifest."""
    folder = qualified(docs.sparkSession, folder)
    files, path = store(f"{folder}/archives")
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(f"{folder}/archives")
        name, at, entries, out = f"{uuid.uuid4().hex}.arch", 0, [], None
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out = out or files.open_output_stream(f"{path}/.{name}", compression=None)
                data = to_png(payload(text), len(text.encode()))
                entries.append(struct.pack(ENTRY, doc_id or 0, doc_id is not None, at, len(data), zlib.crc32(data)))
                out.write(data)
                at += len(data)
        if out is not None:
            out.write(b"".join(entries))
            out.write(struct.pack(FOOTER, at, len(entries), MAGIC))
            out.close()
            files.move(f"{path}/.{name}", f"{path}/{name}")
            size = at + ENTRY_SIZE * len(entries) + FOOTER_SIZE
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([len(entries)], pa.int64())], ["archive", "size", "members"])

    listed = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "archive string, size long, members long")
    listed.write.parquet(f"{folder}/manifest")
    named = set(manifest(folder).column("archive").to_pylist())
    for x in files.get_file_info(fs.FileSelector(path)):  # what lost or repeated tasks left
        if x.base_name not in named:
            files.delete_file(x.path)


def again(files: fs.FileSystem, path: str, at: int, n: int) -> bytes:
    """Bytes read anew, from a file opened for them."""
    with files.open_input_file(path) as f:
        f.seek(at)
        return f.read(n)


class Range(InputPartition):
    def __init__(self, archive: str, size: int, start: int, end: int):
        self.archive, self.size, self.start, self.end = archive, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        """Byte ranges over the archives of the manifest; a row for each archive passes the driver, as in any listing of files."""
        table, out = manifest(self.folder).sort_by("archive"), []
        for archive, size in zip(table.column("archive").to_pylist(), table.column("size").to_pylist(), strict=True):
            out += [Range(archive, size, a, min(size, a + self.range_bytes)) for a in range(0, size, self.range_bytes)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, path = store(f"{self.folder}/archives/{partition.archive}")

        ends, n, magic = struct.unpack(FOOTER, again(files, path, partition.size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != MAGIC:
            raise ValueError(f"{path} is no archive")
        rows: list[tuple] = []
        held = 0
        with files.open_input_file(path) as f:
            f.seek(ends)
            directory = f.read(n * ENTRY_SIZE)
            for doc_id, known, at, length, crc in struct.iter_unpack(ENTRY, directory):
                if not partition.start <= at < partition.end:
                    continue
                f.seek(at)
                data = f.read(length)
                for attempt in range(RETRIES):
                    if zlib.crc32(data) == crc:
                        break
                    time.sleep(0.1 * attempt)
                    data = again(files, path, at, length)
                else:
                    raise OSError(f"{path}: the member at {at} can't be read")
                rows.append((doc_id if known else None, partition.archive, at, data))
                held += length
                if held >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)


MEMBERS = "doc_id long, archive string, offset long, media binary"


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "archive", "offset", "media"])


class Archives(DataSource):
    """spark.read.format("archives").load(folder): doc_id, archive, offset, media."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.read.format("archives").option("rangebytes", range_bytes).load(qualified(spark, folder))


def described(members: DataFrame) -> DataFrame:
    """Digests and features of stored members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples, n_bytes = from_png(media)
                out.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return members.select("doc_id", "media").mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "media")
    write_archives(documents(spark, sf_dir), folder)
    return described(read_archives(spark, folder))
