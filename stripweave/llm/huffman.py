"""Token ids in canonical length-limited Huffman segments.

Segments hold whole documents in ascending (doc_id, ids) order. A segment has a header, the
document ids and token counts, a bit-offset checkpoint for every block of `block` tokens, and the
code bits. Blocks are independent: all blocks of a segment are decoded side by side, one table
look-up a token. Segments are rows of Parquet files, so Spark commits them and a lost executor costs
only its tasks. Driver and broadcasts hold one count and one code length for each vocabulary entry.

Null text: the empty text, so only the end id is stored. Null doc_id: sorts first and is kept as
null. Repeated doc_ids sort by their ids; repeated rows are stored as often as they come. An empty
table gives no segments and no rows. Codes of equal counts are ordered by id (ties). A very long text is encoded whole and is a
segment of its own. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkTable, printable_bytes
from .common import by_rows, documents, new_path, text_or_empty, written

if TYPE_CHECKING:
    from tokenizers import Tokenizer

LIMIT, BLOCK, SEGMENT = 16, 256, 1 << 19
MAGIC = b"HUF1"
END_ID = 0
TOKENS = "doc_id long, n_tokens long, packed binary"
SEGMENTS = "part int, segment int, n_docs long, n_tokens long, data binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most `limit` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.int64)
    n, levels, packages = len(order), [], np.zeros(0, np.int64)
    for _ in range(limit):  # each level: the coins and the packages of the level before, by weight
        both = np.concatenate([weights, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < n)
        both = both[sort]
        m = len(both) // 2 * 2
        packages = both[0:m:2] + both[1:m:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_coin in reversed(levels):  # the first `take` items of a level are chosen; coins among them get a bit more
        coins = int(is_coin[:take].sum())
        lengths[:coins] += 1
        take = 2 * (take - coins)
    out[order] = lengths
    return out


class Code:
    """Canonical code: by length, then by id."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths = lengths.astype(np.int64)
        self.codes = np.zeros(len(lengths), np.int64)
        self.symbols = np.zeros(1 << limit, np.uint32)
        self.steps = np.ones(1 << limit, np.uint8)
        self.limit, code, before = limit, 0, 0
        used = np.flatnonzero(lengths)
        for i in used[np.lexsort((used, lengths[used]))].tolist():
            length = int(lengths[i])
            code <<= length - before
            self.codes[i], before = code, length
            low = code << (limit - length)
            self.symbols[low : low + (1 << (limit - length))] = i
            self.steps[low : low + (1 << (limit - length))] = length
            code += 1

    def pack(self, ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks and the bits."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(ids) else 0
        value = self.codes[ids] << (24 - (starts & 7) - lengths)
        at, size = starts >> 3, (total + 7) // 8 + 3
        bits = np.zeros(size, np.float64)
        for k, shift in enumerate((16, 8, 0)):
            bits += np.bincount(at + k, weights=(value >> shift) & 255, minlength=size)
        return starts[::block].astype(np.uint32), bits.astype(np.uint8).tobytes()

    def unpack(self, checkpoints: np.ndarray, bits: bytes, n: int, block: int = BLOCK) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0" * (8 + block * self.limit // 8), np.uint8).astype(np.uint32)
        windows = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        at, out, mask = checkpoints.astype(np.int64), np.empty((block, len(checkpoints)), np.uint32), (1 << self.limit) - 1
        for k in range(block):
            code = windows[np.minimum(at >> 3, len(windows) - 1)] >> (24 - self.limit - (at & 7)) & mask
            out[k] = self.symbols[code]
            at += self.steps[code]
        return out.T.reshape(-1)[:n]


def segment_bytes(code: Code, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    checkpoints, bits = code.pack(ids)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<IQI", len(doc_ids), len(ids), len(checkpoints))
    return head + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + counts.astype("<u4").tobytes() + checkpoints.astype("<u4").tobytes() + bits


def read_segment(code: Code, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, token counts and all ids of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("no segment of this format")
    n_docs, n, n_blocks = struct.unpack_from("<IQI", data, 4)
    at = 20
    doc_ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    known = np.frombuffer(data, np.uint8, n_docs, at := at + 8 * n_docs)
    counts = np.frombuffer(data, "<u4", n_docs, at := at + n_docs)
    checkpoints = np.frombuffer(data, "<u4", n_blocks, at := at + 4 * n_docs)
    ids = code.unpack(checkpoints, data[at + 4 * n_blocks :], n)
    return [x if k else None for x, k in zip(doc_ids, known, strict=True)], counts.astype(np.int64), ids


#: Words that any byte-level pre-tokenizer takes as one piece, whatever its version of Unicode.
ONE_PIECE = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


class Encoder:
    """Distinct chunks through the tokenizers library, many together with a line feed between them,
    which is a piece and an id of its own. Single words go straight to the model, their bytes written
    as its vocabulary writes them; other chunks take the file's whole way."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each core has a task of its own
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, before = data["model"], data["pre_tokenizer"] or {}
        self.library = Tokenizer.from_file(path)
        if isinstance(self.library.model, BPE):  # the library's own cache of words costs more than it saves: the table asks for a chunk once
            merges = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
            self.library.model = BPE(cache_capacity=0, **{k: v for k, v in model.items() if k != "type" and v is not None} | {"merges": merges})
        self.n = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.n <= 1 << 16 else "<u4")
        added = {t.content: np.array([i], self.dtype).tobytes() for i, t in self.library.get_added_tokens_decoder().items()}
        between = self.library.encode("\n", add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.as_text = "".join(x for _, x in sorted((b, x) for x, b in printable_bytes().items()))
        self.words = None
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and data["normalizer"] is None:
            self.words = Tokenizer(self.library.model)
            self.words.pre_tokenizer = Split(self.as_text[10], "isolated")
        self.table = ChunkTable(self.encode_chunks, added)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        words = [i for i, x in enumerate(chunks) if ONE_PIECE.fullmatch(x)] if self.words and self.between is not None else []
        others = sorted({*range(len(chunks))}.difference(words))
        joined = [i for i in others if self.between is not None and chunks[i][0] == " " and len(chunks[i]) > 1 and not chunks[i].isspace()]
        rest = sorted({*others}.difference(joined))
        for i, e in zip(rest, self.library.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        self.put(out, joined, chunks, self.library, str)
        self.put(out, words, chunks, self.words, lambda x: codecs.charmap_decode(x.encode(), "strict", self.as_text)[0])
        return out

    def put(self, out: list[bytes], rows: list[int], chunks: list[str], library: Tokenizer | None, spelled: Callable[[str], str]) -> None:
        step, size = 512, self.dtype.itemsize
        groups = [rows[k : k + step] for k in range(0, len(rows), step)]
        for at in range(0, len(groups), 256):
            some = groups[at : at + 256]
            for g, e in zip(some, library.encode_batch_fast([spelled("\n".join([chunks[i] for i in g])) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                cuts = np.flatnonzero(ids == self.between)
                if len(cuts) != len(g) - 1:
                    raise ValueError("the vocabulary merges line feeds with their neighbours")
                packed = ids.tobytes()
                for i, a, b in zip(g, [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(packed)], strict=True):
                    out[i] = packed[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, packed: the ids of each document and the end id, zstandard-compressed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e, squeeze = encoder(path), zstandard.ZstdCompressor(level=1)
        end = np.array([END_ID], e.dtype).tobytes()
        packed = [x + end for x in e.table.encode(batch.column("text"))]
        counts = [len(x) // e.dtype.itemsize for x in packed]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([squeeze.compress(x) for x in packed], pa.binary())], ["doc_id", "n_tokens", "packed"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(by_rows(run, limit=8 << 20), TOKENS)


def unpacked(batch: pa.RecordBatch, dtype: np.dtype) -> list[np.ndarray]:
    grow = zstandard.ZstdDecompressor()
    return [np.frombuffer(grow.decompress(x), dtype) for x in batch.column("packed").to_pylist()]


def global_counts(tokens: DataFrame, n: int, dtype: np.dtype) -> np.ndarray:
    """Count of each id over all documents; the result has at most n rows, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                total += np.bincount(np.concatenate(unpacked(batch.slice(k, 512), dtype)), minlength=n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("packed").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_segments(tokens: DataFrame, lengths: np.ndarray, dtype: np.dtype, path: str) -> None:
    """Sorts by doc_id over range partitions and writes the segments."""
    shared = tokens.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, segment = Code(shared.value), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) for x in ids], np.int64)
            data = segment_bytes(code, doc_ids, counts, np.concatenate(ids))
            row = [[part], [segment], [len(ids)], [int(counts.sum())], [data]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "n_docs", "n_tokens", "data"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                for doc_id, x in zip(piece.column("doc_id").to_pylist(), unpacked(piece, dtype), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(x)
                    held += len(x)
                    if held >= SEGMENT:
                        yield flush()
                        doc_ids, ids, held, segment = [], [], 0, segment + 1
        if ids:
            yield flush()

    tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "packed").mapInArrow(run, SEGMENTS).write.parquet(path)


def read_documents(spark: SparkSession, path: str, lengths: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all stored documents."""
    shared = spark.sparkContext.broadcast(lengths)
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            for part, segment, data in zip(*(batch.column(c).to_pylist() for c in ("part", "segment", "data")), strict=True):
                doc_ids, counts, ids = read_segment(code, data)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                same = [np.full(len(doc_ids), x, np.int32) for x in (part, segment)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(same[0]), pa.array(same[1]), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "part", "segment", "inside", "n_tokens", "ids_crc32"])

    decoded = segments.select("part", "segment", "data").mapInArrow(run, "doc_id long, part int, segment int, inside long, n_tokens long, ids_crc32 long")
    # prefix sums in two levels: inside a part, then over the parts' totals
    inside = segments.select("part", "segment", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    offsets = inside.join(parts, "part").select("part", "segment", (F.col("base") + F.col("before")).alias("offset"))
    return decoded.join(offsets, ["part", "segment"]).select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, tokenizer: str) -> tuple[str, np.ndarray]:
    """Encodes, counts, writes; the folder of the segments and the code lengths."""
    e = encoder(tokenizer)
    tokens = written(tokenized(docs, tokenizer), "ids")
    lengths = code_lengths(global_counts(tokens, e.n, e.dtype))
    path = new_path(docs.sparkSession, "huffman")
    write_segments(tokens, lengths, e.dtype, path)
    return path, lengths


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, lengths = stored(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path, lengths)
