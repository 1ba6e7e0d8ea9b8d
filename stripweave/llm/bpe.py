"""Byte-level BPE encoding and decoding with contiguous rank arrays.

Each word holds its parts and the ranks of adjacent pairs in contiguous arrays; the least rank is
searched by a scan, its boundary deleted, and the two neighbouring ranks refreshed. Words of one
length are rows of one matrix, so a step serves all of them; every row still at work has lost the
same number of boundaries. Words over `LONG` bytes take a heap over linked parts, with equal results.

Null text: encoded as the empty text. Empty text: no ids. Equal texts, equal ids. Of pairs of one rank the leftmost is merged first
(ties). Very long texts are worked on whole, word by word, and hold memory in proportion to their ids. Null doc_id: kept. Rows are
independent, so repeats and empty tables need nothing; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkTable, printable_bytes
from .common import by_rows, documents, text_or_empty

#: Fixed value: the split pattern of this family of vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
SHORT, LONG = 64, 512


class RankTable:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, as_byte = data["model"]["vocab"], printable_bytes()
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.n = max([*vocab.values(), *self.added.values()]) + 1
        self.dtype = np.dtype("<u2" if self.n <= 1 << 16 else "<u4")
        self.bytes: list[bytes] = [b""] * self.n
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.added else bytes(as_byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in as_byte.items():
            self.of_byte[b] = vocab[c]
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = keys[order], order.astype(np.int32)
        self.byte_pairs = self.ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.key_ranks[at], NONE)

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Words of one length."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        out: list[bytes] = [b""] * len(words)
        ids, ranks, rows = self.of_byte[raw], self.byte_pairs[raw[:, :-1], raw[:, 1:]], np.arange(len(words))
        while ids.shape[1] > 1 and len(rows):
            at = ranks.argmin(1)
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            work = least < NONE
            if not work.all():
                self.put(out, rows[~work], ids[~work])
                ids, ranks, rows, at, least = ids[work], ranks[work], rows[work], at[work], least[work]
                if not len(rows):
                    return out
            row, width = np.arange(len(rows)), ids.shape[1]
            ids[row, at] = self.merged[least]
            kept = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, kept + (kept > at[:, None]), 1)
            if width == 2:
                break
            kept = kept[:, :-1]
            ranks = np.take_along_axis(ranks, kept + (kept >= at[:, None]), 1)
            has = at > 0
            ranks[row[has], at[has] - 1] = self.ranks(ids[row[has], at[has] - 1], ids[row[has], at[has]])
            has = at < width - 2
            ranks[row[has], at[has]] = self.ranks(ids[row[has], at[has]], ids[row[has], at[has] + 1])
        self.put(out, rows, ids)
        return out

    def put(self, out: list[bytes], rows: np.ndarray, ids: np.ndarray) -> None:
        packed, step = ids.astype(self.dtype).tobytes(), ids.shape[1] * self.dtype.itemsize
        for i, row in enumerate(rows.tolist()):
            out[row] = packed[i * step : i * step + step]

    def merge_long(self, word: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        rank = lambda i: int(self.ranks(np.array([ids[i]]), np.array([ids[after[i]]]))[0])
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := rank(k)) < NONE:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return np.array([x for x, y in zip(ids, alive, strict=True) if y], self.dtype).tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, rows in by_length.items():
            if length > LONG:
                found = [self.merge_long(words[i]) for i in rows]
            else:
                step = max(1, (1 << 20) // length)
                found = [x for k in range(0, len(rows), step) for x in self.merge_rows([words[i] for i in rows[k : k + step]])]
            for i, x in zip(rows, found, strict=True):
                out[i] = x
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = regex.compile(SPLIT).findall
        words = [split(x) for x in chunks]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for x in words for w in x))}
        ids = self.encode_words([w.encode() for w in distinct])
        return [ids[distinct[x[0]]] if len(x) == 1 else b"".join(ids[distinct[w]] for w in x) for x in words]

    def chunk_table(self) -> ChunkTable:
        return ChunkTable(self.encode_chunks, {t: np.array([i], self.dtype).tobytes() for t, i in self.added.items()})


@lru_cache(maxsize=2)
def load(path: str) -> tuple[RankTable, ChunkTable, list[bytes]]:
    """Once for each worker process."""
    table = RankTable(path)
    return table, table.chunk_table(), [str(i).encode() for i in range(table.n)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: every whole text's token ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, chunks, _ = load(path)
        packed = chunks.encode(batch.column("text"))
        ids = [np.frombuffer(x, table.dtype).astype(np.int32) for x in packed]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(by_rows(run), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids array<int>; a null array gives the empty text, bytes that are no UTF-8 the replacement character."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = load(path)[0]
        texts = [b"".join(map(table.bytes.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    def rows(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield run(batch.slice(k, 256))

    return tokens.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass, so that ids never leave the task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, chunks, decimal = load(path)
        counts, ids_sha, text_sha = [], [], []
        for packed in chunks.encode(batch.column("text")):
            ids = np.frombuffer(packed, table.dtype).tolist()
            decoded = b"".join(map(table.bytes.__getitem__, ids)).decode("utf-8", "replace")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(by_rows(run), schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
