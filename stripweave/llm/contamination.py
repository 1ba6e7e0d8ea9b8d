"""Benchmark decontamination by one Aho-Corasick automaton over the windows of all benchmark items.

Texts of documents and items are normalised alike: A-Z lower-cased, words are runs of anything but ASCII characters that are
neither letter nor digit, one space between words and around them. A window is `size` consecutive words of an item, or all
words of a shorter one. The automaton holds every distinct window once, with the items that have it; each text is read once,
and every place where a window ends gives the words that it covers. Words keep their byte offsets in the original text, so
passages come as code points of it.

The windows are sent to all executors, each of whose workers builds the automaton once. Test sets are small, but their size
is measured: beyond `MOST_BYTES` of normalised text the items are dealt to several automata, texts are read once for each, and
what they find is joined by row.

Null text: no words. Texts without words aren't hit; items without words have no window. Very long texts are read in stretches
of `STRETCH` bytes that overlap by one window less a word. Items with the same id (or none: the empty string) count as one;
ties can't arise. Repeated rows are documents of their own. Null doc_id: kept. An empty table gives no rows, an empty
benchmark no hits. Only doc_id and text, item_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, pieces, text_or_empty, written

SIZE = 10
#: Text of the items of one automaton, in bytes; an automaton takes some three hundred times as much.
MOST_BYTES = 1 << 20
STRETCH = 1 << 20
#: ASCII letters (as lower case) and digits stay, other ASCII becomes a space, bytes of other characters stay.
NORMAL = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 128 or chr(b) in LOWER + "0123456789" else 32 for b in range(256))
#: A word of no item.
OTHER = "\0\0"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "row long, doc_id long, n_words long, hit array<struct<start: long, end: long>>, items array<string>, passages array<struct<start: long, end: long>>"
SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit", SPAN), ("items", pa.list_(pa.string())), ("passages", SPAN)])

Runs = list[tuple[int, int]]


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def joined(runs: Iterable[tuple[int, int]]) -> Runs:
    """The union of runs as disjoint ones in order."""
    out: Runs = []
    for begin, end in sorted(runs):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


class Scanner:
    """The automaton of some items, given as id and text."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size, self.automaton = size, ahocorasick.Automaton()
        texts = [(item, words_of(text.encode())) for item, text in items]
        vocabulary = sorted({w for _, words in texts for w in words})
        base = math.isqrt(len(vocabulary)) + 1
        self.letters = {w: chr(1 + k // base) + chr(2 + base + k % base) for k, w in enumerate(vocabulary)}
        holders: dict[str, set[str]] = {}
        for item, words in texts:
            code = [self.letters[w] for w in words]
            for k in range(max(1, len(code) - size + 1) if code else 0):
                holders.setdefault("".join(code[k : k + size]), set()).add(item)
        for window, ids in holders.items():
            self.automaton.add_word(window, (len(window) // 2, frozenset(ids)))
        if holders:
            self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, Runs, list[str]]:
        """Words of a text, runs of hit ones, and the items whose windows occur."""
        marked = raw.translate(NORMAL)
        total, runs, items, at, kept = 0, [], set(), 0, []
        while at < len(marked):
            end = at + STRETCH
            if end < len(marked):
                end = marked.rfind(b" ", at, end) + 1 or marked.find(b" ", end) + 1 or len(marked)
            words = [*kept, *marked[at:end].split()]
            first, total = total - len(kept), total - len(kept) + len(words)
            found = self.stretch(words)
            runs += [(first + a, first + b) for a, b, _ in found]
            items.update(*{ids for _, _, ids in found})
            kept, at = words[max(0, len(words) - self.size + 1) :], end
        return total, joined(runs), sorted(items)

    def stretch(self, words: list[bytes]) -> list[tuple[int, int, frozenset[str]]]:
        if not len(self.automaton):
            return []
        code = "".join([self.letters.get(w, OTHER) for w in words])
        return [((end + 1) // 2 - n, (end + 1) // 2, ids) for end, (n, ids) in self.automaton.iter(code)]


def in_text(raw: bytes, hit: Runs) -> Runs:
    """Runs of words as code points of the original text, from the first word's begin to the last one's end."""
    if not hit:
        return []
    edges = np.diff((np.frombuffer(raw.translate(NORMAL), np.uint8) != 32).astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[begins[a]]), int(points[ends[b - 1]])) for a, b in hit]


#: The scanner that this worker has built last.
BUILT: dict[str, Scanner] = {}


def built(key: str, size: int, items: list[tuple[str, str]]) -> Scanner:
    if key not in BUILT:
        BUILT.clear()
        BUILT[key] = Scanner(items, size)
    return BUILT[key]


def item_parts(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Distinct (id, text) of the items, in parts of about most_bytes of text, or one item; never more than one part at a time."""
    items = written(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text")).distinct(), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // most_bytes))
    for part in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield sorted(tuple(r) for r in mine.collect())


def record(rows: list[tuple]) -> pa.RecordBatch:
    spans = lambda runs: [{"start": a, "end": b} for a, b in runs]
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, (row, doc_id, n, spans(hit), items, spans(passages)), strict=True)) for row, doc_id, n, hit, items, passages in rows], SCHEMA)


def scanned(docs: DataFrame, items: list[tuple[str, str]], size: int) -> DataFrame:
    """What one automaton finds in every text."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    key = hashlib.sha256(repr((size, items)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, row = built(key, size, sent.value), TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            out = []
            for doc_id, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, hit, found = automaton.scan(raw)
                out.append((row, doc_id, n, hit, found, in_text(raw, hit)))
                row += 1
            yield record(out)

    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(run, FOUND)


def merged(found: list[DataFrame]) -> DataFrame:
    """The findings of several automata in the same rows, put together row by row; no text is in them."""
    together = written(found[0], "found")
    for more in found[1:]:
        together = together.unionByName(written(more.filter(F.size("hit") > 0), "found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for batch in batches for r in batch.to_pylist())
        out = []
        for row, parts in groupby(rows, lambda r: r[0]):
            _, doc_ids, ns, hits, items, passages = zip(*parts, strict=True)
            union = lambda lists: joined((x["start"], x["end"]) for runs in lists for x in runs)
            out.append((row, doc_ids[0], ns[0], union(hits), sorted(set().union(*items)), union(passages)))
            if len(out) == 1000:
                yield record(out)
                out = []
        if out:
            yield record(out)

    return together.repartition("row").sortWithinPartitions("row").mapInArrow(run, FOUND)


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, hit (runs of words), items (sorted ids) and passages (code points of the text) of every document."""
    found = [scanned(docs, items, size) for items in item_parts(benchmark, most_bytes)]
    return (found[0] if len(found) == 1 else merged(found)).drop("row")


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most_bytes: int = MOST_BYTES) -> DataFrame:
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    found = matches(docs, benchmark, size, most_bytes).withColumn("n_hit", n_hit)
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "passages")


def op11_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("passages")
