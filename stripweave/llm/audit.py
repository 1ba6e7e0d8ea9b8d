"""Audit of interacting filters: what every order of them removes, and which texts are duplicates, by radix tries.

Filters A to D look at a text alone. E fails a document whose text some document of a smaller id has. Duplicates are found so:

* Ranges: the bytes of distinct texts are counted by prefix; a prefix with more than a range may hold is counted again by
  longer ones, until no prefix is too heavy or a single text is left. Prefixes in their order are packed into ranges, whose
  first prefixes are the bounds; a text belongs to the range that begins last before it, so equal texts meet.
* A task first puts equal texts of its own rows together: rows of larger ids than the least are duplicates already and travel
  without their text. So a group of copies, however large, sends each text once for a task and stretch of rows.
* Each range inserts its full texts into a compressed trie with the least id at each terminal; traversing it gives
  the flag of every row. Ranges come sorted, so a task holds one trie. Texts with very many copies (at most HOT_TEXTS) are put
  together over salts first, so that no task meets a row of every task.

Each document ends as a mask of the filters it fails; masks are summed by part and label, and all orders are evaluated on those
sums. Labels are joined to masks by doc_id, without texts.

Null text: the empty text. Null lang: the empty string. Ids rank by value, nulls last; rows of the least id aren't duplicates
of each other (ties), repeated rows count each. A doc_id with several label rows counts once if any says 1. Very long texts are
measured in stretches and inserted whole. Empty tables give no rows; without labels nothing is lost. Only doc_id,
text, lang, and doc_id, quality, toxic are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby, permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, text_or_empty, written

#: The filters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
BIT = {x: 1 << k for k, x in enumerate(FILTERS)}
#: Bytes of distinct texts in a range, and the most ranges; ranges grow only beyond the product of both.
RANGE_BYTES, MOST_RANGES = 1 << 20, 500_000
#: Code points of the prefixes of each round.
FIRST, FACTOR = 4, 4
STRETCH = 16 << 20
#: Texts of more copies than either are hot: their rows are dealt over salts first.
HOT_COPIES, HOT_TEXTS, SALTS = 1000, 100_000, 1024
#: A salted range is its number and, from this bit on, the salt plus one.
SALT_BIT = 40
ROW = "range long, text string, doc_id long, part string, mask int, n long"


def own_mask(raw: bytes) -> int:
    """The filters A to D that a text fails."""
    n, distinct, at = 0, set(), 0
    while at < len(raw):
        end = at + STRETCH
        if end < len(raw):
            end = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end)) + 1 or len(raw)
        words = raw[at:end].split()
        n += len(words)
        distinct.update(words)
        at = end
    capitals, symbols = (len(raw) - len(raw.translate(None, x)) for x in (CAPITALS, SYMBOLS))
    points = len(raw) if raw.isascii() else len(raw.decode())
    failed = n < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, symbols > 0
    return sum(bit for bit, fails in zip(BIT.values(), failed, strict=False) if fails)


class Trie:
    """A compressed trie of texts. Nodes are [children by first character, label, least id's rank, rows]; a terminal has rows."""

    def __init__(self) -> None:
        self.root: list = [{}, "", None, None]

    def terminal(self, text: str) -> list:
        """The node at which a text ends; labels are split where it leaves them."""
        node, at = self.root, 0
        while at < len(text):
            child = node[0].get(text[at])
            if child is None:
                child = node[0][text[at]] = [{}, text[at:], None, None]
                return child
            label = child[1]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = common(label, text, at)
            upper = [{label[same]: child}, label[:same], None, None]
            node[0][text[at]] = upper
            child[1] = label[same:]
            node, at = upper, at + same
        return node

    def insert(self, text: str, row: tuple) -> None:
        """row: doc_id and more."""
        node = self.terminal(text)
        if node[3] is None:
            node[2], node[3] = rank(row[0]), [row]
        else:
            node[2] = min(node[2], rank(row[0]))
            node[3].append(row)

    def rows(self) -> Iterator[tuple[bool, tuple]]:
        """All rows, each with whether a smaller id ends at its terminal."""
        waiting = [self.root]
        while waiting:
            children, _, least, found = waiting.pop()
            for row in found or ():
                yield rank(row[0]) > least, row
            waiting.extend(children.values())


def common(label: str, text: str, at: int) -> int:
    """Length of the longest prefix of label that text has at a place, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def rank(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


def prefix_ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES, hot_copies: int = HOT_COPIES) -> tuple[list[str], list[int]]:
    """Bounds of the ranges, about MOST_RANGES at most and as many again for prefixes that fit in no other; and the hashes of hot texts."""
    texts = docs.select(text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    length, light, heavy = FIRST, [], None
    while True:
        here = texts if heavy is None else texts.join(F.broadcast(heavy), F.xxhash64(F.substring("text", 1, length // FACTOR)) == F.col("heavy"), "left_semi")
        each = here.groupBy(F.substring("text", 1, length).alias("prefix"), "hash").agg(F.max(F.octet_length("text")).alias("bytes"), F.count("*").alias("copies"))
        if heavy is None:
            each = written(each, "texts")
            total, n = each.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
            limit = max(range_bytes, total // MOST_RANGES)
            hot = [r[0] for r in each.filter(F.col("copies") > max(hot_copies, n // HOT_TEXTS)).select("hash").collect()]
        sizes = written(each.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "prefixes")
        over = (F.col("bytes") > limit) & (F.col("n") > 1)
        light.append(sizes.filter(~over))
        heavy = sizes.filter(over).select(F.xxhash64("prefix").alias("heavy"))  # at most total / limit numbers, so MOST_RANGES
        if not heavy.limit(1).count():
            break
        length *= FACTOR
    leaves = light[0]
    for more in light[1:]:
        leaves = leaves.unionByName(more)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = limit
        for batch in batches:
            bounds = []
            for prefix, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if filled + size > limit:
                    bounds.append(prefix)
                    filled = 0
                filled += size
            yield pa.RecordBatch.from_arrays([pa.array(bounds, pa.string())], ["bound"])

    packed = leaves.select("prefix", "bytes").repartitionByRange(64, "prefix").sortWithinPartitions("prefix").mapInArrow(pack, "bound string")
    return sorted(r[0] for r in packed.collect()), hot


def measured(docs: DataFrame, bounds: list[str], hot: list[int]) -> DataFrame:
    """Rows with masks of A to D. Equal texts of a task are put together stretch by stretch: rows of the least id have range and
    text, the others are duplicates, without text and with ranges below zero that spread them."""
    sent = docs.sparkSession.sparkContext.broadcast((bounds, frozenset(hot)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (starts, often), task = sent.value, TaskContext.get().partitionId()
        turn, salt = task, (task % SALTS + 1) << SALT_BIT
        for batch in pieces(batches, limit=STRETCH):
            held: dict[tuple[bytes, int], dict[tuple, int]] = {}
            for doc_id, raw, part, text_hash in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                group = held.setdefault((raw, text_hash), {})
                group[doc_id, part] = group.get((doc_id, part), 0) + 1
            rows = []
            for (raw, text_hash), group in held.items():
                least, mask, text = min(rank(i) for i, _ in group), own_mask(raw), raw.decode()
                place = max(0, bisect_right(starts, text) - 1) + (salt if text_hash in often else 0)
                for (doc_id, part), n in group.items():
                    if rank(doc_id) == least:
                        rows.append((place, text, doc_id, part, mask, n))
                    else:
                        turn += 1
                        rows.append((-1 - turn % 4096, None, doc_id, part, mask | BIT["E"], n))
            yield batch_of(rows)

    part = F.coalesce("lang", F.lit("")).alias("part")
    text = text_or_empty()
    return docs.select("doc_id", text.cast("binary").alias("text"), part, F.xxhash64(text).alias("hash")).mapInArrow(run, ROW)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [x.split()[0] for x in ROW.split(", ")])


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with duplicate flags from the trie of each range. A row that is settled has no text; of a salted range, those of the
    least id keep their text and go to the range itself."""

    def settled(place: int, found: Iterator[tuple]) -> Iterator[tuple]:
        if place < 0:
            yield from found
            return
        trie, salted = Trie(), place >> SALT_BIT
        for _, text, *row in found:
            trie.insert(text, (*row, text if salted else None))
        for again, (doc_id, part, mask, n, text) in trie.rows():
            if again:
                yield -1, None, doc_id, part, mask | BIT["E"], n
            else:
                yield place & ((1 << SALT_BIT) - 1), text, doc_id, part, mask, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for batch in pieces(batches):
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        held, size = [], 0
        for place, found in groupby(read(), lambda r: r[0]):
            for row in settled(place, found):
                held.append(row)
                size += len(row[1] or "") + 64
                if size > STRETCH:
                    yield batch_of(held)
                    held, size = [], 0
        yield batch_of(held)

    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(run, ROW)


def masks(docs: DataFrame, range_bytes: int = RANGE_BYTES, hot_copies: int = HOT_COPIES) -> DataFrame:
    """doc_id, part, mask of the filters that fail, n: rows alike."""
    bounds, hot = prefix_ranges(docs, range_bytes, hot_copies)
    found = written(flagged(measured(docs, bounds, hot)), "masks")
    if hot:
        again = flagged(found.filter("text IS NOT NULL"))
        found = found.filter("text IS NULL").unionByName(again)
    return found.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def audit(masks_: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every order of the filters keeps and removes at each step, by part."""
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(c)
    told = labels.groupBy("doc_id").agg(says("quality"), says("toxic"))
    joined = masks_.join(told, "doc_id", "left")
    lost = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("quality", "toxic")]
    sums = joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *lost)
    steps = [("".join(order), k + 1, BIT[x], sum(BIT[y] for y in order[:k])) for order in permutations(filters) for k, x in enumerate(order)]
    names, numbers, bits, befores = ([F.lit(x) for x in column] for column in zip(*steps, strict=True))
    at = lambda values: F.get(F.array(*values), F.col("k"))
    rows = sums.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    rows = rows.select("*", at(names).alias("filter_order"), at(numbers).alias("step"), at(bits).alias("bit"), at(befores).alias("before"))
    earlier, fails = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda when, n, name: F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0)).cast("long").alias(name)
    orders = len(steps) // len(filters)  # a document's filters come first equally often
    share = F.sum(F.when(fails, F.col("n") * F.expr(f"{orders} div bit_count(mask)")).otherwise(0))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~earlier & ~fails, "n", "kept"),
        total(~earlier & fails, "n", "removed"),
        total(earlier & fails, "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(~earlier & fails, "quality", "good_lost"),
        total(~earlier & fails, "toxic", "toxic_lost"),
        share.alias("shapley"),
    )


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
