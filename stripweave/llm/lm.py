"""Language-model scoring by deleted interpolation of trigram, bigram and unigram estimates.

    P3(w | u, v) = L3(b) * c(u, v, w) / c(u, v) + (1 - L3(b)) * P2(w | v)     b: bucket (octave) of the context's count c(u, v)
    P2(w | v)    = L2(b) * c(v, w) / c(v)       + (1 - L2(b)) * P1(w)         b: bucket of c(v)
    P1(w)        = L1    * c(w) / N             + (1 - L1) / (V + 1)

All estimates are maximum-likelihood ones. The weights are learned by expectation-maximisation over all events of
held-out training documents, whose own counts are deleted from the estimates meanwhile; the final estimates count
all training documents.

Counting all n-grams as rows would shuffle several times the input, so n-grams travel packed. Documents are packed once
into chunks of about `CHUNK_BYTES`, one row each; a chunk sends each hash range (of about `RANGE_BYTES` of text) its
sorted distinct n-gram hashes and counts, the range adds them up over all chunks and answers in the same order, only
with what other chunks have. A chunk then scores its documents with the answers to its own n-grams. There are at
most (chunks * ranges) messages and never more than n-grams, since empty ones aren't sent. The held-out events are
written as arrays of their chunk, and each round of EM adds up its expectations by bucket. Nothing but the weights, their
expectations by bucket, N and V passes the driver.

Words are hashed to 64 bits, longer n-grams to as many as keep chance collisions rare in this corpus (44 to 64,
under 1e-4 of them). Null text: the
empty text, which is one end token. Empty training set: N = V = 0. Null doc_id: its id counts as the empty text for the
split. Very long texts: whole, in a chunk of their own if need be. Ties don't matter; repeated rows count as often as
they come and get equal scores. An empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, lean_memory, pieces, text_or_empty, written
from .jaccard import STEP, U, mixed, word_hashes

CHUNK_BYTES, RANGE_BYTES, PARTS = 3 << 20, 8 << 20, 8
FOLDS, TEST_FOLD, EM_FOLDS = 7, 2, 8
BUCKETS, ROUNDS, GAIN = 24, 15, 1e-5
BEGIN, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
LEVELS = (1, 2, 3)
#: Classes of documents: held out for the weights, other training documents, and the test fold.
HELD, KEPT, TEST = 0, 1, 2


def squeezed(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def grown(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def packed_counts(x: np.ndarray) -> bytes:
    """Counts, one byte each; from 255 on the rest follows in eight."""
    return squeezed(len(x).to_bytes(8, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes())


def unpacked_counts(raw: bytes) -> np.ndarray:
    data = grown(raw)
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=8 + n)
    return out


def packed_sorted(x: np.ndarray) -> bytes:
    """Steps between ascending hashes, their bytes by significance, so that the upper ones shrink."""
    return squeezed(np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_sorted(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(grown(raw), np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view(U).reshape(-1), dtype=U)


class Events:
    """The tokens of a chunk's documents (words, then one end for each), and its distinct n-grams with their counts.

    hashes, counts: by level. of: each event's place in them; context: the place of its context in the level below.
    Contexts before the first word are counted as well, once for each document.
    """

    def __init__(self, texts: pa.Array, bits: int):
        words, rows, first = [], [], 0
        for piece in pieces([pa.RecordBatch.from_arrays([texts], ["text"])], limit=1 << 18):
            found, row = word_hashes(piece.column(0))
            words.append(found)
            rows.append(row + first)
            first += len(piece)
        word, row, n = np.concatenate(words), np.concatenate(rows), len(texts)
        counts = np.bincount(row, minlength=n)
        ends = np.cumsum(counts + 1) - 1
        starts = ends - counts
        self.n, self.row = n, np.repeat(np.arange(n, dtype=np.int32), counts + 1)
        token = np.empty(len(word) + n, U)
        is_word = np.ones(len(token), bool)
        is_word[ends] = False
        token[is_word], token[ends] = word, END
        before = np.concatenate(([BEGIN], token[:-1]))
        before[starts] = BEGIN
        two_before = np.concatenate(([BEGIN], before[:-1]))
        two_before[starts] = BEGIN
        drop = U(64 - bits)
        follow = lambda h, x: mixed(h * STEP + x)
        pair_of = lambda u, v: follow(mixed(u), v)
        edge = np.full(n, BEGIN, U)
        self.hashes, self.counts, self.of = [], [], []
        of_level = (lambda: np.concatenate((token, edge)), lambda: np.concatenate((pair_of(before, token), pair_of(edge, edge))) >> drop, lambda: follow(pair_of(two_before, before), token) >> drop)
        for hashes in of_level:  # one level in memory at a time
            distinct, place, count = np.unique(hashes(), return_inverse=True, return_counts=True)
            self.hashes.append(distinct)
            self.counts.append(count.astype(np.int32))
            self.of.append(place.astype(np.int32))
        self.context = []
        for k in (0, 1):  # an event's context is the n-gram before it, or that of the text's edge
            place = self.of[k]
            context = np.concatenate((np.zeros(1, np.int32), place[: len(token) - 1]))
            context[starts] = place[len(token) :]
            self.context.append(context)
            self.of[k] = place[: len(token)]


MESSAGE = "chunk long, kind int, range int, " + ", ".join(f"h{k} binary, c{k} binary" for k in LEVELS)
ANSWER = "chunk long, kind int, range int, " + ", ".join(f"a{k} binary, d{k} binary" for k in LEVELS) + ", n_all long, v_all long, n_kept long, v_kept long"
CHUNK = "chunk long, kind int, ids array<bigint>, sizes array<bigint>, texts binary"


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "double": pa.float64()}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def chunks_of(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Documents packed by kind, written once: ids, sizes in bytes and the texts."""
    fold = crc_of_id()
    kind = F.when(fold % FOLDS == TEST_FOLD, TEST).when(F.floor(fold / FOLDS) % EM_FOLDS == 0, HELD).otherwise(KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        held: dict[int, list[tuple]] = {k: [] for k in (HELD, KEPT, TEST)}
        total, first, n = dict.fromkeys(held, 0), TaskContext.get().partitionId() << 32, 0

        def row(kind: int) -> pa.RecordBatch:
            nonlocal n
            ids, texts = zip(*held[kind], strict=True)
            held[kind], total[kind], n = [], 0, n + 1
            return as_batch([(first + n, kind, list(ids), [len(x) for x in texts], squeezed(b"".join(texts), 3))], CHUNK)

        for batch in pieces(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, k, text in zip(batch.column("doc_id").to_pylist(), batch.column("kind").to_pylist(), texts, strict=True):
                held[k].append((doc_id, text))
                total[k] += len(text)
                if total[k] >= chunk_bytes:
                    yield row(k)
        yield from (row(k) for k in held if held[k])

    return written(docs.select("doc_id", text_or_empty().alias("text"), kind.cast("int").alias("kind")).mapInArrow(run, CHUNK), "chunks")


def events_of(sizes: list[int], texts: bytes, bits: int) -> Events:
    lean_memory()
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(grown(texts))]
    return Events(pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers), bits)


def range_of(hashes: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Number of the range of each hash of so many bits: as its highest 32 bits share out the ranges, so it never falls with the hash."""
    low = max(0, bits - 32)
    return ((hashes >> U(low)) * U(ranges)) >> U(bits - low)


def requests(chunks: DataFrame, ranges: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, kind, sizes, texts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "sizes", "texts")), strict=True):
                e = events_of(sizes, texts, bits)
                places = [range_of(h, 64 if k == 0 else bits, ranges) for k, h in enumerate(e.hashes)]
                met = np.unique(np.concatenate([np.unique(x) for x in places]))  # a chunk's work grows with its n-grams alone
                cuts = [(np.searchsorted(x, met), np.searchsorted(x, met, "right")) for x in places]
                out = []
                for k, r in enumerate(met.tolist()):
                    parts = [slice(begin[k], end[k]) for begin, end in cuts]
                    data = [f(x[p]) for p, h, c in zip(parts, e.hashes, e.counts, strict=True) for f, x in ((packed_sorted, h), (packed_counts, c))]
                    out.append((chunk, kind, r, *data))
                yield as_batch(out, MESSAGE)

    return chunks.select("chunk", "kind", "sizes", "texts").mapInArrow(run, MESSAGE)


def added(hashes: list[np.ndarray], counts: list[np.ndarray], kinds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each message what others add to its own counts (all training documents; held-out ones); the distinct hashes with both totals."""
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    lengths = [len(x) for x in hashes]
    kind, own = np.repeat(kinds, lengths), np.concatenate(counts)
    total, held = (np.bincount(place, own * w, len(distinct)).astype(np.int64) for w in (kind != TEST, kind == HELD))
    cuts = np.cumsum(lengths)[:-1]
    return np.split(total[place] - own * (kind != TEST), cuts), np.split(held[place] - own * (kind == HELD), cuts), distinct, total, held


def answers(asked: DataFrame, ranges: int, bits: int) -> DataFrame:
    """For each message what other chunks have of its n-grams (a), and of them the held-out ones (d, for held-out chunks); chunk -1 has the range's part of N and V."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lean_memory()
        r, kinds = key[0].as_py(), np.array(table.column("kind").to_pylist())
        found: dict[str, list[bytes]] = {}
        totals = np.zeros(4, np.int64)
        for level in LEVELS:
            hashes = [unpacked_sorted(x) for x in table.column(f"h{level}").to_pylist()]
            counts = [unpacked_counts(x) for x in table.column(f"c{level}").to_pylist()]
            width = 64 if level == 1 else bits
            low, high = (r << width) // ranges, ((r + 1) << width) // ranges
            inner = np.array([low + (high - low) * k // PARTS for k in range(1, PARTS)], U)
            cuts = [np.concatenate(([0], np.searchsorted(h, inner), [len(h)])) for h in hashes]
            others, deleted = [[] for _ in hashes], [[] for _ in hashes]
            for p in range(PARTS):  # a part of the range at a time
                part = [slice(c[p], c[p + 1]) for c in cuts]
                a, d, distinct, total, held = added([h[s] for h, s in zip(hashes, part, strict=True)], [c[s] for c, s in zip(counts, part, strict=True)], kinds)
                for k in range(len(hashes)):
                    others[k].append(a[k])
                    deleted[k].append(d[k])
                if level == 1:
                    word = distinct != BEGIN
                    kept = (total - held)[word]
                    totals += [total[word].sum(), (total[word] > 0).sum(), kept.sum(), (kept > 0).sum()]
            found[f"a{level}"] = [packed_counts(np.concatenate(x)) for x in others]
            found[f"d{level}"] = [packed_counts(np.concatenate(x)) if k == HELD else b"" for x, k in zip(deleted, kinds.tolist(), strict=True)]
        rows = [(chunk, kind, r, *(found[f"{c}{level}"][i] for level in LEVELS for c in "ad"), 0, 0, 0, 0) for i, (chunk, kind) in enumerate(zip(table.column("chunk").to_pylist(), kinds.tolist(), strict=True))]
        rows.append((-1, -1, r, *[b""] * (2 * len(LEVELS)), *totals.tolist()))
        return pa.Table.from_batches([as_batch(rows, ANSWER)])

    return asked.groupBy("range").applyInArrow(run, ANSWER)


def all_counts(e: Events, kind: int, answered: pa.Table, deleted: bool) -> list[np.ndarray]:
    """The chunk's n-grams' counts in all training documents; deleted: without the held-out ones."""
    answered = answered.sort_by("range")
    out = []
    for level, own in zip(LEVELS, e.counts, strict=True):
        of = lambda c: np.concatenate([unpacked_counts(x) for x in answered.column(f"{c}{level}").to_pylist()])  # noqa: B023, E731
        others = of("a")
        if len(others) != len(own):
            raise ValueError(f"{len(others)} answers to {len(own)} n-grams")
        out.append(others - of("d") if deleted else others + (own if kind != TEST else 0))
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)  # 0 for a context never seen


def estimates(e: Events, counts: list[np.ndarray], n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Maximum-likelihood estimates of each event by level, and the buckets of its contexts (level 1 has one)."""
    seen = [c[at] for c, at in zip(counts, e.of, strict=True)]
    context = [counts[0][e.context[0]], counts[1][e.context[1]]]
    f = [seen[0] / max(1, n), *(s / np.maximum(1, c) for s, c in zip(seen[1:], context, strict=True))]
    return f, [np.ones(len(seen[0]), np.int64), *map(bucket_of, context)]


@dataclass
class Weights:
    """Mixture weights by level and bucket."""

    by_level: np.ndarray = field(default_factory=lambda: np.full((3, BUCKETS), 0.5))
    floor: float = 1.0

    def mix(self, f: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        """P1, P2, P3."""
        out, p = [], self.floor
        for k in range(3):
            w = self.by_level[k][b[k]]
            p = w * f[k] + (1 - w) * p
            out.append(p)
        return out

    def expected(self, f: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """level, bucket, expected events that the level explains, those that reach it; level 0: log-likelihood and events."""
        p = self.mix(f, b)
        reach, out = np.ones(len(p[2])), [(0, 0, float(np.log(p[2]).sum()), float(len(p[2])))]
        for k in (2, 1, 0):
            taken = reach * self.by_level[k][b[k]] * f[k] / p[k]
            s, n = (np.bincount(b[k], x, BUCKETS) for x in (taken, reach))
            out += [(k + 1, i, float(s[i]), float(n[i])) for i in np.flatnonzero(n).tolist()]
            reach = reach - taken
        return out

    def stepped(self, sums: list[tuple[int, int, float, float]]) -> Weights:
        """The maximisation step; buckets without events take their lower neighbour's weight."""
        new = np.full_like(self.by_level, np.nan)
        for level, bucket, s, n in sums:
            if level and n > 0:
                new[level - 1, bucket] = min(1 - 1e-6, max(1e-6, s / n))
        new[1:, 0] = 0.0  # contexts never seen have no estimate
        for k in range(3):
            last = 0.5
            for i in range(0 if k == 0 else 1, BUCKETS):
                last = new[k, i] = last if math.isnan(new[k, i]) else new[k, i]
        return Weights(new, self.floor)


EVENTS = "f1 binary, f2 binary, f3 binary, b1 binary, b2 binary, b3 binary"


def held_out_events(chunks: DataFrame, answered: DataFrame, n: int, bits: int) -> DataFrame:
    """Estimates and buckets of the held-out events, deleted from all counts; one row for each chunk."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([as_batch([], EVENTS)])
        e = events_of(left.column("sizes")[0].as_py(), left.column("texts")[0].as_py(), bits)
        f, b = estimates(e, all_counts(e, HELD, right, True), n)
        row = (*(squeezed(x.astype("<f8").tobytes()) for x in f), *(squeezed(x.astype(np.uint8).tobytes()) for x in b))
        return pa.Table.from_batches([as_batch([row], EVENTS)])

    held = F.col("kind") == HELD
    rows = chunks.filter(held).select("chunk", "sizes", "texts")
    return rows.groupBy("chunk").cogroup(answered.filter(held).groupBy("chunk")).applyInArrow(run, EVENTS)


def learned(events: DataFrame, v: int) -> Weights:
    """Expectation-maximisation over all held-out events; each round is one aggregate of at most 3 * BUCKETS + 1 rows."""
    weights, before = Weights(floor=1 / (v + 1)), -math.inf
    for _ in range(ROUNDS):
        now = weights

        def run(batches: Iterator[pa.RecordBatch], now: Weights = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    f = [np.frombuffer(grown(row[f"f{k}"]), "<f8") for k in LEVELS]
                    b = [np.frombuffer(grown(row[f"b{k}"]), np.uint8).astype(np.int64) for k in LEVELS]
                    yield as_batch(now.expected(f, b), "level int, bucket int, s double, n double")

        sums = events.mapInArrow(run, "level int, bucket int, s double, n double").groupBy("level", "bucket").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        rows = [tuple(r) for r in sums.select("level", "bucket", "s", "n").collect()]
        fit = next((s / n for level, _, s, n in rows if level == 0 and n > 0), None)
        if fit is None or fit - before < GAIN:
            break
        weights, before = weights.stepped(rows), fit
    return weights


def scored(chunks: DataFrame, answered: DataFrame, n: int, v: int, weights: Weights, bits: int) -> DataFrame:
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([as_batch([], schema)])
        e = events_of(left.column("sizes")[0].as_py(), left.column("texts")[0].as_py(), bits)
        counts = all_counts(e, left.column("kind")[0].as_py(), right, False)
        c = counts[0][e.of[0]]
        of_doc = lambda w: np.bincount(e.row, w, e.n)
        base, mix = np.log10((c + 1) / (n + v + 1)), np.log10(weights.mix(*estimates(e, counts, n))[2])
        columns = [pa.array(left.column("ids")[0].as_py(), pa.int64()), pa.array(np.bincount(e.row, minlength=e.n)), pa.array(of_doc(c > 0).astype(np.int64)), pa.array(of_doc(base)), pa.array(of_doc(mix))]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = chunks.select("chunk", "kind", "ids", "sizes", "texts")
    return rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, schema)


@dataclass
class Model:
    """What the driver holds of a fitted model, and the tables that its parts are in."""

    chunks: DataFrame
    answered: DataFrame
    n: int
    v: int
    weights: Weights
    bits: int


def fit(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> Model:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(total / range_bytes))
    bits = min(64, max(44, total.bit_length() + 13))
    chunks = chunks_of(docs, chunk_bytes)
    answered = written(answers(requests(chunks, ranges, bits), ranges, bits), "answers")
    t = answered.filter("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_all", "v_all", "n_kept", "v_kept")]).first()
    of_chunks = answered.filter("chunk <> -1").drop("n_all", "v_all", "n_kept", "v_kept")
    events = written(held_out_events(chunks, of_chunks, t["n_kept"], bits), "events")
    weights = learned(events, t["v_kept"])
    return Model(chunks, of_chunks, t["n_all"], t["v_all"], Weights(weights.by_level, 1 / (t["v_all"] + 1)), bits)


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    m = fit(docs, chunk_bytes, range_bytes)
    out = scored(m.chunks, m.answered.drop("d1", "d2", "d3"), m.n, m.v, m.weights, m.bits)
    return out.select("doc_id", (crc_of_id() % FOLDS == TEST_FOLD).alias("held_out"), "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
