"""Fill-in-the-middle transformation by secondary sort.

A text is cut into lines (units) and, after two of their ends drawn from the document's hash, into prefix, middle and suffix.
Each part becomes pieces of whole units, at most `CHUNK` bytes each (a longer unit is cut), keyed by document and place in
the output. One exchange by document and a sort within its partitions (what repartitionAndSortWithinPartitions does, for
DataFrames) bring the pieces of a document together in the order of its output; a task reads them one after another into an
incremental digest. To restore, the pieces of the output are told apart by its marks and its form alone, sorted again
within the same partitions, and read into a second digest. No task holds a whole document after the cut.

Null text: the empty text. Empty texts and texts that hold a mark stay plain. Null doc_id: hashed as the empty string. Very long
texts stream as pieces. Repeated rows are documents of their own: the key is the row, so no key is hot and there are no ties.
An empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, pieces, text_or_empty

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Places of the parts in the text.
PART = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
RATE, SPM, SEED = 100, 50, 7
CHUNK = 64 << 10
CUT = "row long, doc_id long, place long, body binary, n long, form string, prefix_chars long, middle_chars long"
SORTED = "row long, doc_id long, part int, place long, body binary, n long, form string, prefix_chars long, middle_chars long, output binary"


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def parts(raw: bytes, doc_id: int | None, rate: int, spm: int, seed: int) -> tuple[int, str, list[bytes]]:
    """Units, form, and prefix, middle and suffix (of a plain text: the text alone)."""
    h = draws(doc_id, seed)
    n = raw.count(b"\n") + (raw[-1:] not in (b"", b"\n"))
    if not raw or any(mark in raw for mark in PART) or h[2] % 100 >= rate:
        return n, "plain", [raw]
    ends = np.concatenate(([0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1, [len(raw)]))
    a, b = (int(ends[k]) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    return n, "spm" if h[3] % 100 < spm else "psm", [raw[:a], raw[a:b], raw[b:]]


def chunks(part: bytes, size: int) -> Iterator[bytes]:
    """A part as pieces of whole units where they fit."""
    at = 0
    while at < len(part):
        end = at + size
        if end < len(part):
            end = part.rfind(b"\n", at, end) + 1 or end
        yield part[at:end]
        at = end


def output_order(form: str, found: list[bytes], size: int) -> Iterator[bytes]:
    if form == "plain":
        return chunks(found[0], size)
    prefix, middle, suffix = ([mark, *chunks(part, size)] for mark, part in zip((PREFIX, MIDDLE, SUFFIX), found, strict=True))
    return iter([*prefix, *suffix, *middle] if form == "psm" else [*suffix, *prefix, *middle])


def record_batches(rows: Iterable[tuple], schema: pa.Schema, body: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about `limit` bytes of column `body`."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[body] or b"") + 64
        if size > limit:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def tuples(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
    for piece in pieces(batches, column):
        yield from zip(*[c.to_pylist() for c in piece.columns], strict=True)


def cut(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """The pieces of all documents, and a row with place -1 for each that tells its units, form and the lengths of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            first = TaskContext.get().partitionId() << 40
            for k, (doc_id, raw) in enumerate(tuples(batches, "text")):
                n, form, found = parts(raw, doc_id, rate, spm, seed)
                lengths = (None, None) if form == "plain" else tuple(len(x.decode()) for x in found[:2])
                yield (first + k, doc_id, -1, None, n, form, *lengths)
                for place, body in enumerate(output_order(form, found, size)):
                    yield (first + k, doc_id, place, body, None, form, None, None)

        return record_batches(rows(), arrow(CUT), 3)

    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(run, CUT)


class Digest:
    """Takes pieces one after another; only the state of the hash is held."""

    def __init__(self) -> None:
        self.hash = hashlib.sha256()

    def add(self, body: bytes) -> None:
        self.hash.update(body)

    def value(self) -> bytes:
        return self.hash.hexdigest().encode()


class Text:
    """Takes pieces one after another and joins them: the text itself."""

    def __init__(self) -> None:
        self.held: list[bytes] = []

    def add(self, body: bytes) -> None:
        self.held.append(body)

    def value(self) -> bytes:
        return b"".join(self.held)


def assembled(cut_: DataFrame, sink: Callable[[], Digest | Text] = Digest) -> DataFrame:
    """Pieces in the order of the output, read into a sink. The pieces go on with the part that the marks before them name and
    their place there; the row of part -1 has what the sink took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row, found in groupby(tuples(batches, "body"), lambda r: r[0]):
                out, part, (_, doc_id, _, _, n, form, *lengths) = sink(), 0, next(found)
                for _, _, place, body, *_ in found:
                    out.add(body)
                    if form != "plain" and body in PART:
                        part = PART[body]
                    else:
                        yield (row, doc_id, part, place, body, None, None, None, None, None)
                yield (row, doc_id, -1, -1, None, n, form, *lengths, out.value())

        return record_batches(rows(), arrow(SORTED), 4)

    return cut_.repartition("row").sortWithinPartitions("row", "place").mapInArrow(run, SORTED)


def restored(sorted_: DataFrame, sink: Callable[[], Digest | Text] = Digest) -> DataFrame:
    """The pieces of assembled() sorted again, now by part and place, and read into a sink: the text as it was before."""
    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, found in groupby(tuples(batches, "body"), lambda r: r[0]):
                out, (_, doc_id, _, _, _, *told) = sink(), next(found)
                for r in found:
                    out.add(r[4])
                yield (doc_id, *told, out.value())

        return record_batches(rows(), arrow(ddl), 5)

    return sorted_.sortWithinPartitions("row", "part", "place").mapInArrow(run, ddl)


def transformed(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, form, text: the outputs themselves."""
    found = assembled(cut(docs, rate, spm, seed), Text).filter("part = -1")
    return found.select("doc_id", "form", found["output"].cast("string").alias("text"))


def untransformed(outputs: DataFrame) -> DataFrame:
    """doc_id, text from doc_id, form, text as transformed() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            first = TaskContext.get().partitionId() << 40
            for k, (doc_id, form, raw) in enumerate(tuples(batches, "text")):
                yield (first + k, doc_id, -1, -1, None, None, form, None, None, None)
                spans = [(0, len(raw), 0)]
                if form != "plain":
                    marks = sorted((raw.index(mark), mark) for mark in PART)
                    ends = [at for at, _ in marks[1:]] + [len(raw)]
                    spans = [(at + len(mark), end, PART[mark]) for (at, mark), end in zip(marks, ends, strict=True)]
                for begin, end, part in spans:
                    for place, body in enumerate(chunks(raw[begin:end], CHUNK)):
                        yield (first + k, doc_id, part, place, body, None, None, None, None, None)

        return record_batches(rows(), arrow(SORTED), 4)

    marked = outputs.select("doc_id", "form", text_or_empty().cast("binary").alias("text")).mapInArrow(run, SORTED)
    found = restored(marked.repartition("row"), Text)
    return found.select("doc_id", found["restored"].cast("string").alias("text"))


def report(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    found = restored(assembled(cut(docs, rate, spm, seed)))
    digests = [found[c].cast("string").alias(f"{c}_sha256") for c in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
