"""Compression-distance classification of toxicity.

Zstandard dictionaries are trained (by the library's own training) on whole toxic and on whole ordinary texts: `PARTS` of
each label, on disjoint parts of the fitting rows, behind one larger dictionary of ordinary text that all of them share.
Every window of `WORDS` words of a text is compressed with them. Its saving is the least, over the parts, of the ordinary
length less the toxic length; what a single dictionary holds by chance saves nothing in the others. How many windows
reach each of a ladder of thresholds, and the mean saving, are calibrated to a probability by logistic regression, on
labelled rows that no dictionary has seen.

Fitting takes a bounded sample of labelled rows: at most `SAMPLE` toxic and four times as many ordinary documents, least
hash of doc_id first, whole texts. Dictionaries are trained and windows measured in Spark tasks; the driver gets
dictionaries and one row of features for each calibration text. Scoring covers every whole text, and reads nothing but the text.

Null or empty text: no windows, so the calibrated score of zero counts. Very long texts: whole, window after window. Without
labelled rows of both labels every score is 0. A doc_id with several labels counts as toxic if one says so. Ties and
repeated rows get equal scores. An empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, crc_of_id, documents, text_or_empty, written

SAMPLE, PARTS = 2000, 3
FOLDS, TEST_FOLD, THRESHOLD = 3, 1, 0.7
#: Bytes of a part's dictionary and of the shared one; segment and sub-segment lengths of the training.
PART_BYTES, SHARED_BYTES, SEGMENT, PIECE = 12_288, 60_000, 16, 8
WORDS, STRIDE = 3, 3
#: Stands around each window, since the compressor doesn't match the last bytes of a block.
CARRIER = b"\n#0123456789#\n"
LADDER = (1, 2, 3, 4, 5, 6, 7, 8)
EDGES = b".,!?*$&#%|"
KEPT_WINDOWS = 200_000
SHARED = -1


def windows(text: str) -> list[bytes]:
    words = [w.strip(EDGES) for w in text.lower().encode().split()]
    return [b" ".join(words[k : k + WORDS]) for k in range(0, max(1, len(words) - WORDS + 1), STRIDE)] if words else []


def trained(texts: list[str], size: int) -> bytes:
    """A dictionary of at most `size` bytes of the training's choice; empty if there is too little to train on."""
    samples = [b" " + w.strip(EDGES) + b" " for t in texts for w in three_words(t)]
    if sum(map(len, samples)) < 16 * SEGMENT or len(samples) < 16:
        return b" ".join(samples)
    try:
        return zstandard.train_dictionary(min(size, max(512, sum(map(len, samples)) // 4)), samples, k=SEGMENT, d=PIECE, f=20, level=19).as_bytes()
    except zstandard.ZstdError:  # too few repetitions to choose from
        return b"".join(samples)[-size:]


def three_words(text: str) -> list[bytes]:
    words = [w.strip(EDGES) for w in text.lower().encode().split()]
    return [b" ".join(words[k : k + 3]) for k in range(0, len(words), 3)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=5, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=held)


@dataclass
class Model:
    """pairs: contents of the ordinary and the toxic dictionary of each part; weights of the features, bias first (empty: nothing was learned)."""

    pairs: list[tuple[bytes, bytes]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    _made: tuple | None = None

    def __getstate__(self) -> dict:
        return {"pairs": self.pairs, "weights": self.weights, "_made": None}

    def made(self) -> tuple:
        if self._made is None:
            self._made = ([(compressor(a), compressor(b)) for a, b in self.pairs], {})
        return self._made

    def saving(self, window: bytes) -> int:
        pairs, known = self.made()
        least = known.get(window)
        if least is None:
            x, least = CARRIER + b" " + window + b" " + CARRIER, 99
            for ordinary, toxic in pairs:
                least = min(least, len(ordinary.compress(x)) - len(toxic.compress(x)))
                if least < LADDER[0]:
                    break  # no threshold is reached, whatever the others say
            if len(known) >= KEPT_WINDOWS:
                known.clear()
            known[window] = least
        return least

    def features(self, text: str) -> list[float]:
        saved = np.array([self.saving(w) for w in windows(text)], np.float64)
        counts = [int((saved >= k).sum()) for k in LADDER]
        n = max(1, len(saved))
        return [*(math.log1p(c) for c in counts), *(20.0 * c / n for c in counts), float(np.maximum(saved, 0).sum()) / n]

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w, n = np.zeros(x.shape[1]), len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / n + ridge / n * np.concatenate(([0.0], w[1:]))
        curve = (x * (p * (1 - p))[:, None]).T @ x / n + (ridge / n + 1e-6) * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, part: the fitting rows outside the test fold. Parts from 0 train a dictionary each, part PARTS calibrates. The ids joined are at most 5 * SAMPLE, so they are broadcast."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter((crc_of_id() % FOLDS != TEST_FOLD) & F.col("toxic").isin(0, 1))
    of = lambda k: known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE if k else 4 * SAMPLE)
    ids = of(0).unionByName(of(1)).select(F.col("doc_id").alias("id"), "toxic")
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    # copies of a text are in one part, so that calibration doesn't meet what a dictionary has seen
    part = F.pmod(F.xxhash64("text"), F.lit(2 * PARTS)).cast("int")
    return written(rows.select("text", "toxic", F.least(part, F.lit(PARTS)).alias("part")).dropDuplicates(["text", "toxic"]), "sample")


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels)
    if {r["toxic"] for r in rows.select("toxic").distinct().collect()} != {0, 1}:
        return Model()

    def train(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        toxic, part = key[0].as_py(), key[1].as_py()
        content = trained(table.column("text").to_pylist(), SHARED_BYTES if part == SHARED else PART_BYTES)
        return pa.table({"toxic": pa.array([toxic], pa.int32()), "part": pa.array([part], pa.int32()), "content": pa.array([content], pa.binary())})

    fitting = rows.filter(F.col("part") < PARTS).withColumn("toxic", F.col("toxic").cast("int"))
    both = fitting.unionByName(fitting.filter("toxic = 0").withColumn("part", F.lit(SHARED)))
    found = both.groupBy("toxic", "part").applyInArrow(train, "toxic int, part int, content binary").collect()
    content = {(r["toxic"], r["part"]): bytes(r["content"]) for r in found}
    shared = content.get((0, SHARED), b"")
    model = Model([(shared + content.get((0, k), b"") + CARRIER, shared + content.get((1, k), b"") + CARRIER) for k in range(PARTS)])
    known = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [known.value.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rest = rows.filter(F.col("part") == PARTS).select("text", F.col("toxic").cast("int").alias("toxic")).repartition(8)
    measured = rest.mapInArrow(measure, "toxic int, x array<double>").collect()
    if len({r["toxic"] for r in measured}) == 2:
        x, y = np.array([r["x"] for r in measured]), np.array([r["toxic"] for r in measured], np.float64)
        order = np.lexsort((*x.T, y))
        model.weights = logistic(x[order], y[order]).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(by_rows(run), "doc_id long, score double")
    return out.select("doc_id", (crc_of_id() % FOLDS == TEST_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
