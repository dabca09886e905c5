"""Quality classifier: compressed sizes under dictionaries built from good and from bad text."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import documents, fold, labelled, rows_of, stored, table

#: Labelled rows to learn from; bytes of whole texts of each class that build its dictionary; bytes of a dictionary.
LABELLED, DICTIONARY_TEXT, DICTIONARY_BYTES = 20_000, 6 << 20, 64 << 10
#: A text is compressed in pieces of this size, so that the dictionary tells in long texts too.
PIECE, LEVEL = 2048, 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float]
    own: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "own": {}}

    def sizes(self, text: bytes) -> tuple[int, int]:
        """Compressed bytes under the good and under the bad dictionary."""
        if not self.own:
            self.own = {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=_prepared(d), write_content_size=False, write_checksum=False, write_dict_id=False) for k, d in (("good", self.good), ("bad", self.bad))}
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return tuple(sum(len(c.compress(p)) for p in pieces) for c in (self.own["good"], self.own["bad"]))

    def inputs(self, text: bytes) -> list[float]:
        """What is calibrated: the size difference a byte, that difference for all of the text (a short text tells less), the compressed share."""
        if not text:
            return [0.0, 0.0, 0.0]
        good, bad = self.sizes(text)
        return [20 * (bad - good) / len(text), float(np.clip((bad - good) / 50, -20, 20)), min(good, bad) / len(text)]

    def score(self, text: bytes) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.inputs(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _prepared(data: bytes) -> zstandard.ZstdCompressionDict:
    prepared = zstandard.ZstdCompressionDict(data)
    prepared.precompute_compress(level=LEVEL)
    return prepared


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; raw text where there is too little to train on."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(pieces) or b"no text to learn from ")[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Weights, intercept first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> QualityModel:
    """Dictionaries and calibration from at most bound labelled rows outside the held-out fold.

    One half of the rows, by a hash of the id, builds the dictionaries, from whole texts until DICTIONARY_TEXT bytes of a class are
    gathered; the other half calibrates, so that no text is scored by a dictionary that holds it.
    """
    chosen = stored(labelled(labels, "quality", bound))
    sample = documents(docs).join(F.broadcast(chosen), "doc_id")
    sample = stored(sample.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")))
    built = {}
    for label in (0, 1):
        texts, size = [], 0
        for row in sample.where((F.col("half") == 0) & (F.col("label") == label)).orderBy(F.xxhash64("doc_id")).select("text").toLocalIterator():
            texts.append(row[0].encode())
            size += len(texts[-1])
            if size >= DICTIONARY_TEXT:
                break
        built[label] = _dictionary(texts)
    model = QualityModel(built[1], built[0], [0.0] * 4)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            cols = np.array([model.inputs(t) for t in texts], float).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"label": batch.column("label")} | {f"x{i}": pa.array(cols[:, i]) for i in range(3)})

    rows = sample.where("half = 1").mapInArrow(measure, "label int, x0 double, x1 double, x2 double").collect()  # bound rows of four numbers at most
    if len({r[0] for r in rows}) == 2:
        x, y = np.array([r[1:] for r in rows], float), np.array([r[0] for r in rows], float)
        model.weights = logistic(x, y).tolist()
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) for every row of docs, from the whole text alone.

    Null and empty texts get the calibration's intercept. Null ids count as the text "" in the held-out fold. Repeated rows repeat their
    result; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([shared.value.score(t) for t in texts], pa.float64())})

    scored = documents(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
