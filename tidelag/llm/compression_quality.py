"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts.  A text is cut into pieces
of about ``PIECE`` characters, each compressed with either dictionary; the normalised difference of the summed
sizes, (bad - good) / (bad + good), says which text family it is closer to.  A logistic curve fitted on other
labelled texts turns it, with the plain compression rate, into a probability.

Pieces keep the dictionaries telling: in one long stream a text would soon be its own dictionary.

Defined results: NULL and empty texts get the score of a difference of 0; a NULL id is never held out and never
learned from; ids labelled twice with different labels are left out of learning; repeated rows are scored one by
one; without both labels every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import hash_sample, id_crc, shared_dir, texts_of, written

TRAIN_PER_CLASS = 4000  # labelled documents of each class: half build dictionaries, half fit the curve
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 8 << 20  # a dictionary takes whole texts until they exceed this
PIECE = 1024
LEVEL = 3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, difference double, rate double"


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the pieces; too few of them serve as raw content."""
    cut = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, cut).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cut)[-DICTIONARY_BYTES:]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    curve: list[float] = field(default_factory=lambda: [0.0] * 6)
    mean: list[float] = field(default_factory=lambda: [0.0] * 5)
    spread: list[float] = field(default_factory=lambda: [1.0] * 5)

    def compressors(self) -> list:
        made = []
        for raw in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_dict_id=False, write_content_size=False))
        return made

    @staticmethod
    def measure(text: str | None, compressors: list) -> tuple[float, float]:
        """(normalised size difference, size with the good dictionary per byte)."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(p)) for p in pieces(raw)) for c in compressors)
        return (bad - good) / (bad + good), good / len(raw)

    def probability(self, difference: np.ndarray, rate: np.ndarray) -> np.ndarray:
        x = (_terms(difference, rate) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


UNKNOWING = CompressionModel(b"", b"")


def _terms(difference: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return np.stack([difference, np.maximum(difference, 0), difference * rate, rate, rate**2], axis=1)


def fit_curve(model: CompressionModel, difference: np.ndarray, rate: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
    """Weighted logistic regression by Newton's method; the weights undo the balanced sampling."""
    terms = _terms(difference, rate)
    mean, spread = terms.mean(axis=0), terms.std(axis=0) + 1e-9
    x = np.column_stack([(terms - mean) / spread, np.ones(len(label))])
    theta = np.zeros(x.shape[1])
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (label - p)) - penalty @ theta
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curvature, gradient)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.curve, model.mean, model.spread = theta.tolist(), mean.tolist(), spread.tolist()


def train(documents: DataFrame, labels: DataFrame, folder: str | None = None, per_class: int = TRAIN_PER_CLASS) -> CompressionModel:
    """Fit on a bounded sample of ``labels`` (doc_id, quality), those of smallest id hash."""
    folder = folder or shared_dir(documents.sparkSession)
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("most"))
        .where("label = most")
        .select("doc_id", "label")
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(totals) < 2:
        return UNKNOWING
    chosen = hash_sample(known.where("label = 1"), "doc_id", per_class).unionByName(
        hash_sample(known.where("label = 0"), "doc_id", per_class)
    )
    turn = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    sample = written(texts_of(documents, chosen).withColumn("half", turn), folder, "quality-sample")
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for label in (0, 1):
        # the text sent to the driver is bounded by the sample; each dictionary takes whole texts up to SAMPLE_BYTES
        rows = sample.where((F.col("half") == 0) & (F.col("label") == label)).orderBy("doc_id", "text").select("text")
        room = SAMPLE_BYTES
        for row in rows.toLocalIterator():
            raw = (row["text"] or "").encode("utf-8", "surrogatepass")
            texts[label].append(raw)
            room -= len(raw)
            if room <= 0:
                break
    model = CompressionModel(build_dictionary(texts[1]), build_dictionary(texts[0]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for batch in batches:
            found = [model.measure(t, tools) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "label", "difference", "rate"],
            )

    rows = (
        sample.where("half = 1")
        .select("doc_id", "label", "text")
        .mapInArrow(measured, "doc_id long, label int, difference double, rate double")
        .collect()
    )
    rows.sort()
    if rows:
        label = np.array([r["label"] for r in rows], float)
        taken = np.maximum(np.array([(label == 0).sum(), (label == 1).sum()], float), 1)
        weight = np.array([totals[0], totals[1]])[label.astype(int)] / taken[label.astype(int)]
        weight *= len(label) / weight.sum()
        fit_curve(model, np.array([r["difference"] for r in rows]), np.array([r["rate"] for r in rows]), label, weight)
    return model


def score_documents(documents: DataFrame, model: CompressionModel, held_out) -> DataFrame:
    """Rows of ``SCHEMA``; ``held_out`` is a boolean column of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = np.array([model.measure(t, tools) for t in batch.column("text").to_pylist()])
                score = model.probability(found[:, 0], found[:, 1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(score),
                        pa.array((score >= 0.5).astype(np.int32)),
                        pa.array(found[:, 0]),
                        pa.array(found[:, 1]),
                    ],
                    names=["doc_id", "held_out", "score", "predicted", "difference", "rate"],
                )

    table = documents.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return table.mapInArrow(run, SCHEMA)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that has not seen the fold crc32(doc_id) mod 3 = 1."""
    model = train(documents, labels.where(id_crc("doc_id") % 3 != 1))
    return score_documents(documents, model, id_crc("doc_id") % 3 == 1)
