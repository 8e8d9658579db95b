"""Toxicity by multiple-instance learning.

A document is toxic when at least one of its sentences is: the sentence scores p = sigmoid(bias + weights of the
listed terms in it) are combined by noisy-or, 1 - product(1 - p).  Only document labels are known; the weights are
fitted to them through the noisy-or, and the sentence scores then say which sentences offend.

A term is a word, or the first 4, 5 or 6 bytes of one (written with a star), so inflected words are met too.
The list of terms is chosen over the labelled sample by a likelihood-ratio statistic, counted in Spark.

Defined results: NULL and empty texts have no sentence and score 0; a NULL id is never held out and never learned
from; ids labelled twice with different labels are left out of learning; repeated rows are scored one by one;
without both labels every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import hash_sample, id_crc, shared_dir, texts_of, written

TRAIN_TOXIC = 4000  # labelled documents of either class used to fit, whole texts
TRAIN_CLEAN = 8000
SIGNIFICANT = 15.13  # likelihood ratio of a term that chance passes once in ten thousand

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_offending long, offending array<string>"

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SENTENCE = re.compile(rb"[.!?\n]+")
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def sentences(text: str | None) -> list[bytes]:
    """Sentences of a text, those without a letter left out."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [s for s in _SENTENCE.split(raw) if _WORD.search(s.translate(_LOWER))]


PREFIXES = (4, 5, 6)


def terms(sentence: bytes) -> set[bytes]:
    own = set(_WORD.findall(sentence.translate(_LOWER)))
    found = set(own)
    for k in PREFIXES:
        found.update([w[:k] + b"*" for w in own if len(w) >= k])
    return found


@dataclass
class NoisyOr:
    weights: dict[bytes, float]
    bias: float

    def sentence_score(self, found: set[bytes]) -> float:
        return 1 / (1 + exp(-max(min(self.bias + sum(self.weights[w] for w in found), 30.0), -30.0)))

    def judge(self, text: str | None) -> tuple[float, int, list[bytes]]:
        """Score of the text, its number of sentences, and the sentences that score at least 0.5."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        listed = self.weights.keys() & terms(raw)
        parts = [s for s in _SENTENCE.split(raw) if s]
        if not listed:
            n = sum(1 for s in parts if _WORD.search(s.translate(_LOWER)))
            return -float(np.expm1(n * log1p(-self.sentence_score(set())))), n, []
        clean, n, offending = 0.0, 0, []
        for part in parts:
            own = terms(part)
            if own:
                p = self.sentence_score(own & listed)
                n += 1
                clean += log1p(-p)
                if p >= 0.5:
                    offending.append(part)
        return -float(np.expm1(clean)), n, offending


HARMLESS = NoisyOr({}, -30.0)


def fit(
    documents: list[tuple[int, int, list[list[int]]]], vocabulary: list[bytes], steps: int = 600, l2: float = 5e-5
) -> NoisyOr:
    """Weights from (label, sentences without a listed term, listed terms of each other sentence)."""
    labels = np.array([d[0] for d in documents], float)
    if not len(labels) or labels.min() == labels.max():
        return HARMLESS
    plain = np.array([d[1] for d in documents], float)
    owner = np.array([i for i, d in enumerate(documents) for _ in d[2]], int)
    sizes = np.array([len(s) for d in documents for s in d[2]], int)
    flat = np.array([w for d in documents for s in d[2] for w in s], int)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = -6.0
    momentum, scale = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        logit = theta[-1] + np.bincount(sentence, theta[flat], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        base = 1 / (1 + np.exp(-np.clip(theta[-1], -30, 30)))
        clean = np.bincount(owner, np.log1p(-p), len(labels)) + plain * np.log1p(-base)
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        # d log-likelihood / d logit of a sentence: p (1 - P) / P in toxic documents, -p in clean ones
        pull = np.where(labels == 1, np.exp(clean) / toxic, -1.0)
        by_sentence = pull[owner] * p
        gradient = np.zeros_like(theta)
        gradient[:-1] = np.bincount(flat, by_sentence[sentence], len(vocabulary))
        gradient[-1] = by_sentence.sum() + (pull * plain).sum() * base
        gradient = gradient / len(labels) - l2 * np.append(theta[:-1], 0.0)
        momentum = 0.9 * momentum + 0.1 * gradient
        scale = 0.99 * scale + 0.01 * gradient**2
        theta += 0.1 * momentum / (1 - 0.9**step) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    return NoisyOr({w: float(t) for w, t in zip(vocabulary, theta, strict=False)}, float(theta[-1]))


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = sorted(terms((text or "").encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()), pa.array([label] * len(own), pa.int32())], names=["word", "label"]
            )


def vocabulary_of(sample: DataFrame, significant: float = SIGNIFICANT) -> list[bytes]:
    """Every term whose presence raises the likelihood of a toxic label significantly; the sample bounds their number."""
    totals = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    toxic, clean = float(n.get(1, 0)), float(n.get(0, 0))
    if not toxic or not clean:
        return []
    counted = (
        sample.select("label", "text")
        .mapInArrow(_distinct_terms, "word binary, label int")
        .groupBy("word")
        .agg(F.sum("label").cast("double").alias("in_toxic"), F.count(F.lit(1)).cast("double").alias("in_all"))
        .where("in_toxic >= 3")
    )
    # Likelihood ratio of the term's share of toxic documents against that of all documents.
    share, k, n_all = toxic / (toxic + clean), F.col("in_toxic"), F.col("in_all")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(k, n_all * share) + part(n_all - k, n_all * (1 - share)))
    best = counted.where((k > n_all * share) & (ratio >= significant)).orderBy("word")
    return [bytes(r["word"]) for r in best.select("word").collect()]


def train(
    documents: DataFrame,
    labels: DataFrame,
    folder: str | None = None,
    toxic_bound: int = TRAIN_TOXIC,
    clean_bound: int = TRAIN_CLEAN,
) -> NoisyOr:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic), those of smallest id hash."""
    folder = folder or shared_dir(documents.sparkSession)
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").cast("int").alias("most"))
        .where("label = most")
        .select("doc_id", "label")
    )
    chosen = hash_sample(known.where("label = 1"), "doc_id", toxic_bound).unionByName(
        hash_sample(known.where("label = 0"), "doc_id", clean_bound)
    )
    sample = written(texts_of(documents, chosen), folder, "toxicity-sample")
    vocabulary = vocabulary_of(sample)
    place = {w: i for i, w in enumerate(vocabulary)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, listed = [], []
            for text in batch.column("text").to_pylist():
                found = [sorted(place[w] for w in terms(s) & place.keys()) for s in sentences(text)]
                plain.append(sum(1 for f in found if not f))
                listed.append([f for f in found if f])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array(plain, pa.int64()),
                    pa.array(listed, pa.list_(pa.list_(pa.int32()))),
                ],
                names=["doc_id", "label", "plain", "listed"],
            )

    rows = (
        sample.select("doc_id", "label", "text")
        .mapInArrow(bags, "doc_id long, label int, plain long, listed array<array<int>>")
        .collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.plain, r.listed))
    return fit([(r.label, r.plain, r.listed) for r in rows], vocabulary)


def score_documents(documents: DataFrame, model: NoisyOr, held_out) -> DataFrame:
    """Rows of ``SCHEMA``; ``held_out`` is a boolean column of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                judged = [model.judge(t) for t in batch.column("text").to_pylist()]
                texts = [[s.decode("utf-8", "replace").strip() for s in j[2]] for j in judged]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array([j[0] for j in judged], pa.float64()),
                        pa.array([int(j[0] >= 0.5) for j in judged], pa.int32()),
                        pa.array([j[1] for j in judged], pa.int64()),
                        pa.array([len(j[2]) for j in judged], pa.int64()),
                        pa.array(texts, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "offending"],
                )

    table = documents.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return table.mapInArrow(run, SCHEMA)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that has not seen the fold crc32(doc_id) mod 5 = 0."""
    model = train(documents, labels.where(id_crc("doc_id") % 5 != 0))
    return score_documents(documents, model, id_crc("doc_id") % 5 == 0)
