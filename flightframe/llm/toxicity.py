"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all text of the training fold is unlabelled: documents without a toxic mark
are never taken as clean.  The risk of a classifier f under the logistic loss l, with class prior p, is

    p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)])

and is minimised by Adam steps in numpy; where the bracket falls below zero it counts as zero and has no gradient, so the
classifier can't gain by taking unlabelled text for clean beyond what the prior allows.  Each step takes the risk and its
gradient over all unlabelled documents: Spark sums them over packed rows of bits, and one row per task comes back.

Positives are a bounded sample (hash order) of the training fold's toxic marks; the prior is the share of toxic marks
among all labels of that fold.  Words are runs of letters and digits, A-Z lower-cased.  A token is a word or a word's
beginning (5 to 9 bytes); a document has up to two features of a token: it is there, and it makes at least one in 128 of
the words.  Document frequencies are counted over all documents of the fold; kept are the features whose frequency among
positives stands out most from that among all.

Null and empty texts have no words and score as the bias alone.  Rows with a null doc_id are scored and not held out.
Without positives every score is the prior, which is 0 if there are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.folds import remainder, sample
from flightframe.llm.quality import training_labels
from flightframe.llm.shared import forget, schema_with, table, text_slices, written
from flightframe.llm.words import LETTERS, LOWER, mix, span_hashes, word_bounds

SLICE = 1 << 20
#: Feature counts that a task holds before it sends them on.
MOST_COUNTED = 1 << 21

#: Lengths in bytes of the word beginnings that are tokens, and the share of a document's words that counts as dense.
BEGINNINGS = range(5, 10)
DENSE = 128

ONE = np.uint64(1)


@dataclass
class Model:
    """Known features (sorted; the lowest bit says dense), their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float = 0.0
    risks: list[float] = field(default_factory=list)

    def by_token(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, and each one's weights for being there and for being dense."""
        tokens, at = np.unique(self.features & ~ONE, return_inverse=True)
        dense = (self.features & ONE).astype(bool)
        return tokens, np.bincount(at[~dense], self.weights[~dense], len(tokens)), np.bincount(at[dense], self.weights[dense], len(tokens))


def text_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For whole words and each length of beginnings: token hashes (lowest bit 0) and the number of the text of each;
    and the number of words of each text."""
    starts, ends, bounds = word_bounds(data, offsets, LETTERS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    longer = [np.flatnonzero(ends - starts > n) for n in BEGINNINGS]
    spans = [(starts, ends), *((starts[at], starts[at] + n) for n, at in zip(BEGINNINGS, longer, strict=True))]
    hashes = span_hashes(data, spans, LOWER)
    marked = [hashes[0], *(mix(h + np.uint64(n)) for n, h in zip(BEGINNINGS, hashes[1:], strict=True))]
    return [(h & ~ONE, t) for h, t in zip(marked, (text, *(text[at] for at in longer)), strict=True)], np.diff(bounds)


def feature_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct features of each text."""
    kinds, n_words = text_tokens(data, offsets)
    hashes, text = (np.concatenate(x) for x in zip(*kinds, strict=True))
    order = np.argsort(text, kind="stable")
    cuts = np.searchsorted(text[order], np.arange(len(n_words) + 1))
    sets = []
    for k, n in enumerate(n_words):
        tokens, count = np.unique(hashes[order[cuts[k] : cuts[k + 1]]], return_counts=True)
        sets.append(np.concatenate((tokens, tokens[count * DENSE >= n] | ONE)))
    return sets


def marked(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """(positive boolean, text binary) of docs; positives(doc_id) is bounded, so it is broadcast."""
    known = F.broadcast(positives.select(F.col("doc_id").alias("__id")).distinct())
    joined = docs.join(known, F.col("doc_id") == F.col("__id"), "left")
    return joined.select(F.col("__id").isNotNull().alias("positive"), F.col("text").cast("binary").alias("text"))


def feature_counts(texts: DataFrame) -> DataFrame:
    """texts(positive, text) -> (feature long, n_pos, n_all): documents with each feature; tasks count before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total[0].view(np.int64)), pa.array(total[1]), pa.array(total[2])], ["feature", "n_pos", "n_all"])

        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                sets = feature_sets(data, offsets)
                positive = np.repeat(np.asarray(part.column("positive")), [len(x) for x in sets])
                every = np.concatenate((total[0], *sets))
                found, at = np.unique(every, return_inverse=True)
                n_pos = np.bincount(at, np.concatenate((total[1], positive)), len(found))
                n_all = np.bincount(at, np.concatenate((total[2], np.ones(len(positive)))), len(found))
                total = (found, n_pos.astype(np.int64), n_all.astype(np.int64))
                if len(found) > MOST_COUNTED:
                    yield sent()
                    total = tuple(x[:0] for x in total)
        yield sent()

    parts = texts.mapInArrow(run, "feature long, n_pos long, n_all long")
    return parts.groupBy("feature").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_all").alias("n_all"))


def select_features(counts: DataFrame, positives: int, documents: int, most: int, least: int = 3) -> np.ndarray:
    """The features with the largest standardised difference of document frequency, in at least `least` positives."""
    both = (F.col("n_pos") + F.col("n_all")) / (positives + documents)
    z = (F.col("n_pos") / positives - F.col("n_all") / documents) / F.sqrt(both * (1 - both) * (1 / positives + 1 / documents) + 1e-12)
    best = counts.where(F.col("n_pos") >= least).select("feature", F.abs(z).alias("z")).orderBy(F.desc("z"), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))


def known_bits(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """texts(positive, text) -> (positive, bits binary): which of the known features each document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                rows = [np.packbits(np.isin(known, x, assume_unique=True)).tobytes() for x in feature_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array(rows, pa.binary())], ["positive", "bits"])

    return texts.mapInArrow(run, "positive boolean, bits binary")


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk_sums(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows x (0/1, last column 1), for each of three losses its sum and gradient:

    l(f) and l(-f) of the positives, l(-f) of all.  Shape (3, 1 + len(w)).
    """
    f = x @ w
    p = positive.astype(np.float64)
    losses = np.stack((np.logaddexp(0, -f) * p, np.logaddexp(0, f) * p, np.logaddexp(0, f)))
    slopes = np.stack((-_logistic(-f) * p, _logistic(f) * p, _logistic(f)))
    return np.concatenate((losses.sum(axis=1, keepdims=True), slopes @ x), axis=1)


def total_sums(rows: DataFrame, features: int, w: np.ndarray) -> np.ndarray:
    """risk_sums over all rows(positive, bits); one row of sums a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 + len(w)))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                raw = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                x = np.ones((part.num_rows, features + 1))
                x[:, :features] = np.unpackbits(raw, axis=1, count=features)
                total += risk_sums(x, np.asarray(part.column("positive")), w)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    got = sorted(bytes(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect())
    return sum((np.frombuffer(x).reshape(3, -1) for x in got), np.zeros((3, 1 + len(w))))


def non_negative_risk(sums: np.ndarray, positives: int, documents: int, prior: float) -> tuple[float, np.ndarray]:
    """The risk and its gradient from sums over all rows."""
    pos, pos_neg, unl = sums[0] / positives, sums[1] / positives, sums[2] / documents
    bracket = unl - prior * pos_neg
    both = prior * pos + (bracket if bracket[0] >= 0 else 0)
    return float(both[0]), both[1:]


def train(sums, features: int, positives: int, documents: int, prior: float, steps: int = 30, rate: float = 0.3, decay: float = 5e-2) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the risk before each step.  sums: weights with the bias last -> risk_sums over all rows.

    Adam steps with a rate that falls to zero; decay shrinks the weights' size after each.
    """
    w = np.zeros(features + 1)
    w[features] = np.log((prior + 1e-6) / (1 - prior + 1e-6))
    m, v, risks = np.zeros(features + 1), np.zeros(features + 1), []
    for t in range(1, steps + 1):
        risk, g = non_negative_risk(sums(w), positives, documents, prior)
        risks.append(risk)
        now = rate * (1 - (t - 1) / steps)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:features] = np.sign(w[:features]) * np.maximum(0, np.abs(w[:features]) - now * decay)
    return w[:features], float(w[features]), risks


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_positive: int = 10_000, max_features: int = 256, **kwargs) -> Model:
    """labels(doc_id, label): rows that may be learned from; docs(doc_id, text): only its training fold."""
    labels = labels.where("doc_id is not null and label in (0, 1)")
    counts = labels.agg(F.sum("label"), F.count("*")).first()
    prior = (counts[0] or 0) / counts[1] if counts[1] else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), prior)
    if not counts[0]:
        return none
    texts = marked(docs.where("doc_id is not null"), sample(labels.where("label = 1").select("doc_id").distinct(), max_positive))
    size = texts.agg(F.count_if("positive"), F.count("*")).first()
    if not size[0]:
        return none
    found = written(spark, feature_counts(texts), "features")
    known = select_features(found, *size, max_features)
    if not len(known):
        return none
    rows = written(spark, known_bits(texts, known), "bits", found)
    weights, bias, risks = train(lambda w: total_sums(rows, len(known), w), len(known), *size, prior, **kwargs)
    forget(spark, rows)
    return Model(known, weights, bias, prior, risks)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double (in place of a column of that name): the probability of toxicity of each whole text."""
    docs = docs.drop("score")
    tokens, present, dense = model.by_token()
    maybe = np.zeros(1 << 16, bool)  # by the highest bits of a hash: can it be a known token?
    maybe[(tokens >> np.uint64(48)).astype(np.int64)] = True

    def logits(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        kinds, n_words = text_tokens(data, offsets)
        hits = []
        for hashes, text in kinds:
            some = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(tokens, hashes[some])
            at[at == len(tokens)] = 0
            known = tokens[at] == hashes[some] if len(tokens) else np.zeros(0, bool)
            hits.append(text[some][known] * len(tokens) + at[known])
        pairs, count = np.unique(np.concatenate(hits), return_counts=True)
        text, at = pairs // max(1, len(tokens)), pairs % max(1, len(tokens))
        weights = present[at] + np.where(count * DENSE >= n_words[text], dense[at], 0)
        return np.bincount(text, weights, len(n_words)) + model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_logistic(logits(data, offsets)))], [*part.schema.names, "score"])

    return docs.mapInArrow(run, schema_with(docs, score="double"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = training_labels(table(spark, sf_dir, "labels"), "toxic", 3, 1)
    model = fit(spark, docs.where(remainder(3) != 1), labels)
    return score(docs, model).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
