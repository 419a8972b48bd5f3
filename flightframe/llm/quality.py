"""Quality classifier: supervised subword embeddings, averaged per document, with softmax output.

Words and character n-grams are hashed to rows of one learned embedding table (pairs of equal words share a row); a
document is the mean of its rows (all of its text), a linear layer and softmax give the classes.  Trained by plain stochastic gradient descent in numpy on a
sample of at most max_labelled labelled documents (hash order, so the same each time), drawn from the training fold.

Null texts count as empty; an empty text has the zero vector, so its score is the bias alone.  Rows with a null doc_id
are scored and are not held out.  Repeated labels train once per row.  With no usable labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.folds import remainder, sample
from flightframe.llm.shared import schema_with, table, text_slices
from flightframe.llm.words import word_hashes

WORD_BITS, GRAM_BITS, GRAM = 16, 16, 3
#: One row stands for every pair of equal words in a row, whatever the word.
REPEAT = (1 << WORD_BITS) + (1 << GRAM_BITS)
ROWS = REPEAT + 1
SLICE = 1 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words and character 3-grams of some texts, and the number of the text of each."""
    words, bounds = word_hashes(data, offsets)
    n = len(offsets) - 1
    word_text = np.repeat(np.arange(n), np.diff(bounds))
    word_rows = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    again = np.flatnonzero((words[1:] == words[:-1]) & (word_text[1:] == word_text[:-1]))
    first_bytes = (data & 0xC0) != 0x80
    ends = np.concatenate(([0], np.cumsum(first_bytes)))[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    size = max(0, len(chars) - GRAM + 1)
    code = np.zeros(size, np.uint32)
    for k in range(GRAM):
        code = code * np.uint32(0x01000193) ^ chars[k : k + size]
    code = code * np.uint32(0x9E3779B1)
    text = np.repeat(np.arange(n), np.diff(ends))
    whole = np.repeat(ends[1:], np.diff(ends))[:size] - np.arange(size) >= GRAM
    gram_rows = (code >> np.uint32(32 - GRAM_BITS)).astype(np.int64)[whole] + (1 << WORD_BITS)
    rows = np.concatenate((word_rows, np.full(len(again), REPEAT), gram_rows))
    return rows, np.concatenate((word_text, word_text[again], text[:size][whole]))


@dataclass
class Model:
    """An embedding table and an output layer; for two classes a row's part in the logit is a single number."""

    embeddings: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def row_logits(self) -> np.ndarray:
        """The output layer is linear, so mean(rows) @ output = mean(rows @ output)."""
        both = self.embeddings @ self.output
        return (both[:, 1] - both[:, 0]).astype(np.float64)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 12, rate: float = 8.0, batch: int = 32, least_steps: int = 1500, seed: int = 7) -> Model:
    """docs: for each document its rows and how often each comes.  Cross-entropy, learning rate falling to zero;
    few documents are gone through more often, so that there are least_steps steps."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / dim, 1 / dim, (ROWS, dim)).astype(np.float32), np.zeros((dim, 2), np.float32), np.zeros(2, np.float32))
    if len(set(labels.tolist())) < 2:
        if len(labels):
            model.bias[int(labels[0])] = 3.0
        return model
    per_epoch = -(-len(docs) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    steps, done = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            now = rate * (1 - done / steps)
            done += 1
            picked = order[at : at + batch]
            rows = np.concatenate([docs[k][0] for k in picked])
            share = np.concatenate([docs[k][1] / max(1, docs[k][1].sum()) for k in picked]).astype(np.float32)
            which = np.repeat(np.arange(len(picked)), [len(docs[k][0]) for k in picked])
            means = np.stack([np.bincount(which, share * model.embeddings[rows, d], len(picked)) for d in range(dim)], axis=1).astype(np.float32)
            logits = means @ model.output + model.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), labels[picked]] -= 1
            back = p @ model.output.T
            model.output -= now / len(picked) * means.T @ p
            model.bias -= now / len(picked) * p.sum(axis=0)
            unique, at_row = np.unique(rows, return_inverse=True)
            for d in range(dim):
                model.embeddings[unique, d] -= now / len(picked) * np.bincount(at_row, share * back[which, d], len(unique)).astype(np.float32)
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(label int, rows binary, counts binary) of the sampled labelled documents; the sample's bound makes it broadcastable."""
    chosen = F.broadcast(sample(labels, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                rows, text = features(data, offsets)
                key, count = np.unique(text * ROWS + rows, return_counts=True)
                cuts = np.searchsorted(key, np.arange(part.num_rows + 1) * ROWS)
                out = [(key[i:j] % ROWS, count[i:j]) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([r.astype("<i4").tobytes() for r, _ in out], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in out], pa.binary())], ["label", "rows", "counts"])

    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id").select("label", "text")
    return joined.mapInArrow(run, "label int, rows binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 5000, **kwargs) -> Model:
    """labels(doc_id, label int): the rows that may be learned from."""
    got = labelled_features(docs, labels.where("label in (0, 1) and doc_id is not null"), max_labelled).collect()
    got.sort(key=lambda r: (bytes(r["rows"]), bytes(r["counts"]), r["label"]))  # the order of rows from Spark may vary
    pairs = [(np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in got]  # views, no copies
    return train(pairs, np.array([r["label"] for r in got], np.int64), **kwargs)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double (in place of a column of that name): the softmax probability of class 1 of each whole text."""
    docs = docs.drop("score")
    weights, offset = model.row_logits(), model.offset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                rows, text = features(data, offsets)
                n = np.bincount(text, minlength=part.num_rows)
                logit = np.bincount(text, weights[rows], part.num_rows) / np.maximum(1, n) + offset
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))))], [*part.schema.names, "score"])

    return docs.mapInArrow(run, schema_with(docs, score="double"))


def training_labels(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    return labels.where(remainder(folds) != held).select("doc_id", F.col(column).cast("int").alias("label"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels"), "quality", 5, 0))
    return score(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
