"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, A-Z lower-cased.  A mask is a fixed pattern over neighbouring words; the words
under its ones make a seed, those under its zeros may differ.  Test and training seeds are joined by hash, and around
each hit the words themselves are compared position by position along the diagonal: an overlap is a window of 13 words
(all words of an item of 8 to 12) of which at least 0.8 are equal.  The masks find every such window, wherever its
substitutions are (a test proves it).  An item of fewer than 8 words has one seed, all its words, and overlaps where they
come in a row without a change.  Items without words match nothing.

Null texts count as empty.  Repeated items count once, under their smallest item_id (a null id counts as -1).  A
document is known by its doc_id: rows that repeat an id share its result; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.shared import table, text_slices, written
from flightframe.llm.words import LETTERS, LOWER, mix, span_hashes, word_bounds, word_hashes

#: Weight 6, and together without loss for windows of 8 to 13 words of which 0.8 are equal.
MASKS = ("1110111", "110100111", "1111101", "10011111", "1101010011")
WINDOW, LEAST, SIMILARITY = 13, 8, 0.8
#: The filter of test seeds has so many bits; two are set per seed.  More seeds than it suits only let more rows pass.
FILTER_BITS = 25
SLICE = 1 << 20


def needed(n: int) -> tuple[int, int]:
    """Window of an item of n words, and how many of its words must be equal."""
    size = min(n, WINDOW)
    return size, math.ceil(SIMILARITY * size - 1e-9) if n >= LEAST else n


def seeds(words: np.ndarray, bounds: np.ndarray, masks: list[str]) -> Iterator[np.ndarray]:
    """For each mask the hash of the seed at each position; 0 where the mask does not fit into the text."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
    span = max(map(len, masks), default=0)
    padded = np.concatenate((words, np.zeros(span, np.uint64)))
    n, part = len(words), {}
    for mask in masks:
        number = int("1" + mask, 2)
        h = np.full(n, number, np.uint64)
        for k, one in enumerate(mask):
            if one == "1":
                if k not in part:
                    part[k] = padded[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
                h += part[k]
        yield np.where(left >= len(mask), mix(h), np.uint64(0))


def filter_bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def plain_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words in lower case, one space between two: what is compared in the end."""
    raw = LOWER[data].tobytes()
    return b" ".join([raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id long, words binary, n int, item long): each distinct item with words, as its plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                starts, ends, bounds = word_bounds(data, offsets, LETTERS)
                out = [plain_words(data, starts[i:j], ends[i:j]) if j > i else None for i, j in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(out, pa.binary()), pa.array(np.diff(bounds).astype(np.int32))], ["item_id", "words", "n"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("binary").alias("text"))
    got = rows.mapInArrow(run, "item_id long, words binary, n int").where("words is not null")
    return got.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("n").alias("n")).select("item_id", "words", "n", F.xxhash64("item_id", "words").alias("item"))


def short_masks(items: DataFrame) -> list[str]:
    """For each number of words below LEAST that an item has, the mask of that many words."""
    return ["1" * r["n"] for r in items.where(F.col("n") < LEAST).select("n").distinct().orderBy("n").collect()]


def item_seeds(items: DataFrame) -> DataFrame:
    """(key long, item long, pos int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words, bounds = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                found = list(seeds(words, bounds, list(MASKS) if len(words) >= LEAST else ["1" * len(words)]))
                keys = np.concatenate(found)
                pos = np.tile(np.arange(len(words), dtype=np.int32), len(found))[keys != 0]
                keys = keys[keys != 0]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), item, np.int64)), pa.array(pos)], ["key", "item", "pos"])

    return items.select("item", "words").mapInArrow(run, "key long, item long, pos int")


def seed_filter(test: DataFrame) -> np.ndarray:
    """The filter as bytes, 2 ** FILTER_BITS / 8 of them whatever the number of seeds: built by bitmap aggregation."""
    low = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    high = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bits = test.select("key").distinct().select(F.explode(F.array(high, low)).alias("bit"))
    size = 1 << 15
    chunks = bits.groupBy(F.expr(f"bit div {size}").alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit") % size).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in chunks.collect():  # at most 2 ** FILTER_BITS / 2 ** 15 rows of 4 KB
        out[row["chunk"] * (size // 8) : (row["chunk"] + 1) * (size // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def segments(docs: DataFrame, packed: np.ndarray, short: list[str]) -> DataFrame:
    """Stretches of documents around seeds that the filter lets pass.

    (doc_id, segment long, words binary, keys array<long>, at array<int>): at counts from the stretch's first word.
    """
    margin = WINDOW + max(map(len, MASKS))
    masks = [*MASKS, *short]

    def known(bits: np.ndarray) -> np.ndarray:
        return packed[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", SLICE):
                starts, ends, bounds = word_bounds(data, offsets, LETTERS)
                words = span_hashes(data, [(starts, ends)], LOWER)[0]
                hit_keys, hit_at = [], []
                for keys in seeds(words, bounds, masks):
                    first, second = filter_bits(keys)
                    at = np.flatnonzero(known(first))
                    at = at[known(second[at]) & (keys[at] != 0)]
                    hit_keys.append(keys[at])
                    hit_at.append(at)
                keys, at = np.concatenate(hit_keys), np.concatenate(hit_at)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                keys, at = keys[order].view(np.int64), at[order]
                doc = np.searchsorted(bounds, at, side="right") - 1
                cuts = np.flatnonzero(np.append(True, (at[1:] - at[:-1] > margin) | (doc[1:] != doc[:-1])))
                rows = []
                for i, j in zip(cuts, np.append(cuts[1:], len(at))):
                    d = doc[i]
                    start, end = max(bounds[d], at[i] - margin), min(bounds[d + 1], at[j - 1] + margin)
                    first = starts[start]
                    stretch = plain_words(data[first : ends[end - 1]], starts[start:end] - first, ends[start:end] - first)
                    rows.append((d, stretch, keys[i:j], (at[i:j] - start).astype(np.int32)))
                ids = part.column("doc_id").take(pa.array([r[0] for r in rows]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["doc_id", "words", "keys", "at"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, words binary, keys array<long>, at array<int>")
    return got.select("doc_id", F.xxhash64("doc_id", "words").alias("segment"), "words", "keys", "at")


def compare(words: list[bytes], item: list[bytes], diagonal: int) -> tuple[int, int]:
    """Along words[i] against item[i - diagonal]: the most equal words of a window, and the words that overlaps cover."""
    size, need = needed(len(item))
    low, high = max(0, diagonal), min(len(words), diagonal + len(item))
    if high - low < size:
        return 0, 0
    same = [a == b for a, b in zip(words[low:high], item[low - diagonal : high - diagonal], strict=True)]
    sums = np.concatenate(([0], np.cumsum(same)))
    counts = sums[size:] - sums[:-size]
    good = np.flatnonzero(counts >= need)
    covered = int(np.minimum(np.diff(np.append(good, good[-1] + size)), size).sum()) if len(good) else 0
    return int(counts.max()), covered


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, equal int, covered int), a row per pair that
    overlaps: the most equal words of a window, and the most words that overlaps of one diagonal cover."""
    items = written(spark, item_words(benchmark), "items")
    test = written(spark, item_seeds(items), "seeds")
    found = written(spark, segments(docs, seed_filter(test), short_masks(items)), "segments")
    hits = found.select("segment", F.explode(F.arrays_zip("keys", "at")).alias("x")).select("segment", F.col("x.keys").alias("key"), F.col("x.at").alias("at"))
    lines = hits.join(test, "key").select("segment", "item", (F.col("at") - F.col("pos")).alias("diagonal")).distinct()
    pairs = lines.join(found.select("segment", "doc_id", "words").dropDuplicates(["segment"]), "segment").join(items.select("item", "item_id", F.col("words").alias("test")), "item").select("doc_id", "item_id", "words", "test", "diagonal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lru_cache(16)(lambda text: text.split(b" "))  # a stretch comes once per diagonal
        for batch in batches:
            scores = [compare(split(w), split(t), d) for w, t, d in zip(*(batch.column(c).to_pylist() for c in ("words", "test", "diagonal")), strict=True)]
            keep = pa.array([c > 0 for _, c in scores], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array([e for e, _ in scores], pa.int32()), pa.array([c for _, c in scores], pa.int32())], ["doc_id", "item_id", "equal", "covered"])
            yield out.filter(keep)

    return pairs.mapInArrow(run, "doc_id long, item_id long, equal int, covered int").groupBy("doc_id", "item_id").agg(F.max("equal").alias("equal"), F.max("covered").alias("covered"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id: the smallest item that overlaps, n_items, equal, covered) of the documents with an overlap."""
    return overlaps(spark, docs, benchmark).groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.max("equal").alias("equal"), F.max("covered").alias("covered"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = written(spark, contaminated(spark, docs, table(spark, sf_dir, "benchmark")), "contaminated").withColumnRenamed("doc_id", "id")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("equal", F.lit(0)).alias("equal"), F.coalesce("covered", F.lit(0)).alias("covered"))
