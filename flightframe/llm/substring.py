"""Substring deduplication by fixed-block anchors.

A window is 35 words in a row of one document.  Every document is cut into blocks of 18 words from its start, so each of
its windows holds a whole block; the blocks of all documents are the index, and every rolling window of 18 words of
every document probes it.  A hit at another place (another document, or elsewhere in the same one) is an anchor: the
windows around it are compared, and those whose words start twice or more are repeats.  Anchors are candidates by rolling
hashes; windows are compared by a cryptographic digest (BLAKE2b, 128 bits) of their words, joined by one space, so no two
different windows count as equal.  Overlapping repeats of a document join to maximal spans; the words under them are
removed.

How the work is dealt: texts go through the tasks in slices of whole documents.  A slice sends, for each hash bucket,
one packed row of hashes and positions (equal hashes of a slice once, so a passage that very many documents share is
pre-aggregated), a bucket answers with the positions that hit, and a slice's answers meet its directory of documents.
The number of buckets and of the tasks that hold them grows with the input, so a bucket keeps its size; slices grow as
well (up to a bound), so that a packed row keeps many entries.  Texts themselves are only shuffled for
documents with anchors; a filter of fixed size keeps most others out of that join, which is exact.

Null and empty texts, and texts below 35 words, lose nothing.  Rows that repeat a doc_id and text are separate
occurrences and so repeat each other.  Rows with a null doc_id are treated like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.shared import table, text_slices, written
from flightframe.llm.words import gram_hashes, word_bounds, word_hashes

WINDOW = 35
#: Bytes of a slice: at least, at most, and per bucket (some dozens of words for each).
SLICE, MOST_SLICE, SLICE_PER_BUCKET = 256 << 10, 4 << 20, 384
#: Bytes of text whose entries one task of the exchange holds.
TASK_BYTES = 64 << 20
#: Aimed at per bucket; a bucket is one group in one task.
ENTRIES_PER_BUCKET = 2_000_000
BYTES_PER_WORD = 6
FILTER_BITS = 25

#: Entries of the two rounds: 31 bits of an anchor's hash and a bit for "block"; 128 bits of a window's digest.
ANCHOR = np.dtype([("a", "<u4")])
EXACT = np.dtype([("a", "<u8"), ("b", "<u8")])

ROW = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
ROW_DDL = "bucket int, slice long, kind int, payload binary"
DOC = pa.schema([("doc_id", pa.int64()), ("thash", pa.int64()), ("at", pa.binary())])
DOC_DDL = "doc_id long, thash long, at binary"
ENTRIES, DIRECTORY, ANSWER = 0, 1, 2


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, text): thash tells rows apart that share a doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("thash"), text.cast("binary").alias("text"))


def _packed(part: pa.RecordBatch, bounds: np.ndarray, bucket: np.ndarray, keys: np.ndarray, at: np.ndarray, local: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A slice's rows: one per bucket with entries, and its directory."""
    ids, thash = part.column("doc_id"), np.asarray(part.column("thash"))
    doc_id, known = np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid())
    name = xxhash.xxh64_intdigest(doc_id.tobytes() + thash.tobytes())
    sid = int(np.uint64(name).view(np.int64))
    width = "<u2" if bounds[-1] <= 1 << 16 else "<u4"
    order = np.argsort(bucket, kind="stable")
    keys, at = keys[order], at[order].astype(width)
    found, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(order))
    payloads = [width[2].encode() + keys[i:j].tobytes() + at[i:j].tobytes() for i, j in zip(first, ends)]
    directory = np.array([len(thash), len(local)], "<i8").tobytes() + doc_id.tobytes() + thash.tobytes() + bounds.astype("<i8").tobytes() + local.astype("<u4").tobytes() + known.astype(np.uint8).tobytes()
    n = len(found) + 1
    return pa.RecordBatch.from_arrays([pa.array(np.append(found, name % buckets).astype(np.int32)), pa.array(np.full(n, sid)), pa.array(np.append(np.full(n - 1, ENTRIES), DIRECTORY).astype(np.int32)), pa.array([*payloads, directory], pa.binary())], schema=ROW)


def _answers(entry: np.dtype, hits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """One bucket: entries of all slices in, positions that hit out; directories pass."""

    def run(group: pa.Table) -> pa.Table:
        kinds = np.asarray(group.column("kind"))
        sids, payloads = group.column("slice").to_pylist(), group.column("payload").to_pylist()
        rows = np.flatnonzero(kinds == ENTRIES)
        keys, at, sizes = [], [], []
        for k in rows:
            raw = payloads[k]
            width = int(raw[:1])
            n = (len(raw) - 1) // (entry.itemsize + width)
            keys.append(np.frombuffer(raw, entry, n, 1))
            at.append(np.frombuffer(raw, f"<u{width}", n, 1 + n * entry.itemsize))
            sizes.append(n)
            payloads[k] = None
        out = [(sids[k], DIRECTORY, payloads[k]) for k in np.flatnonzero(kinds == DIRECTORY)]
        if len(rows):
            key = np.concatenate(keys)
            hit = hits(key, np.repeat(np.arange(len(rows)), sizes))
            ends = np.cumsum(sizes)
            for k, x, i, j in zip(rows, at, ends - sizes, ends):
                if (mine := hit[i:j]).any():
                    out.append((sids[k], ANSWER, x[mine].astype("<u4").tobytes()))
        return pa.table({"slice": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "payload": pa.array([r[2] for r in out], pa.binary())})

    return run


def _documents(group: pa.Table) -> pa.Table:
    """One slice: its directory and answers in; per document with hits its positions out."""
    kinds, payloads = group.column("kind").to_pylist(), group.column("payload").to_pylist()
    raw = payloads[kinds.index(DIRECTORY)]
    n, n_local = np.frombuffer(raw, "<i8", 2)
    doc_id, thash = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<i8", n, 16 + 8 * n)
    bounds = np.frombuffer(raw, "<i8", n + 1, 16 + 16 * n)
    local = np.frombuffer(raw, "<u4", n_local, 24 + 24 * n)
    known = np.frombuffer(raw, np.uint8, n, 24 + 24 * n + 4 * n_local)
    at = np.unique(np.concatenate([local, *(np.frombuffer(p, "<u4") for k, p in zip(kinds, payloads) if k == ANSWER)])).astype(np.int64)
    cuts = np.searchsorted(at, bounds)
    docs = np.flatnonzero(np.diff(cuts))
    return pa.table(
        [pa.array(doc_id[docs], mask=known[docs] == 0), pa.array(thash[docs]), pa.array([(at[cuts[d] : cuts[d + 1]] - bounds[d]).astype("<u4").tobytes() for d in docs], pa.binary())],
        schema=DOC,
    )


def _exchange(rows: DataFrame, entry: np.dtype, hits: Callable, tasks: int) -> DataFrame:
    """Packed rows -> (doc_id, thash, at binary): little-endian word positions, once per distinct document row."""
    answers = rows.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_answers(entry, hits), "slice long, kind int, payload binary")
    found = answers.groupBy("slice").applyInArrow(_documents, DOC_DDL)
    return found.groupBy("doc_id", "thash").agg(F.first("at").alias("at"))


def _first_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of one of each set of equal keys, and for every key whether it has an equal."""
    order = np.argsort(keys, kind="stable") if keys.dtype.names is None else np.lexsort([keys[c] for c in reversed(keys.dtype.names)])
    new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)]
    size = np.diff(np.append(np.flatnonzero(new), len(keys)))
    several = np.empty(len(keys), bool)
    several[order] = np.repeat(size > 1, size)
    return order[new], several


def slice_bytes(buckets: int) -> int:
    return min(MOST_SLICE, max(SLICE, SLICE_PER_BUCKET * buckets))


def anchor_rows(texts: DataFrame, buckets: int, window: int) -> DataFrame:
    """Round one: every rolling window of half a window's words, marked where it is one of the document's blocks."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", slice_bytes(buckets)):
                words, bounds = word_hashes(data, offsets)
                grams, whole = gram_hashes(words, bounds, block)
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))[: len(grams)]
                at = np.flatnonzero(whole & (np.diff(bounds)[doc] >= window))
                keys = grams[at]
                is_block = (at - bounds[doc[at]]) % block == 0
                one, several = _first_of_equal(keys)
                indexed = np.zeros(len(keys), bool)  # of equal keys the one that goes stands for a block if any is one
                if len(keys):
                    blocks = np.unique(keys[is_block])
                    spot = np.minimum(np.searchsorted(blocks, keys[one]), max(0, len(blocks) - 1))
                    indexed[one] = blocks[spot] == keys[one] if len(blocks) else False
                packed = np.empty(len(one), ANCHOR)
                packed["a"] = (keys[one] & np.uint64(0x7FFFFFFF)) << np.uint64(1) | indexed[one]
                yield _packed(part.select(["doc_id", "thash"]), bounds, ((keys[one] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), packed, at[one], at[several], buckets)

    return texts.mapInArrow(run, ROW_DDL)


def anchor_hits(keys: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Entries whose hash comes twice or more and is a block's at least once."""
    h = keys["a"] >> np.uint32(1)
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(h)))
    good = (size > 1) & (np.maximum.reduceat(keys["a"][order] & np.uint32(1), starts) > 0)
    hit = np.empty(len(h), bool)
    hit[order] = np.repeat(good, size)
    return hit


def window_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The digests of the windows that begin at the words `at`: of their words' bytes with one space between two words."""
    kept, inside = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    kept[ends] = True  # the byte after a word: white space, or the next text's first
    kept[:-1] |= inside
    place = np.concatenate(([0], np.cumsum(kept)))
    plain = memoryview(np.where(inside, data, np.uint8(0x20))[kept[:-1]].tobytes())
    digest = hashlib.blake2b
    spans = zip(place[starts[at]].tolist(), place[ends[at + window - 1]].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(plain[i:j], digest_size=EXACT.itemsize).digest() for i, j in spans]), EXACT)


def window_rows(texts: DataFrame, buckets: int, window: int) -> DataFrame:
    """Round two: the windows around anchors.  texts(doc_id, thash, text, at): word positions of the anchors."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text", slice_bytes(buckets)):
                starts, ends, bounds = word_bounds(data, offsets)
                near = np.zeros(len(starts) + 1, np.int32)
                for d, raw in enumerate(part.column("at").to_pylist()):
                    anchors = np.frombuffer(raw, "<u4").astype(np.int64) + bounds[d]
                    np.add.at(near, np.maximum(anchors - (window - block), bounds[d]), 1)
                    np.add.at(near, anchors + 1, -1)
                whole = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(starts)) >= window
                at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & whole)
                keys = window_digests(data, starts, ends, at, window)
                one, several = _first_of_equal(keys)
                yield _packed(part.select(["doc_id", "thash"]), bounds, (keys["a"][one] % np.uint64(buckets)).astype(np.int64), keys[one], at[one], at[several], buckets)

    return texts.mapInArrow(run, ROW_DDL)


def window_hits(keys: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Entries whose digest comes twice or more."""
    order = np.lexsort((keys["b"], keys["a"]))
    a, b = keys["a"][order], keys["b"][order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(keys)))
    hit = np.empty(len(keys), bool)
    hit[order] = np.repeat(size > 1, size)
    return hit


def _bit(bits: int) -> Column:
    return F.shiftrightunsigned("thash", 64 - bits)


def _maybe_in(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts without most rows whose thash is not in found; a bitmap of fixed size, whatever found's size."""
    size = 1 << 15
    bits = found.select(_bit(FILTER_BITS).alias("bit")).distinct()
    chunks = bits.groupBy(F.expr(f"bit div {size}").alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit") % size).alias("bits"))
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in chunks.collect():  # at most 2 ** FILTER_BITS / 2 ** 15 rows of 4 KB
        packed[row["chunk"] * (size // 8) : (row["chunk"] + 1) * (size // 8)] = np.frombuffer(row["bits"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = (np.asarray(batch.column("thash")).view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            yield batch.filter(pa.array((packed[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))

    return texts.mapInArrow(run, texts.schema)


def _with_positions(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts(doc_id, thash, text) joined with found(doc_id, thash, at)."""
    other = found.withColumnsRenamed({"doc_id": "id", "thash": "hash"})
    return texts.join(other, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("thash") == F.col("hash"))).select("doc_id", "thash", "text", "at")


def repeated_windows(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> the texts with anchors, and (doc_id, thash, at): starts of their repeated windows."""
    texts = keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-size // (BYTES_PER_WORD * ENTRIES_PER_BUCKET)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    anchors = written(spark, _exchange(anchor_rows(texts, buckets, window), ANCHOR, anchor_hits, tasks), "anchors")
    near = written(spark, _with_positions(_maybe_in(texts, anchors), anchors), "anchored")
    starts = written(spark, _exchange(window_rows(near, buckets, window), EXACT, window_hits, tasks), "repeats")
    return near.select("doc_id", "thash", "text"), starts


def _kept(text: bytes, at: np.ndarray, window: int) -> tuple[list[bytes], np.ndarray]:
    """The words that no repeated window covers, and the n * 2 bounds of the maximal spans of those that one does."""
    words = text.split()
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    gone = np.cumsum(step)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return [w for w, g in zip(words, gone.tolist()) if not g], edges


def without_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, thash, kept binary, n_removed long, spans array<int>) of the rows that lose words.

    kept: the other words, joined by one space; spans: first word and end of each maximal repeat, one after the other.
    """
    near, starts = repeated_windows(spark, docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [_kept(t, np.frombuffer(a, "<u4").astype(np.int64), window) for t, a in zip(part.column("text").to_pylist(), part.column("at").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("thash"), pa.array([b" ".join(w) for w, _ in out], pa.binary()), pa.array([int((e[1::2] - e[::2]).sum()) for _, e in out], pa.int64()), pa.array([e.astype(np.int32) for _, e in out], pa.list_(pa.int32()))], ["doc_id", "thash", "kept", "n_removed", "spans"])

    return _with_positions(near, starts).mapInArrow(run, "doc_id long, thash long, kept binary, n_removed long, spans array<int>").dropDuplicates(["doc_id", "thash"])


def _whole(texts: DataFrame) -> DataFrame:
    """(doc_id, thash, n_words long, sha string) of texts as they are, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = text.as_py().split()
                out.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("thash"), pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["doc_id", "thash", "n_words", "sha"])

    return texts.mapInArrow(run, "doc_id long, thash long, n_words long, sha string")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = without_repeats(spark, docs).select(F.col("doc_id").alias("id"), F.col("thash").alias("hash"), "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    joined = _whole(keyed(docs)).join(cut, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("thash") == F.col("hash")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
