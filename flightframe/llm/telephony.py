"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV containers, expanded to resampled PCM.

A media column holds whole WAV files as binary.  Null or empty texts make one silent unit of 64 zero bytes; equal
payloads make equal media and features; an empty table gives an empty result.  Null media, and media that is no WAV file
of a known code, has null PCM, payload and feature.  Channels are kept (ADPCM: mono only).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.shared import schema_with, table, text_slices, written

RATE, PCM_RATE = 8000, 16000
UNIT = 64
SLICE = 1 << 20
#: Shares of the documents whose media and PCM are stored one after the other.
ROUNDS = 3

#: Format tags of WAV files.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 0x0001, 0x0006, 0x0007, 0x0011

#: The step sizes and index changes of IMA ADPCM.
# fmt: off
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
# fmt: on


def mu_law_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte (ITU-T G.711): inverted bits, sign, 3 bits of exponent, 4 of mantissa."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte (ITU-T G.711): even bits inverted, set sign bit for positive samples."""
    code = np.arange(256) ^ 0x55
    exponent, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, low + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + nibble: the change of the sample, and the next step index * 16."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + CHANGES[None, :], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


MU, A = mu_law_table(), a_law_table()
CHANGE, NEXT = adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (n, size) -> samples (n, 2 * size - 7); each step works on all blocks at once.

    A block starts with its first sample (2 bytes), a step index (clipped to the table) and a reserved byte.
    """
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = sample
    for k, code in enumerate(codes):
        for half, nibble in enumerate((code & 15, code >> 4)):
            at = index + nibble
            sample += CHANGE[at]
            np.clip(sample, -32768, 32767, out=sample)
            index = NEXT[at]
            out[1 + 2 * k + half] = sample
    return out.T


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation of frames (n, channels) from one rate to another, in whole numbers; the last frame is held."""
    if not len(pcm):
        return pcm.astype("<i2")
    wide = pcm.astype(np.int32)
    step = np.diff(wide, axis=0, append=wide[-1:])
    if target % source == 0:
        factor = target // source
        return (wide[:, None] + step[:, None] * np.arange(factor)[None, :, None] // factor).astype("<i2").reshape(-1, pcm.shape[1])
    place = np.arange(len(pcm) * target // source, dtype=np.int64) * source
    at, part = place // target, (place % target)[:, None]
    return (wide[at] + step[at].astype(np.int64) * part // target).astype("<i2")


def to_wav(payload: bytes, tag: int, rate: int = RATE, channels: int = 1) -> bytes:
    """A WAV file around samples that are already coded."""
    if tag == IMA_ADPCM:
        per_block = 2 * UNIT - 7
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * UNIT // per_block, UNIT, 4, 2, per_block)
    else:
        width = 2 if tag == PCM else 1
        form = struct.pack("<HHIIHHH", tag, channels, rate, rate * width * channels, width * channels, 8 * width, 0)
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Wav(NamedTuple):
    tag: int
    channels: int
    rate: int
    block: int
    payload: bytes


def from_wav(media: bytes | None) -> Wav | None:
    """The parts of a WAV file; None for null, other or broken media, and for codes, sizes and channels not known here."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and n >= 16 and at + 24 <= len(media):
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data" and form:
            tag, channels, rate, _, block, bits = form
            good = {PCM: bits == 16, A_LAW: bits == 8, MU_LAW: bits == 8, IMA_ADPCM: bits == 4 and channels == 1 and block > 4}.get(tag)
            return Wav(tag, channels, rate, block, media[at + 8 : at + 8 + n]) if good and channels and rate else None
        at += 8 + n + n % 2
    return None


def expanded(files: list[Wav | None]) -> list[np.ndarray | None]:
    """16-bit frames (n, channels) of each file; what is left of a last frame or block that is not whole is not heard.

    ADPCM blocks of one size are decoded together, whichever files they are from.
    """
    out: list[np.ndarray | None] = [None] * len(files)
    blocks: dict[int, list[int]] = {}
    for k, file in enumerate(files):
        if file is None:
            continue
        if file.tag == IMA_ADPCM:
            blocks.setdefault(file.block, []).append(k)
            continue
        codes = np.frombuffer(file.payload, np.uint8)
        pcm = codes[: len(codes) // 2 * 2].view("<i2") if file.tag == PCM else (MU if file.tag == MU_LAW else A)[codes]
        out[k] = pcm[: len(pcm) // file.channels * file.channels].reshape(-1, file.channels)
    for size, rows in blocks.items():
        codes = [np.frombuffer(files[k].payload, np.uint8) for k in rows]
        for k, pcm in zip(rows, decoded_units(codes, size), strict=True):
            out[k] = pcm[:, None]
    return out


def decoded_units(codes: list[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """The ADPCM samples of each array of bytes, its whole blocks decoded together with the others', so many at a time."""
    counts = [len(c) // size for c in codes]
    blocks = np.concatenate([c[: n * size] for c, n in zip(codes, counts, strict=True)]).reshape(-1, size)
    pcm = np.concatenate([decode_adpcm(blocks[k : k + 16384]) for k in range(0, max(1, len(blocks)), 16384)])
    at = 0
    for n in counts:
        yield pcm[at : at + n].ravel()
        at += n


def media_of(texts: list[bytes], tag: int) -> list[bytes]:
    """Each text's bytes, zeros up to a positive multiple of 64, as the coded samples of a WAV file."""
    return [to_wav(t + bytes(max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)), tag) for t in texts]


def pcm_of(media: list[bytes | None], rate: int) -> list[bytes | None]:
    """Each WAV file expanded and resampled, as a PCM WAV file; None where the media can't be read."""
    files = [from_wav(m) for m in media]
    return [to_wav(resample(pcm, f.rate, rate).tobytes(), PCM, rate, f.channels) if f else None for f, pcm in zip(files, expanded(files), strict=True)]


def _loudness(name: str, pcm: np.ndarray) -> str:
    wide = np.abs(pcm.astype(np.int32))
    peak, mean = (int(wide.max()), int(wide.sum(dtype=np.int64)) // len(pcm)) if len(pcm) else (0, 0)
    return f"{name}:n={len(pcm)},peak={peak},mean={mean},crossings={np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0))}"


def features_of(media: list[bytes | None], pcm_media: list[bytes | None]) -> tuple[list[bytes | None], list[str | None]]:
    """The payloads read back, and features of both files; None where either can't be read.

    A feature has count, peak, mean size and zero crossings of the payload's samples under each telephony code (its whole
    units of 64 bytes are also ADPCM blocks), and number and checksum of the samples of the stored PCM file.
    """
    files, stored = [from_wav(m) for m in media], [from_wav(m) for m in pcm_media]
    codes = [np.frombuffer(f.payload if f else b"", np.uint8) for f in files]
    features: list[str | None] = []
    for file, pcm, code, adpcm in zip(files, stored, codes, decoded_units(codes, UNIT), strict=True):
        parts = (_loudness("mu", MU[code]), _loudness("a", A[code]), _loudness("adpcm", adpcm))
        features.append(";".join((*parts, f"pcm:n={len(pcm.payload) // 2},rate={pcm.rate},crc={zlib.crc32(pcm.payload):08x}")) if file and pcm else None)
    return [f.payload if f else None for f in files], features


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows with a bounded size, and the values of a binary column."""
    for batch in batches:
        for rows, _, _ in text_slices(batch, column, SLICE):
            yield rows, rows.column(column).to_pylist()


def _with(rows: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, *columns.values()], [*rows.schema.names, *columns])


def text_media(docs: DataFrame, tag: int = MU_LAW) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes long, media binary).  64 bytes are also the block of the ADPCM form, so
    nothing is lost whatever the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _slices(batches, "text"):
            raw = [t or b"" for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media_of(raw, tag), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored_pcm(df: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """df(.., media) with pcm_media binary: the media column expanded and resampled, as PCM WAV files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, media in _slices(batches, "media"):
            yield _with(rows, pcm_media=pa.array(pcm_of(media, rate), pa.binary()))

    df = df.drop("pcm_media")
    return df.mapInArrow(run, schema_with(df, pcm_media="binary"))


def media_features(df: DataFrame) -> DataFrame:
    """df(.., media, pcm_media) plus payload binary (read back) and feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, media in _slices(batches, "media"):
            payloads, features = features_of(media, rows.column("pcm_media").to_pylist())
            yield _with(rows, payload=pa.array(payloads, pa.binary()), feature=pa.array(features, pa.string()))

    df = df.drop("payload", "feature")
    return df.mapInArrow(run, schema_with(df, payload="binary", feature="string"))


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm_bytes long, pcm_sha256 string, feature string"


def text_digests(docs: DataFrame, tag: int = MU_LAW, rate: int = PCM_RATE) -> DataFrame:
    """docs(doc_id, text) -> sizes and digests of the payload read back, its media and its stored PCM, and the feature.

    The same steps as text_media, stored_pcm and media_digests, one slice of rows after the other, with nothing stored in between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda values: [hashlib.sha256(v).hexdigest() for v in values]
        size = lambda values: pa.array([len(v) for v in values], pa.int64())
        for rows, texts in _slices(batches, "text"):
            raw = [t or b"" for t in texts]
            media = media_of(raw, tag)
            pcm = pcm_of(media, rate)
            payloads, features = features_of(media, pcm)
            tails = pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64())
            columns = [rows.column("doc_id"), size(raw), size(payloads), pa.array(sha(payloads)), tails, size(media), pa.array(sha(media)), size(pcm), pa.array(sha(pcm)), pa.array(features)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, DIGESTS)


def media_digests(df: DataFrame) -> DataFrame:
    """df(doc_id, n_bytes, media, pcm_media) -> DIGESTS, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda values: [hashlib.sha256(v).hexdigest() for v in values]
        size = lambda values: pa.array([len(v) for v in values], pa.int64())
        for rows, media in _slices(batches, "media"):
            pcm = rows.column("pcm_media").to_pylist()
            payloads, features = features_of(media, pcm)
            tails = pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64())
            columns = [rows.column("doc_id"), rows.column("n_bytes"), size(payloads), pa.array(sha(payloads)), tails, size(media), pa.array(sha(media)), size(pcm), pa.array(sha(pcm)), pa.array(features)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])

    return df.select("doc_id", "n_bytes", "media", "pcm_media").mapInArrow(run, DIGESTS)


def stored_digests(spark: SparkSession, docs: DataFrame, tag: int = MU_LAW, rate: int = PCM_RATE, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> DIGESTS, by way of stored columns: media are written, PCM is made from the media read back and
    written beside them, and sizes, digests and features come from both as read back.

    PCM is four times the text, so documents are dealt to rounds by a hash; the columns of a round go when its digests are whole.
    """
    out = None
    for k in range(rounds):
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k)
        media = written(spark, text_media(some, tag), "media", codec="zstd")
        pcm = written(spark, stored_pcm(media, rate), "pcm", media, codec="zstd")
        digests = written(spark, media_digests(pcm), "digests", pcm)
        out = digests if out is None else out.unionByName(digests)
    return out


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), MU_LAW)
