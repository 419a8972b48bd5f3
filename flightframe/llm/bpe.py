"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised straight from the vocabulary.

A vocabulary file lists base64 tokens with their ranks.  Each byte is mapped to one printable character, so every token
is a piece; its score is the negative rank, so the lowest rank merges first.  Texts are cut into pre-tokens by a
pattern, each is encoded by itself; decoding maps pieces back to bytes.

Null texts count as empty and give no ids; repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.shared import schema_with, table

#: The vocabulary goes to the executors with the tasks, so its size is bounded.
MOST_VOCABULARY_BYTES = 16 << 20


def byte_characters() -> list[str]:
    """For each byte a printable character: itself if Latin-1 prints it, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in own)
    extra = {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [extra.get(b, chr(b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes by length, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece k is tokens[k] in mapped characters, and an unknown piece at the end."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, normal) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes in one worker.  Spaces between words are safe cuts, so results are kept per word."""

    MOST_KEPT = 200_000
    #: Longer words are encoded each time they come.
    LONGEST_KEPT = 64

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        chars = byte_characters()
        self.mapping = {b: c for b, c in enumerate(chars) if c != chr(b)}
        inverse = {c: b for b, c in enumerate(chars)}
        n = self.model.get_piece_size() - 1
        self.tokens = [bytes(inverse[c] for c in self.model.id_to_piece(k)) for k in range(n)]
        # \s of the pattern is Unicode's white space; the regex module's own \s has a few control characters more
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.first: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}

    def _encode_all(self, chunks: Iterable[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit integers."""
        cuts = [self.pattern.findall(c) for c in chunks]
        pre_tokens = list({t for cut in cuts for t in cut})
        mapped = [t.encode().decode("latin-1").translate(self.mapping) for t in pre_tokens]
        ids = self.model.encode(mapped, out_type=int, num_threads=1) if mapped else []
        packed = {t: struct.pack(f"<{len(k)}I", *k) for t, k in zip(pre_tokens, ids, strict=True)}
        return [b"".join([packed[t] for t in cut]) for cut in cuts]

    def _learn(self, known: dict[str, bytes], chunks: set[str], space: str) -> dict[str, bytes]:
        """known with all chunks; those too long to keep come in a copy of their own."""
        new = [c for c in chunks if c not in known]
        got = dict(zip(new, self._encode_all(space + c for c in new), strict=True))
        if len(known) + len(got) > self.MOST_KEPT:
            kept = {c: known[c] for c in chunks if c in known}
            known.clear()
            known.update(kept)
        long = {c: x for c, x in got.items() if len(c) > self.LONGEST_KEPT}
        known.update((c, x) for c, x in got.items() if c not in long)
        return known | long if long else known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts may be cut before a single space between two other characters: a pre-token takes one leading space at
        most and white space follows a word only in a pre-token of its own, so none crosses such a cut."""
        parts = [t.split(" ") if not re.search(r"\s \s?| \s|^ | $", t) else re.split(r"(?<=\S) (?=\S)", t) for t in texts]
        out = []
        for at in range(0, len(parts), 512):
            some = parts[at : at + 512]
            first = self._learn(self.first, {p[0] for p in some}, "")
            rest = self._learn(self.after_space, {c for p in some for c in p[1:]}, " ")
            out += [first[p[0]] + b"".join(map(rest.__getitem__, p[1:])) for p in some]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapped(df: DataFrame, column: str, added: str, model: bytes, pattern: str, work: Callable[[Codec, pa.Array], list[bytes]]) -> DataFrame:
    """df with a binary column (in place of one of that name) that work makes from another one, slices of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array(work(codec, part.column(column)), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, added])

    df = df.drop(added)
    return df.mapInArrow(run, schema_with(df, **{added: "binary"}))


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of ids, little-endian unsigned 32-bit integers in order."""
    work = lambda codec, column: codec.encode([t or "" for t in column.to_pylist()])
    return _mapped(docs, text, ids, serialise_model(read_ranks(vocabulary)), pattern, work)


def decode_ids(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with a binary column of the decoded bytes."""
    work = lambda codec, column: [codec.decode(x or b"") for x in column.to_pylist()]
    return _mapped(df, ids, decoded, serialise_model(read_ranks(vocabulary)), pattern, work)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text, ids, decoded) of docs."""
    return decode_ids(encode_texts(docs.select("doc_id", "text"), vocabulary, pattern), vocabulary, pattern)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
