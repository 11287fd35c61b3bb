"""Encoding of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import struct
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.bounded import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary splits a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker keeps; it forgets all when there are more.
_KEEP = 400_000


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself where printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _field(number: int, kind: int, value: bytes | int | float) -> bytes:
    """A protobuf field of kind 0 (integer), 2 (bytes) or 5 (float)."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    head = varint(number << 3 | kind)
    return head + (varint(value) if kind == 0 else struct.pack("<f", value) if kind == 5 else varint(len(value)) + value)


def sentencepiece_model(vocabulary: str = VOCABULARY) -> bytes:
    """A sentencepiece BPE model of a vocabulary of ranked byte strings.

    Piece n is the byte string of rank n, its bytes written as letters, scored -n: the best
    score merges first, as the lowest rank does. Normalisation is the identity. The unknown
    piece that a model must have follows the last rank; it never occurs, as all 256 bytes are
    pieces.
    """
    letters = byte_letters()
    with open(vocabulary, "rb") as file:
        ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in file if line.strip()))
    piece = lambda text, score, kind: _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, score) + _field(3, 0, kind))
    pieces = [piece("".join(letters[b] for b in token), -float(rank), 1) for rank, token in ranks]
    pieces.append(piece("<unk>", -float(len(ranks)), 2))
    trainer = _field(3, 0, 2) + _field(4, 0, len(pieces)) + _field(40, 0, len(ranks))
    normalizer = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class Encoder:
    """Texts to ids and back with a model of ``sentencepiece_model``."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.letters = {b: c for b, c in byte_letters().items()}
        self.bytes: list[bytes] = []
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for an empty or null text."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > _KEEP:
            self.known.clear()
        known = self.known
        new = list({t for tokens in split for t in tokens if t not in known})
        written = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for t in new]
        known.update(zip(new, self.pieces.encode(written, num_threads=1) if new else [], strict=True))
        return [[i for t in tokens for i in known[t]] for tokens in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the inverse mapping of letters to bytes."""
        if not self.bytes:
            of = {c: b for b, c in self.letters.items()}
            self.bytes = [bytes(of[c] for c in self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size() - 1)]
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "surrogatepass")


def _encoder(model: bytes) -> Encoder:
    """The worker's encoder for a model, kept between tasks."""
    kept = sys.modules.setdefault("_tamarack_encoders", types.ModuleType("_tamarack_encoders")).__dict__
    key = f"encoder_{hash(model)}"
    if key not in kept:
        kept[key] = Encoder(model)
    return kept[key]


def _udf(spark: SparkSession, vocabulary: str, counts: bool):  # noqa: ANN202
    model = spark.sparkContext.broadcast(sentencepiece_model(vocabulary))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model.value)
        for texts in batches:
            ids = encoder.encode([t if isinstance(t, str) else None for t in texts])
            yield pd.Series([len(x) for x in ids] if counts else ids, dtype="int64" if counts else object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long" if counts else "array<int>")


def token_ids(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The ids of a text as an array; an empty array for an empty or null text.

    Nothing written in a text counts as a special token. The model (about 1 MB, as large as the
    vocabulary) is built on the driver and broadcast; workers need no files. A text is encoded
    whole, whatever its length.
    """
    return _udf(spark, vocabulary, counts=False)(text)


def token_count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of ids of a text; 0 for an empty or null text."""
    return _udf(spark, vocabulary, counts=True)(text)


def encode_corpus(documents: DataFrame, *, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ids of every row; repeated rows stay, other columns are ignored.

    A table of fewer files than cores is dealt out first, else nothing is shuffled.
    """
    texts = spread(documents.select(F.col(doc_id).alias(doc_id), F.col(text).alias("_text")))
    return texts.select(doc_id, token_ids(documents.sparkSession, F.col("_text"), vocabulary).alias("ids"))


def decode_corpus(encoded: DataFrame, *, doc_id: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and text of every row, from its ids: the inverse of ``encode_corpus``; null ids give an empty text.

    Ids that the vocabulary doesn't have raise. Repeated rows stay, other columns are ignored.
    """
    model = encoded.sparkSession.sparkContext.broadcast(sentencepiece_model(vocabulary))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model.value)
        for rows in batches:
            yield pd.Series(["" if x is None else encoder.decode([int(i) for i in x]) for x in rows], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.select(F.col(doc_id).alias(doc_id), F.pandas_udf(run, "string")(F.col(ids)).alias("text"))
