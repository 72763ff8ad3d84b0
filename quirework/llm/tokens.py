"""Problem 7: token ids of every text by a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised directly from the rank file: each token becomes a piece whose
bytes are mapped one to one to printable characters, its score is the negative rank, and the normaliser
is the identity. Merging by the highest score is then merging by the lowest rank, so the ids are those of
the vocabulary. Texts are cut into pre-tokens first, as the vocabulary prescribes, and each is encoded
by itself; decoding maps pieces back to bytes.

Defined cases: null and empty texts give an empty list; text that looks like a special token is plain
text; row count and row order within a partition are kept; repeated ids stay repeated rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pre-tokens whose ids a worker keeps; beyond it the table is emptied, results do not change.
CACHE_ENTRIES = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_alphabet() -> list[str]:
    """One printable character for each byte: the byte's own Latin-1 character where that is printable,
    else the next free one from U+0100 on."""
    own = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, in rank order."""
    with open(path, "rb") as fh:
        pairs = [line.split() for line in fh if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise_model(tokens: list[bytes]) -> bytes:
    """ModelProto in wire format: pieces (1), trainer_spec (2), normalizer_spec (3).

    The unknown piece, which the format demands, takes the free id after the last rank; every byte has
    a piece, so it is never produced.
    """
    alphabet = byte_alphabet()
    pieces = []
    for rank, token in enumerate(tokens):
        body = _block(1, "".join(alphabet[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)
        pieces.append(_block(1, body))
    unk = len(tokens)
    pieces.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, unk + 1) + _number(40, unk) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """Encoder and decoder over one serialised model."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.cut = regex.compile(pattern).findall
        alphabet = byte_alphabet()
        self.to_piece = dict(enumerate(alphabet))  # Latin-1 text of the bytes -> mapped text
        self.to_byte = {c: b for b, c in enumerate(alphabet)}
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        new = [p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in self.known]
        if new:
            mapped = [p.encode().decode("latin-1").translate(self.to_piece) for p in new]
            self.known.update(zip(new, self.processor.encode(mapped, out_type=int, num_threads=1)))
        known = self.known
        return [[i for p in parts for i in known[p]] for parts in cut]

    def decode(self, ids: Iterable[int]) -> str:
        pieces = "".join(self.processor.id_to_piece(list(ids)))
        return bytes(self.to_byte[c] for c in pieces).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec_of(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def encode_text(df: DataFrame, text: str = "text", out: str = "ids", *, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with the ids of column ``text`` in column ``out`` (replaced if it exists).

    A narrow stage: one pass over the texts, no shuffle. What is broadcast is the model, whose size is
    that of the vocabulary file and does not grow with the corpus.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(vocabulary or default_vocabulary())))
    cut = pattern or default_pattern()

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(model.value, cut)
        for batch in batches:
            yield pd.Series(codec.encode_batch(t if isinstance(t, str) else None for t in batch), dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def p7_ids(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_text(documents).select("doc_id", "ids")
