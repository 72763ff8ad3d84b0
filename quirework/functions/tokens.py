"""Token counters behind one interface: a column of texts to a column of counts."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

Counter = Callable[[Column], Column]


def word_counter(text: Column) -> Column:
    """The offline default: runs of non-blank characters. All budget logic is the same with any counter."""
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+", -1), lambda w: w != ""))


@lru_cache(maxsize=4)
def _encoding(name: str):
    import tiktoken

    return tiktoken.get_encoding(name)


def tiktoken_counter(name: str = "cl100k_base") -> Counter:
    """Counts by a byte-pair encoding; its vocabulary has to be cached on the executors. Text that looks
    like a special token counts as plain text."""

    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(name)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encoding.encode(t, disallowed_special=())))

    return count


# How a text is cut before pairs of bytes are merged.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding_of(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as fh:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, fh)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_counter(path: str, pattern: str = PRE_TOKENS) -> Counter:
    """Counts by the byte-pair ranks of a file (a token in base64 and its rank on each line), which executors read at
    ``path``. Text that looks like a special token counts as plain text."""

    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding_of(path, pattern)
        for texts in batches:
            ids = encoding.encode_ordinary_batch([t or "" for t in texts], num_threads=1)
            out = pd.Series([None if t is None else len(i) for t, i in zip(texts, ids)], dtype="Int32")
            yield out

    return count


def pick_counter(name: str = "cl100k_base") -> tuple[str, Counter]:
    """The encoding if its vocabulary can be had, else the word counter, and the name of which it is."""
    try:
        _encoding(name)
    except Exception:
        return "words", word_counter
    return name, tiktoken_counter(name)
