"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import let_workers_import

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PIECE = 1 << 16  # characters encoded at a time; a longer text is cut where the tokenizer splits in any case, so its counts add up exactly
# between a character and the blank after it; runs of blanks so long that they are counted by themselves
_CUT, _BLANKS = re.compile(r"(?<=\S)[ \n]"), re.compile(r"[^\S\x1c-\x1f]{4096,}")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE whose ranks are stored at `path`, with the splitting pattern of its publisher."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = RANKS) -> int:
    """Number of tokens of the whole text; null and empty texts have none, lone surrogates count as '?'."""
    if not text:
        return 0
    e, total, at = encoder(path), 0, 0
    text = text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")
    # a run of blanks is one piece of the splitting pattern, but for its last blank where more text follows
    for m in _BLANKS.finditer(text) if len(text) > 4096 else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += _count(e, text[at : m.start()]) + len(e._encode_single_piece(text[m.start() : end]))
        at = end
    return total + _count(e, text[at:])


def _count(e, text: str) -> int:
    total, start = 0, 0
    while start < len(text):
        found = _CUT.search(text, start + PIECE) if len(text) - start > PIECE else None
        end = found.start() if found else len(text)
        total += len(e.encode_ordinary(text[start:end]))
        start = end
    return total


def with_tokens(texts: DataFrame, column: str = "text", path: str = RANKS) -> DataFrame:
    """`texts` with `n_tokens` in place of the text column; null and empty texts have none."""
    let_workers_import(texts.sparkSession)

    @F.pandas_udf("long")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([count_tokens(t, path) for t in s], dtype="int64")

    return texts.withColumn("n_tokens", size(F.col(column))).drop(column)
