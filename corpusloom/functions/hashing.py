"""XXH64 with seed 0 as 16 hex digits, and short line tokens made of it. Spark's own xxhash64 has another seed."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the alphabet of line tokens
ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"


def line_token(line: str, length: int = 3) -> str:
    """The first `length` (2 to 8) five-bit groups of the hash of the trimmed line."""
    length = min(max(length, 2), 8)
    h = xxhash.xxh64_intdigest(line.strip().encode("utf-8", "surrogatepass"))
    return "".join(ALPHABET[(h >> (59 - 5 * k)) & 31] for k in range(length))


def content_hash(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t.encode("utf-8", "surrogatepass")))

    return run(text)


def line_tokens(line: Column, length: int = 3) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else line_token(t, length))

    return run(line)
