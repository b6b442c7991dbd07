"""Labels, durations, sizes, dates, JSON within text, and vectors as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: seconds of a unit of time
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def label(n: Column) -> Column:
    """0 is a, 25 z, 26 aa, and so on up to four letters; null for negative or larger numbers."""
    starts = [0, 26, 26 + 26**2, 26 + 26**2 + 26**3, 26 + 26**2 + 26**3 + 26**4]
    letter = lambda x: F.char(F.lit(97) + x)
    out = F.when(n < 0, None)
    for k in range(4):
        rest = n - starts[k]
        out = out.when(n < starts[k + 1], F.concat(*[letter(F.pmod(F.floor(rest / 26 ** (k - i)), F.lit(26))) for i in range(k + 1)]))
    return out.otherwise(None)


def label_index(text: Column) -> Column:
    """The number of a label; null for anything but one to six lower-case letters."""
    index = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 96) - 1
    return F.when(text.rlike("^[a-z]{1,6}$"), index)


def label_list(text: Column) -> Column:
    """The numbers of comma-separated labels, null where one of them is none; null for an empty list."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.lower(F.btrim(p))), lambda p: p != "")
    numbers = F.transform(parts, label_index)
    return F.when((F.size(parts) > 0) & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values as often, in any order; null counts as empty."""
    none = lambda x: F.coalesce(F.array_sort(x), F.array().cast("array<long>"))
    return none(a) == none(b)


def duration_seconds(text: Column) -> Column:
    """Seconds of '12h', '2d', '1w', '30m' or '45s'; null for anything else."""
    n, unit = F.regexp_extract(text, r"^(\d{1,9})([smhdw])$", 1), F.regexp_extract(text, r"^(\d{1,9})([smhdw])$", 2)
    factor = F.when(F.lit(False), 0)
    for u, seconds in UNITS.items():
        factor = factor.when(unit == u, seconds)
    return F.nullif(n, F.lit("")).cast("long") * factor


def format_duration(seconds: Column) -> Column:
    """Whole minutes below an hour, hours below a day, else days: 30m, 5h, 2d."""
    whole = lambda unit: F.concat(F.floor(seconds / UNITS[unit]).cast("string"), F.lit(unit))
    return F.when(seconds < 3600, whole("m")).when(seconds < 86400, whole("h")).otherwise(whole("d"))


def format_bytes(n: Column) -> Column:
    """512 B, 1.5 KB, 2.0 MB: powers of 1024 with one digit."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate("KMGTP", 1):
        out = out.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}B")))
    return out.otherwise(F.concat(F.format_string("%.1f", n / float(1024**6)), F.lit(" EB")))


def parse_date(text: Column) -> Column:
    """A timestamp from a day or an RFC 3339 time with up to nine digits of a second; null for anything else."""
    shaped = text.rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d))?$")
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))


def json_text(text: Column) -> Column:
    """The JSON object within a text: all of it, the body of its first fenced block, or the first object with balanced braces; null without one.

    Braces within strings do not count. Only texts that are neither pure nor fenced are scanned character by character.
    """
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{"), F.trim(c))
    fenced = F.nullif(F.btrim(F.regexp_extract(text, r"```(?:json)?[ \t]*\n((?s).*?)\n?```", 1), F.lit(" \t\r\n")), F.lit(""))
    rest = F.nullif(F.substring(text, F.greatest(F.instr(text, "{"), F.lit(1)), F.length(text)), F.lit(""))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("k"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        change = F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        depth = s["depth"] + change
        done = (s["end"] == 0) & (change == -1) & (depth == 0)
        return F.struct(depth.alias("depth"), (s["quoted"] != ((c == '"') & ~s["escaped"])).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), (s["k"] + 1).alias("k"), F.when(done, s["k"] + 1).otherwise(s["end"]).alias("end"))

    balanced = F.when(text.contains("{"), F.substring(rest, F.lit(1), F.aggregate(F.split(rest, ""), start, step)["end"]))
    return F.coalesce(valid(text), valid(fenced), valid(balanced))


def float_bytes(vector: Column) -> Column:
    """A vector as little-endian floats of four bytes each; null stays null, missing numbers become NaN."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(vector)


def floats_of(data: Column) -> Column:
    """The vector of float_bytes; null where the length is no multiple of four."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return run(data)


def small_ints(vector: Column) -> Column:
    """A vector as signed bytes, numbers cut towards zero and held within -128 to 127."""
    return F.transform(vector, lambda x: F.greatest(F.least(x, F.lit(127.0)), F.lit(-128.0)).cast("tinyint"))
