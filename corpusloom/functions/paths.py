"""Column builders for paths and section slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(path: Column) -> Column:
    """Absolute form of a path: backslashes count as slashes, empty and '.' segments go, '..' removes one.

    A null stays null; '..' above the root is dropped.
    """
    segments = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    plain = ~path.contains("\\") & ~path.contains("//") & ~path.contains("/.") & path.startswith("/") & ~path.endswith("/")
    return F.when(plain, path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def slug(heading: Column) -> Column:
    """Lower case, runs outside [a-z0-9-] become one '-', repeats collapse, outer '-' go."""
    dashed = F.regexp_replace(F.lower(heading), "[^a-z0-9-]+", "-")
    return F.btrim(F.regexp_replace(dashed, "-{2,}", "-"), F.lit("-"))


def parent_of(path: Column) -> Column:
    """The folder a path lies in; '' for a name without a slash."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, '' when the base name has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
