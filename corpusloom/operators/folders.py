"""Folder rows checked, described and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import resolve
from corpusloom.functions.text import first_sentence

# fixed values: capitalised words that name nothing
COMMON_WORDS = (
    "The This That These Those A An And Or But For Of In On At To From By With Without It Its Their His Her Use Used Useful Uses When Where What "
    "Which Who Why How Files File Folder Folders Notes Note Docs Doc Code Source Tests Test Includes Include Contains Contain Holds Hold Stores "
    "Store Provides Provide Tracks Track Captures Capture Records Record"
).split()


def children(folders: DataFrame) -> DataFrame:
    """(collection_id, path, place, child) with the entries of `children` as paths from the collection root; null entries are left out."""
    e = folders.select("collection_id", "path", F.posexplode("children").alias("place", "entry")).where("entry is not null")
    full = F.when(F.col("entry").contains("/"), F.col("entry")).otherwise(F.concat(F.col("path"), F.lit("/"), "entry"))
    return e.select("collection_id", "path", "place", F.substring(resolve(F.concat(F.lit("/"), full)), F.lit(2), F.length(full) + 1).alias("child"))


def defects(folders: DataFrame) -> DataFrame:
    """(collection_id, path, kind, detail) of folder rows.

    missing_index: files but no index. parse_error. missing_purpose: an index that reads well but says nothing. orphaned: a listed child
    without a row. repeated: a child listed more than once. unlisted: a row that its parent's list leaves out. wrong_depth: another number of
    segments than `depth`. Ignored folders and all below them are not looked at; repeated rows count once.
    """
    f = folders.distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hidden = f.where("ignored").select("collection_id", F.col("path").alias("root")).distinct()
    under = f.select("collection_id", "path", F.explode(above).alias("root")).join(hidden, ["collection_id", "root"], "left_semi").select("collection_id", "path").distinct()
    f = f.join(under, ["collection_id", "path"], "left_anti")
    none = F.lit("")
    indexed, well = F.coalesce("has_index", F.lit(False)), F.col("parse_error").isNull()
    found = F.array(
        F.when(~indexed & (F.col("file_count") > 0), F.struct(F.lit("missing_index").alias("kind"), none.alias("detail"))),
        F.when(~well, F.struct(F.lit("parse_error").alias("kind"), F.col("parse_error").alias("detail"))),
        F.when(indexed & well & (F.trim(F.coalesce("purpose", none)) == ""), F.struct(F.lit("missing_purpose").alias("kind"), none.alias("detail"))),
        F.when(F.size(parts) != F.col("depth"), F.struct(F.lit("wrong_depth").alias("kind"), F.col("depth").cast("string").alias("detail"))),
    )
    own = f.select("collection_id", "path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("collection_id", "path", "x.*")
    listed = children(f).groupBy("collection_id", "path", "child").agg(F.count("*").alias("times"))
    rows = folders.select("collection_id", F.col("path").alias("child")).distinct()
    kind = lambda df, k: df.select("collection_id", "path", F.lit(k).alias("kind"), F.col("child").alias("detail"))
    up = f.where(F.size(parts) > 1).select("collection_id", F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.col("path").alias("child")).distinct()
    lists = f.where("children is not null").select("collection_id", "path").distinct()
    unlisted = up.join(lists, ["collection_id", "path"], "left_semi").join(listed, ["collection_id", "path", "child"], "left_anti")
    return own.unionByName(kind(listed.join(rows, ["collection_id", "child"], "left_anti"), "orphaned")).unionByName(kind(listed.where("times > 1"), "repeated")).unionByName(kind(unlisted, "unlisted"))


def digests(folders: DataFrame, most: int = 500) -> DataFrame:
    """(collection_id, digest): the first sentences of the purposes in order of path, until `most` bytes are reached; cut there, with '...'.

    Every sentence takes at least two characters with its blank, so the first `most` sentences are enough. Folders without a purpose are passed over.
    """
    said = folders.select("collection_id", "path", first_sentence(F.regexp_replace(F.trim("purpose"), "\n", " ")).alias("s")).where("s <> ''").distinct()
    first = said.withColumn("place", F.row_number().over(Window.partitionBy("collection_id").orderBy("path", "s"))).where(F.col("place") <= most)
    rows = first.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("rows"))
    text = F.aggregate("rows", F.lit(""), lambda acc, r: F.when(F.octet_length(acc) >= most, acc).when(acc == "", r["s"]).otherwise(F.concat(acc, F.lit(" "), r["s"])))
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.trim(F.substring(t, 1, most)), F.lit("..."))).otherwise(t)
    return rows.select("collection_id", text.alias("digest")).select("collection_id", cut(F.col("digest")).alias("digest"))


def markdown(folders: DataFrame) -> DataFrame:
    """(collection_id, path, block): each folder as Markdown; headings as deep as the path (at most 6), purpose, counts, hints when to use it, children.

    Lists are sorted and without repeats or nulls, so equal rows give equal bytes.
    """
    level = F.least(F.size(F.split("path", "/")), F.lit(6))
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != ""))))
    bullets = lambda name, c: F.when(F.size(clean(c)) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(clean(c), lambda x: F.concat(F.lit("- "), x)), "\n")))
    counts = F.concat(F.coalesce("file_count", F.lit(0)), F.lit(" files, "), F.coalesce("word_count", F.lit(0)), F.lit(" words"))
    block = F.concat_ws("\n\n", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "path"), F.nullif(F.trim("purpose"), F.lit("")), counts, bullets("Use when", F.col("use_when")), bullets("Folders", F.col("children")))
    return folders.distinct().select("collection_id", "path", block.alias("block"))


def write_markdown(folders: DataFrame, target: str) -> None:
    """The blocks as text files, a folder per collection and sorted by path within each file."""
    blocks = markdown(folders).select("collection_id", "path", F.concat("block", F.lit("\n")).alias("value"))
    blocks.repartitionByRange("collection_id", "path").sortWithinPartitions("collection_id", "path").select("collection_id", "value").write.mode("overwrite").partitionBy("collection_id").text(target)


def naming_words(text: Column) -> Column:
    """Lower-case words of a text that name something: capitalised within a sentence and not common, or with a digit.

    Compounds are taken apart at '-', '/' and dashes, where bare numbers count as quantities; a possessive 's goes.
    """
    edge = r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$"
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    begins = lambda k: (k == 0) | F.coalesce(F.get(words, k - 1).rlike("[.!?]$"), F.lit(False))
    parts = F.flatten(F.transform(words, lambda w, k: F.transform(F.split(F.regexp_replace(w, edge, ""), "[-/—–]"), lambda p: F.struct(F.regexp_replace(F.regexp_replace(p, "(?i)('s|’s)$", ""), edge, "").alias("w"), begins(k).alias("begins"), F.regexp_replace(w, edge, "").rlike("[-/—–]").alias("joined")))))
    names = lambda p: (~p["begins"] & p["w"].rlike("^[A-Z]") & p["w"].rlike("[A-Z][a-zA-Z0-9]+") & ~p["w"].isin(COMMON_WORDS)) | p["w"].rlike("[0-9]")
    kept = F.filter(parts, lambda p: names(p) & ~(p["joined"] & p["w"].rlike("^[0-9]+$")))
    return F.array_distinct(F.transform(kept, lambda p: F.lower(p["w"])))


def ungrounded(purposes: DataFrame, texts: DataFrame) -> DataFrame:
    """(folder, word): naming words of (folder, purpose) that stand in none of its (folder, text) nor in a segment of its path.

    Each text is searched for its folder's few words; found words are made distinct before the shuffle. Null texts hold nothing.
    """
    p = purposes.where("purpose is not null").groupBy("folder").agg(F.max("purpose").alias("purpose")).select("folder", naming_words(F.col("purpose")).alias("words")).where("size(words) > 0")
    hits = texts.where("text is not null").join(p, "folder").select("folder", F.explode(F.filter("words", lambda w: F.lower("text").contains(w))).alias("word")).distinct()
    every = p.select("folder", F.explode("words").alias("word")).where(~F.lower("folder").contains(F.col("word")))
    return every.join(hits, ["folder", "word"], "left_anti")
