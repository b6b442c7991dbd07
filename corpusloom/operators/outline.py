"""Documents as outlines: section chunks, snippets around the best line, excerpts and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import basename, slug
from corpusloom.functions.text import meaningful, title_from_name, truncate_bytes, word_count
from corpusloom.operators.documents import HEADING, nearest_parents, spans as section_spans, title

# blank lines, then a block between two lines of three or more '-' or of three or more '+'
_BLOCK = r"^(\s*\n)?([ \t]*(?:-{3,}[ \t\r]*\n(?:(?s:.*?)\n)?[ \t]*-{3,}|\+{3,}[ \t\r]*\n(?:(?s:.*?)\n)?[ \t]*\+{3,}))[ \t\r]*(?:\n|$)"


def _once(**columns: Column) -> Column:
    """A struct that is computed once however often it is used later: an explode of one element is not inlined."""
    return F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def _joined(lines: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, first, n), "\n")


def section_chunks(docs: DataFrame, max_chars: int = 2000, overlap: int = 5) -> DataFrame:
    """(id, chunk_order, parent_order, start_line, end_line, char_count, section_id, heading, level, content) of (id, text).

    One chunk per section with all below it; text before the first heading is a section of level 0, frontmatter a chunk of its own. A
    section of more than `max_chars` bytes is cut into groups of rows, of which content carries `overlap` rows more on either side
    within the section; the second group on get '::n' behind their id. A text without headings is one section without an id.
    parent_order is the nearest chunk before it with a lower level. Null and blank texts give no chunk.
    """
    d = docs.where("text is not null").select("id", _once(ls=F.split("text", "\n"), lead=F.regexp_extract("text", _BLOCK, 1), block=F.regexp_extract("text", _BLOCK, 2)).alias("d")).select("id", "d.*")
    marked = F.filter(F.transform("ls", lambda s, k: F.struct((k + 1).alias("start_line"), s.alias("s"))), lambda x: x["s"].rlike(HEADING))
    heads = F.transform(marked, lambda x: F.struct(x["start_line"].alias("start_line"), F.length(F.regexp_extract(x["s"], HEADING, 1)).alias("level"), F.trim(F.regexp_extract(x["s"], HEADING, 2)).alias("heading")))
    fm = F.when(F.col("block") == "", 0).otherwise(_breaks(F.col("lead")) + _breaks(F.col("block")) + 1)
    d = d.select("id", _once(ls=F.col("ls"), n=F.size("ls"), heads=heads, fm=fm, lead=_breaks(F.col("lead")) + 1, raw=F.regexp_replace("block", r"^[^\n]*\n|\n?[^\n]*$", "")).alias("d")).select("id", "d.*")
    # text before the first heading, or all of it where there is none
    first = F.get("heads", F.lit(0))["start_line"]
    before = F.struct(F.lit(1).alias("start_line"), (first - 1).alias("end_line"), F.lit(0).alias("level"), F.lit("").alias("heading"))
    whole = F.struct((F.col("fm") + 1).alias("start_line"), F.col("n").alias("end_line"), F.lit(0).alias("level"), F.lit("").alias("heading"))
    spans = F.when(first.isNull(), F.array(whole)).when((first > 1) & _joined(F.col("ls"), F.lit(1), first - 1).rlike(r"\S"), F.concat(F.array(before), section_spans(F.col("heads"), F.col("n")))).otherwise(section_spans(F.col("heads"), F.col("n")))
    begin = lambda s: F.greatest(s["start_line"], F.col("fm") + 1)
    fields = ("start_line", "end_line", "level", "heading")
    keep = lambda s, names: [s[k].alias(k) for k in names]
    bodies = F.transform(F.filter(spans, lambda s: begin(s) <= s["end_line"]), lambda s: F.struct(*keep(s, fields), begin(s).alias("a"), (s["end_line"] - begin(s) + 1).alias("rows"), _joined(F.col("ls"), begin(s), s["end_line"] - begin(s) + 1).alias("full")))
    judged = F.transform(F.filter(bodies, lambda s: s["full"].rlike(r"\S")), lambda s: F.struct(*keep(s, (*fields, "a", "rows", "full")), F.when(first.isNull(), F.rtrim(s["full"], F.lit("\n"))).otherwise(s["full"]).alias("body")))
    step = lambda s: F.greatest(F.lit(5), F.floor(max_chars / F.floor((F.octet_length(s["full"]) + 1) / s["rows"])).cast("int"))
    sized = F.transform(judged, lambda s: F.struct(*keep(s, (*fields, "a", "rows", "body")), F.when(F.octet_length(s["body"]) > max_chars, step(s)).alias("step"), slug(s["heading"]).alias("section_id")))
    single = lambda s: F.array(F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), s["body"].alias("core"), s["body"].alias("content")))

    def groups(s: Column) -> Column:
        count = lambda i: F.least(s["step"], s["rows"] - i)
        lo = lambda i: F.greatest(i - overlap, F.lit(0))
        hi = lambda i: F.least(i + count(i) + overlap, s["rows"])
        cut = F.transform(F.sequence(F.lit(0), s["rows"] - 1, F.coalesce(s["step"], F.lit(1))), lambda i: F.struct((s["a"] + i).alias("start_line"), (s["a"] + i + count(i) - 1).alias("end_line"), _joined(F.col("ls"), s["a"] + i, count(i)).alias("core"), _joined(F.col("ls"), s["a"] + lo(i), hi(i) - lo(i)).alias("content")))
        return F.filter(cut, lambda x: x["core"].rlike(r"\S"))

    named = lambda s, p: F.when(p == 0, s["section_id"]).when(s["section_id"] == "", F.concat(F.lit("part-"), p + 1)).otherwise(F.concat(s["section_id"], F.lit("::"), p + 1))
    chunk = lambda s, x, p: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), F.octet_length(x["core"]).alias("char_count"), named(s, p).alias("section_id"), s["heading"].alias("heading"), s["level"].alias("level"), x["content"].alias("content"))
    made = F.flatten(F.transform(sized, lambda s: F.transform(F.when(s["step"].isNull(), single(s)).otherwise(groups(s)), lambda x, p: chunk(s, x, p))))
    front = F.array(F.struct(F.col("lead").alias("start_line"), F.col("fm").alias("end_line"), F.octet_length("raw").alias("char_count"), F.lit("frontmatter").alias("section_id"), F.lit("").alias("heading"), F.lit(0).alias("level"), F.col("raw").alias("content")))
    rows = d.select("id", F.posexplode(F.when(F.col("fm") > 0, F.concat(front, made)).otherwise(made)).alias("chunk_order", "c")).select("id", "chunk_order", "c.*")
    # only orders and levels are shuffled for the parents, and joined by the row's place
    levels = rows.select(F.col("id").alias("file_id"), F.col("chunk_order").alias("id"), "chunk_order", "level").where("level between 1 and 6")
    parents = nearest_parents(levels).where("parent_id is not null").select(F.col("file_id").alias("id"), "chunk_order", F.col("parent_id").alias("parent_order"))
    return rows.join(parents, ["id", "chunk_order"], "left").select("id", "chunk_order", "parent_order", "start_line", "end_line", "char_count", "section_id", "heading", "level", "content")


def line_snippets(docs: DataFrame, words: list[str], window: int = 7) -> DataFrame:
    """(id, best_line, snippet): the line with most different words and the nearest meaningful lines, `window` in all, in order of the text.

    Of two lines at the same distance the upper one is nearer. '...' stands where the snippet does not reach the start or end. A text of at
    most `window` lines is its own snippet; without any of the words the first line counts as best. Null texts are left out.
    """
    hits = lambda s: sum((F.lower(s).contains(w.lower()).cast("int") for w in dict.fromkeys(words)), F.lit(0))
    d = docs.where("text is not null").select("id", _once(text=F.col("text"), ls=F.split("text", "\n")).alias("d")).select("id", "d.*")
    best = F.array_max(F.transform("ls", lambda s, k: F.struct(hits(s).alias("hits"), (-k).alias("k"))))
    d = d.select("id", "text", "ls", _once(best=-best["k"]).alias("b")).select("id", "text", "ls", "b.best")
    near = F.filter(F.transform("ls", lambda s, k: F.struct(F.abs(k - F.col("best")).alias("far"), (k > F.col("best")).alias("below"), k.alias("k"), s.alias("s"))), lambda x: (x["far"] > 0) & meaningful(x["s"]))
    own = F.struct(F.lit(0).alias("far"), F.lit(False).alias("below"), F.col("best").alias("k"), F.get("ls", F.col("best")).alias("s"))
    taken = F.concat(F.array(own), F.slice(F.array_sort(near), 1, window - 1))
    placed = F.array_sort(F.transform(taken, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"))))
    d = d.select("id", "text", "best", F.size("ls").alias("n"), _once(p=placed).alias("p")).select("id", "text", "best", "n", "p.p")
    dots = lambda cond: F.when(cond, F.lit("...")).otherwise(F.lit(None))
    cut = F.concat_ws("\n", dots(F.get("p", F.lit(0))["k"] > 0), F.array_join(F.transform("p", lambda x: x["s"]), "\n"), dots(F.element_at("p", -1)["k"] < F.col("n") - 1))
    return d.select("id", (F.col("best") + 1).alias("best_line"), F.when(F.col("n") <= window, F.col("text")).otherwise(cut).alias("snippet"))


def excerpt(text: Column, max_bytes: int = 280) -> Column:
    """The first paragraph of prose outside fenced code, frontmatter, headings, tables, comments and images, cut to `max_bytes`; '' without any."""
    body = F.regexp_replace(text, _BLOCK, "")
    start = F.struct(F.lit(False).alias("fenced"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, raw: Column) -> Column:
        s = F.btrim(raw, F.lit(" \t\r"))
        fence = s.startswith("```") | s.startswith("~~~")
        prose = ~acc["fenced"] & ~fence & ~acc["done"] & (s != "") & ~s.rlike(r"^(#|\||<!--|!\[|\[!\[)")
        ends = (s == "") & ~acc["fenced"] & (F.size(acc["parts"]) > 0)
        return F.struct((acc["fenced"] != fence).alias("fenced"), (acc["done"] | ends).alias("done"), F.when(prose, F.concat(acc["parts"], F.array(s))).otherwise(acc["parts"]).alias("parts"))

    return truncate_bytes(F.array_join(F.aggregate(F.split(body, "\n"), start, step)["parts"], " "), max_bytes)


def outlines(docs: DataFrame) -> DataFrame:
    """(id, title, words, excerpt, headings) of (id, path, text): headings are those of levels 1 and 2 in order; the file's name stands in for a missing title."""
    heads = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"^##?[ \t]+.+$"))
    named = F.coalesce(F.nullif(title(F.col("text")), F.lit("")), F.trim(title_from_name(basename(F.col("path")))), F.lit(""))
    return docs.where("text is not null").select("id", named.alias("title"), word_count(F.col("text")).alias("words"), excerpt(F.col("text")).alias("excerpt"), F.transform(heads, lambda s: F.trim(F.regexp_extract(s, r"^##?[ \t]+(.+)$", 1))).alias("headings"))
