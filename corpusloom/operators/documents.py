"""Documents taken apart: lines, headings, sections, row chunks, frontmatter, titles, links, references, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import resolve, slug
from corpusloom.functions.text import bigrams_of, code_reference, directory_key, keyword_tokens, without_urls

HEADING = r"^(#{1,6})[ \t]+(.+)$"


def lines(docs: DataFrame) -> DataFrame:
    """(id, line_no, line) of (id, text), numbered from 1; a trailing line break gives a last empty line."""
    return docs.where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("id", (F.col("k") + 1).alias("line_no"), "line")


def headings(docs: DataFrame) -> DataFrame:
    """(id, line_no, level, heading, section_id). Fenced lines count too, as everywhere in the index."""
    found = lines(docs.where(F.col("text").contains("#"))).where(F.col("line").rlike(HEADING))
    text = F.trim(F.regexp_extract("line", HEADING, 2))
    return found.select("id", "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), text.alias("heading"), slug(text).alias("section_id"))


def spans(heads: Column, n_lines: Column) -> Column:
    """Heads (start_line, level, heading) with end_line. Among the heads of level k and above, a head of level k ends before the next one."""
    found = []
    for k in range(1, 7):
        upto = F.filter(heads, lambda h: h["level"] <= k)
        paired = F.zip_with(upto, F.slice(upto, 2, F.greatest(F.size(upto), F.lit(1))), lambda h, then: F.struct(h["start_line"].alias("start_line"), F.coalesce(then["start_line"] - 1, n_lines).alias("end_line"), h["level"].alias("level"), h["heading"].alias("heading")))
        found.append(F.filter(paired, lambda s: s["level"] == k))
    return F.array_sort(F.concat(*found))


def sections(docs: DataFrame) -> DataFrame:
    """headings with end_line: the line before the next heading of the same or a higher level, else the last line.

    Spans nest. They are found within the row of a document, in one pass per level, and no text leaves it.
    """
    once = lambda c: F.explode(F.array(c))
    d = docs.where(F.col("text").contains("#")).select("id", once(F.split("text", "\n")).alias("ls"))
    marked = F.filter(F.transform("ls", lambda s, k: F.struct((k + 1).alias("start_line"), s.alias("s"))), lambda x: x["s"].rlike(HEADING))
    heads = F.transform(marked, lambda x: F.struct(x["start_line"].alias("start_line"), F.length(F.regexp_extract(x["s"], HEADING, 1)).alias("level"), F.trim(F.regexp_extract(x["s"], HEADING, 2)).alias("heading")))
    d = d.select("id", F.size("ls").alias("n"), once(heads).alias("heads")).where(F.size("heads") > 0)
    return d.select("id", F.explode(spans(F.col("heads"), F.col("n"))).alias("h")).select("id", "h.start_line", "h.end_line", "h.level", "h.heading", slug(F.col("h.heading")).alias("section_id"))


def nearest_parents(rows: DataFrame) -> DataFrame:
    """rows (file_id, id, chunk_order, level) with parent_id: the last earlier row of the file with a lower level.

    One running 'last' per level within the file; levels outside 1 to 6 have no parent and are none.
    """
    before = Window.partitionBy("file_id").orderBy("chunk_order", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = [F.last(F.when(F.col("level") == k, F.struct("chunk_order", "id")), ignorenulls=True).over(before) for k in range(1, 6)]
    lower = [F.when(F.col("level") > k + 1, a) for k, a in enumerate(at)]
    return rows.withColumn("parent_id", F.when(F.col("level").between(2, 6), F.greatest(*lower, F.lit(None))["id"]))


def row_chunks(docs: DataFrame, rows_per_chunk: int = 25, min_chars: int = 200, overlap: int = 5) -> DataFrame:
    """(id, chunk_order, start_line, end_line, char_count, content): groups of non-blank rows.

    char_count are the bytes of the group's rows, content also has `overlap` rows on either side. Groups under
    min_chars are left out, but a last one is joined to the group before it when that one is kept.
    """
    cells = docs.where("text is not null").select("id", F.filter(F.transform(F.split("text", "\n"), lambda s, k: F.struct((k + 1).alias("n"), s.alias("s"))), lambda x: F.trim(x["s"]) != "").alias("rows"))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("rows") / rows_per_chunk).cast("int") - 1, F.lit(0))), lambda g: F.struct((g * rows_per_chunk + 1).alias("a"), F.least((g + 1) * rows_per_chunk, F.size("rows")).alias("b"), g.alias("g")))
    size = lambda a, b: F.aggregate(F.slice("rows", a, b - a + 1), F.lit(0), lambda acc, x: acc + F.octet_length(x["s"]) + 1) - 1
    g = cells.where(F.size("rows") > 0).withColumn("groups", F.transform(groups, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["g"].alias("g"), size(x["a"], x["b"]).alias("size"))))
    n = F.size("groups")
    joined = (n > 1) & (F.element_at("groups", -1)["size"] < min_chars) & (F.get("groups", n - 2)["size"] >= min_chars)
    last = F.element_at("groups", -1)["b"]
    merged = F.when(joined, F.transform(F.slice("groups", 1, F.greatest(n - 1, F.lit(1))), lambda x: F.struct(x["a"].alias("a"), F.when(x["g"] == n - 2, last).otherwise(x["b"]).alias("b")))).otherwise(F.transform("groups", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    lo, hi = lambda x: F.greatest(x["a"] - overlap, F.lit(1)), lambda x: F.least(x["b"] + overlap, F.size("rows"))
    piece = lambda x: F.struct(F.element_at("rows", x["a"])["n"].alias("start_line"), F.element_at("rows", x["b"])["n"].alias("end_line"), size(x["a"], x["b"]).alias("char_count"), F.array_join(F.transform(F.slice("rows", lo(x), hi(x) - lo(x) + 1), lambda r: r["s"]), "\n").alias("content"))
    # the pieces are cut out before the explode, which would otherwise copy all rows for each of them
    g = g.select("id", "rows", F.explode(F.array(merged)).alias("groups"))
    out = g.select("id", F.explode(F.transform("groups", piece)).alias("x")).select("id", "x.*").where(F.col("char_count") >= min_chars)
    return out.withColumn("chunk_order", F.row_number().over(Window.partitionBy("id").orderBy("start_line")) - 1)


def frontmatter(text: Column) -> Column:
    """The lines between a first line of three or more '-' and the next such line; null without."""
    return F.nullif(F.regexp_extract(text, r"^-{3,}[ \t]*\n((?s).*?)\n-{3,}[ \t]*(?:\n|$)", 1), F.lit(""))


def title(text: Column) -> Column:
    """The frontmatter's title without quotes, else the first heading of level 1 or 2, else ''."""
    given = F.regexp_replace(F.trim(F.regexp_extract(F.coalesce(frontmatter(text), F.lit("")), r"(?m)^(?:title|name):[ \t]*(.*)$", 1)), "^[\"']|[\"']$", "")
    return F.coalesce(F.nullif(given, F.lit("")), F.trim(F.regexp_extract(text, r"(?m)^##?[ \t]+(.*)$", 1)), F.lit(""))


def provenance(relative: Column, doc_title: Column, collection: Column, content: Column) -> Column:
    return F.concat(F.lit('<source file="'), relative, F.lit('" title="'), F.coalesce(doc_title, F.lit("")), F.lit('" collection="'), collection, F.lit('" />\n'), content)


def without_code(text: Column) -> Column:
    """The text with fenced blocks and inline code blanked, lines kept: what a rendered page shows as links. An open fence runs to the end."""
    fence = lambda s: F.ltrim(s).rlike(r"^(```|~~~)")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines"))

    def step(acc: Column, s: Column) -> Column:
        shown = F.when(acc["inside"] | fence(s), "").otherwise(F.regexp_replace(s, "`[^`]*`", ""))
        return F.struct((acc["inside"] != fence(s)).alias("inside"), F.concat(acc["lines"], F.array(shown)).alias("lines"))

    # only texts with a backtick or tilde are walked through
    return F.when(text.rlike("[`~]"), F.array_join(F.aggregate(F.split(text, "\n"), start, step)["lines"], "\n")).otherwise(text)


def links(docs: DataFrame) -> DataFrame:
    """(id, line_no, link_type, target_path, target_section, raw): Markdown links, wikilinks, read commands, includes, path references and frontmatter sources.

    Web addresses are left out. Paths are kept as written, without quotes, fragments become slugs. Wikilinks without an extension get '.md';
    commands, includes and paths in code count with the extension .md only. A frontmatter source stands at line 0. Equal links of a line count once.
    """
    texts = docs.where(F.col("text").rlike(r"\[|`|\{\{|mem read|(?m)^source:"))
    rows = lines(texts)
    every = lambda regex: F.regexp_extract_all("line", F.lit(f"({regex})"), F.lit(1))
    form = lambda t, regex, part: F.transform(every(regex), lambda m: F.struct(F.lit(t).alias("t"), m.alias("raw"), F.regexp_extract(m, part, 1).alias("target")))
    tagged = [
        form("markdown", r"\[[^\]\[]*\]\([^)\s]+\)", r"\(([^)]+)\)$"), form("wikilink", r"\[\[[^\]\[]+\]\]", r"^\[\[([^\]|]+)"),
        form("read_command", r"\bmem[ \t]+read[ \t]+[^\s`]+", r"read[ \t]+([^\s`]+)$"), form("include", r"\{\{[ \t]*include(?:-toc)?[ \t]+[^}\s]+[ \t]*\}\}", r"include(?:-toc)?[ \t]+([^}\s]+)"),
        form("path_ref", r"`[^` ]+\.md(?:#[^` ]*)?`", "`([^`]+)`"),
    ]
    found = rows.select("id", "line_no", F.explode(F.concat(*tagged)).alias("x")).select("id", "line_no", F.col("x.t").alias("link_type"), "x.raw", F.btrim(F.trim("x.target"), F.lit("\"'")).alias("target"))
    source = F.regexp_extract(frontmatter(F.col("text")), r"(?m)^source:[ \t]*[\"']?(\[\[[^\]\[]+\]\])", 1)
    front = texts.select("id", F.lit(0).alias("line_no"), F.lit("frontmatter_source").alias("link_type"), source.alias("raw")).where("raw <> ''").withColumn("target", F.trim(F.regexp_extract("raw", r"^\[\[([^\]|]+)", 1)))
    found = found.unionByName(front).where(~F.lower("target").rlike(r"^(https?|mailto):"))
    path, fragment = F.trim(F.substring_index("target", "#", 1)), F.when(F.col("target").contains("#"), F.regexp_replace("target", "^[^#]*#", ""))
    named = F.col("link_type").isin("wikilink", "frontmatter_source") & ~path.rlike(r"\.[A-Za-z0-9]+$")
    local = ~F.col("link_type").isin("read_command", "include", "path_ref") | F.lower(path).endswith(".md")
    return found.where(local).select("id", "line_no", "link_type", F.when(named, F.concat(path, F.lit(".md"))).otherwise(path).alias("target_path"), F.coalesce(slug(fragment), F.lit("")).alias("target_section"), "raw").distinct()


# fixed values: folders below which a target is read from the root of its collection, and folders that mark such a root in a path
ROOT_FOLDERS = ("docs", "memory", "repos", "logs")


def resolved(links_df: DataFrame, source: str = "source_path") -> DataFrame:
    """links with target_path made absolute: from the root for '/', from the collection's root if it names one of its root folders, else from the folder of the source.

    The collection's root is what stands before the first of the root folders in the path of the source. An empty target is the source itself.
    """
    names = "|".join(ROOT_FOLDERS)
    folder = F.regexp_replace(F.col(source), "/[^/]*$", "")
    rooted = F.regexp_replace(F.translate("target_path", "\\", "/"), r"^(?:\.{0,2}/)+", "")
    root = F.regexp_extract(F.col(source), f"^(.*?)(?:^|/)(?:{names})/", 1)
    marked = F.col(source).rlike(f"(?:^|/)(?:{names})/")
    target = (
        F.when(F.col("target_path") == "", F.col(source)).when(F.col("target_path").startswith("/"), F.col("target_path"))
        .when(marked & rooted.rlike(f"^({names})/"), F.concat(root, F.lit("/"), rooted)).otherwise(F.concat(folder, F.lit("/"), "target_path"))
    )
    return links_df.withColumn("target_path", resolve(target))


def located(refs: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """refs (id, source_path, path) with resolved: the first place where the path exists, in the folder of the source, then below each root by name.

    roots: (root), a short list; files: (path). An absolute path is looked up as it is; null where nothing exists. Places are joined once each.
    """
    r = refs.select("id", "source_path", "path").distinct()
    folder = F.regexp_replace("source_path", "/[^/]*$", "")
    own = r.select("id", "source_path", "path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(folder, F.lit("/"), "path")).alias("at"), F.lit("").alias("place"))
    below = r.where("not path like '/%'").join(F.broadcast(roots.select("root").distinct()), F.lit(True)).select("id", "source_path", "path", F.concat("root", F.lit("/"), "path").alias("at"), F.col("root").alias("place"))
    tried = own.unionByName(below).withColumn("at", resolve(F.col("at")))
    there = files.select(resolve(F.col("path")).alias("at")).distinct()
    best = tried.join(there, "at").groupBy("id", "source_path", "path").agg(F.min_by("at", "place").alias("resolved"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "source_path", "path")]
    return r.alias("r").join(best.alias("b"), same, "left").select("r.*", "b.resolved")


def code_refs(docs: DataFrame) -> DataFrame:
    """(id, line_no, raw, path, start, start_token, end, end_token): references like a.go:12@abc-20@xyz or a.go#L12-L20, from the left without overlaps."""
    rows = lines(docs.where(F.col("text").rlike(r"\.[A-Za-z0-9_+\-]+(:|#L)\d"))).select("id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(f"({code_reference()})"), F.lit(1))).alias("raw"))
    part = lambda k: F.regexp_extract("raw", code_reference(True), k)
    number = lambda k: F.nullif(part(k), F.lit("")).try_cast("int")
    return rows.select("id", "line_no", "raw", part(1).alias("path"), number(3).alias("start"), part(4).alias("start_token"), number(5).alias("end"), part(6).alias("end_token")).where("start >= 1 and (end is null or end >= start)")


def keyword_scores(docs: DataFrame, depth: int = 2) -> DataFrame:
    """(directory, term, score) of (id, path, text) by TF-IDF over folders.

    A document that begins with '#' weighs its words three times, as a heading does; words of the file name weigh twice. Terms are words and
    pairs of words. idf is ln(1 + folders / documents that hold the term).
    """
    # an explode of one element keeps what is below it from being computed again for every word
    once = lambda column: F.explode(F.array(column))
    prepared = docs.select(directory_key(F.col("path"), depth).alias("directory"), without_urls(F.col("text")).alias("body"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("name"))
    none = F.array().cast("array<string>")
    words = prepared.select("directory", once(F.struct(F.coalesce(keyword_tokens(F.col("body")), none).alias("t"), F.coalesce(keyword_tokens(F.col("name")), none).alias("n"), F.when(F.col("body").startswith("#"), 3).otherwise(1).alias("w"))).alias("p")).select("directory", "p.*")
    weigh = lambda c, w: F.transform(F.concat(c, bigrams_of(F.col(c))), lambda x: F.struct(x.alias("term"), w.alias("w")))
    lined = words.select("directory", once(F.sort_array(F.concat(weigh("t", F.col("w")), weigh("n", F.lit(2))))).alias("s"))
    # sorted terms tell where a term stands first in its document
    marked = F.transform("s", lambda x, k: F.struct(x["term"].alias("term"), x["w"].alias("w"), ((k == 0) | (F.get("s", k - 1)["term"] != x["term"])).alias("first")))
    terms = lined.select("directory", F.explode(marked).alias("x")).select("directory", "x.*")
    per_dir = terms.groupBy("term", "directory").agg(F.sum("w").alias("w"), F.count_if("first").alias("docs"))
    n_groups = docs.select(directory_key(F.col("path"), depth).alias("d")).distinct().count()
    df = per_dir.groupBy("term").agg(F.sum("docs").alias("df"))
    return per_dir.join(df, "term").select("directory", "term", (F.col("w") * F.log(1.0 + F.lit(float(n_groups)) / F.col("df"))).alias("score"))


def top_keywords(scores: DataFrame, n: int = 8) -> DataFrame:
    """(directory, place, term, score): the n best terms of each folder; on a tie pairs of words come first, then the alphabet."""
    w = Window.partitionBy("directory").orderBy(F.desc(F.round("score", 9)), F.desc(F.col("term").contains(" ")), "term")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def diverse_keywords(scores: DataFrame, n: int = 8) -> DataFrame:
    """(directory, terms): at most n terms by score without overlaps, of (directory, term, score).

    The best pair of words comes first; then terms follow by score, and a pair takes the place of its single words chosen before it. At
    most n pairs are chosen and they displace at most two words each, so the first 3 n + 1 terms and the best pair decide the result.
    """
    pair = F.col("term").contains(" ")
    order = [F.desc(F.round("score", 9)), F.desc(pair), "term"]
    first = scores.withColumn("place", F.row_number().over(Window.partitionBy("directory").orderBy(*order))).where(F.col("place") <= 3 * n + 1)
    best = scores.where(pair).withColumn("place", F.row_number().over(Window.partitionBy("directory").orderBy(*order))).where("place = 1").select("directory", F.lit(0).alias("place"), "term")
    rows = first.select("directory", "place", "term").unionByName(best).groupBy("directory").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("rows"))

    def step(chosen: Column, row: Column) -> Column:
        t = row["term"]
        others = F.filter(chosen, lambda c: ~F.array_contains(F.split(t, " "), c))
        grown = F.concat(F.when(t.contains(" "), others).otherwise(chosen), F.array(t))
        return F.when((F.size(chosen) >= n) | F.array_contains(chosen, t), chosen).otherwise(grown)

    return rows.select("directory", F.aggregate("rows", F.array().cast("array<string>"), step).alias("terms"))
