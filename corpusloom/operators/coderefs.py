"""Code references with line tokens: validation against the lines of their targets, and texts rewritten by the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import line_tokens
from corpusloom.functions.text import code_reference

REFERENCE = code_reference()
# fixed values: how far a line may have moved, how much a range may have grown, and how sure a result is
WINDOW, SLACK = 120, 40
CONFIDENCE = {"valid_exact": 1.0, "valid_shifted": 0.9, "one_of_two_tokens": 0.75, "valid_unchecked": 0.6}
_BAND = 256  # lines of a bucket in which a reference and a line meet
_OWN = ["raw", "path", "start", "start_token", "end", "end_token"]


def _near(own: DataFrame, tokens: DataFrame, token: str, lo: Column, hi: Column, name: str) -> DataFrame:
    """own with `name`: the sorted numbers of the lines from lo to hi that have the token; an empty array without any.

    Shorter tokens are prefixes of longer ones. References and lines meet by path, token and bucket of lines, so a popular file is
    spread over its buckets and a reference sees no line outside its band.
    """
    wanted = own.where(F.col(token) != "").select(*_OWN, F.col(token).alias("token"), lo.alias("lo"), hi.alias("hi")).where("hi >= lo and hi >= 1")
    wanted = wanted.withColumn("bucket", F.explode(F.sequence(F.floor(F.greatest("lo", F.lit(1)) / _BAND), F.floor(F.col("hi") / _BAND))))
    used = wanted.select("path", F.length("token").alias("size")).distinct()
    cut = tokens.join(used, "path").select("path", "line_no", F.floor(F.col("line_no") / _BAND).alias("bucket"), F.expr("substring(token8, 1, size)").alias("token"))
    found = wanted.join(cut, ["path", "token", "bucket"]).where("line_no between lo and hi").groupBy(*_OWN).agg(F.array_sort(F.collect_set("line_no")).alias(name))
    joined = own.alias("o").join(found.alias("f"), [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in _OWN], "left")
    return joined.select("o.*", F.coalesce(F.col(f"f.{name}"), F.array().cast("array<int>")).alias(name))


def validate(refs: DataFrame, lines: DataFrame, window: int = WINDOW, slack: int = SLACK, length: int = 3) -> DataFrame:
    """(id, raw, status, suggested_raw, suggested_start, suggested_end, confidence) for references (id, raw, path, start, start_token, end, end_token).

    `lines` are (path, line_no, line) of the targets. missing_file: no line of that path. out_of_bounds: a line beyond the file. valid_exact: all
    tokens stand at their lines (1.0). valid_unchecked: none contradicts, not all are given (0.6). valid_shifted: they fit at one other
    place within `window` lines, the end within `slack` of where the length of the range puts it (0.9, or 0.75 with one of two tokens).
    stale_ambiguous: at several places. stale: nowhere. Suggestions fill in missing tokens. Equal references are checked once;
    repeated rows give one row; a null path or start gives missing_file.
    """
    own = refs.select("raw", "path", "start", F.lower(F.coalesce("start_token", F.lit(""))).alias("start_token"), "end", F.when(F.col("end").isNull(), "").otherwise(F.lower(F.coalesce("end_token", F.lit("")))).alias("end_token")).distinct()
    here = lines.join(own.select("path").distinct(), "path", "left_semi")
    tokens = here.select("path", F.col("line_no").cast("int").alias("line_no"), line_tokens(F.col("line"), 8).alias("token8"))
    sizes = here.groupBy("path").agg(F.max("line_no").cast("int").alias("n"))
    reach = F.coalesce(F.col("end") - F.col("start"), F.lit(0))
    free = F.col("start_token") == ""
    r = _near(own, tokens, "start_token", F.col("start") - window, F.col("start") + window, "starts")
    r = _near(r, tokens, "end_token", F.col("start") + reach - F.when(free, window).otherwise(window + slack), F.col("start") + reach + F.when(free, window).otherwise(window + slack), "ends")
    r = r.join(sizes, "path", "left").withColumn("reach", reach)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    both = F.flatten(F.transform("starts", lambda a: F.transform(F.filter("ends", lambda b: (F.abs(b - a - F.col("reach")) <= slack) & (b >= a)), lambda b: pair(a, b))))
    by_start, by_end = F.transform("starts", lambda a: pair(a, a + F.col("reach"))), F.transform("ends", lambda b: pair(b - F.col("reach"), b))
    ended = F.col("end").isNotNull()
    places = F.when(~free & (F.col("end_token") != ""), both).when(~free, by_start).otherwise(by_end)
    r = r.withColumn("places", F.filter(places, lambda p: (p["a"] >= 1) & (p["b"] <= F.col("n"))))
    start_ok = free | F.array_contains("starts", F.col("start"))
    end_ok = (F.col("end_token") == "") | F.array_contains("ends", F.col("end"))
    status = (
        F.when(F.col("n").isNull() | F.col("start").isNull(), "missing_file").when((F.col("start") < 1) | (F.col("reach") < 0) | (F.col("start") + F.col("reach") > F.col("n")), "out_of_bounds")
        .when(start_ok & end_ok & ~free & (~ended | (F.col("end_token") != "")), "valid_exact").when(start_ok & end_ok, "valid_unchecked")
        .when(F.size("places") == 1, "valid_shifted").when(F.size("places") > 1, "stale_ambiguous").otherwise("stale")
    )
    r = r.withColumn("status", status)
    at = F.when(F.col("status").isin("valid_exact", "valid_unchecked"), pair(F.col("start"), F.col("start") + F.col("reach"))).when(F.col("status") == "valid_shifted", F.get("places", F.lit(0)))
    half = (F.col("status") == "valid_shifted") & ended & (free | (F.col("end_token") == ""))
    sure = F.when(half, CONFIDENCE["one_of_two_tokens"])
    for name in ("valid_exact", "valid_unchecked", "valid_shifted"):
        sure = sure.when(F.col("status") == name, CONFIDENCE[name])
    sure = sure.otherwise(0.0)
    r = r.select(*_OWN, "status", at["a"].alias("a"), at["b"].alias("b"), sure.alias("confidence"))
    token_at = lambda k: tokens.select("path", F.col("line_no").alias(k), F.col("token8").alias(f"token_{k}"))
    r = r.join(token_at("a"), ["path", "a"], "left").join(token_at("b"), ["path", "b"], "left")
    size = F.when(~free, F.length("start_token")).when(F.col("end_token") != "", F.length("end_token")).otherwise(length)
    filled = lambda given, k: F.coalesce(F.nullif(F.col(given), F.lit("")), F.substring(f"token_{k}", F.lit(1), size))
    file, separator = (F.regexp_extract("raw", code_reference(True), k) for k in (1, 2))
    written = F.concat(file, separator, F.col("a"), F.lit("@"), filled("start_token", "a"), F.when(ended, F.concat(F.when(separator == "#L", "-L").otherwise("-"), F.col("b"), F.lit("@"), filled("end_token", "b"))).otherwise(""))
    result = r.select("raw", "path", "status", written.alias("suggested_raw"), F.col("a").alias("suggested_start"), F.col("b").alias("suggested_end"), "confidence")
    ids = refs.select("id", "raw", "path").distinct().alias("i")
    return ids.join(result.alias("r"), (F.col("i.raw") == F.col("r.raw")) & F.col("i.path").eqNullSafe(F.col("r.path"))).select("i.id", "r.raw", "status", "suggested_raw", "suggested_start", "suggested_end", "confidence")


def rewrite(docs: DataFrame, results: DataFrame) -> DataFrame:
    """(id, text, n_changed) of (id, text): references in the text are replaced by what `results` (id, raw, suggested_raw) suggest.

    References are found from the left and do not overlap; those without a suggestion stay. Of several
    suggestions for one reference the smallest counts. Documents without a change are left out.
    """
    wanted = results.where("suggested_raw is not null and suggested_raw <> raw").groupBy("id", "raw").agg(F.min("suggested_raw").alias("new"))
    wanted = wanted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("by"))
    d = docs.where("text is not null").join(wanted, "id").select("id", F.split("text", REFERENCE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(f"({REFERENCE})"), F.lit(1)).alias("found"), "by")
    new = F.zip_with("gaps", "found", lambda g, r: F.concat(g, F.coalesce(F.col("by")[r], r, F.lit(""))))
    n = F.size(F.filter("found", lambda r: F.col("by")[r].isNotNull()))
    return d.select("id", F.array_join(new, "").alias("text"), n.alias("n_changed")).where("n_changed > 0")
