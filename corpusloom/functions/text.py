"""Column builders for text: tokens, identifiers, globs, truncation, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: a code reference is a file with an extension, a separator, a line and maybe a last line, each with an optional token
REF_FILE, REF_TOKEN = r"[A-Za-z0-9_./~\-]+\.[A-Za-z0-9_+\-]+", r"[A-Za-z0-9]{2,8}"
REF_FORMS = {":": "-", "#L": "-L"}  # separator before the line, and before the last line


def code_reference(named: bool = False) -> str:
    """Pattern of a code reference in either form. With `named`, of one as a whole: groups 1 file, 2 separator, 3 and 4 line and token, 5 and 6 last line and token."""
    if named:
        return rf"^({REF_FILE})({'|'.join(REF_FORMS)})(\d+)(?:@({REF_TOKEN}))?(?:-L?(\d+)(?:@({REF_TOKEN}))?)?$"
    place = rf"\d+(?:@{REF_TOKEN})?"
    return rf"{REF_FILE}(?:" + "|".join(f"{first}{place}(?:{last}{place})?" for first, last in REF_FORMS.items()) + ")"


# fixed values: words that keyword extraction leaves out
STOP_WORDS = (
    "able about across after also and are because been before being between both build built could does each file files for from "
    "have into just made make more most need notes only over same should than that the their them then there these they this "
    "through topic using was what when with your"
).split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and '_'."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def keyword_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at least three bytes that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "), " ")
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(STOP_WORDS))


def bigrams_of(words: Column) -> Column:
    """Adjacent words joined by a blank."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def without_urls(text: Column) -> Column:
    """Words without http(s) addresses, joined by blanks."""
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.lower(w).rlike("^https?://")), " ")


def split_camel(word: Column) -> Column:
    """swapId -> [swap, Id]; HTMLParser -> [HTML, Parser]."""
    return F.split(F.regexp_replace(F.regexp_replace(word, "([^A-Z])([A-Z])", "$1\u0001$2"), "([A-Z])([A-Z][^A-Z\u0001])", "$1\u0001$2"), "\u0001")


def code_variants(word: Column) -> Column:
    """The word, its parts joined by '_' and by a blank, without repeats."""
    parts = F.transform(F.flatten(F.transform(F.split(word, "[_-]"), split_camel)), F.lower)
    return F.array_distinct(F.array(word, F.array_join(parts, "_"), F.array_join(parts, " ")))


def expand_identifiers(query: str) -> str:
    """Query text in which each compound identifier is followed by its variants."""
    out = []
    for word in query.split():
        parts = [p.lower() for x in re.split("[_-]", word) for p in re.sub(r"([A-Z])([A-Z][^A-Z\x01])", "\\1\x01\\2", re.sub(r"([^A-Z])([A-Z])", "\\1\x01\\2", x)).split("\x01") if p]
        variants = list(dict.fromkeys([word, "_".join(parts), " ".join(parts)]))
        out.append(word if len(parts) < 2 else "(" + " OR ".join(variants) + ")")
    return " ".join(out)


def glob_regex(pattern: str, stars_cross: bool) -> str:
    """Anchored regex of a glob. stars_cross: '*' and '?' also match '/', as in SQL GLOB; else only '**' crosses folders."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            double = pattern[k : k + 2] == "**"
            if double and not stars_cross:
                if pattern[k : k + 3] == "**/":
                    out, k = out + "(?:.*/)?", k + 3
                    continue
                out, k = out + ".*", k + 2
                continue
            out += ".*" if stars_cross else "[^/]*"
        elif c == "?":
            out += "." if stars_cross else "[^/]"
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            body = pattern[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            k = end
        elif c == "{" and not stars_cross and "}" in pattern[k:]:
            end = pattern.index("}", k)
            out += "(?:" + "|".join(re.escape(x) for x in pattern[k + 1 : end].split(",")) + ")"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return "^" + out + "$"


def matches_any(path: Column, patterns: str) -> Column:
    """Comma-separated SQL globs, any of which may match; no pattern matches everything."""
    regexes = [glob_regex(p.strip(), True) for p in patterns.split(",") if p.strip()]
    return path.rlike("|".join(regexes)) if regexes else F.lit(True)


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Gitignore-like: a bare name matches at any depth, a trailing '/' or a match of a folder takes all below it; '#' comments."""
    regexes = []
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            core = p.rstrip("/").lstrip("/")
            core = core if "/" in core else "**/" + core
            regexes += [glob_regex(core, False), glob_regex(core + "/**", False)]
    return relative.rlike("|".join(regexes)) if regexes else F.lit(False)


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last three dots where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, max(n - 3, 0)), F.lit("..."))).otherwise(text)


def truncate_bytes(text: Column, n: int) -> Column:
    """At most n bytes of UTF-8, the last three dots where something was cut; no character is broken."""
    # a character has at most four bytes, so one of four cuts falls between characters
    cuts = [F.substring(F.encode(text, "UTF-8"), 1, max(n - 3 - k, 0)).cast("string") for k in range(4)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(F.rtrim(F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts], cuts[0])), F.lit("...")))


def truncate_at_sentence(text: Column, n: int) -> Column:
    """At most n characters: up to the last end of a sentence within them, else cut at a word with '…'. Shorter texts and null stay."""
    head = F.substring(text, 1, n)
    whole = F.regexp_extract(head, r"^((?s).*[.!?])(?=\s|$)", 1)
    word = F.when(head.rlike(r"\s"), F.rtrim(F.regexp_replace(head, r"\s\S*\z", ""))).otherwise(F.substring(text, 1, n - 1))
    return F.when(F.length(text) <= n, text).when(whole != "", whole).otherwise(F.concat(word, F.lit("…")))


def highlight_preview(text: Column, fragments: list[str], n: int) -> Column:
    """A window of n characters that begins n / 4 before the first place where one of the fragments stands; from the start if none does.

    Fragments are compared without regard to case. '...' marks an end that is not that of the text.
    """
    places = F.array_min(F.filter(F.array(*[F.instr(F.lower(text), f.lower()) for f in fragments] or [F.lit(0)]), lambda p: p > 0))
    begin = F.greatest(F.coalesce(places, F.lit(1)) - n // 4, F.lit(1))
    cut = F.substring(text, begin, F.lit(n))
    return F.concat(F.when(begin > 1, "...").otherwise(""), cut, F.when(begin + n - 1 < F.length(text), "...").otherwise(""))


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"^([^.!?]*[.!?]?)", 1))


def word_count(text: Column) -> Column:
    """Words between white space; null counts as none."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))).rlike(r"\S"), F.size(F.filter(F.split(text, r"[ \t\n\r\f\v]+"), lambda w: w != ""))).otherwise(0)


# fixed values: kinds of files by extension
KINDS = {"markdown": [".md", ".mdx", ".markdown", ".qmd"], "text": [".txt", ".log"], "data": [".json", ".jsonl", ".csv"], "config": [".toml", ".yml", ".yaml"]}


def kind_of(extension: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, extensions in KINDS.items():
        out = out.when(extension.isin(extensions), kind)
    return out.otherwise("other")


def title_from_name(name: Column) -> Column:
    return F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "-_", "  ")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def meaningful(line: Column) -> Column:
    """At least four ASCII letters or digits."""
    return F.length(F.regexp_replace(line, "[^A-Za-z0-9]", "")) >= 4


def directory_key(relative: Column, depth: int) -> Column:
    """The first `depth` folders of a path with a final slash; './' for files at the root."""
    folders = F.split(F.regexp_replace(relative, "/?[^/]*$", ""), "/")
    return F.when(~relative.contains("/"), "./").otherwise(F.concat(F.array_join(F.slice(folders, 1, depth), "/"), F.lit("/")))
