"""Text functions of the store and the reader, as Column expressions where Spark can express them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATEX = r"\\\[[\s\S]*?\\\]|\$[^$]+\$"
PUNCTUATION = ".,;:!?()[]{}'\"-/+*=<>%&@#_\\"  # fixed value: marks that readable text may hold


def squeeze(x: Column) -> Column:
    """Outer white space dropped, inner runs made one space."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " ")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def display_text(corrected: Column, original: Column) -> Column:
    return F.coalesce(corrected, original)


def correction_or_null(text: Column, original: Column) -> Column:
    """A correction worth storing: null if empty or the same as the original."""
    t = strip(text)
    return F.nullif(F.nullif(t, F.lit("")), original)


def keywords(x: Column) -> Column:
    """Distinct lower-case words of five or more of a-z and 0-9."""
    return F.array_distinct(tokens(x))


def tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) >= 5)


def page_line(page: Column, text: Column) -> Column:
    return F.concat(F.lit("[p."), (page + 1).cast("string"), F.lit("] "), text)


def fill_template(template: Column, context: Column, text: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{context}"), context), F.lit("{text}"), text)


def strip_fence(x: Column) -> Column:
    """Text inside a fenced code block, or the text itself."""
    t = F.regexp_replace(strip(x), r"^```json", "")
    return strip(F.regexp_replace(F.regexp_replace(t, "^```", ""), "```$", ""))


def title_of_file(name: Column, default: str = "未命名文档") -> Column:
    t = F.regexp_replace(name, r"(?i)\.pdf$", "")
    return F.when(F.coalesce(strip(t), F.lit("")) == "", F.lit(default)).otherwise(t)


def tag_names(x: Column) -> Column:
    """Names between commas of either kind, blank ones dropped."""
    return F.filter(F.transform(F.split(x, "[,，]"), strip), lambda t: t != "")


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units, in which the original store counts."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def readable_share(x: Column) -> Column:
    """Share of letters, digits, white space and common punctuation; 0 without a letter or digit."""
    good = F.length(F.regexp_replace(x, r"[^\p{L}\p{Nd}\s" + "".join("\\" + c for c in PUNCTUATION) + "]+", ""))
    return F.when(x.rlike(r"[\p{L}\p{Nd}]"), good.cast("double") / F.greatest(F.length(x), F.lit(1))).otherwise(F.lit(0.0))


def readable(x: Column) -> Column:
    return readable_share(x).cast("float") >= F.lit(0.82).cast("float")


def allowed_edits(a: Column, b: Column, ratio: Column) -> Column:
    """How many edits a correction may make, in single precision as the original computes it."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1)).cast("float")
    share = F.greatest(F.lit(0.05).cast("float"), F.least(F.lit(1.0).cast("float"), ratio.cast("float")))
    return F.greatest(F.floor((longest * share).cast("float")).cast("int"), F.lit(1))


def accepted_correction(source: Column, candidate: Column, ratio: Column) -> Column:
    """The trimmed candidate if it differs, keeps every formula, and stays within the allowed edits; else null.

    Levenshtein with a limit cannot take a column as its limit, so the distance is compared; both texts are short.
    """
    clean = strip(candidate)
    formulas = lambda x: F.regexp_extract_all(x, F.lit(LATEX), F.lit(0))
    near = (F.abs(F.length(source) - F.length(clean)) <= allowed_edits(source, clean, ratio)) & (F.levenshtein(source, clean) <= allowed_edits(source, clean, ratio))
    return F.when((clean != "") & (clean != source) & (formulas(clean) == formulas(source)) & near, clean)


def spans(x: Column) -> Column:
    r"""Ordered (kind, text) spans: text, and formulas between \[ and \]; alone on its line a formula is displayed.

    An opening without a closing stays text. Empty text has no span.
    """
    split_at = "\x00"
    marked = F.regexp_replace(x, r"(\\\[[\s\S]*?\\\])", split_at + "$1" + split_at)
    parts = F.split(marked, split_at)

    def kind(p: Column, i: Column) -> Column:
        before = F.substring_index(F.coalesce(F.array_join(F.slice(parts, 1, i), ""), F.lit("")), "\n", -1)
        after = F.substring_index(F.coalesce(F.array_join(F.slice(parts, i + 2, F.size(parts)), ""), F.lit("")), "\n", 1)
        alone = (strip(before) == "") & (strip(after) == "")
        formula = p.rlike(r"^\\\[[\s\S]*\\\]$") & (i % 2 == 1)
        return F.struct(F.when(~formula, F.lit("TEXT")).when(alone, F.lit("DISPLAY_FORMULA")).otherwise(F.lit("INLINE_FORMULA")).alias("kind"), p.alias("text"))

    return F.filter(F.transform(parts, kind), lambda s: s["text"] != "")


def closing_mark(latex: Column) -> Column:
    """The formula's own final punctuation, after trailing spacing commands; none after an empty delimiter."""
    body = F.regexp_replace(F.regexp_replace(latex, r"^\\\[", ""), r"\\\]$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?:\\[!,;:]|\\(?:quad|qquad|enspace|thinspace|medspace|thickspace))+\s*$", ""), r"\s+$", "")
    return F.when(body.rlike(r"\\(?:right|left)\.$"), None).otherwise(F.nullif(F.regexp_extract(body, r"[.,;:?!]$", 0), F.lit("")))


def model_word(kind: Column, numbered: Column, latex: Column) -> Column:
    """What a boundary model reads in place of a formula."""
    word = F.when(kind == "INLINE_FORMULA", F.lit("variable")).when(numbered, F.lit("equation (1)")).otherwise(F.lit("equation"))
    return F.concat(word, F.coalesce(closing_mark(latex), F.lit("")))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))
