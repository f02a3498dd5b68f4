"""Text cleaning and scoring as Column expressions; everything stays inside the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkloom.functions import lexicon as L

# --- fixed values: patterns of white space, control characters and page markers ---
SPACE = r"(?U)\s"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAGE_MARKER = r"(?U)\s*[|·•\-–—]\s*[0-9IVXLCDM]{1,5}$"


def strip(c: Column) -> Column:
    """White space of any kind off both ends (`trim` only knows spaces)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def normalize(c: Column) -> Column:
    """Byte-order marks, zero-width and control characters go, fixed spaces become spaces."""
    return F.regexp_replace(F.translate(c, "   ﻿​‌‍⁠", "   "), CONTROL, "")


def dehyphenate(c: Column) -> Column:
    """Join words that a hyphen splits across lines."""
    return F.regexp_replace(c, rf"-{SPACE}*\n{SPACE}*", "")


def is_page_number(line: Column) -> Column:
    return line.rlike(rf"^{SPACE}*[0-9]{{1,4}}{SPACE}*\z")


def drop_page_numbers(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_page_number(x)), "\n")


def count_page_numbers(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), is_page_number)).cast("long")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, rf"\n{SPACE}*\n+", "\n\n")


def strip_lines(c: Column) -> Column:
    return strip(F.array_join(F.transform(F.split(c, "\n"), strip), "\n"))


def page_marker_base(line: Column) -> Column:
    """The line without the page marker at its end; null if it has none."""
    return F.when(line.rlike(PAGE_MARKER), F.regexp_replace(F.regexp_replace(line, PAGE_MARKER, ""), rf"{SPACE}+\z", ""))


def clean_content(c: Column) -> Column:
    return strip(F.regexp_replace(F.translate(F.regexp_replace(c, "\n{3,}", "\n\n"), "﻿", ""), CONTROL, ""))


def clean_page_text(c: Column) -> Column:
    """All steps that look at one page only."""
    return strip_lines(collapse_blank_lines(drop_page_numbers(dehyphenate(normalize(c)))))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")).cast("long")


def chunk_id(document: Column, page: Column, index: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(document, r"\.[^.]*\z", ""), r"(?U)[^\p{L}\p{N}_]", "_")
    return F.concat(F.substring(stem, 1, 40), F.lit("_p"), page.cast("string"), F.lit("_c"), index.cast("string"))


def core_score(c: Column) -> Column:
    """Heuristic quality in 0..1: short, numeric, noisy and letter-poor texts rank low, else more words rank higher."""
    # --- fixed values: patterns and thresholds of this score ---
    t = strip(c)
    n = F.length(t)
    noise = F.aggregate(F.regexp_extract_all(t, F.lit(r"[|\-=_•·~*#^]{3,}"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / n
    return (
        F.when(c.isNull() | (t == ""), 0.0)
        .when(n < 20, 0.1)
        .when(t.rlike(rf"^[0-9][0-9\s.,]+\z"), 0.15)
        .when(noise / n > 0.5, 0.2)
        .when(letters < 0.3, 0.3 + letters)
        .otherwise(0.5 + F.least(F.lit(1.0), word_count(t) / 50) * 0.5)
    )


def signal_score(c: Column) -> Column:
    """Length, letters and domain signals weighed 0.4, 0.4 and 0.2; three decimals."""
    # --- fixed values: patterns and weights of this score ---
    signals = F.regexp_count(c, F.lit(r"(?i)\b(theorem|equation|process|analysis)\b")) + F.regexp_count(c, F.lit(r"[0-9]+[.,][0-9]+|[0-9]+%")) + F.regexp_count(c, F.lit(r"[=<>+\-*/]"))
    plain = F.length(F.regexp_replace(c, r"(?U)[^\p{L}\s]", "")) / F.length(c)
    score = F.least(word_count(c) / 100, F.lit(1.0)) * 0.4 + plain * 0.4 + F.least(signals / 5, F.lit(1.0)) * 0.2
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 3))


def script_language(c: Column) -> Column:
    """ar, en or mixed by the share of Arabic letters among Arabic and Latin ones."""
    arabic = F.length(F.regexp_replace(c, "[^؀-ۿݐ-ݿ]", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    share = arabic / F.nullif(arabic + latin, F.lit(0))
    return F.when(share > 0.7, "ar").when((share < 0.3) | share.isNull(), "en").otherwise("mixed")


def document_language(c: Column, sample: int = 10_000) -> Column:
    """Majority of the languages of the beginning, middle and end; ties go to the smallest name."""
    n = F.length(c)
    parts = F.array(F.substring(c, 1, sample), F.substring(c, F.floor(n / 2).cast("int") + 1, F.lit(sample)), F.substring(c, n - sample + 1, F.lit(sample)))
    found = F.array_sort(F.transform(F.when(n > 3 * sample, parts).otherwise(F.array(c)), script_language))
    # sorted, the middle one of three is the majority if there is one; three different ones: the smallest name
    return F.when((F.size(found) == 3) & (F.size(F.array_distinct(found)) < 3), F.get(found, F.lit(1))).otherwise(F.get(found, F.lit(0)))


def is_arabic(c: Column) -> Column:
    return c.rlike("[؀-ۿ]")


def sanitize(c: Column) -> Column:
    return strip(F.regexp_replace(F.translate(c, "\x00", ""), rf"{SPACE}+", " "))


def wrap_content(c: Column) -> Column:
    return F.concat(F.lit(L.CONTENT_START), sanitize(c), F.lit(L.CONTENT_END))


def tries_injection(c: Column) -> Column:
    return c.rlike("(?i)(" + "|".join(L.INJECTIONS) + ")")


def file_type(name: Column) -> Column:
    """Media type by extension; text/plain for unknown ones."""
    types = F.create_map(*(F.lit(x) for kv in L.FILE_TYPES.items() for x in kv))
    return F.coalesce(types[F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))], F.lit("text/plain"))


def tokens(c: Column) -> Column:
    """Lower-case word tokens: letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


@F.pandas_udf(StringType())
def normalize_words(texts: pd.Series) -> pd.Series:
    """Word tokens of any script, compatibility forms and cases made equal, joined by spaces; Spark has no function for that. Null for null."""
    word = re.compile(r"\w+")
    return texts.map(lambda t: None if t is None else " ".join(word.findall(unicodedata.normalize("NFKC", t).casefold())))


def folded_tokens(c: Column) -> Column:
    """The words of `normalize_words`. One string a text comes from Python, which holds a whole batch of them; lists of words would take many times as much."""
    return F.filter(F.split(normalize_words(c), " "), lambda w: w != "")


@F.pandas_udf(StringType())
def normalize_visible(texts: pd.Series) -> pd.Series:
    """Compatibility normalisation, lower case, whatever is no word or space becomes a space, single spaces; null for null."""
    other = re.compile(r"[^\w\s]")
    return texts.map(lambda t: None if t is None else " ".join(other.sub(" ", unicodedata.normalize("NFKC", t).lower()).split()))


def question_fields(fields: Column, question_type: Column) -> Column:
    """A question's map of fields without answers, explanations and scoring: only those that its type may show."""
    shown = F.lit(None).cast("array<string>")
    for kind, names in L.QUESTION_FIELDS.items():
        shown = F.when(question_type == kind, F.array(*map(F.lit, names))).otherwise(shown)
    shown = F.coalesce(shown, F.array(*map(F.lit, L.OTHER_QUESTION_FIELDS)))
    return F.map_filter(fields, lambda k, v: F.array_contains(shown, k))


def without_fields(fields: Column, names: list[str]) -> Column:
    """A map without the named fields."""
    return F.map_filter(fields, lambda k, v: ~k.isin(*names) if names else F.lit(True))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(word_count(c), F.ceil(F.length(c) / 3))


def table_to_markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table: white space collapsed, bars escaped, empty rows dropped, short rows padded."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda x: F.regexp_replace(sanitize(F.coalesce(x, F.lit(""))), r"\|", r"\\|")))
    full = F.filter(cells, lambda r: F.exists(r, lambda x: x != ""))
    width = F.aggregate(full, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(full, line)
    return F.when(F.size(full) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n"))
