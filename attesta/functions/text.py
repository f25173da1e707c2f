"""Column expressions for text, values and addresses. All of them stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.sources.tables import lookup

SPACE = r"[\t\n\f\r\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def squash(c: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case; every run of anything but letters, digits and underscores becomes one blank. One pass over the text."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def stem(w: Column) -> Column:
    """Cut the first fitting word ending that leaves more than three characters ('ies' becomes 'y')."""
    out = None
    for suffix in fixed.STEM_SUFFIXES:
        fits = (F.length(w) > len(suffix) + 3) & w.endswith(suffix)
        cut = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        cut = F.concat(cut, F.lit("y")) if suffix == "ies" else cut
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(w)


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9'\-]*"), F.lit(0))


def is_index_word(w: Column) -> Column:
    return (F.length(w) > 1) & ~w.isin(fixed.RETRIEVAL_STOP_WORDS)


def tokenize(c: Column) -> Column:
    """Stemmed index words of a text, in order, repeats kept."""
    return F.transform(F.filter(raw_tokens(c), is_index_word), stem)


def sig_tokens(c: Column) -> Column:
    """Words in any script that can identify an incident, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(fixed.NAME_STOP_WORDS))


def years_in(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(fixed.YEAR_PATTERN), F.lit(0))


def split_values(c: Column) -> Column:
    """Parts of a several-codes cell, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def code_set(c: Column) -> Column:
    """Order-free, case-free form of a several-codes cell."""
    return F.array_sort(F.array_distinct(F.transform(split_values(c), F.upper)))


def parse_number(c: Column) -> Column:
    """Struct (lo, hi) of a number or a number range; null when the text is neither."""
    s = F.trim(F.regexp_replace(c, "[,%]", ""))
    single = F.regexp_extract(s, r"^(-?\d+(?:\.\d+)?)$", 1)
    span = r"^(\d+(?:\.\d+)?)\s*[–-]\s*(\d+(?:\.\d+)?)$"
    lo, hi = F.regexp_extract(s, span, 1), F.regexp_extract(s, span, 2)
    return F.when(single != "", F.struct(single.try_cast("double").alias("lo"), single.try_cast("double").alias("hi"))).when(
        lo != "", F.struct(lo.try_cast("double").alias("lo"), hi.try_cast("double").alias("hi")))


def normalize_quote(c: Column) -> Column:
    """Straight quotes and dashes, no soft hyphens, no blank after a hyphen, blanks squashed, lower case.

    Letters are lowered one by one, so a piece cut out of a text keeps its form: a sigma at its end stays a sigma.
    """
    s = F.translate(c, "Σİ’‘“”–— ­", "σi''\"\"-- ")
    s = F.regexp_replace(s, "-" + SPACE + "+", "-")
    return F.lower(squash(s))


def trim_quote(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .\"']+|[ .\"']+\z", "")


def quote_found(q: Column, t: Column) -> Column:
    """A prepared quote, or every piece of it around an ellipsis, occurs in the prepared passage."""
    pieces = F.filter(F.transform(F.split(q, r"\s*(?:\.\.\.|…)\s*"), trim_quote), lambda p: p != "")
    joined = (F.size(pieces) > 1) & F.forall(pieces, lambda p: (F.length(p) >= 6) & F.contains(t, p))
    return (q != "") & (F.contains(t, q) | joined)


def quote_in_passage(quote: Column, passage: Column) -> Column:
    """The quote occurs word for word in the passage, quotation marks, dashes, blanks and case aside."""
    return quote_in_prepared(quote, normalize_quote(passage))


def quote_in_prepared(quote: Column, prepared: Column) -> Column:
    """``quote_in_passage`` for a passage that is normalised already, once for all its quotes."""
    return quote_found(trim_quote(normalize_quote(quote)), prepared)


def special_missing_form(c: Column) -> Column:
    """'-9.0' and ' -9 ' become '-9'; anything else is null."""
    code = F.regexp_extract(F.trim(c), r"^(-\d+)(?:\.0+)?$", 1)
    return F.when(code.isin(fixed.SPECIAL_MISSING), code)


def missing_reason(c: Column) -> Column:
    """Which meaning of -9 the rationale begins with: unknown, not_applicable, or null."""
    word = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), fixed.MISSING_REASON_PATTERN, 1))
    return F.when(word == "unknown", "unknown").when(word != "", "not_applicable")


BOILERPLATE = r"(?i)\b(" + "|".join(fixed.BOILERPLATE_PHRASES) + r")\b"


def is_boilerplate(c: Column) -> Column:
    hits = F.regexp_count(c, F.lit(BOILERPLATE))
    return F.when(F.length(c) < 160, hits >= 1).otherwise(hits >= 2)  # a text is searched once only


def url_host(c: Column) -> Column:
    """Network location of an address, port and user part kept; blank when there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_domain(c: Column) -> Column:
    return F.regexp_replace(url_host(c), r"^www\.", "")


def strip_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def type_priority(c: Column) -> Column:
    return lookup(c, fixed.TYPE_PRIORITY, F.lit(fixed.OTHER_TYPE_PRIORITY))


def classify_source(url: Column, title: Column, head: Column) -> Column:
    """Source type from address, title and the first 1,500 characters; the first fitting rule wins."""
    u = F.lower(F.coalesce(url, F.lit("")))
    host = url_host(u)
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), u, F.substring(F.coalesce(head, F.lit("")), 1, 1500)))
    gov = host.endswith(".gov")
    return (
        F.when(t.rlike(fixed.AAR_PATTERN), "aar")
        .when(t.rlike(fixed.LEGISLATIVE_PATTERN) & host.rlike(fixed.LEGISLATIVE_HOST_PATTERN), "legislative")
        .when(host.endswith("fcc.gov") | (t.rlike(fixed.REGULATORY_PATTERN) & gov), "regulatory")
        .when(gov | host.endswith(".mil") | host.rlike(fixed.LOCAL_GOVERNMENT_HOST_PATTERN)
              | (host.endswith(".us") & (host.contains("county") | host.contains("city"))), "government")
        .when(host.endswith(".edu") | host.contains("doi.org") | host.rlike(fixed.ACADEMIC_HOST_PATTERN), "academic")
        .when(host.endswith(".org") & t.rlike(fixed.REPORT_PATTERN), "ngo_technical")
        .when(host == "", "unknown")
        .otherwise("media")
    )


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def detect_country(location: Column) -> Column:
    """Country code named in a location; null for the U.S. and for unknown places."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(location, F.lit(""))), "[,;/()]", " "), F.lit(" "))
    american = _any([low.contains(f" {h} ") for h in fixed.US_HINTS])
    found = F.coalesce(*[
        F.when(_any([low.contains(f" {n} " if n.isascii() else n) for n in names]), code)
        for code, names, *_ in fixed.COUNTRIES
    ])
    return F.when(~american, found)


def hazard_of(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(r"\b(?:" + "|".join(words) + ")"), key) for key, words in fixed.HAZARD_WORDS])


def place_words(location: Column, country: Column) -> Column:
    """The location without the country's own names."""
    patterns = [
        (code, "(?iu)" + "|".join(rf"\b{re.escape(n)}\b" if n.isascii() else n for n in names))
        for code, names, *_ in fixed.COUNTRIES
    ]
    pattern = lookup(country, patterns)
    s = F.coalesce(location, F.lit(""))
    s = F.when(pattern.isNotNull(), F.regexp_replace(s, pattern, F.lit(" "))).otherwise(s)
    return squash(F.regexp_replace(s, "[,;]", " "))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / F.lit(fixed.CHARS_PER_TOKEN)) + 1


def iso_date(c: Column) -> Column:
    """Date of a ``YYYY-MM-DD`` text; null for anything else."""
    s = F.trim(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def duration_days(start: Column, end: Column) -> Column:
    """Days from start to end, both counted; null when a date is missing or the order is reversed."""
    return F.when(end >= start, F.datediff(end, start) + 1)


def split_paragraphs(c: Column) -> Column:
    """Paragraphs between blank lines; texts without blank lines are cut at every line."""
    blocks = F.filter(F.transform(F.split(c, r"\n\s*\n"), squash), lambda p: p != "")
    lines = F.filter(F.transform(F.split(c, LINE_BREAK), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(blocks) <= 1, lines).otherwise(blocks)
