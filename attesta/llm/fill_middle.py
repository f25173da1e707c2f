"""Fill-in-the-middle transformation by regular expressions with counted quantifiers.

A text is tiled from the left with matches of a ``unit``; ``regexp_count`` gives their number n. Two cuts a <= b follow from a
hash of the document's id. Each row then has a pattern of its own, whose possessive groups ``(?:unit){a}+`` and
``(?:unit){b-a}+`` and rest capture prefix, middle and suffix in one match, and the replacement puts them in the order of the
row's form. A possessive group never gives a unit back, so a match is one pass over the text. All columns are built-in
expressions of one projection: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = "(?s:.)"
MARKS = ("<P>", "<S>", "<M>")


def _hash_part(row_key: Column, seed: str, i: int) -> Column:
    """The i-th 8-digit group of the hex SHA-256 of ``seed:key`` as a number."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), row_key).cast("binary"), 256)
    return F.conv(F.substring(digits, 8 * i - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text an output was made from: the parts between the marks, put back in order."""
    p, s, m = map(re.escape, marks)
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(documents: DataFrame, percent: int = 90, suffix_first_percent: int = 20, unit: str = CODE_POINT,
                   marks: tuple[str, str, str] = MARKS, seed: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    ``n`` counts units (a regular expression that matches no empty string and has no capturing group). ``form`` is ``psm``
    (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``: the text itself, if it is empty, holds a mark
    or is not among the ``percent`` transformed. The lengths are code points, null for plain texts.

    A null text counts as empty; a null doc_id as an empty id. Every row is transformed by itself, so repeated rows give
    repeated results, an empty table gives no rows, and other columns of ``documents`` are not looked at, whatever their names.
    """
    p, s, m = marks
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = documents.select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[_hash_part(key, seed, i).alias(f"h{i}") for i in (1, 2, 3, 4)])
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long"))
    marked = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    rows = rows.withColumn("form", F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= percent), "plain").when(
        F.col("h4") % 100 < suffix_first_percent, "spm").otherwise("psm"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.withColumn("a", F.least(one, two)).withColumn("b", F.greatest(one, two))
    group = F.lit(f"((?:{unit}){{")
    pattern = F.concat(F.lit(r"\A"), group, F.col("a"), F.lit("}+)"), group, F.col("b") - F.col("a"), F.lit(r"}+)((?s:.*))\z"))
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(
        F.regexp_replace("text", pattern, order)))
    at = {mark: F.instr("output", mark) for mark in marks}
    prefix = F.when(F.col("form") == "psm", at[s] - 1 - len(p)).when(F.col("form") == "spm", at[m] - at[p] - len(p))
    middle = F.when(F.col("form") != "plain", F.length("output") - at[m] + 1 - len(m))
    return rows.select("doc_id", "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")
