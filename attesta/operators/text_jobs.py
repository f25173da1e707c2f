"""Table jobs over text columns: lines, paragraphs, page ranges, reply parsing and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.sources.tables import dimension, lookup


def text_paragraphs(sources: DataFrame) -> DataFrame:
    """(source_id, text) -> one row per paragraph with its position."""
    return sources.select("source_id", F.posexplode(X.split_paragraphs(F.col("text"))).alias("pos", "paragraph")).select(
        "source_id", (F.col("pos") + 1).alias("para"), "paragraph")


def _reflow_step(acc: Column, raw: Column) -> Column:
    line = F.trim(raw)
    joined = F.when(acc["cur"] == "", line).otherwise(F.concat_ws(" ", acc["cur"], line))
    full = line.rlike(r'[.!?:"”]$') & (F.length(joined) > 350)
    keep = lambda text: F.concat(acc["done"], F.array(text))
    return (
        F.when((line == "") & (acc["cur"] == ""), acc)
        .when(line == "", F.struct(keep(acc["cur"]).alias("done"), F.lit("").alias("cur")))
        .when(full, F.struct(keep(joined).alias("done"), F.lit("").alias("cur")))
        .otherwise(F.struct(acc["done"].alias("done"), joined.alias("cur")))
    )


def reflow_lines(sources: DataFrame) -> DataFrame:
    """Rebuild paragraphs from hard-wrapped lines. The fold runs over one document's own lines."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    rebuilt = F.aggregate(
        F.split("text", X.LINE_BREAK), start, _reflow_step,
        lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))
    kept = F.filter(F.transform(rebuilt, X.squash), lambda p: F.length(p) >= 3)
    return sources.select("source_id", F.posexplode(kept).alias("pos", "paragraph")).select(
        "source_id", (F.col("pos") + 1).alias("para"), "paragraph")


SECTION_HEADING = r"^\s*(?:#+\s*)?\**\s*([IVX]{1,4})\.\s+\**\s*([A-Z][A-Z /&]+?)\s*\**\s*$"
VARIABLE_HEADING = r"(?i)^\s*(?:#+\s*)?\**\s*Variable:\s*\**\s*(.+?)\s*\**\s*$"
CODE_LINE = r"^\s*(?:[-•*]\s+)?(-?[A-Za-z0-9][A-Za-z0-9\-]*)\s*=\s*(.+)$"
APPENDIX_HEADING = r"^\s*\**\s*APPENDICES"
CLOSING_HEADING = r"(?i)^\s*(#+\s*)?\**\s*(Analytical Relevance|Summary Notes)\b"


def sectionize_lines(lines: DataFrame) -> DataFrame:
    """(source_id, line_no, line) -> the lines inside variable blocks with section, variable and code = label parts."""
    numeral, heading = (F.regexp_extract("line", SECTION_HEADING, i) for i in (1, 2))
    variable = F.regexp_extract("line", VARIABLE_HEADING, 1)
    closes = (numeral != "") | F.col("line").rlike(APPENDIX_HEADING) | F.col("line").rlike(CLOSING_HEADING)
    marked = lines.select(
        "source_id", "line_no", "line",
        F.when(numeral != "", F.concat(numeral, F.lit(". "), F.initcap(F.trim(heading)))).alias("sec"),
        F.when(variable != "", variable).when(closes, F.lit("")).alias("mark"),
    )
    w = W.partitionBy("source_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    filled = marked.select(
        "source_id", "line_no", "line", F.col("mark").alias("own"),
        F.coalesce(F.last("sec", ignorenulls=True).over(w), F.lit("")).alias("section"),
        F.last("mark", ignorenulls=True).over(w).alias("variable"),
    )
    inside = filled.where((F.col("variable") != "") & F.col("own").isNull())
    code, label = (F.regexp_extract("line", CODE_LINE, i) for i in (1, 2))
    return inside.select(
        "source_id", "line_no", "section", "variable",
        F.when(code != "", code).alias("code"), F.when(code != "", label).alias("label"))


def page_ranges(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """Distinct integers per key -> '1-3, 7'. Runs are built in rows; only the short range texts are gathered."""
    n = F.col(number)
    islands = (
        numbers.select(key, n).distinct()
        .withColumn("island", n - F.row_number().over(W.partitionBy(key).orderBy(number)))
        .groupBy(key, "island").agg(F.min(n).alias("lo"), F.max(n).alias("hi"))
    )
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return islands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))).alias("runs")).select(
        key, F.array_join(F.transform("runs", lambda r: r["t"]), ", ").alias("ranges"))


def display_label(code: Column, table: list[tuple[str, str]]) -> Column:
    """Readable names of 'a+b' code lists; unknown codes stay as they are."""
    parts = F.transform(F.split(F.coalesce(code, F.lit("")), r"\+"), lambda p: lookup(p, table, p))
    return F.array_join(parts, " + ")


def model_cost(model_calls: DataFrame, tokens_in: Column, tokens_out: Column) -> DataFrame:
    """Adds cost_usd at list price; null for a model without a price, never zero."""
    prices = dimension(model_calls.sparkSession, fixed.MODEL_PRICES,
                       "model string, price_provider string, in_rate double, out_rate double, threshold bigint, in_factor double, out_factor double")
    long = F.coalesce(tokens_in > F.col("threshold"), F.lit(False))
    in_rate = F.col("in_rate") * F.when(long, F.col("in_factor")).otherwise(1.0)
    out_rate = F.col("out_rate") * F.when(long, F.col("out_factor")).otherwise(1.0)
    cost = F.round(tokens_in / 1e6 * in_rate + tokens_out / 1e6 * out_rate, 5)
    return (model_calls.join(prices, "model", "left").withColumn("cost_usd", cost)
            .drop("price_provider", "in_rate", "out_rate", "threshold", "in_factor", "out_factor"))


def _is_list(kind: Column) -> Column:
    return kind.startswith("ARRAY")


def parse_reply_json(replies: DataFrame, variables: list[str]) -> DataFrame:
    """(reply_id, reply) -> one item row per expected variable, or the reason the reply breaks the agreed shape."""
    parsed = replies.select("reply_id", F.try_parse_json("reply").alias("doc")).select(
        "reply_id", "doc", F.explode(F.array(*[F.lit(v) for v in variables])).alias("variable"))
    part = lambda path, kind: F.try_variant_get("doc", F.concat(F.lit("$.results."), "variable", F.lit(path)), kind)
    kind_of = lambda path: F.coalesce(F.schema_of_variant(part(path, "variant")), F.lit("VOID"))
    body = F.coalesce(F.schema_of_variant(F.try_variant_get("doc", "$.results", "variant")), F.lit("VOID"))
    rows = parsed.select(
        "reply_id", "variable", body.alias("body"), kind_of("").alias("item"),
        part(".variable", "string").alias("named"), part(".evidence_status", "string").alias("evidence_status"),
        part(".status", "string").alias("status"), kind_of(".value").alias("value_kind"),
        part(".value", "string").alias("value_text"), part(".value", "array<string>").alias("value_list"),
        F.coalesce(part(".evidence", "array<map<string,string>>"), F.array().cast("array<map<string,string>>")).alias("evidence"),
        kind_of(".evidence").alias("evidence_kind"),
    )
    stance_ok = F.forall("evidence", lambda e: F.coalesce(F.try_element_at(e, F.lit("stance")).isin(fixed.STANCES), F.lit(False)))
    violation = (
        F.when(~F.col("body").startswith("OBJECT"), "missing results")
        .when(~F.col("item").startswith("OBJECT"), "no entry")
        .when(~F.col("named").eqNullSafe(F.col("variable")), "names a different variable")
        .when(F.col("evidence_status").isNotNull() & ~F.col("evidence_status").isin(fixed.EVIDENCE_STATUSES), "invalid evidence_status")
        .when(F.col("evidence_status").isNull() & ~F.coalesce(F.col("status").isin(fixed.REPLY_STATUSES), F.lit(False)), "invalid status")
        .when(~(_is_list(F.col("value_kind")) | F.col("value_kind").isin("VOID", "STRING")), "invalid value type")
        .when(~(_is_list(F.col("evidence_kind")) | F.col("evidence_kind").isin("VOID")) | ~stance_ok, "invalid evidence entry")
    )
    value = F.when(_is_list(F.col("value_kind")), F.array_join("value_list", ", ")).otherwise(F.coalesce("value_text", F.lit("")))
    ok = F.col("violation").isNull()
    return rows.withColumn("violation", violation).select(
        "reply_id", "variable", "violation",
        F.when(ok, value).alias("value"), F.when(ok, F.col("evidence_status")).alias("evidence_status"),
        F.when(ok, F.size("evidence")).alias("n_evidence"))
