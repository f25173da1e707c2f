"""Tables that leave the engine: long and wide values, citations, coder results, sources and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.operators import compare as C
from attesta.operators.retrieval import rank_sources
from attesta.sources.tables import lookup

KEY = ["case_id", "variable"]


def citation_place(page: Column, para: Column) -> Column:
    return F.when(page.isNotNull(), F.concat(F.lit("p."), page)).when(para.isNotNull(), F.concat(F.lit("para "), para))


def provider_names(provider: Column) -> Column:
    """Shown names of one provider id or of several joined by ``+``."""
    return F.array_join(F.transform(F.split(provider, r"\+"), lambda p: lookup(p, fixed.PROVIDER_API_NAMES, p)), " + ")


def source_cells(values: DataFrame, sources: DataFrame) -> DataFrame:
    """(case, variable) -> '; ' list of the supporting passages with place and address, in order; an answer cites few."""
    backing = F.filter("evidence", lambda e: F.coalesce(e["stance"], F.lit("supports")) == "supports")
    rows = values.where("export_value <> ''").select(*KEY, F.posexplode(backing).alias("pos", "e"))
    named = rows.join(sources.select("source_id", "url", "final_url", "title"), F.col("e.source_id") == F.col("source_id"), "left")
    address = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("final_url", "url", "title")])
    cell = F.trim(F.concat_ws(" ", "e.id", F.coalesce(citation_place(F.col("e.page"), F.col("e.para")), F.lit("")), address))
    return named.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", cell.alias("c")))).alias("l")).select(
        *KEY, F.array_join(F.array_distinct(F.transform("l", lambda x: x["c"])), "; ").alias("source"))


def explanation(columns: list[str]) -> Column:
    """Everything an export says about a value, in one text: marks, models, confirmation, comparison, reasons and status.

    ``rule_flags`` (array), ``analyzed`` (boolean) and ``unresolved`` are used where the values have them.
    """
    c = F.col
    has = lambda n, cell: [cell(c(n))] if n in columns else []
    differ = F.coalesce(c("comparison") != "model_agreement", F.lit(False))
    blank, open_ = c("origin") == "blank", c("origin") != "reviewed"
    marked = lambda *parts: F.concat(F.lit("["), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("]"))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("values_by_provider")), lambda e: F.concat(
        lookup(e["key"], fixed.PROVIDER_SHORT_NAMES, e["key"]), F.lit("="), F.when(e["value"] == "", "(blank)").otherwise(e["value"]))), "; ")
    by = F.coalesce(F.nullif(c("r_reviewer"), F.lit("")), F.lit("reviewer"))
    return F.concat_ws(
        " ",
        F.when(c("origin") == "UNREVIEWED", "[UNREVIEWED SUGGESTION — not confirmed by a human coder]"),
        F.when(c("provider").isNotNull() & open_, marked("model: ", F.concat_ws(" ", "provider", F.nullif(c("model"), F.lit(""))))),
        F.when(c("values_by_provider").isNotNull() & open_, marked("independent providers: ", said)),
        F.when(c("r_method") == "bulk_independent_agreement", marked("human-confirmed independent model agreement (bulk confirmation) by ", by))
        .when(c("r_method") == "bulk_separate_run_agreement", marked("human-confirmed CROSS-VERSION model agreement (bulk confirmation, version warning acknowledged) by ", by))
        .when(F.coalesce("r_source_provider", F.lit("")) != "", marked("accepted from ", provider_names(c("r_source_provider")), " suggestion")),
        F.when(differ, marked("providers: ", lookup(c("comparison"), fixed.COMPARISON_LABELS, c("comparison")), "; human decision needed")),
        F.when(c("kind") == "cross_version", F.when(c("same_value"), "[cross-version: same suggested value, different analysis versions]").otherwise(
            "[cross-version: results differ, but the models also used different analysis inputs]")),
        F.when(c("r_action").isin("edited", "cleared") & (c("r_reason") != ""), F.concat(F.lit("Reviewer: "), "r_reason")),
        *has("rule_flags", lambda f: F.when(F.size(f) > 0, F.array_join(F.transform(f, lambda x: F.concat(F.lit("[rule check: "), x, F.lit("]"))), " "))),
        *has("analyzed", lambda f: F.when(~f & c("status").isNull(), "[not analyzed: no coding analysis has been run for this case — not a finding of insufficient evidence]")),
        F.nullif(c("rationale"), F.lit("")),
        *has("unresolved", lambda u: F.when(u != "", F.concat(F.lit("Unresolved: "), u))),
        F.when(blank & c("status").isNotNull() & ~c("status").isin(fixed.VALUE_STATUSES), F.concat(F.lit("(status: "), "status", F.lit(")"))),
        F.when(blank & (F.coalesce("why", F.lit("")) != ""), F.concat(F.lit("("), "why", F.lit(")"))))


def export_long(values: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per case and variable: value, source, explanation, origin."""
    return values.join(source_cells(values, sources), KEY, "left").select(
        *KEY, F.col("export_value").alias("value"), F.coalesce("source", F.lit("")).alias("source"), explanation(values.columns).alias("explanation"), "origin")


def export_case_row(values: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per case, one typed column per codebook position; several-codes values stay text, blanks become null."""
    wide = values.groupBy("case_id").pivot("variable", [n for n, _ in columns]).agg(F.first("export_value"))

    def cell(name: str, kind: str) -> Column:
        v = F.when(F.col(name) != "", F.col(name))
        if kind == "numeric":
            return F.when(v.rlike(r"^-?\d+(\.\d+)?$"), v.try_cast("double"))
        if kind == "date":
            return X.iso_date(v)
        return v

    return wide.select("case_id", *[cell(n, k).alias(n) for n, k in columns])


def export_evidence(latest: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per citation of every coder, for and against, with its place and the source's address and type."""
    cites = F.concat(C.cited(latest, "evidence"), C.cited(latest, "counter"))
    rows = latest.select(*KEY, "provider", "interpretation", F.inline(cites))
    about = sources.select("source_id", F.coalesce("final_url", "url").alias("url"), "source_type")
    return rows.join(about, "source_id", "left").select(
        *KEY, "stance", F.col("id").alias("passage"), F.concat(F.lit("S"), "source_id").alias("source"), "page", "para", "quote", "url", "source_type",
        provider_names(F.col("provider")).alias("provider"), "interpretation")


def export_provider_suggestions(latest: DataFrame, runs: DataFrame, compared: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per coder result with its versions, cache state, comparison and the human-approved value."""
    final = reviews.where(F.col("action").isin(fixed.FINAL_ACTIONS)).select(*KEY, F.col("value").alias("approved"), F.lit(True).alias("is_final"))
    label = F.when(F.coalesce("is_final", F.lit(False)) & F.col("comparison").isNotNull(), "human_approved").otherwise(F.col("comparison"))
    recorded = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not recorded")).alias(c)
    return (
        latest.join(runs.select("run_id", "model"), "run_id", "left").join(compared.select(*KEY, "comparison"), KEY, "left").join(final, KEY, "left")
        .select(*KEY, lookup(F.col("provider"), fixed.PROVIDER_API_NAMES, F.col("provider")).alias("provider"), "model", "value", "status", "cache_status",
                recorded("snapshot_id"), recorded("spec_id"), "run_id", F.timestamp_seconds("generated_at").cast("string").alias("generated_at"),
                F.coalesce(lookup(label, fixed.COMPARISON_LABELS), F.lit("")).alias("comparison"), F.coalesce("approved", F.lit("")).alias("approved"),
                recorded("evidence_status"))
    )


def export_sources(sources: DataFrame) -> DataFrame:
    """Ranked list of the selected sources per case with derived columns."""
    chosen = sources.where(~F.col("excluded"))
    ranked = rank_sources(chosen, "type")
    usable = (F.col("fetch_status") == "ok") & F.col("duplicate_of").isNull() & (F.col("relevance_status") != "irrelevant") & (F.col("n_passages") > 0)
    yes_no = lambda c: F.when(c, "yes").otherwise("no")
    return ranked.select(
        "case_id", "rank", F.concat(F.lit("S"), "source_id").alias("source"), "title",
        lookup(F.col("source_type"), fixed.SOURCE_TYPE_LABELS, F.col("source_type")).alias("type"), X.url_domain(F.col("url")).alias("domain"), "lang", "url",
        F.when(F.coalesce("final_url", F.lit("")) != F.col("url"), F.coalesce("final_url", F.lit(""))).otherwise("").alias("final_url"),
        F.when(F.col("fetch_status") == "ok", "retrieved").otherwise(F.concat(F.lit("not retrieved ("), "fetch_status", F.lit(")"))).alias("retrieval"),
        F.coalesce(F.concat(F.lit("S"), "duplicate_of"), F.lit("")).alias("duplicate_of"), yes_no(usable).alias("usable"),
        F.when(F.col("job_id").isNotNull(), F.concat(F.lit("run "), "job_id")).when(F.col("origin").isin("manual_url", "upload", "text"), "added by user").otherwise("").alias("search_run"))


def export_json_bundle(values: DataFrame, passages: DataFrame, sections: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(case_id, section, item, json): results with their citations, the cited passages and whole further tables, one JSON row each.

    ``sections`` maps a section (review history, bulk confirmations, sources, searches, usage, runs) to the column that names
    its items and its rows, which have a case_id. A case's bundle is the set of its rows, so no case is folded into one document.
    """
    def rows(section: str, item: str, df: DataFrame) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in df.columns if c != "case_id"]), {"ignoreNullFields": "false"})
        return df.select("case_id", F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), body.alias("json"))

    known = values.select("*", *[C.cited(values, n).alias(f"all_{n}") for n in ("evidence", "counter")])
    results = known.select("case_id", "variable", "export_value", "origin", F.col("all_evidence").alias("evidence"), F.col("all_counter").alias("counter"))
    cited = known.select(F.explode(F.concat("all_evidence", "all_counter")).alias("e")).select(F.col("e.id").alias("passage_id")).distinct()
    texts = passages.join(cited, "passage_id", "left_semi").select("case_id", "passage_id", "seq", "text")
    out = rows("result", "variable", results).unionByName(rows("passage", "passage_id", texts))
    for section, (item, df) in sections.items():
        out = out.unionByName(rows(section, item, df))
    return out
