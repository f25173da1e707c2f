"""Latest results, comparison of two independent coders, agreement and human confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.sources.tables import lookup

A, B = fixed.PROVIDER_A, fixed.PROVIDER_B
KEY = ["case_id", "variable"]
CITATIONS = "array<struct<id:string,source_id:bigint,quote:string,stance:string,page:bigint,para:bigint>>"


# ------------------------------------------------------------------------------------------------ latest results
def latest_results(results: DataFrame) -> DataFrame:
    """Shown row per case, variable and provider: the newest that was not stopped, else the newest; with its state.

    One combined aggregation instead of a window: the row travels inside the struct that is maximised.
    """
    cols = [c for c in results.columns if c not in (*KEY, "provider", "id")]
    shown = F.max(F.struct((F.col("status") != "stopped").alias("done"), "id", F.struct(*cols).alias("row"))).alias("shown")
    newest = F.max(F.struct("id", "status")).alias("newest")
    return results.groupBy(*KEY, "provider").agg(shown, newest).select(
        *KEY, "provider", F.col("shown.id").alias("id"), "shown.row.*",
        lookup(F.col("shown.row.status"), fixed.CELL_STATES, F.col("shown.row.status")).alias("state"),
        ((F.col("newest.id") != F.col("shown.id")) & (F.col("newest.status") == "stopped")).alias("stopped_latest"))


def changed_since_previous(results: DataFrame) -> DataFrame:
    """Newest completed result per case, variable and provider with the previous one, where value or status changed.

    The newest row is a combined maximum; the one before it is the maximum of what is left.
    """
    group = [*KEY, "provider"]
    done = results.where("status <> 'stopped'").select(*group, "id", "value", "status")
    newest = done.groupBy(*group).agg(F.max(F.struct("id", "value", "status")).alias("new"))
    earlier = done.join(newest.select(*group, F.col("new.id").alias("new_id")), group).where("id < new_id").groupBy(*group).agg(
        F.max(F.struct("id", "value", "status")).alias("old"))
    changed = (F.col("new.value") != F.col("old.value")) | (F.col("new.status") != F.col("old.status"))
    return newest.join(earlier, group).where(changed).select(
        *group, "new.id", "new.value", "new.status", F.col("old.value").alias("old_value"), F.col("old.status").alias("old_status"))


def provider_pivot(latest: DataFrame) -> DataFrame:
    """One column set per provider; a provider without a result shows 'not_run'."""
    wide = latest.groupBy(*KEY).pivot("provider", [A, B]).agg(F.first("state").alias("state"), F.first("value").alias("value"), F.first("id").alias("id"))
    out = []
    for p in (A, B):
        state = F.coalesce(F.col(f"{p}_state"), F.lit("not_run"))
        out += [state.alias(f"{p}_state"), lookup(state, fixed.CELL_LABELS).alias(f"{p}_label"),
                F.coalesce(F.col(f"{p}_value"), F.lit("")).alias(f"{p}_value"), F.col(f"{p}_id")]
    return wide.select(*KEY, *out)


# ------------------------------------------------------------------------------------------------ pairs
def pairs(latest: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Both coders' shown rows side by side as structs a and b (null when a coder has none); one aggregation."""
    df = latest
    if runs is not None:
        df = df.join(runs.select("run_id", "schema_version_id", "prompt_version", "model", F.lit(True).alias("has_run")), "run_id", "left")
    row = F.struct(*[c for c in df.columns if c not in KEY])
    side = lambda p: F.max(F.when(F.col("provider") == p, row))
    return df.groupBy(*KEY).agg(side(A).alias("a"), side(B).alias("b"))


def compared_values(r: Column) -> Column:
    return F.when(r["status"].isin(fixed.COMPARABLE_STATUSES), X.code_set(r["value"])).otherwise(F.array().cast("array<string>"))


def _sources(r: Column) -> Column:
    return F.coalesce(r["evidence_sources"], F.array().cast("array<bigint>"))


def both_compared(pair: DataFrame) -> DataFrame:
    ok = lambda r: r.isNotNull() & (r["state"] != "stopped")
    return pair.where(ok(F.col("a")) & ok(F.col("b")))


def with_values(pair: DataFrame) -> DataFrame:
    """Adds va and vb, the comparable code sets of the two results."""
    return pair.withColumn("va", compared_values(F.col("a"))).withColumn("vb", compared_values(F.col("b")))


def comparison(a: Column, b: Column) -> Column:
    """How two results compare (rows have va and vb); the first fitting rule decides."""
    either = lambda test: test(a) | test(b)
    same = F.col("va") == F.col("vb")
    none = lambda c: F.size(c) == 0
    sa, sb = _sources(a), _sources(b)
    return (
        F.when(either(lambda r: r["status"].isin(fixed.INVALID_STATUSES)), "invalid_provider_output")
        .when(either(lambda r: r["status"] == "not_coded_budget"), "needs_human_review")
        .when(either(lambda r: r["status"] == "partially_valid") & same, "needs_human_review")
        .when(either(lambda r: (r["status"] == "disputed") | (r["n_counter"] > 0)), F.when(same, "needs_human_review").otherwise("value_disagreement"))
        .when(none("va") & none("vb"), "both_insufficient")
        .when(none("va") | none("vb"), "one_provider_blank")
        .when(~same, "value_disagreement")
        .when((F.size(sa) > 0) & (F.size(sb) > 0) & ~F.arrays_overlap(sa, sb), "evidence_disagreement")
        .otherwise("model_agreement")
    )


def agreed_value() -> Column:
    return (F.col("va") == F.col("vb")) & (F.size("va") > 0)


def compare_pair(pair: DataFrame) -> DataFrame:
    """Adds comparison and same_value to rows where both coders have a result."""
    df = with_values(both_compared(pair))
    return df.withColumn("comparison", comparison(F.col("a"), F.col("b"))).withColumn("same_value", agreed_value())


def comparison_kind(a: Column, b: Column) -> Column:
    """matched_version, cross_version or cross_model_review."""
    seen = (a["interpretation"] == "cross_model_review") | (b["interpretation"] == "cross_model_review")
    same = (a["snapshot_id"] == b["snapshot_id"]) & (a["spec_id"] == b["spec_id"])
    return F.when(seen, "cross_model_review").when(F.coalesce(same, F.lit(False)), "matched_version").otherwise("cross_version")


def version_differences(a: Column, b: Column) -> Column:
    """Names of the version dimensions in which two results differ."""
    runs = F.coalesce(a["has_run"] & b["has_run"], F.lit(False))
    missing = a["snapshot_id"].isNull() | b["snapshot_id"].isNull() | a["spec_id"].isNull() | b["spec_id"].isNull()
    return F.filter(F.array(
        F.when(missing, "version not recorded"),
        F.when(a["snapshot_id"] != b["snapshot_id"], "evidence version"),
        F.when(runs & ~a["schema_version_id"].eqNullSafe(b["schema_version_id"]), "codebook version"),
        F.when(a["spec_id"] != b["spec_id"], "analysis version"),
        F.when(runs & ~a["prompt_version"].eqNullSafe(b["prompt_version"]), "prompt version"),
    ), lambda d: d.isNotNull())


def cited(r: Column, part: str) -> Column:
    """The citations of a result: ``evidence`` or ``counter``, an array of (id, source_id, quote, stance, page, para)."""
    return F.coalesce(r[part], F.array().cast(CITATIONS))


def united(a: Column, b: Column) -> Column:
    """Citations of both results, each passage once, as the first result that cites it has it."""
    every = F.concat(a, b)
    ids = F.transform(every, lambda c: c["id"])
    return F.filter(every, lambda c, i: F.array_position(ids, c["id"]) == i + 1)


def combined_columns(a: Column, b: Column) -> dict[str, Column]:
    """Neutral view of two results (rows have va and vb): the agreed value or blank, all citations, what each coder said."""
    partial = (a["status"] == "partially_valid") | (b["status"] == "partially_valid")
    first = F.when(a["id"] < b["id"], a["value"]).otherwise(b["value"])
    return {
        "value": F.when(agreed_value(), first).otherwise(""),
        "status": F.when(agreed_value(), F.when(partial, "partially_valid").otherwise("suggested")).otherwise("providers_differ"),
        "evidence_sources": F.array_sort(F.array_union(_sources(a), _sources(b))),
        "evidence": united(cited(a, "evidence"), cited(b, "evidence")),
        "counter": united(cited(a, "counter"), cited(b, "counter")),
        "n_counter": F.size(united(cited(a, "counter"), cited(b, "counter"))),
        "values_by_provider": F.create_map(a["provider"], F.coalesce(a["value"], F.lit("")), b["provider"], F.coalesce(b["value"], F.lit(""))),
        "evidence_statuses": F.create_map(a["provider"], a["evidence_status"], b["provider"], b["evidence_status"]),
        "evidence_status": F.when(a["evidence_status"].eqNullSafe(b["evidence_status"]), a["evidence_status"]).otherwise("MIXED"),
        "stale": a["stale"] | b["stale"],
    }


def combined_view(pair: DataFrame) -> DataFrame:
    """One neutral row for each variable that both coders have a result for."""
    columns = combined_columns(F.col("a"), F.col("b"))
    return with_values(both_compared(pair)).select(*KEY, *[c.alias(n) for n, c in columns.items()])


def normalize_value(kind: Column, value: Column) -> Column:
    """Comparable text of a value: code set, number or date; null when it cannot be compared safely."""
    v = F.trim(F.coalesce(value, F.lit("")))
    parts = F.transform(X.split_values(v), lambda p: F.upper(p))
    codes = F.when((F.size(parts) > 0) & (F.size(F.array_distinct(parts)) == F.size(parts)), F.concat(F.lit("set:"), F.array_join(F.array_sort(parts), "|")))
    n = X.parse_number(v)
    number = F.when(n.isNotNull(), F.concat(F.lit("num:"), n["lo"].cast("string"), F.when(n["hi"] != n["lo"], F.concat(F.lit(":"), n["hi"].cast("string"))).otherwise("")))
    day = X.iso_date(v)
    return F.when(v != "", F.when(kind.isin("categorical", "open_list"), codes).when(kind == "numeric", number).when(
        (kind == "date") & day.isNotNull(), F.concat(F.lit("date:"), day.cast("string"))))


# ------------------------------------------------------------------------------------------------ agreement
def batch_evidence_hash(calls: DataFrame) -> DataFrame:
    """(run_id, variable, evidence_hash) of the newest call of a run that contains the variable."""
    rows = calls.select("run_id", "id", "evidence_hash", F.explode("variables").alias("variable"))
    return rows.groupBy("run_id", "variable").agg(F.max_by("evidence_hash", "id").alias("evidence_hash"))


# what the agreement of two coders is judged by; quotations and other wide columns need not travel to it
AGREEMENT_COLUMNS = [*KEY, "provider", "id", "run_id", "type", "status", "value", "snapshot_id", "spec_id", "interpretation", "evidence_status",
                     "validation_status", "stale", "cache_status", "evidence_sources", "n_counter"]


def assess_agreement(pair: DataFrame, reviews: DataFrame, batch_hashes: DataFrame, listed: dict[str, list[str]]) -> DataFrame:
    """(case, variable) -> status, label, problems: may the two coders' agreement be confirmed in bulk?

    ``listed`` holds the codebook's options of open-list variables; results need ``AGREEMENT_COLUMNS`` only.
    """
    a, b, c = F.col("a"), F.col("b"), F.col
    h = batch_hashes.select("run_id", "variable", "evidence_hash")
    side = lambda p: h.select(c("run_id").alias(f"{p}_run"), "variable", c("evidence_hash").alias(f"{p}_hash"))
    df = (
        pair.withColumn("a_run", a["run_id"]).withColumn("b_run", b["run_id"])
        .join(side("a"), ["a_run", "variable"], "left").join(side("b"), ["b_run", "variable"], "left")
        .join(reviews.select(*KEY, c("action").alias("r_action"), c("value").alias("r_value"), c("method").alias("r_method")), KEY, "left")
    )
    kind = F.coalesce(a["type"], b["type"])
    comparable = ["suggested", "rule_unclear", "disputed", "partially_valid"]
    norm = lambda r: F.when(r["status"].isin(comparable), normalize_value(kind, r["value"]))
    df = df.withColumn("kind", comparison_kind(a, b)).withColumn("type", kind).withColumn("na", norm(a)).withColumn("nb", norm(b)).withColumn(
        "r_norm", normalize_value(kind, c("r_value"))).withColumn("differences", version_differences(a, b))
    done = lambda r: F.coalesce(r["status"].isin(fixed.COMPLETED_STATUSES), F.lit(False))
    blank = lambda r: F.trim(F.coalesce(r["value"], F.lit(""))) == ""
    has_run = lambda r: F.coalesce(r["has_run"], F.lit(False))
    final = F.coalesce(c("r_action").isin(fixed.FINAL_ACTIONS), F.lit(False))
    cross = c("kind") == "cross_version"
    either = lambda test: test(a) | test(b)
    recorded = lambda r: F.coalesce(r["validation_status"], F.lit("")) != ""
    known = lambda r: r["evidence_status"].isin(fixed.EVIDENCE_STATUSES)
    unsupported = lambda r, who: F.when(recorded(r) & ~F.coalesce(known(r), F.lit(False)), f"{who} gave no evidence status").when(
        recorded(r) & (r["evidence_status"] != "SUPPORTED"), F.concat(F.lit(f"{who} marked the evidence "), r["evidence_status"]))
    allowed = F.coalesce(*[F.when(c("variable") == v, F.array(*[F.lit(o.split("(")[0].strip().upper()) for o in opts])) for v, opts in listed.items()],
                         F.array().cast("array<string>")) if listed else F.array().cast("array<string>")
    parts = F.transform(X.split_values(a["value"]), lambda p: F.upper(F.trim(F.split_part(p, F.lit("("), F.lit(1)))))
    problems = F.filter(F.array(
        F.when(either(lambda r: r["status"] == "partially_valid"), "partially valid output").when(
            either(lambda r: r["status"] != "suggested"), "disputed or rule unclear"),
        F.when(either(lambda r: r["n_counter"] > 0), "counter-evidence reported"),
        unsupported(a, "A"), unsupported(b, "B"),
        F.when(either(lambda r: r["stale"]), "cites an excluded source"),
        F.when(either(lambda r: F.size(_sources(r)) == 0), "missing supporting evidence"),
        F.when((c("type") == "open_list") & (F.size(F.array_except(parts, allowed)) > 0), "open-list value not listed"),
        F.when(~a["schema_version_id"].eqNullSafe(b["schema_version_id"]), "codebook versions differ"),
        F.when(~cross & ~c("a_hash").eqNullSafe(c("b_hash")), "batch evidence differs"),
        F.when(c("r_action") == "deferred", "deferred by a reviewer"),
    ), lambda p: p.isNotNull())
    apart = ~F.arrays_overlap(_sources(a), _sources(b))
    confirmed = F.coalesce(c("r_method").isin("bulk_independent_agreement", "bulk_separate_run_agreement"), F.lit(False)) | F.coalesce(
        c("r_norm") == c("na"), F.lit(False))
    df = df.withColumn("problem_list", problems)
    status = (
        F.when(~done(a) & ~done(b), "pending").when(done(a) & ~done(b), "claude_only").when(done(b) & ~done(a), "openai_only")
        .when(c("kind") == "cross_model_review", "cross_model_review")
        .when(either(lambda r: r["status"] == "validation_failed"), "validation_failed")
        .when(blank(a) & blank(b), "both_insufficient").when(blank(a) | blank(b), "pending")
        .when(~c("type").isin(fixed.ELIGIBLE_TYPES) | c("na").isNull() | c("nb").isNull(), "pending")
        .when(c("na") != c("nb"), F.when(cross, "cross_version_disagreement").otherwise("value_disagreement"))
        .when(~(has_run(a) & has_run(b)), "pending")
        .when(final, F.when(confirmed, "confirmed").otherwise("pending"))
        .when(F.size("problem_list") > 0, "pending")
        .when(cross, "eligible_cross_version").when(apart, "eligible_evidence_difference").otherwise("eligible")
    )
    equal = (c("na") == c("nb")) & ~final & has_run(a) & has_run(b)
    return df.withColumn("status", status).select(
        *KEY, "status", lookup(c("status"), fixed.AGREEMENT_LABELS).alias("label"), c("status").startswith("eligible").alias("eligible"),
        F.when(F.coalesce(equal, F.lit(False)) & (c("status") == "pending"), F.array_join("problem_list", "; ")).otherwise("").alias("problems"),
        a["value"].alias("value"), "kind", F.array_join("differences", ", ").alias("differences"),
        (a["cache_status"].isin(*fixed.REUSED_STATES) | b["cache_status"].isin(*fixed.REUSED_STATES)).alias("reused"))


def eligible_summary(assessed: DataFrame, code_labels: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Eligible rows with readable values, and how many rows of each other label a case has."""
    pairs_ = [(f"{v}/{code.upper()}", label) for v, codes in code_labels.items() for code, label in codes]
    labels = F.filter(F.transform(X.split_values(F.col("value")), lambda p: lookup(F.concat_ws("/", F.col("variable"), F.upper(p)), pairs_)), lambda x: x.isNotNull())
    kept = lambda c: F.when(F.col("eligible"), F.col(c)).alias(c)
    # one aggregation over all rows, so that the assessment is made once; an eligible row stays a row of its own
    counted = assessed.select("case_id", kept("variable"), "label", kept("value"), "eligible").groupBy(
        "case_id", "variable", "label", "value", "eligible").agg(F.count("*").alias("n"))
    times = F.when(F.col("eligible"), F.array_repeat(F.lit(1).cast("bigint"), F.col("n").cast("int"))).otherwise(F.array("n"))
    return counted.select(
        "case_id", "variable", "label", "value", F.when(F.col("eligible"), F.array_join(labels, "; ")).alias("value_label"), F.explode(times).alias("n"))


def bulk_confirm(selected: DataFrame, assessed: DataFrame, reviews: DataFrame, acknowledged: bool) -> DataFrame:
    """Outcome of confirming the selected (case, variable) rows: confirmed with method, or skipped with the reason.

    A case with an unacknowledged cross-version row in its selection confirms nothing.
    """
    c = F.col
    rows = selected.distinct().join(assessed, KEY, "left").join(reviews.select(*KEY, F.lit(True).alias("reviewed")), KEY, "left")
    cross = c("status") == "eligible_cross_version"
    blocked = F.lit(False)
    if not acknowledged:
        # a maximum over the narrow selection of a case, so that the assessment is made once
        rows = rows.withColumn("halted", F.max(F.coalesce(cross, F.lit(False))).over(W.partitionBy("case_id")))
        blocked = c("halted")
    reason = (
        F.when(blocked, "version warning not acknowledged")
        .when(~F.coalesce("eligible", F.lit(False)), F.coalesce(F.when(c("problems") != "", c("problems")), "label", F.lit("not eligible")))
        .when(F.coalesce("reviewed", F.lit(False)), "a review already exists")
    )
    method = F.when(cross, "bulk_separate_run_agreement").otherwise("bulk_independent_agreement")
    return rows.select(*KEY, F.when(reason.isNull(), "confirmed").otherwise("skipped").alias("outcome"),
                       F.when(reason.isNull(), c("value")).alias("value"), F.when(reason.isNull(), method).alias("method"), reason.alias("reason"))


def coder_vs_human(latest: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per variable and coder: how often the coder agrees with the human value, differs, is blank or disputed."""
    c = F.col
    human = reviews.where(c("action").isin("accepted", "edited") & (c("value") != "")).select(*KEY, c("value").alias("human"))
    joined = latest.join(human, KEY)
    verdict = (
        F.when(c("status") == "disputed", "disputed").when(F.trim("value") == "", "blank")
        .when(F.coalesce(normalize_value(c("type"), c("value")) == normalize_value(c("type"), c("human")), c("value") == c("human")), "agree")
        .otherwise("disagree")
    )
    counts = joined.withColumn("verdict", verdict).groupBy("variable", "provider").pivot("verdict", ["agree", "disagree", "blank", "disputed"]).count()
    return counts.na.fill(0)


# ------------------------------------------------------------------------------------------------ values in use
def display_rows(pair: DataFrame) -> DataFrame:
    """One neutral row per variable: a single coder's result, or the combined view of two; with the comparison if any.

    All of it is one projection of the pair's own row.
    """
    a, b = F.col("a"), F.col("b")
    usable = lambda r: r.isNotNull() & F.coalesce(r["state"] != "stopped", F.lit(False))
    pick = F.when(usable(a), a).when(usable(b), b).when(a.isNotNull() & (b.isNull() | (a["id"] > b["id"])), a).otherwise(b)
    df = with_values(pair).withColumn("both", usable(a) & usable(b)).withColumn("s", pick)
    two, one, both = combined_columns(a, b), F.col("s"), F.col("both")
    reason = lambda r: F.when(r["review_reason"] != "", r["review_reason"])
    return df.select(
        *KEY, *[F.when(both, two[n]).otherwise(one[n]).alias(n) for n in ("value", "status", "n_counter")],
        F.when(both, two["evidence_sources"]).otherwise(_sources(one)).alias("evidence_sources"),
        *[F.when(both, two[n]).otherwise(cited(one, n)).alias(n) for n in ("evidence", "counter")],
        F.when(both, two["values_by_provider"]).alias("values_by_provider"),
        *[F.when(~both, one[n]).alias(n) for n in ("provider", "model", "rationale")],
        F.when(both, F.concat_ws("; ", reason(a), reason(b))).otherwise(one["review_reason"]).alias("why"),
        F.when(both, comparison(a, b)).alias("comparison"), F.when(both, comparison_kind(a, b)).alias("kind"), F.when(both, agreed_value()).alias("same_value"))


def current_value(display: DataFrame, reviews: DataFrame) -> DataFrame:
    """Value to calculate with: the human's, else an agreed or single unflagged suggestion, else blank; with its origin."""
    c = F.col
    r = reviews.select(*KEY, c("action").alias("r_action"), c("value").alias("r_value"))
    df = display.join(r, KEY, "full_outer")
    final = F.coalesce(c("r_action").isin(fixed.FINAL_ACTIONS), F.lit(False))
    differ = F.coalesce(c("comparison") != "model_agreement", F.lit(False))
    flagged = F.coalesce("why", F.lit("")) != ""
    usable = c("status").isin("suggested", "derived", "admin_generated")
    value = F.when(final, F.coalesce("r_value", F.lit(""))).when(differ | flagged | ~F.coalesce(usable, F.lit(False)), "").otherwise(F.coalesce("value", F.lit("")))
    origin = F.when(final, "reviewed").when(differ, "providers disagree").when(flagged, c("why")).otherwise("suggestion")
    return df.select(*KEY, value.alias("value"), origin.alias("origin"))


def export_value(display: DataFrame, reviews: DataFrame, include_unreviewed: bool) -> DataFrame:
    """Exported value and its origin: reviewed, UNREVIEWED or blank."""
    c = F.col
    r = reviews.select(*KEY, c("action").alias("r_action"), c("value").alias("r_value"), *[c(n).alias(f"r_{n}") for n in ("reason", "method", "reviewer", "source_provider")])
    df = display.join(r, KEY, "full_outer")
    final = F.coalesce(c("r_action").isin(fixed.FINAL_ACTIONS), F.lit(False))
    differ = F.coalesce(c("comparison") != "model_agreement", F.lit(False))
    offered = F.coalesce(c("status").isin(fixed.VALUE_STATUSES) & (c("value") != "") & (F.coalesce("why", F.lit("")) == ""), F.lit(False)) & F.lit(include_unreviewed)
    return df.withColumn("origin", F.when(final, "reviewed").when(differ | ~offered, "blank").otherwise("UNREVIEWED")).withColumn(
        "export_value", F.when(final, F.coalesce("r_value", F.lit(""))).when(differ | ~offered, "").otherwise(c("value")))


def review_category(grid: DataFrame, display: DataFrame, reviews: DataFrame, analyzed_cases: DataFrame) -> DataFrame:
    """Where each (case, variable) of ``grid`` stands in the review; ``grid`` also carries rule_missing."""
    c = F.col
    df = grid.join(display, KEY, "left").join(reviews.select(*KEY, c("action").alias("r_action")), KEY, "left").join(
        analyzed_cases.select("case_id").distinct().withColumn("analyzed", F.lit(True)), "case_id", "left")
    has_value = c("status").isin(fixed.VALUE_STATUSES)
    base = (
        F.when(c("r_action").isin(fixed.FINAL_ACTIONS), "confirmed").when(c("rule_missing") | (c("status") == "rule_missing"), "rule_missing")
        .when((c("status") == "disputed") | (has_value & (c("n_counter") > 0)), "disputed")
        .when((c("status") == "partially_valid") | (has_value & (c("value") != "")) | (c("r_action") == "deferred") | (c("status") == "analyst_note"), "pending")
        .otherwise("insufficient")
    )
    df = df.withColumn("base", base)
    settled = c("base").isin("confirmed", "rule_missing")
    quiet = ["model_agreement", "both_insufficient", "evidence_disagreement"]
    category = (
        F.when((c("base") == "insufficient") & c("status").isNull() & c("analyzed").isNull(), "not_analyzed")
        .when(~settled & c("comparison").isNotNull() & ~c("comparison").isin(quiet), "disputed")
        .when(~settled & (c("comparison") == "evidence_disagreement"), "pending").otherwise(c("base"))
    )
    return df.select(*KEY, category.alias("category"))
