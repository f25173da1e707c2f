"""Citations, explanation texts and specifications on small fixtures."""

from pyspark.sql import functions as F

from attesta.operators import compare as C
from attesta.operators import exports as E
from attesta.operators import retrieval as R
from attesta.operators import rollups

CITE = "struct<id:string,source_id:bigint,quote:string,stance:string,page:bigint,para:bigint>"


def test_citations_are_united_by_passage_and_the_first_coder_leads(spark):
    a = [("S1-P2", 1, "from a", "supports", None, 2), ("S1-P7", 1, "x", "supports", 2, 7)]
    b = [("S1-P7", 1, "from b", "supports", 2, 7), ("S3-P1", 3, "y", "supports", None, 1)]
    row = spark.createDataFrame([(a, b)], f"a array<{CITE}>, b array<{CITE}>").select(C.united(F.col("a"), F.col("b")).alias("u")).first()
    assert [(c.id, c.quote) for c in row.u] == [("S1-P2", "from a"), ("S1-P7", "x"), ("S3-P1", "y")]


VALUES = (f"case_id long, variable string, export_value string, origin string, evidence array<{CITE}>, counter array<{CITE}>, provider string, model string, "
          "values_by_provider map<string,string>, rationale string, comparison string, kind string, same_value boolean, status string, why string, r_action string, "
          "r_reason string, r_method string, r_reviewer string, r_source_provider string, rule_flags array<string>, analyzed boolean, unresolved string")


def test_explanation_names_models_coders_and_reasons(spark):
    cites = [("S5-P3", 5, "q", "supports", None, 3), ("S5-P9", 5, "q", "alternative", None, 9), ("S5-P3", 5, "again", "supports", None, 3), ("S6-P6", 6, "q", None, 2, 6)]
    rows = [
        (1, "A", "x", "reviewed", cites, [], "openai", "m", None, "Said so.", None, None, None, "suggested", "", "edited", "checked", None, "ann", "anthropic+openai", ["flag"], True, "open point"),
        (1, "B", "", "blank", [], [], None, None, {"openai": "", "anthropic": "1"}, "", "value_disagreement", "cross_version", False, "providers_differ", "why", None, None, None, None, None, [], True, ""),
        (1, "C", "", "blank", [], [], None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, False, None),
        (1, "D", "2", "UNREVIEWED", [], [], "anthropic", "m1", None, None, None, None, None, "suggested", "", None, None, None, None, None, None, True, None),
        (1, "E", "2", "reviewed", [], [], "anthropic", "m1", None, None, None, None, None, "suggested", "", "accepted", "", "bulk_separate_run_agreement", None, "openai", None, True, None),
    ]
    sources = spark.createDataFrame([(5, "u5", "f5", "t5"), (6, "", None, "t6")], "source_id long, url string, final_url string, title string")
    got = {r.variable: r for r in E.export_long(spark.createDataFrame(rows, VALUES), sources).collect()}
    assert got["A"].source == "S5-P3 para 3 f5; S6-P6 p.2 t6"
    assert got["A"].explanation == "[accepted from Anthropic API + OpenAI API suggestion] Reviewer: checked [rule check: flag] Said so. Unresolved: open point"
    assert got["B"].explanation == ("[independent providers: Claude=1; GPT=(blank)] [providers: Value disagreement; human decision needed] "
                                    "[cross-version: results differ, but the models also used different analysis inputs] (status: providers_differ) (why)")
    assert got["C"].explanation.startswith("[not analyzed") and got["C"].source == ""
    assert got["D"].explanation == "[UNREVIEWED SUGGESTION — not confirmed by a human coder] [model: anthropic m1]"
    assert got["E"].explanation == "[human-confirmed CROSS-VERSION model agreement (bulk confirmation, version warning acknowledged) by reviewer]"


def test_bundle_has_the_cited_passages_only(spark):
    against = [("S5-P4", 5, "q", "contradicts", None, 4)]
    row = (1, "A", "x", "reviewed", [("S5-P3", 5, "q", "supports", None, 3)], against, *[None] * 17)
    passages = spark.createDataFrame([(1, f"S5-P{i}", i, f"text {i}") for i in range(1, 7)], "case_id long, passage_id string, seq long, text string")
    runs = spark.createDataFrame([(1, 9, None)], "case_id long, run_id long, model string")
    got = E.export_json_bundle(spark.createDataFrame([row], VALUES), passages, {"run": ("run_id", runs)}).collect()
    assert sorted((r.section, r.item) for r in got) == [("passage", "S5-P3"), ("passage", "S5-P4"), ("result", "A"), ("run", "9")]
    assert [r.json for r in got if r.section == "run"] == ['{"run_id":9,"model":null}']


def test_specification_leaves_out_rules_a_variable_does_not_have(spark):
    rows = [("PLAIN", "text", False, None, None, None, None, None, None, None, None, None, None, []),
            ("WHY", "numeric", True, "share", [], [], [], [(0, 5, "few")], ["-9"], ["Unknown"], None, "%", "n" * 700, ["Workbook data only"])]
    fields = spark.createDataFrame(rows, "name string, type string, multi boolean, definition string, codes array<string>, labels array<string>, open_options array<string>, "
                                   "bands array<struct<low:int,high:int,label:string>>, missing_codes array<string>, missing_labels array<string>, absence string, format string, notes string, issues array<string>")
    spec = {r["name"]: r.spec.split("\n") for r in R.variable_specs(fields).collect()}
    assert spec["PLAIN"] == ["### PLAIN  (type: text, single value)", "Definition: ", "No special missing value is defined for this variable: leave blank when not established."]
    assert spec["WHY"][0] == "### WHY  (type: numeric, MULTI-SELECT, CAUSAL)" and spec["WHY"][2] == "Percentage bands: 0-5% = few (record a percentage number)"
    assert spec["WHY"][-2:] == ["Coding notes: " + "n" * 600, "Known rule issues (follow the codebook text literally and mention these in 'unresolved' if relevant): "]


def test_a_note_decides_over_placeholders_and_absence_codes(spark):
    cells = spark.createDataFrame([(i, v, x) for i in (1, 2) for v in ("A", "B", "C") for x in ("N/A", "-9")], "row long, variable string, value string")
    book = spark.createDataFrame([(v, "categorical", False, "sourced", ["0"], ["none documented"], [], n) for v, n in (("A", None), ("B", []), ("C", ["PI-M3", "PI-M7"]))],
                                 "variable string, type string, multi boolean, field_class string, codes array<string>, labels array<string>, missing array<string>, noted array<string>")
    assert {r.variable: r.decisions for r in rollups.missingness_audit(cells, book).collect()} == {"A": "PI-M3, PI-M4", "B": "PI-M3", "C": "PI-M3, PI-M7"}


def test_ranks_of_one_case_with_many_equal_sources(spark, monkeypatch):
    monkeypatch.setattr(R, "RANK_RANGE", 7)
    rows = [(1 if i % 3 else 2 + i % 5, i, "media" if i % 4 else "government", None if i % 2 else i % 3, 0 if i % 7 else i) for i in range(200)]
    frame = spark.createDataFrame(rows, "case_id long, source_id long, source_type string, n_pages long, n_passages long")
    order = {"type": lambda r: (r[2] != "government", -(r[3] or 0), -r[4], r[1]), "length": lambda r: (-(r[3] or 0), -r[4], r[1]), "found": lambda r: r[1]}
    for mode, key in order.items():
        want = {}
        for r in sorted(rows, key=key):
            want[r[1]] = sum(1 for s in rows if s[0] == r[0] and key(s) < key(r)) + 1
        assert {r.source_id: r["rank"] for r in R.rank_sources(frame, mode).collect()} == want
