"""Stated answers for coding rules, identity and comparison."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import compare as C
from attesta.operators import identity as I
from attesta.operators import validation as V

TEXT = ("The county sent a Wireless Emergency Alert to all phones at noon. Local officials also used the reverse-911 system "
        "to call households. The siren was not sounded.")
WEA, LOCAL, NO = "sent a Wireless Emergency Alert to all phones", "used the reverse-911 system", "this was never written anywhere"

FIELDS = [
    ("ALERT", "categorical", True, False, False, ["WEA", "LOCAL", "EAS"], ["wireless", "local", "broadcast"], [], []),
    ("SEVERITY", "categorical", False, False, False, ["1", "2", "3"], ["low", "mid", "high"], [], []),
    ("LATENCY", "numeric", False, False, False, [], [], ["-9"], []),
    ("SHARE", "numeric", False, False, True, [], [], [], []),
    ("DAY", "date", False, False, False, [], [], [], []),
    ("VENDOR", "open_list", False, False, False, [], [], [], ["Everbridge (vendor)", "CodeRED"]),
    ("NO_RULE", "text", False, True, False, [], [], [], []),
    ("PERCEIVED_TIMELINESS", "categorical", False, False, False, ["1", "2", "3"], ["timely", "late", "Indeterminate"], [], []),
]
FIELD_SCHEMA = ("variable string, type string, multi boolean, rule_missing boolean, banded boolean, codes array<string>, labels array<string>, "
                "missing array<string>, options array<string>")


def cite(quote, passage="S1-P1", stance="supports"):
    return (passage, quote, stance)


# name, variable, value, evidence status, rationale, citations of the value, options {code: citations}, expected
CASES = [
    ("both cited", "ALERT", "WEA, LOCAL", "SUPPORTED", "", [], {"WEA": [cite(WEA)], "LOCAL": [cite(LOCAL)]}, ("valid", "WEA, LOCAL", "")),
    ("lower case", "ALERT", "wea; local", "SUPPORTED", "", [], {"wea": [cite(WEA)], "local": [cite(LOCAL)]}, ("valid", "WEA, LOCAL", "")),
    ("one made-up quote", "ALERT", "WEA, LOCAL", "SUPPORTED", "", [], {"WEA": [cite(WEA)], "LOCAL": [cite(NO)]},
     ("partially_valid", "WEA", "no_supporting_evidence,quote_not_found")),
    ("unknown code", "ALERT", "WEA, XYZ", "SUPPORTED", "", [], {"WEA": [cite(WEA)], "XYZ": [cite(LOCAL)]}, ("partially_valid", "WEA", "invalid_code")),
    ("unknown passage", "ALERT", "WEA, LOCAL", "SUPPORTED", "", [], {"WEA": [cite(WEA)], "LOCAL": [cite(LOCAL, "S9-P9")]},
     ("partially_valid", "WEA", "evidence_id_not_supplied,no_supporting_evidence")),
    ("contradicting only", "ALERT", "WEA, LOCAL", "SUPPORTED", "", [], {"WEA": [cite(WEA)], "LOCAL": [cite(LOCAL, stance="contradicts")]},
     ("partially_valid", "WEA", "evidence_does_not_support_selection")),
    ("options without value", "ALERT", "", "SUPPORTED", "", [], {"WEA": [cite(WEA)]}, ("invalid", "", "malformed_output")),
    ("one code by the value's evidence", "ALERT", "WEA", "SUPPORTED", "", [cite(WEA)], {}, ("valid", "WEA", "")),
    ("single select, several codes", "SEVERITY", "3, 2", "SUPPORTED", "", [cite(WEA)], {}, ("invalid", "", "single_select_multiple_codes")),
    ("repeated code", "ALERT", "WEA, wea", "SUPPORTED", "", [cite(WEA)], {}, ("invalid", "", "duplicate_codes")),
    ("-9 without a reason", "LATENCY", "-9", "SUPPORTED", "It was slow.", [cite(WEA)], {}, ("invalid", "", "missing_reason_not_stated")),
    ("-9.0 where defined", "LATENCY", "-9.0", "SUPPORTED", "Unknown: not said", [cite(WEA)], {}, ("valid", "-9", "")),
    ("-9 uncited and insufficient", "LATENCY", "-9", "INSUFFICIENT", "Unknown: not said", [], {}, ("valid", "-9", "")),
    ("-9 uncited but supported", "LATENCY", "-9", "SUPPORTED", "Unknown: not said", [], {}, ("invalid", "", "no_supporting_evidence")),
    ("-9 where undefined", "SEVERITY", "-9", "SUPPORTED", "Unknown: x", [cite(WEA)], {}, ("invalid", "", "missing_code_not_defined")),
    ("-9 undefined number", "SHARE", "-9", "SUPPORTED", "Unknown: x", [cite(WEA)], {}, ("invalid", "", "missing_code_not_defined")),
    ("blank word", "SEVERITY", "N/A", "SUPPORTED", "", [], {}, ("valid", "", "")),
    ("percentage too large", "SHARE", "130%", "SUPPORTED", "", [cite(WEA)], {}, ("invalid", "130%", "percentage_out_of_range")),
    ("range", "SHARE", "10–20", "SUPPORTED", "", [cite(WEA)], {}, ("valid", "10–20", "")),
    ("not a date", "DAY", "14 July 2021", "SUPPORTED", "", [cite(WEA)], {}, ("invalid", "14 July 2021", "not_iso_date")),
    ("impossible date", "DAY", "2021-02-30", "SUPPORTED", "", [cite(WEA)], {}, ("invalid", "2021-02-30", "not_iso_date")),
    ("no rule", "NO_RULE", "x", "SUPPORTED", "", [cite(WEA)], {}, ("invalid", "", "rule_missing")),
    ("absence from silence", "PERCEIVED_TIMELINESS", "3", "INSUFFICIENT", "Not documented: nothing", [], {}, ("valid", "3", "")),
    ("absence without the words", "PERCEIVED_TIMELINESS", "3", "INSUFFICIENT", "nothing", [], {}, ("invalid", "3", "no_supporting_evidence")),
    ("short quote", "SEVERITY", "2", "SUPPORTED", "", [cite("siren")], {}, ("invalid", "2", "no_supporting_evidence,quote_invalid_length")),
    ("ellipsis", "SEVERITY", "2", "SUPPORTED", "", [cite("The county sent … phones at noon.")], {}, ("valid", "2", "")),
]


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([(i, 1, c[1], c[2], c[3], c[4], None, False) for i, c in enumerate(CASES)],
                                  "item_id long, case_id long, variable string, value string, evidence_status string, rationale string, status string, rule_unclear boolean")
    cites, opts = [], []
    for i, c in enumerate(CASES):
        cites += [(i, 1, "value", "", n, *x) for n, x in enumerate(c[5])]
        for n, (code, xs) in enumerate(c[6].items()):
            opts.append((i, n, code))
            cites += [(i, 1, "option", code, n, *x) for x in xs]
    citations = spark.createDataFrame(cites, "item_id long, case_id long, part string, code string, ord int, passage_id string, quote string, stance string")
    options = spark.createDataFrame(opts, "item_id long, ord int, code string")
    passages = spark.createDataFrame([(1, "S1-P1", TEXT)], "case_id long, passage_id string, text string")
    fields = spark.createDataFrame(FIELDS, FIELD_SCHEMA)
    return items, citations, options, passages, fields


def test_validation_ladder(tables):
    got = {r.item_id: (r.outcome, r.value, r.reason_codes) for r in V.item_verdicts(V.validate_items(V.prepare_items(*tables))).collect()}
    wrong = {c[0]: (got[i], c[7]) for i, c in enumerate(CASES) if got[i] != c[7]}
    assert not wrong


def test_status_resolution(spark, tables):
    none = spark.createDataFrame([], "item_id long, n_kept long, n_rejected long")
    got = {r.item_id: r for r in V.resolve_status(V.validate_items(V.prepare_items(*tables)), none).collect()}
    at = lambda name: got[next(i for i, c in enumerate(CASES) if c[0] == name)]
    assert at("both cited").status == "suggested"
    assert at("one made-up quote").status == "partially_valid"
    assert (at("-9 uncited and insufficient").status, at("-9 uncited and insufficient").value) == ("suggested", "-9")
    assert at("-9 uncited and insufficient").codes == "missing_unknown_from_silence"
    assert at("absence from silence").codes == "absence_code_from_silence"
    assert at("-9 without a reason").status == "validation_failed"
    assert (at("absence without the words").status, at("absence without the words").value) == ("insufficient_evidence", "")


def test_ambiguous_keeps_the_allowed_alternative(spark):
    fields = spark.createDataFrame(FIELDS, FIELD_SCHEMA)
    passages = spark.createDataFrame([(1, "S1-P1", TEXT)], "case_id long, passage_id string, text string")
    alts = spark.createDataFrame([(10, 1, 1, "SEVERITY", 0, "2"), (11, 1, 1, "SEVERITY", 1, "99"), (12, 1, 1, "SEVERITY", 2, "2"), (13, 1, 1, "SEVERITY", 3, "1")],
                                 "alt_id long, item_id long, case_id long, variable string, ord int, value string")
    cites = alts.select(F.col("alt_id").alias("item_id"), "case_id", F.lit("value").alias("part"), F.lit("").alias("code"), F.lit(0).alias("ord"),
                        F.lit("S1-P1").alias("passage_id"), F.lit(WEA).alias("quote"), F.lit("supports").alias("stance"))
    verdicts = V.alternative_verdicts(alts, cites, passages, fields)
    chosen = spark.createDataFrame([(1, "1")], "item_id long, value string")
    kept = V.validate_alternatives(verdicts, chosen)
    assert [(r.item_id, r.value) for r in kept.collect()] == [(1, "2")]
    counts = V.alternative_counts(verdicts, kept).collect()[0]
    assert (counts.n_rejected, counts.n_kept) == (1, 1)


@pytest.mark.parametrize("location,code", [
    ("Ahrweiler, Deutschland", "DE"), ("Minsk, Belarus", None), ("Kerr County, Texas, USA", None), ("Osaka 日本", "JP"), ("Indiana", None), ("Leeds (England)", "GB"),
])
def test_country(spark, location, code):
    assert spark.range(1).select(X.detect_country(F.lit(location)).alias("c")).first().c == code


@pytest.mark.parametrize("kind,a,b,equal", [
    ("categorical", "WEA, LOCAL", "LOCAL, WEA", True), ("numeric", "13.5", "13.50", True), ("open_list", "Everbridge", "everbridge", True),
    ("date", "2021-07-14", "2021-07-15", False), ("text", "same words", "same words", False), ("categorical", "1, 1", "1, 1", False),
])
def test_normalized_values(spark, kind, a, b, equal):
    row = spark.range(1).select((C.normalize_value(F.lit(kind), F.lit(a)) == C.normalize_value(F.lit(kind), F.lit(b))).alias("same")).first()
    assert bool(row.same) is equal


AHR = [(1, "Ahr valley flood", "Ahr valley, Germany", "", "July 2021")]
CASE_SCHEMA = "case_id long, name string, location string, aliases string, date_text string"
HITS = [
    ("https://a.de/1", "Flood in the Ahr valley Germany 2021: Ahrweiler hit", "Bad Neuenahr and Ahrtal under water residents"),
    ("https://www.b.de/2", "Ahr valley flood Germany 2021", "Ahrweiler, Bad Neuenahr: Ahrtal residents wait"),
    ("https://c.org/3", "Germany Ahr valley flood 2021 inquiry", "Ahrtal Ahrweiler Bad Neuenahr"),
    ("https://c.org/4", "Germany Ahr valley flood 2021 again", "Onlyhere Onlyhere"),
]


def test_keyword_discovery(spark):
    terms = I.case_terms(spark.createDataFrame(AHR, CASE_SCHEMA))
    hits = spark.createDataFrame([(i, 1, u, t, s, "") for i, (u, t, s) in enumerate(HITS)],
                                 "hit_id long, case_id long, url string, title string, snippet string, published string")
    found = {r.term for r in I.keyword_discovery(I.score_hits(hits, terms), terms).collect()}
    assert {"Ahrweiler", "Ahrtal", "Bad Neuenahr"} <= found
    assert "Bad" not in found and "Onlyhere" not in found and "residents" not in found


def test_identity_wrong_year(spark):
    terms = I.case_terms(spark.createDataFrame(AHR, CASE_SCHEMA))
    texts = spark.createDataFrame([(1, "Elbe flood 2002 in Germany"), (1, "Ahr valley flood July 2021, Deutschland")], "case_id long, t string")
    scores = [r.identity_score for r in I.identity_score(I.with_terms(texts, terms), F.col("t")).orderBy("t").collect()]
    assert scores[0] > 0.9 and scores[1] < 0.4


def test_anchored_keywords_become_aliases_and_reach_local_titles(spark):
    terms = I.case_terms(spark.createDataFrame(AHR, CASE_SCHEMA))
    titles = [("https://a.de/1", "Ahr valley flood Germany 2021: Ahrtal"), ("https://b.de/2", "Germany 2021, Ahr valley flood in Ahrtal"),
              ("https://c.de/3", "Ahrtal Sinzig 2021"), ("https://d.de/4", "2021: Ahrtal Sinzig")]
    hits = spark.createDataFrame([(i, 1, u, t, "", "") for i, (u, t) in enumerate(titles)],
                                 "hit_id long, case_id long, url string, title string, snippet string, published string")
    first = {r.term for r in I.keyword_discovery(I.score_hits(hits, terms), terms).collect()}
    after = {r.term for r in I.expand_aliases(hits, terms).collect()}
    assert "Ahrtal" in first and "Ahrtal Sinzig" not in first
    assert {"Ahrtal", "Ahrtal Sinzig"} <= after


def test_keyword_bound_covers_every_kept_list():
    for top in (1, 8, 20):
        assert I.deciding_candidates(top) >= top + 3 * top + top * top + top**3


def test_length_of_a_quotation_counts_blanks_at_its_ends(spark):
    schema = "item_id long, case_id long, part string, code string, ord int, passage_id string, quote string, stance string"
    quotes = ["De. ... ", "De. ...", " all on. ", " " * 8]
    cites = spark.createDataFrame([(i, 1, "value", "", 0, "S1-P1", q, "supports") for i, q in enumerate(quotes)], schema)
    passages = spark.createDataFrame([(1, "S1-P1", "De. They sent all on.")], "case_id long, passage_id string, text string")
    found = {r.item_id: r.reason for r in V.check_citations(cites, passages).collect()}
    assert found == {0: None, 1: "quote_invalid_length", 2: None, 3: "quote_not_found"}


def test_pieces_of_a_passage_are_found_in_it(spark):
    passages = ["They sent it all. \x85 and more", "\u039f\u0394\u039f\u03a3\u039f\u0394\u039f\u03a3 is a way", "one\x0btwo  three four"]
    quotes = ["sent it all. \x85", "\u039f\u0394\u039f\u03a3\u039f\u0394\u039f\u03a3"[:4], "one\x0btwo three"]
    rows = spark.createDataFrame(list(zip(range(3), quotes, passages)), "i long, q string, t string")
    found = {r.i: (r.found, r.n) for r in rows.select("i", X.quote_in_passage(F.col("q"), F.col("t")).alias("found"), X.normalize_quote(F.col("t")).alias("n")).collect()}
    assert [found[i][0] for i in range(3)] == [True, True, True]
    assert found[2][1] == "one\x0btwo three four"  # as in the SQL, a vertical tab is no blank


def test_keyword_discovery_reads_the_hits_once(spark):
    terms = I.case_terms(spark.createDataFrame([(1, "Ahr Valley Flood", "Ahrweiler, Deutschland", "", "July 2021")], "case_id long, name string, location string, aliases string, date_text string"))
    rows = [(i, 1, f"https://site{i}.de/a", "Ahrtal Flood Ahr Valley Ahrweiler", "Katastrophe im Ahrtal 2021", "") for i in range(3)]
    hits = spark.createDataFrame(rows, "hit_id long, case_id long, url string, title string, snippet string, published string")
    found = I.keyword_discovery(I.score_hits(hits, terms), terms)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?:-") == 1
    assert "Ahr Valley" in {r.term for r in found.collect()}


def test_passages_are_normalised_before_their_quotations_are_made(spark, small):
    from attesta.plans.catalog import queries

    plan = queries()["quote_in_passage"](spark, small)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = next(i for i, line in enumerate(plan) if "Generate explode([0,1,2,3])" in line)
    assert any("translate(text" in line for line in plan[made:]) and not any("translate(text" in line for line in plan[:made])


def test_variable_queries_look_for_keys_by_plain_search_first(spark, small):
    from attesta.plans.catalog import queries

    plan = queries()["variable_query"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") == plan.count("RLIKE") > 0 and "RepartitionByExpression" in plan
