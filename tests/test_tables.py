"""Ordered logs, versions, ledgers, archives and writers on small tables."""

import random
import re
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators import changes as H
from attesta.operators import ordered as O
from attesta.operators import passages as P
from attesta.operators import ranking as K
from attesta.operators import rollups as R
from attesta.session import scratch_folder
from attesta.sources import sinks


def test_last_before_looks_across_blocks(spark):
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 else i % 5, rng.choice([None, None, "x", "y", "z"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, v string")
    got = {r.id: r.seen for r in K.last_before(df, ["g"], "id", {"seen": F.col("v")}, block_rows=7).collect()}
    want, held = {}, {}
    for i, g, v in rows:
        want[i] = held.get(g)
        held[g] = v or held.get(g)
    assert got == want


def test_review_history_and_current_value(spark):
    steps = [("edit", "a"), ("defer", "-"), ("accept", "b"), ("reset", "-"), ("defer", "-"), ("clear", "-")]
    df = spark.createDataFrame([(i, 1, "V", a, v, "r", "me") for i, (a, v) in enumerate(steps)],
                               "id long, case_id long, variable string, action string, value string, reason string, reviewer string")
    history = H.review_history(df)
    assert [(r.old_value, r.new_value) for r in history.orderBy("id").collect()] == [
        (None, "a"), ("a", "a"), ("a", "b"), ("b", None), (None, ""), ("", "")]
    assert [(r.action, r.value) for r in H.review_current(history).collect()] == [("cleared", "")]
    assert H.review_current(history.where("id <= 3")).count() == 0


def test_the_third_call_after_a_repeated_client_error_is_not_sent(spark):
    log = ["HTTP 400", None, "HTTP 400", None, "HTTP 503"]
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(log)] + [(2, 9, "HTTP 503"), (2, 10, "HTTP 503"), (2, 11, None)],
                               "run_id long, id long, error_signature string")
    out = {r.id: r.outcome for r in O.repeat_error_abort(df).collect()}
    assert out == {0: "failed", 1: "sent", 2: "failed", 3: "not sent", 4: "not sent", 9: "failed", 10: "failed", 11: "sent"}


def test_sequence_continues_after_the_highest_number(spark):
    new = spark.createDataFrame([(5, "20210714-TX"), (7, "20210714-TX"), (6, "20210714-CA")], "key long, prefix string")
    old = spark.createDataFrame([("20210714-TX03",), ("20210714-TX01",)], "case_code string")
    assert {r.key: r.case_code for r in O.sequence_ids(new, old).collect()} == {5: "20210714-TX04", 7: "20210714-TX05", 6: "20210714-CA01"}
    old = spark.createDataFrame([("20210714-TX99",), ("20210714-TX100",), ("20210714-TX007",)], "case_code string")
    assert {r.key: r.case_code for r in O.sequence_ids(new.where("prefix LIKE '%TX'"), old).collect()} == {5: "20210714-TX101", 7: "20210714-TX102"}


def test_snapshot_ignores_order_and_notices_every_change(spark):
    passages = [(1, "S1-P1", "a"), (1, "S1-P2", "b"), (1, "S2-P1", "c")]
    sources = [(1, 1, "h1", False), (1, 2, "h2", False)]

    def fingerprint(ps, ss, configuration="k=8"):
        p = spark.createDataFrame(ps, "case_id long, passage_id string, text string")
        s = spark.createDataFrame(ss, "case_id long, source_id long, content_hash string, excluded boolean")
        return P.evidence_snapshot(p, s, configuration).first().fingerprint

    base = fingerprint(passages, sources)
    assert base == fingerprint(passages[::-1], sources[::-1])
    others = {fingerprint(passages[:2], sources), fingerprint([*passages[:2], (1, "S2-P1", "d")], sources),
              fingerprint(passages, [sources[0], (1, 2, "h2", True)]), fingerprint(passages, sources, "k=9"),
              fingerprint([(1, "S1-P1", "b"), (1, "S1-P2", "a"), passages[2]], sources)}
    assert base not in others and len(others) == 5


def test_usage_summary_keeps_unknown_prices_apart(spark):
    rows = [(1, "search", None, True), (1, "search", None, True), (1, "model", 0.25, False), (2, "search", 0.016, True), (2, "search", None, True)]
    got = {(r.case_id, r.activity.split()[0]): (r.requests, r.cost, r.basis.split(" ")[0]) for r in R.usage_summary(
        spark.createDataFrame(rows, "case_id long, kind string, cost_usd double, estimated boolean")).collect()}
    assert got[(1, "Web")] == (2, None, "unknown") and got[(1, "Coding")] == (1, 0.25, "measured")
    assert got[(2, "Web")] == (2, 0.016, "partly") and got[(2, "Coding")] == (0, 0.0, "none")


def test_archive_and_schema_growth_can_be_repeated(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, None, None)], "id long, v string, f boolean")
    kept, packed = H.archive(rows, F.col("f"))
    assert (kept.count(), packed.count()) == (2, 1)
    assert sorted(map(str, H.restore(kept, packed).collect())) == sorted(map(str, rows.collect()))
    assert H.restore(rows, packed).count() == 3
    wanted = T.StructType([T.StructField("id", T.LongType()), T.StructField("w", T.StringType())])
    grown = H.schema_evolve(H.schema_evolve(rows, wanted), wanted)
    assert grown.columns == ["id", "v", "f", "w"] and grown.where("w IS NOT NULL").count() == 0


def test_writers_round_trip(spark):
    df = spark.createDataFrame([(1, 'quote " and, comma', "ü"), (2, "", None)], "id long, a string, b string")
    for write, read in [(sinks.write_tsv, lambda p: spark.read.option("sep", "\t").option("header", True).csv(p)),
                        (sinks.write_csv, lambda p: spark.read.option("header", True).option("escape", '"').csv(p)),
                        (sinks.write_json, spark.read.json), (sinks.write_parquet, spark.read.parquet)]:
        path = scratch_folder(spark)
        write(df, path)
        back = {int(r["id"]): (r["a"] or "", r["b"]) for r in read(path).collect()}
        assert back == {1: ('quote " and, comma', "ü"), 2: ("", None)}


def test_header_beginnings_are_met_without_comparing_all_with_all(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("AB") for _ in range(rng.randint(3, 5)))
    names = [f"{word()}_{word()}" for _ in range(60)] + ["SIREN_STATUS (Primary)", "Siren Statistics Note"]
    headers = [f"{word()[:4]} {word()[:4]}" for _ in range(150)] + ["Sire Stat", "SIREN STATI NOT", "si stat", "", None]
    book = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "cb_id long, codebook_name string")
    asked = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "position long, header string")
    parts = lambda x: [t for t in re.split("[^A-Z0-9]+", x.upper()) if t]
    seen = 0
    for r in R.header_match(asked, book).collect():
        near = [n for n in names if r.header and len(parts(n)) == len(parts(r.header)) and parts(n) != parts(r.header)
                and all(len(h) >= 3 and v.startswith(h) for h, v in zip(parts(r.header), parts(n)))]
        if r.mapping in ("approximate", "none"):
            assert (r.mapping, r.codebook_name) == (("approximate", near[0]) if len(near) == 1 else ("none", None)), r
            seen += len(near) == 1
    assert seen > 5
    # 20,000 open headers and names with the same first characters: 400,000,000 pairs, none of which holds
    many = spark.range(20_000)
    book = many.select(F.col("id").alias("cb_id"), F.format_string("LARGE RING KEY%05dX", "id").alias("codebook_name"))
    asked = many.select(F.col("id").alias("position"), F.format_string("LAR RIN KEY9%05d", "id").alias("header"))
    began = time.time()
    assert R.header_match(asked, book).where("mapping = 'none'").count() == 20_000 and time.time() - began < 30
