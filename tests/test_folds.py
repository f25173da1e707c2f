"""Pages, passages, duplicates, packing, budgets and vectors on small inputs, against plain Python where SQL is silent."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.operators import dedup as D
from attesta.operators import ordered as O
from attesta.operators import passages as P
from attesta.operators import ranking as K
from attesta.operators import retrieval as R
from attesta.operators import text_jobs as J
from attesta.session import written

HTML = """<!DOCTYPE html><html lang="en-US"><head><title>Plain title</title><meta property="og:title" content="Flood report">
<meta property="og:site_name" content="County News"><meta property="article:published_time" content="2021-07-15T10:00:00Z"></head>
<body><nav><p>Navigation text that is long enough to be kept</p></nav><article><h1>A heading long enough to be a block</h1>
<p>The first paragraph of the article is here.</p><p>short</p><p>The first paragraph of the article is here.</p>
<ul><li>A list entry <a href="/more#x">with a link</a> inside it</li><li><p>A nested paragraph inside the entry</p></li></ul></article>
<p>Text outside of the article is not read at all.</p><footer><p>Footer text that is long enough too</p></footer><a href="mailto:x@y">mail</a></body></html>"""


def test_page_reading(spark):
    page = P.read_page(HTML, "https://news.example.com/a/b")
    assert (page["title"], page["publisher"], page["language"]) == ("Flood report", "County News", "en")
    assert page["published"] == "2021-07-15T10:00:00Z"
    assert page["paragraphs"] == [
        "A heading long enough to be a block", "The first paragraph of the article is here.", "A list entry with a link inside it",
        "A nested paragraph inside the entry"]
    assert page["links"] == [{"url": "https://news.example.com/more", "link_text": "with a link"}]
    df = spark.createDataFrame([(1, "https://news.example.com/a/b", HTML)], "page_id long, url string, html string")
    assert P.html_extract(df).count() == 4 and P.html_links(df).count() == 1


def test_page_without_blocks_or_metadata():
    page = P.read_page("<html><body>One line of text that is long enough<br>tiny<script>var x</script></body></html>", "")
    assert page["paragraphs"] == ["One line of text that is long enough"]
    assert (page["title"], page["language"], page["publisher"]) == ("", "", "")


def test_publisher_and_date_from_linked_data():
    script = '<script type="application/ld+json">%s</script>'
    page = P.read_page("<html><head>" + script % "{broken" + script % '[{"a": 1}, {"datePublished": "2020-01-02", "publisher": {"name": "The House"}}]' + "</head></html>", "")
    assert (page["published"], page["publisher"]) == ("2020-01-02", "The House")
    page = P.read_page('<html><head><meta name="author" content="Someone">' + script % '{"datePublished": "2020", "publisher": {"name": "X"}}' + "</head></html>", "")
    assert page["publisher"] == "Someone"


def test_passages_lose_no_text_and_keep_their_size(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma.", "delta"]) for _ in range(n))
    paragraphs = [words(rng.choice([5, 60, 400, 900])) for _ in range(30)] + ["x" * 4000]
    found = spark.createDataFrame([(paragraphs,)], "ps array<string>").select(P.page_passages(F.col("ps")).alias("p")).first().p
    chunks = [(x.para, x.text) for x in found]
    assert "".join("".join(t.split()) for _, t in chunks) == "".join("".join(p.split()) for p in paragraphs)
    assert all(len(t) <= fixed.PASSAGE_MAX + 1 for _, t in chunks)
    assert [n for n, _ in chunks] == sorted(n for n, _ in chunks)
    df = spark.createDataFrame([(7, [(1, ["a" * 600, "Read more and subscribe now"]), (2, ["b" * 600])])],
                               "source_id long, page_list array<struct<page:long, paragraphs:array<string>>>")
    rows = P.make_passages(df).orderBy("seq").collect()
    assert [(r.passage_id, r.page, r.para, r.dropped) for r in rows] == [("S7-P1", 1, 1, 1), ("S7-P2", 2, 1, 1)]


def brute_near(docs):
    """The rule in the order of authority, in plain Python."""
    sets = {}
    for i, case, kind, text in docs:
        w = text.lower().split()
        sets[i] = {h for k in range(len(w) - 4) if (h := zlib.crc32(" ".join(w[k:k + 5]).encode())) % 3 == 0}
    prio = dict(fixed.TYPE_PRIORITY)
    rank = {i: (prio.get(kind, 5), 1, i) for i, case, kind, text in docs}
    case_of = {i: case for i, case, *_ in docs}
    cont = lambda a, b: len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) if sets[a] and sets[b] else 0.0
    copies, out = set(), {}
    for i in sorted(sets, key=rank.get):
        if any(rank[o] < rank[i] and o not in copies and case_of[o] == case_of[i] and cont(i, o) >= 0.6 for o in sets):
            copies.add(i)
    for i in copies:
        c, _, o = min((-cont(i, o), rank[o], o) for o in sets if o not in copies and rank[o] < rank[i] and case_of[o] == case_of[i] and cont(i, o) >= 0.6)
        out[i] = (o, round(-c, 3))
    return out


def test_near_duplicates_match_brute_force_with_a_large_group_of_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, phrase = make(120), make(9)
    docs = []
    for i in range(90):
        if i % 3 == 0:  # a third of all documents are edited copies of one text
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif i % 3 == 1:  # a common phrase, otherwise different
            w = make(60) + phrase
        else:
            w = make(80)
        docs.append((i, 1 if i < 70 else 2, rng.choice(["media", "government", "aar"]), " ".join(w)))
    df = spark.createDataFrame(docs, "source_id long, case_id long, source_type string, text string").withColumn("content_type", F.lit("text/html"))
    got = {r.source_id: (r.near_duplicate_of, r.similarity) for r in D.near_duplicates(D.shingle_sets(df)).collect()}
    assert got == brute_near(docs) and len(got) >= 25


def test_leader_pairs_grow_with_the_members_and_not_with_their_square(spark):
    docs = [(i, 1, "media", "text/html", " ".join(f"w{j}" for j in range(60))) for i in range(200)]
    df = spark.createDataFrame(docs, "source_id long, case_id long, source_type string, content_type string, text string")
    assert D.leader_pairs(D.shingle_sets(df)).count() == 199


def test_overlaps_with_a_leader_of_all_its_shingles_are_whole(spark):
    words = [f"w{i}" for i in range(900)]
    docs = [(1, 1, "government", words[:300]), (2, 1, "media", words[100:500]), (3, 1, "media", words[450:900]), (4, 1, "media", words[:40] + words[280:300])]
    df = spark.createDataFrame([(i, c, k, " ".join(w)) for i, c, k, w in docs], "source_id long, case_id long, source_type string, text string").withColumn("content_type", F.lit("text/html"))
    sets = D.shingle_sets(df)
    sh = {r.source_id: set(r.sh) for r in sets.collect()}
    found = {r.source_id: r.common for r in D.leader_overlaps(sets).where("other_id = 1").collect()}
    assert found == {i: len(sh[i] & sh[1]) for i in sh if sh[i] & sh[1]} and len(found) == 3


def test_cross_pairs_miss_no_pair_of_two_sides(spark):
    rng = random.Random(12)
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.choice([12, 40, 120]))] if i % 3 == 0 else docs[-1][3].split()[rng.randint(0, 5):] + [f"x{i}"]
        docs.append((i, 1 + i // 40, "media", " ".join(w)))
    df = spark.createDataFrame(docs, "source_id long, case_id long, source_type string, text string").withColumn("content_type", F.lit("text/html"))
    sets = D.shingle_sets(df).where("n > 0").persist()
    sh = {r.source_id: (r.case_id, set(r.sh)) for r in sets.collect()}
    share = lambda a, b: len(sh[a][1] & sh[b][1]) / min(len(sh[a][1]), len(sh[b][1])) if sh[a][0] == sh[b][0] else 0
    want = {(a, b) for a in sh for b in sh if a % 4 == 0 and b % 4 and share(a, b) >= 0.6}
    for swapped in (False, True):
        sides = [sets.where("source_id % 4 = 0"), sets.where("source_id % 4 <> 0")]
        got = {(r.source_id, r.other_id) for r in D._cross_pairs(*(sides[::-1] if swapped else sides)).collect()}
        assert want <= ({(b, a) for a, b in got} if swapped else got) and len(want) > 5


def test_what_was_shuffled_for_a_written_table_is_freed(spark):
    def shuffled():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f and f.endswith(".data")}

    before = shuffled()
    written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before


def test_a_copy_never_points_at_a_copy(spark):
    words = [f"w{i}" for i in range(1700)]
    docs = [(1, 1, "media", words[:1000]), (2, 1, "media", words[300:1300]), (3, 1, "media", words[650:1650])]
    df = spark.createDataFrame([(i, c, k, " ".join(w)) for i, c, k, w in docs], "source_id long, case_id long, source_type string, text string").withColumn("content_type", F.lit("text/html"))
    assert [(r.source_id, r.near_duplicate_of) for r in D.near_duplicates(D.shingle_sets(df)).collect()] == [(2, 1)]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    docs = []
    for i in range(40):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 90]))] if i % 4 == 0 else docs[-1][3].split()[rng.randint(0, 9):] + [f"x{i}"]
        docs.append((i, i % 2 // 2, "media", " ".join(w)))
    df = spark.createDataFrame(docs, "source_id long, case_id long, source_type string, text string").withColumn("content_type", F.lit("text/html"))
    sets = D.shingle_sets(df).persist()
    sh = {r.source_id: set(r.sh) for r in sets.collect()}
    pairs = [(a, b, len(sh[a] & sh[b])) for a in sh for b in sh if a < b and sh[a] & sh[b]]
    for limit in (0.2, 0.7):
        assert {(r.source_id, r.other_id) for r in D.similar_pairs(sets, limit, "jaccard").collect()} == {(a, b) for a, b, c in pairs if c / len(sh[a] | sh[b]) >= limit}
        assert {(r.source_id, r.other_id) for r in D.similar_pairs(sets, limit).collect()} == {(a, b) for a, b, c in pairs if c / min(len(sh[a]), len(sh[b])) >= limit}


def test_exact_copies_point_at_the_earliest_readable_source(spark):
    df = spark.createDataFrame(
        [(1, 1, "h", "failed", "t"), (2, 1, "h", "ok", "t"), (3, 2, "h", "ok", "t"), (4, 1, None, "ok", "t"), (5, 1, "h", "ok", "t"), (6, 1, "e", "ok", ""), (7, 1, "e", "ok", " ")],
        "source_id long, case_id long, content_hash string, fetch_status string, text string")
    assert {r.source_id: r.duplicate_of for r in D.exact_duplicates(df).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 2, 6: None, 7: None}


def test_reflow(spark):
    text = "first line\nsecond line\n\nnew block\n" + "\n".join(["word " * 20 + "end."] * 5)
    rows = J.reflow_lines(spark.createDataFrame([(1, text)], "source_id long, text string")).orderBy("para").collect()
    assert rows[0].paragraph == "first line second line"
    assert rows[1].paragraph.startswith("new block word") and len(rows) == 3


def test_packets_respect_both_limits(spark):
    fields = spark.createDataFrame([(1, "s", i, f"V{i}", i) for i in range(30)], "case_id long, section string, pos long, name string, query_id long")
    hits = spark.createDataFrame([(i, k, f"S{i // 4}-P{k}") for i in range(30) for k in range(8)], "query_id long, rank int, passage_id string")
    rows = sorted(R.evidence_packets(hits, fields).collect(), key=lambda r: r.batch)
    assert [v for r in rows for v in r.variables] == [f"V{i}" for i in range(30)]
    assert all(len(r.variables) <= 12 and len(r.passage_ids) <= 40 == len(set(r.passage_ids)) or len(r.passage_ids) <= 40 for r in rows)
    assert len(rows) == 3


def test_search_budget_admits_three_queries(spark):
    calls = spark.createDataFrame([(1, i, "tavily", 0.016) for i in range(5)], "case_id long, id long, provider string, worst_cost double")
    rows = O.budget_admission(calls, cap=0.05).orderBy("id").collect()
    assert [r.reason for r in rows] == [None, None, None, "case budget", "case budget"]


def test_a_request_that_does_not_fit_does_not_stop_the_next(spark):
    calls = spark.createDataFrame([(1, 1, "x", 3.0), (1, 2, "x", 9.0), (1, 3, "x", 1.0), (2, 4, "openai", 3.5)], "case_id long, id long, provider string, worst_cost double")
    assert [r.reason for r in O.budget_admission(calls).orderBy("id").collect()] == [None, "case budget", None, "provider budget"]


def test_full_rank_equals_a_plain_row_number(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("a"), (F.col("id") * 13 % 17).alias("b"))
    got = {r.id: r.rank for r in K.full_rank(df, ["g"], [("c", F.col("a"))], [F.col("b"), F.col("id")], "rank").collect()}
    want = {}
    for g in range(3):
        rows = sorted((r for r in df.collect() if r.g == g), key=lambda r: (r.a, r.b, r.id))
        want.update({r.id: n for n, r in enumerate(rows, 1)})
    assert got == want


def test_page_ranges(spark):
    df = spark.createDataFrame([(1, n) for n in (1, 2, 3, 7, 9, 10)] + [(2, 5)], "k long, n long")
    assert {r.k: r.ranges for r in J.page_ranges(df, "k", "n").collect()} == {1: "1-3, 7, 9-10", 2: "5"}


def test_lsa_vectors_are_unit_and_close_for_like_texts(spark):
    pytest.importorskip("numpy")
    rows = [(f"p{i}", t) for i, t in enumerate(["flood water river bridge"] * 3 + ["fire smoke forest wind"] * 3 + ["flood river fire smoke"])]
    vectors = {r.passage_id: r.vector for r in R.lsa_vectors(spark.createDataFrame(rows, "passage_id string, text string"), 2).collect()}
    assert len(vectors) == 7
    dot = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    assert all(abs(dot(p, p) - 1) < 1e-6 for p in vectors)
    assert dot("p0", "p1") > 0.99 and dot("p0", "p3") < dot("p0", "p6")


def test_pairs_of_classes_lose_no_link_and_stay_linear_in_a_group_of_copies(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(90)) for _ in range(12)]
    texts += [t + f" x{k} y{k}" for k, t in enumerate(texts[:4])] + [t.rsplit(" ", 40)[0] for t in texts[:6]] + ["short", None]
    docs = [(i, i % 2 + 1, rng.choice(["media", "aar"]), texts[0] if i % 3 == 0 else rng.choice(texts)) for i in range(120)] + [(900, None, "media", texts[0])]
    df = spark.createDataFrame(docs, "source_id long, case_id long, source_type string, text string").withColumn("content_type", F.lit("text/html"))
    sets = D.shingle_sets(df).persist()
    rows = {r.source_id: (r.case_id, frozenset(r.sh or [])) for r in sets.collect()}
    members = {r.source_id: (r.first_id, r.class_size) for r in D.shingle_classes(sets)[1].collect()}
    assert set(members) == {i for i, (c, s) in rows.items() if s and c is not None}
    for i, (first, size) in members.items():
        alike = [j for j in members if rows[j] == rows[i]]
        assert (first, size) == (min(alike), len(alike))
    share = {"jaccard": lambda a, b: len(a & b) / len(a | b), "containment": lambda a, b: len(a & b) / min(len(a), len(b))}
    for by, rate in share.items():
        for limit in (0.3, 0.8):
            want = {(a, b) for a in members for b in members if a < b and rows[a][0] == rows[b][0] and rate(rows[a][1], rows[b][1]) >= limit}
            found = D.similar_class_pairs(sets, limit, by).collect()
            of = lambda first: [i for i in members if members[i][0] == first]
            got = {tuple(sorted((a, b))) for r in found for a in of(r.source_id) for b in of(r.other_id)}
            assert all(r.links == len(of(r.source_id)) * len(of(r.other_id)) for r in found)
            assert got | {(a, b) for a in members for b in members if a < b and members[a] == members[b]} == want and len(found) < 80 < len(want)
    near = {r.source_id: (r.near_duplicate_of, r.similarity) for r in D.near_duplicates(sets).collect()}
    assert near == brute_near([d for d in docs if d[0] in members])


def test_pairs_of_classes_with_their_members_give_every_pair(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(5)]
    texts = [rng.choice(base + [b.rsplit(" ", 30)[0] for b in base]) for _ in range(60)] + ["short"]
    df = spark.createDataFrame([(i, i % 2, "media", t) for i, t in enumerate(texts)], "source_id long, case_id long, source_type string, text string").withColumn("content_type", F.lit("text/html"))
    sets = D.shingle_sets(df).persist()
    for by in ("jaccard", "containment"):
        rows = D.similar_classes(sets, 0.2, by).collect()
        of = {}
        for r in rows:
            if r.kind == "member":
                of.setdefault(r.source_id, {r.source_id}).add(r.other_id)
        of = lambda i, groups=of: groups.get(i, {i})
        pairs = [(a, b) for r in rows if r.kind == "classes" for a in of(r.source_id) for b in of(r.other_id)]
        pairs += [(a, b) for first in {r.source_id for r in rows if r.kind == "member"} for a in of(first) for b in of(first) if a < b]
        want = {(r.source_id, r.other_id) for r in D.similar_pairs(sets, 0.2, by).collect()}
        assert {tuple(sorted(p)) for p in pairs} == want and len(pairs) == len(want) and any(r.kind == "member" for r in rows)


def test_pages_are_read_few_at_a_time(spark):
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("https://news.example.com/a/b").alias("url"), F.when(F.col("id") != 5, HTML).alias("html")).coalesce(1)
    sizes = P.read_pages(pages).mapInArrow(lambda batches: batches, P.PAGE_SCHEMA)
    assert sizes.count() == 1000 and P.html_links(pages).count() == 999
    seen = []

    class Frame:
        select = lambda self, *names: self
        mapInArrow = lambda self, parse, schema: seen.append(parse)

    P.read_pages(Frame())
    made = list(seen[0](iter(pages.toArrow().combine_chunks().to_batches())))
    assert sum(b.num_rows for b in made) == 1000 and max(b.num_rows for b in made) <= P.PAGES_AT_ONCE


def test_a_passage_is_searched_for_advertising_once(spark):
    from attesta.functions import text as X

    plan = spark.range(1).select(X.is_boilerplate(F.lit("Read more").substr(F.lit(1), F.col("id").cast("int") + 9)).alias("b"))
    assert plan.first().b
    texts = spark.createDataFrame([("Read more",), ("x" * 200 + " Read more",), ("x" * 200 + " Read more. Read more",), ("plain",), (None,)], "t string")
    assert [r.b for r in texts.select(X.is_boilerplate(F.col("t")).alias("b")).collect()] == [True, False, True, False, None]
    from attesta.operators.passages import _strip
    shown = texts.select(_strip(F.col("t")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in shown
    odd = spark.createDataFrame([(" a b \n",), ("　a",), ("a\t",), ("",), (" ",), ("a b",)], "t string")
    assert [r.s for r in odd.select(_strip(F.col("t")).alias("s")).collect()] == ["a b", "a", "a", "", "", "a b"]


def test_overlaps_of_classes_are_counted_with_frequent_shingles(spark, monkeypatch):
    import random

    from attesta.operators import dedup

    monkeypatch.setattr(dedup, "SELDOM", 3)
    rng = random.Random(4)
    rows = []
    for i in range(90):
        own = set(rng.sample(range(12), rng.randint(1, 9))) | {100 + rng.randrange(60) for _ in range(rng.choice([0, 3, 20]))}
        rows.append((i % 2, i, sorted(own), len(own)))
    sets = spark.createDataFrame(rows, "case_id long, source_id long, sh array<long>, n int")
    for limit in (0.2, 0.6, 1.0):
        got = {(r.source_id, r.other_id): (r.na, r.nb, r.common) for r in dedup._counted_pairs(sets, limit).where(f"containment >= {limit}").collect()}
        want = {}
        for c, i, a, n in rows:
            for d, j, b, m in rows:
                common = len(set(a) & set(b))
                if c == d and i < j and common / min(n, m) >= limit:
                    want[i, j] = (n, m, common)
        assert got == want and want
