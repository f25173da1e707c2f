import base64
import gzip
import hashlib
import random
import tracemalloc

import pyarrow as pa
import sentencepiece

from attesta.llm import pieces, warc
from attesta.llm.quality import quality_rules
from attesta.llm.url_filters import filter_captures, intervals


def want_quality(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i: i + 3]), []).append(i)
    covered = {i + s for at in windows.values() if len(at) > 1 for i in at for s in range(3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_quality_equals_brute_force(documents):
    random.seed(5)
    rows = [(i, "".join(random.choice("ab \n#é") for _ in range(random.randint(0, 120))), random.choice(["x", "y", None])) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "a a a a a a"), (1003, "A a A a A a"), (1004, "lang " * 30000), (1005, "one\n\none\n one")]
    got = {r.doc_id: r for r in quality_rules(documents(rows)).collect()}
    for r in rows:
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want_quality(r[1]), r[0]
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.kept and g.base_failed)


def test_hosts_are_judged_by_shrunk_rates(documents):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(100)] + [(1000 + i, "short", "bad") for i in range(100)] + [(2000, good, "bad"), (2001, "short", "new"), (2002, good, "new")]
    got = {r.doc_id: r for r in quality_rules(documents(rows)).collect()}
    assert got[0].kept and not got[2000].kept and not got[2000].base_failed
    assert 0 < got[0].host_rate < got[2002].host_rate < got[2000].host_rate < 1


def test_quality_of_nothing(documents):
    assert quality_rules(documents([])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, row string, digest string")


def test_archives_round_trip(spark):
    rows = [(1, "http://a.b/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a.b/\r\nX: y", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\n"),
            (6, "u", "x" * 300000), (None, "u", "n"), (7, "u", "n"), (8, "u", "r"), (8, "u", "r")]
    got = warc.archive_round_trip(pages(spark, [(*r, "q", "d") for r in rows])).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    text = {r[0]: r[2] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(text[r.page_id].encode()), digest(text[r.page_id])), r.page_id
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", 2), ("2", "response", None), ("3", "revisit", 4), ("4", "response", None), ("5", "response", None), ("6", "response", None),
                            ("None", "revisit", 7), ("7", "response", None), ("8", "response", None), ("8", "revisit", 8)])


def test_archives_of_a_shuffled_frame_with_long_addresses(spark):
    rng = random.Random(3)
    rows = [(i, "http://h/" + "".join(rng.choice("abcdefgh0123") for _ in range(96_000 if i % 2 else 5)), f"<p>{i // 3}", "q", "d") for i in range(400)]
    plain = pages(spark, rows)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n, None) for n in names]
    try:
        for n, v in zip(names, ("40", "1m")):
            spark.conf.set(n, v)
        key = lambda df: sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in df.collect())
        got = key(warc.archive_round_trip(plain.repartition("page_id")))
        assert len(got) == 400 and got == key(warc.archive_round_trip(plain))
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_archives_of_nothing_and_small_payloads(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0
    got = warc.archive_round_trip(pages(spark, [(1, "u", "ab", "q", "d"), (2, "u", "ab", "q", "d")]), min_bytes=3).collect()
    assert {r.record_type for r in got} == {"response"}


def test_captures_are_nested(spark):
    path = warc.write_archives(pages(spark, [(1, "http://a.b/", "<p>", "q", "d")]))
    capture = warc.assemble(warc.read_records(spark, path)).first()
    assert capture.target == "http://a.b/" and bytes(capture.response.payload) == b"<p>" and capture.metadata.body == "pageId: 1\r\n" and capture.request.body.startswith("GET")


def test_gzip_members_are_read():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <%d>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    records = list(warc.parse(gzip.compress(one % 1) + gzip.compress(one % 2)))
    assert [r[0] for r in records] == ["<1>", "<2>"] and records[0][-1] == b"ab"


def test_url_filters_follow_time(spark):
    day = 86400
    entries = spark.createDataFrame([
        ("B.org", 10 * day, "block", "x"), ("b.org", 100 * day, "allow", "x"), ("a.b.org", 200 * day, "block", "y"), ("b.org/p", 5 * day, "block", "z"),
        (None, 1, "block", "x"), ("c.org", None, "block", "x"), ("b.org", 100 * day, "allow", "a")], "pattern string, listed_at long, action string, category string")
    captures = spark.createDataFrame([
        (1, "http://a.b.org/", 9 * day), (2, "http://a.b.org/", 10 * day), (3, "http://a.b.org/", 150 * day), (4, "https://u@A.B.org:80?x", 200 * day),
        (5, "http://b.org/p/q", 150 * day), (6, "nothing", 1), (7, None, 1), (8, "http://b.org/pq", 150 * day), (9, "http://b.org", None), (10, "http://c.org/", 5)],
        "page_id long, url string, fetched_at long")
    got = {r.page_id: (r.blocked, r.pattern) for r in filter_captures(captures, entries).collect()}
    assert got == {1: (False, None), 2: (True, "b.org"), 3: (False, "b.org"), 4: (True, "a.b.org"), 5: (True, "b.org/p"), 6: (False, None), 7: (False, None),
                   8: (False, "b.org"), 9: (False, None), 10: (False, None)}
    assert intervals(entries).count() == 4
    assert filter_captures(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in filter_captures(captures, entries.limit(0)).collect())


def test_url_filters_keep_the_case_of_paths(spark):
    entries = spark.createDataFrame([("B.org/Docs", 1, "block", "x")], "pattern string, listed_at long, action string, category string")
    captures = spark.createDataFrame([(1, "http://b.ORG/Docs/a", 5), (2, "http://b.org/docs/a", 5)], "page_id long, url string, fetched_at long")
    got = {r.page_id: (r.blocked, r.pattern) for r in filter_captures(captures, entries).collect()}
    assert got == {1: (True, "b.org/Docs"), 2: (False, None)}


def test_pieces_equal_the_library(documents, small):
    import pyarrow.parquet as pq

    vocabulary, library = pieces.Vocabulary(pieces.DEFAULT_MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    random.seed(3)
    texts = ["", None, " ", "  x\n y \t日本 ▁ a<s>b", " " * 37 + "x", "\x00é ﬁ ①\x00", "a" * 3000, "🙂🙂 a", "x   ", "▁▁"]
    texts += ["".join(random.choice("ab  ▁cdeéü日\n.thréing ") for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += pq.read_table(f"{small}/documents.parquet")["text"].to_pylist()
    ids, count, same = pieces.encode_column(vocabulary, pa.array(texts, pa.string()), pieces.Known())
    assert ids.to_pylist() == [library.encode(t or "") for t in texts]
    assert count.to_pylist() == [len(x) for x in ids.to_pylist()] and all(same.to_pylist())


def test_pieces_as_an_operator(documents):
    rows = [(1, "a b"), (2, None), (None, "x  y"), (1, "a b"), (3, "long text " * 20000)]
    out = pieces.encode(documents(rows))
    got = out.collect()
    assert len(got) == 5 and all(r.round_trip for r in got) and {len(r.ids) == r.n_ids for r in got} == {True}
    back = pieces.decode(out.select("doc_id", "ids")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.encode(documents([])).count() == 0


def test_encoding_new_words_takes_bounded_memory():
    vocabulary, rng = pieces.Vocabulary(pieces.DEFAULT_MODEL), random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    texts = pa.array([" ".join(word() for _ in range(300)) for _ in range(1200)])
    tracemalloc.start()
    ids, count, same = pieces.encode_column(vocabulary, texts, pieces.Known())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(same.to_pylist()) and sum(count.to_pylist()) == len(ids.flatten()) and peak < 150e6
