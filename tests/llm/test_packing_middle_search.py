import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm.fill_middle import fill_in_middle, restored
from attesta.llm.packing import DEFAULT_TOKENIZER, best_fit, crc32_of, pack, place, sequences
from attesta.llm.ranked_search import ranked_search, share_sums, term_ranges

ODD = [None, "", " \n", "a", "Straße ΟΔΟΣ Σ. don't 12345", "éa ́ x y z", "<|endoftext|> it's <|startoftext|>", "\U0001F600\U0001F600 ok", "ß" * 300, "x" * 9000]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(DEFAULT_TOKENIZER)
    tokenizer.encode_special_tokens = True
    return tokenizer


def want_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_are_the_whole_text_ids_and_sequences_hold_them(documents, small_batches, whole):
    random.seed(5)
    words = ["the", "Cat's", "über", "12", "--", "naïve,", "a\x85b", "日本語"]
    texts = ODD + [" ".join(random.choice(words) for _ in range(random.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "no id")]
    packed = pack(documents(rows), capacity=64)
    got = packed.collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids = want_ids(whole, text)
        copies = 2 if i == 3 else 1
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in mine] == sorted(
            [(k, 64 * k, len(ids[64 * k: 64 * k + 64]), crc32_of(ids[64 * k: 64 * k + 64])) for k in range(-(-len(ids) // 64))] * copies)
        if copies == 1:
            assert b"".join(bytes(r.ids) for r in mine) == np.asarray(ids, "<u4").tobytes()
    made = check_packing(got, 64)
    at_once = best_fit(sorted((r.length for r in got), reverse=True), 64)[2]
    assert made <= 1.03 * len(at_once)
    filled = {r.sequence_id: r for r in sequences(packed).collect()}
    assert sum(len(r.ids) for r in filled.values()) == 4 * sum(r.length for r in got) and all(len(r.ids) == 4 * r.length for r in filled.values())


def test_best_fit_takes_the_tightest_bin():
    chosen, offsets, fill = best_fit([6, 7, 3, 4, 10], 10)
    assert (chosen, offsets, fill) == ([0, 1, 1, 0, 2], [0, 0, 7, 6, 0], [10, 10, 10])


@pytest.mark.parametrize("lengths", [[33] * 500, [1] * 640, [40, 24] * 100, list(range(1, 65)) * 5, [64], []])
def test_levels_merge_what_partitions_leave(spark, lengths, monkeypatch):
    monkeypatch.setattr("attesta.llm.packing.FAN_IN", 2)
    monkeypatch.setattr("attesta.llm.packing.NODE_ITEMS", 40)
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long").repartition(9, "item")
    got = place(frame, capacity=64).collect()
    assert sorted((r.item, r.length) for r in got) == list(enumerate(lengths))
    made = check_packing(got, 64)
    least = 500 if lengths[:1] == [33] else math.ceil(sum(lengths) / 64)
    assert least <= made <= least * 1.1 + 1


def test_packing_of_nothing(documents):
    assert pack(documents([])).count() == 0


def want_middle(i, text):
    text = text or ""
    n, hexed = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexed[8 * k: 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, text)
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}")
    return (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_in_middle_equals_slicing(documents):
    random.seed(6)
    alphabet = ["a", "\n", "\r\n", "é", "é", "\U0001F600", "<", "P>", "$1", "\\", "\x85", " ", "S>", "日"]
    texts = [None, "", "<P>", "x<M>y", "\n", "\U0001F600", "a" * 300000, "\U0001F600\n" * 30000] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (9, "same"), (9, "same")]
    got = fill_in_middle(documents(rows)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, *want_middle(i, t), t or "") for i, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(documents([])).count() == 0


def test_fill_in_middle_cuts_between_units(documents):
    rows = [(i, "one two  three\nfour five") for i in range(50)]
    for r in fill_in_middle(documents(rows), percent=100, suffix_first_percent=0, unit=r"\S+\s*").collect():
        assert r.n == 5 and re.fullmatch(r"<P>((?:\S+\s*)*)<S>((?:\S+\s*)*)<M>((?:\S+\s*)*)", r.output)
        pre, suf, mid = re.fullmatch(r"(?s)<P>(.*)<S>(.*)<M>(.*)", r.output).groups()
        assert pre + mid + suf == "one two  three\nfour five" and (len(pre), len(mid)) == (r.prefix_chars, r.middle_chars)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def want_search(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(term for _, c in held for term in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0))
        out += [(item, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("entries", [1 << 16, 60])
def test_search_equals_brute_force(spark, documents, small_batches, entries):
    random.seed(7)
    words = ["Alpha", "beta", "γάμμα", "delta_5", "x1", "İi", "a.b", "日本", "end", "the", "THE", "\u0085mid"] + [f"w{i}" for i in range(40)]
    say = lambda top: " ".join(random.choice(words[: random.randint(1, len(words))]) for _ in range(random.randint(0, top)))
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "?!"), (4, "same text"), (4, "same text"), (5, "long " * 20000)] + [(10 + i, say(60)) for i in range(300)]
    items = [(i, say(25)) for i in range(40)] + [(100, None), (101, "—"), (7, "alpha alpha beta"), (7, "alpha alpha beta"), (None, "beta"), (8, "absent")]
    asked = spark.createDataFrame([(i, t, 5, "s") for i, t in items], "item_id long, text string, score long, slot string")
    got = ranked_search(documents(docs), asked, k=5, block_entries=entries).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == want_search(docs, items, 5)


def test_search_of_empty_tables(spark, documents):
    asked = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked_search(documents([]), asked).count() == 0
    assert ranked_search(documents([(1, None)]), asked).count() == 0
    assert ranked_search(documents([(1, "alpha")]), asked.where("false")).count() == 0


def test_shared_sums_give_every_item_its_terms_once():
    random.seed(8)
    base = [random.sample(range(300), 30) for _ in range(5)]
    items = [np.array(sorted(set(random.choice(base)[:random.randint(5, 30)]) | set(random.sample(range(300), 5)))) for _ in range(60)]
    nodes, roots = share_sums(items, 300)

    def terms(symbol):
        return [symbol] if symbol < 300 else [t for child in nodes[symbol - 300].tolist() for t in terms(child)]

    for item, root in zip(items, roots):
        assert sorted(t for child in root.tolist() for t in terms(child)) == item.tolist()
    assert all((children < 300 + i).all() for i, children in enumerate(nodes))
    below = Counter(child for children in [*nodes, *roots] for child in children.tolist())
    assert sum(len(c) for c in [*nodes, *roots]) < 0.7 * sum(map(len, items)) and all(below[300 + i] > 0 for i in range(len(nodes)))


def test_terms_end_at_text_ends():
    data = np.frombuffer("ab.cd".encode() + "ef é".encode(), np.uint8)
    start, end, row = term_ranges(data, np.array([0, 5, 5, 10]))
    assert list(zip(start.tolist(), end.tolist(), row.tolist())) == [(0, 2, 0), (3, 5, 0), (5, 7, 2), (8, 10, 2)]
