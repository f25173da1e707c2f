import hashlib
import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import gru, lm_scoring, toxicity
from attesta.llm.batches import prefix_hash
from attesta.llm.components import components
from attesta.llm.count_tree import CountTree, bound_holds, points
from attesta.llm.ngram_join import alike_once, linked_members, marked_buckets, ngram_join, partners_by_size, shared_buckets
from attesta.llm.substring_dedup import substring_dedup, suffix_mergesort


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def want_components(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def changed(words, share, rng):
    return [rng.choice("pqrstuv") * 3 if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    passage, rows = [word() for _ in range(40)], []
    for g in range(25):
        base = [word() for _ in range(rng.randint(3, 200))]
        if g % 4 == 0:
            base[1:1] = passage
        for _ in range(rng.randint(1, 8)):
            rows.append(" ".join(changed(base, rng.choice([0, 0.01, 0.03, 0.05, 0.08]), rng)))
    chain = [word() for _ in range(150)]
    for _ in range(12):  # neighbours are near, ends are not
        rows.append(" ".join(chain))
        at = rng.randrange(140)
        chain[at: at + 4] = [word() for _ in range(4)]
    rows += ["A b C", "a B c", "a b c d", "", "  ", "one two three four five", "One two three four five"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1)) + [(1000, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(documents, small_batches, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(documents(rows)).collect()}
    assert got == want_components(rows)


def test_buckets_keep_their_centre_across_batches(spark, documents, small_batches):
    rng = random.Random(6)
    entries = [(key, rng.randint(-999, 999)) for key in range(80) for _ in range(2 if key % 9 else rng.randint(1, 30))]
    of = {}
    for key, name in entries:
        of.setdefault(key, set()).add(name)
    want = sorted((key, name, min(names)) for key, names in of.items() if len(names) > 1 for name in names)
    got = shared_buckets(spark.createDataFrame(entries, "key long, class long").repartition(1)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_most_buckets_of_two_are_told_and_no_others(spark, small_batches):
    rng = random.Random(7)
    entries = [(key, name) for key in range(300) for name in rng.sample(range(99), rng.choice([1, 2, 2, 3, 9]))]
    sizes = Counter(key for key, _ in entries)
    got = marked_buckets(spark.createDataFrame(entries, "key long, class long").repartition(1)).collect()
    told = {r.key for r in got if r.two}
    assert {sizes[k] for k in told} == {2} and len(told) > 0.5 * sum(n == 2 for n in sizes.values())
    assert all(not r.two for r in got if r.key not in told)


def test_ngram_join_of_pairs_that_meet_in_few_buckets(documents, small_batches):
    rows = []
    for i in range(80):  # six of seven n-grams are shared, and two n-grams of a set make buckets
        words = [f"w{i}x{j}" for j in range(11)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:10], "other"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(documents(rows)).collect()}
    assert got == {i: (7, i - i % 2) for i, _ in rows}


def test_ngram_join_of_near_copies_at_the_edge(documents, small_batches, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = list(enumerate((" ".join(changed(base, 0.035, rng)) for _ in range(70)), 1))  # many pairs on both sides of the limit
    monkeypatch.setattr("attesta.llm.ngram_join.BLOCK", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(documents(rows)).collect()}
    assert got == want_components(rows)


@pytest.mark.parametrize("blocks", [1, 2])
def test_links_of_a_bucket_are_a_forest_over_its_components(blocks):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(85, 120), replace=False), rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(90)]
    names, roots, block = np.arange(90) * 7 - 300, np.arange(90) // 2, np.arange(90) % blocks
    links = linked_members(names, roots, block, [x.tobytes() for x in sets], 75)

    def groups(pairs):
        label = list(roots)
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return sorted(sorted(i for i in range(90) if label[i] == x) for x in set(label)), len(set(label))

    want = [(i, j) for i in range(90) for j in range(i) if block[i] != block[j] or blocks == 1]
    want = [(i, j) for i, j in want for both in [len(np.intersect1d(sets[i], sets[j]))] if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)]
    got, left = groups([((a + 300) // 7, (b + 300) // 7) for a, b in links])
    assert got == groups(want)[0] and len(links) == 45 - left and all(a < b for a, b in links)


def test_members_of_a_bucket_without_a_partner_of_their_size_stay_behind(spark, small_batches):
    rng = random.Random(8)
    rows = [(k, 0, 0, i, rng.randint(1, 4), 0, rng.randint(5, 60)) for k in range(30) for i in range(rng.randint(1, 12))]
    rows += [(99, 0, 1, i, i, i % 2, 20 if i < 8 else 21 + 9 * (i - 7)) for i in range(14)]
    frame = spark.createDataFrame(rows, "key long, low int, high int, class long, root long, block int, size long")
    fits = lambda a, b: a[:3] == b[:3] and a[4] != b[4] and (a[1] == a[2] or a[5] != b[5]) and 100 * min(a[6], b[6]) >= 75 * max(a[6], b[6])
    want = sorted(r for r in rows if any(fits(r, o) for o in rows))
    got = frame.repartition(1).sortWithinPartitions("key", "low", "high").mapInArrow(partners_by_size(75), frame.schema).collect()
    assert sorted(tuple(r) for r in got) == want and len(want) < len(rows)


def test_blocks_of_the_same_members_are_compared_once(spark):
    blocks = {(5, 0, 0): {1: 0, 2: 0}, (7, 0, 0): {1: 0, 2: 0}, (8, 0, 0): {1: 0, 3: 0}, (9, 0, 1): {1: 0, 2: 1}, (11, 0, 2): {1: 0, 2: 2}, (12, 0, 1): {1: 0, 2: 1, 3: 1}}
    rows = [(*name, c, c, b) for name, members in blocks.items() for c, b in members.items()]
    left = spark.createDataFrame(rows, "key long, low int, high int, class long, root long, block int")
    got = {r.key for r in alike_once(left).collect()}
    assert got == {5, 8, 9, 12}


def test_ngram_join_of_odd_rows(documents):
    assert ngram_join(documents([])).count() == 0
    got = ngram_join(documents([(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "x " * 30000), (4, None), (None, "z")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([
        ("None", 1, "2"), ("2", 1, "2"), ("2", 1, "2"), ("3", 1, "3"), ("4", 0, "4"), ("None", 1, "None")])


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 300), replace=False), rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    raw = points(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    tree = CountTree(sizes, raw, 75)
    found = {frozenset((int(tree.order[i]), int(tree.order[j]))) for i in range(60) for j in tree.partners(i)}
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
                assert frozenset((i, j)) in found and bound_holds(raw[i], sizes[i], raw[j], sizes[j], 75)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 130)] + [(7, 7), (3, 2)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def want_cut(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            part = data[s: s + length]
            if part in seen:
                gone[s: s + length] = b"\1" * length
            seen.add(part)
        rest = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for j in range(len(data)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(documents, small_batches):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd e") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(90):
        text = "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 4)):
            passage, at = rng.choice(base), rng.randint(0, 300)
            text += passage[at: at + rng.randint(50, 300)] + rng.choice(["", "x", "yy" * 40, "é" * 60])
        rows.append((i * 7, text))
    rows += [(9999, "a" * 500), (10001, "a" * 350), (10003, "ab" * 200), (10005, None), (10007, ""), (10009, base[0]), (10011, base[0])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup(documents(rows)).collect()}
    assert got == want_cut(rows, 100)


def test_substring_dedup_of_odd_rows(documents):
    assert substring_dedup(documents([])).count() == 0
    got = substring_dedup(documents([(None, "a" * 99 + "b" * 50), (1, "c" * 99), (1, "c" * 99), (5, None)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 0), ("5", 0), ("None", 0)]


def test_suffix_mergesort_sorts_segments():
    rng = random.Random(5)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(600)).encode(), np.uint8)
    starts = np.array([rng.randrange(500) for _ in range(80)])
    segment = np.sort(np.array([rng.randrange(6) for _ in range(80)]))
    order = suffix_mergesort(data, prefix_hash(data), starts, segment, 100)
    assert (segment[order] == segment).all()
    texts = [(g, data[s: s + 100].tobytes()) for g, s in zip(segment, starts[order])]
    assert texts == sorted(texts)


def test_language_model_base_and_probability(documents):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat,", "É", "dog.", "42", "mat", "rareword%d" % i]) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(500, None), (501, "x " * 5000), (7001, "The THE")]
    frame = documents(rows).select("doc_id", "text")
    model, counts = lm_scoring.fit(frame, table_words=4, one_in=2)
    got = {r.doc_id: r for r in lm_scoring.score(frame, model, counts).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    c = Counter(w for i in words if not held(i) for w in words[i])
    texts = sum(not held(i) for i in words)
    total, types = sum(c.values()) + texts, len(c) + 1
    for i, own in words.items():
        r = got[i]
        base = sum(math.log10((c[w] + 1) / (total + types + 1)) for w in own) + math.log10((texts + 1) / (total + types + 1))
        assert r.n_tokens == len(own) + 1 and r.n_known == sum(w in c for w in own) + 1 and r.train_tokens == total
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    out = [got[i] for i in words if held(i)]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # classes add up to one with what is left for one unseen word in each
    assert abs(sum(10.0 ** (np.log10(n + 1) - d) for n, d in zip(model.class_counts, model.log_class)) - 0) > 0
    w = gru.unpack(model.weights, lm_scoring.CLASSES)
    assert np.allclose(np.exp(gru.log_softmax(w, np.zeros((1, 1, gru.HIDDEN), np.float32))).sum(), 1, atol=1e-4)


def test_network_learns_from_every_training_text(documents, monkeypatch):
    seen = []
    monkeypatch.setattr(lm_scoring, "train_network", lambda texts, model, rounds: seen.extend(r.text for r in texts.collect()))
    lm_scoring.fit(documents([(i, f"text {i}") for i in range(100)]).select("doc_id", "text"))
    assert sorted(seen) == sorted(f"text {i}" for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)


def test_language_model_of_nothing(documents):
    frame = documents([]).select("doc_id", "text")
    model, counts = lm_scoring.fit(frame)
    assert lm_scoring.score(frame, model, counts).count() == 0
    one = documents([(None, None), (3, "a b")]).select("doc_id", "text")
    assert [r.n_known for r in lm_scoring.score(one, model, counts).collect()] == [0, 0]


def test_gradients_are_right():
    rng = np.random.default_rng(2)
    classes, steps, texts = 5, 6, 3
    vector = gru.start(np.arange(1.0, 6.0)).astype(np.float64)
    inputs, wanted = rng.integers(0, classes, (steps, texts)), rng.integers(0, classes, (steps, texts))
    real = np.ones((steps, texts), bool)
    state = rng.normal(size=(texts, gru.HIDDEN))
    loss = lambda v: -gru.gradient(gru.unpack(v, classes), inputs, wanted, real, state)[2] / real.sum()
    got = gru.gradient(gru.unpack(vector, classes), inputs, wanted, real, state)[0]
    for i in rng.integers(0, len(vector), 25):
        step = np.zeros_like(vector)
        step[i] = 1e-3
        assert abs((loss(vector + step) - loss(vector - step)) / 2e-3 - got[i]) < 2e-3


def test_a_step_looks_up_its_inputs_once_a_window():
    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return np.asarray(super().__getitem__(at))

    w = gru.unpack(gru.start(np.ones(4)), 4)
    w["inputs"] = w["inputs"].view(Counted)
    gru.forward(w, np.zeros((20, 3), np.uint8), np.zeros((3, gru.HIDDEN), np.float32))
    assert Counted.reads <= 1


def test_state_is_carried_across_windows():
    vector = gru.start(np.ones(4))
    text = np.array([1, 2, 3] * 40 + [0], np.uint8)
    whole = gru.score(vector, 4, [text])[0]
    w, state, total, before = gru.unpack(vector, 4), np.zeros((1, gru.HIDDEN), np.float32), 0.0, 0
    for c in text:
        states, state, _ = gru.forward(w, np.array([[before]]), state)
        total += float(gru.log_softmax(w, states)[0, c]) / math.log(10)
        before = c
    assert abs(whole - total) < 1e-3


def toxic_rows(n, rng):
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = ["".join(rng.choice("klmnop") for _ in range(4)) for _ in range(rng.randint(5, 40))]
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Zorrible,", "zorrid", "vilex"]) + rng.choice(["", "!", "ster"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, documents):
    rng = random.Random(8)
    rows, labels = toxic_rows(400, rng)
    rows += [(1000, None), (1001, ""), (1002, "klmn " * 20000)]
    docs = documents(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == y for i, y in labels if i in set(held)]) > 0.95
    assert got[1000].score == got[1001].score and got[1000].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert len(got) == len(rows)


def test_block_max_search_is_exact(spark, documents):
    rng = random.Random(9)
    rows, labels = toxic_rows(300, rng)
    model = toxicity.fit(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    dense = np.concatenate([b.T for b in model.blocks])
    bounds, place, weight = model.example_vectors()
    best, close = model.search(bounds, place, weight)
    for i in range(0, len(dense), 7):
        own = slice(bounds[i], bounds[i + 1])
        every = dense[:, place[own]] @ weight[own]
        want = np.sort(every[every > 0])[::-1][: model.k]
        assert np.allclose(close[i][: len(want)], want, atol=2e-5) and (best[i] >= 0).sum() == len(want)


def test_toxicity_cosines_are_of_all_terms(spark, documents):
    rng = random.Random(10)
    rows, labels = toxic_rows(120, rng)
    model = toxicity.fit(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def terms(text):
        words = [w.strip(".,;:!?") for w in text.lower().split()]
        return Counter(words) + Counter((n, w[:n]) for w in words for n in range(3, 9) if len(w) > n)

    training = {i: terms(t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    docs = Counter(t for c in training.values() for t in c)

    def vector(found):
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(training)) / (1 + docs[t])) + 1) for t, n in found.items() if t in docs}
        return {t: w / math.sqrt(sum(x * x for x in raw.values())) for t, w in raw.items()}

    examples = [vector(c) for c in training.values()]
    for r in toxicity.score(documents(rows), model).collect():
        own = vector(terms(r.text))
        want = sorted((sum(w * e.get(t, 0) for t, w in own.items()) for e in examples), reverse=True)[:3]
        assert np.allclose(r.cosines, want, atol=2e-5)


def test_toxicity_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents([(1, "a")]), none)
    assert [r.predicted for r in toxicity.score(documents([(1, "a"), (1, "a"), (None, None)]), model).collect()] == [0, 0, 0]
    assert toxicity.score(documents([]), model).count() == 0


class Batches:
    """Stands for a table and takes the function that would run on it in tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.run = function
        return self

    def groupBy(self, *columns):
        return self

    def agg(self, *columns):
        return self


def peak_of(call):
    tracemalloc.start()
    out = call()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def many_terms(n):
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrst"))
    return [" ".join("".join(letters[rng.integers(0, 20, 9)]) for _ in range(300)) for _ in range(n)]


def test_term_counts_of_a_large_batch_take_bounded_memory(spark):
    words, rng = many_terms(5)[0].split(), random.Random(12)
    texts, table = [" ".join(rng.choices(words, k=300)) for _ in range(1000)], Batches()  # 3 MB
    toxicity.term_counts(table)
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    list(table.run(iter([batch.slice(0, 1)])))  # tables that are made once
    parts, peak = peak_of(lambda: list(table.run(iter([batch]))))
    assert peak < 60e6
    docs, want = Counter(), Counter()
    for p in parts:
        docs.update(dict(zip(p["term"].to_pylist(), p["docs"].to_pylist())))
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        want.update(set(toxicity._terms(data, np.array([0, len(data)]))[1].tolist()))
    assert docs == want and len(parts) <= 2


def test_examples_are_taken_out_of_the_index_one_by_one():
    texts, n = many_terms(600), 600
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    terms = np.unique(np.concatenate([toxicity._terms(data[s:e], np.array([0, e - s]))[1] for s, e in zip(at[:-1], at[1:])]))
    model = toxicity.Model(terms, np.ones(len(terms), np.float32), 0.1, 15, 0.5)
    run = toxicity._index_of(model)
    states, _ = peak_of(lambda: list(run(iter([pa.record_batch([pa.array(np.arange(n)), pa.array(np.arange(n) % 2), pa.array(texts)], names=["doc_id", "toxic", "text"])]))))
    model = pickle.loads(states[0]["state"][0].as_py())
    bounds, place, weight = model.example_vectors()
    own = np.array([17, 3, 599])
    (got_bounds, got_place, got_weight), peak = peak_of(lambda: model.example_vectors(own))
    assert got_place.tolist() == np.concatenate([place[bounds[i]: bounds[i + 1]] for i in own]).tolist()
    assert got_weight.tolist() == np.concatenate([weight[bounds[i]: bounds[i + 1]] for i in own]).tolist()
    assert np.diff(got_bounds).tolist() == np.diff(bounds)[own].tolist() and peak < 30 * len(model.example)


def test_classes_of_texts_are_found_once_for_all_rounds(spark, documents, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), lm_scoring._class_texts

    def counted(model, column):
        seen.add(len(column))
        return plain(model, column)

    monkeypatch.setattr(lm_scoring, "_class_texts", counted)
    texts = documents([(i, f"text {i % 5} again.") for i in range(60)]).select("text")
    model = lm_scoring.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.ones(lm_scoring.CLASSES), np.ones(lm_scoring.CLASSES), 100, 10, 60)
    before = model.weights.copy()
    after = lm_scoring.train_network(texts, model, 3)
    assert seen.value == 60 and after.shape == before.shape and (after != before).any()


def test_a_window_ends_with_its_texts():
    rng = np.random.default_rng(3)
    vector = gru.start(np.ones(6))
    texts = [rng.integers(1, 6, n).astype(np.uint8) for n in (70, 33, 32, 1, 5)]
    alone = [gru.score(vector, 6, [t])[0] for t in texts]
    assert np.allclose(gru.score(vector, 6, [*texts, np.zeros(0, np.uint8)]), [*alone, 0], atol=1e-4)
    w, state, total = gru.unpack(vector, 6), np.zeros((1, gru.HIDDEN), np.float32), 0.0
    for c, before in zip(texts[0], [0, *texts[0][:-1]]):
        _, state, found = gru.gradient(w, np.array([[before]]), np.array([[c]]), np.ones((1, 1), bool), state)
        total += found
    assert abs(total / math.log(10) - alone[0]) < 1e-3
