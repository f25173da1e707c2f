import hashlib
import random

from attesta.llm.exact_dedup import build_index, exact_dedup
from attesta.llm.mixing import mix

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")
ODD = [(1, "a b\tc"), (2, "abc"), (3, " a  b c "), (4, None), (5, ""), (6, " \n"), (7, "x" * 20000), (8, "x " * 20000), (9, " a"), (10, "  a")]


def want_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(BLANK), []).append((-len(t or ""), i))
    out = {}
    for plain, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(plain.encode()).hexdigest())
    return out


def test_exact_dedup_equals_brute_force(documents):
    random.seed(1)
    rows = ODD + [(100 + i, "".join(random.choice("ab \n") for _ in range(random.randint(0, 4)))) for i in range(200)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(documents(rows)).collect()}
    assert got == want_exact(rows)


def test_exact_dedup_splits_overfull_buckets(documents):
    rows = [(i, f"text {i}") for i in range(300)]
    index = build_index(documents(rows), bucket_entries=3).toPandas()
    assert len(index) == 300 and index.groupby("bucket").size().max() <= 3
    assert exact_dedup(documents(rows), bucket_entries=3).where("kept").count() == 300


def test_exact_dedup_of_nothing_nulls_and_repeats(documents):
    assert exact_dedup(documents([])).count() == 0
    got = exact_dedup(documents([(None, "a"), (1, "a"), (1, "a"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [
        ("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]


def test_exact_dedup_looks_up_by_bucket_at_any_depth(documents):
    rows = [(i, f"text {i % 400} " + " " * (i % 5)) for i in range(1200)]
    index = build_index(documents(rows), bucket_entries=2).toPandas()
    assert index["bucket"].nunique() > 100 and (index["chain"] == 0).all() and len(index) == 400
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(documents(rows), bucket_entries=2).collect()}
    assert got == want_exact(rows)


def test_of_rows_with_one_doc_id_the_longest_stays(documents):
    got = exact_dedup(documents([(1, "a"), (1, "a  "), (2, "a "), (None, "b"), (None, "b ")])).collect()
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in got) == [
        ("1", 3, False), ("1", 3, True), ("2", 3, False), ("None", 2, False), ("None", 2, True)]


def test_mix_meets_targets_and_reruns_agree(documents):
    random.seed(2)
    rows = [(i, "w " * random.randint(0, 30), random.choice(["a", "b", "b", "b", "c", None])) for i in range(600)]
    first = mix(documents(rows)).toPandas().sort_values("doc_id").reset_index(drop=True)
    again = mix(documents(rows, partitions=5)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert first.equals(again)
    source = {i: s for i, _, s in rows}
    first["source"] = [source[i] for i in first["doc_id"]]
    taken = first.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((taken["taken"] - taken["target"]).abs() <= 60).all()
    assert (first["taken"] <= 2 * first["size"]).all() and (taken["target"] <= 2 * taken["size"] + 1e-9).all()
    assert abs(taken["target"].sum() - 1.5 * first["size"].sum()) < 1e-6


def test_mix_of_odd_tables(documents):
    assert mix(documents([])).count() == 0
    got = mix(documents([(1, None, "a"), (2, "", None)])).collect()
    assert {(r.doc_id, r.size, r.taken, r.target) for r in got} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
    got = mix(documents([(1, "a b", "s"), (1, "a b", "s"), (None, "c " * 50000, "t")])).collect()
    assert len(got) == 3 and sum(r.taken for r in got) > 0
