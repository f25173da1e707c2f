"""Vector search by cells and latent semantics on tables, against plain numpy."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import latent
from attesta.operators import retrieval as R
from attesta.session import shared_base

VECTORS = "case_id long, vec_id long, embedding array<double>"
QUERIES = "query_id string, case_id long, embedding array<double>"


def test_cells_give_the_plain_ranking_with_fewer_comparisons(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 12))
    rows = [(1 if i % 3 == 0 else 2 + i % 4, i, (middles[i % 6] + 0.15 * rng.normal(size=12)).tolist()) for i in range(600)]
    rows += [(1, 1000 + i, rows[0][2]) for i in range(12)] + [(1, 2000, [0.0] * 12), (9, 2001, [1.0] + [0.0] * 11)]
    queries = [(f"q{i}", case, (middles[i % 6] + 0.1 * rng.normal(size=12)).tolist()) for i, case in enumerate([1, 1, 1, 2, 3, 4, 5, 1])]
    queries += [("same", 1, rows[0][2]), ("none", 77, [1.0] * 12), ("few", 9, [1.0] + [0.1] * 11), ("zero", 1, [0.0] * 12)]
    v, q = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(queries, QUERIES)
    found, compared = R.semantic_topk(v, q, ["vec_id"], 8)
    plain = R.top_k(R.semantic_scores(v, q), ["query_id"], [F.desc("semantic"), F.asc("vec_id")], 8)
    cells = ["query_id", "vec_id", "semantic", "rank"]
    assert sorted(map(tuple, found.select(cells).collect())) == sorted(map(tuple, plain.select(cells).collect()))
    sizes = Counter(case for case, *_ in rows)
    share = {r.query_id: r.compared / sizes[dict((i, c) for i, c, _ in queries)[r.query_id]] for r in compared.collect()}
    assert np.mean(list(share.values())) < 0.7 and max(share.values()) <= 1


def dense(tokens, k):
    """TF-IDF, SVD and unit rows of one case, as plain arrays."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for tk in tokens for t in tk}))}
    df = Counter(t for tk in tokens for t in set(tk))
    idf = {t: math.log((1 + len(tokens)) / (1 + df[t])) + 1 for t in vocabulary}

    def row(tk):
        x = np.zeros(len(vocabulary))
        for t, f in Counter(tk).items():
            if t in vocabulary:
                x[vocabulary[t]] = (1 + math.log(f)) * idf[t]
        return x / (np.linalg.norm(x) or 1)

    x = np.array([row(tk) for tk in tokens])
    basis = np.linalg.svd(x, full_matrices=False)[2][:k].T
    unit = lambda z: z / (np.linalg.norm(z, axis=-1, keepdims=True) + 1e-9)
    return unit(x @ basis), lambda tk: unit(row(tk) @ basis)


def test_latent_space_ranks_like_a_dense_decomposition(spark):
    random.seed(11)
    topics = [[f"topic{t}word{i}" for i in range(9)] for t in range(5)]
    passages = []
    for i in range(120):
        case, topic = 1 + i % 2, random.randrange(5)
        passages.append((case, f"P{i}", " ".join(random.choice(topics[topic] if random.random() < 0.8 else random.choice(topics)) for _ in range(random.randint(5, 30)))))
    passages += [(1, "empty", "??"), (3, "alone", "single passage here"), (4, "a", "river"), (4, "b", "river")]
    frame = spark.createDataFrame(passages, "case_id long, passage_id string, text string")
    model = R.lsa_model(frame, dimensions=4, iterations=25)
    asked = spark.createDataFrame([("q1", 1, "topic1word1 topic1word2 topic1word2"), ("q2", 2, "topic3word0 topic0word5 unknown"), ("q3", 2, "nothing known")], "query_id string, case_id long, query string")
    vectors = {(r.case_id, r.passage_id): np.array(r.embedding) for r in model.passages.collect()}
    queries = {r.query_id: (r.case_id, np.array(r.embedding)) for r in R.lsa_queries(model, asked).collect()}
    assert len(vectors) == len(passages) and set(queries) == {"q1", "q2"}
    assert not vectors[1, "empty"].any() and not vectors[3, "alone"].any()
    tokens = {r.passage_id: r.tk for r in frame.select("passage_id", X.tokenize(F.col("text")).alias("tk")).collect()}
    words = {r.query_id: r.tk for r in asked.select("query_id", X.tokenize(F.col("query")).alias("tk")).collect()}
    for query, (case, q) in queries.items():
        ids = [p for c, p, _ in passages if c == case]
        z, fold = dense([tokens[p] for p in ids], 4)
        want, got = z @ fold(words[query]), np.array([vectors[case, p] @ q for p in ids])
        assert np.abs(want - got).max() < 1e-3
        assert [ids[i] for i in np.argsort(-want)[:5]] == [ids[i] for i in np.argsort(-got)[:5]]


def test_latent_space_does_not_depend_on_blocks(spark, monkeypatch):
    random.seed(5)
    passages = [(1 + i % 2, f"P{i}", " ".join(f"w{random.randrange(40)}" for _ in range(12)) + f" only{i}") for i in range(60)] + [(1, "empty", "??")]
    frame = spark.createDataFrame(passages, "case_id long, passage_id string, text string")
    asked = spark.createDataFrame([(1, 1, "w1 w2 only4"), (2, 2, "w3 only7 only7")], "query_id long, case_id long, query string")

    def found():
        model = R.lsa_model(frame, dimensions=3, iterations=2)
        return {**{r.passage_id: r.embedding for r in model.passages.collect()}, **{r.query_id: r.embedding for r in R.lsa_queries(model, asked).collect()}}

    whole = found()
    monkeypatch.setattr(R, "BLOCK_TOKENS", 100)
    dealt = found()
    assert whole.keys() == dealt.keys() and len(whole) == 63
    assert all(np.abs(np.array(whole[k]) - dealt[k]).max() < 1e-9 for k in whole)


def test_start_vectors_are_hashes_of_terms(spark):
    rows = spark.range(20).select(F.xxhash64(F.concat(F.lit("t"), "id")).alias("h"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: F.xxhash64(F.concat(F.lit("t"), "id"), j) / F.lit(2.0**63)).alias("v")).collect()
    assert np.array_equal(R.start_vectors(np.array([r.h for r in rows], np.int64), 5), np.array([r.v for r in rows]))


def test_seeds_of_terms_are_spark_hashes(spark):
    random.seed(3)
    terms = ["".join(random.choice("abcxyz019-'") for _ in range(n)) for n in range(1, 80)]
    want = [r.h for r in spark.createDataFrame(list(enumerate(terms)), "i long, term string").orderBy("i").select(F.xxhash64("term").alias("h")).collect()]
    assert latent.term_seeds(pa.array(terms)).tolist() == want and latent.term_seeds(pa.array([], pa.string())).tolist() == []


def test_counts_kept_as_bytes_weigh_in_full_precision():
    chunk = latent.Chunk(np.array([2], np.int32), np.array([0, 1], np.int32), np.array([3, 200], np.uint8))
    assert np.array_equal(chunk.damped, 1 + np.log(np.array([3.0, 200.0])))


def test_the_sign_of_a_dimension_does_not_hang_on_rounding():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 13))
    flip = np.diag(rng.choice([-1.0, 1.0], 13))
    want = x @ latent.orthonormal(x.T @ x)
    for vectors in (latent.orthonormal(x.T @ x), latent.leading(x.T @ x, 5), flip @ latent.leading(flip @ x.T @ x @ flip, 5)):
        assert vectors.shape[0] == 13
    assert ((1 / np.sqrt(np.arange(1.0, 14))) @ latent.leading(x.T @ x, 13) >= 0).all()
    assert np.abs(want.T @ want - np.eye(13)).max() < 1e-9


def stored(spark):
    base = shared_base(spark).removeprefix("file://")
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(base) for f in files if not f.endswith(".crc")}


def test_latent_vectors_leave_no_copies_of_the_texts(spark, monkeypatch):
    random.seed(8)
    passages = [(1 + i % 2, f"P{i}", " ".join(f"word{random.randrange(10 ** 6)}" for _ in range(60))) for i in range(300)]
    frame = spark.createDataFrame(passages, "case_id long, passage_id string, text string")
    chars = sum(len(text) for *_, text in passages)
    for tokens in (R.BLOCK_TOKENS, 6000):
        monkeypatch.setattr(R, "BLOCK_TOKENS", tokens)
        before = stored(spark)
        assert R.lsa_vectors(frame, 4).count() == 300
        left = {f: n for f, n in stored(spark).items() if f not in before}
        # one block: the sizes of the cases only; several: besides them the last vectors, with which the dimensions are turned
        assert sum(left.values()) < (chars / 10 if tokens > 6000 else chars)


def test_only_terms_that_are_asked_for_keep_their_vectors(spark, monkeypatch):
    random.seed(9)
    passages = [(1 + i % 2, f"P{i}", " ".join(f"w{random.randrange(60)}" for _ in range(15))) for i in range(80)]
    frame = spark.createDataFrame(passages, "case_id long, passage_id string, text string").withColumn("seq", F.lit(1).cast("long"))  # never null
    asked = spark.createDataFrame([(1, 1, "w1 w2 w2"), (2, 2, "w3 w4"), (3, 9, "w1"), (4, 1, "nothing")], "query_id long, case_id long, query string")
    for tokens in (R.BLOCK_TOKENS, 150):
        monkeypatch.setattr(R, "BLOCK_TOKENS", tokens)
        every, some = R.lsa_model(frame, 3), R.lsa_model(frame, 3, terms=R.query_terms(asked).select("case_id", "term"))
        assert some.basis.groupBy("case_id", "term").count().count() == some.basis.count() == 4 < every.basis.count()
        found = [{r.query_id: r.embedding for r in R.lsa_queries(m, asked).collect()} for m in (every, some)]
        assert found[0].keys() == found[1].keys() == {1, 2}
        assert all(np.abs(np.array(found[0][q]) - found[1][q]).max() < 1e-9 for q in found[0])
