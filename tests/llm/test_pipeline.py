"""The stages of the pipeline against brute force, each on what the stage before it kept."""

import random
import zlib

import pytest
import sentencepiece

import corpus_pipeline
from __spark_entry__ import queries
from attesta.llm import pieces
from test_exact_and_mixing import want_exact
from test_joins_and_models import toxic_rows, want_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = toxic_rows(250, rng)
    texts = dict(rows)
    clean = [i for i, y in labels if not y]
    rows += [(1000 + j, texts[i]) for j, i in enumerate(clean[:20])]  # copies
    rows += [(2000 + j, texts[i].replace(" ", "\n ")) for j, i in enumerate(clean[20:30])]  # copies but for white space
    long = [" ".join("".join(rng.choice("klmnop") for _ in range(4)) for _ in range(80)) for _ in range(10)]
    rows += [(3000 + j, t) for j, t in enumerate(long)] + [(3100 + j, t.rsplit(" ", 1)[0] + " changed") for j, t in enumerate(long)]
    rows += [(4000, None), (4001, ""), (4002, "pqpq " * 20000)]
    folder = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, dict(labels)


def test_every_stage(spark, corpus, tmp_path):
    folder, rows, labels = corpus
    docs, texts = spark.read.parquet(f"{folder}/documents.parquet"), dict(rows)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.toPandas())
    toxic, exact, near, mixed, encoded = kept
    for table in kept[:-1]:
        assert list(table.columns) == COLUMNS
    # toxic documents go, clean ones stay
    stay = set(toxic["doc_id"])
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((i in stay) != bool(labels[i]) for i in held) >= 0.9 * len(held) and {4000, 4001, 4002} <= stay
    # one of each group of equal texts
    left = [(i, texts[i]) for i in sorted(stay)]
    want = {i for i, v in want_exact(left).items() if v[2]}
    assert set(exact["doc_id"]) == want and len(exact) == len(want)
    # one of each group of near copies
    left = [(i, texts[i]) for i in sorted(want)]
    want = {i for i, (_, root) in want_components(left).items() if root == i}
    assert set(near["doc_id"]) == want and len(near) == len(want) < len(left)
    # once or twice, near the targets of the sources
    times = mixed["doc_id"].value_counts()
    assert set(times.index) <= want and times.max() <= 2
    words = {i: len((texts[i] or "").encode().split()) for i in want}
    assert abs(sum(words[i] * n for i, n in times.items()) - 1.5 * sum(words.values())) <= max(words.values())
    # every text encoded as the library does
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    assert len(encoded) == len(mixed) and encoded["round_trip"].all()
    for i, ids in zip(encoded["doc_id"], encoded["ids"]):
        assert list(ids) == library.encode(texts[i])


def test_run_is_registered(spark, corpus):
    assert queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, corpus[0]).where("round_trip").count() > 100


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_go_by_row_where_doc_ids_are_null_or_repeated(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    top = 1 << 62
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b + " "), (None, c), (2, c), (top, d), (top, d), (None, d.rsplit(" ", 1)[0] + " other"), (-5, None), (None, None)]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    assert exact.columns == COLUMNS
    left = exact.collect()
    plain = sorted("".join((r.text or "").split()) for r in left)
    assert plain == sorted({"".join((t or "").split()) for _, t in rows}) and {r.doc_id for r in left if r.text in (c, d)} == {2, top}
    near = corpus_pipeline.ngram_jaccard(spark, docs, "").collect()  # texts without words are linked with nothing
    assert len(near) == 6 and {"".join(r.text.split()) for r in near if r.text} >= {"".join(t.split()) for t in (a, b, c)}
    assert len([r for r in near if r.text and r.text.startswith(d[:100])]) == 1
    mixed = corpus_pipeline.source_mixing(spark, docs, "").collect()
    words = lambda t: len((t or "").split())
    assert abs(sum(words(r.text) for r in mixed) - 1.5 * sum(words(t) for _, t in rows)) <= 61
    # no room behind the largest doc_id
    ends = [((1 << 63) - 1, a, "en", "s", 9), ((1 << 63) - 1, b, "en", "s", 9), (3, b, "en", "s", 9)]
    left = corpus_pipeline.exact_dedup(spark, spark.createDataFrame(ends, docs.schema), "").collect()
    assert sorted(r.text for r in left) == sorted([a, b])
