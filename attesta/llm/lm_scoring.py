"""Log probability of whole documents by a gated recurrent language model with a class-factored output.

p(word | past) = p(class | past) * p(word | class). The classes are the end of a text, the most frequent words (one class
each) and shapes of the other words (their last letters, or their first letter outside ASCII, or punctuation and digits).
The network predicts the class; within a class a word has its add-one share of the corpus counts, one unseen word
included. Word counts cover every training text. The network learns by truncated backpropagation on every training text:
in each round every partition trains from the same weights, and the weights are averaged by tokens.

Counts reach the texts in two ways: those of the most frequent words, as many as ``table_words``, travel with the model;
each other word of a text is joined to the table of counts. No count is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import gru
from attesta.llm.batches import Words, chunks, column_bytes, release_memory
from attesta.llm.shared import shared_table

OWN_CLASSES = 24
SUFFIX_CLASSES, LETTER_CLASSES = 22, 12
CLASSES = 1 + OWN_CLASSES + SUFFIX_CLASSES + LETTER_CLASSES + 5

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_COMMA = np.zeros(256, bool)
_COMMA[list(b",;:)]}\"'")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def shape(words: Words) -> np.ndarray:
    """Class of each word by its looks, counted from the first class after the words with classes of their own."""
    data, start, last = words.data, words.start, words.end - 1
    if not len(start):
        return np.zeros(0, np.int64)
    high = data >= 0x80
    n_high = np.concatenate([[0], np.cumsum(high)])
    has_high = n_high[last + 1] > n_high[start]
    at_high = np.flatnonzero(high)
    first_high = at_high[np.minimum(np.searchsorted(at_high, start), max(len(at_high) - 1, 0))] if len(at_high) else start
    letter = data[np.minimum(first_high + 1, len(data) - 1)].astype(np.int64)
    before = data[np.maximum(last - 1, start)].astype(np.int64)
    end = data[last]
    out = (before * 7 + end.astype(np.int64) * 3) % SUFFIX_CLASSES
    out = np.where(has_high, SUFFIX_CLASSES + letter % LETTER_CLASSES, out)
    rest = SUFFIX_CLASSES + LETTER_CLASSES
    plain = _LETTER[data[start]] | has_high
    out = np.where(_STOP[end], rest + plain, out)
    out = np.where(_COMMA[end], rest + 2 + plain, out)
    return np.where(~(_LETTER[end] | high[last] | _STOP[end] | _COMMA[end]), rest + 4, out)


def held_out(fold: int, folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(texts: DataFrame) -> DataFrame:
    """(word hash, shape, count) over all texts; words are lower-cased and told apart by a 64-bit hash."""
    def count(batches):
        for b in batches:
            for _, _, data, at in chunks(b.column(0), 8 << 20):
                parts = []
                for _, _, piece, own in chunks(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])):
                    words = Words(piece, own)
                    parts.append((words.hashes().view(np.int64), shape(words)))
                hashes, looks = (np.concatenate(x) for x in zip(*parts))
                names, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(looks[first].astype(np.int32)), pa.array(n, pa.int64())], names=["word", "shape", "n"])

    return texts.select("text").mapInArrow(count, "word long, shape int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.max("shape").alias("shape"))


class Model:
    """What scoring needs on every executor: weights, class sizes and the counts of the most frequent words."""

    def __init__(self, own: np.ndarray, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, types: np.ndarray, total: int, distinct: int, texts: int):
        self.own_words, self.own_class = np.sort(own), np.argsort(own) + 1
        order = np.argsort(words)
        self.words, self.log_counts = words[order], np.log10(counts[order] + 1.0)
        self.class_counts = sizes
        self.log_class = np.log10(sizes + types + 1.0)  # all words of the class, one more each, and one unseen word
        self.total, self.distinct, self.texts = total, distinct, texts
        self.weights = gru.start(sizes)

    def classes(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        out = shape(words) + 1 + OWN_CLASSES
        if len(self.own_words) and len(hashes):
            at = np.minimum(np.searchsorted(self.own_words, hashes), len(self.own_words) - 1)
            hit = self.own_words[at] == hashes
            out[hit] = self.own_class[at[hit]]
        return out.astype(np.uint8)


def _class_texts(model: Model, column: pa.Array) -> list[np.ndarray]:
    """Class sequence of each text, its end included."""
    out = []
    for _, _, data, at in chunks(column):
        words = Words(data, at)
        found = model.classes(words, words.hashes().view(np.int64))
        out += [np.append(found[s:e], np.uint8(0)) for s, e in zip(words.first[:-1], words.first[1:])]
    return out


def count_model(counts: DataFrame, n_texts: int, table_words: int) -> Model:
    """The model with class statistics from the counts of all training texts, before the network is trained."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    frequent = counts.orderBy(F.desc("n"), "word").limit(OWN_CLASSES).toPandas()
    own = frequent["word"].to_numpy(np.int64)
    by_shape = counts.where(~F.col("word").isin(own.tolist())) if len(own) else counts
    per_shape = by_shape.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()  # one row per shape
    sizes, types = np.zeros(CLASSES), np.zeros(CLASSES)
    at = per_shape["shape"].to_numpy(np.int64) + 1 + OWN_CLASSES
    sizes[at], types[at] = per_shape["n"], per_shape["types"]
    sizes[1: 1 + len(own)], types[1: 1 + len(own)] = frequent["n"], 1
    sizes[0], types[0] = n_texts, min(n_texts, 1)
    # the smallest count such that at most table_words words have it: from a short histogram
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 16) + 864)
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).toPandas()
    fits = histogram[histogram["words"].cumsum() <= table_words]
    table = counts.where(F.col("n") >= int(fits["least"].iloc[-1])).select("word", "n").toPandas() if len(fits) else counts.limit(0).select("word", "n").toPandas()
    return Model(own, table["word"].to_numpy(np.int64), table["n"].to_numpy(float), sizes, types,
                 int(totals[0] or 0) + n_texts, int(totals[1] or 0) + min(n_texts, 1), n_texts)


def train_network(texts: DataFrame, model: Model, rounds: int) -> np.ndarray:
    """Weights after some rounds: each partition trains from the common weights, which are then averaged by tokens.

    The classes of a text do not change from round to round, so they are found and written once, a byte for each token.
    """
    named = texts.sparkSession.sparkContext.broadcast(model)

    def classes(batches):
        for b in batches:
            found = _class_texts(named.value, b.column(0))
            at = np.concatenate([[0], np.cumsum([len(t) for t in found])]).astype(np.int64)
            data = np.concatenate([*found, np.zeros(0, np.uint8)])
            yield pa.RecordBatch.from_arrays([pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())], names=["classes"])
        release_memory()

    written = shared_table(texts.select("text").mapInArrow(classes, "classes binary"), "network_classes")
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(model)

        def local(batches, shared=shared):
            m = shared.value
            sequences = []
            vector, tokens = m.weights, 0
            for b in batches:
                data, at = column_bytes(b.column(0))
                sequences += [data[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                if sum(map(len, sequences)) > 4_000_000:  # bounded memory; training goes on with the next texts
                    vector, n = gru.train(vector, CLASSES, sequences)
                    tokens, sequences = tokens + n, []
            if sequences:
                vector, n = gru.train(vector, CLASSES, sequences)
                tokens += n
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vector)), pa.int64()), pa.array(vector.astype(float)), pa.array(np.full(len(vector), float(tokens)))], names=["place", "value", "tokens"])

        found = written.mapInArrow(local, "place long, value double, tokens double").groupBy("place").agg(
            (F.sum(F.col("value") * F.col("tokens")) / F.sum("tokens")).alias("value")).orderBy("place").toPandas()  # one row per weight
        if len(found):
            model.weights = found["value"].to_numpy(np.float32)
    return model.weights


def fit(documents: DataFrame, fold: int = 2, folds: int = 7, table_words: int = 1 << 19, one_in: int = 1, rounds: int = 2) -> tuple[Model, DataFrame]:
    """(model, word counts) from the documents outside the held-out fold; the network sees one text in ``one_in``, all by default."""
    training = documents.where(~held_out(fold, folds))
    n_texts = training.count()
    counts = shared_table(word_counts(training), "counts")
    model = count_model(counts, n_texts, table_words)
    train_network(training.where(F.pmod(F.xxhash64("doc_id", F.lit("network")), F.lit(one_in)) == 0).select("text"), model, rounds)
    return model, counts


def score(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to (doc_id, text).

    Tokens are the lower-cased words ``[^\\x20\\x09-\\x0D]+`` of the whole text and one end, so a null or empty text has
    one token. n_known counts tokens seen in training. base_score adds up log10((c + 1) / (N + V + 1)). Repeated rows are
    scored one by one; without training texts every count is zero; no rows give none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            n, known, logs, inside = (np.zeros(b.num_rows) for _ in range(4))
            rare_words, rare_counts, rare_at, sequences = [], [], [0], []
            for first, last, data, at in chunks(b.column(2)):
                words = Words(data, at)
                hashes = words.hashes().view(np.int64)
                classes = m.classes(words, hashes)
                rows = words.row
                if len(m.words):
                    place = np.minimum(np.searchsorted(m.words, hashes), len(m.words) - 1)
                    hit = m.words[place] == hashes
                    value = np.where(hit, m.log_counts[place], 0)
                else:
                    hit, value = np.zeros(len(hashes), bool), np.zeros(len(hashes))
                size = last - first
                n[first:last] = words.count + 1
                known[first:last] = np.bincount(rows, hit, minlength=size) + (m.texts > 0)
                logs[first:last] = np.bincount(rows, value, minlength=size) + np.log10(m.texts + 1.0)
                inside[first:last] = np.bincount(rows, m.log_class[classes], minlength=size) + m.log_class[0]
                pairs = np.rec.fromarrays([rows[~hit], hashes[~hit]])
                order = np.lexsort((pairs.f1, pairs.f0))
                r, h = pairs.f0[order], pairs.f1[order]
                begins = np.ones(len(r), bool)
                begins[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                spots = np.flatnonzero(begins)
                rare_words.append(h[spots])
                rare_counts.append(np.diff(np.append(spots, len(r))))
                rare_at += (rare_at[-1] + np.searchsorted(r[spots], np.arange(1, size + 1))).tolist()
                sequences += [np.append(classes[s:e], np.uint8(0)) for s, e in zip(words.first[:-1], words.first[1:])]
            class_part = gru.score(m.weights, CLASSES, sequences)
            offsets = pa.array(rare_at, pa.int32())
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(class_part - inside),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*rare_words, np.zeros(0, np.int64)]), pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*rare_counts, np.zeros(0, np.int64)]), pa.int64()))],
                names=["row", "doc_id", "n_tokens", "known", "logs", "class_part", "rare", "times"])

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = shared_table(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, logs double, class_part double, rare array<long>, times array<long>"), "read")
    rare = read.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    more = rare.join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return read.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(model.total + model.distinct + 1.0))).alias("base_score"), (logs + F.col("class_part")).alias("score"))
