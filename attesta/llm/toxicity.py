"""Toxicity from the nearest labelled examples.

An index holds up to ``max_examples`` labelled training texts, chosen by a hash in the proportions of the training rows; that
sample is the only bound and is a parameter. Terms are words and beginnings of words. *All* terms of the examples span the
space of TF-IDF vectors; their inverse document frequencies count *all* labelled training texts (per batch, combined before
the shuffle). The index is built in one task, as the sample is bounded, and travels as one broadcast; the driver keeps no
layout of it, and examples are searched in tasks to calibrate.

The index is inverted and block-max: examples lie in blocks. Terms of few examples have postings, whose products are summed
exactly; each of the ``COMMON`` terms of most examples keeps, per block, its largest weight. A text's cosine with any example
of a block is at most the block's best sum over postings and the sum of its own weights times those maxima, so blocks are
scored exactly in order of that bound until no bound reaches the k-th best cosine found. Votes of the k nearest, weighted by
closeness and drawn towards the training rate, give a score, which a monotone table fitted by leaving examples out turns into
a rate. The neighbours are the evidence.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.batches import Words, chunks, mix, prefix_hash, range_hash, release_memory
from attesta.llm.shared import shared_table

PREFIXES = (3, 4, 5, 6, 7, 8)
BLOCK = 128
COMMON = 2048  # a matter of speed only: terms of most examples are multiplied as matrices, the others by postings
LOT, LOT_POSTINGS = 256, 1 << 20  # texts searched at once, and about how many postings they meet
PIECE_BYTES = 1 << 19  # texts whose terms are taken at once: a term of a word takes some ten times its bytes meanwhile
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]{}<>*_-")] = True


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every word, without punctuation around it, and of its beginnings in bytes."""
    words = Words(data, at)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        end -= (end > start) & _TRIM[words.data[np.maximum(end - 1, 0)]]
        start += (end > start) & _TRIM[words.data[np.minimum(start, len(data) - 1)]]
    prefix = prefix_hash(words.data)
    rows, hashes = [words.row], [range_hash(prefix, start, end)]
    for n in PREFIXES:
        long = end - start > n
        rows.append(words.row[long])
        hashes.append(range_hash(prefix, start[long], start[long] + n) ^ np.uint64(n))
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def _distinct(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term of a row once."""
    order = np.argsort(mix(terms.view(np.uint64) ^ mix(rows.astype(np.uint64))))
    rows, terms = rows[order], terms[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[first], terms[first]


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, docs): in how many of the texts a term occurs; counted per batch, then combined."""
    def count(batches):
        for b in batches:
            parts, taken = [], 0
            for _, last, data, at in chunks(b.column(0), PIECE_BYTES):
                parts.append(np.unique(_distinct(*_terms(data, at))[1], return_counts=True))
                taken += len(data)
                if taken < 3 * PIECE_BYTES and last < b.num_rows:  # rows of some pieces are combined
                    continue
                terms, docs = (np.concatenate(x) for x in zip(*parts))
                parts, taken = [], 0
                order = np.argsort(terms)
                terms, docs = terms[order], docs[order]
                first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)])
                sums = np.add.reduceat(docs, first) if len(first) else docs
                yield pa.RecordBatch.from_arrays([pa.array(terms[first], pa.int64()), pa.array(sums, pa.int64())], names=["term", "docs"])
        release_memory()

    return texts.select("text").mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def weigh_terms(training: DataFrame, n: int, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All terms of the sample's texts and their inverse document frequencies among the ``n`` training texts."""
    table = term_counts(training).join(term_counts(sample).select("term").hint("merge"), "term").toArrow()
    return table["term"].to_numpy(), (np.log((1 + n) / (1 + table["docs"].to_numpy())) + 1).astype(np.float32)


class Model:
    """Vocabulary, index and calibration; with the terms of the training texts and ``max_examples`` of these texts."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, prior: float, k: int, pull: float):
        order = np.argsort(terms)
        self.terms, self.idf = terms[order], idf[order]
        self.prior, self.k, self.pull = prior, k, pull
        self.edges, self.rates = np.array([0.0]), np.array([prior])

    def vectors(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """TF-IDF of every row in compressed form, of length one: (row bounds, term numbers, weights)."""
        n = len(at) - 1
        if not len(self.terms) or not len(data):
            return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, terms = _terms(data, at)
        names, terms = np.unique(terms, return_inverse=True)
        if not len(names):
            return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        place = np.minimum(np.searchsorted(self.terms, names), len(self.terms) - 1)
        hit = (self.terms[place] == names)[terms]
        code, count = np.unique(rows[hit] * len(names) + terms[hit], return_counts=True)
        rows, place = code // len(names), place[code % len(names)]
        weight = (1 + np.log(count)) * self.idf[place]
        size = np.sqrt(np.bincount(rows, weight * weight, minlength=n))
        return np.searchsorted(rows, np.arange(n + 1)), place, weight / size[rows]

    def index(self, doc_ids: np.ndarray, toxic: np.ndarray, bounds: np.ndarray, place: np.ndarray, weight: np.ndarray, heads: tuple[np.ndarray, np.ndarray]) -> None:
        """Lays examples out in blocks of like texts: ordered by their heaviest terms, of which ``heads`` holds the numbers and weights."""
        heaviest, most = heads
        order = np.lexsort((doc_ids, most, heaviest))
        self.doc_ids, self.toxic = doc_ids[order], toxic[order].astype(float)
        rows = np.repeat(np.argsort(order).astype(np.int32), np.diff(bounds))
        # a term's examples in their order: the pairs are distinct, so one sort of numbers made of both will do
        by_term = np.argsort((place.astype(np.int64) << 32) | rows)
        self.example, self.weight = rows[by_term], weight.astype(np.float32)[by_term]
        # postings of each term: where they begin and how many there are, none for a term in no example
        self.times = np.bincount(place, minlength=len(self.terms)).astype(np.int32)

    @staticmethod
    def heads(bounds: np.ndarray, place: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The heaviest term of every row and its weight, -1 and 0 in rows without terms."""
        n, filled = len(bounds) - 1, np.flatnonzero(np.diff(bounds))
        head = np.lexsort((-weight, np.repeat(np.arange(n), np.diff(bounds))))[bounds[filled]]
        heaviest, most = np.full(n, -1), np.zeros(n)
        heaviest[filled], most[filled] = place[head], weight[head]
        return heaviest, most

    def _lay_out(self) -> None:
        """Where postings begin, and the common terms as matrices; made on every executor at the first search."""
        n = len(self.doc_ids)
        self.first = np.cumsum(self.times) - self.times
        common = np.argsort(-self.times, kind="stable")[:COMMON]
        common = common[self.times[common] > 0]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[common] = np.arange(len(common))
        column = np.repeat(self.column, self.times)
        own = np.flatnonzero(column >= 0)
        example, column = self.example[own], column[own]
        dense = np.zeros((-(-n // BLOCK), len(common), BLOCK), np.float32)
        dense[example // BLOCK, column, example % BLOCK] = self.weight[own]
        self.parts = [p if i + BLOCK <= n else np.ascontiguousarray(p[:, : n - i]) for i, p in zip(range(0, n, BLOCK), dense)]
        self.most = np.array([p.max(axis=1) for p in self.parts], np.float32).reshape(len(self.parts), len(common)).T

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("first", "column", "parts", "most", "shared")}

    @property
    def blocks(self) -> list[np.ndarray]:
        """The weights of all terms (rows) in each block's examples (columns), laid out in full."""
        terms, out = np.repeat(np.arange(len(self.terms)), self.times), []
        for i in range(0, len(self.doc_ids), BLOCK):
            own = (self.example >= i) & (self.example < i + BLOCK)
            out.append(np.zeros((len(self.terms), min(BLOCK, len(self.doc_ids) - i)), np.float32))
            out[-1][terms[own], self.example[own] - i] = self.weight[own]
        return out

    def example_vectors(self, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The examples with the given numbers, which differ (all of the index by default), as ``vectors`` gives them; only their
        postings are taken out."""
        own = np.arange(len(self.doc_ids)) if own is None else own
        turn = np.full(len(self.doc_ids), -1, np.int32)
        turn[own] = np.arange(len(own))
        found = np.flatnonzero(turn[self.example] >= 0)
        place = np.searchsorted(np.cumsum(self.times), found, side="right")
        turn = turn[self.example[found]]
        order = np.argsort(turn, kind="stable")
        return np.searchsorted(turn[order], np.arange(len(own) + 1)), place[order], self.weight[found][order].astype(float)

    def search(self, bounds: np.ndarray, place: np.ndarray, weight: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest of every text, exactly, -1 and 0 where there are fewer with a cosine above
        zero. ``without``: the example that each text is itself.

        The block with the largest bound comes first and gives a first k-th best cosine; the other blocks are scored, each
        for the texts whose bound reaches what they have by then.
        """
        if "parts" not in self.__dict__:
            self._lay_out()
        n, k = len(bounds) - 1, self.k
        best, close = np.full((n, k), -1), np.zeros((n, k))
        if not self.parts:
            return best, close
        width = len(self.parts) * BLOCK
        filled = np.flatnonzero(np.diff(bounds))
        met = np.concatenate([[0], np.cumsum(np.where(self.column[place] >= 0, 0, self.times[place]))])
        met = np.cumsum(met[bounds[1:]] - met[bounds[:-1]])[filled]
        lot = met // LOT_POSTINGS + np.arange(len(filled)) // LOT
        for rows in np.split(filled, np.flatnonzero(np.diff(lot)) + 1):
            if not len(rows):
                continue
            count = np.diff(bounds)[rows]
            spots = np.arange(int(count.sum())) + np.repeat(bounds[rows] - (np.cumsum(count) - count), count)
            own, term, share = np.repeat(np.arange(len(rows)), count), place[spots], weight[spots].astype(np.float32)
            column = self.column[term]
            common = column >= 0
            q = np.zeros((len(rows), len(self.most)), np.float32)
            q[own[common], column[common]] = share[common]
            times = np.where(common, 0, self.times[term])
            posting = np.arange(int(times.sum())) + np.repeat(self.first[term] - (np.cumsum(times) - times), times)
            cell, product = np.repeat(own * width, times), np.repeat(share, times)
            cell += self.example[posting]
            product *= self.weight[posting]
            rare = np.bincount(cell, product, minlength=len(rows) * width).reshape(len(rows), len(self.parts), BLOCK)
            bound = q @ self.most + rare.max(axis=2)
            first = bound.argmax(axis=1)
            for phase in (0, 1):
                for b in range(len(self.parts)):
                    own = (first == b) if phase == 0 else (first != b) & (bound[:, b] > 0) & (bound[:, b] >= close[rows, k - 1] - 1e-5)
                    at = np.flatnonzero(own)
                    if not len(at):
                        continue
                    cosine = np.round((q[at] @ self.parts[b]).astype(float) + rare[at, b, : self.parts[b].shape[1]], 5)
                    names = np.broadcast_to(np.arange(b * BLOCK, b * BLOCK + cosine.shape[1]), cosine.shape)
                    if without is not None:
                        cosine = np.where(names == without[rows[at], None], 0, cosine)
                    better = cosine.max(axis=1) > close[rows[at], k - 1]  # no other text's neighbours change
                    at, cosine, names = at[better], cosine[better], names[better]
                    if not len(at):
                        continue
                    all_close = np.concatenate([close[rows[at]], cosine], axis=1)
                    all_names = np.concatenate([best[rows[at]], np.where(cosine > 0, names, -1)], axis=1)
                    order = np.argsort(-all_close, axis=1, kind="stable")[:, :k]
                    close[rows[at]], best[rows[at]] = np.take_along_axis(all_close, order, 1), np.take_along_axis(all_names, order, 1)
        return best, close

    def votes(self, best: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Closeness-weighted share of toxic neighbours, drawn towards the training rate by the weight ``pull``."""
        weight = close / (1.05 - np.minimum(close, 1.0))
        toxic = self.toxic[best] if len(self.toxic) else np.zeros(best.shape)
        return ((weight * np.where(best >= 0, toxic, 0)).sum(axis=1) + self.pull * self.prior) / (weight.sum(axis=1) + self.pull)

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Isotonic steps (pooled neighbours) of the toxic rate over votes of examples left out of their own search."""
        order = np.argsort(votes, kind="stable")
        groups: list[list[float]] = []
        for v, y in zip(votes[order], toxic[order]):
            groups.append([v, v, y, 1.0])
            while len(groups) > 1 and (groups[-2][1] == groups[-1][0] or groups[-2][2] / groups[-2][3] >= groups[-1][2] / groups[-1][3]):
                last = groups.pop()
                groups[-1] = [groups[-1][0], last[1], groups[-1][2] + last[2], groups[-1][3] + last[3]]
        if groups:
            self.edges = np.array([(g[0] + g[1]) / 2 for g in groups])
            self.rates = np.array([(g[2] + self.prior) / (g[3] + 1) for g in groups])

    def scores(self, votes: np.ndarray) -> np.ndarray:
        """Calibrated rates; a small share of the raw vote keeps texts with equal rates in order."""
        return np.round(np.clip(0.98 * np.interp(votes, self.edges, self.rates) + 0.02 * votes, 0, 1), 6)


def held_out(fold: int, folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(documents: DataFrame, labels: DataFrame, max_examples: int = 4000,
        k: int = 15, pull: float = 0.5, fold: int = 2, folds: int = 4) -> Model:
    """Learns from labelled rows outside the held-out fold. Only text and ``toxic`` are read, doc_id for the join and fold.

    A document with several labels counts as toxic if one of them is 1; labels without a document or value are ignored.
    """
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # labels grow with the documents, so they are joined by a shuffle at every size
    training = documents.where(~held_out(fold, folds)).select("doc_id", "text").join(marks.hint("merge"), "doc_id")
    training = shared_table(training.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"), "training")
    totals = training.groupBy("toxic").count().collect()  # two rows
    n_toxic = sum(r["count"] for r in totals if r["toxic"] == 1)
    n_clean = sum(r["count"] for r in totals if r["toxic"] != 1)
    prior = n_toxic / max(n_toxic + n_clean, 1)
    # examples by hash, so in about the proportions of the training rows; the hash of the last one is found on narrow rows
    place = F.xxhash64("doc_id")
    last = training.select(place.alias("place")).orderBy("place").limit(max_examples).agg(F.max("place")).first()[0]
    sample = training.where(place <= F.lit(last)).select("doc_id", "toxic", "text") if last is not None else training.limit(0).select("doc_id", "toxic", "text")
    model = Model(*weigh_terms(training, n_toxic + n_clean, sample), prior, k, pull)
    built = sample.repartition(1).mapInArrow(_index_of(model), "state binary").toArrow()["state"]
    if len(built):
        model = pickle.loads(built[0].as_py())
    else:
        none = np.zeros(0, np.int64)
        model.index(none, none, np.zeros(1, np.int64), none, np.zeros(0), (none, none))
    del built
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n = len(model.doc_ids)
    votes = spark.range(0, n, 1, max(1, min(64, n // 64))).mapInArrow(_own_votes(shared), "id long, vote double").toArrow()
    order = np.argsort(votes["id"].to_numpy())
    model.calibrate(votes["vote"].to_numpy()[order], model.toxic)
    model.shared = shared
    return model


def _own_votes(shared):
    """Votes for the examples with the given numbers, each left out of its own search."""
    def run(batches):
        for b in batches:
            own, model = b.column(0).to_numpy(), shared.value
            votes = model.votes(*model.search(*model.example_vectors(own), own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes)], names=["id", "vote"])
        release_memory()

    return run


def _index_of(model: Model):
    """The model with its index, built from all examples, as one row of bytes."""
    def run(batches):
        parts = []
        for b in batches:
            for first, last, data, at in chunks(b.column(2), PIECE_BYTES):
                rows = slice(first, last)
                bounds, place, weight = model.vectors(data, at)
                parts.append((b.column(0).to_numpy()[rows], b.column(1).to_numpy()[rows], np.diff(bounds), place.astype(np.int32), weight.astype(np.float32), *model.heads(bounds, place, weight)))
        if parts:
            doc_ids, toxic, sizes, place, weight, heaviest, most = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            model.index(doc_ids, toxic, np.concatenate([[0], np.cumsum(sizes)]), place, weight, (heaviest, most))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, protocol=5)], pa.binary())], names=["state"])
        release_memory()

    return run


def score(documents: DataFrame, model: Model, limit: float = 0.3, evidence: int = 3) -> DataFrame:
    """Adds to every row: score (0 to 1), predicted (1 if score >= limit), neighbours (doc_ids of the nearest examples) and
    cosines.

    Whole texts are read. A null or empty text, or one without any of the terms, has no neighbours and gets the rate of
    such texts. Equal texts get equal scores. No rows give none; other columns stay.
    """
    shared, steps = model.shared, (model.edges, model.rates)
    rows = documents.drop("score", "predicted", "neighbours", "cosines")
    names, text_at = rows.columns, rows.columns.index("text")

    def run(batches):
        m = shared.value
        m.edges, m.rates = steps
        for b in batches:
            for first, last, data, at in chunks(b.column(text_at), PIECE_BYTES):
                bounds, place, weight = m.vectors(data, at)
                best, cosine = m.search(bounds, place, weight)
                scores = m.scores(m.votes(best, cosine))
                near = [[int(m.doc_ids[j]) for j in row if j >= 0] for row in best[:, :evidence]]
                close = [row[: len(n)].tolist() for row, n in zip(cosine, near)]
                yield pa.RecordBatch.from_arrays([
                    *b.slice(first, last - first).columns, pa.array(scores), pa.array((scores >= limit).astype(np.int32)),
                    pa.array(near, pa.list_(pa.int64())), pa.array(close, pa.list_(pa.float64()))], names=[*names, "score", "predicted", "neighbours", "cosines"])
        release_memory()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, score double, predicted int, neighbours array<long>, cosines array<double>")
