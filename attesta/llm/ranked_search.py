"""Ranked lexical search of many queries at once, by evaluating shared sub-expressions once.

A score is a sum over the query's terms of integer contributions (weight times saturated frequency), so two queries that share
terms share partial sums.

1. The query items are dealt into blocks of bounded size. For each block shared term sets are mined: terms that occur in exactly
   the same items form one set, then neighbouring sets (ordered by the number of items that hold them) that occur together in
   several items are joined, round after round. The result is a DAG: leaves are terms, inner nodes partial sums used by
   several items, roots the items.
2. One pass over all documents gives their postings of the block's terms (matched by hash, compared by bytes) and their
   lengths; document frequencies are counted from those.
3. A second pass evaluates the DAG for some documents at a time: each node's accumulator (one number per document) is filled
   once, whatever the number of items above it. Each task keeps the k best of every item; the k best of those are the result.

Documents are never shuffled; what is shuffled are k rows per item and task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.batches import LOWER, chunks, prefix_hash, range_hash, release_memory
from attesta.llm.shared import shared_table

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ENTRIES = 1 << 16  # (item, term) entries a block holds, about
ACCUMULATORS = 1 << 22  # numbers held at once by a task's accumulators
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = True
_TERM[0x80:] = True


def term_ranges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every term of a chunk: maximal runs of term bytes within one text."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = _TERM[data]
    start, end = np.flatnonzero(np.diff(edge) == 1), np.flatnonzero(np.diff(edge) == -1)
    inner = at[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    cut = inner[_TERM[data[inner]] & _TERM[data[inner - 1]]]  # a run that goes on in the next text is cut there
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(at, start, side="right") - 1


def share_sums(items: list[np.ndarray], n_terms: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Mines shared term sets: (children of each inner node, children of each item).

    ``items`` hold term numbers without repeats. Numbers below n_terms are terms, n_terms + i is inner node i; a node's children
    have smaller numbers. Every node is below at least two items, and every item is the sum of its children.
    """
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for i, terms in enumerate(items):
        for term in terms.tolist():
            holders[term].append(i)
    groups: dict[tuple, list[int]] = {}
    for term, held in enumerate(holders):
        if held:
            groups.setdefault(tuple(held), []).append(term)
    nodes: list[np.ndarray] = []
    symbols = []  # (items, symbol): one symbol per group of terms that always occur together
    kept: list[list[int]] = [[] for _ in items]
    for held, terms in groups.items():
        if len(held) == 1:
            kept[held[0]].extend(terms)
        elif len(terms) == 1:
            symbols.append((held, terms[0]))
        else:
            nodes.append(np.asarray(terms))
            symbols.append((held, n_terms + len(nodes) - 1))
    symbols.sort(key=lambda pair: (-len(pair[0]), pair[0], pair[1]))
    lines: list[list[int]] = [[] for _ in items]
    for held, symbol in symbols:
        for i in held:
            lines[i].append(symbol)
    flat = np.asarray([symbol for line in lines for symbol in line], np.int64)
    owner = np.repeat(np.arange(len(items)), [len(line) for line in lines])
    while len(flat) > 1:
        limit = n_terms + len(nodes)
        pair = np.where(owner[1:] == owner[:-1], flat[:-1] * limit + flat[1:], -1)
        values, where, counts = np.unique(pair, return_inverse=True, return_counts=True)
        often = np.where(pair >= 0, counts[where], 0)
        before, after = np.append(0, often[:-1]), np.append(often[1:], 0)
        chosen = (often > 1) & (often > before) & (often >= after)
        used = np.bincount(where[chosen], minlength=len(values))
        chosen &= used[where] > 1
        chosen[1:] &= ~chosen[:-1]
        used = np.bincount(where[chosen], minlength=len(values))
        chosen &= used[where] > 1
        if not chosen.any():
            break
        new = np.unique(where[chosen])
        number = np.zeros(len(values), np.int64)
        number[new] = limit + np.arange(len(new))
        nodes.extend(np.asarray([value // limit, value % limit]) for value in values[new].tolist())
        left = np.flatnonzero(chosen)
        flat[left] = number[where[left]]
        stays = np.ones(len(flat), bool)
        stays[left + 1] = False
        flat, owner = flat[stays], owner[stays]
    ends = np.searchsorted(owner, np.arange(len(items) + 1))
    return nodes, [np.concatenate([np.asarray(kept[i], np.int64), flat[ends[i]: ends[i + 1]]]) for i in range(len(items))]


def _mine(block: pd.DataFrame) -> pd.DataFrame:
    """The DAG of one block, a row per term, inner node and item."""
    block = block.sort_values("slot")
    vocabulary = sorted(set().union(*[set(terms) for terms in block["terms"]]))
    number = {term: i for i, term in enumerate(vocabulary)}
    nodes, roots = share_sums([np.asarray([number[t] for t in terms], np.int64) for terms in block["terms"]], len(vocabulary))
    rows = [("term", i, term, []) for i, term in enumerate(vocabulary)]
    rows += [("node", i, None, children.tolist()) for i, children in enumerate(nodes)]
    rows += [("item", slot, None, children.tolist()) for slot, children in zip(block["slot"], roots)]
    out = pd.DataFrame(rows, columns=["kind", "number", "term", "children"])
    return out.assign(block=block["block"].iloc[0])


class _Vocabulary:
    """Terms by hash, with their bytes for the comparison."""

    def __init__(self, terms: list[str]):
        raw = [term.encode() for term in terms]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(term) for term in raw])]).astype(np.int64)
        hashes = range_hash(prefix_hash(self.data), self.at[:-1], self.at[1:])
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if len(np.unique(self.sorted)) < len(self.sorted):
            raise ValueError("two terms of a block have one 64-bit hash")

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the ranges are terms, their numbers): found by hash, compared byte by byte."""
        if not len(self.sorted) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = range_hash(prefix_hash(data), start, end)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[at] == hashes)
        term = self.order[at[hit]]
        size = end[hit] - start[hit]
        same = size == self.at[term + 1] - self.at[term]
        hit, term, size = hit[same], term[same], size[same]
        begin = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(begin, size)
        equal = data[np.repeat(start[hit], size) + inside] == self.data[np.repeat(self.at[term], size) + inside]
        good = np.add.reduceat(equal, begin) == size if len(begin) else np.zeros(0, bool)
        return hit[good], term[good]


def _postings(documents: DataFrame, vocabulary: _Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of every document: all its terms counted, and how often it holds those of the vocabulary."""
    n_terms = max(len(vocabulary.at) - 1, 1)

    def run(batches):
        for batch in batches:
            for first, last, data, at in chunks(batch.column(1)):
                data = LOWER[data]
                start, end, row = term_ranges(data, at)
                n = np.bincount(row, minlength=last - first)
                hit, term = vocabulary.find(data, start, end)
                keys, counts = np.unique(row[hit] * n_terms + term, return_counts=True)
                bounds = np.searchsorted(keys, np.arange(last - first + 1) * n_terms).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:last], pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array((keys % n_terms).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.astype(np.int64)))], names=["doc_id", "n", "terms", "counts"])
        release_memory()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class _Best:
    """The k best documents of each item so far; equal scores by ascending doc_id, null last."""

    def __init__(self, n_items: int, k: int):
        self.n_items, self.k, self.least = n_items, k, np.ones(n_items, np.int64)
        self.kept, self.size = [], 0

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        self.kept.append((item, scores[item, at], doc[at], null[at]))
        self.size += len(item)
        if self.size > 4 * self.k * self.n_items:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        item, score, doc, null = (np.concatenate(column) for column in zip(*self.kept))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        good = rank < self.k
        self.kept = [(item[good], score[good], doc[good], null[good])]
        self.size = int(good.sum())
        return self.kept[0]


def _evaluate(postings: DataFrame, weights: np.ndarray, nodes: list[np.ndarray], roots: list[np.ndarray], slots: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """(slot, doc_id, score): the k best documents of each item in each task."""
    n_terms = len(weights)
    width = max(16, min(2048, ACCUMULATORS // max(n_terms + len(nodes) + len(roots), 1)))

    def run(batches):
        best = _Best(len(roots), k)
        sums = np.zeros((n_terms + len(nodes), width), np.int64)
        scores = np.zeros((len(roots), width), np.int64)
        for batch in batches:
            ids, length = batch.column(0), batch.column(1).to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            for first in range(0, batch.num_rows, width):
                part = batch.slice(first, width)
                size = part.num_rows
                held = part.column(2)
                per = np.diff(held.offsets.to_numpy())
                term, count = held.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                if not len(term):
                    continue
                m = 50 + (50 * length[first: first + size] * n_docs) // n_words
                at = np.repeat(np.arange(size), per)
                sums[:n_terms] = 0
                sums[term, at] = weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[at]))
                for i, children in enumerate(nodes):
                    np.sum(sums[children], axis=0, out=sums[n_terms + i])
                for i, children in enumerate(roots):
                    np.sum(sums[children], axis=0, out=scores[i])
                best.add(scores[:, :size], doc[first: first + size], null[first: first + size])
        if best.kept:
            item, score, found, missing = best.prune()
            yield pa.RecordBatch.from_arrays([pa.array(slots[item]), pa.array(found, mask=missing), pa.array(score)], names=["slot", "doc_id", "score"])
        release_memory()

    return postings.mapInArrow(run, "slot long, doc_id long, score long")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 50, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of ``items`` (item_id, text).

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. Equal scores go by ascending
    doc_id, null last. A null text has no terms. Repeated documents are ranked each, repeated items have a ranking each, an
    item without terms or an empty table of either kind gives no rows, and other columns are not looked at.

    Jobs run while the frame is built: one pass over the documents per block of ``block_entries`` terms of items.
    """
    spark = documents.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(PATTERN), 0))
    listed = items.select("item_id", F.coalesce(terms, F.array().cast("array<string>")).alias("terms")).where(F.size("terms") > 0)
    listed = shared_table(listed.withColumn("slot", F.monotonically_increasing_id()), "items")
    n_blocks = -(-(listed.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_entries)
    blocks = listed.select("slot", "terms", F.pmod(F.xxhash64("slot"), F.lit(max(n_blocks, 1))).cast("int").alias("block"))
    plans = shared_table(blocks.groupBy("block").applyInPandas(_mine, "kind string, number long, term string, children array<long>, block int"), "plans")
    results = []
    for block in range(n_blocks):
        plan = plans.where(F.col("block") == block).toPandas().sort_values("number")
        kinds = {kind: plan[plan["kind"] == kind] for kind in ("term", "node", "item")}
        if not len(kinds["item"]):
            continue
        postings = shared_table(_postings(documents, _Vocabulary(kinds["term"]["term"].tolist())), "postings")
        n_docs, n_words = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not n_words:
            continue
        found = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
        weights = np.zeros(len(kinds["term"]), np.int64)
        for term, df in zip(found["term"].tolist(), found["df"].tolist()):
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        nodes, roots = ([np.asarray(c, np.int64) for c in kinds[kind]["children"]] for kind in ("node", "item"))
        best = _evaluate(postings, weights, nodes, roots, kinds["item"]["number"].to_numpy(np.int64), n_docs, n_words, k)
        results.append(shared_table(best, "best"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").select(F.col("item_id").cast(items.schema["item_id"].dataType), "rank", "doc_id", "score")
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    order = W.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(listed.select("slot", "item_id"), "slot").select("item_id", "rank", "doc_id", "score")
