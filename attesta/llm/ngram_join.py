"""Similarity join of documents by the Jaccard similarity of their word n-grams, with a count-vector R-tree.

1. Every text becomes its set of n-gram hashes. Texts with the same set form a class and are one from here on.
2. Sets that reach the similarity share one of their ``size - needed + 1`` first n-grams in any common order. The order
   puts frequent n-grams last, so sets meet in buckets of rare n-grams. N-grams of passages that many texts share hardly
   ever make a bucket, and no n-gram is dropped: a set of frequent n-grams only still meets in their buckets.
3. Every set is a point of group counts (``count_tree``). In three rounds each member of a bucket is held against one
   centre of the bucket, by the bound and then exactly, and what links is contracted: a group of copies of any size costs
   few comparisons per member and round. In the first round a set meets the centre of most of its buckets before others.
4. In buckets that still hold different components, an R-tree over the members' points finds all pairs of different
   components whose summed coordinate minima reach the overlap they need. The members of such pairs, not the pairs, go on
   with their whole sets to a task of the bucket that compares them exactly, contracts at once what links, and tells only
   links that join two components: fewer than members.
5. Components of all links are labelled by their smallest doc_id.

Exact comparisons work on the whole sets, read again from the texts of just those documents. Sets are told apart by a
64-bit hash of their n-gram hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.batches import Words, chunks, mix, release_memory, run_sums, window_hashes
from attesta.llm.components import components
from attesta.llm.count_tree import CountTree, bound_holds, points
from attesta.llm.shared import bitmap_of, bitmap_place, in_bitmap, shared_table

FREQUENT_IN_BATCH = 4
PAIRS_PER_TASK = 256
BLOCK = 1024
BLOCK_GRAMS = 1 << 20
REMEMBERED_PAIRS = 1 << 20


def sets_of(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted set of n-grams of every text; a text with fewer words than n is one n-gram."""
    words = Words(data, at)
    hashes = words.hashes()
    grams = window_hashes(hashes, width)
    rows = words.row[: len(grams)]
    inside = rows == words.row[width - 1: width - 1 + len(grams)]
    grams, rows = grams[inside], rows[inside]
    for i in np.flatnonzero((words.count > 0) & (words.count < width)).tolist():
        own = hashes[words.first[i]: words.first[i + 1]]
        grams = np.append(grams, mix(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(own.tolist())) % 2**64], np.uint64) + np.uint64(len(own))))
        rows = np.append(rows, i)
    order = np.argsort(grams)
    order = order[np.argsort(rows[order].astype(np.uint16 if len(at) < 1 << 16 else np.int64), kind="stable")]
    grams, rows = grams[order], rows[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[first], rows[first]
    return grams, np.searchsorted(rows, np.arange(len(at)))


def classes_of(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for every set that depends on its elements only."""
    return mix(run_sums(mix(grams), bounds) + mix(run_sums(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), bounds)) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def read_sets(documents: DataFrame, width: int) -> DataFrame:
    """One table of two kinds of rows: per document (doc_id, class, size, point), and n-grams found often in one batch
    (class: n-gram, size: in how many different sets), which only help to order n-grams."""
    def run(batches):
        for b in batches:
            seen, often = set(), []
            for first, last, data, at in chunks(b.column(1)):
                grams, bounds = sets_of(data, at, width)
                names, sizes = classes_of(grams, bounds), np.diff(bounds)
                new = np.array([c not in seen and not seen.add(c) for c in names.tolist()], bool)
                often.append(grams[np.repeat(new, sizes)])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(first, last - first), pa.array(names), pa.array(sizes), pa.array(points(grams, bounds), pa.binary())], names=["doc_id", "class", "size", "point"])
            found, n = np.unique(np.concatenate([*often, np.zeros(0, np.uint64)]), return_counts=True)
            found, n = found[n >= FREQUENT_IN_BATCH], n[n >= FREQUENT_IN_BATCH]
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(found), pa.int64()), pa.array(found.view(np.int64)), pa.array(n, pa.int64()), pa.nulls(len(found), pa.binary())], names=["doc_id", "class", "size", "point"])
        release_memory()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return shared_table(rows.mapInArrow(run, "doc_id long, class long, size long, point binary"), "sets")


def frequent_grams(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts), sorted by n-gram: those seen most often, at most ``most`` of them. They are put last in the order
    of n-grams, which is a matter of speed only: any order finds all pairs."""
    counts = found.groupBy(F.col("class").alias("gram")).agg(F.sum("size").alias("n"))
    level = F.floor(F.log2("n") * 16)
    histogram = counts.groupBy(level.alias("level")).agg(F.count("*").alias("grams")).orderBy(F.desc("level")).toPandas()
    fits = histogram[histogram["grams"].cumsum() <= most]
    if not len(fits):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(level >= int(fits["level"].iloc[-1])).toPandas()
    grams = table["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], table["n"].to_numpy(np.int64)[order]


def bucket_entries(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """(key, class): every class under each of its first n-grams, once per partition."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often, count = shared.value
        seen: set[int] = set()
        for b in batches:
            for _, _, data, at in chunks(b.column(0)):
                grams, bounds = sets_of(data, at, width)
                names, sizes = classes_of(grams, bounds), np.diff(bounds)
                new = np.array([c not in seen and not seen.add(c) for c in names.tolist()], bool) & (sizes > 0)
                keep = np.repeat(new, sizes)
                rows, own = np.repeat(np.arange(len(sizes)), sizes)[keep], grams[keep]
                weight = np.zeros(len(own), np.int64)
                if len(often) and len(own):
                    place = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    weight = np.where(often[place] == own, count[place], 0)
                # inside a set: rare n-grams by hash, then frequent ones by count
                special = np.flatnonzero(weight)
                order = np.arange(len(own))
                if len(special):
                    order = np.lexsort((own, weight, rows))
                rank = np.arange(len(own)) - np.repeat(np.cumsum(sizes[new]) - sizes[new], sizes[new])
                first = rank < np.repeat(sizes[new] - (-(-percent * sizes[new] // 100)) + 1, sizes[new])
                yield pa.RecordBatch.from_arrays([pa.array(own[order][first].view(np.int64)), pa.array(names[rows[order][first]])], names=["key", "class"])
        release_memory()

    return documents.select("text").mapInArrow(run, "key long, class long")


def shared_buckets(entries: DataFrame) -> DataFrame:
    """(key, class, centre) of buckets with at least two classes; the centre is the bucket's smallest class."""
    return marked_buckets(entries).drop("two")


def marked_buckets(entries: DataFrame) -> DataFrame:
    """``shared_buckets`` with a column that tells most buckets of exactly two classes (two): those inside one Arrow batch.

    Entries are shuffled and sorted by key once; a task walks along them and remembers one bucket's key and centre, so no
    bucket is ever gathered.
    """
    def run(batches):
        key, centre, last, open_ = None, None, None, False
        for b in batches:
            k, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            starts = np.ones(len(k), bool)
            starts[1:] = k[1:] != k[:-1]
            starts[0] = key is None or k[0] != key
            group = np.cumsum(starts) - int(starts[0])  # 0: the batch's first bucket, which may go on from the batch before
            begin = np.flatnonzero(starts)
            heads = c[begin] if starts[0] else np.concatenate([[centre], c[begin]])
            centres = heads[group]
            before = np.concatenate([[last if not starts[0] else c[0]], c[:-1]])
            fresh = ~starts & (c != before)  # another class than the one before, in the same bucket
            # the centre itself is told once its bucket has a second class
            second = np.flatnonzero(fresh)
            told = second[np.concatenate([[True], group[second][1:] != group[second][:-1]])] if len(second) else second
            if open_ and len(told) and not starts[0] and group[told[0]] == 0:
                told = told[1:]
            # a bucket that begins in this batch, behind its start, and ends before its last row lies inside it
            two = np.bincount(group[second], minlength=int(group[-1]) + 1) == 1
            two[[0, -1]] = False
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([k[fresh], k[told]])), pa.array(np.concatenate([c[fresh], centres[told]])), pa.array(np.concatenate([centres[fresh], centres[told]])),
                pa.array(two[np.concatenate([group[second], group[told]])])], names=["key", "class", "centre", "two"])
            same = k[-1] == key
            has = bool((fresh & (k == k[-1])).any())
            open_ = (open_ and same) or has
            key, centre, last = int(k[-1]), int(centres[-1]), int(c[-1])

    return shared_table(entries.repartition("key").sortWithinPartitions("key", "class").mapInArrow(run, "key long, class long, centre long, two boolean"), "buckets")


def _surviving(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and summed coordinate minima allow the similarity."""
    def run(batches):
        for b in batches:
            a, z, sa, pa_, sb, pb = (c.to_pylist() for c in b.columns)
            fits = [bound_holds(w, x, y, v, percent) for x, w, v, y in zip(sa, pa_, sb, pb)]
            mask = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    one = classes.select(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("point").alias("point_a"))
    two = classes.select(F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("point").alias("point_b"))
    # pairs are told apart by size on narrow rows before any point travels
    sized = pairs.join(one.drop("point_a"), "a").join(two.drop("point_b"), "b").where(
        100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")).select("a", "b")
    full = sized.join(one, "a").join(two, "b").select("a", "b", "size_a", "point_a", "size_b", "point_b")
    return shared_table(full.mapInArrow(run, "a long, b long"), "pairs")


def _sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, grams) of at least the wanted classes (column ``class``), read again from the documents that stand for them.

    A bitmap of these documents' ids spares most others; the few it lets through fall out of the joins that follow.
    """
    ids = shared_table(wanted.join(classes, "class").select("rep"), "wanted")
    bitmap = documents.sparkSession.sparkContext.broadcast(bitmap_of(ids, F.col("rep")))
    rows = documents.select(bitmap_place(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))).alias("place"), "text")

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            text = b.column(1).filter(pa.array(in_bitmap(bitmap.value, b.column(0).to_numpy())))
            for _, _, data, at in chunks(text):
                grams, bounds = sets_of(data, at, width)
                names = classes_of(grams, bounds).tolist()
                keep = [i for i, c in enumerate(names) if c not in seen and not seen.add(c)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[i] for i in keep], pa.int64()), pa.array([grams[bounds[i]: bounds[i + 1]].tobytes() for i in keep], pa.binary())], names=["class", "grams"])

    return shared_table(rows.mapInArrow(run, "class long, grams binary"), "grams")


def _links(documents: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity, by comparing their whole sets.

    All pairs of one ``a`` meet its set in a task, in lots of ``PAIRS_PER_TASK``, to each of which a copy of the set goes.
    """
    found = _sets(documents, classes, pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct(), width)
    numbered = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").withColumn(
        "lot", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PAIRS_PER_TASK)).cast("int"))
    lots = numbered.select("a", "lot").distinct()
    partners = numbered.join(found, numbered["b"] == found["class"]).select("a", "lot", F.lit(1).alias("side"), "b", "grams")
    owners = lots.join(found, lots["a"] == found["class"]).select("a", "lot", F.lit(0).alias("side"), F.col("a").alias("b"), "grams")
    meeting = owners.unionByName(partners).repartition("a", "lot").sortWithinPartitions("a", "lot", "side")

    def compare(batches):
        name, own = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, side, b, grams in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)]):
                other = np.frombuffer(grams, np.uint64)
                if side == 0:
                    name, own = a, other
                elif a == name:
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    overlap = int((own[place] == other).sum())
                    if 100 * overlap >= percent * (len(own) + len(other) - overlap):
                        a_out.append(a)
                        b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
        release_memory()

    return shared_table(meeting.mapInArrow(compare, "a long, b long").distinct(), "links")


def _open_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, class, root, members) of buckets that still hold more than one component.

    Buckets of two are left out, as their only pair is a star's; so are all but one of the buckets with the same members,
    told by their number and two exclusive-or sums of 64-bit values.
    """
    named = buckets.select("key", "class").join(roots, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    known = named.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y"))
    mixed = known.where("low < high AND members > 2").groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members")
    return shared_table(named.join(mixed, "key"), "open")


def bounded_partners(sizes: np.ndarray, raw: list[bytes], label: np.ndarray, blocks: np.ndarray, percent: int):
    """(member, others) of all pairs of different labels within the bound, by R-trees; labels may change on the way.

    Members of one block are not held against each other if there are two blocks.
    """
    across = len(np.unique(blocks)) > 1
    sharp = np.array([len(r) for r in raw])
    # partners differ in size by less than a factor of two, so in sharpness by one step at most: a tree for each two steps
    for step in np.unique(sharp).tolist():
        members = np.flatnonzero((sharp == step) | (sharp == 2 * step))
        if len(np.unique(label[members])) < 2:
            continue
        tree = CountTree(sizes[members], [raw[m] for m in members.tolist()], percent)
        order = members[tree.order]
        for i, me in enumerate(order.tolist()):
            near = order[tree.partners(i)]
            near = near[(label[near] != label[me]) & ((blocks[near] != blocks[me]) | (not across))]
            if len(near):
                yield me, near


def linked_members(names: np.ndarray, roots: np.ndarray, blocks: np.ndarray, grams: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links (smaller name, larger name) among sets of different components, found by an R-tree and compared exactly.

    Components grow while the search goes on, so the links are a forest over them.
    """
    sizes = np.array([len(g) // 8 for g in grams])
    hashes = np.concatenate([np.frombuffer(g, np.uint64) for g in grams])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.unique(hashes, return_inverse=True)[1]
    own = np.zeros(len(hashes), bool)  # own[code]: whether the set in hand has it
    label = np.unique(roots, return_inverse=True)[1]
    links = []
    for me, near in bounded_partners(sizes, points(hashes, begin), label, blocks, percent):
        own[codes[begin[me]: begin[me + 1]]] = True
        ends = np.cumsum(sizes[near])
        place = np.arange(ends[-1]) + np.repeat(begin[near] - (ends - sizes[near]), sizes[near])
        overlap = np.add.reduceat(own[codes[place]].astype(np.int64), ends - sizes[near])
        own[codes[begin[me]: begin[me + 1]]] = False
        for other in near[100 * overlap >= percent * (sizes[me] + sizes[near] - overlap)].tolist():
            if label[other] != label[me]:
                label[label == label[other]] = label[me]
                links.append((min(int(names[me]), int(names[other])), max(int(names[me]), int(names[other]))))
    return links


def _by_block(batches):
    """The rows of each (key, low, high), the leading columns, of batches sorted by them."""
    name, rows = None, []
    for b in batches:
        for key, low, high, *row in zip(*[x.to_pylist() for x in b.columns]):
            if (key, low, high) != name:
                if len(rows) > 1:
                    yield name, rows
                name, rows = (key, low, high), []
            rows.append(row)
    if len(rows) > 1:
        yield name, rows


def partners_by_size(percent: int):
    """Of rows (key, low, high, class, root, block, size) sorted by the first three, those with a partner of another root
    whose size allows the similarity."""
    def run(batches):
        held = None
        for b in batches:  # a block may go on in the next batch
            rows = [c.to_numpy() for c in b.columns]
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
            if not len(rows[0]):
                continue
            begins = np.flatnonzero(np.any([c[1:] != c[:-1] for c in rows[:3]], axis=0)) + 1
            last = int(begins[-1]) if len(begins) else 0
            held = [c[last:] for c in rows]
            yield kept([c[:last] for c in rows], np.concatenate([[0], begins])[: len(begins)])
        if held is not None:
            yield kept(held, np.zeros(1, np.int64))

    def kept(rows, begins):
        _, low, high, _, root, block, size = rows
        keep = np.zeros(len(root), bool)
        for s, e in zip(begins.tolist(), np.append(begins[1:], len(root)).tolist()):
            if e - s < 2:
                continue
            mine, n, part = root[s:e], size[s:e], block[s:e]
            fits = (mine[:, None] != mine) & (100 * n[:, None] >= percent * n) & (100 * n >= percent * n[:, None])
            if low[s] < high[s]:
                fits &= part[:, None] != part
            keep[s:e] = fits.any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows], names=["key", "low", "high", "class", "root", "block", "size"])

    return run


def alike_once(left: DataFrame) -> DataFrame:
    """Of blocks that hold the same members, dealt alike, the one with the smallest name: their pairs are the same.

    Two exclusive-or sums of 64-bit values and their number tell members apart.
    """
    block = ["key", "low", "high"]
    side = F.when(F.col("low") == F.col("high"), 0).when(F.col("block") == F.col("low"), 1).otherwise(2)
    marks = left.groupBy(*block).agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("class", side)).alias("x"), F.bit_xor(F.xxhash64(side, "class")).alias("y"))
    first = marks.groupBy("members", "x", "y").agg(F.min(F.struct(*block)).alias("first")).select("first.*")
    return shared_table(left.join(first, block, "left_semi"), "alike")


def _tree_links(documents: DataFrame, open_buckets: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components which the buckets' members can link, by R-trees.

    A bucket with more than ``BLOCK`` members or ``BLOCK_GRAMS`` n-grams is dealt into blocks, and each two blocks meet in a
    task of their own. Sizes travel first, points follow for members that have a partner of a fitting size, and whole sets
    for members that have a partner within the bound.
    """
    known = open_buckets.join(classes.select("class", "size"), "class")
    load = known.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    block = ["key", "low", "high"]
    dealt = known.join(load, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class", "root", "block", "size")
    sized = dealt.repartition(*block).sortWithinPartitions(*block, "class").mapInArrow(
        partners_by_size(percent), "key long, low int, high int, class long, root long, block int, size long")
    # points, the wide part, travel once, with the members that sizes leave
    pointed = shared_table(sized, "sized").join(classes.select("class", "point"), "class").select(*block, "class", "root", "block", "size", "point")

    def prune(batches):
        told: set[tuple[int, int]] = set()  # pairs that meet in many buckets of a task count in the first only
        for (key, low, high), rows in _by_block(batches):
            names, roots, blocks, sizes = (np.array(x) for x in list(zip(*rows))[:4])
            wanted = np.zeros(len(rows), bool)
            for me, near in bounded_partners(sizes, [r[4] for r in rows], roots, blocks, percent):
                mine = int(names[me])
                new = [o for o, n in zip(near.tolist(), names[near].tolist())
                       if (pair := (min(mine, n), max(mine, n))) not in told and not told.add(pair)]
                wanted[new] = True
                wanted[me] |= bool(new)
            if len(told) > REMEMBERED_PAIRS:
                told.clear()
            n = int(wanted.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array([key] * n, pa.int64()), pa.array([low] * n, pa.int32()), pa.array([high] * n, pa.int32()),
                pa.array(names[wanted]), pa.array(roots[wanted]), pa.array(blocks[wanted].astype(np.int32))], names=[*block, "class", "root", "block"])
        release_memory()

    def compare(batches):
        for _, rows in _by_block(batches):
            links = linked_members(*(np.array(x) for x in list(zip(*rows))[:3]), [r[3] for r in rows], percent)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])
        release_memory()

    left = alike_once(shared_table(pointed.repartition(*block).sortWithinPartitions(*block, "class").mapInArrow(
        prune, "key long, low int, high int, class long, root long, block int"), "left"))
    grams = _sets(documents, classes, left.select("class").distinct(), width).dropDuplicates(["class"])
    full = left.join(grams, "class").select(*left.columns, "grams")
    return full.repartition(*block).sortWithinPartitions(*block, "class").mapInArrow(compare, "a long, b long").distinct()


def ngram_join(documents: DataFrame, width: int = 5, percent: int = 75, frequent: int = 1 << 18) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, n_links.

    Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``; two documents link when 100 * overlap >= percent * union of
    their n-gram sets. component_id is the smallest doc_id reachable by links, the document's own included. A document
    without words (or null text) has no n-grams and links with nothing. class_id names the set: documents with one
    class_id have equal sets and are linked; n_links counts the links found between the class and others (links that
    contraction made unnecessary are not looked for). A null doc_id takes part and has the component of its set; repeated
    rows are rows of one class; no rows give none. ``frequent`` bounds the list that orders n-grams, not the result.
    """
    read = read_sets(documents, width)
    # rows with a point are documents, the others frequent n-grams
    per_document = read.where("point IS NOT NULL")
    classes = shared_table(per_document.where("size > 0").groupBy("class").agg(
        F.min(F.coalesce("doc_id", F.lit(-1).cast("long"))).alias("rep"), F.min("doc_id").alias("first_id"), F.min("size").alias("size"), F.min("point").alias("point")), "classes")
    buckets = marked_buckets(bucket_entries(documents, frequent_grams(read.where("point IS NULL"), frequent), width, percent))
    meetings = shared_table(
        buckets.where("class <> centre").groupBy(F.col("centre").alias("a"), F.col("class").alias("b")).agg(F.count("*").alias("n")), "meetings")
    tested = _surviving(meetings.select("a", "b"), classes, percent)
    # each set meets the centre of most of its buckets first, and the others only if that leaves them apart
    best = shared_table(tested.join(meetings, ["a", "b"]).groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "best")
    links = _links(documents, classes, best, width, percent)
    roots = components(links)
    root_a, root_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    rest = tested.join(best, ["a", "b"], "left_anti").join(root_a, "a", "left").join(root_b, "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = shared_table(links.unionByName(_links(documents, classes, shared_table(rest, "rest"), width, percent)), "links")
    open_ = _open_buckets(buckets.where("NOT two"), components(links))
    # two more rounds among what is left: around the members that share most n-grams (an original shares more than its
    # changed copies), then around others
    shared = buckets.groupBy("class").agg(F.count("*").alias("shared"))
    for order in (F.col("shared"), F.xxhash64("class")):
        ranked = open_.join(shared, "class").select("key", F.struct(order.alias("order"), F.col("class").alias("centre"), F.col("root").alias("centre_root")).alias("c"))
        centre = ranked.groupBy("key").agg(F.max("c").alias("c")).select("key", "c.centre", "c.centre_root")
        stars = open_.join(centre, "key").where("root <> centre_root").select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct()
        stars = stars.join(tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        more = _surviving(stars, classes, percent)
        tested = tested.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        links = shared_table(links.unionByName(_links(documents, classes, more, width, percent)), "links")
        open_ = _open_buckets(open_.select("key", "class"), components(links))
    links = shared_table(links.unionByName(_tree_links(documents, open_, classes, width, percent)).distinct(), "links")
    roots = components(links)
    named = classes.select("class", "first_id").join(roots, F.col("class") == F.col("node"), "left").select("class", "first_id", F.coalesce("root", "class").alias("root"))
    labels = named.groupBy("root").agg(F.min("first_id").alias("component"))
    per_class = shared_table(named.join(labels, "root").select(F.col("class").alias("class_id"), "component"), "labels")
    degree = links.select(F.col("a").alias("of")).unionByName(links.select(F.col("b").alias("of"))).groupBy("of").agg(F.count("*").alias("n_links"))
    return (
        per_document.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("class")).alias("class_id"))
        .join(per_class, "class_id", "left").join(degree, F.col("class_id") == F.col("of"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
