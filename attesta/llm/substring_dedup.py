"""Removing repeated byte strings: every byte that lies in a string of ``length`` bytes which also starts earlier.

Prefix polynomial hashes give the hash of any byte range in constant time, so the common extension of two suffixes is
found by binary search over hashes (``common_extension``) and suffixes are sorted by mergesort with comparisons of
logarithmic cost (``suffix_mergesort``); strings that come out equal are compared byte by byte.

Strings meet across documents without shuffling every suffix:

1. Each string of ``length`` bytes is named after its anchor: of all its ``GRAM``-byte grams the one with the smallest
   hash, the leftmost of equals. Equal strings have equal anchors at equal places. Neighbouring strings with one anchor
   form a region; there is about one region for 35 bytes.
2. Regions are shuffled by their anchor's hash and sorted. A region whose whole bytes came earlier is removed altogether.
   Inside long repeats all regions are of this kind.
3. Where one anchor has regions of different bytes (at the ends of repeats), the first region of each kind is shuffled as
   bytes by its anchor, and a task sorts the strings of whole anchors by suffix mergesort. Of equal strings all but the
   first are removed.
4. An anchor with more than ``HOT_REGIONS`` kinds of regions is not gathered: its strings are sorted where they lie, and
   each distinct one goes on by two 64-bit hashes, its own and its anchor's.

All other steps walk along sorted rows with a constant state, so a passage that very many documents share needs no
gathering.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.batches import chunks, mix, prefix_hash, range_hash
from attesta.llm.shared import bitmap_of, bitmap_place, in_bitmap, shared_table

GRAM = 32
HOT_REGIONS = 4096
LAST_ID = 9223372036854775807
_LOW = np.uint64(0xFFFFFFFF)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from running minima inside blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


class Regions:
    """Regions of a chunk of texts: row, first and last string start, anchor place, and the hashes of both."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int):
        self.data, self.at, self.length = data, at, length
        self.prefix = prefix_hash(data)
        count = np.maximum(np.diff(at) - length + 1, 0)  # strings of each row
        starts = np.arange(int(count.sum())) + np.repeat(at[:-1] - (np.cumsum(count) - count), count)
        if not len(starts):
            self.row = self.low = self.high = self.anchor = np.zeros(0, np.int64)
            self.gram = self.body = self.sides = np.zeros(0, np.int64)
            return
        grams = range_hash(self.prefix, np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1))
        packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_min(packed, length - GRAM + 1)[starts] & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.low, self.high = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        self.anchor = anchor[first]
        self.row = np.searchsorted(at, self.low, side="right") - 1
        self.gram = grams[self.anchor].view(np.int64)
        body = range_hash(self.prefix, self.low, self.high + length)
        self.body = mix(body ^ (self.anchor - self.low).astype(np.uint64)).view(np.int64)
        # a string takes at least half of its bytes beside the anchor from one side: 16 bits of the hash of each such half
        half = (length - GRAM + 1) // 2
        left = range_hash(self.prefix, np.maximum(self.anchor - half, at[self.row]), self.anchor)
        right = range_hash(self.prefix, self.anchor + GRAM, np.minimum(self.anchor + GRAM + half, at[self.row + 1]))
        self.sides = ((left >> np.uint64(48)) << np.uint64(16) | (right >> np.uint64(48))).astype(np.int64)

    def repeated_in_row(self) -> np.ndarray:
        """How often the same region came before in its row."""
        order = np.lexsort((self.low, self.body, self.row))
        row, body = self.row[order], self.body[order]
        new = np.ones(len(order), bool)
        new[1:] = (row[1:] != row[:-1]) | (body[1:] != body[:-1])
        group = np.flatnonzero(new)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) - group[np.cumsum(new) - 1] if len(order) else 0
        return out


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes (up to ``limit``) agree from places a and b on, by binary search over range hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = range_hash(prefix, a + low, a + middle) == range_hash(prefix, b + low, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _before(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as the string at a sorts before, with or after the one at b; equal hashes are verified by bytes."""
    extent = common_extension(prefix, a, b, length)
    at = np.minimum(extent, length - 1)
    order = np.sign(data[a + at].astype(np.int16) - data[b + at].astype(np.int16))
    equal = extent == length
    order[equal] = 0
    for i in np.flatnonzero(equal & (a != b)).tolist() if equal.sum() < 1 << 12 else []:
        x, y = data[a[i]: a[i] + length].tobytes(), data[b[i]: b[i] + length].tobytes()
        order[i] = (x > y) - (x < y)
    if equal.sum() >= 1 << 12:
        spots = np.flatnonzero(equal)
        steps = np.arange(length)
        for part in np.array_split(spots, len(spots) // 4096 + 1):
            differs = data[a[part, None] + steps] != data[b[part, None] + steps]
            wrong = np.flatnonzero(differs.any(axis=1))
            at = differs[wrong].argmax(axis=1)
            x, y = data[a[part[wrong]] + at].astype(np.int16), data[b[part[wrong]] + at].astype(np.int16)
            order[part[wrong]] = np.sign(x - y)
    return order


def suffix_mergesort(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Order of string starts inside each segment (equal numbers lie together), by bottom-up mergesort of all segments at
    once. The place of an element in a merged run is its own place plus the elements of the other run before it, found by
    binary search with hash comparisons."""
    n = len(starts)
    order = np.arange(n)
    if n < 2:
        return order
    begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.append(begin, n))
    inside = np.arange(n) - np.repeat(begin, size)
    base, total = np.repeat(begin, size), np.repeat(size, size)
    run = 1
    while run < size.max():
        lot = inside // (2 * run)
        right = inside % (2 * run) >= run
        other = base + lot * 2 * run + np.where(right, 0, run)
        other_size = np.clip(np.where(right, run, total - lot * 2 * run - run), 0, run)
        ask = np.flatnonzero(other_size > 0)
        low, high = np.zeros(len(ask), np.int64), other_size[ask].copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            who = ask[open_]
            sign = _before(data, prefix, starts[order[other[who] + middle]], starts[order[who]], length)
            ahead = (sign < 0) | ((sign == 0) & right[who])  # equals of the left run stay before those of the right
            low[open_], high[open_] = np.where(ahead, middle + 1, low[open_]), np.where(ahead, high[open_], middle)
        place = base + lot * 2 * run + inside % run
        place[ask] += low
        place = np.where(other_size > 0, place, np.arange(n))
        merged = np.empty(n, np.int64)
        merged[place] = order
        order = merged
        run *= 2
    return order


def region_rows(documents: DataFrame, length: int) -> DataFrame:
    """(gram, body, doc, sides): every region of every text; a region that a text repeats comes twice at most."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, last, data, at in chunks(b.column(1)):
                r = Regions(data, at, length)
                keep = r.repeated_in_row() < 2
                yield pa.RecordBatch.from_arrays([pa.array(r.gram[keep]), pa.array(r.body[keep]), pa.array(ids[first:last][r.row[keep]], pa.int64()), pa.array(r.sides[keep].astype(np.uint32).view(np.int32))], names=["gram", "body", "doc", "sides"])

    return documents.mapInArrow(run, "gram long, body long, doc long, sides int")


def region_marks(rows: DataFrame) -> DataFrame:
    """(doc, body, kind, gram, sides): 2 the region came in an earlier document, 1 the document repeats it, 0 its anchor has other
    regions as well and this is the first document with this one."""
    def run(batches):
        gram = body = first_doc = first_sides = None
        told = False
        for b in batches:
            out_doc, out_body, out_kind, out_gram, out_sides = [], [], [], [], []
            g, y, d, e = (b.column(i).to_numpy() for i in range(4))
            if not len(g):
                continue
            new_gram = np.ones(len(g), bool)
            new_gram[1:] = g[1:] != g[:-1]
            new_gram[0] = gram is None or g[0] != gram
            new_body = new_gram.copy()
            new_body[1:] |= y[1:] != y[:-1]
            new_body[0] |= body is None or y[0] != body
            # first document of each region, carried over from the batch before where a region goes on
            spots = np.flatnonzero(new_body)
            number = np.cumsum(new_body) - 1
            firsts = d[spots]
            leader = np.where(number >= 0, firsts[np.maximum(number, 0)] if len(spots) else 0, first_doc if first_doc is not None else 0)
            later = ~new_body
            out_doc.append(d[later])
            out_body.append(y[later])
            out_gram.append(g[later])
            out_sides.append(e[later])
            out_kind.append(np.where(d[later] > leader[later], 2, 1))
            # regions of an anchor: all of them are told once there is a second
            gram_no = np.cumsum(new_gram)  # 0: the anchor of the batch before
            of_region = gram_no[spots]
            second = np.zeros(len(spots), bool)
            second[1:] = of_region[1:] == of_region[:-1]
            if len(spots) and not new_gram[spots[0]] and of_region[0] == 0:
                second[0] = True  # its anchor began before this batch
            tell = second.copy()
            tell[:-1] |= second[1:]
            if second.any() and second[0] and not told and gram is not None and of_region[0] == 0:
                out_doc.append(np.array([first_doc]))
                out_body.append(np.array([body]))
                out_gram.append(np.array([gram]))
                out_sides.append(np.array([first_sides]))
                out_kind.append(np.array([0]))
            out_doc.append(d[spots[tell]])
            out_body.append(y[spots[tell]])
            out_gram.append(g[spots[tell]])
            out_sides.append(e[spots[tell]])
            out_kind.append(np.zeros(int(tell.sum()), np.int64))
            if len(spots):
                told = bool(tell[-1])
                body, first_doc, first_sides = int(y[spots[-1]]), int(firsts[-1]), int(e[spots[-1]])
            gram = int(g[-1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(out_doc), pa.int64()), pa.array(np.concatenate(out_body), pa.int64()), pa.array(np.concatenate(out_kind).astype(np.int32)),
                pa.array(np.concatenate(out_gram), pa.int64()), pa.array(np.concatenate(out_sides), pa.int32())], names=["doc", "body", "kind", "gram", "sides"])

    return rows.repartition("gram").sortWithinPartitions("gram", "body", "doc").mapInArrow(run, "doc long, body long, kind int, gram long, sides int")


def _with_marks(documents: DataFrame, marks: DataFrame, columns: str) -> DataFrame:
    """(doc, text, marks) of the documents that have marks; a document's marks are as many as its text has regions."""
    bitmap = documents.sparkSession.sparkContext.broadcast(bitmap_of(marks.select("doc").distinct(), F.col("doc")))

    def run(batches):
        for b in batches:
            mask = pa.array(in_bitmap(bitmap.value, b.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["doc", "text"])

    some = documents.select("doc", "text", bitmap_place(F.col("doc")).alias("place")).mapInArrow(run, "doc long, text binary")
    listed = marks.groupBy("doc").agg(F.collect_list(F.struct(*columns.split())).alias("marks"))
    return some.join(listed, "doc")


def _lists(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each entry, the entries' fields) of a list-of-struct column."""
    counts = np.array([len(x) for x in column], np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), counts), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _pairs_in(row: np.ndarray, value: np.ndarray, in_row: np.ndarray, in_value: np.ndarray) -> np.ndarray:
    """Whether each (row, value) is among the others."""
    key = mix(value.view(np.uint64) ^ mix(row.astype(np.uint64)))
    wanted = np.sort(mix(in_value.view(np.uint64) ^ mix(in_row.astype(np.uint64))))
    if not len(wanted):
        return np.zeros(len(key), bool)
    return wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key


def sort_strings(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, gram: np.ndarray, distance: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int):
    """(order, again): strings sorted so that equal ones lie together by doc and place, and which of them start later than
    the first of their kind. Equal strings have equal anchors at equal distances: only these are sorted against each other."""
    key = mix(gram.view(np.uint64) ^ mix(distance.astype(np.uint64)))
    order = np.lexsort((place, doc, key))
    order = order[suffix_mergesort(data, prefix, starts[order], key[order], length)]  # stable
    starts, key, doc, place = starts[order], key[order], doc[order], place[order]
    first = np.ones(len(order), bool)
    same = np.flatnonzero(key[1:] == key[:-1])
    first[same + 1] = _before(data, prefix, starts[same], starts[same + 1], length) != 0
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
    return order, (doc != doc[lead]) | (place != place[lead])


def _windows(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which region, start) of every string in regions with these first and last starts."""
    count = high - low + 1
    which = np.repeat(np.arange(len(low)), count)
    return which, np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)


def marked_regions(documents: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """The regions marked 0, as bytes (gram, doc, place: first start inside the text, distance to the anchor, text) or, for
    hot anchors, as strings (gram, doc, place, string, again)."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            mark_row, (mark_body, mark_hot) = _lists(b.column(2), ["body", "hot"])
            mark_body, mark_hot = mark_body.astype(np.int64), mark_hot.astype(bool)
            for first, last, data, at in chunks(b.column(1)):
                r = Regions(data, at, length)
                near = (mark_row >= first) & (mark_row < last)
                row, body, hot = mark_row[near] - first, mark_body[near], mark_hot[near]
                new = r.repeated_in_row() == 0
                doc = ids[first:last][r.row]
                some = np.flatnonzero(new & _pairs_in(r.row, r.body, row[~hot], body[~hot]))
                raw = data.tobytes()
                n = len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array(r.gram[some]), pa.array(doc[some], pa.int64()), pa.array(r.low[some] - at[r.row[some]]), pa.array((r.anchor - r.low)[some]),
                    pa.array([raw[x:y] for x, y in zip(r.low[some].tolist(), (r.high[some] + length).tolist())], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=_MARKED)
                many = np.flatnonzero(new & _pairs_in(r.row, r.body, row[hot], body[hot]))
                if len(many):
                    which, starts = _windows(r.low[many], r.high[many])
                    own = many[which]
                    place = starts - at[r.row[own]]
                    order, again = sort_strings(data, r.prefix, starts, r.gram[own], r.anchor[own] - starts, doc[own], place, length)
                    own, starts, place = own[order], starts[order], place[order]
                    n = len(own)
                    string = range_hash(r.prefix, starts, starts + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(r.gram[own]), pa.array(doc[own], pa.int64()), pa.array(place), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(string), pa.array(again)], names=_MARKED)

    variants = marks.where("kind = 0").select("doc", "body", "gram", F.shiftright("sides", 16).alias("left"), F.col("sides").bitwiseAND(0xFFFF).alias("right"))
    # regions of one anchor share a string only if they share the half string on one side
    twice = [variants.groupBy("gram", side).agg(F.count("*").alias("n")).where("n > 1").select("gram", side) for side in ("left", "right")]
    variants = variants.join(twice[0], ["gram", "left"], "left_semi").select("doc", "body", "gram").unionByName(
        variants.join(twice[1], ["gram", "right"], "left_semi").select("doc", "body", "gram")).distinct()
    hot = variants.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT_REGIONS).select("gram", F.lit(True).alias("hot"))
    told = variants.join(hot, "gram", "left").select("doc", "body", F.coalesce("hot", F.lit(False)).alias("hot"))
    marked = _with_marks(documents, told, "body hot")
    return shared_table(marked.mapInArrow(run, "gram long, doc long, place long, distance long, text binary, string long, again boolean"), "regions")


_MARKED = ["gram", "doc", "place", "distance", "text", "string", "again"]


def later_in_anchors(rows: DataFrame, length: int) -> DataFrame:
    """(doc, start) of strings in regions given as bytes that also start earlier. Whole anchors are sorted together; none
    has more than ``HOT_REGIONS`` regions."""
    def sort(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        gram, doc, place, distance = (table.column(i).to_numpy() for i in range(4))
        text = table.column(4).combine_chunks()
        parts = []
        for first, last, data, at in chunks(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text, 1 << 40):
            which, starts = _windows(at[:-1], at[1:] - length)
            own = which + first
            inside = starts - at[which]
            order, again = sort_strings(data, prefix_hash(data), starts, gram[own], distance[own] - inside, doc[own], place[own] + inside, length)
            late = order[again]
            parts.append((doc[own][late], (place[own] + inside)[late]))
        docs, found = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*parts) if parts else ([], [])))
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(found)], names=["doc", "start"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            gram = b.column(0).to_numpy()
            if not len(gram):
                continue
            cut = int(np.searchsorted(gram, gram[-1]))  # rows come sorted; the last anchor may go on in the next batch
            if cut or (held and held[-1].column(0)[-1].as_py() != gram[0]):
                whole = [*held, b.slice(0, cut)] if cut else held
                held = []
                yield sort(pa.Table.from_batches(whole))
            held.append(b.slice(cut))
        if held:
            yield sort(pa.Table.from_batches(held))

    given = rows.where("text IS NOT NULL").select("gram", "doc", "place", "distance", "text").repartition("gram").sortWithinPartitions("gram")
    return given.mapInArrow(run, "doc long, start long")


def later_strings(rows: DataFrame) -> DataFrame:
    """(doc, start) of strings of hot anchors that also start earlier, in another document or before in the same one."""
    def run(batches):
        string = gram = doc = start = None
        for b in batches:
            s, g, d, t = (b.column(i).to_numpy() for i in range(4))
            if not len(s):
                continue
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
            new[0] = string is None or s[0] != string or g[0] != gram
            spots = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            lead_doc = np.where(number >= 0, d[spots[np.maximum(number, 0)]] if len(spots) else 0, doc if doc is not None else 0)
            lead_start = np.where(number >= 0, t[spots[np.maximum(number, 0)]] if len(spots) else 0, start if start is not None else 0)
            later = ~new & ((d != lead_doc) | (t != lead_start))
            string, gram, doc, start = int(s[-1]), int(g[-1]), int(lead_doc[-1]), int(lead_start[-1])
            yield pa.RecordBatch.from_arrays([pa.array(d[later]), pa.array(t[later])], names=["doc", "start"])

    hot = rows.where("string IS NOT NULL").select("string", "gram", "doc", F.col("place").alias("start"), "again")
    across = hot.where("NOT again").select("string", "gram", "doc", "start").repartition("string").sortWithinPartitions("string", "gram", "doc", "start")
    return across.mapInArrow(run, "doc long, start long").unionByName(hot.where("again").select("doc", "start"))


def _result(row_id: np.ndarray, data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    """Figures of each text after the byte ranges [low, high) are taken out."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    gone = np.cumsum(edge)[:-1] > 0
    out = []
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own = gone[s:e]
        removed = int(own.sum())
        spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
        rest = data[s:e] if not removed else data[s:e][~own]
        out.append((int(row_id[i]), e - s, removed, spans, hashlib.sha256(rest.tobytes()).hexdigest()))
    return out


_RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64()] * 4 + [pa.string()]
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def substring_dedup(documents: DataFrame, length: int = 100) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed when it lies in a string of ``length`` bytes (of the UTF-8 text, never across documents) that also
    starts earlier: in a document with a smaller doc_id, or earlier in the same document. Strings are judged on the input.
    Overlapping strings count. A null text is empty; texts shorter than ``length`` stay whole; a null doc_id counts as the
    largest, and rows with one doc_id are not held against each other. No rows give none.
    """
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    marks = shared_table(region_marks(region_rows(texts, length)).distinct(), "marks")
    regions = marked_regions(texts, marks, length)
    later = shared_table(later_in_anchors(regions, length).unionByName(later_strings(regions)), "later")
    every = marks.where("kind > 0").select("doc", "body", "kind").unionByName(
        later.select("doc", F.col("start").alias("body"), F.lit(3).alias("kind")))
    touched = shared_table(every.select("doc").distinct(), "touched")
    bitmap = texts.sparkSession.sparkContext.broadcast(bitmap_of(touched, F.col("doc")))

    def untouched(batches):
        for b in batches:
            mask = pa.array(~in_bitmap(bitmap.value, b.column(2).to_numpy()))
            ids = b.column(0).filter(mask).to_numpy()
            for first, last, data, at in chunks(b.column(1).filter(mask)):
                yield _batch(_result(ids[first:last], data, at, np.zeros(0, np.int64), np.zeros(0, np.int64)))

    def cut(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            mark_row, (value, kind) = _lists(b.column(2), ["body", "kind"])
            value = value.astype(np.int64)
            for first, last, data, at in chunks(b.column(1)):
                near = (mark_row >= first) & (mark_row < last)
                row, v, k = mark_row[near] - first, value[near], kind[near]
                r = Regions(data, at, length)
                gone = _pairs_in(r.row, r.body, row[k == 2], v[k == 2])
                gone |= _pairs_in(r.row, r.body, row[k == 1], v[k == 1]) & (r.repeated_in_row() > 0)
                single = at[row[k == 3]] + v[k == 3]
                low, high = np.concatenate([r.low[gone], single]), np.concatenate([r.high[gone], single]) + length
                yield _batch(_result(ids[first:last], data, at, low, high))

    marked = texts.select("doc", "text", bitmap_place(F.col("doc")).alias("place"))
    whole = marked.mapInArrow(untouched, _RESULT)
    listed = every.groupBy("doc").agg(F.collect_list(F.struct("body", "kind")).alias("marks"))

    def some(batches):
        for b in batches:
            mask = pa.array(in_bitmap(bitmap.value, b.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["doc", "text"])

    found = marked.mapInArrow(some, "doc long, text binary").join(listed, "doc", "left").select(
        "doc", "text", F.coalesce("marks", F.array().cast("array<struct<body:bigint,kind:int>>")).alias("marks"))
    out = whole.unionByName(found.mapInArrow(cut, _RESULT))
    return out.select(F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
