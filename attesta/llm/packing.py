"""Best-fit packing of token sequences by hierarchical residual packing.

1. Documents become ids; one longer than the capacity is cut into pieces, shorter ones are never cut.
2. Every partition packs its pieces best-fit, longest first: a piece goes to the bin with the least room that still holds it.
   Bins that are nearly full are sequences.
3. The underfull bins are items of the next level of a tree: each node packs the bins its ``FAN_IN`` child nodes left over,
   again best-fit, until one node is left or a level saves no bin. A level has at least as many nodes as keep each below
   ``NODE_ITEMS`` bins, so what cannot be merged anywhere is never gathered in one task.
4. Where a bin went is a narrow table per level; composed from the top they give each piece its sequence and offset.

Only lengths and numbers are shuffled, never ids.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.batches import release_memory
from attesta.llm.shared import shared_table

DEFAULT_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY = 4096
NEARLY_FULL = 512  # a bin with room for less than this part of the capacity is a sequence
FAN_IN = 8
NODE_ITEMS = 1 << 17
REMEMBERED_WORDS, REMEMBERED_SEGMENTS, REMEMBERED_CHARS = 1 << 19, 1 << 20, 64
ROWS_BYTES = 4 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


# How the tokenizer splits lower-cased text, for the characters up to U+00FF, and the characters of single bytes.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^ \t-\r\x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {byte: 256 + i for i, byte in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class _Segments(dict):
    """Ids of segments; short ones are remembered."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, segment: str) -> bytes:
        if segment.isascii() and segment.isprintable():
            ids = [token.id for token in self.model.tokenize(segment)]
        elif max(segment) <= "\xff":
            ids = [token.id for token in self.model.tokenize(segment.encode().decode("latin-1").translate(_BYTE))]
        else:
            ids = self.tokenizer.encode(segment, add_special_tokens=False).ids
        ids = array("I", ids).tobytes()
        if len(segment) <= REMEMBERED_CHARS:
            self[segment] = ids
        return ids


class WordIds(dict):
    """Ids of words and whole texts (UTF-8) as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space, no token runs across any, and what it does to a word depends on that word only, so words
    are remembered. A new word up to U+00FF is split into segments as the tokenizer would (letters, one digit, other
    characters), and merging a new segment is left to the library's model; any other word goes through the whole library.
    """

    def __init__(self, path: str):
        super().__init__()
        self.segments = _Segments(_tokenizer(path))

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isascii() or max(text) <= "\xff":
            ids = b"".join(map(self.segments.__getitem__, _SPLIT.findall(text.lower())))
        else:
            ids = self.segments[text]
        if len(word) <= REMEMBERED_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        for known, limit in ((self, REMEMBERED_WORDS), (self.segments, REMEMBERED_SEGMENTS)):
            if len(known) > limit:
                known.clear()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """Kept by a Python worker from task to task."""
    return WordIds(path)


def token_pieces(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document: its ids, then ``end_id``, cut only where they exceed ``capacity``.

    ``ids`` is binary, little-endian unsigned 32-bit numbers. A null text counts as empty (one piece that holds the end only),
    a null doc_id stays null, repeated rows give repeated pieces, and other columns are not looked at.
    """
    end = np.asarray([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        words = _word_ids(tokenizer)
        for batch in batches:
            doc, texts = batch.column(0).to_pylist(), batch.column(1)
            first = 0
            while first < len(doc):
                held, rows = 0, ([], [], [], [], [])
                while first < len(doc) and held < ROWS_BYTES:
                    ids = words.encode(texts[first].as_py() or b"") + end
                    held += len(ids)
                    for number, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at: at + step]
                        for column, value in zip(rows, (doc[first], number, at // 4, len(cut) // 4, cut)):
                            column.append(value)
                    first += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])
        release_memory()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset of each item, fill of each bin), items in the given order.

    Bins lie in stacks by room; the set bits of one number tell which rooms occur, so the least room that holds an item is
    the lowest bit at or above its length.
    """
    rooms: dict[int, list[int]] = {}
    bits = 0
    chosen, offsets, fill = [], [], []
    for length in lengths:
        above = bits >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            stack = rooms[room]
            number = stack.pop()
            if not stack:
                bits ^= 1 << room
        else:
            room, number = capacity, len(fill)
            fill.append(0)
        chosen.append(number)
        offsets.append(capacity - room)
        fill[number] += length
        room -= length
        if room:
            rooms.setdefault(room, []).append(number)
            bits |= 1 << room
    return chosen, offsets, fill


def _pack(items: DataFrame, capacity: int) -> DataFrame:
    """(item, bin, offset, fill): best-fit in each partition of items (item, length). A bin is named after its first item."""

    def run(batches):
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        item, length = table["item"].to_numpy(), table["length"].to_numpy()
        chosen, offsets, fill = best_fit(length.tolist(), capacity)
        chosen = np.asarray(chosen, np.int64)
        opened = np.zeros(len(fill), np.int64)
        opened[chosen[::-1]] = item[::-1]  # the first item of each bin is written last
        out = [pa.array(opened[chosen]), pa.array(np.asarray(offsets, np.int64)), pa.array(np.asarray(fill, np.int64)[chosen])]
        yield from pa.Table.from_arrays([table["item"].combine_chunks(), *out], names=["item", "bin", "offset", "fill"]).to_batches(1 << 16)

    return items.sortWithinPartitions(F.desc("length"), "item").mapInArrow(run, "item long, bin long, offset long, fill long")


def place(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """pieces (with unique long ``item`` and ``length`` from 1 to capacity) with ``sequence_id`` and ``offset``.

    Sequences are at most ``capacity`` long and gapless from offset 0. ``pieces`` must give the same rows when read again
    (a written table). An empty table stays empty.
    """
    narrow, room = pieces.select("item", "length"), max(1, capacity // nearly_full)
    level = shared_table(_pack(narrow.withColumn("node", F.spark_partition_id()), capacity).withColumn("node", F.spark_partition_id().cast("long")), "packed")
    first, levels = level, []
    width = None
    while True:
        left = level.where(f"item = bin AND fill <= {capacity - room}").select(F.col("bin").alias("item"), F.col("fill").alias("length"), "node")
        before, widest = left.agg(F.count("*"), F.max("node")).first()
        if width == 1 or before < 2:
            break
        width = (widest + 1 if width is None else width)
        merged = -(-width // FAN_IN)
        least = -(-before // NODE_ITEMS)
        if least <= merged:
            dealt, width = left.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")), merged
        else:  # too many bins for so few nodes: mixed anew over as many as hold them
            dealt, width = left.withColumn("node", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(least))), least
        packed = _pack(dealt.repartition(width, "node").select("item", "length", "node"), capacity)
        nodes = dealt.select(F.col("item").alias("named"), "node")
        level = shared_table(packed.join(nodes, packed["item"] == nodes["named"]).drop("named"), "merged")
        levels.append(level)
        if level.where("item = bin").count() == before:
            break
    home = None
    for level in reversed(levels):
        step = level.select("item", F.col("bin").alias("sequence_id"), "offset")
        if home is not None:
            up = home.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("top"), F.col("offset").alias("further"))
            step = step.join(up, "sequence_id", "left").select(
                "item", F.coalesce("top", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("further", F.lit(0))).alias("offset"))
        home = step
    placed = first.select("item", F.col("bin").alias("sequence_id"), "offset")
    if home is not None:
        up = shared_table(home, "home").select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("top"), F.col("offset").alias("further"))
        placed = placed.join(up, "sequence_id", "left").select(
            "item", F.coalesce("top", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("further", F.lit(0))).alias("offset"))
    return pieces.join(placed, "item")


def pack(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): every piece and its place; ids only if asked for."""
    pieces = token_pieces(documents, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        pieces = pieces.drop("ids")
    return place(shared_table(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces"), capacity).drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): the sequences themselves, ids and documents in order of their offsets."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids", "doc_id"))).alias("parts"))
    return parts.select(
        "sequence_id", F.expr("aggregate(parts, 0L, (s, p) -> s + p.length)").alias("length"),
        F.expr("aggregate(parts, X'', (s, p) -> s || p.ids)").alias("ids"), F.expr("transform(parts, p -> p.doc_id)").alias("doc_ids"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
