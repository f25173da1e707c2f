"""SentencePiece encoding and decoding by suffix-array matching.

Encoding a batch:

1. The texts are cut before every run of spaces. No piece of the vocabulary runs across such a cut (this is checked), so
   each distinct word of the batch is encoded once.
2. The distinct words are laid out one after the other and indexed by a suffix array (prefix doubling up to the longest
   piece). Every piece of the vocabulary is looked up by binary search; its range in the array gives all its occurrences.
3. The occurrences are edges between positions. Sorted by the position they end at, they are relaxed from left to right:
   an edge is taken if its piece may follow the last piece of the prefix it starts from, that is, if merging by score
   would leave the two side by side. For a vocabulary of merges exactly one edge into each position passes this test,
   and the edges taken are the pieces that merging by score gives.
4. Characters without a piece become byte pieces. Runs of several spaces, whose pieces all share the lowest score, are
   merged last and from the left.

Decoding joins the pieces again; the result is compared with the text, which also guards against two words with one hash.
Nothing is shuffled: each task encodes its own rows, whole texts in batches of bounded bytes.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attesta.llm.batches import chunks, column_bytes, mix, prefix_hash, range_hash, release_memory

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BATCH_BYTES = 1 << 19
REMEMBERED = 1 << 19


def merge_pieces(text: str, ids: dict[str, int], score: dict[str, float]) -> list[str]:
    """Merges neighbouring symbols, best score first and leftmost among equals, until no merge is left."""
    symbols, after, before = list(text), [*range(1, len(text)), -1], list(range(-1, len(text) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right >= 0 and (joined := symbols[left] + symbols[right]) in ids:
            heapq.heappush(heap, (-score[joined], left, right, joined))

    for i in range(len(symbols) - 1):
        offer(i)
    while heap:
        _, left, right, joined = heapq.heappop(heap)
        if not symbols[left] or after[left] != right or symbols[left] + symbols[right] != joined:
            continue
        symbols[left], symbols[right] = joined, ""
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [s for s in symbols if s]


class Vocabulary:
    """Pieces of a model with the tables that matching and relaxing need. Built on the driver; its size is the vocabulary's."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ordinary = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in ordinary}
        score = {names[i]: model.get_score(i) for i in ordinary}
        self.run_score = {n: s for n, s in score.items() if len(n) > 1 and not n.strip(SPACE)}
        rest = {n: s for n, s in score.items() if n not in self.run_score}
        alphabet = sorted(n for n in rest if len(n) == 1)
        merged = sorted((n for n in rest if len(n) > 1), key=lambda n: -rest[n])
        if self.run_score and merged and max(self.run_score.values()) >= min(rest[n] for n in merged):
            raise ValueError("pieces of several spaces must have the lowest scores")
        if any(SPACE in n[1:] for n in merged) or {c for n in merged for c in n} - set(alphabet):
            raise ValueError("a piece runs across a space or has a character that is no piece")
        if len({rest[n] for n in merged}) < len(merged) or (self.byte_ids == model.unk_id()).any():
            raise ValueError("scores of pieces must differ, and every byte needs a piece")
        # rank: characters first, then merged pieces by falling score; left and right: the last merge inside a piece
        place = {n: i for i, n in enumerate(alphabet)}
        left, right, kept, longest = list(range(len(alphabet))), list(range(len(alphabet))), list(alphabet), 1
        for n in merged:
            others = {k: v for k, v in ((n[i:j], 0) for i in range(len(n)) for j in range(i + 2, len(n) + 1)) if k in rest and k != n}
            halves = merge_pieces(n, others, rest)
            if len(halves) == 2 and halves[0] in place and halves[1] in place:
                place[n] = len(kept)
                left.append(place[halves[0]])
                right.append(place[halves[1]])
                kept.append(n)
                longest = max(longest, len(n))
        self.rank_ids = np.array([self.ids[n] for n in kept], np.int32)
        self.space_rank = place[SPACE]
        self.left, self.right = np.array(left), np.array(right)
        pair = self.left.astype(np.int64) * len(kept) + self.right
        pair[: len(alphabet)] = -1
        order = np.argsort(pair, kind="stable")[len(alphabet):]
        self.pair_keys, self.pair_rank = pair[order], order
        # marks of hashed pairs: a pair without a mark is no merge
        self._spread = np.int64(0x1E3779B97F4A7C15)
        self.never = np.ones(1 << 20, bool)
        self.never[(pair[order] * self._spread & 0x7FFFFFFFFFFFFFFF) >> 43] = False
        # characters as codes; 0 ends a word, 1 is a character without a piece
        self.code = np.ones(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        self.depth = 1 << max(2, (longest - 1).bit_length())
        spelled = np.zeros((len(kept), self.depth), np.uint16)
        for i, n in enumerate(kept):
            spelled[i, : len(n)] = [self.code[ord(c)] for c in n]
        self.spelled, self.length = spelled, np.array([len(n) for n in kept])
        texts = [n.replace(SPACE, " ").encode() for n in names]
        for b, i in enumerate(self.byte_ids):
            texts[i] = bytes([b])
        self.name = hashlib.md5("\0".join(f"{n} {score.get(n)}" for n in names).encode()).hexdigest()
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging by score leaves these pieces (ranks) side by side, for all pairs at once.

        The merges that made the two pieces are undone from the last one; if at some point the inner neighbours would
        have merged earlier than the merge just undone, they do not stay apart.
        """
        n = len(self.rank_ids)
        out = np.zeros(len(first), bool)
        which, a, b = np.arange(len(first)), first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), np.iinfo(np.int64).max)
        while len(which):
            key = a * n + b
            maybe = np.flatnonzero(~self.never[(key * self._spread & 0x7FFFFFFFFFFFFFFF) >> 43])  # most pairs never merge
            own = key[maybe]
            at = np.minimum(np.searchsorted(self.pair_keys, own), len(self.pair_keys) - 1)
            dead = maybe[(self.pair_keys[at] == own) & (self.pair_rank[at] < limit[maybe])]
            if len(dead):
                alive = np.ones(len(which), bool)
                alive[dead] = False
                which, a, b = which[alive], a[alive], b[alive]
            inner_a, inner_b = self.right[a], self.left[b]
            plain_a, plain_b = inner_a == a, inner_b == b
            undo_a = ((a > b) & ~plain_a) | (plain_b & ~plain_a)
            limit = np.where(undo_a, a, b + 1)
            done = plain_a & plain_b
            out[which[done]] = True
            a, b = np.where(undo_a, inner_a, a), np.where(undo_a, b, inner_b)
            which, a, b, limit = which[~done], a[~done], b[~done], limit[~done]
        return out

    @lru_cache(maxsize=4096)  # noqa: B019  one vocabulary per worker
    def space_run(self, k: int) -> tuple[int, ...]:
        """Ids of k spaces that merged with no word."""
        return tuple(self.ids[s] for s in merge_pieces(SPACE * k, self.run_score, self.run_score))


def _packed(codes: np.ndarray) -> np.ndarray:
    """Four character codes in one number, for every position."""
    wide = np.concatenate([codes, np.zeros(3, codes.dtype)]).astype(np.uint64)
    n = len(codes)
    return (wide[:n] << np.uint64(48)) | (wide[1: n + 1] << np.uint64(32)) | (wide[2: n + 2] << np.uint64(16)) | wide[3: n + 3]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of what follows them, compared up to ``depth`` characters (prefix doubling from four)."""
    key, reach = _packed(codes), 4
    while True:
        order = np.argsort(key)  # equal suffixes may come in any order
        if reach >= depth:
            return order
        new = np.ones(len(key), np.uint64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(new)
        further = np.zeros(len(key), np.uint64)
        further[:-reach] = rank[reach:] if len(key) > reach else 0
        key = (rank << np.uint64(32)) | further
        reach *= 2


def _bound(columns: list[np.ndarray], wanted: list[np.ndarray], upper: bool) -> np.ndarray:
    """Binary search of every wanted row among sorted rows, all at once."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(columns[0]), np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(columns[0]) - 1)
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for have, want in zip(columns, wanted):
            value = have[middle]
            less |= equal & (value < want)
            equal &= value == want
        right = (less | equal if upper else less) & open_
        low = np.where(right, middle + 1, low)
        high = np.where(~right & open_, middle, high)
    return low


def occurrences(vocabulary: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (position, piece rank) at which a piece occurs, from the suffix array of the codes."""
    order = suffix_array(codes, vocabulary.depth)
    packed = np.concatenate([_packed(codes), np.zeros(vocabulary.depth, np.uint64)])
    columns = [packed[order + 4 * i] for i in range(vocabulary.depth // 4)]
    low_rows = vocabulary.spelled
    high_rows = np.where(low_rows == 0, np.uint16(0xFFFF), low_rows)
    four = lambda rows, i: _packed(rows[:, 4 * i: 4 * i + 4].reshape(-1))[::4]
    low = _bound(columns, [four(low_rows, i) for i in range(vocabulary.depth // 4)], False)
    high = _bound(columns, [four(high_rows, i) for i in range(vocabulary.depth // 4)], True)
    count = high - low
    piece = np.repeat(np.arange(len(low), dtype=np.int32), count)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    return order[np.repeat(low, count) + inside].astype(np.int32), piece


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each word with one space before it: (ids, offsets, whether the space stands alone)."""
    text = "\0".join(SPACE + w.decode() for w in words) + "\0"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # a NUL inside a word is a character of its own: word ends are found by length
    lengths = np.array([len(w.decode()) + 1 for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    codes = vocabulary.code[points].astype(np.uint16)
    codes[begin + lengths] = 0
    position, piece = occurrences(vocabulary, codes)
    unknown = np.flatnonzero(codes == 1).astype(np.int32)
    start = np.concatenate([position, unknown])
    rank = np.concatenate([piece, np.full(len(unknown), -1, np.int32)])
    end = start + np.where(rank >= 0, vocabulary.length[np.maximum(rank, 0)], 1).astype(np.int32)
    step = end - np.repeat(begin, lengths + 1)[start]
    step = step.astype(np.uint16 if step.max(initial=0) < 1 << 16 else np.int64)
    order = np.argsort(step, kind="stable")  # a radix sort for all but huge words
    start, end, rank = start[order], end[order], rank[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=int(lengths.max(initial=0)) + 1))])
    last = np.full(len(codes) + 1, -2, np.int32)  # rank of the last piece of the prefix that ends here; -1 a byte piece, -2 none
    came = np.zeros(len(codes) + 1, np.int32)
    first_of = np.zeros(len(codes) + 1, bool)
    first_of[begin] = True
    for s, e in zip(bounds[:-1], bounds[1:]):
        if s == e:
            continue
        a, r, z = start[s:e], rank[s:e], end[s:e]
        before = last[a]
        free = first_of[a] | (before == -1) | (r == -1)
        fits = free.copy()
        ask = np.flatnonzero(~free & (before >= 0))
        fits[ask] = vocabulary.may_follow(before[ask], r[ask])
        last[z[fits]], came[z[fits]] = r[fits], a[fits]
    # walk back from each word's end, all words together: first count the pieces, then fill from the end
    pieces_in = np.zeros(len(words), np.int64)
    trail, live, at = [], np.arange(len(words)), begin + lengths
    while len(live):
        trail.append((live, at))
        pieces_in[live] += 1
        at = came[at]
        more = at > begin[live]
        live, at = live[more], at[more]
    pieces_before = np.concatenate([[0], np.cumsum(pieces_in)])
    spots = np.empty(int(pieces_before[-1]), np.int64)
    for back, (live, at) in enumerate(trail):
        spots[pieces_before[live + 1] - 1 - back] = at
    ranks = last[spots]
    if (ranks == -2).any():
        raise ValueError("no path of pieces through a word")
    # a byte piece stands for all bytes of its character
    raw = ranks == -1
    width = np.ones(len(spots), np.int64)
    pts = points[spots - 1]
    width[raw] = 1 + (pts[raw] >= 0x80) + (pts[raw] >= 0x800) + (pts[raw] >= 0x10000)
    at_out = np.concatenate([[0], np.cumsum(width)])
    ids = np.repeat(vocabulary.rank_ids[np.maximum(ranks, 0)], width)
    for i in np.flatnonzero(raw).tolist():
        ids[at_out[i]: at_out[i + 1]] = vocabulary.byte_ids[list(chr(pts[i]).encode())]
    alone = np.zeros(len(words), bool)
    alone[:] = ranks[pieces_before[:-1]] == vocabulary.space_rank
    return ids, at_out[pieces_before], alone


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start:start+count] of every pair, one after the other."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return values[shift + np.arange(total)]


def _unit_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every byte range, through chunks that keep the power tables small."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(int(np.searchsorted(end, base + (1 << 20), side="right")), i + 1)
        prefix = prefix_hash(data[base: int(end[j - 1])])
        out[i:j] = range_hash(prefix, start[i:j] - base, end[i:j] - base)
        i = j
    return out


class Known:
    """Encoded units of earlier batches, by hash; forgotten as a whole when there are more than ``REMEMBERED``."""

    def __init__(self):
        self.keys, self.begin, self.length, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether known)"""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New units, whose ids lie one after the other."""
        if len(self.keys) + len(keys) > REMEMBERED and len(self.keys):
            self.__init__()
        keys, begin = np.concatenate([self.keys, keys]), np.concatenate([self.begin, len(self.pool) + np.cumsum(lengths) - lengths])
        order = np.argsort(keys)
        self.keys, self.begin, self.length = keys[order], begin[order], np.concatenate([self.length, lengths])[order]
        self.pool = np.concatenate([self.pool, ids])


_KNOWN: dict[str, Known] = {}


def _encode_units(vocabulary: Vocabulary, texts: list[bytes], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, number of ids) of units: a word after so many spaces."""
    ids, offsets, alone = encode_words(vocabulary, texts)
    odd = np.flatnonzero((runs != 1) | np.array([not t for t in texts], bool))
    if not len(odd):
        return ids, np.diff(offsets)
    parts = {}
    for i in odd.tolist():
        own, n = ids[offsets[i]: offsets[i + 1]], int(runs[i])
        if not texts[i] or alone[i]:  # the space before the word merged with nothing: it joins the run
            parts[i] = np.concatenate([np.array(vocabulary.space_run(n), np.int32), own[1:]])
        else:
            parts[i] = np.concatenate([np.array(vocabulary.space_run(n - 1), np.int32), own])
    pieces, at = [], 0
    for i in odd.tolist():
        pieces += [ids[offsets[at]: offsets[i]], parts[i]]
        at = i + 1
    pieces.append(ids[offsets[at]:])
    lengths = np.diff(offsets)
    lengths[odd] = [len(parts[i]) for i in odd.tolist()]
    return np.concatenate(pieces), lengths


def encode_bytes(vocabulary: Vocabulary, data: np.ndarray, at: np.ndarray, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets per row) of texts lying one after the other; the caller has turned U+2581 into spaces.

    With ``known`` units are told apart by hash and each distinct one is encoded once; without, every unit is encoded.
    """
    blank = data == 32
    row_begin = at[:-1][np.diff(at) > 0]
    # a unit is a run of spaces and the run of other characters after it; a row begins a unit
    opens = np.zeros(len(data) + 1, bool)
    opens[1:-1] = blank[1:] & ~blank[:-1]
    opens[row_begin] = True
    start = np.flatnonzero(opens[:-1])
    end = np.concatenate([start[1:], [len(data)]])
    spaces = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    k = (spaces[end] - spaces[start]).astype(np.int64)  # spaces inside a unit lie at its beginning only
    word = start + k
    leads = np.zeros(len(data) + 1, bool)
    leads[row_begin] = True
    k = k + leads[start]  # every text begins with one more space
    raw = data.tobytes()
    if known is None:
        ids, lengths = _encode_units(vocabulary, [raw[s:e] for s, e in zip(word.tolist(), end.tolist())], k)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(start, at)]
    keys = mix(_unit_hashes(data, word, end) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys, where, unit = np.unique(keys, return_index=True, return_inverse=True)
    new = ~known.find(keys)[1]
    if len(known.keys) + new.sum() > REMEMBERED and len(known.keys):
        known.__init__()
        new[:] = True
    if new.any():
        where = where[new]
        ids, lengths = _encode_units(vocabulary, [raw[s:e] for s, e in zip(word[where].tolist(), end[where].tolist())], k[where])
        known.add(keys[new], lengths, ids)
    place = known.find(keys)[0][unit]
    out = gather(known.pool, known.begin[place], known.length[place])
    per_unit = np.concatenate([[0], np.cumsum(known.length[place])])
    return out, per_unit[np.searchsorted(start, at)]


def decode_bytes(vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets per row) of the texts; the space that begins every text is dropped."""
    size = vocabulary.piece_at[ids + 1] - vocabulary.piece_at[ids]
    data = gather(vocabulary.piece_bytes, vocabulary.piece_at[ids], size)
    ends = np.concatenate([[0], np.cumsum(size)])[at]
    keep = np.ones(len(data), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    return data[keep], ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])


def encode_column(vocabulary: Vocabulary, texts: pa.Array, known: Known) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(ids, number of ids, whether decoding gives the text back) for every text; null counts as empty."""
    ids, counts, same = [], [], []
    for first, last, data, at in chunks(texts, BATCH_BYTES):
        if len(data) >= 3 and ((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any():
            plain = [data[s:e].tobytes().replace(SPACE.encode(), b" ") for s, e in zip(at[:-1], at[1:])]
            data, at = np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in plain])])
        if not len(data):
            ids.append(np.zeros(0, np.int32))
            counts.append(np.zeros(last - first, np.int64))
            same.append(np.ones(last - first, bool))
            continue
        own, own_at = encode_bytes(vocabulary, data, at, known)
        back, back_at = decode_bytes(vocabulary, own, own_at)
        if len(back) == len(data) and (back_at == at).all():
            wrong = np.concatenate([[0], np.cumsum(back != data)])
            equal = wrong[at[1:]] == wrong[at[:-1]]
        else:
            equal = np.array([back[back_at[i]: back_at[i + 1]].tobytes() == data[at[i]: at[i + 1]].tobytes() for i in range(len(at) - 1)])
        if not equal.all():  # two units with one hash: encode these texts without hashes
            parts = [own[s:e] for s, e in zip(own_at[:-1], own_at[1:])]
            for i in np.flatnonzero(~equal).tolist():
                text = data[at[i]: at[i + 1]]
                parts[i] = encode_bytes(vocabulary, text, np.array([0, len(text)]))[0]
                equal[i] = decode_bytes(vocabulary, parts[i], np.array([0, len(parts[i])]))[0].tobytes() == text.tobytes()
            own, own_at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ids.append(own.astype(np.int32))
        counts.append(np.diff(own_at))
        same.append(equal)
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(count), pa.array(np.concatenate(same) if same else np.zeros(0, bool))


def encode(documents: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Adds to every row: ids (array of int), n_ids, round_trip (decoding gives the text back, U+2581 read as a space).

    Whole texts are encoded; a null or empty text has no ids. Repeated rows are encoded alike; other columns stay; no
    rows give none. Columns named like the added ones are replaced.
    """
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(model))  # as large as the vocabulary, whatever the data
    rows = documents.drop("ids", "n_ids", "round_trip")
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    names, text_at = [*rows.columns, "ids", "n_ids", "round_trip"], rows.columns.index("text")

    def run(batches):
        release_memory()
        known = _KNOWN.setdefault(vocabulary.value.name, Known())  # a worker goes on to the next task with what it knows
        for batch in batches:
            _, at = column_bytes(batch.column(text_at))
            first = 0
            while first < batch.num_rows:  # smaller record batches, so ids of many long texts never pile up
                last = min(max(int(np.searchsorted(at, at[first] + BATCH_BYTES, side="right")) - 1, first + 1), batch.num_rows)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *encode_column(vocabulary.value, part.column(text_at), known)], names=names)
                first = last
        release_memory()

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Adds to every row the text that its ids (array of int) stand for; null ids give null, bytes that are no UTF-8 are replaced."""
    spark = rows.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(model))
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            count = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            values = np.array(column.flatten().to_pylist(), np.int64)
            data, at = decode_bytes(vocabulary.value, values, np.concatenate([[0], np.cumsum(count)]))
            texts = [data[s:e].tobytes().decode("utf-8", "replace") if known else None for s, e, known in zip(at[:-1], at[1:], column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in others], pa.array(texts, pa.string())], names=[*[f.name for f in others], "text"])

    return rows.mapInArrow(run, T.StructType([*others, T.StructField("text", T.StringType())]))
