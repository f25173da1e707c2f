"""Latent semantics inside tasks: blocks of a case's passages and the products that block power iteration needs of them."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENTS = 32  # parts of a large case's vocabulary; the vectors of a part are summed in one task
STRIP = 4  # columns that are multiplied at a time
CHUNK = 1 << 20  # weights that are multiplied at a time
PASSAGES = 2048  # passages whose words are counted at a time
PART = pa.schema([("case_id", pa.int64()), ("_block", pa.int32()), ("_segment", pa.int32()), ("_kind", pa.string()), ("_data", pa.binary())])
PART_ROW = "case_id long, _block int, _segment int, _kind string, _data binary"

_P = [np.uint64(x) for x in (0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _last_mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P[2]
    h = (h ^ (h >> np.uint64(29))) * _P[3]
    return h ^ (h >> np.uint64(32))


def start_vectors(seeds: np.ndarray, width: int) -> np.ndarray:
    """Noise of a term, the same in every task: ``xxhash64(term, j) / 2**63`` for j from 1, of seeds ``xxhash64(term)``."""
    h = (seeds.view(np.uint64) + _P[5] + np.uint64(4))[:, None] ^ (np.arange(1, width + 1, dtype=np.uint64) * _P[1])
    return _last_mix(_turn(h, 23) * _P[2] + _P[3]).view(np.int64) / 2.0**63


def term_seeds(terms: pa.Array) -> np.ndarray:
    """``xxhash64(term)`` of strings, as Spark has it, for all terms of one length at a time."""
    if not len(terms):
        return np.empty(0, np.int64)
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset: terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    sizes, out = np.diff(offsets), np.empty(len(terms), np.int64)
    one = lambda v, word: _turn(v + word * _P[2], 31) * _P[1]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        text = data[offsets[at][:, None] + np.arange(size)]
        whole = int(size) & -8
        words = np.ascontiguousarray(text[:, :whole]).view(np.uint64) if whole else np.empty((len(at), 0), np.uint64)
        seed, done = np.full(len(at), 42, np.uint64), 0
        if size >= 32:
            v = [seed + _P[1] + _P[2], seed + _P[2], seed, seed - _P[1]]
            while done + 4 <= int(size) // 8:
                v = [one(x, words[:, done + i]) for i, x in enumerate(v)]
                done += 4
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ one(np.uint64(0), x)) * _P[1] + _P[4]
        else:
            h = seed + _P[5]
        h = h + np.uint64(size)
        for i in range(done, whole // 8):
            h = _turn(h ^ one(np.uint64(0), words[:, i]), 27) * _P[1] + _P[4]
        if size - whole >= 4:
            h = _turn(h ^ (np.ascontiguousarray(text[:, whole: whole + 4]).view(np.uint32)[:, 0].astype(np.uint64) * _P[1]), 23) * _P[2] + _P[3]
            whole += 4
        for i in range(whole, int(size)):
            h = _turn(h ^ (text[:, i].astype(np.uint64) * _P[5]), 11) * _P[1]
        out[at] = _last_mix(h).view(np.int64)
    return out


def _one_way(vectors: np.ndarray) -> np.ndarray:
    """Eigenvectors have no sign of their own; a fixed rule keeps that of the result from hanging on rounding."""
    way = (1 / np.sqrt(np.arange(1.0, len(vectors) + 1))) @ vectors
    return vectors * np.where(way < 0, -1.0, 1.0)


def orthonormal(gram: np.ndarray) -> np.ndarray:
    value, vector = np.linalg.eigh(gram)
    scale = np.where(value > max(value[-1], 0) * 1e-13, 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
    return _one_way(vector) * scale


def leading(gram: np.ndarray, k: int) -> np.ndarray:
    return _one_way(np.linalg.eigh(gram)[1][:, ::-1][:, :k])


def trim() -> None:
    """Memory that is free goes back to the machine, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


class Space(NamedTuple):
    """A case's passages and the dimensions it is asked for."""

    n: int
    k: int
    width: int


def space(n: int, terms: int, dimensions: int, oversample: int) -> Space:
    k = max(2, min(dimensions, n - 1, terms - 1))
    return Space(n, k, max(k, min(k + oversample, n, terms)))


class Chunk(NamedTuple):
    """Passages that hold terms: how many each holds, which, and how often."""

    lengths: np.ndarray
    cols: np.ndarray
    f: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.lengths[:-1], dtype=np.int64)))

    @property
    def damped(self) -> np.ndarray:
        return 1 + np.log(self.f, dtype=np.float64)  # of bytes numpy would take half precision


class Block:
    """The weights of a block of passages, rows of unit length. Vectors of terms and of passages are columns."""

    def __init__(self, chunks: list[Chunk], df: np.ndarray, n: int):
        self.chunks, self.idf = chunks, np.log((1 + n) / (1 + df)) + 1
        self.inverse = [1 / np.sqrt(np.add.reduceat((c.damped * self.idf[c.cols]) ** 2, c.starts)) for c in chunks]

    def placed(self, y: np.ndarray) -> Iterator[np.ndarray]:
        """Per chunk the vectors of its passages, from those of the terms."""
        for c, inverse in zip(self.chunks, self.inverse):
            s, starts = c.damped, c.starts
            yield np.stack([np.add.reduceat(s * (x * self.idf)[c.cols], starts) for x in y]) * inverse

    def grow(self, y: np.ndarray) -> None:
        """From the terms to the passages and back, in the place of ``y``."""
        for lo in range(0, len(y), STRIP):
            x = y[lo: lo + STRIP] * self.idf
            new = np.zeros_like(x)
            for c, inverse in zip(self.chunks, self.inverse):
                s, starts = c.damped, c.starts
                for old, out in zip(x, new):
                    made = np.add.reduceat(s * old[c.cols], starts) * inverse * inverse
                    out += np.bincount(c.cols, s * np.repeat(made, c.lengths), minlength=len(out))
            y[lo: lo + STRIP] = new * self.idf

    def noise(self, seeds: np.ndarray, width: int) -> np.ndarray:
        y = np.empty((width, len(seeds)))
        for lo in range(0, len(seeds), 1 << 14):
            y[:, lo: lo + (1 << 14)] = start_vectors(seeds[lo: lo + (1 << 14)], width).T
        return y


def turn(y: np.ndarray, matrix: np.ndarray) -> None:
    for lo in range(0, y.shape[1], 1 << 14):
        y[:, lo: lo + (1 << 14)] = matrix.T @ y[:, lo: lo + (1 << 14)]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / (np.sqrt((vectors * vectors).sum(axis=0)) + 1e-9)


class Read(NamedTuple):
    """A block as it comes in: its terms by segment, passages with and without terms, and the terms that queries ask for."""

    chunks: list[Chunk]
    names: list[pa.Table]
    blank: pa.Table
    terms: pa.Array
    seeds: np.ndarray
    bounds: np.ndarray
    asked: pa.Array | None


def read_block(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Read:
    chunks, names, blank, found, asked, dictionaries = [], [], [], [], [], []
    held = at = 0

    def close() -> None:
        nonlocal held
        if held:
            lengths, cols, f = (np.concatenate(x) for x in zip(*found))
            chunks.append(Chunk(lengths, cols, f.astype(np.min_scalar_type(f.max()))))
            names[len(chunks) - 1:] = [pa.concat_tables(names[len(chunks) - 1:]).combine_chunks()]
            found.clear()
            held = 0
            trim()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        asked.extend(table.filter(table["_asked"])["_stems"].to_pylist())
        table = table.filter(pc.invert(table["_asked"]))
        filled = pc.not_equal(pc.fill_null(table["_stems"], ""), "")
        blank.append(table.select(columns).filter(pc.invert(filled)))
        table = table.filter(filled)
        for lo in range(0, table.num_rows, PASSAGES):
            part = table.slice(lo, PASSAGES).combine_chunks()
            lists = pc.split_pattern(part["_stems"].combine_chunks(), " ")
            coded = pc.list_flatten(lists).dictionary_encode()
            lengths, size = pc.list_value_length(lists).to_numpy(), len(coded.dictionary)
            spots, f = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(), return_counts=True)
            found.append((np.bincount(spots // size, minlength=len(lengths)).astype(np.int32), (spots % size + at).astype(np.int32), f.astype(np.int32)))
            names.append(part.select(columns).take(pa.array(np.arange(part.num_rows))))
            dictionaries.append(coded.dictionary)
            at, held = at + size, held + len(f)
            if held >= CHUNK:
                close()
    close()
    every = pa.concat_arrays(dictionaries) if dictionaries else pa.array([], pa.string())
    terms = every.unique()
    seeds = term_seeds(terms)
    segment = seeds.view(np.uint64) % np.uint64(SEGMENTS)
    order = np.argsort(segment, kind="stable")
    place = np.empty(len(terms), np.int32)
    place[order] = np.arange(len(terms), dtype=np.int32)
    to = place[pc.index_in(every, value_set=terms).to_numpy()]
    for c in chunks:
        c.cols[:] = to[c.cols]
    trim()
    wanted = pa.array(" ".join(asked).split(" "), pa.string()) if asked else None
    return Read(chunks, names, pa.concat_tables(blank), terms.take(pa.array(order)), seeds[order], np.searchsorted(segment[order], np.arange(SEGMENTS + 1, dtype=np.uint64)), wanted)


def local_df(chunks: list[Chunk], terms: int) -> np.ndarray:
    return sum((np.bincount(c.cols, minlength=terms) for c in chunks), np.zeros(terms, np.int64))


class Asks(NamedTuple):
    """What is asked for: dimensions, rounds, and which terms' vectors ('all', 'asked' or 'none')."""

    dimensions: int
    oversample: int
    iterations: int
    basis: str

    def mask(self, terms: pa.Array, asked: pa.Array | None) -> np.ndarray:
        if self.basis == "asked" and asked is not None:
            return pc.is_in(terms, value_set=asked).to_numpy(zero_copy_only=False)
        return np.full(len(terms), self.basis == "all")


def rows_of(schema: pa.Schema, count: int, **columns) -> list[pa.RecordBatch]:
    """Rows that hold the given columns, and nulls in all others."""
    made = [columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in schema]
    same = [pa.array([x] * count, f.type) if isinstance(x, (str, int)) else x for x, f in zip(made, schema)]
    return pa.Table.from_arrays(same, schema=schema).combine_chunks().to_batches()


def listed(vectors: np.ndarray) -> pa.Array:
    """Columns as list values."""
    width, n = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(vectors.T).ravel()))


def _done(schema: pa.Schema, names: pa.Table, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from rows_of(schema, names.num_rows, _kind="done", embedding=listed(vectors), **{c: names[c] for c in names.column_names})


def _basis(schema: pa.Schema, case_id: int, terms: pa.Array, idf: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from rows_of(schema, len(terms), _kind="basis", case_id=pa.array([case_id] * len(terms), pa.int64()), _term=terms, _idf=pa.array(idf, pa.float64()), embedding=listed(vectors))


def _part(case_id: int, block: int, segment: int, kind: str, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((case_id, block, segment, kind, pickle.dumps(data, 5)), PART)], schema=PART)


def whole_case(schema: pa.Schema, columns: list[str], asks: Asks, case_id: int | None, n: int | None, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rounds of a case that is one block: its passages' unit vectors, and the vectors of the terms asked for."""
    read = read_block(batches, columns)
    if case_id is None or n is None or n < 2 or not len(read.terms):
        for names in [read.blank, *read.names]:
            yield from _done(schema, names, np.zeros((2, names.num_rows)))
        return
    held = space(n, len(read.terms), asks.dimensions, asks.oversample)
    block = Block(read.chunks, local_df(read.chunks, len(read.terms)), n)
    y = block.noise(read.seeds, held.width)
    for _ in range(asks.iterations):
        block.grow(y)
        turn(y, orthonormal(y @ y.T))
    made = list(block.placed(y))
    last = leading(sum(z @ z.T for z in made), held.k)
    yield from _done(schema, read.blank, np.zeros((held.k, read.blank.num_rows)))
    for names, z in zip(read.names, made):
        yield from _done(schema, names, unit(last.T @ z))
    want = np.flatnonzero(asks.mask(read.terms, read.asked))
    yield from _basis(schema, case_id, read.terms.take(pa.array(want)), block.idf[want], last.T @ y[:, want])
    del read, block, y, made
    trim()


# ------------------------------------------------------------------------------------------------ cases of several blocks
def first_parts(columns: list[str], asks: Asks, case_id: int, number: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block as rows of moderate size: counts and names by chunk, terms by segment."""
    read = read_block(batches, columns)
    df = local_df(read.chunks, len(read.terms)).astype(np.int32)
    for i, (c, names) in enumerate(zip(read.chunks, read.names)):
        yield _part(case_id, number, i, "counts", tuple(c))
        yield _part(case_id, number, i, "names", names)
    yield _part(case_id, number, 0, "blank", read.blank)
    wanted = asks.mask(read.terms, read.asked)
    for s in range(SEGMENTS):
        lo, hi = read.bounds[s: s + 2]
        yield _part(case_id, number, s, "terms", (read.terms.take(pa.array(np.arange(lo, hi))), df[lo:hi], wanted[lo:hi]))


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, str, object]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block, segment, kind, data = (batch.column(c)[i] for c in ("_block", "_segment", "_kind", "_data"))
            yield block.as_py(), segment.as_py(), kind.as_py(), pickle.loads(data.as_buffer())


def known_terms(case_id: int, segment: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block of a case, of its terms of a segment: the passages of the case that hold them, their number among the
    terms of several blocks (-1 if no other block holds them), and whether the block is the first to hold them."""
    sent = sorted(((block, data[0], data[1]) for block, _, _, data in _unpacked(batches)), key=lambda x: x[0])
    coded = pa.concat_arrays([x[1] for x in sent]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    df, holders = np.bincount(codes, np.concatenate([x[2] for x in sent])).astype(np.int64), np.bincount(codes)
    ids = np.where(holders > 1, np.cumsum(holders > 1) - 1, -1).astype(np.int32)
    first = np.zeros(len(codes), bool)
    first[np.unique(codes, return_index=True)[1]] = True
    at = 0
    for block, terms, _ in sent:
        mine = codes[at: at + len(terms)]
        yield _part(case_id, block, segment, "known", (df[mine], ids[mine], first[at: at + len(terms)]))
        at += len(terms)
    yield _part(case_id, -1, segment, "size", len(coded.dictionary))


def summed_terms(case_id: int, segment: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of terms that several blocks hold, summed and sent back to each of them; and their Gram matrix."""
    ids, total = {}, None
    for block, _, _, (mine, vectors, *place) in _unpacked(batches):
        ids[block] = mine, place
        need = int(mine.max(initial=-1)) + 1
        if total is None or total.shape[1] < need:
            grown = np.zeros((len(vectors), need))
            if total is not None:
                grown[:, : total.shape[1]] = total
            total = grown
        total[:, mine] += vectors
    for block, (mine, place) in ids.items():
        yield _part(case_id, block, segment, "down", (total[:, mine], *place))
    yield _part(case_id, -1, segment, "gram", total @ total.T)


def block_round(spaces: dict[int, Space], matrices: dict[int, np.ndarray] | None, last: bool, case_id: int, number: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A round of a block. It keeps the vectors of the terms that it alone holds, and hands on its part of the others' sums; the
    last round hands on its passages' vectors and those of the terms asked for."""
    got: dict[str, dict[int, object]] = {}
    held, y = spaces[case_id], None
    for _, segment, kind, data in _unpacked(batches):
        if kind in ("state", "down"):
            vectors, places, terms = data
            y = np.empty((held.width, terms)) if y is None else y
            y[:, places] = vectors
        else:
            got.setdefault(kind, {})[segment] = data
    trim()
    known = [got["known"][s] for s in range(SEGMENTS)]
    bounds = np.concatenate(([0], np.cumsum([len(x[0]) for x in known])))
    df, ids, first = (np.concatenate(x) for x in zip(*known))
    counts = got.pop("counts", {})
    block = Block([Chunk(*counts[i]) for i in sorted(counts)], df, held.n)
    if matrices is None:
        y = block.noise(np.concatenate([term_seeds(got["terms"][s][0]) for s in range(SEGMENTS)]), held.width)
    else:
        turn(y, matrices[case_id])
    if last:
        gram = np.zeros((held.width, held.width))
        for i, z in enumerate(block.placed(y)):
            gram += z @ z.T
            yield _part(case_id, number, i, "made", (got["names"].pop(i), z))
        yield _part(case_id, number, 0, "gram", gram)
        yield _part(case_id, number, 0, "blank", got["blank"][0])
        for s in range(SEGMENTS):
            terms, _, wanted = got["terms"][s]
            want = np.flatnonzero(wanted & first[bounds[s]: bounds[s + 1]])
            yield _part(case_id, number, s, "basis", (terms.take(pa.array(want)), block.idf[bounds[s] + want], y[:, bounds[s] + want]))
        return
    block.grow(y)
    gram = np.zeros((held.width, held.width))
    for s in range(SEGMENTS):
        mine = ids[bounds[s]: bounds[s + 1]]
        own, others = ((bounds[s] + np.flatnonzero(x)).astype(np.int32) for x in (mine < 0, mine >= 0))
        vectors = y[:, own]
        gram += vectors @ vectors.T
        yield _part(case_id, number, s, "state", (vectors, own, len(ids)))
        yield _part(case_id, number, s, "up", (mine[mine >= 0], y[:, others], others, len(ids)))
    yield _part(case_id, number, 0, "gram", gram)
    del block, y
    trim()


def last_rows(schema: pa.Schema, spaces: dict[int, Space], turns: dict[int, np.ndarray], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages and terms of large cases, brought into the latent space."""
    for batch in batches:
        for case_id, (_, _, kind, data) in zip(batch.column("case_id").to_pylist(), _unpacked([batch])):
            if kind == "made":
                yield from _done(schema, data[0], unit(turns[case_id].T @ data[1]))
            elif kind == "blank":
                yield from _done(schema, data, np.zeros((spaces[case_id].k, data.num_rows)))
            else:
                yield from _basis(schema, case_id, data[0], data[1], turns[case_id].T @ data[2])
