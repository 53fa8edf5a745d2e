"""Counts of pairs of words, and each word's nearest, in Arrow batches: a word is its place in the sorted table of words, a pair a 64-bit number.

What goes between tasks are blocks of sorted numbers, written as differences: 3 to 5 bytes a pair that occurs in a chunk, where rows of two words take 40.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose pairs are counted at once, or pairs of which the nearest are taken at once; a batch more at most.
AT_ONCE = 1 << 19
#: Numbers that a task of the second step gets, on average.
EACH = 1 << 22
#: Odd, so that products with it, cut to a number of bits, are as many as there are numbers.
ODD = 0x9E3779B97F4A7C15
#: Bits of a strength of at most 10,000.
STRENGTH = 14
BATCH_BYTES = 4 << 20
BLOCKS = "part int, n int, keys binary"
COUNTED = "a int, b int, n bigint, x bigint, y bigint"

_READ: dict[str, tuple[str, object]] = {}


def words_at(path: str, column: str):
    """A column of the table of words, in the order in which it was written. A worker keeps the last one of each name."""
    if _READ.get(column, ("",))[0] != path:
        _READ.pop(column, None)
        system, at = fs.FileSystem.from_uri(path)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet"))
        parts = [pq.read_table(f, columns=[column], filesystem=system).column(0) for f in files]
        whole = pa.chunked_array([c for p in parts for c in p.chunks], parts[0].type).combine_chunks() if parts else pa.array([], pa.int64())
        if column == "h":  # sorted hashes, and the places of their words
            h = whole.to_numpy(zero_copy_only=False)
            order = np.argsort(h)
            _READ[column] = path, (h[order], order.astype(np.int32))
        else:
            _READ[column] = path, whole.to_numpy(zero_copy_only=False) if pa.types.is_integer(whole.type) else whole
    return _READ[column][1]


def in_batches(df: DataFrame, f, shape: str) -> DataFrame:
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, shape)


def bits_of(n: int) -> int: return max(1, int(n - 1).bit_length())


def parts_of(n: int) -> int:
    """A power of two: tasks for n numbers."""
    return 1 << max(5, bits_of(-(-n // EACH)))


def pack(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted keys as differences, and their counts, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    rows = [(steps >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(8)]
    if counts is not None:
        rows += [(counts >> 8 * k).astype(np.uint8).tobytes() for k in range(4)]
    return pa.compress(b"".join(rows), codec="zstd", asbytes=True)


def unpack(n: int, data: bytes, counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    rows = np.frombuffer(pa.decompress(data, n * (12 if counted else 8), codec="zstd", asbytes=True), np.uint8).reshape(-1, n)
    steps, counts = np.zeros(n, np.uint64), np.zeros(n, np.uint64) if counted else None
    for k in range(8):
        steps |= rows[k].astype(np.uint64) << np.uint64(8 * k)
    for k in range(4 if counted else 0):
        counts |= rows[8 + k].astype(np.uint64) << np.uint64(8 * k)
    return np.cumsum(steps, dtype=np.uint64), counts


def blocks(keys: np.ndarray, counts: np.ndarray | None, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys of so many bits, cut into parts by their highest bits."""
    edges = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(bits - bits_of(parts)))
    edges[-1] = len(keys)
    full = np.flatnonzero(np.diff(edges))
    for some in np.array_split(full, max(1, len(keys) * 4 // BATCH_BYTES)):
        data = [pack(keys[edges[p] : edges[p + 1]], None if counts is None else counts[edges[p] : edges[p + 1]]) for p in some]
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(np.diff(edges)[some], pa.int32()), pa.array(data, pa.binary())], ["part", "n", "keys"])


def opened(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    for b in batches:
        for n, data in zip(b.column(1).to_pylist(), b.column(2)):
            yield unpack(n, data.as_buffer(), counted)


def gathered(batches: Iterator[pa.RecordBatch], size) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of AT_ONCE by size at least, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += size(b)
        if n >= AT_ONCE:
            yield held
            held, n = [], 0
    if held:
        yield held


def pair_keys(ids: np.ndarray, line: np.ndarray, window: int, bits: int) -> np.ndarray:
    """A key for each two different words of a line, the second of which is at most window words behind the first; sorted."""
    out, mask = [], np.uint64((1 << 2 * bits) - 1)
    for s in range(1, min(window, len(ids) - 1) + 1):
        a, b = ids[:-s], ids[s:]
        ok = (line[:-s] == line[s:]) & (a != b)
        a, b = a[ok], b[ok]
        out.append(np.minimum(a, b) << np.uint64(bits) | np.maximum(a, b))
    keys = np.concatenate(out) if out else np.empty(0, np.uint64)
    keys *= np.uint64(ODD)
    keys &= mask
    keys.sort()
    return keys


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal keys, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(starts, append=len(keys))


def count_in_chunks(words: str, window: int, bits: int, parts: int):
    """An Arrow function (hs: hashes of a line's words) -> blocks of the pairs of each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, lambda b: len(b.column(0).flatten())):
            hashes, places = words_at(words, "h")
            lines = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            own = lines.flatten().dictionary_encode()
            ids = places[np.searchsorted(hashes, own.dictionary.to_numpy(zero_copy_only=False))].astype(np.uint64)[own.indices.to_numpy(zero_copy_only=False)]
            line = np.repeat(np.arange(len(lines), dtype=np.int32), np.diff(lines.offsets.to_numpy()))
            keys = pair_keys(ids, line, window, bits)
            starts, n = runs(keys)
            if len(starts):
                yield from blocks(keys[starts], n, 2 * bits, parts)

    return run


def add_up(words: str, least: int, bits: int):
    """An Arrow function: blocks of a part -> its pairs that occur so often at least, with the counts of pair and words."""
    room = 64 - 2 * bits
    most, undo, mask = (1 << min(room, 31)) - 1, np.uint64(pow(ODD, -1, 1 << 64)), np.uint64((1 << 2 * bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for keys, n in opened(batches, True):
            while (over := n > most).any():  # a count that doesn't fit beside its key is several
                found.append(keys[over] << np.uint64(room) | np.uint64(most))
                n[over] -= np.uint64(most)
            found.append(keys << np.uint64(room) | n)
        if not found:
            return
        whole = np.concatenate(found)
        del found
        whole.sort()
        keys = whole >> np.uint64(room)
        whole &= np.uint64((1 << room) - 1)
        starts, _ = runs(keys)
        n = np.add.reduceat(whole, starts)
        enough = n >= least
        keys, n = (keys[starts[enough]] * undo) & mask, n[enough].astype(np.int64)
        counts = words_at(words, "n")
        for at in range(0, len(keys), 1 << 16):
            a, b = (keys[at : at + (1 << 16)] >> np.uint64(bits)).astype(np.int32), (keys[at : at + (1 << 16)] & np.uint64((1 << bits) - 1)).astype(np.int32)
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(n[at : at + (1 << 16)]), pa.array(counts[a]), pa.array(counts[b])], ["a", "b", "n", "x", "y"])

    return run


def counted(lines: DataFrame, words: str, n_words: int, tokens: int, window: int, least: int) -> DataFrame:
    """a, b, n, x, y: pairs of words (places in the table at words) that occur so often at least, and how often each of the two does. lines: hs, the words' hashes."""
    bits = bits_of(n_words)
    if bits > 30:
        raise ValueError("more than a thousand million words")
    parts = min(parts_of(5 * tokens), 1 << 2 * bits)
    cut = in_batches(lines, count_in_chunks(words, window, bits, parts), BLOCKS)
    return in_batches(cut.repartitionById(parts, F.col("part")), add_up(words, least, bits), COUNTED)


def best_in_chunks(k: int, bits: int, parts: int):
    """An Arrow function (a, b, strength) -> blocks of keys word, less strength, less other; the k best of each word in a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, lambda b: 2 * b.num_rows):
            a, b, s = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]).astype(np.uint64) for c in range(3))
            keys = first_of(np.concatenate([ranked(a, b, s, bits), ranked(b, a, s, bits)]), k, bits)[0]
            if len(keys):
                yield from blocks(keys, None, 2 * bits + STRENGTH, parts)

    return run


def ranked(word: np.ndarray, other: np.ndarray, strength: np.ndarray, bits: int) -> np.ndarray:
    return (word << np.uint64(STRENGTH) | np.uint64((1 << STRENGTH) - 1) - strength) << np.uint64(bits) | np.uint64((1 << bits) - 1) - other


def first_of(keys: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k keys of each word, sorted, and their numbers from 1."""
    keys.sort()
    starts, n = runs(keys >> np.uint64(bits + STRENGTH))
    number = np.arange(1, len(keys) + 1) - np.repeat(starts, n)
    return keys[number <= k], number[number <= k]


def best(words: str, k: int, bits: int):
    """An Arrow function: blocks of a part -> word, other, strength, k."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [keys for keys, _ in opened(batches, False)]
        if not found:
            return
        keys, number = first_of(np.concatenate(found), k, bits)
        spelling = words_at(words, "word")
        for at in range(0, len(keys), 1 << 16):
            some = keys[at : at + (1 << 16)]
            word, other = some >> np.uint64(bits + STRENGTH), np.uint64((1 << bits) - 1) - (some & np.uint64((1 << bits) - 1))
            strength = np.uint64((1 << STRENGTH) - 1) - (some >> np.uint64(bits) & np.uint64((1 << STRENGTH) - 1))
            yield pa.record_batch([spelling.take(pa.array(word)), spelling.take(pa.array(other)), pa.array(strength.astype(np.int64)), pa.array(number[at : at + (1 << 16)].astype(np.int32))], ["word", "other", "strength", "k"])

    return run


def related(strong: DataFrame, pairs: int, words: str, n_words: int, k: int) -> DataFrame:
    """word, other, strength, k: the k strongest others of each word, the last in order of letters first where strengths are equal. strong: a, b, strength below 2^14."""
    bits = bits_of(n_words)
    parts = min(parts_of(2 * pairs), 1 << bits)
    cut = in_batches(strong, best_in_chunks(k, bits, parts), BLOCKS)
    return in_batches(cut.repartitionById(parts, F.col("part")), best(words, k, bits), "word string, other string, strength bigint, k int")


def spelled(df: DataFrame, words: str, **names: str) -> DataFrame:
    """df with words for their places: names are columns of places and what they are called then."""
    kept = [c for c in df.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spelling = words_at(words, "word")
            yield pa.record_batch([*(spelling.take(b.column(b.schema.get_field_index(c))) for c in names), *(b.column(b.schema.get_field_index(c)) for c in kept)], [*names.values(), *kept])

    return in_batches(df, run, ", ".join([*(f"{x} string" for x in names.values()), *(f"{c} {dict(df.dtypes)[c]}" for c in kept)]))
