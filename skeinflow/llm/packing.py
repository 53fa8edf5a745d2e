"""Packing of token sequences by best-two-fit.

Documents become token ids (a public tokenizer's file, then an end id) and only documents longer than a sequence are cut. To
a packer, pieces of one length are alike, so it works on the histogram of lengths, which has at most max_len entries however
many documents there are:

* fill greedily: the longest unpacked piece opens a sequence; then, again and again, the longest that still fits joins it;
* then take the sequence's shortest piece out and look for the two unpacked pieces that together fill the gap that leaves
  more tightly; if there are such, they replace it;
* the filled pattern is used as many times as the counts allow.

The plan says which ranks of a length go to which sequences and offsets. Pieces get their rank within their length by
counts of small buckets, so that a length that a third of all pieces have is never in one task.

Null texts count as empty; an empty text is the end id alone. Null or repeated doc_ids are rows like any other. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, local_rows, slices, staged
from .tokens import default_path, tokenizer

MAX_LEN = 4096
END_ID = 1
PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(path: str, max_len: int, end_id: int):
    """An Arrow function (doc_id, text) -> a row for each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        encode = words.text
        for b in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at : at + 4 * max_len]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch([b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.forget()

    return run


def best_two_fit(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, list[int]]]:
    """[(times, lengths)]: sequences to make, as patterns, from counts of pieces by length."""
    left = np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    if left[max_len]:
        out.append((int(left[max_len]), [max_len]))
        left[max_len] = 0
    below = np.maximum.accumulate(np.where(left > 0, np.arange(max_len + 1), 0))  # the longest unpacked length up to each
    while below[max_len]:
        bin_, used, gap = [], {}, max_len
        while gap and (x := int(below[gap])):
            if used.get(x, 0) >= left[x]:  # as many as there are are in this sequence
                smaller = x
                while (smaller := int(below[smaller - 1])) and used.get(smaller, 0) >= left[smaller]:
                    pass
                if not (x := smaller):
                    break
            bin_.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        least = bin_[-1]
        if gap and len(bin_) > 1:
            room = gap + least
            free = left.copy()
            for x, n in used.items():
                free[x] -= n
            near = np.maximum.accumulate(np.where(free[: room + 1] > 0, np.arange(room + 1), 0))
            first = np.flatnonzero(free[: room + 1] > 0)
            second = near[room - first]
            twice = (second == first) & (free[first] < 2)
            if twice.any():
                near1 = near[np.maximum(first - 1, 0)]
                second = np.where(twice, near1, second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > least:
                k = int(total.argmax())
                bin_[-1:] = sorted((int(first[k]), int(second[k])), reverse=True)
                used = {x: bin_.count(x) for x in bin_}
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= times * n
        if any(not left[x] for x in used):
            below = np.maximum.accumulate(np.where(left > 0, np.arange(max_len + 1), 0))
        out.append((times, bin_))
    return out


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): at most a few rows for each length."""
    rows, given, base = [], dict.fromkeys(counts, 0), 0
    for times, lengths in best_two_fit(counts, max_len):
        at = 0
        for x in lengths:
            rows.append((x, given[x], times, base, at))
            given[x] += times
            at += x
        base += times
    return rows


def token_pieces(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; written and read back."""
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString())
    return staged(in_arrow(docs.select("doc_id", "text"), pieces_of(path or default_path(), max_len, end_id), schema), "pieces")


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: those of token_pieces, sequence_id, and offset (the piece's place in its sequence)."""
    spark = docs.sparkSession
    found = token_pieces(docs, path, max_len, end_id)
    by_length = {r.length: r.n for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_len rows at most
    buckets = max(16, sum(by_length.values()) // 500_000)
    rows = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = local.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("skip"))
    steps = local_rows(spark, plan(by_length, max_len), ["length", "first", "times", "base", "offset"])
    at = F.broadcast(steps.withColumnRenamed("length", "len"))  # bounded by max_len, not by the data
    out = ranked.join(at, (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("times")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
