"""Nearest vectors of a query set, in Arrow batches: a product of matrices for each batch, and the best of each task, instead of a join of every pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass over the vectors; vectors and queries compared at once, half a megabyte of products, whatever the size of the tables.
QUERIES_AT_ONCE = 1024
VECTORS_AT_ONCE = 1024
TILE = 64
#: Less than any cosine, and still has a negative.
NONE = -(1 << 62)
FOUND = "q bigint, v bigint, ql int, vl int, cosine bigint"


def dots_of(queries: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of queries (a row each) and vectors (a column each)."""
    dots = np.zeros((len(queries), v.shape[1]))
    for d in range(len(v)):  # in the order of the components, as a fold adds them up
        dots += queries[:, d, None] * v[d]
    return dots


def better(best: tuple, dots: np.ndarray, ids: np.ndarray, number: np.ndarray, label: np.ndarray) -> tuple:
    """best (cosines, numbers and labels, a row for each query) with the vectors that belong there; only those are sorted."""
    cosine = np.floor(dots * 1_000_000 + 0.5).astype(np.int64)
    cosine[number == ids[:, None]] = NONE
    row, column = np.nonzero((cosine >= best[0][:, -1:]) & (cosine > NONE))
    if not len(row):
        return best
    k = best[0].shape[1]
    new = cosine[row, column], number[column], label[column]
    every = [np.concatenate([x.ravel(), y]) for x, y in zip(best, new)]
    row = np.concatenate([np.repeat(np.arange(len(ids)), k), row])
    order = np.lexsort((every[1], -every[0], row))
    starts = np.searchsorted(row[order], np.arange(len(ids)))
    first = order[starts[:, None] + np.arange(k)]
    return tuple(x[first] for x in every)


def best_of(queries: np.ndarray, ids: np.ndarray, labels: list, k: int):
    """An Arrow function (vec_id, label, embedding) -> the k best of a task for each query: by cosine in millionths, then by number."""
    kinds = np.array(labels, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [tuple(np.full((len(ids[at : at + TILE]), k), fill, np.int64) for fill in (NONE, 0, 0)) for at in range(0, len(ids), TILE)]
        for b in batches:
            for at in range(0, b.num_rows, VECTORS_AT_ONCE):
                part = b.slice(at, VECTORS_AT_ONCE)
                v = np.ascontiguousarray(np.stack(part.column(2).to_numpy(zero_copy_only=False)).astype(np.float64).T)
                number, label = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for t, best in enumerate(top):
                    own = slice(t * TILE, t * TILE + TILE)
                    top[t] = better(best, dots_of(queries[own], v), ids[own], number, label)
        for t, best in enumerate(top):
            own = slice(t * TILE, t * TILE + TILE)
            real = (best[0] > NONE).ravel()
            columns = [np.repeat(ids[own], k)[real], best[1].ravel()[real], np.repeat(kinds[own], k)[real], best[2].ravel()[real], best[0].ravel()[real]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["q", "v", "ql", "vl", "cosine"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, v, ql, vl, cosine, r of the k nearest of vectors (vec_id, label, embedding) for each query, itself left out. Queries go in blocks, one pass over the vectors each."""
    rows = vectors.where("embedding is not null").select("vec_id", "label", "embedding")
    found, block = None, []

    def search() -> DataFrame:
        q = np.array([r.embedding for r in block], np.float64)
        return rows.mapInArrow(best_of(q, np.array([r.vec_id for r in block], np.int64), [r.label for r in block], k), FOUND)

    for r in queries.where("embedding is not null").select("vec_id", "label", "embedding").toLocalIterator():
        block.append(r)
        if len(block) == QUERIES_AT_ONCE:
            found, block = search() if found is None else found.unionByName(search()), []
    if block or found is None:
        found = (search() if found is None else found.unionByName(search())) if block else vectors.sparkSession.createDataFrame([], FOUND)
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "v")))
    return ranked.where(F.col("r") <= k)
