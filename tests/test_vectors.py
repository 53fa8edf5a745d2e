"""Nearest vectors in tiles: the same as a plain sort, with ties, itself left out, and without more memory where there are more queries and vectors."""

import tracemalloc

import numpy as np
import pyarrow as pa

from skeinflow.operators import vectors


def batch(v, at=0):
    return pa.record_batch([pa.array(np.arange(at, at + len(v))), pa.array([None if k % 7 == 0 else k % 5 for k in range(len(v))], pa.int32()).fill_null(9), pa.array(list(v), pa.list_(pa.float32()))], ["vec_id", "label", "embedding"])


def test_tiles_are_a_plain_sort(monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS_AT_ONCE", 32)
    monkeypatch.setattr(vectors, "TILE", 8)
    v = np.random.default_rng(4).integers(-1, 2, (150, 4)).astype(np.float32) / 2  # many ties
    q = v[::7].astype(np.float64)
    for n, k in ((150, 6), (4, 6)):
        out = [r for b in vectors.best_of(q, np.arange(0, 150, 7), [0] * len(q), k)(iter([batch(v[:n][:90]), batch(v[:n][90:], 90)] if n > 90 else [batch(v[:n])])) for r in b.to_pylist()]
        got = {(r["q"], r["v"], r["cosine"]) for r in out}
        want = set()
        for at, x in zip(range(0, 150, 7), q):
            near = sorted((-int(np.floor((x * y.astype(np.float64)).sum() * 1_000_000 + 0.5)), j) for j, y in enumerate(v[:n]) if j != at)
            want |= {(at, j, -c) for c, j in near[:k]}
        assert got == want and len(out) == len(got)


def test_memory_does_not_grow_with_queries():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4096, 8)).astype(np.float32)
    b = batch(v)
    peaks = []
    for n in (64, 1024):
        q, run = v[:n].astype(np.float64), None
        run = vectors.best_of(q, np.arange(n), [0] * n, 30)
        tracemalloc.start()
        list(run(iter([b])))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 8  # the answers themselves; all products at once took over 100 MB
