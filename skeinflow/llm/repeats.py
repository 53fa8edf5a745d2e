"""Removal of repeated passages: documents are parsed into factors relative to the whole corpus as reference.

A window is WINDOW consecutive words of one document (words: runs outside [\\x20\\x09-\\x0D], unchanged). Every word that lies in
a window whose words also start anywhere else goes; windows are judged on the input.

* Index: the reference is cut into blocks by anchors, the smallest 8-word hash in each window. A window's anchor depends on its
  words alone, so equal windows lie in the same block, wherever they occur. The windows of a document that share an anchor are
  one phrase (1 to 28 windows in a row, so at least 35 words).
* Factors: a document is parsed from left to right into phrases, and each is looked up in its block, whatever document it
  came from. A phrase that occurs there as a whole is a factor of at least 35 words: all of it is a repeat. This settles
  nearly all repeats with one row for each phrase. A phrase whose anchor occurs nowhere else is new text.
* Boundaries: what is left are phrases whose anchor is known but which differ somewhere, as where a copied passage begins
  or ends. They are checked window by window against the phrases of the block, each distinct phrase once.

This is greedy relative Lempel-Ziv parsing with content-defined factor ends instead of longest matches from a suffix array,
since a longest match depends on what block it is searched in, and every document would have to visit every block.

Words and windows are compared by 64-bit hashes, phrases by two such (128 bits). A null text has no words; texts with fewer
than 35 words lose nothing. Null or repeated doc_ids are rows like any other, and repeated rows repeat each other. An empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_hashes, in_arrow, keep_or_drop, key_of, mix, raw, slices, small_enough, staged, with_group

WINDOW = 35
GRAM = 8
#: Distinct phrases of one anchor up to which one task compares them; beyond it, windows are counted by salted aggregation.
HOT = 20_000
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_STEP = np.uint64(_B1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    @staticmethod
    def powers(x: int, n: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self.powers(x, 2 * n) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_P1, _P2 = Powers(_B1), Powers(_B2)


class Sums:
    """Hashes of any span of words, by prefix sums."""

    def __init__(self, h: np.ndarray, powers: Powers):
        up, self.down = powers.to(len(h))
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up, out=self.sums[1:])

    def span(self, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[lo]) * self.down[lo] + (end - lo).astype(np.uint64))


def phrases(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, first window, last window, and two hashes of each phrase of a document with these word hashes."""
    if len(h) < WINDOW:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    g = h
    for k in (1, 2, 4):
        g = mix(g[:-k] * _STEP + g[k:])
    views = sliding_window_view(g, WINDOW - GRAM + 1)
    at = np.concatenate([views[k : k + 8192].argmin(axis=1) + np.arange(k, min(k + 8192, len(views))) for k in range(0, len(views), 8192)])
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:] - 1, [len(at) - 1]])
    return g[at[lo]], lo, hi, Sums(h, _P1).span(lo, hi + WINDOW), Sums(mix(h), _P2).span(lo, hi + WINDOW)


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text keys, row keys) -> these keys, words, digest and phrases of each text."""
    for b in slices(batches):
        n, sha, found = [], [], []
        h, first = column_hashes(b.column(1))
        for i, text in enumerate(raw(b.column(1))):
            n.append(int(first[i + 1] - first[i]))
            sha.append(digest(text.split() if text else []))
            found.append(phrases(h[first[i] : first[i + 1]]))
        ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
        columns = [np.concatenate([np.empty(0, t), *(f[k].astype(t) for f in found)]) for k, t in enumerate((np.uint64, np.int32, np.int32, np.uint64, np.uint64))]
        parts = pa.StructArray.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], ["anchor", "lo", "hi", "f1", "f2"])
        yield pa.record_batch([b.column(0), *(b.column(k) for k in (2, 3, 4, 5)), pa.array(n, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(ends, parts)], ["doc_id", "k1", "k2", "r1", "r2", "n_words", "sha", "phrases"])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node, spans) -> each span's windows as a list of hashes."""
    for b in slices(batches):
        anchor, where, lo, times, lists = [], [], [], [], []
        h, first = column_hashes(b.column(0))
        for i, (key, spans) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            sums = Sums(h[first[i] : first[i + 1]], _P1)
            for s in spans:
                at = np.arange(s["lo"], s["hi"] + 1)
                anchor.append(s["anchor"])
                where.append(key)
                lo.append(s["lo"])
                times.append(s["n"])
                lists.append(sums.span(at, at + WINDOW).view(np.int64))
        ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
        flat = pa.array(np.concatenate([np.empty(0, np.int64), *lists]))
        yield pa.record_batch([pa.array(anchor, pa.int64()), pa.array(where, pa.int64()), pa.array(lo, pa.int32()), pa.array(times, pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["anchor", "node", "lo", "n", "hashes"])


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node, spans of (lo, last window or -1, mask)) -> words removed and the digest of the rest."""
    for b in slices(batches):
        gone, sha = [], []
        for text, spans in zip(raw(b.column(0)), b.column(2).to_pylist()):
            words = text.split()
            step = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                if s["hi"] >= 0:
                    step[s["lo"]] += 1
                    step[s["hi"] + WINDOW] -= 1
                else:
                    for k in range(WINDOW - GRAM + 1):
                        if s["mask"] >> k & 1:
                            step[s["lo"] + k] += 1
                            step[s["lo"] + k + WINDOW] -= 1
            keep = np.cumsum(step[:-1]) == 0
            gone.append(len(words) - int(keep.sum()))
            sha.append(digest(list(compress(words, keep.tolist()))))
        yield pa.record_batch([b.column(1), pa.array(gone, pa.int64()), pa.array(sha)], ["node", "n_removed", "kept_sha256"])


def texts_with(docs: DataFrame, rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(text, node, spans) for each text that spans (node, spans) has. Of copies only one moves: the row that the text is named after."""
    one = staged(keep_or_drop(rows.where("row = node").select("r1", "r2", "node"), staged(spans.select("node"), "named"), "left_semi", "node"), "one")
    texts = docs.select("text", *(k.alias(n) for k, n in zip(key_of("doc_id", "text"), ("r1", "r2"))))
    found = texts.join(F.broadcast(one) if small_enough(one) else one, ["r1", "r2"]).drop("r1", "r2")
    return found.join(spans, "node").select("text", "node", "spans")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row for each row of docs, with the node that its text is named after; the spans of each node to remove, as (lo, hi, mask)."""
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 bigint, k2 bigint, r1 bigint, r2 bigint, n_words bigint, sha string, phrases array<struct<anchor:bigint,lo:int,hi:int,f1:bigint,f2:bigint>>"
    keys = [*key_of("text"), *(k.alias(n) for k, n in zip(key_of("doc_id", "text"), ("r1", "r2")))]
    parsed = staged(in_arrow(docs.select("doc_id", "text", *keys), parse, shape).withColumn("row", F.monotonically_increasing_id()), "parsed")
    # texts are told apart by 128 bits; each distinct text is worked on once, and counts as often as it occurs
    rows = with_group(parsed.drop("phrases"), ["k1", "k2"], [F.min("row").alias("node"), F.count(F.lit(1)).alias("times")], [F.min("node").alias("node"), F.sum("times").alias("times")], by="row")
    rows = staged(rows.drop("k1", "k2"), "rows")
    copies = staged(rows.where("row <> node").select("row"), "copies")
    often = staged(rows.where("row = node and times > 1").select("row", "times"), "often")
    texts = keep_or_drop(parsed.select("row", "phrases"), copies, "left_anti", "row")
    texts = texts.join(F.broadcast(often) if small_enough(often) else often, "row", "left")
    each = texts.select(F.col("row").alias("node"), F.coalesce("times", F.lit(1)).alias("times"), F.explode("phrases").alias("p")).select("node", "times", "p.*")
    known = each.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    again = staged(each.join(known, "anchor"), "known")
    distinct = staged(again.groupBy("anchor", "f1", "f2").agg(F.sum("times").alias("n"), F.min("node").alias("node")), "distinct")
    whole = with_group(again, ["anchor", "f1", "f2"], [F.sum("times").alias("n")], [F.sum("n").alias("n")], by="node").where("n > 1")
    factors = whole.select("node", "lo", "hi", F.lit(0).cast("bigint").alias("mask"))
    # boundaries: anchors with several distinct phrases, of which one at least isn't a factor
    blocks = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("least")).where("d > 1 and least = 1").select("anchor", "d")
    open_ = distinct.join(blocks, "anchor")
    spans = again.join(open_, ["anchor", "f1", "f2", "node"]).groupBy("anchor", "f1", "f2", "node").agg(F.min(F.struct("lo", "hi", "n")).alias("s"))
    todo = staged(spans.groupBy("node").agg(F.collect_list(F.struct("anchor", "s.lo", "s.hi", "s.n")).alias("spans")), "boundaries")
    lists = staged(in_arrow(texts_with(docs, rows, todo), windows, "anchor bigint, node bigint, lo int, n bigint, hashes array<bigint>"), "windows")
    hot = staged(blocks.where(F.col("d") > HOT).select("anchor"), "hot")
    is_hot = bool(hot.limit(1).count())
    usual = keep_or_drop(lists, hot, "left_anti", "anchor") if is_hot else lists
    item = F.posexplode("hashes").alias("k", "w")
    # one exchange, by anchor; the window and the aggregate after it need no other
    parts = usual.repartition("anchor").select("anchor", "node", "lo", "n", item)
    counted = parts.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("anchor", "w"))).where("c > 1 and n = 1")
    bit = F.expr("shiftleft(1L, k)")
    masks = counted.groupBy("anchor", "node", "lo").agg(F.sum(bit).alias("mask"))
    if is_hot:
        far = keep_or_drop(lists, hot, "left_semi", "anchor").select("anchor", "node", "lo", "n", item)
        far = with_group(far, ["anchor", "w"], [F.count(F.lit(1)).alias("c")], [F.sum("c").alias("c")], by="node").where("c > 1 and n = 1")
        masks = masks.unionByName(far.groupBy("anchor", "node", "lo").agg(F.sum(bit).alias("mask")))
    all_spans = factors.unionByName(masks.select("node", "lo", F.lit(-1).alias("hi"), "mask")).distinct()
    return rows, staged(all_spans.groupBy("node").agg(F.collect_list(F.struct("lo", "hi", "mask")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    rows, spans = repeated(docs)
    done = staged(in_arrow(texts_with(docs, rows, spans), remove, "node bigint, n_removed bigint, kept_sha256 string").dropDuplicates(["node"]), "removed")
    out = rows.select("doc_id", "node", "n_words", "sha").join(F.broadcast(done) if small_enough(done, 200_000) else done, "node", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
