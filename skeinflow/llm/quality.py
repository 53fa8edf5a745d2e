"""Quality filter: an interpolated modified Kneser-Ney bigram model of trusted text, and each document's perplexity under it.

* Trusted rows are those labelled quality 1 and not toxic. Four fifths of them train; the others calibrate.
* One pass turns every whole text into token ids of a public tokenizer (at most 65,534 of them, so a pair is one 32-bit number; no
  word is unknown). It writes blocks of about BLOCK_TOKENS tokens with the distinct pairs in each, and the training pairs' counts.
* Pair counts are summed, and the discounts, continuation counts and context weights of modified Kneser-Ney come from them
  with aggregates; tables by one token id have at most 65,536 rows.
* The distinct pairs of all blocks are joined with the counts, in shards by pair, which gives each pair's log-probability. They are
  written out by groups of 2**GROUP_BITS input parts, and the task that reads a block reads those of its own pairs too and adds them up by
  document. Neither texts nor ids are shuffled, and the counts are never in one place.
* A document is kept if its perplexity is no higher than what all but REJECT of the trusted calibration texts of its language have,
  times MARGIN. That limit is the mean of the language's own (weighted by its calibration texts) and all languages' (weighted as PRIOR texts), so
  it moves from one to the other with what is known of the language, without a switch.

A null or empty text has no token: its perplexity is null and it isn't kept. Null languages are one language. Null or repeated
doc_ids are rows like any other (a null doc_id is never trusted). Without trusted rows nothing is rejected but empty texts.
Columns other than doc_id, text and lang, and doc_id, quality and toxic of the labels, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, new_path, slices, small_enough, staged
from .tokens import default_path, tokenizer

BLOCK_TOKENS = 8 << 20
#: Ids are most of what is written: the window holds a whole block, so what occurs again in it is written once.
PACKED = {"window_log": 24, "enable_ldm": True}
PACK_LEVEL = 6
#: Pairs held by a task before they are made distinct.
PAIRS_AT_ONCE = 1 << 20
START = 65_535
#: A block is its input part and a number below 2**PART_BITS.
PART_BITS = 24
GROUP_BITS = 4
REJECT = 0.01
MARGIN = 1.1
PRIOR = 20


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """The pairs of a document's ids, the first after the start mark."""
    wide = ids.astype(np.uint32)
    return np.concatenate([np.array([START], np.uint32), wide[:-1]]) << np.uint32(16) | wide


class Counts:
    """Distinct pairs and how often they were added; what is held is made distinct whenever there is much of it."""

    def __init__(self):
        self.pairs, self.times, self.held = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0

    def add(self, pairs: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.times.append(np.ones(len(pairs), np.int64))
        self.held += len(pairs)
        if self.held > PAIRS_AT_ONCE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        every, which = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.bincount(which, np.concatenate(self.times), len(every)).astype(np.int64)
        self.pairs, self.times, self.held = [every], [times], 0
        return every, times


def blocks(path: str):
    """An Arrow function (doc_id, text, lang, trust) -> blocks of documents, and counts of training pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = tokenizer(path), zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(PACK_LEVEL, **PACKED))
        encode = words.text
        part, made = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        columns: list[list] = [[], [], [], []]
        ids: list[bytes] = []
        every, learned, size = Counts(), Counts(), 0

        def batch(id_type: pa.DataType) -> pa.RecordBatch:
            train, times = learned.merge()
            kinds = {"doc_ids": pa.list_(id_type), "langs": pa.list_(pa.string()), "trust": pa.list_(pa.int32()), "ids": pa.binary(), "block": pa.int64(), "pairs": pa.list_(pa.int32()), "train": pa.list_(pa.int32())}
            row = {"block": part << PART_BITS | made, "doc_ids": columns[0], "langs": columns[1], "trust": columns[2], "lengths": columns[3], "ids": pack.compress(b"".join(ids)), "pairs": every.merge()[0].view(np.int32), "train": train.view(np.int32), "times": times}
            return pa.record_batch([pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in row.items()], list(row))

        id_type = None
        for b in slices(batches):
            id_type = b.column(0).type
            for doc_id, text, lang, trust in zip(*(b.column(k).to_pylist() for k in range(4))):
                one = np.frombuffer(encode(text or ""), "<u4").astype("<u2")
                ids.append(one.tobytes())
                if len(one):
                    pairs = pairs_of(one)
                    every.add(np.unique(pairs))
                    if trust == 1:
                        learned.add(pairs)
                for c, v in zip(columns, (doc_id, lang, trust, len(one))):
                    c.append(v)
                size += len(one)
                if size >= BLOCK_TOKENS:
                    yield batch(id_type)
                    made, size, ids, columns, every, learned = made + 1, 0, [], [[], [], [], []], Counts(), Counts()
        if ids:
            yield batch(id_type)
        words.forget()

    return run


def scorer(folder: str):
    """An Arrow function: blocks -> a row for each document, with the log-probabilities of a block's pairs from the committed table in folder.

    A merge join on the map side: the table is laid out by input part, so each task reads what its own blocks asked for, and neither
    texts nor ids are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        files, at = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for k in range(b.num_rows):
                block, doc_ids, langs, trust, lengths, ids = (b.column(j)[k] for j in range(6))
                n = np.array(lengths.values)
                flat = np.frombuffer(unpack.decompress(ids.as_py()), "<u2")
                keys, logs = np.empty(0, np.uint32), np.empty(0)
                if len(flat):
                    found = pq.read_table(f"{at}/parts={block.as_py() >> PART_BITS + GROUP_BITS}", filesystem=files, columns=["pair", "logp"], filters=[("block", "=", block.as_py())], partitioning=None)
                    keys, logs = found.column("pair").to_numpy().view(np.uint32), found.column("logp").to_numpy()
                    order = np.argsort(keys)
                    keys, logs = keys[order], logs[order].astype(np.float64)
                ends = np.cumsum(n)
                total = np.zeros(len(n))
                for i, (lo, hi) in enumerate(zip(ends - n, ends)):
                    if hi > lo:
                        p = pairs_of(flat[lo:hi])
                        place = np.searchsorted(keys, p)
                        if (keys[np.minimum(place, len(keys) - 1)] != p).any():
                            raise ValueError("a pair of this block has no probability")
                        total[i] = -logs[place].sum()
                yield pa.record_batch([doc_ids.values, langs.values, trust.values, pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["doc_id", "lang", "trust", "n_tokens", "nll"])

    return run


def discounts(counts: DataFrame, column: str) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from counts of counts."""
    n = {r.c: r.n for r in counts.where(F.col(column) <= 4).groupBy(F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]  # too few counts to estimate from
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def discount(column, d: list[float]):
    return F.when(column == 1, d[0]).when(column == 2, d[1]).when(column >= 3, d[2]).otherwise(0.0)


def log_probabilities(asked: DataFrame, counts: DataFrame, vocabulary: int) -> DataFrame:
    """asked (pair, ...) with logp, by counts (pair, n)."""
    a, b = F.shiftrightunsigned("pair", 16), F.col("pair").bitwiseAND(F.lit(65_535))
    known = counts.select("pair", "n", a.alias("a"), b.alias("b"))
    d = discounts(counts, "n")
    after = known.groupBy("a").agg(F.sum("n").alias("total"), F.sum(discount(F.col("n"), d)).alias("spare"))
    before = staged(known.groupBy("b").agg(F.count(F.lit(1)).alias("kinds")), "before")
    e = discounts(before, "kinds")
    sums = before.agg(F.sum("kinds").alias("t"), F.sum(discount(F.col("kinds"), e)).alias("s")).collect()[0]
    types, rest = sums.t or 0, sums.s or 0.0
    uniform = 1.0 / (vocabulary + 1)
    if not types:
        return asked.withColumn("logp", F.lit(float(np.log(uniform))))
    low = before.select("b", ((F.col("kinds") - discount(F.col("kinds"), e)) / types + rest / types * uniform).alias("low"))
    rows = asked.withColumns({"a": a, "b": b}).join(known.select("pair", "n"), "pair", "left")
    rows = rows.join(F.broadcast(after), "a", "left").join(F.broadcast(low), "b", "left")  # at most 65,536 rows each, whatever the corpus
    below = F.coalesce("low", F.lit(rest / types * uniform))
    n = F.coalesce("n", F.lit(0))
    p = F.when(F.col("total").isNull(), below).otherwise((n - discount(n, d)) / F.col("total") + F.col("spare") / F.col("total") * below)
    return rows.select(*asked.columns, F.log(p).alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, lang, trust (1 trained on, 2 calibrated on, else 0), n_tokens, nll (sum); written and read back."""
    ids = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    ids = staged(ids.select("doc_id", F.when(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0, 2).otherwise(1).alias("trust")), "trusted")
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(ids) if small_enough(ids) else ids, "doc_id", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"block bigint, doc_ids array<{kind}>, langs array<string>, trust array<int>, lengths array<bigint>, ids binary, pairs array<int>, train array<int>, times array<bigint>"
    path = path or default_path()
    made = staged(in_arrow(rows.select("doc_id", "text", "lang", F.coalesce("trust", F.lit(0)).alias("trust")), blocks(path), shape), "blocks")
    counts = made.select(F.explode(F.arrays_zip("train", "times")).alias("x")).groupBy(F.col("x.train").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = staged(counts, "counts")
    each = made.select("block", F.explode("pairs").alias("pair"))
    asked = log_probabilities(each, counts, tokenizer(path).whole.get_vocab_size())
    asked = asked.select("block", "pair", F.col("logp").cast("float").alias("logp")).repartition(F.shiftright("block", PART_BITS))
    folder = new_path(docs.sparkSession, "logs")
    asked.withColumn("parts", F.shiftright("block", PART_BITS + GROUP_BITS)).sortWithinPartitions("parts", "block", "pair").write.option("compression", "zstd").partitionBy("parts").parquet(folder)
    scored = in_arrow(made.select("block", "doc_ids", "langs", "trust", "lengths", "ids"), scorer(folder), f"doc_id {kind}, lang string, trust int, n_tokens bigint, nll double")
    return staged(scored, "scored")


def quality(docs: DataFrame, labels: DataFrame, path: str | None = None, reject: float = REJECT, margin: float = MARGIN) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_tokens, perplexity, threshold (of its language), kept."""
    rows = perplexities(docs, labels, path).withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(F.col("nll") / F.col("n_tokens"))))
    check = rows.where("trust = 2 and perplexity is not null")
    cut = F.percentile_approx("perplexity", F.lit(1 - reject), F.lit(10_000))
    by_lang = check.groupBy(F.col("lang").alias("l")).agg(F.log(cut).alias("cut"), F.count(F.lit(1)).alias("m"))
    overall = check.agg(F.log(cut).alias("cut_all"))
    out = rows.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(overall))  # overall: one row
    m = F.coalesce("m", F.lit(0))
    limit = F.exp((m * F.coalesce("cut", F.lit(0.0)) + PRIOR * F.col("cut_all")) / (m + PRIOR)) * margin
    return out.select("doc_id", "lang", "n_tokens", "perplexity", limit.alias("threshold"), (F.col("perplexity").isNotNull() & (limit.isNull() | (F.col("perplexity") <= limit))).alias("kept"))
