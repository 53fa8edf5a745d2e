"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on the full shingle sets.

A document's words are its runs of characters outside [\\x20\\x09-\\x0D], A-Z lower-cased; its set is its distinct 2-word shingles
(with one word, that word; without words or with a null text, empty and linked with nothing). Documents are linked when
100 * intersection >= 75 * union, and components of linked documents are reported.

1. Each whole text becomes 64-bit shingle hashes and 128 MinHash coordinates. Equal sets form one class, by a 128-bit fingerprint of
   the set; from here on only classes are compared.
2. Skipping: a pair at 0.75 agrees on 3 or more of 42 triples of coordinates, but for 5 in 100 million. A class with fewer than 3 triples that
   occur again has no partner, and is skipped before any posting. Triples of unlike texts hardly ever coincide, so what goes on is
   about as many classes as have partners, whatever the size of the corpus.
3. The others are posted under each (coordinate, value). A pair at 0.75 collides on 96 of 128 coordinates on average, and on fewer than
   MATCHES = 70 of them less than once in 10 million times. So only values that occur again count, a class with fewer than 70 of those is
   done, and the rest are posted under their rarest values only, as a pair with 70 common values must share 8 among the first
   (size - 70 + 8) in order of rarity (prefix): pairs are counted, and those that meet in fewer than 8 lists are skipped. A value
   shared by very many is in no prefix unless nearly all of a class's values are such.
4. Lists are merged in rounds: in each list, every class is compared with one leader, and what is linked becomes one component.
   A list whose members are all in one component needs no further pair: a group of thousands of near copies costs about as
   many comparisons as it has members. The last round compares all pairs of different components that still share a list
   and collide on 70 coordinates, so no link between components is missed; pairs within a component are never expanded.

Every comparison is of the full sets. Null and repeated doc_ids are allowed: rows with equal sets are one class, and a
component's id is its smallest doc_id that isn't null. An empty table gives an empty result. Only doc_id and text are read.
drop_near keeps one row of each component: that with the smallest doc_id, a null one last; rows without a set all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_hashes, components, in_arrow, keep_keys, keep_or_drop, key_of, local_rows, mix, slices, small_enough, staged, with_group

COORDINATES = 128
MATCHES = 70
PER_CENT = 75
ROUNDS = 3
#: Prefixes are so long that a pair with MATCHES common values meets in this many lists at least; fewer meetings need no look.
TOGETHER = 8
#: Triples of coordinates, and how many of them a pair has in common at least.
TRIPLES = COORDINATES // 3
COMMON_TRIPLES = 3
#: Bits of a key: 7 for the coordinate, 32 for the value.
KEY_BITS = 39
_random = np.random.default_rng(7)
_TIMES = _random.integers(0, 2**32, COORDINATES, np.uint32) | np.uint32(1)
_PLUS = _random.integers(0, 2**32, COORDINATES, np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text: the sorted distinct 64-bit hashes of its set."""
    h, first = column_hashes(column, lower=True)
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * _STEP + h[1:])
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(pairs[lo : hi - 1]) if hi - lo > 1 else mix(h[lo:hi] + _STEP)


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 2**32 - 1, np.uint32)
    half = (mix(found) >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(half), 2048):
        np.minimum(low, (half[k : k + 2048, None] * _TIMES + _PLUS).min(axis=0), out=low)
    return low


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), ">i8").tolist())


def triples(sig: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each triple of coordinates."""
    x = sig[: 3 * TRIPLES].astype(np.uint64).reshape(TRIPLES, 3)
    with np.errstate(over="ignore"):
        return (mix(mix(x[:, 0] << np.uint64(32) | x[:, 1]) + x[:, 2]) >> np.uint64(32)).astype(np.uint32)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind.to_pandas_dtype()), *parts]), kind))


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, k1, k2) -> the size and fingerprint of each set, and its triples."""
    for b in slices(batches):
        n, high, low, found = [], [], [], []
        for s in sets(b.column(1)):
            n.append(len(s))
            one, two = fingerprint(s)
            high.append(one)
            low.append(two)
            found.append(triples(signature(s)).view(np.int32) if len(s) else np.empty(0, np.int32))
        yield pa.record_batch([b.column(0), b.column(2), b.column(3), *(pa.array(x, pa.int64()) for x in (n, high, low)), lists(found, pa.int32())], ["doc_id", "k1", "k2", "n_shingles", "high", "low", "triples"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, node) -> node, size, signature, and the full set."""
    for b in slices(batches):
        found = [s for s in sets(b.column(0))]
        sigs = [signature(s).view(np.int32) for s in found]
        yield pa.record_batch([b.column(1), pa.array(map(len, found), pa.int64()), lists(sigs, pa.int32()), lists([s.view(np.int64) for s in found], pa.int64())], ["node", "size", "signature", "shingles"])


def survivors(classes: DataFrame) -> DataFrame:
    """(node) of the classes (node, triples) that have enough triples which occur again."""
    posted = classes.select("node", F.posexplode("triples").alias("i", "v")).select("node", F.shiftleft(F.col("i").cast("bigint"), 32).bitwiseOR(F.col("v").cast("bigint").bitwiseAND(F.lit(2**32 - 1))).alias("key"))
    again = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return staged(posted.join(again, "key", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_TRIPLES).select("node"), "survivors")


def prefixes(info: DataFrame) -> DataFrame:
    """(key, node, size): the prefix postings of classes that have enough values which occur again."""
    key = F.shiftleft(F.col("i").cast("bigint"), 32).bitwiseOR(F.col("v").cast("bigint").bitwiseAND(F.lit(2**32 - 1)))
    posted = info.select("node", "size", F.posexplode("signature").alias("i", "v")).select("node", "size", key.alias("key"))
    ranked = F.shiftleft(F.least("n", F.lit(2**24 - 1)), KEY_BITS).bitwiseOR(F.col("key"))  # sorts by rarity, then key, in one number
    again = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = posted.join(again, "key").groupBy("node", "size").agg(F.sort_array(F.collect_list(ranked)).alias("keys")).where(F.size("keys") >= MATCHES)  # 128 keys at most
    first = F.slice("keys", F.lit(1), F.size("keys") - (MATCHES - TOGETHER))
    return staged(found.select("node", "size", F.explode(first).alias("key")).withColumn("key", F.col("key").bitwiseAND(F.lit(2**KEY_BITS - 1))), "prefixes")


def info_of(docs: DataFrame, which: DataFrame) -> DataFrame:
    """(node, size, signature, shingles) of the classes of staged which (k1, k2, node), each from one row's text."""
    texts = docs.select("text", *key_of("doc_id", "text")).join(F.broadcast(which) if small_enough(which) else which, ["k1", "k2"])
    found = staged(in_arrow(texts.select("text", "node"), full_sets, "node bigint, size bigint, signature array<int>, shingles array<bigint>"), "sets")
    return found if found.count() == which.count() else staged(found.dropDuplicates(["node"]), "sets")


def narrow(pairs: DataFrame):
    """A broadcast hint for staged pairs where their count allows it, so that wide rows needn't move to meet them; else none."""
    return F.broadcast if small_enough(pairs) else lambda df: df


def linked(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Those of staged pairs (a, b) whose full sets are linked. A b that many a share is salted; only sets that pairs need move."""
    hint = narrow(pairs)
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(16)).alias("salt"))
    lead = info.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).join(hint(salted.select("b", "salt").distinct()), "b")
    own = info.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(hint(salted), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    found = own.join(lead, ["b", "salt"]).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))
    return staged(found.where(F.lit(100) * F.col("both") >= F.lit(PER_CENT) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct(), "linked")


def close_in_size(a: str, b: str):
    return F.lit(100) * F.least(a, b) >= F.lit(PER_CENT) * F.greatest(a, b)


def collide(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Those of staged pairs (a, b) whose signatures agree on enough coordinates."""
    hint = narrow(pairs)
    same = F.size(F.filter(F.zip_with("s1", "s2", lambda x, y: x == y), lambda z: z))
    left = info.select(F.col("node").alias("a"), F.col("signature").alias("s1")).join(hint(pairs), "a")
    right = info.select(F.col("node").alias("b"), F.col("signature").alias("s2")).join(hint(pairs.select("b").distinct()), "b", "left_semi")
    return left.join(right, "b").where(same >= MATCHES).select("a", "b")


def size_class(size: str):
    """Sizes within a ratio of PER_CENT are in the same or in neighbouring classes."""
    return F.floor(F.log(F.col(size)) / F.log(F.lit(100 / PER_CENT)) - 1e-9)


def merge(post: DataFrame, info: DataFrame) -> DataFrame:
    """(a, b): links that join up the components, found in rounds. post: (key, node, size)."""
    spark = post.sparkSession
    edges = local_rows(spark, [], ["a", "b"])
    now = post.withColumn("comp", F.col("node"))
    for k in range(ROUNDS + 1):
        groups = with_group(now, ["key"], [F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h") if k else F.col("node").alias("h"), "node", "size", "comp")).alias("m")],
                            [F.min("c1").alias("c1"), F.max("c2").alias("c2"), F.min("m").alias("m")], by="node")
        open_ = staged(groups.where("c1 < c2").drop("c1", "c2"), "open")
        if not open_.limit(1).count():
            break
        if k < ROUNDS:
            to_leader = open_.where((F.col("comp") != F.col("m.comp")) & close_in_size("size", "m.size"))
            counted = to_leader.groupBy("node", F.col("m.node").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TOGETHER)
            pairs = counted.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("n", (-F.col("b")).alias("minus"))).alias("x")).select("a", (-F.col("x.minus")).alias("b"))
        else:
            classed = open_.select("key", "node", "size", "comp", size_class("size").alias("k"))
            other = classed.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("comp").alias("comp_b"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
            every = classed.withColumnRenamed("node", "a").join(other, ["key", "k"]).where((F.col("comp") < F.col("comp_b")) & close_in_size("size", "size_b"))
            pairs = every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TOGETHER).select("a", "b")
            pairs = collide(staged(pairs, "met"), info)
        more = linked(staged(pairs, "pairs"), info)
        edges = staged(edges.unionByName(more), "links")
        if k < ROUNDS:
            comp = components(edges)
            left = open_.drop("comp", "m").join(comp.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
            now = staged(left.select("key", "node", "size", F.coalesce("comp", "node").alias("comp")), "round")
    return edges


def found_rows(docs: DataFrame) -> DataFrame:
    """near_duplicates with each row's key (k1, k2) of doc_id and text, its number (row), and stays: whether it is the one row of its component that stays."""
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 bigint, k2 bigint, n_shingles bigint, high bigint, low bigint, triples array<int>"
    signed = in_arrow(docs.select("doc_id", "text", *key_of("doc_id", "text")), sign, shape)
    signed = staged(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    rows = signed.drop("triples")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    classed = with_group(rows.where("n_shingles > 0"), ["high", "low"], [F.min("row").alias("node"), F.min(first).alias("first")], [F.min("node").alias("node"), F.min("first").alias("first")], by="row")
    classed = staged(classed.drop("high", "low"), "classes")
    copies = staged(rows.where("n_shingles = 0").select("row").unionByName(classed.where("row <> node").select("row")), "copies")
    near = survivors(keep_or_drop(signed.select("row", "triples"), copies, "left_anti", "row").select(F.col("row").alias("node"), "triples"))
    which = staged(keep_or_drop(rows.select(F.col("row").alias("node"), "k1", "k2"), near, "left_semi", "node"), "which")
    info = info_of(docs, which)
    edges = merge(prefixes(info), info)
    comp = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("spanning_links"))
    member = comp.join(degree, "node", "left")
    least = classed.select("node", "first").distinct().join(member, "node").groupBy("comp").agg(F.min("first").alias("lead"))
    found = staged(member.join(least, "comp").select("node", "lead", "spanning_links"), "membership")
    out = classed.join(F.broadcast(found) if small_enough(found) else found, "node", "left").withColumn("lead", F.coalesce("lead", "first"))
    out = out.select("k1", "k2", "row", "doc_id", "n_shingles", F.col("lead.doc_id").alias("component_id"), F.coalesce("spanning_links", F.lit(0)).alias("spanning_links"), (F.col("row") == F.col("lead.row")).alias("stays"))
    empty = rows.where("n_shingles = 0").select("k1", "k2", "row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("spanning_links"), F.lit(True).alias("stays"))
    return out.unionByName(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id), spanning_links.

    spanning_links counts the confirmed links of a row's class that join up its component, not all pairs within it, which are never expanded.
    """
    return found_rows(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "spanning_links")


def drop_near(docs: DataFrame) -> DataFrame:
    """docs with one row of each component; same columns."""
    return keep_keys(docs, staged(found_rows(docs).select("k1", "k2", "stays"), "near"), "doc_id", "text")
