"""Helpers shared by the training-data operators: work folder, staging, size-checked broadcasts, word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 8 to 24 bytes up to which a key list is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Entries of a worker's word cache. The cache is only for speed: it is emptied when full.
CACHE_WORDS = 400_000
#: Edges up to which the driver joins up components itself.
DRIVER_EDGES = 200_000
#: Bytes of an Arrow batch that goes to or comes from a worker.
BATCH_BYTES = 4 << 20
#: Delimiters of the word rule [^\x20\x09-\x0D]+; bytes.split() cuts at exactly these.
SPACES = "\\x20\\x09-\\x0D"


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master (tests) may do without, and gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skeinflow-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Returns a worker's unused memory to the system: workers stay for other tasks, and what one operator needed isn't there for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def giving_back(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def in_arrow(df: DataFrame, f, shape) -> DataFrame:
    """df.mapInArrow, with Arrow batches of bounded bytes unless the session says otherwise (by default a batch is 10,000 rows, however long their texts are), and
    with workers that give their memory back at the end of a task.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(giving_back(f), shape)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and a lost executor costs nothing done before."""
    spark = df.sparkSession
    at = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def local_rows(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """The driver's rows of whole numbers, by way of Arrow: from lists or pandas, Spark starts a daemon and Python workers of another kind on every executor, which stay."""
    columns = zip(*rows) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({k: pa.array(x, pa.int64()) for k, x in zip(names, columns)}), ", ".join(f"{k} bigint" for k in names))


def key_of(*columns: str) -> list[Column]:
    """k1, k2: a 128-bit key of columns, by two hashes with different seeds."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")]


def keep_keys(docs: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """docs without the rows that found drops. found: staged (k1, k2, stays), a row for each row of docs or only for those whose key has a row to drop.

    Rows of one key (equal in columns) that don't all stay are repeated rows, of which one stays.
    """
    names = {"k1": "__k1_of_row", "k2": "__k2_of_row"}
    keys = list(names.values())
    some = found.groupBy("k1", "k2").agg(F.max("stays").alias("stays"), F.min("stays").alias("all")).where("not all").withColumnsRenamed(names)
    some = staged(some.select(*keys, "stays"), "drop")
    wide = docs.withColumns(dict(zip(keys, key_of(*columns))))
    hint = F.broadcast if small_enough(some) else lambda df: df
    out = wide.join(hint(some.select(*keys)), keys, "left_anti")
    thin = some.where("stays").select(*keys)
    if thin.limit(1).count():
        out = out.unionByName(wide.join(hint(thin), keys, "left_semi").dropDuplicates(keys))
    return out.drop(*keys)


def small_enough(ids: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ids (narrow, staged rows) has at most limit rows. Reads no more than limit + 1 rows."""
    return ids.limit(limit + 1).count() <= limit


def keep_or_drop(rows: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """left_semi or left_anti of rows by a staged list of keys; the list is broadcast only when its counted size allows it."""
    return rows.join(F.broadcast(ids) if small_enough(ids) else ids, key, how)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of a public mixing function)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Bytes of text that are hashed at once: the arrays for them stay in a core's cache. A longer word is hashed alone.
HASHED_AT_ONCE = 1 << 19
SUMMED_AT_ONCE = 1 << 15


def powers(odd: int, n: int) -> np.ndarray:
    steps = np.full(n, odd, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_STEP = 0x9E3779B97F4A7C15
_UP, _DOWN = powers(_STEP, SUMMED_AT_ONCE), powers(pow(_STEP, -1, 1 << 64), SUMMED_AT_ONCE)


def hashed(a: np.ndarray, breaks: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of bytes a (runs outside SPACES, and none across breaks), and the words' first bytes.

    A word's hash is the mixed sum of random numbers for its bytes times powers for their places, so numpy does all words at once: it is a difference of
    two running sums, in which places count from anywhere, times the inverse power of the word's first place.
    """
    solid = ((a - np.uint8(9)) > 4) & (a != 32)
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(a))]
    start[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    lo = np.flatnonzero(start)
    if not len(lo):
        return np.empty(0, np.uint64), lo
    hi, table = np.flatnonzero(stop) + 1, _LOWER if lower else _BYTES
    out, sums = np.empty(len(lo), np.uint64), np.zeros(SUMMED_AT_ONCE + 1, np.uint64)
    k = 0
    while k < len(lo):
        at, upto = lo[k], int(np.searchsorted(hi, lo[k] + SUMMED_AT_ONCE, "right"))
        if upto > k:
            own, size = slice(k, upto), hi[upto - 1] - at
            np.cumsum(table[a[at : at + size]] * _UP[:size], out=sums[1 : size + 1])
            out[own] = (sums[hi[own] - at] - sums[lo[own] - at]) * _DOWN[lo[own] - at]
        else:
            upto = k + 1
            out[k] = np.sum(table[a[at : hi[k]]] * powers(_STEP, hi[k] - at))
        k = upto
    return mix(out + (hi - lo).astype(np.uint64)), lo


def column_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a string column, one row after the other, and where each row's begin (with the end of all). A null has no words."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    found, ends, made, row = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0, 0
    while row < len(column):
        upto = max(row + 1, int(np.searchsorted(at, at[row] + HASHED_AT_ONCE, "right")) - 1)
        h, lo = hashed(data[at[row] : at[upto]], at[row : upto + 1] - at[row], lower)
        found.append(h)
        ends.append(made + np.searchsorted(lo, at[row + 1 : upto + 1] - at[row]))
        made += len(h)
        row = upto
    return np.concatenate(found), np.concatenate(ends)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about most_bytes at most, one row at least: memory stays bounded with very long texts."""
    for b in batches:
        if not b.num_rows:
            continue
        i = b.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; None stays None."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def with_group(rows: DataFrame, keys: list[str], first: list, final: list, by: str, salts: int = 16) -> DataFrame:
    """rows with figures of their group, without a task that gets a whole hot group.

    first aggregates each (keys, salt), final aggregates those parts, and the result goes back only to the salts that occur.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    part = salted.groupBy(*keys, "__salt").agg(*first)
    whole = part.groupBy(*keys).agg(*final, F.collect_set("__salt").alias("__salts"))
    back = whole.withColumn("__salt", F.explode("__salts")).drop("__salts")
    return salted.join(back, [*keys, "__salt"]).drop("__salt")


def components(edges: DataFrame, limit: int = DRIVER_EDGES) -> DataFrame:
    """(node, comp) for each node of edges (a, b): comp is the smallest node reachable. edges must be staged.

    Up to limit edges the driver joins them up; beyond it, stars are contracted in turns (large stars, small stars) until no edge changes.
    """
    spark = edges.sparkSession
    if small_enough(edges, limit):
        pairs = edges.select("a", "b").toPandas()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(pairs.a.tolist(), pairs.b.tolist()):
            x, y = sorted((root(x), root(y)))
            parent[y] = x
        found = [(x, root(x)) for x in parent]
        at = new_path(spark, "components")
        local_rows(spark, found, ["node", "comp"]).write.parquet(at)
        return spark.read.schema("node bigint, comp bigint").parquet(at)
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    nodes = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v"))).where("u <> v")
        new = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        if not new.exceptAll(now).limit(1).count() and not now.exceptAll(new).limit(1).count():
            break
        now = new
    return staged(nodes.join(now.groupBy("u").agg(F.min("v").alias("comp")), nodes.node == F.col("u"), "left").select("node", F.coalesce("comp", "node").alias("comp")), "components")
