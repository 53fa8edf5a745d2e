"""Parquet tables, as views under private names, and tables that several plans share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NAMED = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")
_SHARED = re.compile(r"\bskeinflow_s_\w+")
_DERIVED = re.compile(r"\bskeinflow_v_\w+")

#: Statements of shared tables, by name; those that need Python are functions of (spark, sf_dir).
SHARED: dict[str, str | Callable[[SparkSession, str], DataFrame]] = {}
#: What is made of shared tables whenever it is read, and not written; functions of (spark, sf_dir).
DERIVED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_WRITTEN: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master (tests) may do without, and gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skeinflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def file_of(spark: SparkSession, path: str):
    """The file system and the path, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def changed(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables that shared ones are made of were written last."""
    out = []
    for name in ("conversations", "documents"):
        fs, at = file_of(spark, f"{sf_dir}/{name}.parquet")
        out.append(fs.getFileStatus(at).getModificationTime() if fs.exists(at) else 0)
    return tuple(out)


def shared(d, *parts: tuple[str, str]) -> str:
    """CTEs of (name, statement), each of which may read those before it. For Spark each is a table that is written once, for the oracle the statement itself."""
    if d.name != "spark":
        return ",\n".join(f"{name} AS ({statement})" for name, statement in parts)
    views = [f"{name} AS (SELECT * FROM skeinflow_s_{name})" for name, _ in parts]
    for k, (name, statement) in enumerate(parts):
        SHARED[f"skeinflow_s_{name}"] = (f"WITH {', '.join(views[:k])} " if k else "") + f"SELECT * FROM ({statement}) z"
    return ", ".join(views)


#: Whether rows that are where their conversation is go elsewhere for a join on more than that.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def in_place(spark: SparkSession):
    """Joins on a conversation and more leave rows where they are if both sides are already dealt out by conversation."""
    before = spark.conf.get(_ALL_KEYS, None)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ALL_KEYS)
        else:
            spark.conf.set(_ALL_KEYS, before)


def needed(statement: str) -> str:
    """The statement without views of shared tables that nothing in it reads, so that those aren't made for it."""
    for text, name in re.findall(r"((?<=[ ,])(\w+) AS \(SELECT \* FROM skeinflow_[sv]_\w+\))", statement):
        if not re.search(rf"\b(FROM|JOIN) {name}\b", statement):
            statement = statement.replace(text, f"{name} AS (SELECT 0 AS unread)", 1)
    return statement


def written(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where a shared table is; it is written if it isn't there yet."""
    key = (spark.sparkContext.applicationId, sf_dir, changed(spark, sf_dir), name)
    fs, at = file_of(spark, _WRITTEN.get(key, "/"))
    if key not in _WRITTEN or not fs.exists(at):
        made = SHARED[name]
        path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with in_place(spark):
            (run_sql(spark, sf_dir, made) if isinstance(made, str) else made(spark, sf_dir)).write.parquet(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def run_sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Runs a statement over the tables in sf_dir; the views that it reads have names of their own, so the session's stay as they are."""
    statement = needed(statement)
    for name in dict.fromkeys(_DERIVED.findall(statement)):
        DERIVED[name](spark, sf_dir).createOrReplaceTempView(name)
    for name in dict.fromkeys(_SHARED.findall(statement)):
        spark.read.parquet(written(spark, sf_dir, name)).createOrReplaceTempView(name)
    for name in {m[1] for m in _NAMED.findall(statement)}:
        table(spark, sf_dir, name).createOrReplaceTempView(f"skeinflow_t_{name}")
    return spark.sql(_NAMED.sub(r"\1 skeinflow_t_\2", statement))
