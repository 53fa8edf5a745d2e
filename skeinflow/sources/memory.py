"""Memory files: one JSON document for each conversation. Weave and web files: one JSON document for each word."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import file_of

MEMORY = "v INT, max BIGINT, o BIGINT, seq BIGINT, e ARRAY<STRING>, k ARRAY<ARRAY<STRING>>"
FACTS = "conv_id bigint, seq bigint, hits bigint, ts double, idx array<string>, reinforced bigint, text string"


def save(docs: DataFrame, path: str) -> None:
    """Writes (conv_id, doc) as a new generation under path. The last generation whose files are complete (_SUCCESS) is the one that is read, so a reader, or one
    after a crash, sees the former or the new one as a whole; older ones are deleted after that.
    """
    spark = docs.sparkSession
    old = generations(spark, path)
    docs.select(F.to_json(F.struct("conv_id", "doc")).alias("value")).write.text(f"{path}/g{len(old) and int(old[-1][1:9]) + 1:08d}-{uuid.uuid4().hex}")
    for g in generations(spark, path)[:-2]:
        fs, at = file_of(spark, f"{path}/{g}")
        fs.delete(at, True)


def generations(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_of(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    return [n for n in names if n[0] == "g" and fs.exists(file_of(spark, f"{path}/{n}/_SUCCESS")[1])]


def load(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The facts saved at path, of any version; no rows if nothing is there. A text counts once in a memory. Entries that aren't facts are left out, and so are documents that aren't memories,
    unless strict, where they fail the job.
    """
    found = generations(spark, path)
    if not found:
        return spark.createDataFrame([], FACTS)
    rows = spark.read.text(f"{path}/{found[-1]}").select(F.from_json("value", "conv_id BIGINT, doc STRING").alias("r")).select("r.conv_id", "r.doc", F.from_json("r.doc", MEMORY).alias("m"))
    if strict:
        rows = rows.withColumn("m", F.when(F.col("m.e").isNull() & F.col("m.k").isNull(), F.raise_error(F.concat(F.lit("not a memory: "), "doc"))).otherwise(F.col("m")))

    def field(k: int, kind: str):
        return F.expr(f"try_cast(try_element_at(x, {k}) AS {kind})")

    old = rows.select("conv_id", F.posexplode("m.e").alias("pos", "text")).select("conv_id", "pos", (F.col("pos") + 1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("hits"), F.lit(0.0).alias("ts"), F.expr("cast(array() as array<string>)").alias("idx"), F.lit(0).cast("bigint").alias("reinforced"), "text")
    new = rows.select("conv_id", F.posexplode("m.k").alias("pos", "x")).select(
        "conv_id", "pos", field(2, "BIGINT").alias("seq"), F.coalesce(field(3, "BIGINT"), F.lit(0)).alias("hits"), F.coalesce(field(4, "DOUBLE"), F.lit(0.0)).alias("ts"),
        F.coalesce(F.from_json(F.try_element_at("x", F.lit(5)), "ARRAY<STRING>"), F.expr("cast(array() as array<string>)")).alias("idx"), F.coalesce(field(6, "BIGINT"), F.lit(0)).alias("reinforced"), F.col("x")[0].alias("text"))
    all_ = old.unionByName(new).where("seq is not null and text is not null")
    return all_.groupBy("conv_id", "text").agg(F.min_by(F.struct("seq", "hits", "ts", "idx", "reinforced"), "pos").alias("f")).select("conv_id", "f.*", "text")


def save_weave(related: DataFrame, path: str) -> None:
    """Writes (word, other, strength in ten-thousandths, k) as lines {"v": 1, "r": {word: [[other, strength], ...]}}."""
    item = F.array("other", (F.col("strength") / 10_000).cast("string"))
    lists = related.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", item.alias("x")))), lambda s: s["x"]).alias("l"))  # weave_neighbours items at most
    lists.select(F.to_json(F.struct(F.lit(1).alias("v"), F.create_map("word", "l").alias("r"))).alias("value")).write.text(path)


def load_weave(spark: SparkSession, path: str) -> DataFrame:
    """word, other, strength, k. Lines that aren't weaves are left out."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "r MAP<STRING, ARRAY<ARRAY<STRING>>>").r).alias("word", "l")).select("word", F.posexplode("l").alias("pos", "x"))
    return rows.select("word", F.col("x")[0].alias("other"), F.floor(F.col("x")[1].cast("double") * 10_000 + 0.5).cast("bigint").alias("strength"), (F.col("pos") + 1).cast("bigint").alias("k"))


def extend_web(links: DataFrame, path: str) -> None:
    """Adds the words of (word, pos, other) that the web at path doesn't have yet."""
    spark = links.sparkSession
    fs, at = file_of(spark, path)
    todo = links.join(load_web(spark, path).select("word").distinct(), "word", "left_anti") if fs.exists(at) else links
    lists = todo.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "other"))), lambda s: s["other"]).alias("l"))
    lists.select(F.to_json(F.struct(F.create_map("word", "l").alias("links"))).alias("value")).write.text(f"{path}/{uuid.uuid4().hex}")


def load_web(spark: SparkSession, path: str) -> DataFrame:
    """word, pos, other."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.explode(F.from_json("value", "links MAP<STRING, ARRAY<STRING>>").links).alias("word", "l"))
    return rows.select("word", F.posexplode("l").alias("pos", "other")).withColumn("pos", F.col("pos").cast("bigint"))
