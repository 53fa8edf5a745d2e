"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is normalised by deleting the characters [\\x20\\x09-\\x0D], then cut into chunks where its own content says so, so that
equal texts have equal chunks. The ordered list of chunk identifiers is the text's recipe, and equal recipes mean equal texts:

1. One pass turns each text into a recipe of 64-bit chunk hashes; no text moves.
2. Only rows whose hashed recipe occurs again can be copies. Of those rows, each distinct chunk moves once: where one
   hash stands for more than one chunk text, the texts are numbered, so identifiers (hash, number) are verified by content.
3. Rows are grouped by verified recipe. Partial aggregates collapse a hot group before the shuffle, and the way back from
   group to rows is salted, so no task receives a whole hot group.

Null texts count as empty, and empty texts are equal to each other. A null doc_id sorts after all others. Repeated rows
(same doc_id, equal text) are separate rows of one group, of which one stays. An empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, keep_keys, keep_or_drop, key_of, staged

#: A chunk ends after a vowel, one of s to v, and a comma or full stop, or such a pair before an upper-case letter; 256 to 4096 characters.
CHUNK = r"(?s).{255,4093}?[aeiou][nr-v][.,A-Z]|.{1,4096}"
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", "")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """(row, k1, k2, doc_id, n_points, text_sha256, recipe): one row per row of docs, written and read back; row tells repeated rows apart, k1 and k2 are of doc_id and text."""
    norm = docs.select("doc_id", *key_of("doc_id", "text"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"), normalised(F.col("text")).alias("norm"))
    parts = norm.select("doc_id", "k1", "k2", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("parts"))
    hashed = parts.select(F.monotonically_increasing_id().alias("row"), "k1", "k2", "doc_id", "n_points", "text_sha256", F.transform("parts", lambda c: F.xxhash64(c)).alias("recipe"))
    return staged(hashed, "recipes")


def clashes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(hash, chunk, number) of each chunk hash that stands for several texts among rows that may be copies; nearly always empty."""
    again = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("recipe")
    ids = staged(rows.join(again, "recipe", "left_semi").select("doc_id").distinct(), "maybe")
    texts = keep_or_drop(docs.select("doc_id", "text"), ids, "left_semi")
    if rows.where("doc_id is null").limit(1).count():
        texts = texts.unionByName(docs.where("doc_id is null").select("doc_id", "text"))
    one = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(F.xxhash64("chunk").alias("hash"), "chunk").distinct()
    one = staged(one.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.collect_set("chunk").alias("texts")).where("n > 1"), "clashes")
    return one.select("hash", F.posexplode(F.sort_array("texts")).alias("number", "chunk"))


def verified(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the recipe as a list of (hash, number). Only rows with a clashing hash are computed from their text again."""
    clash = staged(clashes(docs, rows), "numbers")
    plain = F.transform("recipe", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("number")))
    if not clash.limit(1).count():
        return rows.withColumn("recipe", plain)
    # number of each chunk by its text, joined in by (hash, text): exact, however unlikely
    parts = docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).distinct()
    numbered = parts.withColumn("hash", F.xxhash64("chunk")).join(clash.select("hash").distinct(), "hash", "left_semi").join(clash, ["hash", "chunk"])
    named = rows.select("row", "k1", "k2", "doc_id", "n_points", "text_sha256", F.posexplode_outer("recipe").alias("pos", "hash"))
    # a doc_id that occurs with several texts has a number for each: (doc_id, pos, hash) may then be ambiguous, so the row's own text_sha256 decides
    sha = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).distinct()
    numbered = sha.withColumn("hash", F.xxhash64("chunk")).join(clash, ["hash", "chunk"]).select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"), F.col("pos").alias("p"), "number")
    full = named.join(numbered, named.doc_id.eqNullSafe(numbered.d) & (named.text_sha256 == numbered.s) & (named.pos == numbered.p), "left")
    item = F.struct("pos", F.struct("hash", F.coalesce("number", F.lit(0)).alias("number")).alias("id"))
    back = full.groupBy("row", "k1", "k2", "doc_id", "n_points", "text_sha256").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("items"))
    return back.select("row", "k1", "k2", "doc_id", "n_points", "text_sha256", F.transform("items", lambda x: x["id"]).alias("recipe"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, chunks.

    Of equal texts the row with the most code points in the original text stays, then the smallest doc_id; see the module's text for nulls and ties.
    """
    return decided(docs).drop("k1", "k2")


def decided(docs: DataFrame) -> DataFrame:
    """exact_duplicates with each row's key."""
    rows = recipes(docs)
    known = verified(docs, rows)
    last = F.lit(-(2**63)).cast("bigint")
    best = F.struct("n_points", F.coalesce(-F.col("doc_id"), last).alias("minus_id"), (-F.col("row")).alias("minus_row"), "doc_id")
    salted = known.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    part = staged(salted.groupBy("recipe", "salt").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n")), "groups")
    group = part.groupBy("recipe").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    back = group.select("recipe", "best", "group_size", F.explode("salts").alias("salt"))
    out = salted.join(back, ["recipe", "salt"])
    return out.select("k1", "k2", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.minus_row")).alias("kept"), "text_sha256", F.size("recipe").alias("chunks"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates drops; same columns."""
    return keep_keys(docs, staged(decided(docs).select("k1", "k2", F.col("kept").alias("stays")), "exact"), "doc_id", "text")
