"""Preference formatting of conversations (DataFrame functions only).

Input: turns (pair_id, side, turn, role, text), side "chosen" or "rejected". Turns are compared by position, role and text; the longest
common prefix of a pair's two sides is the prompt and is rendered once; what follows on each side is its completion, in which only the
assistant's words are trained on. The result has a row for each pair with its prompt, both completions, and the spans of each that are
trained on; all else is masked. A row holds up to SEGMENT turns of each part, and longer parts go on in the pair's next rows (segment 1, 2, ...), so
a pair that holds a third of all turns is never in one row or task.

Places are worked out on narrow rows (128 bits of a text's SHA-256 and its length for the text): sorted by range, numbered by
partition, and the partitions' sums added, so no group is in one task. The prefix ends at the smallest position at which the sides differ,
an aggregate over a full outer join by pair and position. Texts move once, to their pair's row.

Null and empty pair_ids are one pair; a null turn comes before all others; a null role or text is empty. Exact repeats of a turn count once, and
different rows of one turn follow each other in order of role and the text's SHA-256. A side without turns has an empty completion. If both
sides are equal, all is prompt. Sides of other names are not read. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_enough, staged

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SEGMENT = 256
#: Narrow rows up to which they are broadcast to the texts.
BROADCAST_PLACES = 200_000


def clean(turns: DataFrame, key: str) -> DataFrame:
    """key as text, side if there is one, turn, role and text without nulls, and sha."""
    rows = turns.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), *(["side"] if "side" in turns.columns else []), F.coalesce("turn", F.lit(-1)).cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("sha", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def hint(rows: DataFrame) -> DataFrame:
    """Staged narrow rows, to be broadcast if a count shows that they are few."""
    return F.broadcast(rows) if small_enough(rows, BROADCAST_PLACES) else rows


def branches(conversations: DataFrame) -> DataFrame:
    """A preference pair of each conversation: as it is (chosen), and broken off with a stale answer (rejected).

    The stale answer repeats the assistant's answer before its last one (empty if there is none) in place of that. Without an answer both sides are equal.
    """
    rows = clean(conversations, "conv_id")
    answers = rows.where("role = 'assistant'").select("key", "turn", "sha").distinct()
    back = answers.withColumn("back", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("turn"), F.desc("sha")))).where("back <= 2")  # two a key at most go into the exchange from each task
    ends = back.groupBy("key").agg(*(F.max(F.when(F.col("back") == k, F.struct("turn", "sha"))).alias(name) for k, name in ((1, "last"), (2, "earlier"))))
    ends = staged(ends, "ends")
    known = rows.join(hint(ends), "key", "left")
    chosen = rows.select("key", F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = F.lit("rejected").alias("side")
    kept = known.where(F.col("last").isNull() | (F.col("turn") < F.col("last.turn"))).select("key", rejected, "turn", "role", "text")
    stale = known.where((F.col("role") == "assistant") & (F.col("turn") == F.col("earlier.turn")) & (F.col("sha") == F.col("earlier.sha"))).select("key", rejected, F.col("last.turn").alias("turn"), "role", "text")
    blank = ends.where("earlier is null").select("key", rejected, F.col("last.turn").alias("turn"), F.lit("assistant").alias("role"), F.lit("").alias("text"))
    return chosen.unionByName(kept).unionByName(stale).unionByName(blank).withColumnRenamed("key", "pair_id")


def positions(narrow: DataFrame) -> DataFrame:
    """narrow with pos: the number of a row within its key and side, in order of turn, role and sha. Written and read back."""
    order = ["key", "side", "turn", "role", "sha"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)  # a key of any size is split, as its rows differ in the last columns
    ordered = staged(ordered.withColumns({"pid": F.spark_partition_id(), "id": F.monotonically_increasing_id()}), "ordered")
    before = Window.partitionBy("key", "side").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("key", "side", "pid").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    starts = starts.select("key", "side", "pid", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return staged(ordered.join(starts, ["key", "side", "pid"]).withColumn("pos", F.col("id") - F.col("lo") + F.col("skip")).drop("pid", "id", "lo", "skip"), "positions")


def format_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, segment, prompt, chosen, rejected, and chosen_spans and rejected_spans: (start, stop) in characters of the row's completion that are trained on."""
    full = clean(turns, "pair_id").where("side in ('chosen', 'rejected')")
    found = positions(full.select("key", "side", "turn", "role", "sha", F.char_length("text").cast("bigint").alias("chars")).distinct())
    one, two = (found.where(F.col("side") == s).select("key", "pos", F.struct("role", "sha").alias(s)) for s in ("chosen", "rejected"))
    differ = one.join(two, ["key", "pos"], "full").where(~F.col("chosen").eqNullSafe(F.col("rejected")))
    ends = staged(differ.groupBy("key").agg(F.min("pos").alias("end")), "prefixes")
    parted = found.join(hint(ends), "key", "left").withColumn("part", F.when(F.col("end").isNull() | (F.col("pos") < F.col("end")), "prompt").otherwise(F.col("side")))
    parted = parted.where((F.col("part") != "prompt") | (F.col("side") == "chosen")).withColumn("place", F.when(F.col("part") == "prompt", F.col("pos")).otherwise(F.col("pos") - F.col("end")))
    head = F.lit(len(OPEN) + 1) + F.char_length("role")
    sized = parted.select("key", "side", "turn", "role", "sha", "part", F.floor(F.col("place") / SEGMENT).alias("segment"), "place", head.cast("bigint").alias("head"), (head + F.col("chars") + len(CLOSE) + 1).alias("size"))
    inside = Window.partitionBy("key", "part", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # SEGMENT rows at most
    start = F.coalesce(F.sum("size").over(inside), F.lit(0))
    span = F.when((F.col("part") != "prompt") & (F.col("role") == "assistant"), F.struct((start + F.col("head")).alias("start"), (start + F.col("size") - 1).alias("stop")))
    places = staged(sized.select("key", "side", "turn", "role", "sha", "part", "segment", "place", span.alias("span")), "places")
    rendered = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n")).alias("rendered")
    rows = full.join(hint(places), ["key", "side", "turn", "role", "sha"]).select("key", "segment", F.struct("part", "place", rendered, "span").alias("item"))
    rows = rows.groupBy("key", "segment").agg(F.sort_array(F.collect_set("item")).alias("items"))  # at most SEGMENT turns of each part; repeats are one

    def of(name: str) -> Column:
        return F.filter("items", lambda x: x["part"] == name)

    texts = [F.array_join(F.transform(of(name), lambda x: x["rendered"]), "").alias(name) for name in ("prompt", "chosen", "rejected")]
    spans = [F.filter(F.transform(of(name), lambda x: x["span"]), lambda s: s.isNotNull()).alias(f"{name}_spans") for name in ("chosen", "rejected")]
    return rows.select(F.when(F.col("key") != "", F.col("key")).alias("pair_id"), "segment", *texts, *spans)
