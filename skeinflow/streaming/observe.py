"""The online store: turns arrive as a stream, each conversation's facts are its state."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT as C
from ..operators import rules
from ..sources.tables import file_of, work_dir

LIVE = "conv_id bigint, seq bigint, text string, reinforced bigint"


class Memory:
    """One conversation's facts: [seq, text, reinforced, words, frame key, identifiers]."""

    def __init__(self, facts: list | None = None, seq: int = 0):
        self.facts, self.seq = facts or [], seq

    def add(self, text: str, most: int) -> None:
        text = text[: C.max_chars]
        if len(text) < C.min_chars or any(f[1] == text for f in self.facts):
            return
        w, frame = rules.words(text), rules.frame(text)
        key, ids = "|".join(frame), "|".join(x for x in frame if x.startswith("ID:"))

        def replaced(f) -> bool:
            both = len(set(w) & set(f[3]))
            return bool(key and f[4] == key) or (f[5] == ids and both > 0 and 10 * both >= 6 * (len(w) + len(f[3]) - both))

        old = [f for f in self.facts if replaced(f)]
        self.seq += 1
        self.facts = [f for f in self.facts if not replaced(f)] + [[self.seq, text, sum(1 + f[2] for f in old), w, key, ids]]
        if len(self.facts) > most:  # bounded state: the least valuable go
            self.facts = sorted(sorted(self.facts, key=lambda f: (self.value(f), f[0]))[-most:], key=lambda f: f[0])

    def value(self, fact) -> float:
        """How rare a fact's words are in this memory, times its importance."""
        total = len(self.facts)
        idf = [math.log(1 + total / (1 + sum(w in f[3] for f in self.facts))) for w in fact[3]]
        return math.floor((sum(sorted(idf)) / len(idf) if idf else 0.0) * (1 + rules.importance(fact[1]) / 5) * 1e6 + 0.5)


def observe(turns: DataFrame, most: int = C.max_entries, extracting: bool = False) -> DataFrame:
    """A streaming DataFrame of turns (conv_id, turn, role, text) -> each touched conversation's live facts after each batch.

    extracting: facts are extracted from each turn; else each sentence is added as it is.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Memory(*json.loads(state.get[0])) if state.exists else Memory()
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        for role, text in zip(rows.role, rows.text):
            for s in rules.said(role, text) if extracting else rules.sentences(text or ""):
                memory.add(s, most)
        state.update((json.dumps([memory.facts, memory.seq]),))
        yield pd.DataFrame([(key[0], f[0], f[1], f[2]) for f in memory.facts], columns=["conv_id", "seq", "text", "reinforced"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, LIVE, "memory string", "append", GroupStateTimeout.NoTimeout)


def stream_of(spark: SparkSession, source: str) -> DataFrame:
    """A table, a file or a folder of them, as a stream."""
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rpartition("/")
    fs, at = file_of(spark, source)
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if fs.getFileStatus(at).isFile() else reader.parquet(source)


def drain(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, and returns all that it gave, with the number of the batch. A batch that is tried again replaces what it wrote."""
    spark = rows.sparkSession
    at = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def run_once(spark: SparkSession, source: str, most: int = C.max_entries, extracting: bool = False) -> DataFrame:
    """Runs the stream over the turns that are there and returns the live facts: those of each conversation's last batch."""
    live = drain(observe(stream_of(spark, source), most, extracting))
    last = live.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return live.join(last, ["conv_id", "batch"]).drop("batch")


def keyed(turns: DataFrame, step, schema: str) -> DataFrame:
    """A row for each (turn, role, text) and what step makes of it and its conversation's state, a JSON value that step changes and that is None at first."""
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        rows = []
        for turn, role, text in pd.concat(list(batches)).sort_values("turn", kind="stable")[["turn", "role", "text"]].itertuples(index=False):
            rows += [(key[0], turn, *r) for r in step(kept, turn, role, text or "")]
        state.update((json.dumps(kept),))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", *(c.split()[0] for c in schema.split(", "))])

    return turns.groupBy("conv_id").applyInPandasWithState(run, f"conv_id bigint, turn bigint, {schema}", "kept string", "append", GroupStateTimeout.NoTimeout)


def previous_turn(extracting: bool):
    """The fact-bearing turn before each one."""
    def step(kept: dict, turn: int, role: str, text: str) -> list[tuple]:
        facts = rules.said(role, text) if extracting else rules.sentences(text)
        if not any(len(f[: C.max_chars]) >= C.min_chars for f in facts):
            return []
        before, kept["last"] = kept.get("last"), int(turn)
        return [(before,)]

    return step


def running_names(kept: dict, turn: int, role: str, text: str) -> list[tuple]:
    """How often each name of a turn has occurred up to and with it."""
    names = rules.capitals(text)
    for name in names:
        kept[name] = kept.get(name, 0) + 1
    return [(name, kept[name]) for name in dict.fromkeys(names)]
