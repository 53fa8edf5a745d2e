"""Fact extraction over tables of turns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules


def per_text(texts: DataFrame, rule, result: str = "array<string>") -> DataFrame:
    """(id, value) by a rule for each text."""
    @F.pandas_udf(result)
    def apply(column: pd.Series) -> pd.Series:
        return column.map(lambda t: rule(t or ""))

    return texts.select("id", apply("text").alias("value"))


def extract_knots(turns: DataFrame, only_user: bool = False) -> DataFrame:
    """(conv_id, turn, pos, knot) of turns (conv_id, turn, role, text); the subject is the user or the speaker's name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, turn, role, text in b.itertuples(index=False):
                who = (role or "").strip()
                user = who.lower() in ("user", "you", "")
                if user or not only_user:
                    rows += [(conv, turn, k, f) for k, f in enumerate(rules.extract(text, "the user" if user else who))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "pos", "knot"])

    return turns.select("conv_id", "turn", "role", "text").mapInPandas(run, "conv_id bigint, turn bigint, pos bigint, knot string")
