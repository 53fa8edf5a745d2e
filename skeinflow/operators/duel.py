"""Two ways to answer, judged by a model that the caller gives: each question is answered from both contexts, and judged twice with the answers swapped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTCOMES = "id bigint, first string, second string, outcome string, grounded boolean"


def duel(rows: DataFrame, client: Callable[[str], str | None], retries: int = 2) -> DataFrame:
    """rows (id, question, one, two): contexts. outcome is one, two or tie (the judge's choice changes with the order), or failed; grounded: whether the first answer is in its context."""
    def call(text: str) -> str | None:
        for _ in range(retries):
            try:
                if said := client(text):
                    return said
            except Exception:  # noqa: BLE001 - a model's failure is an outcome
                pass
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, question, one, two in b[["id", "question", "one", "two"]].itertuples(index=False):
                a, z = (call(f"answer\n{question}\n{context or ''}") for context in (one, two))
                votes = [call(f"judge\n{question}\n{x or ''}\n{y or ''}") for x, y in ((a, z), (z, a))]
                outcome = "failed" if a is None and z is None or None in votes else {("1", "2"): "one", ("2", "1"): "two"}.get(tuple(votes), "tie")
                out.append((id_, a, z, outcome, bool(a) and a.lower() in (one or "").lower()))
            yield pd.DataFrame(out, columns=["id", "first", "second", "outcome", "grounded"])

    return rows.select("id", "question", "one", "two").mapInPandas(run, OUTCOMES)
