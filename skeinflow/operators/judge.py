"""A language model as a bridge: it is shown a numbered list of facts and names those that answer. The client is given by the caller."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prompt(query: str, facts: list[str]) -> str:
    return "\n".join([f"Question: {query}", *(f"{k}. {f}" for k, f in enumerate(facts, 1)), "Numbers of the facts that answer it:"])


def picks(reply: str, n: int, most: int) -> list[int]:
    """Numbers from 1 to n in a reply, each once, in its order, at most most of them."""
    return list(dict.fromkeys(k for k in map(int, re.findall(r"[0-9]+", reply)) if 1 <= k <= n))[:most]


def judge(asked: DataFrame, client: Callable[[str], str], most: int = 6) -> DataFrame:
    """asked (query, facts) -> (query, rank, fact, failed). Equal questions over equal lists are asked once; a failed call picks nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for query, facts in zip(b["query"], b["facts"]):
                try:
                    chosen, failed = picks(client(prompt(query, list(facts))), len(facts), most), False
                except Exception:  # any failure of a remote service counts as no proposal
                    chosen, failed = [], True
                rows += [(query, r, facts[k - 1], failed) for r, k in enumerate(chosen)] or [(query, -1, None, failed)]
            yield pd.DataFrame(rows, columns=["query", "rank", "fact", "failed"])

    once = asked.select("query", "facts").dropDuplicates(["query", "facts"])
    return once.mapInPandas(run, "query string, rank bigint, fact string, failed boolean").where(F.col("rank") >= -1)
