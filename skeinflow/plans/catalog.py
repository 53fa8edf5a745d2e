"""Registry of plans. A plan is a function of a dialect that gives one SQL statement over the tables' names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK
from ..sources.tables import run_sql


@dataclass(frozen=True)
class Plan:
    name: str
    tables: tuple[str, ...]
    sql: Callable

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, self.sql(SPARK))

    def oracle(self) -> str:
        return self.sql(DUCK)


PLANS: dict[str, Plan] = {}


def plan(*tables: str, name: str | None = None):
    def add(f: Callable) -> Callable:
        key = name or f.__name__
        PLANS[key] = Plan(key, tables, f)
        return f

    return add
