"""Numbers of the stages of a plan, taken while it runs: rows, and rows of which something holds, such as errors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Stages:
    """Watches DataFrames by name. The numbers are those of the first run of each; they cost no pass of their own."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """df, of which `rows` and the rows that meet each of the conditions are counted; null counts as not met."""
        if name in self._seen:
            raise ValueError(f"{name} is watched already")
        self._seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()])

    def report(self) -> dict[str, dict[str, int]]:
        """Numbers by stage; waits until every watched DataFrame has been run."""
        return {name: dict(o.get) for name, o in self._seen.items()}


def watched(stages: Stages | None, df: DataFrame, name: str, **counts: Column) -> DataFrame:
    return df if stages is None else stages.watch(df, name, **counts)
