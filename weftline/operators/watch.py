"""Counters taken while a plan runs, without a second pass: named observations of its stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Observes frames under stage names; the counters can be read when an action over each of them has ended."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def __call__(self, frame: DataFrame, stage: str, **counters: Column) -> DataFrame:
        """The frame, observed: ``rows`` and the given aggregates. It must stand in one plan that runs once."""
        if stage in self._seen:
            raise ValueError(f"{stage} is observed already")
        self._seen[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return frame.observe(self._seen[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()])

    def counters(self) -> dict[str, dict[str, int]]:
        """All counters by stage. Waits for stages that have not run."""
        return {stage: {k: v or 0 for k, v in seen.get.items()} for stage, seen in self._seen.items()}


def unwatched(frame: DataFrame, stage: str, **counters: Column) -> DataFrame:  # noqa: ARG001
    """Stands for a Watch where nothing is counted."""
    return frame
