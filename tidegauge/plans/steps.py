"""Composition of named table steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Flow:
    """Tables and warnings handed from step to step; every table stays lazy."""

    in_df: DataFrame | None = None
    out_df: DataFrame | None = None
    merged: DataFrame | None = None
    warnings: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    def with_warnings(self, more: DataFrame) -> "Flow":
        return replace(self, warnings=more if self.warnings is None else self.warnings.unionByName(more))

    def with_metadata(self, name: str, value: object) -> "Flow":
        return replace(self, metadata={**self.metadata, name: value})


Step = Callable[[Flow], Flow]


def run_steps(flow: Flow, steps: Sequence[Step]) -> Flow:
    for step in steps:
        flow = step(flow)
    return flow
