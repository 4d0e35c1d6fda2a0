"""Compose step functions into one lazy flow of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Transform = Callable[[SparkSession, dict[str, DataFrame]], "DataFrame | dict[str, DataFrame]"]


@dataclass(frozen=True)
class Step:
    """One step: a function of named DataFrames. Several outputs are returned as a dict by dataset key."""

    label: str
    outputs: tuple[str, ...]
    inputs: tuple[str, ...]
    transform: Transform


def external_inputs(steps: Sequence[Step]) -> list[str]:
    made: set[str] = set()
    needed = []
    for s in steps:
        needed += [k for k in s.inputs if k not in made and k not in needed]
        made.update(s.outputs)
    return sorted(needed)


def final_outputs(steps: Sequence[Step]) -> list[str]:
    read = {k for s in steps for k in s.inputs}
    return sorted({k for s in steps for k in s.outputs} - read)


def eligible(steps: Sequence[Step], status: Mapping[str, str], include_unverified: bool = False) -> list[Step]:
    """The steps that may run: passed ones, on request also those not yet verified."""
    wanted = {"passed"} | ({"translated", "needs_human"} if include_unverified else set())
    return [s for s in steps if status.get(s.label) in wanted]


def run_flow(
    spark: SparkSession,
    sources: Mapping[str, DataFrame],
    steps: Sequence[Step],
    required: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Thread each step's outputs into later inputs; returns every dataset by key.

    Nothing is computed here. Each returned DataFrame is one plan from its sources,
    which the optimizer prunes and pushes down as a whole.
    """
    absent = sorted(set(external_inputs(steps) if required is None else required) - set(sources))
    if absent:
        raise ValueError(f"missing source datasets: {absent}")
    datasets = dict(sources)
    for step in steps:
        gone = [k for k in step.inputs if k not in datasets]
        if gone:
            raise ValueError(f"step {step.label} lacks upstream datasets {gone}")
        result = step.transform(spark, {k: datasets[k] for k in step.inputs})
        if isinstance(result, dict):
            extra = sorted(set(result) ^ set(step.outputs))
            if extra:
                raise ValueError(f"step {step.label} declares {list(step.outputs)}, differs in {extra}")
            datasets.update(result)
        elif step.outputs:
            datasets[step.outputs[0]] = result
    return datasets
