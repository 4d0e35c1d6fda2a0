"""Roll check outcomes up into verdicts. Input: the columns of ``checks_frame``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepledger.columns import col
from stepledger.lineage.graph import downstream

# Phases that look at data.
DATA_PHASES = ["schema", "property", "data_equivalence"]
JUDGE_PHASE = "llm_judge"


def step_verdicts(checks: DataFrame, by: Sequence[str] = ("program", "step")) -> DataFrame:
    """A step passes when no check failed and at least one really passed."""
    ran = ~F.col("skipped")
    return checks.groupBy(*[col(c) for c in by]).agg(
        (F.bool_and(F.col("passed") | F.col("skipped")) & F.bool_or(F.col("passed") & ran)).alias("step_passed"),
        F.count_if(~F.col("passed") & ran).alias("failed_checks"),
        F.count_if("skipped").alias("skipped_checks"),
    )


def roll_up(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per group, over everything when no group is named."""
    return (
        verdicts.groupBy(*[col(c) for c in by])
        .agg(
            F.count(F.lit(1)).alias("steps"),
            F.count_if("step_passed").alias("passed_steps"),
            F.count_if(~F.col("step_passed")).alias("review_steps"),
        )
        .withColumn("all_passed", F.col("review_steps") == 0)
    )


def strength(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How the verdict was reached: verified by data, data checks ran at all, judged."""
    ran = ~F.col("skipped")
    on_data = F.col("phase").isin(DATA_PHASES)
    return checks.groupBy(*[col(c) for c in by]).agg(
        F.bool_or(on_data & F.col("passed") & ran).alias("data_verified"),
        F.bool_or(on_data & ran).alias("data_ran"),
        F.bool_or((F.col("phase") == JUDGE_PHASE) & F.col("passed") & ran).alias("judged"),
    )


def review(checks: DataFrame, by: Sequence[str] = ("program", "step")) -> DataFrame:
    """The failed checks of the steps that need a person."""
    failed = ~F.col("passed") & ~F.col("skipped")
    columns = [c for c in ("phase", "summary", "diagnostics") if c in checks.columns]
    return checks.filter(failed).select(*[col(c) for c in by], *columns)


def pass_rate(checks: DataFrame, run: str = "run", by: Sequence[str] = ("program", "step")) -> DataFrame:
    """Share of verified steps per run."""
    verdicts = step_verdicts(checks, [run, *by])
    return verdicts.groupBy(col(run)).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if("step_passed").alias("passed_steps"),
        (F.count_if("step_passed") / F.count(F.lit(1))).alias("pass_rate"),
    )


# States of a step that may run, and further ones that may on request.
READY = ["passed"]
UNVERIFIED = ["translated", "needs_human"]


def eligibility(status: DataFrame, edge_rows: DataFrame, include_unverified: bool = False) -> DataFrame:
    """``program, idx, status, verdict``: whether each step runs, is left out, or lacks inputs since a step above it is.

    ``status``: program, idx, status. A step lacks inputs however far above it the step lies that was left out.
    """
    wanted = F.coalesce(F.col("status").isin(READY + (UNVERIFIED if include_unverified else [])), F.lit(False))
    out = status.filter(~wanted).select("program", "idx")
    below = downstream(out, edge_rows).withColumn("__below", F.lit(True))
    marked = status.join(below, ["program", "idx"], "left")
    verdict = F.when(~wanted, "left out").when(F.col("__below"), "lacks inputs").otherwise("runs")
    return marked.withColumn("verdict", verdict).drop("__below")
