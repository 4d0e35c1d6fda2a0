"""The fail-fast cascade: schema, then profile, then values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from stepledger.reconcile.profile import compare_profiles
from stepledger.reconcile.schema import column_issues
from stepledger.reconcile.values import value_diff
from stepledger.settings import ATOL, MAX_REPORT, RTOL, store, tables

CHECK_SCHEMA = (
    "run string, program string, step string, phase string, passed boolean, skipped boolean, "
    "summary string, diagnostics array<string>"
)


@dataclass
class Check:
    """Outcome of one phase."""

    phase: str
    passed: bool
    summary: str = ""
    diagnostics: list[str] = field(default_factory=list)
    skipped: bool = False


def reconcile(
    actual: DataFrame,
    golden: DataFrame,
    keys: Sequence[str] | None = None,
    atol: float = ATOL,
    rtol: float = RTOL,
    max_report: int = MAX_REPORT,
    approx: bool = False,
) -> list[Check]:
    """Compare ``actual`` with the trusted copy; a failed phase ends the cascade.

    Both sides are read by several passes over disjoint columns, so hand in tables
    rather than long plans; the step checks below write a step's result first.
    Column checks need no job, one job profiles and counts both sides, and one
    more compares values. Only verdict rows and a bounded sample reach the driver.
    """
    issues = [f"{c}: {issue} (actual {x}, golden {y})" for c, issue, x, y in column_issues(actual, golden)]
    if issues:
        return [Check("schema", False, "schema mismatch", issues)]

    rows = compare_profiles(actual, golden, atol, rtol, approx).collect()
    mine = max((r["actual_row_count"] or 0 for r in rows), default=0)
    theirs = max((r["golden_row_count"] or 0 for r in rows), default=0)
    if mine != theirs:
        return [Check("schema", False, "schema mismatch", [f"row count {mine} != golden {theirs}"])]
    checks = [Check("schema", True, "schema matches golden")]

    failed = [r for r in rows if not r["passed"]]
    if failed:
        notes = []
        for r in failed:
            for stat in ("null_count", "distinct_count", "sum_value", "mean_value", "min_value", "max_value"):
                x, y = r[f"actual_{stat}"], r[f"golden_{stat}"]
                if x != y:
                    notes.append(f"{r['column_name']}: {stat} {x} != golden {y}")
        return [*checks, Check("property", False, "property mismatch", notes)]
    checks.append(Check("property", True, "properties match golden"))

    with tables(actual.sparkSession):
        sample = _shown(actual, golden, keys, atol, rtol, max_report)
    if not sample:
        return [*checks, Check("data_equivalence", True, "values match golden within tolerance")]
    notes = []
    for kind in ("changed", "only in actual", "only in golden"):
        found = [r for r in sample if r["issue"] == kind]
        notes += [f"{kind}: {r.asDict(recursive=True)}" for r in found[:max_report]]
        more = "+" if len(found) > max_report else ""
        notes.append(f"rows {kind}: {min(len(found), max_report)}{more}")
    return [*checks, Check("data_equivalence", False, "value-level difference", notes)]


def _shown(actual: DataFrame, golden: DataFrame, keys: Sequence[str] | None, atol: float, rtol: float, n: int) -> list[Row]:
    """The first row of every kind, then the second of every kind and so on; one more than the report shows of an issue."""
    issues = value_diff(actual, golden, keys, atol, rtol).sample(n)
    first = Window.partitionBy("issue").orderBy("place", "differs")
    return issues.withColumn("__no", F.row_number().over(first)).filter(F.col("__no") <= n + 1).drop("__no", "place").collect()


def check_step(
    spark: SparkSession,
    datasets: Mapping[str, DataFrame],
    transform: Callable[[SparkSession, dict[str, DataFrame]], DataFrame],
    inputs: Sequence[str],
    output: str,
    **options,
) -> list[Check]:
    """Run one step on trusted inputs and reconcile its result with the trusted output.

    Absent trusted data skips the check; an error in the step is a failed check.
    """
    absent = [k for k in [*inputs, output] if k not in datasets]
    if absent:
        return [Check("schema", True, "no trusted data", absent, skipped=True)]
    try:
        with tables(spark):
            result = store(transform(spark, {k: datasets[k] for k in inputs}))
            return reconcile(result, datasets[output], **options)
    except Exception as error:  # noqa: BLE001 - the step's own failure is the finding
        return [Check("schema", False, "runtime error in the step", [f"{type(error).__name__}: {error}"])]


def check_final_outputs(
    produced: Mapping[str, DataFrame], trusted: Mapping[str, DataFrame], finals: Iterable[str], **options
) -> dict[str, list[Check]]:
    """Reconcile every final output of a flow end to end."""
    results = {}
    for name in finals:
        if name not in produced:
            results[name] = [Check("end_to_end", False, "output was not produced")]
        elif name not in trusted:
            results[name] = [Check("end_to_end", True, "no trusted data", skipped=True)]
        else:
            with tables(produced[name].sparkSession):
                checks = reconcile(store(produced[name]), trusted[name], **options)
            passed = all(c.passed for c in checks)
            results[name] = [*checks, Check("end_to_end", passed, "all phases passed" if passed else "a phase failed")]
    return results


def checks_frame(
    spark: SparkSession, results: Mapping[str, Sequence[Check]], run: str = "", program: str = ""
) -> DataFrame:
    """Check outcomes as a table, one row per step and phase."""
    rows = [
        (run, program, step, c.phase, c.passed, c.skipped, c.summary, c.diagnostics)
        for step, checks in results.items()
        for c in checks
    ]
    return spark.createDataFrame(rows, CHECK_SCHEMA)
