"""Compare two tables by schema, profile and value."""

from stepledger.reconcile.align import AlignedDiff, aligned_diff
from stepledger.reconcile.cascade import Check, check_final_outputs, check_step, checks_frame, reconcile
from stepledger.reconcile.profile import compare_profiles, profile
from stepledger.reconcile.schema import schema_differences
from stepledger.reconcile.sketches import DISTINCT_ERROR, RANK_ERROR, column_sketches, estimates, merged
from stepledger.reconcile.values import ValueDiff, value_diff

__all__ = [
    "DISTINCT_ERROR",
    "RANK_ERROR",
    "AlignedDiff",
    "Check",
    "ValueDiff",
    "aligned_diff",
    "check_final_outputs",
    "check_step",
    "checks_frame",
    "column_sketches",
    "compare_profiles",
    "estimates",
    "merged",
    "profile",
    "reconcile",
    "schema_differences",
    "value_diff",
]
