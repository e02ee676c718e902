"""History tables (type 2 slowly changing dimensions) as Spark DataFrame jobs."""

from sediment.operators.apply import apply_scd2
from sediment.operators.diff import compare, detect_changes, summary
from sediment.operators.validate import validate_scd2
from sediment.plans.run import run_scd2
from sediment.sources.ingest import load_snapshot

__all__ = [
    "apply_scd2",
    "compare",
    "detect_changes",
    "load_snapshot",
    "run_scd2",
    "summary",
    "validate_scd2",
]
