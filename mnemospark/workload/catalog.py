"""All registered queries."""

from mnemospark.workload import (  # noqa: F401
    distil_cases, retrieval_cases, source_cases, weight_cases, write_cases,
)
from mnemospark.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
