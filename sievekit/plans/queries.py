"""Every named query of the library proper, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievekit.plans import checks, dependencies, findings, graphs, guards, origins, outputs, proofs, resolution, scan, selection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (scan, graphs, origins, dependencies, findings, selection, resolution, outputs, proofs, guards, checks):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
