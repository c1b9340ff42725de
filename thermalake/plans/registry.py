"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thermalake.plans import assessments, models, native, products, retrievals, spectral, statistics, streams, training

FLAGSHIP = "gridded_flux_budget"
_MODULES = (products, statistics, models, retrievals, spectral, assessments, training, streams, native)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
