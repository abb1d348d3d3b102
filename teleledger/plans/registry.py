"""All registered queries, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from teleledger.plans import (
    queries_epg, queries_ingest, queries_recordings, queries_search, queries_series, queries_stream,
)
from teleledger.plans.tables import Source
from teleledger.session import tune

_ALL = {
    **queries_search.QUERIES, **queries_recordings.QUERIES, **queries_ingest.QUERIES,
    **queries_series.QUERIES, **queries_epg.QUERIES, **queries_stream.QUERIES,
}


def _bind(build: Callable[[Source], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Source(tune(spark), str(sf_dir)))

    run.__doc__ = build.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(build) for name, (build, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
