"""All registered queries of the library: name to a function of (session, directory of tables), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import linking, reporting
from .context import Tables


def _query(make: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Tables(spark, sf_dir))


_ALL = reporting.QUERIES | linking.QUERIES
QUERIES = {name: _query(make) for name, (make, _) in _ALL.items()}
ORACLE = {name: text for name, (_, text) in _ALL.items() if text}
