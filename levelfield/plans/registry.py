"""Registered queries: name, Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from levelfield.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(workspace) -> DataFrame`` under ``name``."""

    def add(build: Callable[[Workspace], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return build(workspace(spark, directory))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add
