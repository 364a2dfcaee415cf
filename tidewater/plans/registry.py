"""Registered queries: each is a function of the tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["shape", "joins", "aggregates", "windows", "reshape", "scalars", "kernels", "storage", "files", "catalogs", "extensions"]
_found: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """Tables of a folder by attribute: ``t.lineitem`` reads ``lineitem.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        _found[f.__name__] = (f, sql)
        return f

    return add


def _load() -> dict[str, tuple[Callable, str | None]]:
    for m in MODULES:
        importlib.import_module(f"tidewater.plans.{m}")
    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}
