"""Registered queries: one per operator, most with a SQL twin for checking."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("source", "text", "vector", "sentiment", "topic", "search", "chart", "summary", "run")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for family in FAMILIES:
        found.update(import_module(f"commentarium.catalogue.{family}_queries").QUERIES)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
