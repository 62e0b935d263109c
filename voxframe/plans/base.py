"""The registry that the modules of queries fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxframe.plans import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "a1_der"
#: A speaker's label in SQL.
LABEL = "'SPEAKER_' || lpad(CAST(speaker AS VARCHAR), 2, '0')"
#: Fixed value: rows of a part of a batch, where a row makes thousands of numbers.
PART = 256


def in_parts(batches):
    """The batches' rows, ``PART`` at a time: what a Python worker holds then does not grow with a batch, up to 10,000 rows."""
    for b in batches:
        for at in range(0, len(b), PART):
            yield b.iloc[at : at + PART]


def query(name: str, sql: str | None = None):
    """Registers a query; sql follows the derivations of ``derived.SQL`` and gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = derived.SQL + sql
        return f

    return add
