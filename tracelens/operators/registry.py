"""Plug-ins: analysers of a language, registered by name, and their facts as functions of SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import pysource
from .code import DEFINITION, REPORT, mapper, reports


class Analyzer(Protocol):
    """What a language offers: file extensions and rows of facts of a source text."""

    name: str
    extensions: tuple[str, ...]

    def facts(self, source: str) -> list[dict]: ...


class Registry:
    """Analysers by name; the first registered that takes an extension wins."""

    def __init__(self) -> None:
        self._own: dict[str, Analyzer] = {}

    def register(self, analyzer: Analyzer) -> None:
        if analyzer.name in self._own:
            raise ValueError(f"{analyzer.name} is registered already")
        self._own[analyzer.name] = analyzer

    def get(self, name: str) -> Analyzer | None:
        return self._own.get(name)

    def names(self) -> list[str]:
        return sorted(self._own)

    def column(self, path: Column) -> Column:
        """Name of the analyser for a column of paths, null without one."""
        out = F.lit(None).cast("string")
        for a in reversed(list(self._own.values())):
            mine = F.lit(False)
            for e in a.extensions:
                mine = mine | F.lower(path).endswith(e)
            out = F.when(mine, a.name).otherwise(out)
        return out

    def for_path(self, path: str) -> Analyzer | None:
        return next((a for a in self._own.values() if path.lower().endswith(a.extensions)), None)


class Python:
    name = "python"
    extensions = (".py", ".pyw")

    def facts(self, source: str) -> list[dict]:
        return pysource.definitions(source)


def default() -> Registry:
    out = Registry()
    out.register(Python())
    return out


def register_functions(spark: SparkSession) -> None:
    """SQL functions ``py_definitions(source)`` and ``py_complexity(source)``: arrays of rows, for ``LATERAL inline(...)``.

    They map Arrow batches; a table function of Python would be called for each row, and one of Arrow can't stand in a lateral join.
    """
    for name, f, kind in (("py_definitions", pysource.definitions, DEFINITION), ("py_complexity", reports, REPORT)):
        spark.udf.register(name, mapper(f, f"array<{kind}>"))
