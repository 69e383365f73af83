"""Named queries: what runs under which name, and how a call that can't run is reported.

A query is a function of the session and the folder of the tables, and of parameters with defaults. Its DuckDB
text, where SQL can express it, is kept beside it. `run` is the call layer: an unknown name, an argument that the query
does not take, and a failure of planning or of execution each give one row instead of an exception.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}
        self.described: dict[str, dict[str, str]] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered already")
            self.queries[name] = fn
            self.described[name] = {"name": name, "does": (fn.__doc__ or "").strip()}
            if sql:
                self.oracles[name] = sql
            return fn

        return add

    def parameters(self, name: str) -> dict[str, inspect.Parameter]:
        """A query's own parameters, beyond the session and the folder."""
        return dict(list(inspect.signature(self.queries[name]).parameters.items())[2:])

    def tools(self, spark: SparkSession) -> DataFrame:
        """(tool, does, parameters) of every query; parameters as "name: type = default" parts."""
        listed = lambda n: ", ".join(f"{p.name}: {_kind(p).__name__} = {p.default!r}" for p in self.parameters(n).values())
        rows = [(name, self.described[name]["does"], listed(name)) for name in sorted(self.queries)]
        return spark.createDataFrame(rows, "tool string, does string, parameters string")

    def fault(self, name: str, arguments: dict[str, object]) -> tuple[str, str] | None:
        """(status, message) of a call that cannot be made; null for one that can."""
        if name not in self.queries:
            return "unknown", f"no query is named {name}"
        own = self.parameters(name)
        for key, value in arguments.items():
            if key not in own:
                return "bad_argument", f"{name} takes no {key}; it takes {', '.join(own) or 'nothing'}"
            kind = _kind(own[key])
            fits = isinstance(value, kind) or (kind is float and isinstance(value, int))
            if not fits or (isinstance(value, bool) and kind is not bool):
                return "bad_argument", f"{key} of {name} is {kind.__name__}, not {type(value).__name__}"
        return None

    def run(self, spark: SparkSession, name: str, sf_dir: str, **arguments) -> DataFrame:
        """The named query's rows, or one row (tool, status, message): unknown, bad_argument or failed.

        Arguments are checked before anything is planned. The query is run to its end, into the shared folder, so that
        what fails while it runs is told here too; the rows are read from there.
        """
        fault = self.fault(name, arguments)
        if fault is None:
            try:
                rows, path = self.queries[name](spark, sf_dir, **arguments), new_folder(spark, "call")
                rows.write.parquet(path)
                return spark.read.schema(rows.schema).parquet(path)
            except Exception as e:  # noqa: BLE001  reported as a row
                fault = "failed", str(e)[:500]
        return spark.createDataFrame([(name, *fault)], "tool string, status string, message string")


def _kind(parameter: inspect.Parameter) -> type:
    """A parameter's type: that of its default."""
    return type(parameter.default)


REGISTRY = Registry()
query = REGISTRY.query
