"""Named tables that are made from others on demand: what a run offers is declared, and a table is built from what it depends on when it is asked for.

Nothing is computed here: a table is a lazy DataFrame, and Spark plans all of it at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Table:
    """``make(inputs, options)`` gives the table from its inputs (a dict of tables by name). The types of the defaults are those of the options."""

    name: str
    make: Callable[[dict[str, DataFrame], dict], DataFrame]
    inputs: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    version: str = "1"
    defaults: dict = field(default_factory=dict)

    def options(self, given: dict) -> dict:
        for name, value in given.items():
            if name not in self.defaults:
                raise KeyError(f"{self.name} has no option {name}")
            if not isinstance(value, type(self.defaults[name])) or isinstance(value, bool) != isinstance(self.defaults[name], bool):
                raise TypeError(f"{self.name}: {name} is a {type(self.defaults[name]).__name__}")
        return self.defaults | given


class Run:
    """Tables of a run: the sources by name, the declared tables, and options for each of them by its name."""

    def __init__(self, sources: dict[str, DataFrame], tables: list[Table], config: dict[str, dict] | None = None):
        self.made, self.tables, self.config = dict(sources), {t.name: t for t in tables}, config or {}
        self._open: list[str] = []

    def table(self, name: str) -> DataFrame:
        """The table, made once. An unknown name raises KeyError; a circle, and a table without a column that it declares, raise ValueError."""
        if name in self.made:
            return self.made[name]
        if name in self._open:
            raise ValueError("a circle: " + " -> ".join([*self._open, name]))
        t = self.tables[name]
        self._open.append(name)
        try:
            out = t.make({i: self.table(i) for i in t.inputs}, t.options(self.config.get(name, {})))
        finally:
            self._open.pop()
        if missing := set(t.columns) - set(out.columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
        self.made[name] = out
        return out

    def views(self, *names: str) -> None:
        """Registers the tables as temporary views, for SQL."""
        for name in names:
            self.table(name).createOrReplaceTempView(name)


def by_trace(traces: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make`` (a pandas frame of some traces to a frame of results) over all traces, in Arrow batches."""
    return traces.mapInPandas(lambda frames: map(make, frames), schema)


def by_event(traces: DataFrame, make: Callable, schema: str, key: str = "event_id") -> DataFrame:
    """``make`` (a pandas frame of all traces of an event to a frame of results) over all events; an event has as many traces as the detector has channels."""
    return traces.groupBy(key).applyInPandas(make, schema)
