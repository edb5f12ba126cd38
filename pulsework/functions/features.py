"""Named features of traces: each is an expression of columns, and a set of them is one projection for each level of dependence."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reduced import doubles, mean


@dataclass(frozen=True)
class Feature:
    """``make(options)`` gives the column; ``inputs`` are the features that it reads."""

    name: str
    make: Callable[[dict], Column]
    inputs: tuple[str, ...] = ()
    version: str = "1"
    defaults: dict = field(default_factory=dict)


REGISTRY: dict[str, Feature] = {}


def register(feature: Feature) -> Feature:
    if feature.name in REGISTRY:
        raise ValueError(f"there is a feature {feature.name} already")
    REGISTRY[feature.name] = feature
    return feature


def with_features(traces: DataFrame, config: dict[str, dict]) -> DataFrame:
    """The traces with the configured features as columns, and what they depend on. ``config`` maps names to options.

    Features that don't depend on each other are one projection. Unknown names raise KeyError, a circle graphlib.CycleError.
    """
    need: dict[str, Iterable[str]] = {}
    todo = list(config)
    while todo:
        name = todo.pop()
        if name not in need:
            need[name] = REGISTRY[name].inputs
            todo += REGISTRY[name].inputs
    order = TopologicalSorter(need)
    order.prepare()
    while order.is_active():
        level = order.get_ready()
        traces = traces.withColumns({n: REGISTRY[n].make(REGISTRY[n].defaults | config.get(n, {})) for n in sorted(level)})
        order.done(*level)
    return traces


def versions(config: dict[str, dict]) -> dict[str, str]:
    """name -> version of the configured features, for the key of a stored table."""
    return {n: REGISTRY[n].version for n in sorted(config)}


register(Feature("mean", lambda o: mean(doubles())))
register(Feature("mean_baseline", lambda o: mean(F.slice(doubles(), 1, o["samples"])), defaults={"samples": 16}))
register(Feature("amplitude", lambda o: F.array_max(doubles()) - F.col("mean_baseline"), inputs=("mean_baseline",)))
register(Feature("peak_arg", lambda o: (F.array_position("samples", F.array_max("samples")) - 1).cast("long")))
register(Feature("peak_time", lambda o: F.col("peak_arg") * o["time_per_sample"], inputs=("peak_arg",), defaults={"time_per_sample": 1.0}))
