"""A threshold trigger over a stream of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import holdoff as steps
from .slots import SLOTS, named, packed, slotted, together, unpacked


def stepped(rows: pd.DataFrame, state: pd.DataFrame | None, threshold: float, holdoff: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(channel, i) of the hits in rows (channel, i, v) of several channels, and the new state: channel, fired, free."""
    m = 0 if state is None else len(state)
    codes, names = pd.factorize(together([state[["channel"]], rows[["channel"]]] if m else [rows[["channel"]]])["channel"], use_na_sentinel=False)
    fired, free = np.zeros(len(names), bool), np.full(len(names), steps.START, np.int64)
    if m:
        fired[codes[:m]], free[codes[:m]] = state["fired"].to_numpy(bool), state["free"].to_numpy(np.int64)
    of, i, above = codes[m:], rows["i"].to_numpy(np.int64), rows["v"].to_numpy(float) > threshold
    order = np.lexsort((i, of))
    of, i, above = of[order], i[order], above[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    hits = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=False):
        c = of[a]
        found, fired[c], last = steps.run(i[a:b], above[a:b], bool(fired[c]), int(free[c]), holdoff)
        free[c] = max(last, int(i[b - 1]) + 1)
        hits.append(found)
    channels = names.take(np.repeat(of[first], [len(h) for h in hits]))
    found = pd.DataFrame({"channel": channels, "i": np.array([x for h in hits for x in h], np.int64)})
    return found, pd.DataFrame({"channel": names, "fired": fired, "free": free})


def hits(samples: DataFrame, threshold: float, rearm: float, holdoff: int = 0, slots: int = SLOTS) -> DataFrame:
    """channel, i of hits: a value above ``threshold`` while armed, after which ``holdoff`` samples are skipped; a later one below rearm * threshold arms again.

    ``samples`` is a stream of (channel, i, v). The state of a channel is one flag and one number, so a hit may lie in any chunk;
    within a chunk samples are put in order. Chunks are taken to come in order; samples that come again or late are left out
    (``ordered.hits`` waits for them). Samples that are neither above nor below change nothing and don't leave the JVM.
    """
    low = rearm * threshold

    def slot(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        found, known = stepped(pd.concat(list(frames)), unpacked(state.get[0]) if state.exists else None, threshold, holdoff)
        state.update((packed(known),))
        yield named(key, found)

    kind = samples.schema["channel"].dataType.simpleString()
    some = samples.select("channel", "i", "v").where(f"v > {threshold!r} or v < {low!r}")
    return slotted(some, slots).applyInPandasWithState(slot, f"channel {kind}, i long", "known binary", "append", GroupStateTimeout.NoTimeout)
