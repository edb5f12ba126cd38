"""A threshold trigger with hysteresis and holdoff in slices of places: no task holds a channel.

A slice is a map from the state at its start (armed or not, and the place from which samples count again) to the state at its end.
Few starts lead to different ends, so a map is short. The maps of a channel are followed one after another, which gives each
slice its first state; then the slices run by themselves.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a slice.
SLICE = 1 << 20
#: Before any place.
START = -(1 << 62)
_MAP = "slice long, fired boolean, since long, to_fired boolean, to_free long"


def run(i: np.ndarray, above: np.ndarray, fired: bool, free: int, holdoff: int) -> tuple[list[int], bool, int]:
    """Places of the hits, and the state after them, of rising places ``i`` that are above the threshold or (not ``above``) low.

    While armed, the next place above is a hit; then ``holdoff`` samples are skipped, and the next low one arms again. Only hits are stepped through.
    """
    high, low, found = i[above], i[~above], []
    while True:
        if not fired:
            at = np.searchsorted(high, free)
            if at == len(high):
                return found, fired, free
            hit = int(high[at])
            found.append(hit)
            fired, free = True, hit + 1 + holdoff
        at = np.searchsorted(low, free)
        if at == len(low):
            return found, fired, free
        fired, free = False, int(low[at]) + 1


def ends(i: np.ndarray, above: np.ndarray, holdoff: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each first place k (0 to len(i)) and state (armed, fired), whether the slice ends fired and from where samples count again, at least ``end``.

    States point at their next state, and the pointers are doubled until all stand on a last one.
    """
    n = len(i)
    k = np.arange(n + 1)
    next_high, next_low = (np.append(np.minimum.accumulate(np.where(test, k[:n], n)[::-1])[::-1], n) for test in (above, ~above))
    free = np.append(i, end) + 1 + holdoff  # after a hit there
    lands = np.searchsorted(i, free)
    # states: 0 to n armed, n + 1 to 2 n + 1 fired
    armed = np.where(next_high == n, k, n + 1 + lands[next_high])
    armed_free = np.full(n + 1, end)
    out = (next_high < n) & (free[next_high] >= end)  # a hit whose holdoff leaves the slice is an end of its own
    to = np.concatenate([np.where(out, k, armed), np.where(next_low == n, n + 1 + k, np.minimum(next_low + 1, n))])
    last_fired = np.concatenate([out, np.ones(n + 1, bool)])
    last_free = np.concatenate([np.where(out, free[next_high], armed_free), np.full(n + 1, end)])
    for _ in range(max(1, int(2 * n + 2).bit_length())):
        to = to[to]
    return last_fired[to].reshape(2, -1), last_free[to].reshape(2, -1)


def held_off(series: DataFrame, threshold: float, rearm: float, holdoff: int, slice_places: int | None = None) -> DataFrame:
    """channel, i of hits in rows (channel, i, v): a value above ``threshold`` while armed, after which ``holdoff`` samples are skipped, not
    even the test for arming is made; a later value below rearm * threshold arms again.

    Samples that are neither above nor below don't leave the JVM. Null values are neither. A task holds one slice of ``slice_places``
    places, or the maps of a channel's slices. Of places that come twice, each counts.
    """
    size, low = slice_places or SLICE, rearm * threshold
    kind = series.schema["channel"].dataType.simpleString()
    some = series.where((F.col("v") > threshold) | (F.col("v") < low))
    some = some.select("channel", F.floor(F.col("i") / size).cast("long").alias("slice"), F.col("i").cast("long").alias("i"), (F.col("v") > threshold).alias("above"))
    slices = some.groupBy("channel", "slice")

    def ordered(table):
        table = table.sort_by([("i", "ascending"), ("above", "ascending")])
        return table["i"].to_numpy(), table["above"].to_numpy()

    def maps(key, table):
        i, above = ordered(table)
        fired, free = ends(i, above, holdoff, (key[1].as_py() + 1) * size)
        rows = []
        for state in (0, 1):
            new = np.flatnonzero(np.r_[True, (fired[state, 1:] != fired[state, :-1]) | (free[state, 1:] != free[state, :-1])])
            since = np.append(START, i + 1)[new]
            rows.append((np.full(len(new), state == 1), since, fired[state, new], free[state, new]))
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(columns[0]), table.schema.field("channel").type), pa.array(np.full(len(columns[0]), key[1].as_py())), *map(pa.array, columns)], names=["channel", "slice", "fired", "since", "to_fired", "to_free"])

    def followed(key, table):
        table = table.sort_by([("slice", "ascending"), ("fired", "ascending"), ("since", "ascending")])
        at, state, since, to_fired, to_free = (table[c].to_numpy() for c in ("slice", "fired", "since", "to_fired", "to_free"))
        fired, free, out = False, START, []
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        for a, b in zip(first, [*first[1:], len(at)], strict=True):
            out.append((at[a], fired, free))
            if free < (at[a] + 1) * size:
                own = a + np.flatnonzero(state[a:b] == fired)
                row = own[np.searchsorted(since[own], free, "right") - 1]
                fired, free = bool(to_fired[row]), int(to_free[row])
        return pa.table([pa.array([key[0].as_py()] * len(out), table.schema.field("channel").type), *(pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.bool_(), pa.int64())))], names=["channel", "slice", "fired", "free"])

    def hits(key, rows, entry):
        i, above = ordered(rows)
        found, _, _ = run(i, above, entry["fired"][0].as_py(), entry["free"][0].as_py(), holdoff)
        return pa.table([pa.array([key[0].as_py()] * len(found), rows.schema.field("channel").type), pa.array(found, pa.int64())], names=["channel", "i"])

    entries = slices.applyInArrow(maps, f"channel {kind}, {_MAP}").groupBy("channel").applyInArrow(followed, f"channel {kind}, slice long, fired boolean, free long")
    return slices.cogroup(entries.groupBy("channel", "slice")).applyInArrow(hits, f"channel {kind}, i long")
