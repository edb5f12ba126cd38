"""A sliding filter over a stream of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.filters import BLOCK, Filter
from .slots import SLOTS, named, packed, slotted, together, unpacked

#: Runs of more samples are filtered one at a time, the windows of shorter ones together.
ALONE = 4096


def advanced(f: Filter, ddof: int, rows: pd.DataFrame, tails: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(channel, start, amp, chisq) of the windows that the rows (channel, i, v) of several channels complete, and the new tails.

    A channel's tail are its last samples (channel, i, v), one fewer than a window. Samples up to its end are left out; after a gap it starts anew.
    """
    n, norm = f.length, f.norm
    m = 0 if tails is None else len(tails)
    every = together([tails, rows] if m else [rows])
    of, names = pd.factorize(every["channel"], use_na_sentinel=False)
    i, v = every["i"].to_numpy(np.int64), every["v"].to_numpy(float)
    last = np.full(len(names), np.iinfo(np.int64).min)
    np.maximum.at(last, of[:m], i[:m])
    some = np.flatnonzero(np.r_[np.ones(m, bool), (i[m:] > last[of[m:]]) | (last[of[m:]] == np.iinfo(np.int64).min)])
    # of a place that comes twice the first sample counts
    some = some[np.lexsort((i[some], of[some]))]
    some = some[np.r_[True, (of[some[1:]] != of[some[:-1]]) | (i[some[1:]] != i[some[:-1]])]] if len(some) else some
    of, i, v = of[some], i[some], np.where(np.isnan(v[some]), 0.0, v[some])

    begin = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (i[1:] != i[:-1] + 1)]) if len(of) else np.zeros(0, int)
    end = np.append(begin[1:], len(of))[: len(begin)]
    size = end - begin
    amp, chi = np.zeros(len(of)), np.zeros(len(of))
    left = np.repeat(end, size) - np.arange(len(of))  # samples of the run from here on
    whole = left >= n
    short = np.flatnonzero(whole & np.repeat(size <= ALONE, size))
    step = max(1, BLOCK // n)
    for at in (short[k : k + step] for k in range(0, len(short), step)):
        overlap, own = f.overlap(np.lib.stride_tricks.sliding_window_view(v, n)[at])
        amp[at] = overlap[:, 0] / norm
        chi[at] = (own - amp[at] ** 2 * norm) / (n - ddof)
    for a, b in zip(begin[size > ALONE].tolist(), end[size > ALONE].tolist(), strict=True):
        if b - a >= n:
            w = slice(a, b - n + 1)
            amp[w] = f.correlated(v[a:b])
            chi[w] = (f.powers(v[a:b]) - amp[w] ** 2 * norm) / (n - ddof)
    final = np.repeat(np.r_[of[begin[1:]] != of[begin[:-1]], True][: len(begin)], size)
    keep = final & (left < n)
    found = pd.DataFrame({"channel": names.take(of[whole]), "start": i[whole], "amp": amp[whole], "chisq": chi[whole]})
    return found, pd.DataFrame({"channel": names.take(of[keep]), "i": i[keep], "v": v[keep]})


def sliding(samples: DataFrame, f: Filter, ddof: int = 2, slots: int = SLOTS) -> DataFrame:
    """channel, start, amp, chisq of every window of the template's length in a stream of (channel, i, v), as the batch form has them.

    The state of a channel is its last samples, one fewer than a window, so windows cross chunks. Chunks are taken to come in
    order (``ordered.sliding`` puts them in order) and without gaps; samples that come again are left out, and after a gap the
    channel starts anew. Null values count as 0.
    """

    def slot(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        found, tails = advanced(f, ddof, pd.concat(list(frames))[["channel", "i", "v"]], unpacked(state.get[0]) if state.exists else None)
        state.update((packed(tails),))
        yield named(key, found)

    kind = samples.schema["channel"].dataType.simpleString()
    rows = samples.select("channel", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    out = slotted(rows, slots).applyInPandasWithState(slot, f"channel {kind}, start long, amp double, chisq double", "tails binary", "append", GroupStateTimeout.NoTimeout)
    return out.select("channel", "start", F.round("amp", 5).alias("amp"), F.round("chisq", 5).alias("chisq"))
