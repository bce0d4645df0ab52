"""Sessions of a stream by gaps that are kept to the tick: events exactly a gap apart belong together, as in the batch operator.

Spark's session windows end before last + gap, so there the choice is Spark's; here every key keeps its open sessions as
state, merges what arrives in any order, and gives a session out once the watermark has passed its last event by more than the gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merge(held: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(start, last, n) in order; neighbours that are a gap or less apart become one."""
    out: list[tuple[int, int, int]] = []
    for start, last, n in sorted(held):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((start, last, n))
    return out


def gap_sessions(stream: DataFrame, key: str, at: str, gap_us: int, late: str = "1 hour") -> DataFrame:
    """(key, start, last, n) of sessions of a stream of events, in microseconds since 1970; a new one begins where the gap is more than gap_us.

    Rows later than the watermark are dropped by Spark; one that opens a session that was given out already begins another. A null time
    or key belongs to no session.
    """
    rows = stream.where(F.col(at).isNotNull() & F.col(key).isNotNull()).withWatermark(at, late).select(key, at, F.unix_micros(at).alias("_us"))
    kind = dict(stream.dtypes)[key]

    def update(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Any] = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for frame in frames:
            held += [(int(us), int(us), 1) for us in frame["_us"]]
            held = merge(held, gap_us)
        passed = state.getCurrentWatermarkMs() * 1000
        closed, open_ = [s for s in held if s[1] + gap_us < passed], [s for s in held if s[1] + gap_us >= passed]
        if open_:
            state.update(tuple(map(list, zip(*open_, strict=True))))
            # the first time at which one of them may be closed; a timeout must lie after the watermark
            state.setTimeoutTimestamp(max(min(s[1] for s in open_) // 1000 + gap_us // 1000 + 2, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame([(who[0], *s) for s in closed], columns=[key, "start", "last", "n"])

    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, start long, last long, n long", "starts array<bigint>, lasts array<bigint>, ns array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
