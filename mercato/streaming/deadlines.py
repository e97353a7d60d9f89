"""Closing what a run left open: timers over a stream of rows by site."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECOND = 1_000_000
CLOSED = ["site", "opened", "last_seen", "closed_at", "n", "reason"]


def _watching(silence: int, most: int):
    """Keeper of one site's state ``(opened, last, n)``; times are microseconds."""

    def deadline(opened: int, last: int) -> int:
        return min(last + silence, opened + most)

    def closed(site: str, opened: int, last: int, n: int) -> tuple:
        return site, opened, last, deadline(opened, last), n, "overdue" if opened + most < last + silence else "silent"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append(closed(key[0], *state.get))
            state.remove()
        else:
            opened, last, n = state.get if state.exists else (None, None, 0)
            for t in np.sort(np.concatenate([b["us"].to_numpy() for b in batches])).tolist():
                if opened is not None and t >= deadline(opened, last):
                    out.append(closed(key[0], opened, last, n))
                    opened = None
                opened, last, n = (t, t, 1) if opened is None else (opened, max(last, t), n + 1)
            state.update((opened, last, n))
            state.setTimeoutTimestamp(max(deadline(opened, last) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=CLOSED)

    return run


def closed(rows: DataFrame, silence_s: int, most_s: int, lateness: str = "10 minutes") -> DataFrame:
    """``site, opened, last_seen, closed_at, n, reason`` of every run of a site in ``rows(site, ts)``, once it is over.

    A run opens with a site's first row and is over when the site stays ``silent`` for ``silence_s`` or,
    whatever still comes, ``most_s`` after it opened (``overdue``); a later row opens the next run. A
    timer closes runs of sites that send nothing more, when event time has passed their deadline by
    ``lateness``. Rows later than that are dropped; one that comes late within it joins the open run.
    Rows without a site or a time are ignored. State: three numbers a site; of a micro-batch's rows
    of a site only the times are held.
    """
    timed = rows.where("site is not null and ts is not null").withWatermark("ts", lateness).select("site", "ts", F.unix_micros("ts").alias("us"))
    found = timed.groupBy("site").applyInPandasWithState(
        _watching(silence_s * SECOND, most_s * SECOND),
        "site string, opened long, last_seen long, closed_at long, n long, reason string",
        "opened long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return found.withColumns({c: F.timestamp_micros(c) for c in ("opened", "last_seen", "closed_at")})
