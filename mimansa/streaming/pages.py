"""Fetch logs as streams: page state, and seen urls and contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "url string, seq long, event string, content_hash string, fetched_at string, last_changed_at string, interval double"
STATE = "content_hash string, fetched_at string, last_changed_at string, interval double"


def _events(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One event a fetch: first, unchanged, changed or refreshed; the recrawl interval follows."""
    digest, at, changed_at, interval = state.get if state.exists else (None, None, None, 3600.0)
    rows = []
    for fetch in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
        if fetch.status == "ok":
            event = "first" if digest is None else "unchanged" if fetch.content_hash == digest else "changed"
            if event != "unchanged":
                changed_at = fetch.fetched_at
            digest = fetch.content_hash
        elif fetch.status == "not_modified" and digest is not None:
            event = "refreshed"
        else:
            continue
        at = fetch.fetched_at
        if event != "first":
            interval = min(86400.0, max(300.0, interval * (0.5 if event == "changed" else 1.5)))
        rows.append((key[0], fetch.seq, event, digest, at, changed_at, interval))
    if digest is not None:
        state.update((digest, at, changed_at, interval))
    yield pd.DataFrame(rows, columns=["url", "seq", "event", "content_hash", "fetched_at", "last_changed_at", "interval"])


def page_events(fetches: DataFrame) -> DataFrame:
    """Events of a stream of fetches, by url; the state is one short row a page."""
    return fetches.groupBy("url").applyInPandasWithState(_events, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def unseen(rows: DataFrame, key: str, time: str, lateness: str = "7 days") -> DataFrame:
    """Rows whose key has not been seen within the lateness: the store of seen urls or contents."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """window_start, by, n of a stream; late rows count until the watermark has passed."""
    grouped = events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), F.col(by))
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops."""
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
