"""Page state from fetch logs: upserts, versions, changes, recrawl intervals, the frontier.

A log is `fetches(seq, url, fetched_at, status, content_hash, etag, last_modified, g_score)`, in which status "ok" has a
content hash and "not_modified" only refreshes a page that is known. All folds are windows or ordered aggregates by url.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Recrawl intervals in seconds: first, least, most, and the factors for a changed and an unchanged page.
START, LEAST, MOST, SHRINK, GROW = 3600.0, 300.0, 86400.0, 0.5, 1.5


def with_history(fetches: DataFrame) -> DataFrame:
    """Adds prev_hash and changed (null for a first crawl and for refreshes) to the fetches that count."""
    order = Window.partitionBy("url").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("status") == "ok"
    known = fetches.where(F.col("url").isNotNull() & F.col("status").isin("ok", "not_modified")).withColumns(
        {"prev_hash": F.last(F.when(ok, F.col("content_hash")), ignorenulls=True).over(before), "_seen": F.max(ok.cast("int")).over(before)}
    )
    counted = known.where(ok | (F.col("_seen") == 1))
    return counted.withColumn("changed", F.when(ok & (F.col("_seen") == 1), ~F.col("content_hash").eqNullSafe(F.col("prev_hash")))).drop("_seen")


def page_state(fetches: DataFrame) -> DataFrame:
    """url, content_hash, fetched_at, last_changed_at, etag, last_modified, g_score, n_versions of every known page.

    An unchanged recrawl keeps last_changed_at; a refresh moves fetched_at and replaces etag and last_modified only by
    values that are not blank. Latest is by `seq`.
    """
    h = with_history(fetches)
    ok = F.col("status") == "ok"
    fresh = ok & F.coalesce("changed", F.lit(True))
    refresh = lambda c: F.when(ok | (F.coalesce(c, F.lit("")) != ""), F.struct("seq", F.col(c).alias("v")))
    return h.groupBy("url").agg(
        F.max(F.when(ok, F.struct("seq", "content_hash"))).alias("_hash"), F.max(F.struct("seq", "fetched_at")).alias("_at"), F.max(F.when(fresh, F.struct("seq", "fetched_at"))).alias("_changed"),
        F.max(refresh("etag")).alias("_etag"), F.max(refresh("last_modified")).alias("_mod"), F.max(F.when(ok, F.struct("seq", "g_score"))).alias("_g"), F.count_if(ok).alias("n_versions"),
    ).select(
        "url", F.col("_hash.content_hash").alias("content_hash"), F.col("_at.fetched_at").alias("fetched_at"), F.col("_changed.fetched_at").alias("last_changed_at"),
        F.col("_etag.v").alias("etag"), F.col("_mod.v").alias("last_modified"), F.col("_g.g_score").alias("g_score"), "n_versions",
    )


def versions(fetches: DataFrame) -> DataFrame:
    """The snapshot log: one row for each fetch with content."""
    return fetches.where((F.col("status") == "ok") & F.col("url").isNotNull()).select("seq", "url", "fetched_at", "content_hash", "etag", "last_modified")


def changes(fetches: DataFrame) -> DataFrame:
    """url, seq, detected_at, old_hash, new_hash of every change of content."""
    return with_history(fetches).where(F.coalesce("changed", F.lit(False))).select("url", "seq", F.col("fetched_at").alias("detected_at"), F.col("prev_hash").alias("old_hash"), F.col("content_hash").alias("new_hash"))


def latest_versions(log: DataFrame) -> DataFrame:
    """The newest row of each url by id; rows logged twice count once."""
    return log.where(F.col("url").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("id")))).where(F.col("_n") == 1).drop("_n")


def inconsistent(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Pages without a version, or whose newest version has another hash. A refresh moves times, so only hashes compare."""
    newest = latest_versions(log).select("url", F.col("content_hash").alias("version_hash"))
    joined = pages.join(newest, "url", "left")
    return joined.where(~F.col("content_hash").eqNullSafe(F.col("version_hash"))).select("url", "content_hash", "version_hash")


def adaptive_intervals(fetches: DataFrame, start: float = START, least: float = LEAST, most: float = MOST, shrink: float = SHRINK, grow: float = GROW) -> DataFrame:
    """url, interval after every recrawl of it: halved on change, half as long again without, within bounds."""
    steps = with_history(fetches).where(F.coalesce("prev_hash", F.lit("")) != "").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("changed", F.lit(False)).alias("changed")))).alias("steps"))
    fold = F.aggregate("steps", F.lit(start), lambda acc, s: F.greatest(F.lit(least), F.least(F.lit(most), acc * F.when(s["changed"], shrink).otherwise(grow))))
    return steps.select("url", fold.alias("interval"))


def fixed_interval(url: Column, default: float, overrides: dict[str, float] | None = None) -> Column:
    """The interval of a url, at least a second."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]), url) if overrides else F.lit(None).cast("double")
    return F.greatest(F.lit(1.0), F.coalesce(own, F.lit(float(default))))


def is_due(last: Column, interval: Column, now: Column) -> Column:
    return now >= last + interval


def frontier(tasks: DataFrame) -> DataFrame:
    """Tasks with their priority and their `host_slot`, the place in the order of their host by priority, then arrival.

    A url counts once, when first added. Priority is given, or importance (1 if missing) plus staleness (0 if missing).
    """
    first = tasks.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("seq"))).where(F.col("_n") == 1).drop("_n")
    rank = F.coalesce("priority", F.coalesce("base_importance", F.lit(1.0)) + F.coalesce("staleness", F.lit(0.0)))
    rows = first.withColumn("priority", rank.cast("double")).withColumn("host", F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))))
    slot = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "seq")) - 1
    return rows.select("url", "host", "priority", "seq", slot.alias("host_slot"))


def ready_hosts(hosts: DataFrame, now: float, delay: float) -> DataFrame:
    """host, wait: seconds until a host may be asked again; 0 if it may be now or never was."""
    wait = F.greatest(F.lit(0.0), F.col("last_fetch") + F.lit(delay) - F.lit(now))
    return hosts.groupBy("host").agg(F.max("last_fetch").alias("last_fetch")).select("host", F.coalesce(wait, F.lit(0.0)).alias("wait"))


def pop_order(tasks: DataFrame, delay: float, step: float = 1.0) -> DataFrame:
    """url, popped_at of taking one task every `step` seconds, each time the best whose host is not cooling down.

    The order is sequential by nature, so the queue (a bounded schedule) goes through one task; the hosts' own orders are
    made before. For unbounded queues use `frontier`, whose host_slot times the delay is each task's earliest start.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        import heapq

        queues = {h: sorted(zip(-g["priority"], g["seq"], g["url"])) for h, g in frame.groupby("host")}
        ready = [(*q[0], h) for h, q in queues.items()]
        heapq.heapify(ready)
        at, cooling, now, out = dict.fromkeys(queues, 0), [], 0.0, []
        while ready or cooling:
            while cooling and cooling[0][0] <= now:
                h = heapq.heappop(cooling)[1]
                heapq.heappush(ready, (*queues[h][at[h]], h))
            if ready:
                _, _, url, h = heapq.heappop(ready)
                out.append((url, now))
                at[h] += 1
                if at[h] < len(queues[h]):
                    heapq.heappush(cooling, (now + delay, h))
            now += step
        return pd.DataFrame(out, columns=["url", "popped_at"])

    return frontier(tasks).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "url string, popped_at double")


def simulate(schedule: DataFrame, intervals: dict[str, tuple[float, float, float, float, float]], hours: float, budget: int, step: float = 900.0) -> DataFrame:
    """scheduler, requests, caught, occurred, staleness_hours of recrawling `schedule(url, position, changes ARRAY<DOUBLE>)`.

    `intervals` has (start, least, most, shrink, grow) of every scheduler; a fixed one has factors of 1. The budget is
    shared by the urls of one scheduler, in their order of position, so each scheduler is one group: a simulation's
    stated list of urls, not a corpus.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        start, least, most, shrink, grow = intervals[key[0]]
        pages = [dict(changes=sorted(c), interval=start, crawled=0.0, seen=0, at=0) for c in frame.sort_values("position")["changes"]]
        requests = caught = occurred = 0
        stale = now = 0.0
        while now < hours * 3600 and requests < budget:
            for p in pages:
                before = p["at"]
                while p["at"] < len(p["changes"]) and p["changes"][p["at"]] <= now:
                    p["at"] += 1
                occurred += p["at"] > before
                stale += step * (p["at"] > p["seen"])
            for p in pages:
                if requests < budget and now >= p["crawled"] + p["interval"]:
                    requests += 1
                    hit = p["at"] > p["seen"]
                    caught += hit
                    p["seen"], p["crawled"] = p["at"], now
                    p["interval"] = min(most, max(least, p["interval"] * (shrink if hit else grow)))
            now += step
        return pd.DataFrame([(key[0], requests, caught, occurred, stale / 3600 / max(1, len(pages)))], columns=["scheduler", "requests", "caught", "occurred", "staleness_hours"])

    names = schedule.sparkSession.createDataFrame([(n,) for n in intervals], "scheduler string")
    return schedule.join(F.broadcast(names)).groupBy("scheduler").applyInPandas(run, "scheduler string, requests long, caught long, occurred long, staleness_hours double")


def change_schedule(n_urls: int, hours: float, mean_hours: list[float], seed: int) -> Iterator[tuple[str, int, list[float]]]:
    """Change times of every url, drawn in the order in which one shared generator is asked while time steps on."""
    import random

    rng = random.Random(seed)
    draw = lambda i, now: now + max(1800.0, rng.expovariate(1.0 / (mean_hours[i % len(mean_hours)] * 3600.0)))
    upcoming = [draw(i, 0.0) for i in range(n_urls)]
    changes: list[list[float]] = [[] for _ in range(n_urls)]
    now = 0.0
    while now < hours * 3600:
        for i in range(n_urls):
            while now >= upcoming[i]:
                changes[i].append(upcoming[i])
                upcoming[i] = draw(i, upcoming[i])
        now += 900.0
    for i in range(n_urls):
        yield f"page_{i}", i, changes[i]
