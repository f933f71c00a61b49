"""Decisions that depend on earlier decisions: sliding-log admission and daily quotas.

Both are ordered replays per user. Each exists as a batch job and as a keyed-stateful stream job
that share the same step function.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalspark.functions.tiers import UNLIMITED
from evalspark.session import work_dir

MICROS = 1_000_000
WINDOW_SECONDS = 60
DAY_SECONDS = 86_400
# A key with more rows than this is replayed slice after slice instead of in one group.
HOT_ROWS = 1_000_000

Columns = dict[str, list]
Step = Callable[[list[int], Columns, int, int], tuple[list[bool | None], list[int]]]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# -- step functions: rows [low, high) of one key in order, after a state -> (admitted, new state) ---


def admission_step(window_us: int) -> Step:
    """State: times of the accepted calls inside the window. Rejected calls leave no trace.

    Seed rows are accepted already; they enter the log and get no decision.
    """

    def step(
        log: list[int], rows: Columns, low: int, high: int
    ) -> tuple[list[bool | None], list[int]]:
        times, limits, seeds = rows["us"], rows["allowed"], rows["seed"]
        log, oldest, out = list(log), 0, []
        for i in range(low, high):
            now = times[i]
            while oldest < len(log) and log[oldest] <= now - window_us:
                oldest += 1
            admitted = seeds[i] or len(log) - oldest < limits[i]
            if admitted:
                log.append(now)
            out.append(None if seeds[i] else admitted)
        return out, log[oldest:]

    return step


def quota_step(day_us: int) -> Step:
    """State: [reset time, calls counted per kind...]. The first call at or after the reset time
    zeroes all counters and moves the reset one day past itself."""

    def step(
        state: list[int], rows: Columns, low: int, high: int
    ) -> tuple[list[bool], list[int]]:
        times, limits, kinds = rows["us"], rows["allowed"], rows["kind"]
        reset_at, *counts = state or [rows["first_reset"][low], 0, 0]
        out = []
        for i in range(low, high):
            if reset_at <= times[i]:
                reset_at, counts = times[i] + day_us, [0] * len(counts)
            admitted = limits[i] == UNLIMITED or counts[kinds[i]] < limits[i]
            if admitted:
                counts[kinds[i]] += 1
            out.append(admitted)
        return out, [reset_at, *counts]

    return step


# -- batch replay --------------------------------------------------------------------------------


def replay(rows: DataFrame, keys: list[str], step: Step, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, event_id, admitted) of ordered rows per key.

    Rows are partitioned by key, sorted by Spark and streamed through the step, which carries the
    state of one key at a time. Keys with more than ``hot_rows`` rows would keep one task busy for
    too long; they are cut at common points in time instead, each slice being one job that starts
    from the states the slice before it wrote to the shared folder.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    total = sizes.agg(F.sum("n").alias("n")).first()["n"]
    names = ", ".join(
        f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys
    )
    if not total:
        return _replay_whole(rows, keys, names, step)
    hot_keys = sizes.select(*keys)
    cold = _replay_whole(rows.join(hot_keys, keys, "left_anti"), keys, names, step)
    hot = rows.join(hot_keys, keys, "left_semi")
    return cold.unionByName(_replay_in_slices(hot, keys, names, step, total, hot_rows))


def _replay_whole(rows: DataFrame, keys: list[str], names: str, step: Step) -> DataFrame:
    """Every key from its first row on; memory holds one Arrow batch and one state per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for frame in frames:
            if not len(frame):
                continue
            columns = {name: frame[name].tolist() for name in frame.columns}
            ids = list(zip(*[columns[k] for k in keys]))
            admitted: list[bool] = []
            low = 0
            while low < len(ids):
                high = low + 1
                while high < len(ids) and ids[high] == ids[low]:
                    high += 1
                if ids[low] != current:
                    current, state = ids[low], []
                flags, state = step(state, columns, low, high)
                admitted += flags
                low = high
            yield frame[[*keys, "event_id"]].assign(admitted=admitted)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "us", "event_id")
    return ordered.mapInPandas(run, f"{names}, event_id long, admitted boolean")


def _replay_in_slices(
    rows: DataFrame, keys: list[str], names: str, step: Step, total: int, hot_rows: int
) -> DataFrame:
    spark = rows.sparkSession
    slices = math.ceil(total / hot_rows)
    shares = [i / slices for i in range(1, slices)]
    cuts = sorted(set(map(int, rows.approxQuantile("us", shares, 0.25 / slices)))) if shares else []
    bounds = [None, *cuts, None]
    out = work_dir(spark, "replay")
    schema = f"{names}, event_id long, admitted boolean, state array<long>"

    def slice_step(_: tuple, frame: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        state = list(carried["state"].iloc[0]) if len(carried) else []
        frame = frame.sort_values(["us", "event_id"])
        decisions = frame[[*keys, "event_id"]].assign(admitted=False, state=None)
        if len(frame):
            columns = {name: frame[name].tolist() for name in frame.columns}
            decisions["admitted"], state = step(state, columns, 0, len(frame))
        last = (frame if len(frame) else carried)[keys].head(1).assign(event_id=-1, admitted=False)
        last["state"] = [state]
        return pd.concat([decisions, last]) if len(frame) else last

    state = spark.createDataFrame([], f"{names}, state array<long>")
    paths = []
    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = rows
        if low is not None:
            part = part.where(F.col("us") >= low)
        if high is not None:
            part = part.where(F.col("us") < high)
        path = f"{out}/slice={number}"
        both = part.groupBy(*keys).cogroup(state.groupBy(*keys))
        both.applyInPandas(slice_step, schema).write.parquet(path)
        paths.append(path)
        state = spark.read.parquet(path).where(F.col("state").isNotNull()).select(*keys, "state")
    decided = spark.read.parquet(*paths).where(F.col("state").isNull())
    return decided.select(*keys, "event_id", "admitted")


def admission_replay(
    events: DataFrame,
    allowed: Column,
    window_seconds: int = WINDOW_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Which calls a sliding-log limiter accepts. ``events`` has user_id, event_id, created_at.

    Calls are counted per (user, window-long bucket) first. In a bucket that together with the one
    before it stays within the limit, every call is accepted whatever happened earlier. Only
    the remaining runs of busy buckets are replayed in order, each run on its own, seeded with the
    calls of the quiet bucket right before it.
    """
    window_us = window_seconds * MICROS
    calls = events.select(
        "user_id",
        "event_id",
        micros(F.col("created_at")).alias("us"),
        allowed.cast("long").alias("allowed"),
    ).withColumn("bucket", F.floor(F.col("us") / F.lit(window_us)).cast("long"))
    counted = calls.groupBy("user_id", "bucket").agg(
        F.count("*").alias("n"), F.min("allowed").alias("least")
    )
    by_time = Window.partitionBy("user_id").orderBy("bucket")
    before = F.lag("bucket").over(by_time) == F.col("bucket") - 1
    earlier = F.when(before, F.lag("n").over(by_time)).otherwise(F.lit(0))
    marked = counted.withColumn("busy", F.col("n") + earlier > F.col("least"))
    follows_busy = F.coalesce(before & F.lag("busy").over(by_time), F.lit(False))
    precedes_busy = F.coalesce(
        (F.lead("bucket").over(by_time) == F.col("bucket") + 1) & F.lead("busy").over(by_time),
        F.lit(False),
    )
    run = (
        marked.withColumn("starts", F.col("busy") & ~follows_busy)
        .withColumn("seeds", ~F.col("busy") & precedes_busy)
        .withColumn(
            "run",
            F.when(F.col("seeds"), F.col("bucket") + 1).when(
                F.col("busy"),
                F.last(F.when(F.col("starts"), F.col("bucket")), ignorenulls=True).over(
                    by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                ),
            ),
        )
        .where(F.col("run").isNotNull())
        .select("user_id", "bucket", "run", F.col("seeds").alias("seed"))
    )
    placed = calls.join(run, ["user_id", "bucket"], "left")
    quiet = placed.where(F.col("run").isNull() | F.col("seed")).select(
        "user_id", "event_id", F.lit(True).alias("admitted")
    )
    contested = placed.where(F.col("run").isNotNull()).select(
        "user_id", "run", "event_id", "us", "allowed", "seed"
    )
    decided = replay(contested, ["user_id", "run"], admission_step(window_us), hot_rows)
    decided = decided.where(F.col("admitted").isNotNull()).drop("run")
    return quiet.unionByName(decided)


def quota_replay(calls: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Which calls a daily quota admits.

    ``calls`` has user_id, event_id, created_at, kind (0 semantic, 1 model call), allowed (-1
    unlimited, 0 blocked) and reset_at, the reset time stored with the user.
    """
    rows = calls.select(
        "user_id",
        "event_id",
        micros(F.col("created_at")).alias("us"),
        F.col("allowed").cast("long").alias("allowed"),
        F.col("kind").cast("long").alias("kind"),
        micros(F.col("reset_at")).alias("first_reset"),
    )
    return replay(rows, ["user_id"], quota_step(DAY_SECONDS * MICROS), hot_rows)


# -- stream jobs ---------------------------------------------------------------------------------


def _stateful(step: Step, ends: Callable[[list[int]], int] | None) -> Callable:
    """``ends``: from when on a state decides like none at all. The watermark drops it then."""

    def run(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log, newest = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        late = rows["us"] < newest if newest is not None else pd.Series(False, index=rows.index)
        in_time = rows[~late]
        columns = {name: in_time[name].tolist() for name in in_time.columns}
        admitted, log = step(log, columns, 0, len(in_time)) if len(in_time) else ([], log)
        newest = int(in_time["us"].max()) if len(in_time) else newest
        state.update((log, newest))
        if ends is not None:
            over = max(newest, ends(log)) // 1000 + 1
            state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.concat(
            [
                in_time[["event_id"]].assign(admitted=admitted, late=False),
                rows[late][["event_id"]].assign(admitted=False, late=True),
            ]
        ).assign(user_id=key[0])[["user_id", "event_id", "admitted", "late"]]

    return run


def _decide(
    calls: DataFrame, columns: list[Column], step: Step, ends: Callable[[list[int]], int], delay: str | None
) -> DataFrame:
    """Without ``delay`` states are kept for good. With it they end by the watermark, and Spark leaves out the calls behind
    that and counts them in the progress (``numRowsDroppedByWatermark``), as their states may be gone."""
    timed, timeout = delay is not None, GroupStateTimeout.NoTimeout
    if timed:
        calls = calls.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
        columns, timeout = [*columns, F.col("created_at")], GroupStateTimeout.EventTimeTimeout
    return calls.select(*columns).groupBy("user_id").applyInPandasWithState(
        _stateful(step, ends if timed else None),
        "user_id long, event_id long, admitted boolean, late boolean",
        "log array<long>, newest long",
        "append",
        timeout,
    )


def admission_stream(
    events: DataFrame, allowed: Column, window_seconds: int = WINDOW_SECONDS, delay: str | None = None
) -> DataFrame:
    """Streaming twin of the admission replay; calls older than the user's newest are late.

    With ``delay`` a user's state ends once the watermark, that much behind the newest call of all, has passed the window of the
    user's last accepted call.
    """
    window_us = window_seconds * MICROS
    columns = [
        F.col("user_id"),
        F.col("event_id"),
        micros(F.col("created_at")).alias("us"),
        allowed.cast("long").alias("allowed"),
        F.lit(False).alias("seed"),
    ]
    return _decide(events, columns, admission_step(window_us), lambda log: log[-1] + window_us if log else 0, delay)


def quota_stream(calls: DataFrame, delay: str | None = None) -> DataFrame:
    """Streaming twin of the quota replay. With ``delay`` a user's state ends once the watermark has passed its reset time."""
    columns = [
        F.col("user_id"),
        F.col("event_id"),
        micros(F.col("created_at")).alias("us"),
        F.col("allowed").cast("long").alias("allowed"),
        F.col("kind").cast("long").alias("kind"),
        micros(F.col("reset_at")).alias("first_reset"),
    ]
    return _decide(calls, columns, quota_step(DAY_SECONDS * MICROS), lambda state: state[0], delay)
