"""Ordered replays: plain Python, batch job, sliced hot keys and stream agree."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import accounts
from evalspark.session import work_dir
from evalspark.streaming import counts, replay, subscriptions
from test_curation import SUBS, USERS

START = dt.datetime(2024, 1, 1)
CALLS = "user_id long, event_id long, created_at timestamp"


def make_calls(seed, users=6, events=900, span=4000):
    rng = random.Random(seed)
    out = []
    for i in range(events):
        # User 0 makes a third of all calls.
        user = 0 if rng.random() < 0.34 else rng.randrange(users)
        out.append((user, i, START + dt.timedelta(seconds=rng.randrange(span * 10) / 10)))
    return out


def plain_admission(calls, limit, window):
    logs, out = {}, {}
    for user, event, ts in sorted(calls, key=lambda c: (c[2], c[1])):
        log = [t for t in logs.get(user, []) if t > ts - dt.timedelta(seconds=window)]
        out[event] = len(log) < limit
        if out[event]:
            log.append(ts)
        logs[user] = log
    return out


def decisions(df):
    found = df.collect()
    assert len(found) == len({r["event_id"] for r in found})
    return {r["event_id"]: r["admitted"] for r in found}


@pytest.mark.parametrize("limit,window", [(2, 60), (5, 60), (1, 10), (40, 600)])
def test_admission_equals_plain_replay(spark, limit, window):
    calls = make_calls(limit)
    want = plain_admission(calls, limit, window)
    frame = spark.createDataFrame(calls, CALLS)
    assert decisions(replay.admission_replay(frame, F.lit(limit), window)) == want


def test_hot_keys_are_replayed_in_slices(spark):
    calls = make_calls(9, users=3, events=600, span=600)
    frame = spark.createDataFrame(calls, CALLS)
    want = plain_admission(calls, 3, 60)
    assert not all(want.values())
    assert decisions(replay.admission_replay(frame, F.lit(3), 60, hot_rows=80)) == want


QUOTA = CALLS + ", kind int, allowed long, reset_at timestamp"


def quota_calls(seed):
    rng = random.Random(seed)
    allowed = {0: (3, 0), 1: (-1, 2), 2: (2, 4)}
    out = []
    for user, event, ts in make_calls(seed, users=3, events=400, span=400_000):
        kind = rng.randrange(2)
        out.append((user, event, ts, kind, allowed[user][kind], START + dt.timedelta(hours=30)))
    return out


def plain_quota(calls):
    state, out = {}, {}
    for user, event, ts, kind, allowed, first in sorted(calls, key=lambda c: (c[2], c[1])):
        reset, used = state.get(user, (first, [0, 0]))
        if reset <= ts:
            reset, used = ts + dt.timedelta(days=1), [0, 0]
        out[event] = allowed == -1 or used[kind] < allowed
        used[kind] += out[event]
        state[user] = (reset, used)
    return out


@pytest.mark.parametrize("hot", [replay.HOT_ROWS, 100])
def test_quota_equals_plain_replay(spark, hot):
    calls = quota_calls(4)
    frame = spark.createDataFrame(calls, QUOTA)
    assert decisions(replay.quota_replay(frame, hot_rows=hot)) == plain_quota(calls)


def write_batches(spark, calls, schema, folder, parts=4):
    """Files in time order, one per micro-batch."""
    ordered = sorted(calls, key=lambda c: c[2])
    size = -(-len(ordered) // parts)
    for i in range(parts):
        piece = ordered[i * size : (i + 1) * size]
        frame = spark.createDataFrame(piece, schema).coalesce(1)
        frame.write.mode("append").parquet(folder)


def test_streams_equal_batch(spark, tmp_path):
    calls = make_calls(2, events=400, span=1500)
    write_batches(spark, calls, CALLS, str(tmp_path / "a"))
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    out = counts.drain(replay.admission_stream(stream, F.lit(2), 60), spark, "test-admission")
    assert out.where("late").count() == 0
    assert decisions(out) == plain_admission(calls, 2, 60)
    calls = quota_calls(8)
    write_batches(spark, calls, QUOTA, str(tmp_path / "b"))
    stream = spark.readStream.schema(QUOTA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b"))
    assert decisions(counts.drain(replay.quota_stream(stream), spark, "test-quota")) == plain_quota(calls)


def test_stream_counts_equal_batch(spark, tmp_path):
    rng = random.Random(0)
    events = [(START + dt.timedelta(minutes=i * 7), rng.choice("ab")) for i in range(500)]
    ordered = sorted(events)
    for i in range(0, 500, 125):
        frame = spark.createDataFrame(ordered[i : i + 125], "created_at timestamp, event_type string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = (
        spark.readStream.schema("created_at timestamp, event_type string")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "e"))
    )
    got = counts.run_counts(counts.event_counts(stream), spark).collect()
    want = {}
    for ts, kind in events:
        want[(ts.date(), kind)] = want.get((ts.date(), kind), 0) + 1
    assert {(r["window_start"].date(), r["event_type"]): r["n"] for r in got} == want


def streamed(spark, folder, decide):
    """Runs a stream over all files of a folder, one a batch: its rows, how many states each batch left, and calls left out."""
    out = work_dir(spark, "test-stream")
    source = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(folder)
    query = decide(source).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    rows = {r["event_id"]: (r["admitted"], r["late"]) for r in spark.read.parquet(f"{out}/rows").collect()}
    return rows, [s["numRowsTotal"] for s in states], sum(s["numRowsDroppedByWatermark"] for s in states)


def test_stream_state_ends(spark, tmp_path):
    """One burst of a user's own per step of time: a state is dropped after its window, and results stay those of the replay."""
    folder, calls = str(tmp_path / "c"), []
    for step in range(6):
        part = [(step * 10 + u, step * 100 + u * 4 + i, START + dt.timedelta(hours=step, seconds=i)) for u in range(8) for i in range(4)]
        # One user calls in every burst and is never forgotten wrongly.
        part += [(999, step * 100 + 90 + i, START + dt.timedelta(hours=step, seconds=i * 10)) for i in range(3)]
        calls += part
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(folder)
    got, left, dropped = streamed(spark, folder, lambda c: replay.admission_stream(c, F.lit(2), window_seconds=60, delay="10 minutes"))
    want = {event: (admitted, False) for event, admitted in plain_admission(calls, 2, 60).items()}
    assert got == want and dropped == 0
    assert max(left) <= 3 * 9 and left[-1] <= 2 * 9
    # Without a watermark every user's state stays.
    got, left, _ = streamed(spark, folder, lambda c: replay.admission_stream(c, F.lit(2), window_seconds=60))
    assert got == want and left[-1] == 6 * 8 + 1

    quotas = lambda c: replay.quota_stream(
        c.select("*", F.lit(1).alias("kind"), F.lit(2).alias("allowed"), F.lit(START).alias("reset_at")), delay="10 minutes"
    )
    days = str(tmp_path / "d")
    spread = [(u, e, START + (ts - START) * 30) for u, e, ts in calls]
    for step in range(6):
        part = [c for c in spread if c[1] // 100 == step]
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(days)
    got, left, dropped = streamed(spark, days, quotas)
    counted, reset = {}, {}
    for user, event, ts in sorted(spread, key=lambda c: (c[2], c[1])):
        if reset.get(user, START) <= ts:
            reset[user], counted[user] = ts + dt.timedelta(days=1), 0
        assert got[event] == (counted[user] < 2, False)
        counted[user] += counted[user] < 2
    assert dropped == 0 and max(left) <= 3 * 9 and left[-1] <= 2 * 9


def test_stream_tells_late_calls(spark, tmp_path):
    folder = str(tmp_path / "c")
    hour = dt.timedelta(hours=1)
    for part in (
        [(1, 1, START), (2, 2, START + 10 * hour)],
        [(2, 3, START + 11 * hour)],
        # Users 1 and 3 have no call after the watermark so far; user 2 has called later already; the last one is in time.
        [(1, 4, START + hour), (3, 5, START + 2 * hour), (2, 6, START + 9 * hour), (1, 7, START + 12 * hour)],
    ):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(folder)
    first = {1: (True, False), 2: (True, False), 3: (True, False)}
    got, _, dropped = streamed(spark, folder, lambda c: replay.admission_stream(c, F.lit(5), window_seconds=60, delay="30 minutes"))
    assert got == {**first, 7: (True, False)} and dropped == 3
    got, _, dropped = streamed(spark, folder, lambda c: replay.admission_stream(c, F.lit(5), window_seconds=60))
    assert got == {**first, 4: (True, False), 5: (True, False), 6: (False, True), 7: (True, False)} and dropped == 0


STATE = ["id", "tier", "trial_ends_at", "customer_id", "subscription_id", "subscription_status", "applied"]


def subscription_files(spark, folder, events, size):
    for i in range(0, len(events), size):
        spark.createDataFrame(events[i : i + size], SUBS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SUBS).option("maxFilesPerTrigger", 1).parquet(folder)


def some_events(seed, first, last, users):
    rng = random.Random(seed)
    kinds = ("subscription.created", "subscription.updated", "subscription.canceled", "other")
    return [
        (i, START + dt.timedelta(minutes=i), rng.choice(kinds), f"u{rng.randrange(users)}@x", "", f"s{i}",
         rng.choice(("active", "past_due")), rng.choice(("ultra", "pro")))
        for i in range(first, last)
    ]


def test_subscription_stream(spark, tmp_path):
    users = spark.createDataFrame([(i, f"u{i}@x", "free", START, None, None, None) for i in range(40)], USERS)
    events = some_events(6, 0, 90, 6)
    path, folder = work_dir(spark, "test-subs"), str(tmp_path / "s")

    def state_of(frame):
        return sorted(map(tuple, frame.select(*STATE).collect()))

    def whole(upto):
        return state_of(accounts.fold_subscriptions(spark.createDataFrame(events[:upto], SUBS), users, "ultra"))

    stream = subscription_files(spark, folder, events[:60], 20)
    state = subscriptions.run_subscriptions(stream, users, path, "ultra", compact_every=2)
    assert state_of(state.users()) == whole(60)
    # Batches 0 and 1 are in the base now; a batch holds no users but those it changed.
    assert state._through() == 1 and {r["batch"] for r in state.changes().select("batch").distinct().collect()} == {0, 1, 2}
    assert state.changes().groupBy("batch").count().agg(F.max("count")).first()[0] <= 6
    # A restart without new events changes nothing, whatever users it is given.
    other = users.withColumn("tier", F.lit("pro"))
    again = subscriptions.run_subscriptions(stream, other, path, "ultra", compact_every=2)
    assert state_of(again.users()) == whole(60) and again._through() == 1
    # New events go on from there.
    stream = subscription_files(spark, folder, events[60:], 30)
    assert state_of(subscriptions.run_subscriptions(stream, other, path, "ultra", compact_every=99).users()) == whole(90)
    # A batch that runs again replaces its folder; one that the base holds is left out.
    state.apply(spark.createDataFrame(events[60:], SUBS), 3, "ultra")
    state.apply(spark.createDataFrame(events[:20], SUBS), 0, "ultra")
    assert state_of(state.users()) == whole(90)
    # A compaction changes no row, and one that was cut off before its mark is not read.
    users.withColumn("applied", F.lit(99).cast("long")).write.parquet(f"{path}/base/through=77")
    state.compact()
    assert state._through() == 3 and state_of(state.users()) == whole(90)
    state.compact()
    assert state._through() == 3 and state_of(state.users()) == whole(90)


def test_subscription_state_before_events(spark):
    state = subscriptions.SubscriptionState(spark, work_dir(spark, "test-subs"))
    with pytest.raises(ValueError, match="no subscription state"):
        state.users()
    users = spark.createDataFrame([(1, "u1@x", "free", None, None, None, None)], USERS)
    state.create(users)
    state.compact()
    assert [tuple(r) for r in state.users().select("id", "tier", "applied").collect()] == [(1, "free", 0)]
    state.apply(spark.createDataFrame([], SUBS), 0, "ultra")
    assert state.changes().count() == 0 and state.users().count() == 1
    # A customer id learned in one batch matches events of the next.
    state.apply(spark.createDataFrame([(1, START, "subscription.created", "u1@x", "c1", "s1", "active", "ultra")], SUBS), 1, "ultra")
    state.apply(spark.createDataFrame([(2, START, "subscription.canceled", "new@x", "c1", "s1", "canceled", "")], SUBS), 2, "ultra")
    assert [tuple(r) for r in state.users().select("tier", "customer_id", "applied").collect()] == [("free", "c1", 2)]
