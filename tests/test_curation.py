"""Collections, the interaction log and accounts."""

import datetime as dt
import functools
import pathlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.operators import accounts, changes, curation, event_log, mining
from evalspark.plans.queries import QUERIES

LINKS = "collection_id long, example_id long"


def pairs(df):
    return sorted((r["collection_id"], r["example_id"]) for r in df.collect())


def test_add_outcomes(rows):
    links = rows(LINKS, (1, 10))
    examples = rows("id long, dataset_id long", (10, 5), (11, 6))
    asked = rows(LINKS, (1, 10), (1, 11), (1, 11), (1, 99), (1, 99))
    done = curation.classify_adds(asked, links, examples)
    assert curation.add_summary(done).first().asDict() == {
        "collection_id": 1, "added": 1, "skipped_duplicates": 2, "not_found": 2,
    }
    event = curation.pick_events(done).collect()
    assert [(e["event_type"], e["example_id"], e["dataset_id"]) for e in event] == [("pick", 11, 6)]


def test_add_examples_tasks_follow_the_rows(spark, rows, tmp_path, monkeypatch):
    dealt = functools.partial(curation.dealt_pairs, pairs_per_task=20)
    monkeypatch.setattr(curation, "dealt_pairs", dealt)
    known, brand = range(0, 8), lambda p: f"Brand#{p + 10}"
    lines = [(o, o * 3 % 11, n) for o in range(60) for n in (1, 1, 2)] + [(None, 3, 1), (4, None, 1), (5, 6, 2)]
    orders = [(o, o * 7 % 2503) for o in range(65)] + [(None, 3), (6, None), (7, 49)]
    rows("l_orderkey long, l_partkey long, l_linenumber int", *lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows("o_orderkey long, o_custkey long", *orders).write.parquet(f"{tmp_path}/orders.parquet")
    parts = [(p, "n", brand(p), "t") for p in known]
    rows("p_partkey long, p_name string, p_brand string, p_type string", *parts).write.parquet(f"{tmp_path}/part.parquet")

    asked = [(o, p) for o, p, n in lines if n == 1]
    for o, c in orders:
        wanted = None if c is None else c % 2500
        asked += [(o, wanted), (o, wanted), (o, None if c is None else -1 - c)]
    present = {(o, p) for o, p, _ in lines if o is not None and p is not None}
    sums, events = {}, []
    for (o, p), times in Counter(asked).items():
        sums.setdefault(o, [0, 0, 0])
        if (o, p) in present:
            sums[o][1] += times
        elif p in known:
            sums[o][0] += 1
            sums[o][1] += times - 1
            events.append((o, p, p + 10))
        else:
            sums[o][2] += times
    done = QUERIES["add_examples"](spark, str(tmp_path))
    assert {r[0]: list(r[1:]) for r in done.collect()} == sums
    picks = QUERIES["pick_events"](spark, str(tmp_path)).collect()
    assert Counter(r[1:] for r in picks) == Counter(events)
    # Both sides are dealt by pair, once, to as many tasks as their rows need, whatever the session's partitions.
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    tasks = re.findall(r"hashpartitioning\(collection_id#\d+L?, example_id#\d+L?, (\d+)\)", plan)
    assert tasks == [str(-(-(len(asked) + len(lines)) // 20))] * 2


def test_remove_undoes_add(rows):
    links = rows(LINKS, (1, 10), (2, 10))
    extra = rows(LINKS, (1, 11), (2, 12))
    back = curation.remove(links.unionByName(extra), extra.unionByName(rows(LINKS, (7, 7))))
    assert pairs(back) == pairs(links)
    assert pairs(curation.remove_events(curation.removed(links, rows(LINKS, (1, 10), (5, 5))))) == [(1, 10)]


def test_lists_and_updates(rows):
    day = dt.datetime(2024, 1, 1)
    collections = rows(
        "id long, name string, description string, user_id long, created_at timestamp",
        (1, "a", None, 7, day), (2, "b", "old", 7, day + dt.timedelta(1)), (3, "c", None, 8, day),
    )
    links = rows(LINKS, (1, 10), (1, 11), (3, 10))
    out = curation.list_collections(collections, links, owner=7).collect()
    assert [(r["id"], r["example_count"]) for r in out] == [(2, 0), (1, 2)]
    patches = rows("id long, new_name string, new_description string", (1, "z", None), (2, None, "new"))
    out = curation.update_collections(collections, patches, rows("id long", (3,))).collect()
    assert sorted((r["id"], r["name"], r["description"]) for r in out) == [(1, "z", None), (2, "b", "new")]


EVENTS = "event_type string, collection_id long, example_id long, user_id long, query string"


def test_event_mining(rows):
    log = [("pick", 1, 100, 1, None)] * 3 + [("pick", 1, 101, 1, None)] + [("pick", 2, 102, 2, None)] * 2
    log += [("search", None, None, 1, "q"), ("search", None, None, 1, "q"), ("pick", 1, None, 1, None)]
    events = rows(EVENTS, *log)
    assert [r["example_id"] for r in mining.popular(events).collect()] == [100, 102, 101]
    mine = {(r["stat"], r["key"]): r["n"] for r in mining.event_stats(events, user_id=1).collect()}
    assert mine[("total", None)] == 7 and mine[("query", "q")] == 2 and mine[("type", "pick")] == 5
    everyone = mining.event_stats(events).collect()
    assert not any(r["stat"] == "query" for r in everyone)
    empty = mining.event_stats(events, user_id=99).collect()
    assert [(r["stat"], r["n"]) for r in empty] == [("total", 0)]
    with pytest.raises(ValueError):
        mining.popular(events, limit=201)


def test_co_picks_equal_brute_force(rows):
    rng = random.Random(1)
    # One collection holds a third of all picks.
    log = [(1 if rng.random() < 0.33 else rng.randint(2, 30), rng.randint(1, 40)) for _ in range(900)]
    events = rows(EVENTS, *[("pick", c, e, 1, None) for c, e in log])

    def brute(anchor):
        holding = {c for c, e in log if e == anchor}
        counts = Counter(e for c, e in log if c in holding and e != anchor)
        return sorted(((-n, e) for e, n in counts.items()))[:10]

    got = [(-r["co_pick_count"], r["example_id"]) for r in mining.co_picked(events, 5).collect()]
    assert got == brute(5)
    wanted = rows("example_id long", (5,), (6,), (41,))
    many = mining.co_picked_for(events, wanted).collect()
    for anchor in (5, 6):
        mine = sorted((r["rank"], -r["co_pick_count"], r["example_id"]) for r in many if r["anchor_id"] == anchor)
        assert [m[1:] for m in mine] == brute(anchor)
    assert not any(r["anchor_id"] == 41 for r in many)


def test_session_ids(rows):
    events = rows("session_id string", ("ok-1_A",), ("has space",), ("x" * 101,), ("",), (None,))
    assert [r["session_id"] for r in mining.normalise(events).collect()] == ["ok-1_A", None, None, None, None]


USERS = (
    "id long, email string, tier string, trial_ends_at timestamp, customer_id string, "
    "subscription_id string, subscription_status string"
)
SUBS = (
    "event_id long, created_at timestamp, type string, email string, customer_id string, "
    "subscription_id string, status string, product_id string"
)


def test_subscription_fold(rows):
    trial = dt.datetime(2024, 2, 1)
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    users = rows(
        USERS,
        (1, "a@x", "free", trial, None, None, None), (2, "b@x", "pro", None, "c2", "s", "active"),
        (3, "c@x", "free", trial, None, None, None), (4, "d@x", "ultra", None, None, None, None),
    )
    events = rows(
        SUBS,
        (1, at(1), "subscription.created", "a@x", "c1", "s1", "active", "ultra"),
        (2, at(2), "subscription.updated", "a@x", "c1", "s2", "past_due", "pro"),
        (3, at(1), "subscription.canceled", "other@x", "c2", "s3", "canceled", ""),
        (4, at(1), "subscription.updated", "c@x", "", "s4", "incomplete", "ultra"),
        (5, at(1), "subscription.created", "", "c2", "s5", "active", "ultra"),
        (6, at(1), "order.paid", "d@x", "", "s6", "active", "ultra"),
        (7, at(1), "subscription.created", "ghost@x", "", "s7", "active", "ultra"),
    )
    out = {r["id"]: r for r in accounts.fold_subscriptions(events, users, "ultra").collect()}
    one = out[1]
    assert (one["tier"], one["trial_ends_at"], one["subscription_status"]) == ("ultra", None, "past_due")
    assert (one["customer_id"], one["subscription_id"], one["applied"]) == ("c1", "s2", 2)
    assert (out[2]["tier"], out[2]["subscription_status"], out[2]["subscription_id"]) == ("free", "canceled", "s")
    assert (out[3]["tier"], out[3]["trial_ends_at"], out[3]["subscription_status"]) == ("free", trial, "incomplete")
    assert (out[4]["tier"], out[4]["applied"]) == ("ultra", 0)


def test_newest_events_of_a_heavy_user(rows):
    users = rows("id long, email string, tier string, trial_ends_at timestamp", (1, "a", "free", None), (2, "b", "pro", None))
    none = rows("id long, name string, description string, user_id long, created_at timestamp", (9, "n", None, 2, dt.datetime(2024, 1, 1)))
    links = rows(LINKS, (9, 4))
    keys = rows("id long, user_id long, key_prefix string, key_hash string, created_at timestamp", (3, 2, "ck_3", "SECRET", dt.datetime(2024, 1, 1)))
    start = dt.datetime(2024, 1, 1)
    log = [(i, "view", 1, None, None, None, start + dt.timedelta(seconds=i)) for i in range(500)]
    events = rows("id long, event_type string, user_id long, query string, example_id long, collection_id long, created_at timestamp", *log)
    out = accounts.personal_export(users, none, links, keys, events, newest=100).collect()
    kept = sorted(r["item_id"] for r in out if r["section"] == "event")
    assert kept == list(range(400, 500))
    whole = accounts.personal_export(users, none, links, keys, events).where("section = 'event'")
    assert whole.count() == 500
    assert not any("SECRET" in r["payload"] for r in out)
    assert sorted(r["section"] for r in out if r["user_id"] == 2) == ["account", "api_key", "collection", "collection_example"]


def test_erasure(rows):
    tables = {
        "users": rows("id long", (1,), (2,)),
        "collections": rows("id long, user_id long", (5, 1), (6, 2)),
        "links": rows(LINKS, (5, 1), (6, 1)),
        "api_keys": rows("id long, user_id long", (1, 1)),
        "events": rows("id long, user_id long, session_id string, collection_id long", (1, 1, "s", 6), (2, 2, "t", 5), (3, 2, "t", 6)),
    }
    out = accounts.erase(tables, rows("user_id long", (1,)))
    assert [r["id"] for r in out["users"].collect()] == [2] and pairs(out["links"]) == [(6, 1)]
    assert out["api_keys"].count() == 0 and [r["id"] for r in out["collections"].collect()] == [6]
    kept = sorted((r["id"], r["user_id"], r["session_id"], r["collection_id"]) for r in out["events"].collect())
    assert kept == [(1, None, None, 6), (2, 2, "t", None), (3, 2, "t", 6)]


def stored_tables(spark, tmp_path):
    """Collections, links and events of three users, in partitions."""
    event = (
        "id", "if(id % 5 = 0, null, id % 40) AS collection_id", "id AS example_id", "id % 9 AS dataset_id",
        "id % 3 AS user_id", "concat('s', id) AS session_id", "id % 40 % 8 AS part",
    )
    frames = {
        "collections": spark.range(40).selectExpr("id", "id % 3 AS user_id", "id % 8 AS part"),
        "links": spark.range(400).selectExpr("id % 40 AS collection_id", "id AS example_id", "id % 40 % 8 AS part"),
        "events": spark.range(200).selectExpr(*event),
    }
    paths = {}
    for name, frame in frames.items():
        paths[name] = str(tmp_path / name)
        frame.write.partitionBy("part").parquet(paths[name])
    return frames, paths


def files(path):
    return {str(f) for f in pathlib.Path(path).rglob("*.parquet")}


def test_deleted_collections_touch_their_partitions_only(spark, tmp_path):
    frames, paths = stored_tables(spark, tmp_path)
    gone = [0, 8, 16, 24, 32, 3, 99]  # all of partition 0, one of partition 3, one that is not there
    removal = changes.deleted_collections(spark.createDataFrame([(i,) for i in [*gone, 3, None]], "id long"))
    before = {name: files(path) for name, path in paths.items()}
    for turn in range(2):
        touched = {name: removal.rewrite(spark, path, name, "part") for name, path in paths.items()}
        # The second run finds nothing left to do.
        assert touched == {name: [] if turn else [0, 3] for name in paths}
        read = {name: spark.read.schema(frames[name].schema).parquet(path).collect() for name, path in paths.items()}
        assert {r["id"] for r in read["collections"]} == set(range(40)) - set(gone)
        assert {r["example_id"] for r in read["links"]} == {i for i in range(400) if i % 40 not in gone}
        want = {i: None if i % 5 == 0 or i % 40 in gone else i % 40 for i in range(200)}
        assert {r["id"]: r["collection_id"] for r in read["events"]} == want and len(read["events"]) == 200
        assert all((r["example_id"], r["session_id"]) == (r["id"], f"s{r['id']}") for r in read["events"])
    for name, path in paths.items():
        untouched = {f for f in before[name] if "part=0" not in f and "part=3" not in f}
        assert untouched <= files(path) and not (before[name] - untouched) & files(path)


def test_erasure_as_a_change_set(spark, tmp_path):
    frames, _ = stored_tables(spark, tmp_path)
    leaving = spark.createDataFrame([(1,)], "user_id long")
    theirs = frames["collections"].join(leaving, "user_id", "left_semi").select("id")
    out = changes.deleted_users(leaving, theirs).applied(frames["events"], "events").collect()
    for r in out:
        user, lost = r["id"] % 3, r["id"] % 40 % 3 == 1
        assert (r["user_id"], r["session_id"]) == ((None, None) if user == 1 else (user, f"s{r['id']}"))
        assert r["collection_id"] == (None if r["id"] % 5 == 0 or lost else r["id"] % 40)
    assert len(out) == 200


def test_event_batches_are_recorded_once(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    schema = "key long, event_type string, created_at timestamp_ntz, session_id string, query string, event_metadata struct<a:int>, other string"
    at = dt.datetime(2024, 1, 1)
    batch = rows(
        schema,
        (1, "search", at, "s-1", "q", (1,), "x"), (2, "pick", at, "bad id", None, None, "y"),
        (3, None, at, None, None, None, "z"), (4, "v" * 51, at, None, None, None, "z"),
    )
    unfit = event_log.event_rows(batch, "b1", "key").where("event_type IS NULL OR length(event_type) = 51")
    for _ in range(2):
        refused = event_log.record(batch, path, "b1", "key")
        assert sorted(r["id"] for r in refused.collect()) == sorted(r["id"] for r in unfit.collect())
    event_log.record(batch.where("key < 3"), path, "b2", "key")
    log = event_log.read_log(spark, path).collect()
    assert Counter(r["batch"] for r in log) == {"b1": 2, "b2": 2} and len({r["id"] for r in log}) == 4
    first = next(r for r in log if r["batch"] == "b1" and r["event_type"] == "search")
    assert (first["session_id"], first["query"], first["event_metadata"], first["example_id"]) == ("s-1", "q", '{"a":1}', None)
    assert all(r["session_id"] is None for r in log if r["event_type"] == "pick")
    assert [f.name for f in schemas.CURATION_EVENTS.fields] == event_log.read_log(spark, path).columns[:-1]
    with pytest.raises(ValueError, match="batch name"):
        event_log.record(batch, path, "../x", "key")
    shown = event_log.searches(rows("query_id string, query string", ("a", "x"), ("a", "x")), "hybrid", F.lit(at))
    saved = event_log.exports(rows("collection_id long, example_id long", (5, 1), (5, 2)), "csv", F.lit(at))
    event_log.record(shown, path, "b3", "query_id")
    event_log.record(saved, path, "b4", "collection_id")
    late = event_log.read_log(spark, path).where("batch IN ('b3', 'b4')").collect()
    assert {(r["event_type"], r["search_mode"], r["export_format"], r["collection_id"]) for r in late} == {("search", "hybrid", None, None), ("export", None, "csv", 5)}
