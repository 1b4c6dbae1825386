"""Shards of the activity log and the states that are merged over them."""

import datetime as dt
import random

import pytest

from glossmill.operators import popularity, shards

SCHEMA = "type string, repo struct<id:long,name:string>, actor struct<id:long>, created_at timestamp_ntz"


def events(n=900, seed=4):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        repo = 1 if rng.random() < 0.4 else rng.choice([2, 3, 4, None])  # one repository owns a large share
        actor = rng.choice([None, -5, 0, 32768, 32769, 10**12, *range(60)])
        when = dt.datetime(2023, rng.choice([10, 11, 12]), rng.randrange(1, 28), rng.randrange(24))
        name = rng.choice(["a/x", "b/y", "plain", None])
        out.append((rng.choice(["WatchEvent", "WatchEvent", "Push"]), (repo, name), (actor,), when))
    return out


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "log"), str(tmp_path / "state")


def test_states_merge_to_the_whole_log(spark, places):
    log, state = places
    whole = spark.createDataFrame(events(), SCHEMA)
    shards.write_shards(whole, log)
    assert shards.shards_in(spark, log) == {"202310", "202311", "202312"}
    assert shards.update_states(spark, log, state) == ["202310", "202311", "202312"]
    want = popularity.repository_profile(popularity.watch_events(whole))
    assert sorted(map(tuple, shards.merged_profile(spark, state).collect())) == sorted(map(tuple, want.collect()))
    table = sorted(map(tuple, shards.merged_table(spark, state).collect()))
    assert table == sorted(map(tuple, popularity.stars_table(whole).collect()))


def test_a_new_shard_reads_no_old_one(spark, places, tmp_path):
    log, state = places
    whole = spark.createDataFrame(events(), SCHEMA)
    old = whole.filter("created_at < timestamp'2023-12-01'")
    shards.write_shards(old, log)
    shards.update_states(spark, log, state)
    assert shards.update_states(spark, log, state) == []
    for shard in ("202310", "202311"):
        for part in (tmp_path / "log" / f"shard={shard}").glob("*.parquet"):
            part.write_bytes(b"no longer readable")
    shards.write_shards(whole.filter("created_at >= timestamp'2023-12-01'"), log)
    assert shards.update_states(spark, log, state) == ["202312"]
    want = popularity.repository_stars(popularity.watch_events(whole))
    assert sorted(map(tuple, shards.merged_stars(spark, state).collect())) == sorted(map(tuple, want.collect()))


def test_shards_are_pruned_and_the_type_is_pushed(spark, places):
    log, _ = places
    shards.write_shards(spark.createDataFrame(events(), SCHEMA), log)
    some = shards.read_period(spark, log, "202311", "202311")
    plan = popularity.watch_events(some).select("repo_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(type,WatchEvent)" in plan and "IsNotNull(repo.id)" in plan
    read = {f.split("shard=")[1].split("/")[0] for f in some.select("type").inputFiles()}
    assert {r.m for r in some.selectExpr("date_format(created_at, 'yyyyMM') m").distinct().collect()} == {"202311"}
    assert "202311" in read


def test_shards_without_stars_have_a_state(spark, places):
    log, state = places
    rows = [("Push", (1, "a/x"), (1,), dt.datetime(2023, 10, 1)), ("WatchEvent", (1, "a/x"), (None,), dt.datetime(2023, 11, 1))]
    shards.write_shards(spark.createDataFrame(rows, SCHEMA), log)
    assert shards.update_states(spark, log, state) == ["202310", "202311"]
    assert shards.update_states(spark, log, state) == []
    want = popularity.repository_stars(popularity.watch_events(spark.createDataFrame(rows, SCHEMA)))
    assert [tuple(r) for r in shards.merged_stars(spark, state).collect()] == [tuple(r) for r in want.collect()]
    assert shards.shards_in(spark, "file:/nowhere/at/all") == set()
