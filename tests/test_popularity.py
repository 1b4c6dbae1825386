import datetime as dt
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossmill.operators import popularity, ranking

SCHEMA = "type string, repo struct<id:long,name:string>, actor struct<id:long>, created_at timestamp_ntz"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_stars_table(spark):
    rows = [
        ("WatchEvent", (1, "a/x"), (10,), day(0)),
        ("WatchEvent", (1, "a/x"), (10,), day(1)),
        ("WatchEvent", (1, "a/renamed"), (11,), day(2)),
        ("WatchEvent", (2, "a/x"), (12,), day(5)),  # same name, later id wins
        ("WatchEvent", (3, "nameonly"), (12,), day(5)),
        ("WatchEvent", (None, "b/y"), (13,), day(5)),
        ("ForkEvent", (4, "c/z"), (14,), day(6)),
        ("WatchEvent", (5, None), (14,), day(6)),
    ]
    out = {(r.repo_name, r.repo_id, r.stars) for r in popularity.stars_table(log(spark, rows)).collect()}
    assert out == {("a/x", 2, 1), ("a/renamed", 1, 2)}


def test_ties_keep_the_larger_id(spark):
    rows = [("WatchEvent", (i, "a/x"), (i,), day(0)) for i in (1, 2, 3)]
    assert [r.repo_id for r in popularity.stars_table(log(spark, rows)).collect()] == [3]


def test_hot_repository_is_exact_and_independent_of_partitions(spark):
    """A third of all events belong to one repository."""
    rng = random.Random(5)
    rows = [
        (
            "WatchEvent",
            (0, "hot/repo") if i % 3 == 0 else (rng.randrange(1, 40), f"o/r{rng.randrange(25)}"),
            (rng.randrange(500),),
            day(rng.randrange(300)),
        )
        for i in range(6000)
    ]
    df = log(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, popularity.stars_table(df).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    hot = len({r[2][0] for r in rows if r[1][0] == 0})
    assert [r[1] for r in results[0] if r[2] == "hot/repo"] == [hot]


def functions(spark, rows):
    return spark.createDataFrame(
        rows, "id string, paths array<string>, line int, character int, comments string, text string"
    )


def test_ranking_keeps_one_whole_function_per_id(spark):
    fs = functions(
        spark,
        [
            ("i", ["a/x/1.ts", "b/y/2.ts"], 9, 0, "later", "t9"),
            ("i", ["a/x/1.ts", "b/y/2.ts"], 3, 1, "first", "t3"),
            ("i", ["a/x/1.ts"], 1, 0, "x", "short comment"),
            ("j", ["odd"], 0, 0, "none", "u"),
            ("k", [], 0, 0, "no path", "u"),
        ],
    )
    stars = spark.createDataFrame([("a/x", 5), ("b/y", 7)], "repo_name string, stars long")
    out = {r.id: r for r in ranking.rank_functions(fs, stars).collect()}
    assert set(out) == {"i", "j"}
    assert tuple(out["i"]) == (
        "i", 0, [("a/x/1.ts", 2), ("b/y/2.ts", 2)], 4, 3, 1, "first", "t3", 7,
    )
    assert out["j"].stars is None and out["j"].paths == [("odd", 1)]
    per_function = ranking.rank_functions(fs, stars, ("id", "line", "character"))
    assert per_function.count() == 3
    assert ranking.popular(per_function, 7).count() == 2


def test_equal_positions_are_decided_by_the_texts(spark):
    rows = [("i", ["a/x/1.ts"], 2, 5, f"comment {i}", f"text {i % 3}") for i in range(12)]
    rows += [("i", ["a/x/1.ts"], 2, 6, "later", "t"), ("n", ["a/x/1.ts"], 0, 0, "no text", None)]
    key = lambda r: hashlib.md5(f"{r[4]}\0{r[5]}".encode()).hexdigest()[:15]
    want = min(rows[:12], key=key)
    for n in (1, 5):
        stored = ranking.numbered(functions(spark, rows).repartition(n))
        got = {r.id: tuple(r) for r in ranking.first_functions(stored).collect()}
        assert got["i"] == ("i", *want[2:]) and got["n"] == ("n", 0, 0, "no text", None)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_large_ids_have_a_row_per_range_of_paths(spark, size):
    """An id that owns most rows is split; every path keeps its copies, in order."""
    paths = [f"a/x/{i:03}.ts" for i in range(10)]
    rows = [("hot", paths[: 1 + i % 10], i, 0, "comment", f"t{i}") for i in range(60)]
    rows += [(f"cold{i}", paths[:2], 0, 0, "comment", "t") for i in range(25)]
    stars = spark.createDataFrame([("a/x", 5)], "repo_name string, stars long")
    got = ranking.rank_functions(functions(spark, rows).repartition(4), stars, size=size).collect()
    assert all(len(r.paths) <= size and r.stars == 5 for r in got)
    assert all((r.text is not None) == (r.part == 0) for r in got)
    for id_ in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.id == id_), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(len(mine)))
        want = sorted(Counter(p for r in rows if r[0] == id_ for p in r[1]).items())
        assert [tuple(p) for r in mine for p in r.paths] == want
        assert {r.n_paths for r in mine} == {sum(n for _, n in want)}


def test_ranking_sorts_no_texts(spark):
    fs = functions(spark, [("i", ["a/x/1.ts"], i, 0, "comment", "t" * 9) for i in range(5)])
    stored = ranking.numbered(fs)
    plan = ranking.first_functions(stored)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Window" not in plan
    stars = spark.createDataFrame([("a/x", 5)], "repo_name string, stars long")
    plan = ranking.rank_functions(fs, stars)._jdf.queryExecution().executedPlan().toString()
    # arrays of at most PART paths are the only objects that are aggregated
    assert "SortAggregate" not in plan and "array_repeat" not in plan and plan.count("collect_list") <= 4


def test_paths_of_a_hot_content_are_combined_before_the_shuffle(spark):
    fs = functions(spark, [("hot", ["a/x/1.ts"], i, 0, "comment", "t") for i in range(3000)])
    paths = ranking.function_paths(fs)
    assert [tuple(r) for r in paths.collect()] == [("hot", "a/x/1.ts", 3000)]
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_predicates_reach_the_scan(spark, tmp_path):
    log(spark, [("WatchEvent", (1, "a/x"), (1,), day(0))]).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    plan = popularity.watch_events(stored).select("repo_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,WatchEvent)" in plan and "IsNotNull(repo.id)" in plan
    assert "ReadSchema: struct<type:string,repo:struct<id:bigint>>" in plan


def test_latest_name_uses_group_limits(spark):
    df = log(spark, [("WatchEvent", (1, "a/x"), (1,), day(0))])
    plan = popularity.stars_table(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "Contains" in plan.split("Window [")[-1]


def test_repo_of_short_paths_is_null(spark):
    df = spark.createDataFrame([("a/b/c",), ("a/b",), ("a",), (None,)], "p string")
    assert [r.r for r in df.select(ranking.repo_of_path(F.col("p")).alias("r")).collect()] == [
        "a/b", "a/b", None, None,
    ]
