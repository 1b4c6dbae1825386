"""Popularity of repositories, derived from an activity log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WATCH = "WatchEvent"


def watch_events(events: DataFrame, watch_type: str = WATCH, *more: str) -> DataFrame:
    """Flatten the log to ``repo_id, repo_name, actor_id, created_at`` of stars.

    Both predicates sit directly on the scan so that they reach the reader. ``more`` are
    columns of the log that are kept as they are.
    """
    return events.filter(
        (F.col("type") == watch_type) & F.col("repo.id").isNotNull()
    ).select(
        F.col("repo.id").alias("repo_id"),
        F.col("repo.name").alias("repo_name"),
        F.col("actor.id").alias("actor_id"),
        "created_at",
        *more,
    )


def repository_names(stars: DataFrame) -> DataFrame:
    """First and last star per (repository, name).

    Plain min/max: every map task reduces a hot repository to one row per name
    before the shuffle.
    """
    return stars.groupBy("repo_id", "repo_name").agg(
        F.min("created_at").alias("first_star_date"),
        F.max("created_at").alias("last_star_date"),
    )


def repository_stars(stars: DataFrame) -> DataFrame:
    """Exact number of different actors per repository.

    A single distinct count: the first shuffle is keyed by (repository, actor),
    which spreads one hot repository over all tasks, and only partial counts
    reach the shuffle by repository.
    """
    return stars.groupBy("repo_id").agg(F.count_distinct("actor_id").alias("stars"))


def repository_profile(stars: DataFrame) -> DataFrame:
    """``repo_id, stars, last_star_date, first_star_date, repo_names``.

    Dates and names come from the (repository, name) aggregate, so the name array
    is built from one row per name and never from one row per event.
    """
    names = repository_names(stars)
    dates = names.groupBy("repo_id").agg(
        F.max("last_star_date").alias("last_star_date"),
        F.min("first_star_date").alias("first_star_date"),
        F.sort_array(F.collect_list("repo_name")).alias("repo_names"),
    )
    return repository_stars(stars).join(dates, "repo_id").select(
        "repo_id", "stars", "last_star_date", "first_star_date", "repo_names"
    )


def ranked_names(profile: DataFrame) -> DataFrame:
    """One row per (repository, name) with ``rn`` counting from the latest star."""
    latest = Window.partitionBy("repo_name").orderBy(
        F.col("last_star_date").desc(), F.col("repo_id").desc()
    )
    return (
        profile.select("*", F.explode("repo_names").alias("repo_name"))
        .drop("repo_names")
        .withColumn("rn", F.row_number().over(latest))
    )


def stars_table(events: DataFrame, watch_type: str = WATCH) -> DataFrame:
    """Stars per repository name; a name used by several ids keeps the latest id.

    The name pattern is a predicate on the window key, so the optimiser evaluates
    it below the window; the rank filter becomes a group limit on both sides of
    the shuffle, which leaves one row per name and map task.
    """
    return latest_names(repository_profile(watch_events(events, watch_type)))


def latest_names(profile: DataFrame) -> DataFrame:
    """A row per repository name, for the id that was starred last under it."""
    return (
        ranked_names(profile)
        .filter(F.col("repo_name").like("%/%") & (F.col("rn") == 1))
        .select("repo_id", "stars", "repo_name", "last_star_date", "first_star_date")
    )
