"""From source files to the dataset in one job: extract, rank, threshold, records, limits, cap.

The sources are read once: functions are stored as they are extracted, with a number for
each and with whether its record keeps within the limits. Stars, limits and the cap work on
thin rows of keys and numbers; code, comments and trees are fetched by number for the
functions that pass all of them, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.dataset import N_OBSERVATIONS, capped, fits_limits, prepare_entries
from glossmill.operators.extraction import extract_functions
from glossmill.operators.ranking import commented, function_paths, lookup_stars
from glossmill.session import MAX_BROADCAST_ROWS, materialise

MIN_STARS = 100
_EXTRACTED = ("id", "paths", "line", "character", "comments", "text", "kind", "name", "params", "body")


def stored_functions(files: DataFrame, **limits: int) -> DataFrame:
    """Extracted functions with ``_at``, a number, and ``_fits``, the verdict of the limits."""
    found = commented(extract_functions(files)).filter(F.size("paths") > 0).select(*_EXTRACTED)
    record = prepare_entries(found, "paths", "kind", "name", "params", "body", F.col("comments").alias("_raw"))
    return materialise(
        record.select(
            "id", "paths", "line", "character", F.col("_raw").alias("comments"), F.col("code").alias("text"),
            "kind", "name", "params", "body",
            fits_limits(F.col("comments"), F.col("ast"), **limits).alias("_fits"),
        ).withColumn("_at", F.monotonically_increasing_id())
    )


def popular_contents(stored: DataFrame, stars: DataFrame, min_stars: int) -> DataFrame:
    """``id, stars`` of contents with a path in a repository of enough stars; stored."""
    paths = materialise(function_paths(stored))
    best = lookup_stars(paths, stars).groupBy("id").agg(F.max("stars").alias("stars"))
    return materialise(best.filter(F.col("stars") >= min_stars))


def mined_dataset(
    files: DataFrame, stars: DataFrame, min_stars: int = MIN_STARS, n: int = N_OBSERVATIONS, **limits: int
) -> DataFrame:
    """``id, line, character, stars, code, comments, ast`` of the first ``n`` popular functions.

    ``files`` has ``id, paths, content``; ``stars`` is the stars table. Records without a
    comment or beyond the limits do not count towards ``n``.
    """
    stored = stored_functions(files, **limits)
    popular = popular_contents(stored, stars, min_stars)
    thin = stored.filter("_fits").select("id", "line", "character", "_at").join(popular, "id")
    chosen = capped(materialise(thin), n).select("_at", "stars")
    if n <= MAX_BROADCAST_ROWS:
        chosen = F.broadcast(chosen)  # n rows at most
    entries = prepare_entries(stored.join(chosen, "_at"), "stars")
    return entries.select("id", "line", "character", "stars", "code", "comments", "ast")
