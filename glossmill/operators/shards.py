"""An activity log in shards, and states of its shards that can be merged.

The log is a table partitioned by ``shard`` (a month or another unit of time). Each
shard has a state: per repository the set of its actors as bitmaps of 32,768 numbers, and
per repository and name the first and the last star. States of different shards merge to the
exact figures of the whole log, so a new shard is read once and old ones never again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import popularity
from glossmill.session import materialise

MONTH = "yyyyMM"
SHARD = "shard"


def shard_of(created_at: Column | str, unit: str = MONTH) -> Column:
    """The name of the shard that a time falls into."""
    return F.date_format(created_at, unit)


def write_shards(events: DataFrame, path: str, unit: str = MONTH) -> None:
    """Write a log by shard; shards that exist and get rows are replaced, others stay."""
    (
        events.withColumn(SHARD, shard_of("created_at", unit))
        .write.partitionBy(SHARD)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_period(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """The shards from ``first`` to ``last``, both included; others are not even listed as input."""
    log = spark.read.option("basePath", path).parquet(path)
    shard = F.col(SHARD).cast("string")
    if first is not None:
        log = log.filter(shard >= first)
    if last is not None:
        log = log.filter(shard <= last)
    return log


def shards_in(spark: SparkSession, path: str) -> set[str]:
    """Names of the stored shards, from their folders; empty if there are none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return set()
    names = (str(entry.getPath().getName()) for entry in files.listStatus(root))
    return {name.partition("=")[2] for name in names if name.startswith(f"{SHARD}=")}


def actor_bitmaps(stars: DataFrame) -> DataFrame:
    """``shard, repo_id, bucket, actors``: the actors of a repository, 32,768 numbers a row."""
    return stars.groupBy(SHARD, "repo_id", F.bitmap_bucket_number("actor_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("actor_id")).alias("actors")
    )


def name_spans(stars: DataFrame) -> DataFrame:
    """``shard, repo_id, repo_name`` with the first and the last star."""
    return stars.groupBy(SHARD, "repo_id", "repo_name").agg(
        F.min("created_at").alias("first_star_date"), F.max("created_at").alias("last_star_date")
    )


def update_states(
    spark: SparkSession, log_path: str, state_path: str, watch_type: str = popularity.WATCH
) -> list[str]:
    """Add the states of the log's shards that have none yet; their names.

    The new shards alone are read, once for each of the two tables. A repeated run
    replaces a shard's state, so a job that was cut off can be run again.
    """
    known = shards_in(spark, f"{state_path}/actors") & shards_in(spark, f"{state_path}/names")
    missing = sorted(shards_in(spark, log_path) - known)
    if not missing:
        return []
    log = spark.read.option("basePath", log_path).parquet(
        *[f"{log_path}/{SHARD}={name}" for name in missing]
    )
    stars = popularity.watch_events(log, watch_type, SHARD).withColumn(
        SHARD, F.col(SHARD).cast("string")
    )
    for name, made in (("actors", actor_bitmaps(stars)), ("names", name_spans(stars))):
        # a shard without stars has a state too: one row of nulls
        marks = spark.createDataFrame([(x,) for x in missing], f"{SHARD} string")
        rows = made.unionByName(marks, allowMissingColumns=True)
        (
            rows.write.partitionBy(SHARD)
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .parquet(f"{state_path}/{name}")
        )
    return missing


def merged_stars(spark: SparkSession, state_path: str) -> DataFrame:
    """``repo_id, stars``: the exact number of different actors over all shards.

    A repository's actors are merged bucket by bucket, so a repository that owns a large
    share of the log is spread over tasks.
    """
    merged = (
        spark.read.parquet(f"{state_path}/actors")
        .filter(F.col("repo_id").isNotNull())
        .groupBy("repo_id", "bucket")
        .agg(F.bitmap_or_agg("actors").alias("actors"))
    )
    return merged.groupBy("repo_id").agg(F.sum(F.bitmap_count("actors")).alias("stars"))


def merged_profile(spark: SparkSession, state_path: str) -> DataFrame:
    """The repository profile of all shards that have a state."""
    names = (
        spark.read.parquet(f"{state_path}/names")
        .filter(F.col("repo_id").isNotNull())
        .groupBy("repo_id", "repo_name")
        .agg(
            F.min("first_star_date").alias("first_star_date"),
            F.max("last_star_date").alias("last_star_date"),
        )
    )
    dates = names.groupBy("repo_id").agg(
        F.max("last_star_date").alias("last_star_date"),
        F.min("first_star_date").alias("first_star_date"),
        F.sort_array(F.collect_list("repo_name")).alias("repo_names"),
    )
    return merged_stars(spark, state_path).join(dates, "repo_id").select(
        "repo_id", "stars", "last_star_date", "first_star_date", "repo_names"
    )


def merged_table(spark: SparkSession, state_path: str) -> DataFrame:
    """Stars per repository name over all shards, as from the whole log."""
    return popularity.latest_names(materialise(merged_profile(spark, state_path)))
