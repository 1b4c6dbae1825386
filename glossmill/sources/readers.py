"""Readers: Parquet shards and tables, JSON lines (plain or gzip)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mined functions as exported by the extraction step; positions are integers.
FUNCTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("paths", T.ArrayType(T.StringType())),
        T.StructField("line", T.StringType()),
        T.StructField("character", T.StringType()),
        T.StructField("comments", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("stars", T.StringType()),
    ]
)

#: Processed dataset entries.
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("character", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("comments", T.StringType()),
        T.StructField("ast", T.StringType()),
    ]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """On a single machine, give every core work when a scan has fewer splits.

    Small test files have one row group, which no split size divides. On a cluster a
    scan is returned as it is, so texts are never shuffled for it.
    """
    sc = scan.sparkSession.sparkContext
    if not sc.master.startswith("local["):
        return scan
    cores = sc.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def read_shards(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """All shards whose path matches a glob, as one relation."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(pattern)


def read_functions_jsonl(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Mined functions from JSON lines, gzip included.

    The positions arrive as strings or as numbers and are cast once here. A gzip file is one
    task, so ``partitions`` spreads its rows before the expensive columns.
    """
    rows = spark.read.schema(FUNCTION_SCHEMA).json(path)
    if partitions is not None:
        rows = rows.repartition(partitions)
    return rows.withColumns(
        {
            "line": F.col("line").cast("int"),
            "character": F.col("character").cast("int"),
            "stars": F.col("stars").cast("long"),
        }
    )


def read_entries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Processed dataset entries from JSON lines."""
    return spark.read.schema(ENTRY_SCHEMA).json(path)


#: Clean dataset: structure, normalised comment, original comment.
CLEAN_SCHEMA = "ast string, comments string, comments_orig string"

#: The one-row dataset profile.
METADATA_SCHEMA = (
    "skipped long, avg_comment_len double, max_comment_len long, avg_ast_len double, "
    "max_ast_len long, observations long, entries long"
)


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """The clean dataset; texts may span lines."""
    return (
        spark.read.schema(CLEAN_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("lineSep", "\n")
        .csv(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A stored dataset profile."""
    return spark.read.schema(METADATA_SCHEMA).json(path)


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A stored vocabulary ``(token, id)`` and its parameters ``(name, value)``."""
    tokens = spark.read.schema("token string, id int").json(f"{path}/tokens")
    params = spark.read.schema("name string, value long").json(f"{path}/params")
    return tokens, params
