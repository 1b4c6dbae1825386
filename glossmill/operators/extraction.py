"""Mine functions and their leading comments from source files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glossmill.functions.scanner import find_functions
from glossmill.functions.structure import function_structure

FUNCTION_TYPE = T.StructType(
    [
        T.StructField("line", T.IntegerType()),
        T.StructField("character", T.IntegerType()),
        T.StructField("comments", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("params", T.ArrayType(T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("start_off", T.IntegerType()),
        T.StructField("end_off", T.IntegerType()),
    ]
)


@F.arrow_udf(T.ArrayType(FUNCTION_TYPE))
def functions_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All functions of each source text; unreadable text gives an empty array."""
    rows = to_arrow_type(T.ArrayType(FUNCTION_TYPE))
    kinds = {f.name: f.type for f in rows.value_type}
    for content in batches:
        found = [find_functions(s.as_py()) for s in content]
        columns = [pa.array([f[c] for file in found for f in file], kind) for c, kind in kinds.items()]
        flat = pa.StructArray.from_arrays(columns, fields=list(rows.value_type))
        bounds = np.cumsum([0, *map(len, found)], dtype=np.int32)
        yield pa.ListArray.from_arrays(pa.array(bounds), flat, type=rows)


def extract_functions(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per function next to the other columns of the file.

    Only the content crosses to Python, and only for files that can hold a
    function; each file is read once however many functions it has. No shuffle.
    """
    keep = [c for c in files.columns if c != content]
    return (
        files.filter(F.col(content).contains("(") & F.col(content).contains("{"))
        .select(*keep, F.explode(functions_of(F.col(content))).alias("f"))
        .select(*keep, "f.*")
    )


def with_structure(found: DataFrame) -> DataFrame:
    """Add the structure string ``ast`` of every extracted function."""
    return found.withColumn(
        "ast", function_structure(F.col("kind"), F.col("name"), F.col("params"), F.col("body"))
    )


class _FunctionsTable:
    """Rows of one source text for the SQL table function.

    Table functions over whole Arrow batches cannot stand in a lateral join; this one
    is called by text, and its rows still travel as Arrow batches.
    """

    def eval(self, content: str) -> Iterator[tuple]:
        for f in find_functions(content):
            yield tuple(f[c] for c in FUNCTION_TYPE.names)


def register_sql(spark: SparkSession, name: str = "functions_of") -> None:
    """Register the SQL surface: ``LATERAL <name>(content)`` and ``<name>_array(content)``."""
    spark.udtf.register(name, F.udtf(_FunctionsTable, returnType=FUNCTION_TYPE, useArrow=True))
    spark.udf.register(f"{name}_array", functions_of)
