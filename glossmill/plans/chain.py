"""The whole way from source files to the capped dataset as one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators.chain import mined_dataset
from glossmill.plans import inputs
from glossmill.plans.cleaning import sql_clean_comment, sql_function_structure, sql_to_placeholders
from glossmill.plans.mining import MINED_VIEWS, stars_of
from glossmill.plans.oracle_inputs import with_inputs
from glossmill.plans.registry import query
from glossmill.session import materialise

MIN_STARS, RECORDS = 4, 500

_PARAMS = "string_split(params, ',')"
_RECORDS = f"""SELECT id, line, "character", stars, text AS code,
  {sql_to_placeholders(sql_clean_comment("comments"), "name", _PARAMS)} AS comments,
  {sql_function_structure("kind", "name", _PARAMS, "body")} AS ast
FROM (SELECT m.*, m.doc_id::VARCHAR AS id, s.stars FROM mined m JOIN documents d USING (doc_id)
  JOIN stars_table s ON s.repo_name = d.source || '/' || d.lang
  WHERE length(m.comments) >= 2 AND s.stars >= {MIN_STARS})"""


@query(
    "p8_mined_dataset",
    with_inputs(
        "stars_table",
        f"""SELECT * FROM records WHERE comments <> '' AND len(string_split(comments, ' ')) <= 200
  AND len(string_split(ast, ' ')) <= 500 ORDER BY id, line, "character" LIMIT {RECORDS}""",
        **MINED_VIEWS,
        records=_RECORDS,
    ),
)
def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popular functions of all files, cleaned, within the limits, the first by position."""
    stars = materialise(stars_of(spark, sf_dir))
    found = mined_dataset(inputs.repository_files(spark, sf_dir), stars, MIN_STARS, RECORDS)
    return found.withColumns({c: F.col(c).cast("long") for c in ("line", "character")})
