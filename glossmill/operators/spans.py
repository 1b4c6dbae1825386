"""Innermost span around a position, for whole corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width in characters of the buckets that spans and positions meet in.
BUCKET = 1024


def innermost_span(
    cursors: DataFrame,
    spans: DataFrame,
    doc: str = "doc_id",
    cursor: str = "cursor_id",
    bucket: int = BUCKET,
) -> DataFrame:
    """The smallest span with ``start_off <= off < end_off`` per cursor, or NULLs.

    A range join by document would pair all cursors with all spans of a long
    document. Spans are cut to the buckets they touch instead, so the equality
    join is keyed by (document, bucket) and a cursor meets only the spans around
    it. Spans of equal size are told apart by their start.
    """
    cut = spans.filter(F.col("end_off") > F.col("start_off")).select(
        F.col(doc).alias("_doc"),
        "start_off",
        "end_off",
        F.explode(
            F.sequence(
                F.floor(F.col("start_off") / bucket), F.floor((F.col("end_off") - 1) / bucket)
            )
        ).alias("_bucket"),
    )
    inside = (
        (F.col("_doc") == F.col(doc))
        & (F.col("_bucket") == F.floor(F.col("off") / bucket))
        & (F.col("start_off") <= F.col("off"))
        & (F.col("off") < F.col("end_off"))
    )
    # size and start share one long, so the minimum runs in a hash aggregate
    size = (F.col("end_off") - F.col("start_off")).cast("long")
    found = (
        cursors.join(cut, inside)
        .groupBy(cursor)
        .agg(F.min(F.shiftleft(size, 32) + F.col("start_off")).alias("_best"))
        .select(
            cursor,
            F.col("_best").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("span_start"),
            F.shiftright("_best", 32).cast("int").alias("_size"),
        )
        .select(cursor, "span_start", (F.col("span_start") + F.col("_size")).alias("span_end"))
    )
    return cursors.join(found, cursor, "left")
