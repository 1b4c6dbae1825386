"""Greedy decoding of scored tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_tokens(scores: DataFrame) -> DataFrame:
    """Highest-scoring token per ``(example, step)``; the smaller token wins a tie."""
    return (
        scores.groupBy("example", "step")
        .agg(F.max(F.struct("score", (-F.col("token")).alias("neg"))).alias("b"))
        .select("example", "step", (-F.col("b.neg")).alias("token"), F.col("b.score").alias("score"))
    )


def greedy_decode(scores: DataFrame, end_token: int, limit: int) -> DataFrame:
    """``example, tokens``: best token per step up to the end token or the limit.

    An example has at most ``limit`` steps, so its list is bounded and the cut is
    an array operation instead of a second join.
    """
    ordered = F.sort_array(F.collect_list(F.struct("step", "token")))["token"]
    stop = F.array_position("tokens", end_token).cast("int")
    return (
        best_tokens(scores.filter(F.col("step") < limit))
        .groupBy("example")
        .agg(ordered.alias("tokens"))
        .select(
            "example",
            F.when(stop > 0, F.slice("tokens", F.lit(1), stop - 1)).otherwise(F.col("tokens")).alias("tokens"),
        )
    )


def spell(tokens: Column, pieces: list[str]) -> Column:
    """Replace token numbers by their texts, for small fixed alphabets."""
    table = F.array(*[F.lit(p) for p in pieces])
    return F.transform(tokens, lambda t: F.get(table, t.cast("int")))
