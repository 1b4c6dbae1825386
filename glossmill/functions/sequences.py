"""Token and id sequences: wrap, truncate, pad, shift, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_tokens(text: Column) -> Column:
    """Tokens of a blank-separated string."""
    return F.split(text, " ")


def token_count(text: Column) -> Column:
    """Number of blank-separated tokens; an empty string counts as one."""
    return F.size(F.split(text, " "))


def with_bounds(ids: Column, start: Column | int, end: Column | int) -> Column:
    """``[start] + ids + [end]``."""

    def one(x: Column | int) -> Column:
        return F.array((x if isinstance(x, Column) else F.lit(x)).cast("int"))

    return F.concat(one(start), ids, one(end))


def truncate(ids: Column, limit: int) -> Column:
    """The first ``limit`` elements."""
    return F.slice(ids, 1, limit)


def pad(ids: Column, limit: int, filler: Column | int) -> Column:
    """Exactly ``limit`` elements, filled up at the end."""
    fill = (filler if isinstance(filler, Column) else F.lit(filler)).cast("int")
    missing = F.greatest(F.lit(0), F.lit(limit) - F.size(ids))
    return F.slice(F.concat(ids, F.array_repeat(fill, missing)), 1, limit)


def shifted_targets(ids: Column, limit: int, end: Column | int) -> Column:
    """Targets one step ahead of the inputs, filled up with the end id.

    A sequence longer than ``limit`` has no label in its last slot (NULL).
    """
    fill = (end if isinstance(end, Column) else F.lit(end)).cast("int")
    ahead = F.slice(ids, 2, limit - 1)
    missing = F.lit(limit) - F.size(ahead)
    last = F.when(F.size(ids) > limit, F.lit(None).cast("int")).otherwise(fill)
    return F.concat(ahead, F.array_repeat(last, missing))


def arg_max(scores: Column) -> Column:
    """Zero-based position of the largest element, the first one on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def zip_elements(left: Column, right: Column) -> Column:
    """Pairs of elements at equal positions."""
    return F.transform(
        left, lambda x, i: F.struct(x.alias("left"), F.get(right, i).alias("right"))
    )


def differing(left: Column, right: Column, tolerance: float) -> Column:
    """``struct(pos, left, right)`` where two vectors differ by more than ``tolerance``."""
    return F.filter(
        F.transform(
            left,
            lambda x, i: F.struct(
                i.alias("pos"), x.alias("left"), F.get(right, i).alias("right")
            ),
        ),
        lambda e: F.abs(e["left"].cast("double") - e["right"].cast("double")) > tolerance,
    )


def equal_vectors(left: Column, right: Column) -> Column:
    """True if both vectors have the same length and equal elements."""
    return (F.size(left) == F.size(right)) & F.forall(
        zip_elements(left, right), lambda e: e["left"] == e["right"]
    )


def leading_digits(n: Column) -> Column:
    """Keep two leading digits below 1000, else three; the other digits become 0."""
    keep = F.when(n < 1000, 2).otherwise(3)
    digits = F.length(n.cast("string"))
    unit = F.pow(F.lit(10), F.greatest(digits - keep, F.lit(0))).cast("long")
    return n - n % unit


def one_hot_cells(rows: DataFrame, key: str, ids: Column) -> DataFrame:
    """``key, slot, token_id``: the non-zero cells of the indicator tensor."""
    return rows.select(key, F.posexplode(ids).alias("slot", "token_id"))
