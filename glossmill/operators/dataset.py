"""Build the dataset: entries, length filter, cap, profile, language filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.comments import clean_comment
from glossmill.functions.normalise import normalise_comment
from glossmill.functions.placeholders import to_placeholders
from glossmill.functions.sequences import leading_digits, token_count
from glossmill.functions.structure import function_structure
from glossmill.operators.vocabulary import dense_ids
from glossmill.session import MAX_BROADCAST_ROWS

# Limits of the published datasets; every job takes them as parameters.
MAX_COMMENT_LENGTH = 200
MAX_AST_LENGTH = 500
N_OBSERVATIONS = 100_000
#: Positions the driver samples to find the bound of a cap.
SAMPLE = 20_000


def prepare_entries(found: DataFrame, *more: Column | str) -> DataFrame:
    """``id, line, character, code, comments, ast`` of extracted functions.

    Expects the columns of ``extract_functions``. All steps are expressions of one
    projection. ``more`` are columns that are kept as they are.
    """
    return found.select(
        *more,
        "id",
        "line",
        "character",
        F.col("text").alias("code"),
        to_placeholders(clean_comment(F.col("comments")), F.col("name"), F.col("params")).alias(
            "comments"
        ),
        function_structure(F.col("kind"), F.col("name"), F.col("params"), F.col("body")).alias(
            "ast"
        ),
    )


def fits_limits(
    comments: Column,
    ast: Column,
    max_comment: int = MAX_COMMENT_LENGTH,
    max_ast: int = MAX_AST_LENGTH,
) -> Column:
    """True if an entry has a comment and neither side is longer than its limit."""
    return (
        (comments != "") & (token_count(comments) <= max_comment) & (token_count(ast) <= max_ast)
    )


def keep_fitting(entries: DataFrame, **limits: int) -> DataFrame:
    """Entries within the limits."""
    return entries.filter(fits_limits(F.col("comments"), F.col("ast"), **limits))


def position_bound(places: DataFrame, n: int) -> tuple | None:
    """A position that at least ``n`` rows do not exceed, and few more; None for all rows.

    Positions are sampled by hash, about ``SAMPLE`` of them; the one whose rank in the
    sample stands for ``n`` rows and a margin is tried, with a wider margin if rows lack.
    """
    total = places.count()
    if total <= n:
        return None
    share = max(1, total // SAMPLE)
    sampled = places.where(F.pmod(F.xxhash64(*places.columns), F.lit(share)) == 0).collect()
    sampled = sorted(map(tuple, sampled), key=lambda p: tuple((x is not None, x) for x in p))
    expected, margin = n / share, 4.0
    while True:
        at = int(expected + margin * (expected**0.5 + 1))
        if at >= len(sampled):
            return None
        if places.where(_not_behind(places, sampled[at])).count() >= n:
            return sampled[at]
        margin *= 2


def _not_behind(places: DataFrame, bound: tuple) -> Column:
    given = F.struct(*[F.lit(v).cast(places.schema[c].dataType) for c, v in zip(places.columns, bound, strict=True)])
    return F.struct(*places.columns) <= given


def capped(entries: DataFrame, n: int = N_OBSERVATIONS) -> DataFrame:
    """The first ``n`` entries by position (``id, line, character``, unique).

    A plain sorted limit would send up to ``n`` wide rows of every task to one task, and
    a global sort would move every position. Here a bound is selected that little more
    than ``n`` positions keep within; they alone are ranked exactly, over all tasks, and
    select the entries.
    """
    position = ["id", "line", "character"]
    places = entries.select(*position)
    bound = position_bound(places, n)
    kept = places if bound is None else places.where(_not_behind(places, bound))
    ranked = dense_ids(kept, *position, out="_rank", kind="long")
    first = ranked.filter(F.col("_rank") < n).drop("_rank")
    if bound is not None:
        entries = entries.where(_not_behind(places, bound))
    return entries.join(F.broadcast(first) if n <= MAX_BROADCAST_ROWS else first, position, "left_semi")


def dataset_profile(entries: DataFrame, **limits: int) -> DataFrame:
    """One row of statistics: maxima over all rows, averages over kept rows."""
    kept = F.col("kept")
    return (
        entries.select(
            token_count(F.col("comments")).alias("comment_len"),
            token_count(F.col("ast")).alias("ast_len"),
            fits_limits(F.col("comments"), F.col("ast"), **limits).alias("kept"),
        )
        .agg(
            F.count_if(~kept).alias("skipped"),
            F.avg(F.when(kept, F.col("comment_len"))).alias("avg_comment_len"),
            F.max("comment_len").alias("max_comment_len"),
            F.avg(F.when(kept, F.col("ast_len"))).alias("avg_ast_len"),
            F.max("ast_len").alias("max_ast_len"),
            F.count(F.lit(1)).alias("observations"),
            F.count_if(kept).alias("entries"),
        )
    )


def run_name(profile: DataFrame, count: str = "entries") -> DataFrame:
    """Name of a run: the row count with its leading digits kept."""
    return profile.select(leading_digits(F.col(count)).cast("string").alias("run_name"))


def clean_dataset(entries: DataFrame, labels: DataFrame, lang: str = "en") -> DataFrame:
    """``ast, comments, comments_orig`` of entries in one language.

    ``labels`` has ``id`` and the predicted ``label``, one row per entry id. Rows
    with a missing or empty value are dropped; the kept ids alone travel through
    the semi join, so no text of another language is normalised.
    """
    wanted = labels.filter(F.col("label") == lang).select("id")
    return (
        entries.join(wanted, "id", "left_semi")
        .withColumn("comments_orig", F.col("comments"))
        .withColumn("comments", F.nullif(normalise_comment(F.col("comments")), F.lit("")))
        .na.drop("any", subset=["ast", "comments", "comments_orig"])
        .select("ast", "comments", "comments_orig")
    )


def running_average(
    rows: DataFrame, group: str, order: str, value: str, out: str, chunk_size: int = 1_000_000
) -> DataFrame:
    """Average of ``value`` over all rows of ``group`` up to the current ``order``.

    A window over ``group`` alone would put a dominant group into one task.
    Here a group is cut into chunks of its integer ``order``; rows are summed
    within their chunk, chunk totals within their group, and both sums are added.
    The totals hold one row per chunk, so neither window sees an unbounded group.
    ``order`` must be unique within a group and ``value`` an integer.
    """
    cut = rows.withColumn("_chunk", F.floor(F.col(order) / chunk_size))
    totals = cut.groupBy(group, "_chunk").agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        group,
        "_chunk",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
    )
    within = Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        cut.join(offsets, [group, "_chunk"])
        .withColumn(
            out,
            (F.col("_sum0") + F.sum(value).over(within))
            / (F.col("_n0") + F.count(value).over(within)),
        )
        .drop("_chunk", "_sum0", "_n0")
    )


def random_pick(rows: DataFrame, key: str, seed: int, n: int = 1) -> DataFrame:
    """``n`` pseudo-random rows, the same ones for the same seed and data."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.orderBy(mixed, key).limit(n)


def run_stages(
    rows: DataFrame, column: str, stages: list[tuple[str, Callable[[Column], Column]]]
) -> DataFrame:
    """Apply named column stages in order; they collapse into one projection."""
    for _, stage in stages:
        rows = rows.transform(lambda df, stage=stage: df.withColumn(column, stage(F.col(column))))
    return rows
