"""Language identification by character trigrams."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import fits_broadcast, materialise

#: Largest profile that is sent to every task.
MAX_TRIGRAMS = 500_000

#: Log-probabilities are summed as whole numbers of this part, so sums do not depend on order.
UNIT = 1 << 20

TRIGRAMS = r"(?s)(?=(.{3}))"


def trigrams(text: Column) -> Column:
    """All overlapping trigrams of the lower-cased text, in one pass."""
    return F.regexp_extract_all(F.lower(text), F.lit(TRIGRAMS), F.lit(1))


@dataclass(frozen=True)
class LanguageProfile:
    """``scores`` holds one log-probability column per language; ``unseen`` its default.

    Both are in units of 1 / ``UNIT``.
    """

    langs: tuple[str, ...]
    scores: DataFrame
    unseen: dict[str, int]


def fit_language_profile(
    rows: DataFrame, text: Column | str, lang: Column | str, langs: tuple[str, ...]
) -> LanguageProfile:
    """Trigram log-probabilities per language with add-one smoothing.

    One pass over the texts; counts are combined per task, so the shuffle carries
    one row per trigram and task. The totals are one row.
    """
    text, lang = (F.col(c) if isinstance(c, str) else c for c in (text, lang))
    counts = materialise(
        rows.select(lang.alias("_lang"), F.explode(trigrams(text)).alias("trigram"))
        .groupBy("trigram")
        .agg(*[F.count_if(F.col("_lang") == x).alias(f"n_{x}") for x in langs])
    )
    totals = counts.agg(
        F.count(F.lit(1)).alias("v"), *[F.sum(f"n_{x}").alias(f"n_{x}") for x in langs]
    ).first()
    size = {x: float((totals[f"n_{x}"] or 0) + totals["v"]) for x in langs}
    scores = counts.select(
        "trigram",
        *[
            F.round(F.log((F.col(f"n_{x}") + 1) / F.lit(size[x])) * UNIT).cast("long").alias(f"s_{x}")
            for x in langs
        ],
    )
    unseen = {x: -round(log(size[x]) * UNIT) if size[x] else 0 for x in langs}
    return LanguageProfile(langs, scores, unseen)


def identify_language(
    rows: DataFrame, key: str, text: Column | str, profile: LanguageProfile
) -> DataFrame:
    """``key, label`` of the most probable language; NULL for a text without a trigram.

    A profile of checked size is joined inside the task that reads the text, and a
    text's trigrams are summed there before the shuffle by key. A larger profile is
    joined by shuffle, after the trigrams were counted per text.
    """
    text = F.col(text) if isinstance(text, str) else text
    grams = rows.select(key, F.explode_outer(trigrams(text)).alias("trigram"))
    if fits_broadcast(profile.scores, MAX_TRIGRAMS):
        scored = grams.withColumn("_k", F.lit(1)).join(F.broadcast(profile.scores), "trigram", "left")
    else:
        counted = grams.groupBy(key, "trigram").agg(F.count(F.lit(1)).alias("_k"))
        scored = counted.join(profile.scores, "trigram", "left")
    sums = scored.groupBy(key).agg(
        *[
            F.sum(
                F.when(
                    F.col("trigram").isNotNull(),
                    F.col("_k") * F.coalesce(f"s_{x}", F.lit(profile.unseen[x])),
                )
            ).alias(f"s_{x}")
            for x in profile.langs
        ]
    )
    known = F.coalesce(*[F.col(f"s_{x}") for x in profile.langs]).isNotNull()
    best = F.array_max(
        F.array(*[F.struct(F.col(f"s_{x}").alias("s"), F.lit(x).alias("x")) for x in profile.langs])
    )
    return sums.select(key, F.when(known, best["x"]).alias("label"))
