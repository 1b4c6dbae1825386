"""Quality rules whose cutoffs come with a bound on false rejection.

Every rule scores texts, higher is worse, and rejects from a cutoff on. Labelled rows
that pass the base rules are the holdout. In every stratum (language) and rule the
cutoffs of a fixed grid are tested from the mildest to the strictest: a cutoff is safe
if the exact binomial probability of seeing so few good rows rejected, were the true
rate the rule's share of ``RISK``, is at most its share of ``ERROR`` / strata. The
sequence ends at the first cutoff that fails, so it needs no further correction, and
the shares correct for the strata and rules (weighted Bonferroni). With probability 1 - ``ERROR`` no stratum loses
more than ``RISK`` of its good rows. Of the safe cutoffs the one that rejects the most
bad rows per good row lost is used, the mildest among equals; without a safe one that
helps, the rule is off in that stratum. Even with no good row rejected a rule needs
log(share * ERROR / strata) / log(1 - share * RISK) good rows in a stratum: with four
strata 201 for symbols, 835 for marks and repeats, 1,334 for duplicate_lines and capitals.

Null texts have no words. Rows without a language form a stratum. Unlabelled rows and
rows without a key are judged, not learnt from. Equal labelled texts of a stratum count
once, as good if any label says so: copies are no independent draws. Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import map_batches
from glossmill.session import materialise

#: Bound on the share of good rows of a stratum that all rules together reject.
RISK = 0.05
#: Probability with which any bound may fail.
ERROR = 0.05
#: Cutoffs of each rule from the mildest to the strictest.
GRID = (1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
#: The measures that have a rule, with their shares of the risk and of the error.
RULES = {"symbols": 0.5, "marks": 0.15, "repeats": 0.15, "duplicate_lines": 0.1, "capitals": 0.1}
SYMBOLS = re.compile(rb"[#*$%&|<>]")
MARKS = re.compile(rb"[!?|*=_~^\\{}@]")

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "symbols double, duplicate_lines double, repeats double, capitals double, marks double, content long"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, until = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def measures(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()  # at the ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(SYMBOLS.findall(raw))
    lines = [x for x in raw.split(b"\n") if x.split()]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    capitals = sum(map(str.isupper, text)) if text.upper() != text.lower() else 0
    return (
        n,
        chars,
        symbols,
        duplicates,
        repeats,
        symbols / max(chars, 1),
        duplicates / max(len(lines), 1),
        repeats / max(n, 1),
        capitals / max(chars, 1),
        len(MARKS.findall(raw)) / max(chars, 1),
        xxhash.xxh3_64_intdigest(raw) - (1 << 63),
    )


def measured(docs: DataFrame, key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """key, stratum, the base measures, the measures of the rules, base_failed."""
    source = docs.select(
        F.col(key),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(measures, batch.column(2).to_pylist()), strict=True)
        kinds = [pa.int64()] * 5 + [pa.float64()] * 5 + [pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1)]
            + [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
            [key, "stratum", *names],
        )

    kind = source.schema[key].dataType.simpleString()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return map_batches(source, run, f"{key} {kind}, stratum string, {MEASURES}").withColumn(
        "base_failed", failed
    )


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, exactly summed in logarithms."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    total = -math.inf
    for i in range(k + 1):
        term = (
            math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q
        )
        top = max(total, term)
        total = top + math.log(math.exp(total - top) + math.exp(term - top))
    return min(1.0, math.exp(total))


def cutoffs(rows: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff from labelled measures (stratum, quality, rules)."""
    def reached(rule: str):
        """The number of grid points that reject the row."""
        return F.aggregate(
            F.array(*[F.lit(x) for x in GRID]),
            F.lit(0),
            lambda n, cutoff: n + (F.col(rule) >= cutoff).cast("int"),
        )

    hits = [F.struct(F.lit(x).alias("rule"), reached(x).alias("hit")) for x in RULES]
    counts = (
        rows.select("stratum", "quality", F.explode(F.array(*hits)).alias("r"))
        .groupBy("stratum", "quality", "r.rule", "r.hit")
        .agg(F.count("*").alias("n"))
    )
    counts = materialise(counts)
    strata = max(counts.select("stratum").distinct().count(), 1)

    def choose(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        good, bad = (group[group["quality"] == q] for q in (1, 0))
        n, best = int(good["n"].sum()), None
        share = RULES[keys[1]]
        rate, level = share * risk, share * error / strata
        # a row is hit by the strictest ``hit`` cutoffs of the grid
        for step, cutoff in enumerate(GRID):
            need = len(GRID) - step
            lost = int(good.loc[good["hit"] >= need, "n"].sum())
            if not n or tail(lost, n, rate) > level:
                break
            gain = int(bad.loc[bad["hit"] >= need, "n"].sum()) - lost
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, cutoff)
        columns = ["stratum", "rule", "cutoff"]
        return pd.DataFrame([(*keys, best[1])] if best else [], columns=columns)

    # a group has at most 2 * (len(GRID) + 1) rows
    return counts.groupBy("stratum", "rule").applyInPandas(
        choose, "stratum string, rule string, cutoff double"
    )


def once_each(labelled: DataFrame) -> DataFrame:
    """Each text of a stratum once: copies are no independent draws of a binomial variable.

    A text with both labels counts as good, which keeps the bound on good rows lost.
    """
    return labelled.groupBy("stratum", "content").agg(
        F.max("quality").alias("quality"), *[F.max(rule).alias(rule) for rule in RULES]
    )


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """key, the base measures, base_failed, kept of every row."""
    rows = materialise(measured(docs, key))
    known = labels.select(F.col(key), F.col("quality").cast("int").alias("quality"))
    holdout = once_each(rows.where("not base_failed").join(known.where("quality in (0, 1)"), key))
    chosen = (
        cutoffs(holdout, risk, error)
        .groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )
    judged = rows.join(materialise(chosen), "stratum", "left")
    broken = F.lit(False)
    for rule in RULES:
        broken = broken | F.coalesce(F.col(rule) >= F.col("cutoffs")[rule], F.lit(False))
    return judged.select(
        key,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~broken).alias("kept"),
    )
