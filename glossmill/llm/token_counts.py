"""Token counts from pre-token frequencies: every distinct pre-token is counted once.

1. Each task sums the pre-tokens of its texts; a grouped sum makes them the distinct
   pre-tokens of the corpus with their frequencies.
2. The tokenizer counts the pieces of each distinct pre-token, once.
3. The ``FREQUENT`` most frequent pre-tokens, a bounded table whatever the corpus,
   reach every task. The frequencies of the others, per document, are joined on the
   pre-token; each is less than 1 / ``FREQUENT`` of all, so none is a hot key.
4. A document's count is the sum of frequency times pieces; ids never exist.

The special token's string in a text is one token and parts the text, as the library
has it. Null texts count as empty; an empty text has no tokens. Repeated rows of one
key get a count each. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import map_batches, texts
from glossmill.llm.pretokens import UnitCache, pattern, units
from glossmill.session import materialise

#: Bound on the pre-tokens that reach every task.
FREQUENT = 250_000
#: Units a task adds up before it hands them on.
TASK_UNITS = 300_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def specials(path: str) -> tuple[str, ...]:
    """Strings of the added tokens; each is one token wherever it stands in a text."""
    added = tokenizer(path).get_added_tokens_decoder().values()
    return tuple(sorted((x.content for x in added), key=len, reverse=True))


def parts(text: str, marks: tuple[str, ...]) -> tuple[list[str], int]:
    """The text between the added tokens, and their number."""
    found, out = 0, [text]
    for mark in marks:
        if mark in text:
            cut = [x.split(mark) for x in out]
            found += sum(len(x) - 1 for x in cut)
            out = [y for x in cut for y in x]
    return out, found


def pretoken_frequencies(docs: DataFrame, path: str) -> DataFrame:
    """Distinct pre-tokens of all texts: token, n."""

    def summed(counts: Counter) -> pa.RecordBatch:
        tokens: Counter = Counter()
        for unit, n in counts.items():
            for token in pattern().findall(unit):
                tokens[token] += n
        return pa.RecordBatch.from_arrays(
            [pa.array(list(tokens), pa.string()), pa.array(list(tokens.values()), pa.int64())],
            ["token", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, counts = specials(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in parts(text, marks)[0]:
                    counts.update(units(part))
                if len(counts) > TASK_UNITS:
                    yield summed(counts)
                    counts = Counter()
        yield summed(counts)

    found = texts(docs).select("text").mapInArrow(run, "token string, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def pieces_of(tokens: DataFrame, path: str) -> DataFrame:
    """The number of pieces of each pre-token: token, n, pieces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoded = tokenizer(path).encode_batch_fast(
            batch.column(0).to_pylist(), add_special_tokens=False
        )
        pieces = pa.array([len(x) for x in encoded], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, pieces], ["token", "n", "pieces"])

    return map_batches(tokens, run, "token string, n long, pieces long")


def common_pieces(known: DataFrame, frequent: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent pre-tokens, ``frequent`` at most, and the others: token, pieces.

    A histogram of the frequencies gives the least one that keeps within the bound.
    """
    bucket = F.floor(F.log2("n") * 8).cast("int")
    sizes = known.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("tokens")).collect()
    held, least = 0, None
    for row in sorted(sizes, reverse=True):
        held += row["tokens"]
        if held > frequent:
            break
        least = row["bucket"]
    inside = F.lit(False) if least is None else bucket >= least
    return known.where(inside).select("token", "pieces"), known.where(~inside).select("token", "pieces")


def count_tokens(
    docs: DataFrame, path: str, key: str = "doc_id", frequent: int = FREQUENT
) -> DataFrame:
    """Tokens of every text: key, n_bytes, n_tokens."""
    spark = docs.sparkSession
    known = materialise(pieces_of(pretoken_frequencies(docs, path), path))
    common, others = common_pieces(known, frequent)
    shared = spark.sparkContext.broadcast(dict(common.toPandas().itertuples(index=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, pieces = specials(path), shared.value

        def resolve(unit: str) -> tuple[int, tuple[str, ...]]:
            base, rare = 0, []
            for token in pattern().findall(unit):
                got = pieces.get(token)
                if got is None:
                    rare.append(token)
                else:
                    base += got
            return base, tuple(rare)

        cache = UnitCache(resolve)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, sizes, rows, tokens, counts = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rest: Counter = Counter()
                between, base = parts(text, marks)
                for part in between:
                    for unit, n in Counter(units(part)).items():
                        sure, rare = cache[unit]
                        base += n * sure
                        for token in rare:
                            rest[token] += n
                # a first row of what is settled; no pre-token mixes \0 and digits
                ids.append(doc)
                ids.extend([None] * len(rest))
                sizes.append(len(text.encode()))
                sizes.extend([None] * len(rest))
                rows.extend([row] * (len(rest) + 1))
                tokens.append(f"\0{row}")
                tokens.extend(rest)
                counts.append(base)
                counts.extend(rest.values())
                row += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.column(0).type),
                    pa.array(sizes, pa.int64()),
                    pa.array(rows, pa.int64()),
                    pa.array(tokens, pa.string()),
                    pa.array(counts, pa.int64()),
                ],
                [key, "n_bytes", "row", "token", "count"],
            )

    source = texts(docs, key)
    kind = source.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes long, row long, token string, count long"
    # settled counts join nothing and count as they are
    joined = source.mapInArrow(run, schema).join(others, "token", "left")
    return (
        joined.groupBy("row")
        .agg(
            F.max(key).alias(key),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("count") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"),
        )
        .select(key, "n_bytes", "n_tokens")
    )
