"""Toxicity: misspelt lexicon terms by Levenshtein automata, and the context they stand in.

1. A bounded sample of labelled rows (``PER_CLASS`` of each class, by hash order of the
   key) is split by hash: two thirds fit the lexicon, one third fits the weights.
2. The lexicon holds words, and stems of words, that follow many different words in
   toxic texts and none or few in clean ones: so many that chance would give less than
   one such word. Counting different predecessors keeps copies from electing terms.
3. The Levenshtein automata of all terms are run together over the trie of the terms:
   a state is a set of (trie node, errors), made when a text first leads there. Words
   that clean texts use are no misspellings.
4. Each hit has a context score: quotation marks around it and words of reporting near
   it turn abuse into quotation. A document's hits, weighted so, and their density go
   into a logistic regression.

Rows whose crc32(key as text) mod 5 is 0 are held out and never learnt from. Scores see
the text alone. Null texts count as empty; an empty text has no hits and gets the score
of none. Without labelled rows of both classes every score is 0. Rows without a key are
scored, not learnt from. Repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import filter_rows, hold, map_batches, texts
from glossmill.session import materialise

#: Labelled rows of each class that are learnt from, at most.
PER_CLASS = 10_000
#: Terms that a task counts together.
MAX_COUNTED = 100_000
#: Lengths of stems.
STEMS = (4, 5, 6)
#: Words on either side of a hit that make its context.
WINDOW = 4
#: Words of reporting.
REPORTING = frozenset(
    "said says quote quoted wrote called word term sagte schrieb zitat wort dit écrit cité mot dijo escribió cita palabra".split()
)
QUOTES = "\"'`«»„“”‘’‹›"
_WORD = re.compile(r"[^\W_](?:[^\W_]|[*@$!#](?=[^\W_]))*")


def errors_allowed(term: str) -> int:
    """Misspellings of short terms are other words."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All terms' Levenshtein automata, determinised along the trie as words come.

    States and moves are made when a word first needs them. Once ``MAX_MOVES`` moves
    are held they are made anew, so a worker's memory has a bound whatever it reads.
    """

    MAX_MOVES = 40_000

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.slack = [0]
        for term in terms:
            node, allowed = 0, errors_allowed(term)
            self.slack[0] = max(self.slack[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], allowed)
            self.term[node] = term
        self.renew()

    def renew(self) -> None:
        """Forget all states but the first."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.made = 0
        self.start = self._state({0: 0})

    def _state(self, errors: dict[int, int]) -> int:
        """The state of these nodes; a missing letter is a step down with an error."""
        todo = list(errors)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = errors[node] + 1
                if e <= self.slack[child] and e < errors.get(child, 99):
                    errors[child] = e
                    todo.append(child)
        key = frozenset(errors.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            found = [
                (e, t) for node, e in errors.items() if (t := self.term[node]) and e <= errors_allowed(t)
            ]
            self.accepts.append((min(found)[1], min(found)[0]) if found else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.slack[node] and e < after.get(node, 99):
                after[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        self.made += 1
        self.moves[state][c] = self._state(after) if after else -1
        return self.moves[state][c]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its errors, and the errors."""
        if self.made > self.MAX_MOVES:
            self.renew()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]


class Lexicon:
    """Terms and stems with their weights, and what clean texts use instead."""

    MAX_MEMO = 100_000

    def __init__(self, terms: dict[str, float], stems: dict[str, float], clean: set[str]):
        self.terms, self.stems, self.clean = terms, stems, clean
        self.automaton = Automaton(sorted(terms))
        self.memo: dict[str, tuple[float, float] | None] = {}

    def look_up(self, word: str) -> tuple[float, float] | None:
        """Weight of a word as the term it is, and as the term it may be meant for."""
        if word in self.terms:
            return self.terms[word], 0.0
        for n in STEMS:
            if word[:n] in self.stems and len(word) >= n:
                return self.stems[word[:n]], 0.0
        if word in self.clean:
            return None
        got = self.automaton.match(word)
        return (0.0, self.terms[got[0]] / (1 + got[1])) if got else None

    def features(self, text: str) -> list[float]:
        """Exact hits, misspelt hits, both per word, quoted share; hits by context score."""
        lower = text.lower()
        words = _WORD.findall(lower)
        memo, hits = self.memo, []
        for word in set(words):
            try:
                got = memo[word]
            except KeyError:
                if len(memo) >= self.MAX_MEMO:
                    memo.clear()
                got = memo[word] = self.look_up(word)
            if got:
                hits.append(word)
        if not hits:
            return [0.0, 0.0, 0.0, 0.0]
        wanted, exact, fuzzy, quoted, n = set(hits), 0.0, 0.0, 0.0, 0
        found = list(_WORD.finditer(lower))
        for i, m in enumerate(found):
            if m[0] in wanted:
                own = self.context(lower, found, i)
                e, f = memo.get(m[0]) or self.look_up(m[0])
                exact, fuzzy, quoted, n = exact + own * e, fuzzy + own * f, quoted + 1 - own, n + 1
        density = 100 * (exact + fuzzy) / len(words)
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(density), quoted / n]

    @staticmethod
    def context(text: str, found: list[re.Match], i: int) -> float:
        """1 for a term spoken by the text itself, near 0 for one it quotes."""
        lo, hi = max(0, i - WINDOW), min(len(found), i + WINDOW + 1)
        before = text[found[lo].start() : found[i].start()]
        behind = text[found[i].end() : found[hi - 1].end() + 1]
        marks = any(c in QUOTES for c in before) + any(c in QUOTES for c in behind)
        reported = sum(m[0] in REPORTING for m in found[lo:hi])
        evidence = 1.5 * (marks == 2) + 1.0 * min(reported, 2)
        return 2 / (1 + math.exp(evidence))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, key: str) -> DataFrame:
    """text, toxic, fit, weight: labelled rows that are not held out, each text once.

    A text with both labels is toxic. A row's weight is the number of usable labels of
    its class for each sampled one, so that the sample's bound does not shift scores.
    """
    usable = (
        labels.select(F.col(key).alias("k"), F.col("toxic").cast("int").alias("toxic"))
        .where("k is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("k").cast("string")) % 5 != 0)
        .groupBy("k")
        .agg(F.max("toxic").alias("toxic"))
    )
    usable = materialise(usable)
    sizes = dict(usable.groupBy("toxic").agg(F.count("*")).collect())
    order = F.xxhash64("k")
    chosen = None
    for value in (0, 1):
        some = usable.where(F.col("toxic") == value).orderBy(order, "k").limit(per_class)
        some = some.withColumn("weight", F.lit(max(1.0, sizes.get(value, 0) / per_class)))
        chosen = some if chosen is None else chosen.union(some)
    # at most 2 * per_class rows, by the limit
    rows = texts(docs, key).join(F.broadcast(chosen), F.col(key) == F.col("k"))
    return materialise(
        rows.where("text <> ''")
        .groupBy("text")
        .agg(F.max(F.struct("toxic", "weight")).alias("of"))
        .select("text", "of.toxic", "of.weight", (F.pmod(F.xxhash64("text"), F.lit(3)) != 0).alias("fit"))
    )


def term_counts(sample: DataFrame) -> DataFrame:
    """Sampled documents by term and class: term, toxic, clean; stems end in ``*``."""

    def rows(counts: dict[int, Counter]) -> pa.RecordBatch:
        every = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(every, pa.string()),
                pa.array([counts[1][x] for x in every], pa.int64()),
                pa.array([counts[0][x] for x in every], pa.int64()),
            ],
            ["term", "toxic", "clean"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words = set(_WORD.findall(text.lower()))
                stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                counts[toxic].update(words | stems)
                if len(counts[0]) + len(counts[1]) > MAX_COUNTED:
                    yield rows(counts)
                    counts = {0: Counter(), 1: Counter()}
        yield rows(counts)

    found = sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def context_counts(sample: DataFrame, terms: set[str]) -> DataFrame:
    """Different predecessors of the terms by class: term, toxic, clean, forms."""
    shared = sample.sparkSession.sparkContext.broadcast(terms)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, wanted = set(), shared.value
        for text, toxic in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            words = _WORD.findall(text.lower())
            for before, word in zip(["", *words], words, strict=False):
                for term in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)):
                    if term in wanted:
                        rows.add((term, before, toxic, word))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
            ["term", "before", "toxic", "word"],
        )

    found = map_batches(
        sample.select("text", "toxic"), run, "term string, before string, toxic long, word string"
    )
    once = found.groupBy("term", "before", "word").agg(
        F.max("toxic").alias("toxic"), F.min("toxic").alias("least")
    )
    return once.groupBy("term").agg(
        F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"),
        F.count(F.when(F.col("least") == 0, 1)).alias("clean"),
        F.countDistinct("word").alias("forms"),
    )


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms and stems of the rows with ``fit``."""
    rows = sample.where("fit")
    sizes = rows.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()
    size = {r["toxic"]: r["n"] for r in sizes}
    if len(size) < 2:
        return Lexicon({}, {}, set())
    share = size[1] / (size[0] + size[1])
    counts = materialise(term_counts(rows))
    vocabulary = counts.count()
    # by chance a term has all of n contexts in toxic texts with probability share ** n
    least = max(3, math.ceil(math.log(max(vocabulary, 2)) / -math.log(share)))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - math.log(share / (1 - share))
    likely = (
        counts.where((F.col("toxic") >= least) & (odds > 2)).toPandas()["term"]  # of the bounded sample
    )
    contexts = context_counts(rows, set(likely)).toPandas()
    contexts["weight"] = np.log((contexts["toxic"] + 0.5) / (contexts["clean"] + 0.5)) - math.log(
        share / (1 - share)
    )
    contexts = contexts[(contexts["toxic"] >= least) & (contexts["weight"] > 2)]
    is_stem = contexts["term"].str.endswith("*")
    words = contexts[~is_stem]
    stems = contexts[is_stem & (contexts["forms"] >= 3)]
    terms = dict(zip(words["term"], words["weight"], strict=True))
    stem_weights = dict(zip(stems["term"].str[:-1], stems["weight"], strict=True))
    automaton_terms = sorted(terms)

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        match = Automaton(automaton_terms).match
        found = [x for x in batch.column(0).to_pylist() if match(x)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["term"])

    # distinct words of the bounded sample, and few of them
    used = counts.where((F.col("clean") > 0) & ~F.endswith("term", F.lit("*"))).select("term")
    clean = set(map_batches(used, near, "term string").toPandas()["term"]) - set(terms)
    return Lexicon(terms, stem_weights, clean)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id"):
    """The lexicon, and the weights of its features with the intercept, or None."""
    sample = labelled_sample(docs, labels, per_class, key)
    lexicon = learn_lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.features(x) for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)],
            ["features", "label", "weight"],
        )

    rows = map_batches(
        sample.where("not fit").select("text", F.col("toxic").cast("double"), "weight"),
        run,
        "features array<double>, label double, weight double",
    ).select(array_to_vector("features").alias("features"), "label", "weight")
    rows = materialise(rows)
    if rows.select("label").distinct().count() < 2:
        return lexicon, None
    model = LogisticRegression(regParam=1e-3, maxIter=50, weightCol="weight").fit(rows)
    return lexicon, [*model.coefficients.toArray().tolist(), model.intercept]


class Scorer:
    """Scores of texts; made where the texts are."""

    def __init__(self, lexicon: Lexicon, weights: list[float] | None):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        *factors, z = self.weights
        z += sum(a * b for a, b in zip(self.lexicon.features(text), factors, strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def score(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id"
) -> DataFrame:
    """key, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(*learn(docs, labels, per_class, key)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = list(map(shared.value.score, batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])

    source = texts(docs, key)
    kind = source.schema[key].dataType.simpleString()
    held = F.crc32(F.col(key).cast("string")) % 5 == 0
    return map_batches(source, run, f"{key} {kind}, score double").select(
        key,
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id"
) -> DataFrame:
    """The rows, with all their columns, whose score is below one half."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(*learn(docs, labels, per_class, key)))

    def keeps(text: str | None) -> bool:
        return shared.value.score(text or "") < 0.5

    return filter_rows(docs, keeps)
