"""N-gram Jaccard join: documents whose sets of word n-grams overlap, and their groups.

Exact, by token-combination prefixes. A set's tokens are 64-bit hashes of its shingles;
``x`` can miss at most t(x) = |x| - ceil(threshold * |x|) tokens of a set it links to.

1. Documents with equal sets become one class; its smallest key stands for it.
2. The first t + s tokens by hash order are a class's prefix: linked classes share s
   prefix tokens (the s of one of them). Tokens held by one prefix alone are dropped by
   a count and a bit table of fixed size (which may keep too many, never too few).
3. Classes are first compared with a head per token and size band, and what links is
   joined to components, so that large groups of near copies need no pairs of members.
4. Tokens whose buckets still hold many components (passages that many documents share)
   are frequent, and so is what their texts have in common. Classes with one in their prefix get another prefix: rare tokens first.
   t + s rare tokens are indexed alone. Where a class has t or fewer, frequent tokens follow,
   parted into subclasses by hash; the prefix grows until the tokens beyond one per
   subclass make up for what is missing, and pairs of tokens of one subclass are
   indexed: a linked class shares a rare token or two frequent ones of a subclass. The
   number of subclasses grows with the size, so pairs stay in proportion to the size.
5. A class has a vector of ``PARITY`` bits, each the parity of the tokens dealt to it. Sets
   differ in at least as many tokens as their vectors in bits, so classes whose vectors
   differ too much cannot link: the join under a key leaves them out at once.
6. Classes of different components that meet otherwise are verified on whole sets,
   and all links are joined to components.

The frequent tokens only fix an order of tokens; any order gives the same links.

Null or empty texts have an empty set and link with nothing. Rows without a key get no
component and link nothing. Rows of one key are one document for the groups. Other
columns are not read. Tables between the steps lie in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import ROWS, Bloom, give_back, hold, map_batches, texts
from glossmill.session import checked_broadcast, fits_broadcast, materialise

#: Words of a shingle.
WIDTH = 4
#: Similarity in hundredths from which documents link.
PERCENT = 85
#: Components under one token from which it is frequent.
FREQUENT = 12
#: Classes read whole for each frequent token.
WITNESSES = 24
#: Bits of the tables over tokens and over keys, as powers of two.
TOKEN_BITS, KEY_BITS = 26, 24
#: Bits of a class's parity vector, as 64-bit numbers.
PARITY = 512
#: Bytes of texts whose words are hashed at once.
TOGETHER = 1 << 18
#: Tokens from which a task hands on what it has counted.
COUNTED = 1 << 18
INDEX = "token long, rep long, n long, length long"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


#: Values of the bytes, A-Z as a-z, and which bytes part words.
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of all words, without a loop over them."""
    octets = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~_WHITE[octets], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()))
    within = place - np.repeat(first, sizes)
    powers = np.full(int(sizes.max()), _FACTOR)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = _VALUES[octets[within + np.repeat(starts, sizes)]] * powers[within]
    return starts, mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def shingle_sets(texts_: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text.

    About ``TOGETHER`` bytes of texts are worked out together, as each takes some fifty
    bytes of numbers meanwhile.
    """
    out, held, size = [], [], 0
    for text in texts_:
        held.append(text.encode())
        size += len(held[-1])
        if size >= TOGETHER:
            out += _sets(held, width)
            held, size = [], 0
    return out + _sets(held, width)


def _sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    bounds = np.cumsum([0] + [len(x) + 1 for x in raw])  # a white byte parts the texts
    starts, words = word_hashes(b"\n".join(raw))
    ends = np.searchsorted(starts, bounds)
    runs = np.full(max(len(words) - width + 1, 0), width, np.uint64)
    for k in range(width):
        runs = runs * _FACTOR + words[k : k + len(runs)]
    runs = mixed(runs)
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
            continue
        whole = np.full(min(b - a, 1), b - a, np.uint64)
        for k in range(a, b):
            whole = whole * _FACTOR + words[k]
        out.append(mixed(whole))
    return out


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    return shingle_sets([text], width)[0]


def parity(tokens: np.ndarray) -> list[int]:
    """Of each bin of tokens whether it holds an odd number, packed in 64-bit numbers."""
    bins = (mixed(tokens) % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(bins, minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def misses(n, percent: int = PERCENT):
    """Tokens of a set of n that a linked set may lack, at most."""
    return n - -(-n * percent // 100)


def shared_least(n: int, percent: int = PERCENT) -> int:
    """Tokens that linked sets share at least within prefixes of misses + as many."""
    return 1 + misses(n, percent) * 2 // 5


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, misses(n, percent) + shared_least(n, percent))


def linked(n: int, m: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (n + m - both)


def sketches(
    docs: DataFrame, key: str, width: int, percent: int, frequent: Bloom | None = None
) -> DataFrame:
    """key, n, digest of the set, its prefix, the length of the prefix, parity.

    The prefix is by hash order, or with ``frequent`` by rare tokens first; the length
    is 0 where it has pairs of tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        often = shared.value
        sizes, digests, prefixes, lengths, parities = [], [], [], [], []
        for found in shingle_sets(batch.column(1).to_pylist(), width):
            n = len(found)
            if often is None or not misses(n + 1, percent):
                # sets that may lack no token are in no index
                prefix = found[: prefix_length(n, percent)]
                length = len(prefix)
            else:
                prefix, length = combination_keys(found, often.has(found), percent)
            sizes.append(n)
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            prefixes.append(prefix.tobytes())
            lengths.append(length)
            parities.append(parity(found) if often is None else None)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(prefixes, pa.binary()),
                pa.array(lengths, pa.int64()),
                pa.array(parities, pa.list_(pa.int64())),
            ],
            [key, "n", "digest", "prefix", "length", "parity"],
        )

    source = texts(docs, key)
    kind = source.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n long, digest binary, prefix binary, length long, parity array<long>"
    return map_batches(source, run, schema)


def index_rows(prefixes: DataFrame, keep: Bloom) -> DataFrame:
    """One row per prefix token that the bit table has: token, rep, n, length."""
    shared = prefixes.sparkSession.sparkContext.broadcast(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        tokens = np.concatenate(found)
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        kept = shared.value.has(tokens)
        tokens, rows = tokens[kept], rows[kept]
        others = (batch.column(k).to_numpy(zero_copy_only=False)[rows] for k in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens), *map(pa.array, others)], ["token", "rep", "n", "length"]
        )

    return map_batches(prefixes.select("rep", "n", "length", "prefix"), run, INDEX)


def counted(sets: Iterator[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Tokens with their number in the sets, after every ``most`` tokens: token, n."""

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["token", "n"])

    held, size = [], 0
    for tokens in sets:
        held.append(tokens.view(np.int64))
        size += len(tokens)
        if size >= most:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def repeated_tokens(prefixes: DataFrame) -> DataFrame:
    """Tokens that occur twice or more in the prefixes, combined in each task: token."""

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        raw = (x for batch in batches for x in batch.column(0).to_pylist())
        yield from counted((np.frombuffer(x, np.int64) for x in raw), 1_000_000)

    once = prefixes.select("prefix").mapInArrow(combined, "token long, n long")
    return once.groupBy("token").agg(F.sum("n").alias("n")).where("n > 1").select("token")


def read_sets(
    docs: DataFrame, wanted: DataFrame, key: str, width: int
) -> tuple[DataFrame, Callable[[pa.RecordBatch], tuple[np.ndarray, list[np.ndarray]]]]:
    """Rows of keys and texts; the wanted keys, and a few more, of a batch with their sets."""
    bits = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted, "rep", KEY_BITS))

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(bits.value.has(keys))
        return keys[rows], shingle_sets(batch.column(1).take(pa.array(rows)).to_pylist(), width)

    source = texts(docs.where(F.col(key).isNotNull()), key).withColumn(key, F.col(key).cast("long"))
    return source, read


def sets_of(docs: DataFrame, wanted: DataFrame, key: str, width: int) -> DataFrame:
    """Whole sets of the wanted keys, and of a few more: rep, tokens."""
    source, read = read_sets(docs, wanted, key, width)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sets = read(batch)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "tokens"]
        )

    return map_batches(source, run, "rep long, tokens binary")


def token_counts(docs: DataFrame, wanted: DataFrame, key: str, width: int) -> DataFrame:
    """Tokens of the wanted keys' whole sets, and of a few more, with their number: token, n.

    The task that reads a text counts its tokens: sets do not go through the JVM to a
    second Python worker, which would stay beside the first one for the later stages.
    """
    source, read = read_sets(docs, wanted, key, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        slices = (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS))
        yield from counted((tokens for x in slices for tokens in read(x)[1]), COUNTED)
        give_back()

    counts = source.mapInArrow(run, "token long, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def verified(docs: DataFrame, pairs: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of keys those whose whole sets link; materialised.

    Both sets of a pair are sent to one place; a key of many pairs is no hot key, as
    rows are dealt by pair.
    """
    pairs = materialise(pairs.distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"), "a", "b")
    sets = sets_of(docs, ends, key, width)
    # a row for each set and pair; the ends are written down narrow, their number is checked
    sent = sets.join(checked_broadcast(materialise(ends)), "rep").select("a", "b", "rep", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        pair, first, found = None, [], []
        for batch in batches:
            for a, b, rep, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (a, b) != pair:
                    pair, first = (a, b), []
                tokens = np.frombuffer(raw, np.uint64)
                if rep == a:
                    # several sets only where rows of one key differ
                    first.append(tokens)
                elif any(linked_sets(x, tokens, percent) for x in first):
                    found.append(pair)
            if len(found) > 10_000:
                yield pair_rows(found)
                found = []
        yield pair_rows(found)

    dealt = sent.repartition(F.col("a"), F.col("b"))
    # the set of a comes first: a < b
    return materialise(
        dealt.sortWithinPartitions("a", "b", "rep").mapInArrow(run, "a long, b long").distinct()
    )


def linked_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return linked(len(x), len(y), both, percent)


def pair_rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """rep, comp: the smallest key of each linked key's component.

    Alternates large-star and small-star steps over the links until nothing changes;
    a node's least neighbour is a grouped minimum that is joined back, so a hub's links
    are never in one task.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges, before = materialise(edges.distinct()), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = materialise(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
        )
        edges = materialise(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
        before = state


def with_components(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows by rep with the column comp: its component so far, or itself."""
    if found is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(found, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def may_link(x: str, y: str, percent: int) -> Column:
    """False only where parities prove that sets of sizes ``n`` differ too much to link.

    Linked sets differ in (100 - percent) / (100 + percent) of their sizes' sum at most.
    """
    odd = sum(
        F.bit_count(F.get(f"parity{x}", k).bitwiseXOR(F.get(f"parity{y}", k)))
        for k in range(PARITY // 64)
    )
    sizes = F.col(f"size{x}") + F.col(f"size{y}")
    return F.coalesce((100 + percent) * odd <= (100 - percent) * sizes, F.lit(True))


def star_pairs(index: DataFrame, found: DataFrame | None, percent: int, smallest: bool) -> DataFrame:
    """Each class with the head it shares most tokens with, in another component: a, b.

    A head is the least (or largest) key of a token and size band; sizes of a band
    differ by less than the threshold, and heads of the band below may link too. Pairs
    that share few tokens are left to the exact step.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).alias("band")
    rows = index.select("token", "rep", "length", band)
    pick = F.min if smallest else F.max
    heads = rows.groupBy("token", "band").agg(pick("rep").alias("head"))
    near = heads.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "head")
    met = (
        rows.join(near, ["token", "band"])
        .where("rep <> head")
        .groupBy("rep", "head", "length")
        .agg(F.count("*").alias("shared"))
        .where("5 * shared >= length")
    )
    own = with_components(met, found).withColumnRenamed("comp", "own")
    if found is None:
        other = own.withColumn("other", F.col("head"))
    else:
        seen = found.select(F.col("rep").alias("head"), F.col("comp").alias("other"))
        other = own.join(seen, "head", "left").withColumn("other", F.coalesce("other", "head"))
    order = Window.partitionBy("rep").orderBy(F.desc("shared"), "head")
    best = other.where("own <> other").withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"))


def subclasses(level: int) -> int:
    return max(1, (1 << level) // 16)


def combination_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Keys of a set with frequent tokens: rare tokens, then pairs of frequent ones.

    With them the length of the prefix of rare tokens, or 0 if there are pairs.
    """
    n = len(tokens)
    rare, often = tokens[~frequent], tokens[frequent]
    keys = [rare[: prefix_length(n, percent)]]
    length = len(keys[0])
    need = misses(n, percent) + 1 - length
    if need > 0:
        length = 0
        # linked sets differ in size by less than a factor of two: they meet on a level
        low = -(-n * percent // 100)
        for level in sorted({n.bit_length() - 1, low.bit_length() - 1}):
            parts = subclasses(level)
            part = (often % np.uint64(parts)).astype(np.int64)
            # tokens beyond the first of their subclass, along the order
            order = np.argsort(part, kind="stable")
            first = np.ones(len(often), bool)
            first[order[1:]] = part[order[1:]] != part[order[:-1]]
            gained = np.cumsum(~first)
            # enough ones always exist: see the sizes that are indexed at all
            stop = int(np.searchsorted(gained, need)) + 1
            taken, part = often[:stop], part[:stop]
            for p in np.unique(part):
                own = taken[part == p]
                i, j = np.triu_indices(len(own), 1)
                keys.append(mixed(own[i] * _FACTOR + own[j] + np.uint64(level + 1 << 32)))
    return np.concatenate(keys), length


def cross_pairs(index: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Classes of different components that share enough of their prefixes: a, b.

    The prefix that ends first lacks no shared token of the other, so linked classes
    share its length less what may miss; classes indexed by pairs share one key.
    """
    least = F.col("length") - (F.col("n") - F.ceil(F.col("n") * percent / 100))
    rows = index.join(parities, "rep").select(
        "token", "rep", "n", "comp", F.greatest(least, F.lit(1)).alias("least"), "size", "parity"
    )
    x, y = (rows.select("token", *(F.col(c).alias(c + k) for c in rows.columns[1:])) for k in "xy")
    fits = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    met = x.join(y, "token").where("repx < repy and compx <> compy").where(
        fits & may_link("x", "y", percent)
    )
    return (
        met.groupBy(
            F.col("repx").alias("a"), F.col("repy").alias("b"), F.least("leastx", "leasty").alias("least")
        )
        .agg(F.count("*").alias("shared"))
        .where("shared >= least")
        .select("a", "b")
    )


def mixed_buckets(index: DataFrame) -> DataFrame:
    """Tokens with classes of several components: token, comps."""
    once = index.groupBy("token", "comp").agg(F.count("*").alias("k"))
    return once.groupBy("token").agg(F.count("*").alias("comps")).where("comps > 1")


def indexed(prefixes: DataFrame) -> DataFrame:
    """The rows of tokens that more than one prefix may have; materialised."""
    repeated = materialise(repeated_tokens(prefixes))
    return materialise(index_rows(prefixes, Bloom.of(repeated, "token", TOKEN_BITS)))


class Classes:
    """One document for each set that can link with another set."""

    def __init__(self, docs: DataFrame, key: str, width: int, percent: int):
        self.docs, self.key, self.width, self.percent = docs, key, width, percent
        self.base = materialise(sketches(docs, key, width, percent))
        self.usable = (F.col("n") > 0) & F.col(key).isNotNull()
        # sets that may lack no token link with equal sets alone, which are one class
        least = next(n for n in range(1, 1000) if misses(n + 1, percent) > 0)
        self.indexed = self.usable & (F.col("n") >= least)
        self.classes = materialise(
            self.base.where(self.usable).groupBy("digest").agg(F.min(key).cast("long").alias("rep"))
        )
        self.copies = materialise(
            self.base.where(self.indexed)
            .select(key, "digest")
            .join(self.classes, "digest")
            .where(F.col(key) != F.col("rep"))
            .select(key, "digest")
        )
        self.few = fits_broadcast(self.copies)
        # rows that repeat a key may have several sets; their pairs are all verified
        one = F.min("digest") == F.max("digest")
        self.parities = materialise(
            self.base.where(self.indexed)
            .join(self.classes.select(F.col("rep").alias(key)), key, "left_semi")
            .groupBy(F.col(key).cast("long").alias("rep"))
            .agg(F.max("n").alias("size"), F.when(one, F.max("parity")).alias("parity"))
        )

    def prefixes(self, frequent: Bloom | None = None) -> DataFrame:
        """rep, n, length, prefix; with ``frequent`` in the order of rare tokens first."""
        rows = self.base
        if frequent is not None:
            rows = sketches(self.docs, self.key, self.width, self.percent, frequent)
        copies = F.broadcast(self.copies) if self.few else self.copies
        found = (
            rows.where(self.indexed)
            .join(copies, [self.key, "digest"], "left_anti")
            .select(F.col(self.key).cast("long").alias("rep"), "n", "length", "prefix")
        )
        return found if self.few and frequent is None else materialise(found)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        for end in ("a", "b"):
            columns = [F.col(c).alias(new) for c, new in (("rep", end), ("size", f"size{end}"), ("parity", f"parity{end}"))]
            pairs = pairs.join(self.parities.select(columns), end)
        pairs = pairs.where(may_link("a", "b", self.percent)).select("a", "b")
        return verified(self.docs, pairs, self.key, self.width, self.percent)


def widened(own: Classes, located: DataFrame, often: DataFrame) -> DataFrame:
    """More tokens of the texts that hold frequent ones: token.

    Passages lie partly outside the prefixes. Of each frequent token's classes the
    ``WITNESSES`` first by a hash of the key, which are much the same for all tokens of a
    passage, are read whole; what several of them hold is taken for frequent too. This
    only shapes the order of tokens, so it may be incomplete.
    """
    first = Window.partitionBy("token").orderBy(F.xxhash64("rep"))
    chosen = (
        located.join(often, "token")
        .withColumn("k", F.row_number().over(first))
        .where(F.col("k") <= WITNESSES)
        .select("rep")
        .distinct()
    )
    counts = token_counts(own.docs, materialise(chosen), own.key, own.width)
    # written here, where Arrow batches are small: the texts of 10,000 rows are not
    return materialise(counts.where("n > 2").select("token"))


def links_between(own: Classes, frequent: int = FREQUENT) -> DataFrame:
    """Links that join the classes into their components: a, b."""
    percent = own.percent
    index = indexed(own.prefixes())
    links, found = None, None
    for smallest in (True, False):
        new = own.verified(star_pairs(index, found, percent, smallest))
        links = new if links is None else links.union(new)
        found = components(links)
    located = materialise(with_components(index, found))
    often = mixed_buckets(located).where(F.col("comps") >= frequent)
    often = materialise(often.select("token"))
    if not often.isEmpty():
        common = Bloom.of(often.union(widened(own, located, often)), "token", KEY_BITS)
        located = materialise(with_components(indexed(own.prefixes(common)), found))
    meeting = located.join(mixed_buckets(located).select("token"), "token")
    return links.union(own.verified(cross_pairs(meeting, own.parities, percent)))


def groups(
    docs: DataFrame, key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    own = Classes(docs, key, width, percent)
    located = with_components(own.classes, components(links_between(own)))
    base = own.base
    component = F.when(F.col(key).isNotNull(), F.coalesce("comp", F.col(key)))
    return base.select(key, "n", "digest").join(located, "digest", "left").select(
        key, F.col("n").alias("n_shingles"), component.alias("component_id")
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """The document of each group whose key is the smallest; rows without a key stay.

    Rows that repeat a key are one document: one of them stays.
    """
    found = groups(docs, key, width, percent).where(F.col(key).isNotNull())
    rows = found.groupBy(key).agg(
        F.count("*").alias("n"), F.max(F.col(key) == F.col("component_id")).alias("first")
    )
    rows = materialise(rows.where("n > 1 or not first"))
    # the dropped keys are written, so their size decides how they are joined
    kept = docs.join(materialise(rows.where("not first").select(key)), key, "left_anti").select(docs.columns)
    repeated = materialise(rows.where("first").select(key))
    if repeated.isEmpty():
        return kept
    several = kept.join(repeated, key, "left_semi").dropDuplicates([key])
    return (
        kept.join(repeated, key, "left_anti")
        .select(docs.columns)
        .unionByName(several.select(docs.columns))
    )
