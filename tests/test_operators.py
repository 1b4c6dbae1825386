import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.operators import (
    dataset,
    decoding,
    embedding,
    language,
    spans,
    subwords,
    suggestion,
    vocabulary,
)
from glossmill.plans import inputs
from glossmill.session import checked_broadcast, materialise
from glossmill.sources.readers import read_table


# --- dataset -----------------------------------------------------------------


def test_kept_and_skipped_are_all(spark, sf_dir):
    entries = inputs.length_mix(spark, sf_dir)
    p = dataset.dataset_profile(entries).first()
    assert p.skipped + p.entries == p.observations == entries.count()
    assert dataset.keep_fitting(entries).count() == p.entries > 0
    assert p.skipped > 0


def test_limits_are_inclusive(spark):
    rows = [("w " * 199 + "w", "a"), ("w " * 200 + "w", "a"), ("", "a"), ("c", "t " * 499 + "t"), ("c", "t " * 500 + "t")]
    df = spark.createDataFrame(rows, "comments string, ast string")
    kept = dataset.keep_fitting(df).collect()
    assert [(len(r.comments.split(" ")), len(r.ast.split(" "))) for r in kept] == [(200, 1), (1, 500)]


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_running_average_with_a_hot_group(spark, chunk):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", rng.randrange(100)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, source string, v long")
    got = {r.id: r.avg for r in dataset.running_average(df, "source", "id", "v", "avg", chunk).collect()}
    sums, counts = Counter(), Counter()
    for i, s, v in rows:
        sums[s] += v
        counts[s] += 1
        assert got[i] == sums[s] / counts[s]
    assert len(got) == len(rows)


def test_cap_is_exact_and_ordered(spark):
    df = spark.range(5000).select(
        (F.col("id") * 7919 % 5000).alias("id"), F.lit(0).alias("line"), F.lit(0).alias("character")
    )
    assert sorted(r.id for r in dataset.capped(df.repartition(16), 700).collect()) == list(range(700))
    assert dataset.capped(df, 10_000).count() == 5000


def test_random_pick_is_repeatable(spark):
    df = spark.range(1000)
    first = dataset.random_pick(df, "id", seed=1).first().id
    assert dataset.random_pick(df.repartition(7), "id", seed=1).first().id == first
    assert len({dataset.random_pick(df, "id", seed=s).first().id for s in range(5)}) > 1


def test_clean_dataset_keeps_one_language(spark):
    entries = spark.createDataFrame(
        [(1, "Adds A.", "x"), (2, "Addiert.", "x"), (3, "Adds.", None), (4, "No label", "x")],
        "id int, comments string, ast string",
    )
    labels = spark.createDataFrame([(1, "en"), (2, "de"), (3, "en")], "id int, label string")
    out = dataset.clean_dataset(entries, labels).collect()
    assert [tuple(r) for r in out] == [("x", "<start> adds a . <end>", "Adds A.")]


# --- vocabulary ----------------------------------------------------------------


def test_dense_ids_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    out = vocabulary.dense_ids(df, "k", first=3).collect()
    assert sorted((r.k, r.id) for r in out) == [(i, i + 3) for i in range(5000)]


def test_vocabulary_and_round_trip(spark):
    rows = spark.createDataFrame(
        [(1, ["a", "b", "a"]), (2, ["b", "c", "a"]), (3, []), (4, ["UNK", "z"])], "id int, t array<string>"
    )
    vocab = vocabulary.vocabulary(vocabulary.word_counts(rows, "t", 2))
    assert {(r.token, r.id) for r in vocab.collect()} == {("UNK", 1), ("a", 2), ("b", 3)}
    ids = vocabulary.encode_words(rows, "id", "t", vocab)
    assert {r.id: r.ids for r in ids.collect()} == {1: [2, 3, 2], 2: [3, 1, 2], 3: [], 4: [1, 1]}
    words = vocabulary.decode_words(ids, "id", "ids", vocab)
    assert {r.id: r.tokens for r in words.collect()}[2] == ["b", "UNK", "a"]


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_lookups_of_any_size_agree(spark, max_bytes):
    """Beyond the checked bytes the lookup is a join; nulls and empty rows have a result."""
    data = [(i, [f"w{(i * j) % 17}" for j in range(i % 9)]) for i in range(200)]
    data += [(500, None), (501, []), (502, ["w1", None, "new"])]
    rows = spark.createDataFrame(data, "id int, t array<string>").repartition(5)
    vocab = materialise(vocabulary.vocabulary(vocabulary.word_counts(rows.filter("id < 500"), "t", 2)))
    known = {r.token: r.id for r in vocab.collect()}
    ids = vocabulary.encode_words(rows, "id", "t", vocab, max_bytes)
    got = {r.id: r.ids for r in ids.collect()}
    assert got == {i: [known.get(w, 1) for w in t or []] for i, t in data}
    words = vocabulary.decode_words(ids, "id", "ids", vocab, max_bytes)
    back = {r.id: r.tokens for r in words.collect()}
    assert back == {i: [w if w in known else "UNK" for w in t or []] for i, t in data}
    plan = vocabulary.encode_words(materialise(rows), "id", "t", vocab, max_bytes)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert ("Generate" in plan and "Exchange" in plan) == (max_bytes == 0)


def test_context_pairs_against_brute_force(spark):
    rng = random.Random(1)
    texts = [[rng.choice("abcde") for _ in range(rng.randrange(30))] for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>")
    want = Counter(
        (t[i], t[j]) for t in texts for i in range(len(t)) for j in range(len(t)) if 1 <= abs(i - j) <= 3
    )
    got = {(r.center, r.context): r.n for r in vocabulary.context_pairs(df, "t", 3).collect()}
    assert got == dict(want)


# --- subwords -------------------------------------------------------------------


def greedy(pieces, run):
    out, at = [], 0
    while at < len(run):
        n = max(n for n in range(1, len(run) - at + 1) if run[at : at + n] in pieces)
        out.append(pieces[run[at : at + n]])
        at += n
    return out


def test_subwords_against_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = materialise(subwords.build_subwords(docs, "text", 300))
    pieces = {r.piece: r.id for r in vocab.collect()}
    assert len(pieces) == 300 and sorted(pieces.values()) == list(range(1, 301))
    encoded = docs.select("doc_id", "text", subwords.runs(F.col("text")).alias("runs"),
                          subwords.encode_subwords(vocab, F.col("text")).alias("ids"))
    out = encoded.withColumn("back", subwords.decode_subwords(vocab, F.col("ids"))).collect()
    for r in out:
        assert r.back == r.text
        assert r.ids == [i for run in r.runs for i in greedy(pieces, run)]


@pytest.mark.parametrize("target, widest", [(6, 20), (40, 3), (60, 9), (400, 12)])
def test_pieces_against_brute_force(spark, target, widest):
    rng = random.Random(target)
    texts = [" ".join(rng.choice(["abab", "abcabcabcabc", "xyz", "hello", "help"]) for _ in range(9)) for _ in range(30)]
    counts = Counter()
    for text in texts:
        for run in re.findall(r"\w+|\W+", text):
            counts.update(run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + widest) + 1))
    order = lambda p: (-p[1], p[0])
    single = [p for p in counts.items() if len(p[0]) == 1]
    longer = sorted((p for p in counts.items() if len(p[0]) > 1), key=order)[: max(target - len(single), 0)]
    want = [p for p, _ in sorted(single + longer, key=order)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = subwords.build_subwords(df, "text", target, widest).orderBy("id").collect()
    assert [r.piece for r in got] == want


@pytest.mark.parametrize("target", [30, 120, 700])
def test_long_pieces_enter_the_vocabulary(spark, target, monkeypatch):
    """No length is cut off: runs of 500 brackets, and a sentence without blanks."""
    monkeypatch.setattr(subwords, "CHUNK", 97)  # words are read in many parts
    texts = ["(" * 500 + ")"] * 3 + ["x" + "abcdefghij" * 6] * 40 + ["[" * 33, "word", "wort"] * 5
    counts = Counter()
    for text in texts:
        for run in re.findall(r"\w+|\W+", text):
            counts.update(run[i:j] for i in range(len(run)) for j in range(i + 1, len(run) + 1))
    order = lambda p: (-p[1], p[0])
    single = [p for p in counts.items() if len(p[0]) == 1]
    longer = sorted((p for p in counts.items() if len(p[0]) > 1), key=order)[: max(target - len(single), 0)]
    got = subwords.build_subwords(spark.createDataFrame([(t,) for t in texts], "text string"), "text", target)
    found = [(r.piece, r.n) for r in got.orderBy("id").collect()]
    assert found == sorted(single + longer, key=order)
    assert max(len(p) for p, _ in found) > {30: 12, 120: 20, 700: 400}[target]


def test_a_vocabulary_of_one_text_ends_with_its_longest_word(spark):
    df = spark.createDataFrame([("abcabc",), (None,), ("",)], "text string")
    got = {r.piece for r in subwords.build_subwords(df, "text", 1000).collect()}
    assert got == {"abcabc"[i:j] for i in range(6) for j in range(i + 1, 7)}


def test_unseen_characters_fall_back_to_bytes(spark):
    corpus = spark.createDataFrame([("aa ab",)], "text string")
    vocab = subwords.build_subwords(corpus, "text", 6)
    new = spark.createDataFrame([("ab é\U0001f600",), ("",), (None,)], "text string")
    out = new.select("text", subwords.encode_subwords(vocab, F.col("text")).alias("ids"))
    back = out.select("text", subwords.decode_subwords(vocab, F.col("ids")).alias("back")).collect()
    assert [(r.text, r.back) for r in back][:2] == [("ab é\U0001f600", "ab é\U0001f600"), ("", "")]


def test_training_sequences(spark):
    df = spark.createDataFrame([([5, 6],), ([1, 2, 3, 4, 5],)], "ids array<int>")
    a, b = subwords.training_sequences(df, "ids", 10, 4).collect()
    assert (a.inputs, a.targets) == ([10, 5, 6, 11], [5, 6, 11, 11])
    assert (b.inputs, b.targets) == ([10, 1, 2, 3], [1, 2, 3, None])


# --- language, vectors -------------------------------------------------------------


def test_texts_without_a_trigram_have_no_language(spark):
    rows = [(1, "aaaa", "en"), (2, "bbbb", "de"), (3, "", "en"), (4, None, "de"), (5, "ab", "de"), (6, "xyzw", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profile = language.fit_language_profile(docs.where("doc_id < 3"), "text", "lang", ("en", "de"))
    found = {r.doc_id: r.label for r in language.identify_language(docs, "doc_id", "text", profile).collect()}
    assert found == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: "en"}


def test_language_holdout(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    profile = language.fit_language_profile(train, "text", "lang", inputs.LANGS)
    found = language.identify_language(test, "doc_id", "text", profile).join(test, "doc_id")
    right = found.filter("label = lang").count()
    assert right >= 0.99 * test.count()


def test_large_profiles_are_joined_by_shuffle(spark, sf_dir, monkeypatch):
    docs = read_table(spark, sf_dir, "documents")
    profile = language.fit_language_profile(docs, "text", "lang", inputs.LANGS)
    small = sorted(language.identify_language(docs, "doc_id", "text", profile).collect())
    monkeypatch.setattr(language, "MAX_TRIGRAMS", 10)
    assert sorted(language.identify_language(docs, "doc_id", "text", profile).collect()) == small


def test_language_of_tiny_texts(spark):
    rows = spark.createDataFrame([(1, "the and"), (2, ""), (3, "x")], "id int, text string")
    train = spark.createDataFrame([("the the and", "en"), ("der die das", "de")], "text string, lang string")
    profile = language.fit_language_profile(train, "text", "lang", ("en", "de"))
    out = {r.id: r.label for r in language.identify_language(rows, "id", "text", profile).collect()}
    assert out[1] == "en" and set(out) == {1, 2, 3}


def test_word_vectors(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 20 + [(["rare"],)], "t array<string>")
    vectors = embedding.train_word_vectors(df, F.col("t"), dimensions=8)
    rows = vectors.collect()
    assert {r.word for r in rows} == {"a", "b", "c"} and all(len(r.vector) == 8 for r in rows)
    assert embedding.project(vectors).columns == ["word", "x", "y"]
    none = spark.createDataFrame([(["a"],), (None,), ([],)], "t array<string>")
    assert embedding.train_word_vectors(none, F.col("t"), dimensions=8).count() == 0
    lone = embedding.train_word_vectors(none, F.col("t"), dimensions=3, min_count=1).collect()
    assert [tuple(r) for r in lone] == [("a", [0.0, 0.0, 0.0])]


def low_rank(spark, n, seed, rank=6):
    """A symmetric matrix of low rank and some noise, its entries, its words."""
    rng = np.random.default_rng(seed)
    factor = rng.normal(size=(n, rank)) * np.linspace(4, 1, rank)
    dense = factor @ factor.T + rng.normal(size=(n, n)) * 1e-3
    dense = (dense + dense.T) / 2
    entries = [(i, j, float(dense[i, j])) for i in range(n) for j in range(n)]
    words = spark.createDataFrame([(f"w{i}", 1, i) for i in range(n)], "word string, n long, id long")
    return dense, spark.createDataFrame(entries, "i long, j long, value double"), words


@pytest.mark.parametrize("n, dimensions, block", [(40, 60, 7), (90, 6, 16), (90, 6, 1000)])
def test_vectors_equal_the_dense_factorisation(spark, n, dimensions, block):
    dense, entries, words = low_rank(spark, n, 5)
    got = embedding.factorised(entries, words, dimensions, power=1.0, block=block).collect()
    made = np.array([r.vector for r in sorted(got, key=lambda r: int(r.word[1:]))])
    u, s, _ = np.linalg.svd(dense)
    k = min(dimensions, n)
    want = (u[:, :k] * s[:k]) @ (u[:, :k] * s[:k]).T
    assert made.shape == (n, dimensions) and np.abs(made @ made.T - want).max() < 1e-5 * np.abs(want).max()
    assert (made.sum(axis=0) >= -1e-9 * np.abs(made).sum()).all()


def test_vectors_do_not_depend_on_partitions(spark):
    _, entries, words = low_rank(spark, 80, 9)
    made = []
    for partitions in (2, 16):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = embedding.factorised(entries.repartition(partitions), words, 5, block=11).collect()
        made.append(np.array([r.vector for r in sorted(found, key=lambda r: int(r.word[1:]))]))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert np.abs(np.abs(made[0]) - np.abs(made[1])).max() < 1e-8


def test_log_ratios_against_plain_counts(spark):
    rng = random.Random(2)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randrange(1, 15))] for _ in range(25)]
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>")
    words = embedding.numbered_words(df, F.col("t"), 1)
    name = {r.id: r.word for r in words.collect()}
    pairs = Counter()
    for t in texts:
        for i, a in enumerate(t):
            pairs.update((a, b) for j, b in enumerate(t) if i != j and abs(i - j) <= 2)
    total = Counter()
    for (a, _), n in pairs.items():
        total[a] += n
    want = {
        (a, b): math.log(n * sum(total.values()) / (total[a] * total[b]) / 1.1) for (a, b), n in pairs.items()
    }
    got = embedding.log_ratios(df, F.col("t"), words, window=2, negative=1.1).collect()
    found = {(name[r.i], name[r.j]): r.value for r in got}
    assert found == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_only_small_matrices_reach_the_driver(spark, monkeypatch):
    """The widest thing collected is a basis' width squared, whatever the vocabulary."""
    _, entries, words = low_rank(spark, 120, 3)
    sizes, collect = [], type(entries).collect
    monkeypatch.setattr(type(entries), "collect", lambda self: sizes.append(len(x := collect(self))) or x)
    embedding.factorised(entries, words, 4, block=16)
    assert sizes and max(sizes) <= (4 + embedding.OVERSAMPLE + 1) * (4 + embedding.OVERSAMPLE)


# --- decoding, spans ------------------------------------------------------------------


def test_greedy_decode(spark):
    rows = [(1, 0, t, s) for t, s in ((0, 0.1), (1, 0.7), (2, 0.7))] + [(1, 1, 0, 0.9), (1, 1, 2, 0.2), (1, 2, 2, 1.0)]
    rows += [(2, s, 2, 1.0) for s in range(5)] + [(3, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "example int, step int, token int, score double")
    out = {r.example: r.tokens for r in decoding.greedy_decode(df, end_token=0, limit=3).collect()}
    assert out == {1: [1], 2: [2, 2, 2], 3: []}


@pytest.mark.parametrize("bucket", [4, 1024])
def test_innermost_span_against_brute_force(spark, bucket):
    rng = random.Random(9)
    nodes = [(d, a, a + rng.randrange(0, 40)) for d in range(3) for a in (rng.randrange(100) for _ in range(30))]
    points = [(i, 0 if i % 3 else rng.randrange(4), rng.randrange(150)) for i in range(400)]
    got = spans.innermost_span(
        spark.createDataFrame(points, "cursor_id int, doc_id int, off int"),
        spark.createDataFrame(nodes, "doc_id int, start_off int, end_off int"),
        bucket=bucket,
    ).collect()
    assert len(got) == len(points)
    for r in got:
        around = [(e - s, s) for d, s, e in nodes if d == r.doc_id and s <= r.off < e]
        best = min(around, default=None)
        assert (r.span_start, r.span_end) == ((best[1], best[1] + best[0]) if best else (None, None))


# --- suggestions ------------------------------------------------------------------------


def test_suggestions_against_brute_force(spark):
    rng = random.Random(2)
    shapes = ["A ( B )", "A ( B C )", "A ( C B )", "A ( B B C )", "X ( B )", "A ( D D D D D D D )"]
    rows = [
        (f"f{i:03d}", f"n{i}", ["p"], shapes[0] if i % 3 == 0 else rng.choice(shapes), f"FunctionNamePlaceholder {i} ArgumentNumber0")
        for i in range(60)
    ] + [("g", "alone", [], "Z ( q )", "c")]
    df = spark.createDataFrame(rows, "fid string, name string, params array<string>, ast string, canonical string")
    got = {r.fid: r for r in suggestion.suggest(df).collect()}

    def keys(row):
        toks = row[3].split(" ")
        return (
            row[3], tuple(sorted(toks)), tuple(sorted(set(toks))),
            (toks[0], len(row[2]), len(toks).bit_length()),
        )

    for row in rows:
        want = None
        for level in range(4):
            others = sorted(o[0] for o in rows if o[0] != row[0] and keys(o)[level] == keys(row)[level])
            if others:
                want = (level, others[0])
                break
        have = got.get(row[0])
        assert (want is None) == (have is None)
        if want:
            number = int(want[1][1:])
            assert (have.level, have.partner) == want
            assert have.suggestion == f"{row[1]} {number} p"
    matrix = suggestion.suggestion_matrix(df)
    assert matrix.columns == ["fid", *suggestion.VARIANTS] and matrix.count() == 60


def test_partners_have_a_comment_and_most_stars(spark):
    """Stars decide between equal structures; functions without a comment only ask."""
    rng = random.Random(6)
    rows = [
        (f"f{i:03d}", "n", ["p"], rng.choice(["A ( B )", "A ( C )"]), rng.choice(["", f"text {i}"]), rng.choice([None, 3, 50]))
        for i in range(80)
    ]
    df = spark.createDataFrame(
        rows, "fid string, name string, params array<string>, ast string, canonical string, stars long"
    )
    got = {r.fid: r.partner for r in suggestion.suggest(df).collect()}
    for row in rows:
        others = [o for o in rows if o[0] != row[0] and o[3] == row[3] and o[4]]
        assert got[row[0]] == min(others, key=lambda o: (-(o[5] or 0), o[0]))[0]


def test_a_hot_signature_is_split(spark):
    """A signature of nearly all functions meets its two best in many tasks of the join."""
    df = spark.range(60_000).select(
        F.format_string("f%06d", "id").alias("fid"), F.lit("n").alias("name"), F.array(F.lit("p")).alias("params"),
        F.lit("A ( B )").alias("ast"), F.lit("c").alias("canonical"),
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    found = suggestion.partners(df)
    assert found.count() == 4 * 60_000
    plan = materialise(found)
    sizes = [r.n for r in plan.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    for k in conf:
        spark.conf.unset(k)
    assert len(sizes) > 4 and max(sizes) < 60_000


def test_broadcast_only_within_the_bound(spark):
    big = spark.range(100)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(checked_broadcast(big, 100))
    assert "strategy=broadcast" not in plan(checked_broadcast(big, 99))


def test_pairs_of_numbers_over_many_parts(spark, monkeypatch):
    """Texts longer than a part, nulls that take a position, texts without words."""
    monkeypatch.setattr(vocabulary, "PAIR_TOKENS", 16)
    rng = random.Random(3)
    texts = [[rng.choice([None, 0, 1, 2, 70_000]) for _ in range(rng.randrange(60))] for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, []]], "t array<int>").repartition(3)
    want = Counter(
        (t[i], t[j])
        for t in texts
        for i in range(len(t))
        for j in range(len(t))
        if 1 <= abs(i - j) <= 3 and t[i] is not None and t[j] is not None
    )
    got = vocabulary.context_pairs(df, "t", 3)
    rows = got.collect()
    assert {(r.center, r.context): r.n for r in rows} == dict(want) and len(rows) == len(want)
    # pairs travel packed, by bucket: no aggregate by pair is left in the plan
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "HashAggregate" not in plan


def test_joined_lookup_shuffles_words_once_per_chunk(spark, monkeypatch):
    """Chunks of rows, rows longer than a chunk, nulls; ids as by the lookup that travels."""
    monkeypatch.setattr(vocabulary, "CHUNK", 10)
    rng = random.Random(4)
    data = [(i, [rng.choice(["a", "b", "c", None, f"x{i}"]) for _ in range(rng.randrange(25))]) for i in range(60)]
    rows = spark.createDataFrame([*data, (99, None)], "id int, t array<string>").repartition(3)
    vocab = materialise(vocabulary.vocabulary(vocabulary.word_counts(rows, "t", 3)))
    known = {r.token: r.id for r in vocab.collect()}
    for unknown in (1, None):
        got = vocabulary.encode_words(rows, "id", "t", vocab, 0, unknown)
        assert {r.id: r.ids for r in got.collect()} == {
            i: [known.get(w, unknown) for w in t or []] for i, t in [*data, (99, None)]
        }
    chunks = vocabulary._chunks(rows, "id", F.col("t")).collect()
    assert len(chunks) > 30 and all(len(set(c.words)) == len(c.words) for c in chunks)


@pytest.mark.parametrize("unfolded", [1, 7, 100_000])
def test_subwords_of_a_batch_in_slices(spark, monkeypatch, unfolded):
    """A batch is unfolded in parts; empty texts and rows longer than a part included."""
    monkeypatch.setattr(subwords, "UNFOLDED", unfolded)
    texts = ["", "ab ab, ab", "x" * 40, "né a", "", "a b c d e f g h i j", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    vocab = materialise(subwords.build_subwords(docs, "t", 30))
    ids = docs.select("i", subwords.encode_subwords(vocab, F.coalesce("t", F.lit(""))).alias("ids"))
    back = ids.select("i", subwords.decode_subwords(vocab, F.col("ids")).alias("t")).collect()
    assert {r.i: r.t for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_slices_hold_few_elements(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(subwords, "UNFOLDED", 10)
    batch = pa.array([["a"] * n for n in (3, 4, 0, 25, 0, 9, 1, 1)]).slice(1)
    parts = list(subwords._slices(batch))
    assert sum((p.to_pylist() for p in parts), []) == batch.to_pylist()
    assert all(len(p) == 1 or len(p.flatten()) <= 10 for p in parts) and len(parts) > 2


def test_bases_are_never_broadcast(spark, monkeypatch):
    """A row per word of the vocabulary: its vectors stay off the driver, however small they seem."""
    _, entries, words = low_rank(spark, 60, 3)
    plans, stored = [], embedding.materialise
    monkeypatch.setattr(
        embedding,
        "materialise",
        lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df),
    )
    embedding.factorised(entries, words, 4, block=16, iterations=1)
    joins = [p for p in plans if "vector" in p and "Join" in p]
    assert len(joins) == 2 and not any("Broadcast" in p for p in joins)


def test_a_stored_table_takes_the_codec_asked_for(spark):
    from glossmill.session import materialise

    for codec, df in (("zstd", materialise(spark.range(9), codec="zstd")), ("snappy", materialise(spark.range(9)))):
        assert df.count() == 9
        assert all(f".{codec}." in name for name in df.inputFiles())


def test_a_chunk_of_vectors_travels_once_per_row_block(spark, monkeypatch):
    """Products shuffle packed tiles and chunks of words, not a vector per word and row block."""
    dense, entries, words = low_rank(spark, 90, 4)
    monkeypatch.setattr(embedding, "CHUNK_BYTES", 8 * 16 * 10)  # chunks of 10 words
    products, made = [], embedding.multiplied

    def seen(tiles, basis, width, n, blocks, chunks, kind="<f8"):
        products.append((tiles.count(), tiles.join(basis, "chunk").count(), blocks, chunks))
        return made(tiles, basis, width, n, blocks, chunks, kind)

    monkeypatch.setattr(embedding, "multiplied", seen)
    found = embedding.factorised(entries, words, 6, power=1.0, block=30, iterations=2).collect()
    assert len(products) == 3 and all(p == (27, 27, 3, 9) for p in products)
    got = np.array([r.vector for r in sorted(found, key=lambda r: int(r.word[1:]))])
    u, s, _ = np.linalg.svd(dense)
    want = (u[:, :6] * s[:6]) @ (u[:, :6] * s[:6]).T
    assert np.abs(got @ got.T - want).max() < 1e-5 * np.abs(want).max()


def test_rows_of_any_number_of_entries_are_added(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(embedding, "_ENTRIES", 8)
    places, columns = np.concatenate((np.full(30, 2), rng.integers(0, 9, 60))), rng.integers(0, 12, 90)
    values, vectors, total = rng.normal(size=90), rng.normal(size=(12, 4)), np.ones((9, 4))
    want = np.ones((9, 4))
    np.add.at(want, places, values[:, None] * vectors[columns])
    embedding._added(total, places, columns, values, vectors)
    assert np.allclose(total, want)


def test_counted_pairs_take_few_bytes():
    """Pairs of a frequent word are small steps; ids of any size come back as they were."""
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 1 << 31, (2, 400))
    wide = np.unique(np.minimum(one, two) << 32 | np.maximum(one, two))
    low = np.unique(rng.integers(0, 300, 60_000) << 32 | rng.integers(300, 5_000, 60_000))
    for keys, most in ((np.union1d(wide, low), None), (low, 2.5)):
        n = rng.integers(1, 3, len(keys))
        rows = vocabulary._split(keys, n).to_pylist()
        back = [vocabulary._unpacked(r["size"], r["heads"], r["packed"]) for r in rows]
        found = np.concatenate([k for k, _ in back])
        order = np.argsort(found)
        assert (found[order] == keys).all() and (np.concatenate([m for _, m in back])[order] == n).all()
        assert most is None or sum(len(r["packed"]) for r in rows) < most * len(keys)


def test_signatures_of_odd_structures(spark):
    """Digests of sorted and distinct tokens as the functions of Spark give them; Python does the work."""
    odd = [None, "", " ", "a", "b [x] a  b", "é z Z [y] é a", "f ( [p q] ) f", "x [open", "ß ] [ [a] ss", "a\nb a", "\U0001f600 ￿ a"]
    rows = [(str(i), a, ["p"] * (i % 3) if i % 4 else None) for i, a in enumerate(odd * 120)]
    df = spark.createDataFrame(rows, "fid string, ast string, params array<string>")
    plain = F.regexp_replace("ast", r" \[[^\]]*\]", "")
    tokens = F.sort_array(F.split(plain, " "))
    shape = F.concat_ws(
        ":", F.substring_index(plain, " ", 1), F.size("params").cast("string"), F.length(F.bin(F.size(tokens).cast("long"))).cast("string")
    )
    keys = (F.md5(plain), F.md5(F.array_join(tokens, " ")), F.md5(F.array_join(F.array_distinct(tokens), " ")), shape)
    want = {(r.fid, i): r[i + 1] for r in df.select("fid", *(k.alias(f"k{i}") for i, k in enumerate(keys))).collect() for i in range(4)}
    got = suggestion.signatures(df)
    assert {(r.fid, r.level): r.signature for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "sort_array" not in plan
