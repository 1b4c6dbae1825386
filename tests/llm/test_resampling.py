"""Importance resampling, whitening and line deduplication against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glossmill.llm import importance, line_runs, whitening

# --- importance resampling ---------------------------------------------------------

WORD = re.compile(importance.WORD)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_features(text, width=2):
    words = WORD.findall(lowered(text or ""))
    runs = [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(x.encode()) for x in runs]


def plain_resample(docs, target, percent=25, least=20, buckets=10_000, width=2):
    made = [(k, *plain_features(t, width)) for k, t in docs]
    hist_s = Counter(x % buckets for _, _, f in made for x in f)
    hist_t = Counter(x % buckets for t in target for x in plain_features(t, width)[1])
    s_all, t_all = sum(hist_s.values()), sum(hist_t.values())

    def gain(b):
        return math.floor(
            1000 * math.log((hist_t[b] + 1) * (s_all + buckets) / ((hist_s[b] + 1) * (t_all + buckets)))
        )

    rows = []
    for k, n_words, found in made:
        weight = sum(gain(x % buckets) for x in found) // len(found) if found else 0
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([k, n_words, len(found), weight, score, None])
    asked = [r for r in rows if r[4] is not None and r[1] >= least]
    asked.sort(key=lambda r: (-r[4], r[0], r[2], r[1]))
    for place, row in enumerate(asked[: percent * len(asked) // 100], 1):
        row[5] = place
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


TEXTS = [
    "",
    " ",
    "One word",
    "A_b\x00c\x7fd ÀÉ éa İ ß 12x-3 [k] {z} `q` @",
    "x" * 70_000 + " tail",
    "same words here " * 30,
    "Same Words here " * 30,
    "naïve Ünicode straße 中文 текст " * 25,
]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "eps", "Zeta9", "7", "x-y"]
    texts = TEXTS + [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 60))) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (5, TEXTS[5]), (None, TEXTS[5]), (None, None)]
    return docs, [texts[9], texts[10] + " benchmark words", None, ""]


def test_windows_are_the_runs_of_words(corpus):
    for _, text in corpus[0]:
        if text is not None:
            for width in (1, 2, 3):
                n, sums = importance.windows(text, width)
                want_n, want = plain_features(text, width)
                assert n == want_n and Counter(sums) == Counter(want)


def test_pieces_cut_no_word(monkeypatch):
    text = "ab cd  éf " * 50 + "g" * 100
    whole = importance.windows(text)
    monkeypatch.setattr(importance, "PIECE", 7)
    assert len(list(importance.pieces(text))) > 20 and importance.windows(text) == whole


def test_resampling_equals_the_plain_version(spark, corpus):
    docs, target = corpus
    rows = [(k, t, "clash", 1) for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight string, n_words int").repartition(4)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(df, aim).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert ordered(got.collect()) == ordered(plain_resample(docs, target))


def test_other_widths_and_buckets(spark, corpus):
    docs, target = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, aim, percent=50, least_words=1, buckets=70_001, width=3)
    got = got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert ordered(got) == ordered(plain_resample(docs, target, 50, 1, 70_001, 3))


def test_resampling_of_empty_tables(spark, corpus):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aim = spark.createDataFrame([], "text string")
    assert importance.resample(docs, aim).count() == 0
    some = spark.createDataFrame(corpus[0], "doc_id long, text string")
    got = importance.resample(some, aim).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert ordered(got.collect()) == ordered(plain_resample(corpus[0], []))


# --- whitening ----------------------------------------------------------------------


def whitened(spark, rows, **named):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int")
    return whitening.whiten(df.repartition(3), **named)


def check_whitening(got, rows, k=4):
    """Every column against whole-number and numpy versions."""
    ok = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(256 * c) for c in v] for i, v in ok}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    total = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[n * c - s for c, s in zip(v, total, strict=True)] for v in fit], dtype=object)
    cov = np.array([[float(c) for c in row] for row in centred.T @ centred]) / float(n) ** 3
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == len(ok) * min(k, d)
    signs = {}
    for row in got:
        v, c = x[row["vec_id"]], row["component"] - 1
        assert row["n"] == n
        assert row["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True))
        assert row["explained"] == pytest.approx(values[c] / cov.trace(), rel=1e-9)
        assert row["identity_error"] < 1e-9
        want = float((np.array(v) - np.array(total) / n) @ axes[:, c]) / math.sqrt(values[c])
        if abs(want) > 1e-6:
            signs.setdefault(c, row["whitened"] / want > 0)
            sign = 1 if signs[c] else -1
            assert row["whitened"] == pytest.approx(sign * want, rel=1e-6, abs=1e-9)


def vectors(seed, n, d, spread=1.0, shift=0.0):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, d)) * np.linspace(0.3, 1, d) * spread + shift
    return [(i, [float(c) for c in v], "clash", 1) for i, v in enumerate(made)]


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_whitening_equals_numpy(spark, shift):
    rows = vectors(5, 90, 7, shift=shift)
    rows += [(200 + i, rows[3][1], "copy", 2) for i in range(40)]
    rows += [
        (300, None, "c", 1),
        (301, [], "c", 1),
        (302, [1.0, None, *[1.0] * 5], "c", 1),
        (303, [float("nan")] * 7, "c", 1),
        (304, [float("inf")] + [0.0] * 6, "c", 1),
    ]
    check_whitening(whitened(spark, rows).collect(), rows)


def test_whitening_beyond_sixty_four_bits(spark):
    rows = vectors(6, 40, 5, spread=3e11)
    got = whitened(spark, rows).collect()
    assert max(r["deviation"] for r in got) > 2**63
    check_whitening(got, rows)


def test_squares_of_dimensions_and_pairs():
    u = np.array([[1, -2, 3], [4, 5, -6]], dtype=np.int64)
    got = whitening.pair_squares(u)
    for i in range(3):
        for j in range(i, 3):
            s = u[:, i] if i == j else u[:, i] + u[:, j]
            assert got[i, j] == int((s * s).sum())
    big = u * 2**33
    assert whitening.pair_squares(big)[0, 1] == ((1 - 2) ** 2 + 9**2) * 2**66


def test_whitening_does_not_depend_on_partitions(spark):
    rows = vectors(8, 60, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int")
    one, many = (whitening.whiten(df.repartition(k)).orderBy("vec_id", "component").collect() for k in (1, 9))
    for a, b in zip(one, many, strict=True):
        assert a[:4] == b[:4] and a["whitened"] == pytest.approx(b["whitened"], rel=1e-9)


def test_whitening_without_variance(spark):
    one = whitened(spark, [(1, [0.5, 0.25], "c", 1), (2, [0.5, 0.25], "c", 1)]).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 0, None, None, None)
    ] * 4
    line = whitened(spark, [(i, [float(i), float(i)], "c", 1) for i in range(5)]).collect()
    by = {r["component"]: r for r in line}
    assert by[1]["whitened"] is not None and by[1]["identity_error"] < 1e-9
    assert by[2]["whitened"] is None and by[2]["explained"] == pytest.approx(0, abs=1e-12)


def test_whitening_of_nothing_and_of_mixed_lengths(spark):
    assert whitened(spark, []).count() == 0
    assert whitened(spark, [(1, None, "c", 1)]).count() == 0
    with pytest.raises(ValueError):
        whitened(spark, [(1, [1.0], "c", 1), (2, [1.0, 2.0], "c", 1)])


# --- line deduplication ----------------------------------------------------------------


def plain_lines(docs, least=10):
    def key(line):
        return lowered(line.strip(" \t\n\x0b\f\r"))

    first, holders = {}, {}
    for k, text in docs:
        if k is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= least:
                    first[key(line)] = min(k, first.get(key(line), k))
                    holders.setdefault(key(line), set()).add(k)
    out = []
    for k, text in docs:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if k is None or len(key(x)) < least or len(holders[key(x)]) < 2 or first[key(x)] == k
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((k, len(lines), len(lines) - len(kept), digest))
    return ordered(out)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(11)
    lines = [f"Line number {i} of the common ones" for i in range(30)]
    lines += ["short", "", "  padded line of words \t", "PADDED LINE OF WORDS", "É accent line ÄÖ", "é accent line äö"]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randrange(0, 12)))) for i in range(120)]
    docs += [(200 + i, "the very common line\nown line number %d" % i) for i in range(60)]
    docs += [(300, None), (301, ""), (302, "\n\n"), (303, "\n".join(["repeated in one text"] * 50))]
    docs += [(304, "\x0b\f repeated in one text\r\nnothing else"), (None, "the very common line"), (None, None)]
    docs += [(7, "the very common line\nsecond row of an id"), (7, docs[7][1])]
    return docs


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_equal_the_plain_version(spark, lined, batches, fanout):
    df = spark.createDataFrame([(*x, "clash", 1) for x in lined], "doc_id long, text string, h string, row int")
    got = line_runs.dedup_lines(df.repartition(5), batches=batches, fanout=fanout).collect()
    assert ordered(got) == plain_lines(lined)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.mark.parametrize("hot", [1e-6, 1.0])
def test_frequent_and_other_hashes_agree(spark, lined, monkeypatch, hot):
    monkeypatch.setattr(line_runs, "HOT", hot)
    df = spark.createDataFrame(lined, "doc_id long, text string")
    assert ordered(line_runs.dedup_lines(df).collect()) == plain_lines(lined)


def test_batches_may_arrive_one_by_one(spark):
    """An index that is kept: later batches lose what earlier ones hold."""
    runs = line_runs.Runs(spark, fanout=2)
    gone = []
    for number in range(5):
        rows = [(number * 10 + i, f"line that recurs {i}\nline of batch {number} {i}") for i in range(4)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        lines, _ = line_runs.hashed_lines(df, "doc_id", 10, 1)
        gone.append(line_runs.add_batch(lines.drop("batch"), runs).count())
        runs.compact()
        assert all(len(level) < 2 for level in runs.levels)
    assert gone == [0, 4, 4, 4, 4]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [row.h for name in runs.names() for row in spark.table(name).collect()]
    assert len(held) == len(set(held)) == 4 + 5 * 4
    plan = runs.unseen(lines.select("h"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert "Python" not in plan and "Arrow" not in plan
    runs.forget(runs.names())


def test_kept_texts_and_long_texts(spark):
    long = "\n".join(f"row {i % 70_000} of a long text" for i in range(150_000))
    docs = [(1, "row 5 of a long text\nkeep"), (2, long), (3, "Row 6 of a long text \nb")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_runs.dedup_lines(df, keep_text=True)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[3]["kept_text"] == "b" and rows[1]["kept_text"] == docs[0][1]
    assert ordered([r[:3] + (r["kept_sha256"],) for r in rows.values()]) == plain_lines(docs)


def test_lines_of_an_empty_table(spark):
    assert line_runs.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
