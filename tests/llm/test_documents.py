"""Joins, tilings, scores, rules, secrets and the pipeline against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import ngram_join, quality, secrets, tiling, toxicity

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def words(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(text, n, rng=RNG):
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(VOCABULARY)
    return out


def corpus():
    """Copies, near copies, shared passages, short and odd texts."""
    rng, out = random.Random(5), []
    passage = words(40, rng)
    for size in (6, 7, 9, 12, 30, 80, 200):
        base = words(size, rng)
        out += [base, base] + [edited(base, k, rng) for k in (0, 1, 1, 1, 2, 3, 5)]
        out += [base + words(max(1, size // 10), rng), base[: -max(1, size // 12)]]
    out += [passage + words(k, rng) for k in (0, 1, 2, 3, 5, 8, 13, 40, 60) for _ in range(4)]
    out += [words(3, rng), ["a"], ["a"], ["A"], [], words(4, rng)]
    return [" ".join(x) for x in out]


def plain_groups(texts, width, percent):
    sets = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        whole = {tuple(w)} if w else set()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or whole)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent", "frequent"), [(4, 85, 12), (4, 85, 2), (5, 80, 2)])
def test_ngram_join(spark, monkeypatch, width, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join.links_between, "__defaults__", (frequent,))
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.groups(df, width=width, percent=percent).collect()))
    assert got == plain_groups(texts, width, percent)


def test_combination_keys_meet_for_linked_sets():
    """Any two sets over the threshold share a key, whatever tokens are frequent."""
    rng = np.random.default_rng(4)
    for n in (6, 7, 13, 20, 60, 130, 700):
        for share in (0.0, 0.5, 0.95, 1.0):
            pool = np.unique(ngram_join.mixed(rng.integers(1, 2**63, 3 * n).astype(np.uint64)))
            often = set(pool[rng.random(len(pool)) < share].tolist())
            for _ in range(20):
                x = np.sort(rng.choice(pool, n, replace=False))
                gone = rng.integers(0, ngram_join.misses(n) + 1)
                rest = np.setdiff1d(pool, x)
                y = np.concatenate([rng.permutation(x)[gone:], rest[: rng.integers(0, gone + 1)]])
                y = np.sort(y)
                if not ngram_join.linked(len(x), len(y), len(np.intersect1d(x, y))):
                    continue
                if len(x) == len(y) and (x == y).all():
                    continue
                keys = [
                    ngram_join.combination_keys(z, np.array([t in often for t in z.tolist()]), 85)[0]
                    for z in (x, y)
                ]
                assert np.intersect1d(*keys).size


def test_ngram_join_odd_rows(spark):
    rows = [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (2, None, 3)]
    rows += [(4, " \n", 4), (None, "a b c d e f", 5), (9, "x " * 50_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(map(tuple, ngram_join.groups(df).collect()), key=str)
    want = [(3, 3, 1), (1, 3, 1), (1, 3, 1), (2, 0, 2), (4, 0, 4), (None, 3, None), (9, 1, 9)]
    assert got == sorted(want, key=str)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 9]
    assert ngram_join.groups(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150)]
    found = ngram_join.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.rep: r.comp for r in found.collect()} == {i: 0 for i in range(1, 61)} | {200: 100, 150: 100}


def plain_tiles(item, doc, size):
    """Greedy tiles by trying every pair of places."""
    used, taken, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while (
                i + n < len(item)
                and j + n < len(doc)
                and item[i + n] == doc[j + n]
                and i + n not in used
                and j + n not in taken
            ):
                n += 1
            if n > best[0]:
                best = (n, i, j)
        n, i, j = best
        if n < size:
            return out
        used |= set(range(i, i + n))
        taken |= set(range(j, j + n))
        out.append(best)


def test_tiles_agree_with_plain_tiling():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        doc = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        got, want = tiling.tiles(item, doc, 3), plain_tiles(item, doc, 3)
        assert sum(x[0] for x in got) == sum(x[0] for x in want)


def test_leaks(spark):
    rng = random.Random(8)
    item, other = words(40, rng), words(30, rng)
    noise = lambda n: [f"n{rng.randrange(9999)}" for _ in range(n)]
    docs = [
        (1, " ".join(noise(50) + item + noise(50)), 0),
        (2, " ".join(noise(9) + item[20:] + noise(9) + item[:20] + noise(9)).upper(), 0),
        (3, ", ".join(noise(9) + item[:10] + noise(9)), 0),
        (4, None, 0),
        (5, "", 0),
        (6, "say hello world! again", 0),
        (6, "say hello world! again", 0),
        (None, " ".join(other), 0),
        (7, " ".join(noise(100_000) + other), 0),
    ]
    bench = [(10, " ".join(item), "x"), (11, " ".join(other), "x"), (12, "Hello, World", "x"), (13, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    items = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    want = [(1, 10), (2, 10), (6, 12), (6, 12), (7, 11), (None, 11)]
    for block_words in (1, 2_000_000):
        got = [(r.doc_id, r.item_id) for r in tiling.leaks(df, items, block_words=block_words).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        clean = tiling.without_leaks(df, items, block_words=block_words)
        assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    assert tiling.leaks(df, items.limit(0)).count() == 0
    assert tiling.leaks(df.limit(0), items).count() == 0
    assert tiling.without_leaks(df, items.limit(0)).count() == len(docs)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_agrees_with_edit_distance():
    rng = random.Random(1)
    terms = ["stupid", "idiot", "loser", "disgusting", "scum", "idiotic"]
    automaton = toxicity.Automaton(terms)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "s", "i", "do"])
        word = "".join(word)
        near = [distance(word, t) for t in terms if distance(word, t) <= toxicity.errors_allowed(t)]
        got = automaton.match(word)
        assert (got is None) == (not near)
        assert got is None or (got[1] == min(near) and distance(word, got[0]) == got[1])


def test_context_separates_quotation():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {}, set())
    abuse = lexicon.features("you are such an idiot my friend")
    quoted = lexicon.features('the paper wrote "idiot" about it')
    assert quoted[0] < abuse[0] and quoted[3] > abuse[3]
    assert lexicon.features("you idi0t you")[1] > 0
    assert lexicon.features("") == [0.0] * 4


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["stupid", "idiot", "loser", "disgusting"]
    data, known = [], []
    for i in range(1200):
        text = words(rng.randrange(20, 60), rng)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        data.append((i, " ".join(text), "en", 0.5))
        known.append((i, 1, int(toxic)))
    data += [(5000, "you are a stuppid idiiot", "en", 0.1), (5001, None, None, 0.1), (None, "", None, 0.1)]
    known += [(None, 1, 1), (7, None, None), (99_999, 1, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert len(got) == len(data)
    held = [i for i in range(1200) if got[i].held_out]
    assert 150 < len(held) < 350
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert got[5000].predicted == 1 and got[5001].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    left = toxicity.without_toxic(df, labels)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {k for k, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), labels).count() == 0


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    inside = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = re.findall(r"[#*$%&|<>]", text)
    return len(w), sum(map(len, w)), len(symbols), len(lines) - len(set(lines)), len(inside)


def test_measures_agree_with_plain_ones():
    rng = random.Random(3)
    parts = ["a", "b", "é#", "c|", "\n", " ", " ", "\x0b", "  ", "x*", "\x1c"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40)))
        assert quality.measures(text)[:5] == plain_measures(text)


def test_tail_is_the_binomial_sum():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 40, 0.05), (40, 40, 0.5), (7, 20, 0.3)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.tail(k, n, p) == pytest.approx(want)


def test_readme_states_the_least_good_rows_of_each_rule():
    readme = (Path(__file__).parents[2] / "README.md").read_text()
    for strata in (1, 2, 4, 8):
        least = []
        for rule in ("symbols", "marks", "duplicate_lines"):
            rate, level = quality.RULES[rule] * quality.RISK, quality.RULES[rule] * quality.ERROR / strata
            least.append(next(n for n in range(1, 9999) if quality.tail(0, n, rate) <= level))
        assert f"| {strata} | {least[0]} | {least[1]} | {least[2]} |" in readme


def test_quality_rules(spark):
    rng = random.Random(9)
    data, known = [], []
    for i in range(3000):
        text = words(80, rng)
        junk = i % 5 == 0
        if junk:
            text = [x + "###" for x in text]
        data.append((i, " ".join(text), "en" if i % 2 else None, 0))
        known.append((i, int(not junk), 0))
    data += [(9000, None, "xx", 0), (None, " ".join(words(60, rng)), "xx", 0), (9001, "a b c " * 90, "xx", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert len(got) == len(data)
    assert all(got[i].kept == (i % 5 != 0) for i in range(3000))
    assert got[9000].base_failed and not got[9000].kept and got[None].kept and got[9001].base_failed
    # without labels nothing but the base rules rejects
    assert all(r.kept != r.base_failed for r in quality.judge(df, labels.limit(0)).collect())
    assert quality.judge(df.limit(0), labels).count() == 0


def plain_base(text):
    either = "|".join("".join(f"[{c}{c.upper()}]" for c in x) for x in ("password", "passwd", "secret", "token"))
    key = "[aA][pP][iI]_?[kK][eE][yY]"
    assign = rf"""(?:{either}|{key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_scan(spark):
    rng = random.Random(13)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    strong = "".join(rng.choice(b64) for _ in range(60))
    parts = ["password", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "é", "\n", "AKIA"]
    parts += ["ABCDEF0123456789", "0123456789abcdef", "abc", "wxyz.-_", "AKIAAKIA", "𝄞"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", None, f"é key {strong} end", "token=password:abcdefghijklmnop", "z" * 40]
    texts += ["word " * 60_000 + "secret: abcdefghijklmnop", "thisisanordinarysentencewithnoblanksinsideit"]
    rows = [(i, x, 0, "c") for i, x in enumerate(texts)] + [(None, "AKIA" + "A" * 16, 0, "c"), (0, texts[0], 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")
    got = secrets.scan(df).select("row.doc_id", "base", "spans").collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(texts):
        assert [(x.s, x.k, x.e) for x in by_id[i].base] == plain_base(text or "")
    at = by_id[302].spans
    assert [(x.s, x.k, x.e) for x in at] == [(6, 3, 66)]
    assert not by_id[304].spans and not by_id[306].spans
    masked = {r.doc_id: r for r in secrets.without_secrets(df).collect()}
    assert masked[302].text == "é key [SECRET] end" and masked[302].n_chars == len(masked[302].text)
    assert masked[301].text is None and masked[304].text == texts[304]
    for i, text in enumerate(texts[:300]):
        want, at = "", 0
        for s, _, e in plain_base(text):
            if s >= at:
                want += text[at:s] + "[SECRET]"
            at = max(at, e)
        if len(by_id[i].spans) == len(by_id[i].base) and plain_base(text):
            assert masked[i].text == want + text[at:]
    assert secrets.scan(df.limit(0)).count() == 0


def test_long_random_tokens_of_each_alphabet_are_found(spark):
    rng = random.Random(17)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper = lower.upper()
    alphabets = [lower, lower + "234567", digits + lower[:22], digits + "abcdefghjkmnpqrstvwxyz", digits + lower]
    alphabets += [x.upper() for x in alphabets] + [upper + lower, upper + lower + digits]
    alphabets += [upper + lower + digits + "+/", upper + lower + digits + "-_"]
    alphabets.append("123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz")
    tokens = ["".join(rng.choice(x) for _ in range(n)) for x in alphabets for n in (64, 400, 3000)]
    tokens.append("".join(rng.choice("0123456789ABCDEF") for _ in range(400)))
    words = ["thisisanordinarysentencewithnoblanksinsideit", "AbstractBeanFactoryAwareAdvisingPostProcessor"]
    df = spark.createDataFrame(list(enumerate([f"x {t}, y" for t in tokens + words])), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.scan(df).select("row.doc_id", "spans").collect()}
    missed = [t[:64] for i, t in enumerate(tokens) if got[i] != [(2, 3, 2 + len(t))]]
    assert not missed
    assert not got[len(tokens)] and not got[len(tokens) + 1]


def test_rest_of_a_run_outside_base_spans_is_tested(spark):
    rng = random.Random(23)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(2)]
    a, b = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(60)) for _ in "ab")
    texts = [f"{hexes[0]}-{a}", f"x {a}_{hexes[0]}.", f"{a}-{hexes[0]}--{b}-{hexes[1]}-zz", f"{hexes[0]} {hexes[1]}"]
    texts += [f"token={hexes[0]}-{a}", f"of_an_ordinary_production_environment_password={hexes[0]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.scan(df).select("row.doc_id", "spans").collect()}
    assert {(0, 2, 32), (33, 3, 93)} <= set(got[0]) and {(2, 3, 62), (63, 2, 95)} <= set(got[1])
    assert {(0, 3, 60), (61, 2, 93), (95, 3, 155), (156, 2, 188)} <= set(got[2])
    assert all(k != 3 for i in (3, 4, 5) for _, k, _ in got[i])
    masked = {r.doc_id: r.text for r in secrets.without_secrets(df).collect()}
    for i in range(3):
        assert a not in masked[i] and b not in masked[i] and "[SECRET]" in masked[i]


def test_secret_digest_is_of_the_joined_spans(spark):
    df = spark.createDataFrame([(1, "x token=abcdefabcdefabcdef")], "doc_id long, text string")
    row = secrets.scan(df).select(
        secrets.written(F.col("base")).alias("w"), F.sha2(secrets.written(F.col("base")), 256).alias("d")
    ).first()
    assert row.w == "assign:2:26,hex:8:26"
    assert row.d == hashlib.sha256(row.w.encode()).hexdigest()


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        after = stage(spark, docs, sf_dir)
        if name == "bpe":
            assert {r.doc_id for r in after.collect()} == set(before)
            return
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert ids == {r.doc_id for r in scores.where("predicted = 0").collect()}
        if name == "ngram_join":
            keys = sorted(before)
            groups = plain_groups([before[k] for k in keys], 5, 80)
            assert ids == {keys[i] for i, _, root in groups if i == root}
        if name == "decontamination":
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert ids == set(before) - {r.doc_id for r in tiling.leaks(docs, items).collect()}
        if name == "secrets":
            assert ids == set(before)
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)


def test_many_secrets_in_one_text_take_time_in_proportion(spark):
    """Places and masks of thousands of matches, far into a text, agree with plain ones."""
    rng = random.Random(8)
    took = []
    for n in (2_000, 16_000):
        words = ["".join(rng.choices("0123456789abcdef", k=rng.choice([12, 16, 40]))) + rng.choice([" é ", "\n", "-"]) for _ in range(n)]
        text = "".join(words)
        df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
        start = time.perf_counter()
        row = secrets.scan(df).select("base", "spans").first()
        masked = secrets.without_secrets(df).first().text
        took.append(time.perf_counter() - start)
        want = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
        assert [tuple(x) for x in row.base] == want
        out, at = [], 0
        for s, _, e in map(tuple, row.spans):
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        assert masked == "".join(out) + text[at:]
    assert took[1] < 8 * took[0] + 10


def test_copies_of_labelled_texts_count_once(spark):
    """A thousand copies of one good text prove no more than the text itself."""
    good = " ".join(f"word{i}" for i in range(80))
    bad = good + " #" * 40
    docs = [(i, good, "en") for i in range(1500)] + [(5000 + i, bad, "en") for i in range(300)]
    labels = [(i, 1) for i in range(1500)] + [(5000 + i, 0) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert all(r.kept for r in quality.judge(df, known).collect())
    own = spark.createDataFrame([(i, f"{t} own{i}", l) for i, t, l in docs], "doc_id long, text string, lang string")
    judged = {r.doc_id: r.kept for r in quality.judge(own, known).collect()}
    assert all(judged[i] for i in range(1500)) and not any(judged[5000 + i] for i in range(300))


def test_texts_with_both_labels_are_toxic(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 7)) for i in range(60)], "doc_id long, toxic int")
    for n in (1, 6):
        sample = toxicity.labelled_sample(docs.repartition(n), labels.repartition(n), 50, "doc_id")
        assert {r.text: r.toxic for r in sample.collect()} == {"text 0": 0, "text 1": 1, "text 2": 0}


def test_automata_are_made_anew_beyond_their_bound(monkeypatch):
    terms = ["horrible", "dreadful", "awful"]
    whole = toxicity.Automaton(terms)
    monkeypatch.setattr(toxicity.Automaton, "MAX_MOVES", 5)
    small = toxicity.Automaton(terms)
    for word in ["horible", "dreadfull", "awful", "lawful", "xyz", "horrible", "dredful"] * 3:
        assert small.match(word) == whole.match(word)
        assert small.made <= 5 + len(word)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 40, 900):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, n // 9 + 1).astype(np.uint64)]))
        odd = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(ngram_join.parity(x), ngram_join.parity(y), strict=True))
        assert odd <= len(np.setxor1d(x, y)) and ngram_join.parity(x) == ngram_join.parity(x)


def test_shingle_sets_against_plain_ones():
    """Equal sets of word runs have equal sets of hashes, and no others, in any batch."""
    rng = random.Random(12)
    texts = ["", " \t\n", "One", "one two", "ONE  two\x0bthree four", "é É e", "x" * 5000, "one\x1ftwo three four five"]
    texts += [" ".join(rng.choices(["a", "B", "é", "cc", "d\x85e", "f g"], k=rng.randrange(20))) for _ in range(120)]
    for width in (1, 4, 5):
        plain = []
        for text in texts:
            w = text.encode().lower().split()
            n = min(width, len(w))
            plain.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
        made = ngram_join.shingle_sets(texts, width)
        assert [len(x) for x in made] == [len(x) for x in plain]
        for (a, x), (b, y) in itertools.combinations(zip(plain, made, strict=True), 2):
            assert len(a & b) == len(np.intersect1d(x, y))
        assert all(np.array_equal(x, ngram_join.shingles(t, width)) for t, x in zip(texts, made, strict=True))


def test_shingle_sets_hold_the_numbers_of_few_texts_at_once(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(1)
    given = [" ".join(map(str, rng.integers(0, 10**6, n))) for n in rng.integers(0, 900, 500)] + ["", " "]
    tracemalloc.start()
    got = ngram_join.shingle_sets(given, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35e6
    monkeypatch.setattr(ngram_join, "TOGETHER", 1 << 40)
    assert [x.tolist() for x in got] == [x.tolist() for x in ngram_join.shingle_sets(given, 5)]


def test_terms_counted_in_parts_are_the_same(spark, monkeypatch):
    rows = [(f"alpha{i % 7} beta{i % 5} gamma", i % 2) for i in range(60)]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    whole = sorted(map(tuple, toxicity.term_counts(sample).collect()))
    monkeypatch.setattr(toxicity, "MAX_COUNTED", 3)
    assert sorted(map(tuple, toxicity.term_counts(sample).collect())) == whole


def test_witnesses_are_read_and_counted_by_one_worker(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = ngram_join.Classes(docs, "doc_id", 4, 85)
    located = ngram_join.with_components(ngram_join.indexed(own.prefixes()), None)
    often = located.select("token").distinct()
    plans, write = [], ngram_join.materialise

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(ngram_join, "materialise", noted)
    found = ngram_join.widened(own, located, often)
    # the texts are read while a table is written, in small batches
    assert [x.count("MapInArrow") for x in plans if "MapInArrow" in x] == [1]
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()

    first = collections.defaultdict(list)
    rows = located.withColumn("h", F.xxhash64("rep")).select("token", "h", "rep").collect()
    for token, h, rep in rows:
        first[token].append((h, rep))
    chosen = {rep for x in first.values() for _, rep in sorted(x)[: ngram_join.WITNESSES]}
    counts = collections.Counter(
        t for rep in chosen for t in ngram_join.shingles(texts[rep]).view(np.int64).tolist()
    )
    assert {r["token"] for r in found.collect()} == {t for t, n in counts.items() if n > 2}


def test_tokens_are_counted_in_parts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, k).astype(np.uint64)) for k in (0, 5, 70, 1, 40, 200)]
    plain = collections.Counter(t for x in sets for t in x.tolist())
    for most in (1, 50, 10**6):
        got, parts = collections.Counter(), list(ngram_join.counted(iter(sets), most))
        for part in parts:
            assert len(part) < most + max(map(len, sets))
            got.update(dict(zip(*(x.to_pylist() for x in part.columns), strict=True)))
        assert got == plain and (most > 1 or len(parts) == 5)
    assert not list(ngram_join.counted(iter([]), 1))
