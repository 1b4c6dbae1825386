from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmill.functions import detokenise as D
from glossmill.functions import normalise as N
from glossmill.functions import sequences as Q


def test_chain(column):
    out = column(N.normalise_comment, "/** Get HTTP://a.b/c?d=1, snake_case:\n\t/// x */")
    assert out == "<start> /** get URL , snake _ case : <eol> / / / x */ <end>"


def test_address_edges(column):
    assert column(N.mask_urls, "see ://a.b. and // and https://x.y/é") == "see URL. and // and URL/é"


def test_slash_runs(column):
    assert column(N.split_slashes, "a // b /// c //// d") == "a // b / / / c / / / / d"


def test_protected_tokens(column):
    assert column(N.tokenise, "/**a*/ // <eol><start> b_c é!") == [
        "/**", "a", "*/", "//", "<eol>", "<start>", "b_c", "é", "!",
    ]


def test_line_ends(column):
    assert column(N.mark_lines, "a\r\nb\rc\nd\te") == "a <eol> b <eol> c <eol> de"


def test_detokenise_examples(spark):
    cases = [
        ([], ""),
        (["a"], "a"),
        (["a", "word", "word"], "a word word"),
        (["<eol>", "a"], "\na"),
        (["a", "<eol>", "<eos>", "b"], "a\n\nb"),
        (["f", ">(", ">)", "g"], "f () g"),
        ([">(", "a", ">)"], "( a )"),
        (["a", "<eol>", ">)", ">(", "b"], "a\n)( b"),
        (["a", ">(", "<eol>", ">(", "b"], "a (\n( b"),
    ]
    df = spark.createDataFrame(cases, "t array<string>, want string")
    for row in df.select("t", "want", D.detokenise(F.col("t")).alias("out")).collect():
        assert row.out == row.want, row.t


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["a", "bc", "d_1"]), min_size=1, max_size=9))
def test_plain_words_are_joined_by_blanks(spark, tokens):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(D.detokenise(F.col("t"))).first()[0] == " ".join(tokens)


def test_rechunk(column):
    assert column(D.rechunk, list("ab (c)")) == ["ab", " (", "c", ")"]


def test_leading_digits(spark):
    cases = {0: 0, 7: 7, 86: 86, 860: 860, 867: 860, 999: 990, 1000: 1000, 2004: 2000, 7930: 7930, 12345: 12300}
    df = spark.createDataFrame([(k,) for k in cases], "n long")
    assert {r.n: r.out for r in df.select("n", Q.leading_digits(F.col("n")).alias("out")).collect()} == cases


def test_bounds_pad_shift(spark):
    df = spark.createDataFrame([(list(range(1, n + 1)),) for n in (0, 2, 3, 5)], "ids array<int>")
    rows = df.select(
        "ids",
        Q.with_bounds(F.col("ids"), 8, 9).alias("bound"),
        Q.pad(F.col("ids"), 3, 0).alias("padded"),
        Q.shifted_targets(F.col("ids"), 3, 9).alias("targets"),
    ).collect()
    by_size = {len(r.ids): r for r in rows}
    assert by_size[2].bound == [8, 1, 2, 9]
    assert [by_size[n].padded for n in (0, 2, 3, 5)] == [[0, 0, 0], [1, 2, 0], [1, 2, 3], [1, 2, 3]]
    assert [by_size[n].targets for n in (2, 3, 5)] == [[2, 9, 9], [2, 3, 9], [2, 3, None]]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0005, 3.1])], "a array<double>, b array<double>")
    row = df.select(
        Q.differing(F.col("a"), F.col("b"), 0.001).alias("d"),
        Q.equal_vectors(F.col("a"), F.col("b")).alias("ab"),
        Q.equal_vectors(F.col("a"), F.col("a")).alias("aa"),
        Q.arg_max(F.col("b")).alias("best"),
    ).first()
    assert [(e.pos, e.left, e.right) for e in row.d] == [(2, 3.0, 3.1)]
    assert (row.ab, row.aa, row.best) == (False, True, 2)
