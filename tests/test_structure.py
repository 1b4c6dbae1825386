import random

from pyspark.sql import functions as F

from glossmill.functions import structure as S


def test_function_header_is_exact(column):
    out = column(
        lambda k, n, p, b: S.function_structure(k, n, p, b),
        "function", "f", ["foo"], "{ return foo + 'x'; }",
    )
    assert out == (
        "FunctionDeclaration ( FunctionKeyword Identifier [f] OpenParenToken SyntaxList ( "
        "Parameter ( Identifier [foo] ) ) CloseParenToken Block ( OpenBraceToken SyntaxList ( "
        "ReturnKeyword Identifier [foo] PlusToken StringLiteral SemicolonToken ) CloseBraceToken )"
    )


def test_method_without_parameters_and_nested_blocks(spark):
    row = spark.range(1).select(
        S.function_structure(
            F.lit("method"), F.lit("m"), F.array().cast("array<string>"),
            F.lit("{ if (typeof a) { } /* c { */ b(`t`, 2); }"),
        ).alias("ast")
    ).first()
    assert row.ast == (
        "MethodDeclaration ( Identifier [m] OpenParenToken SyntaxList CloseParenToken "
        "Block ( OpenBraceToken SyntaxList ( IfKeyword OpenParenToken TypeOfKeyword Identifier [a] "
        "CloseParenToken Block ( OpenBraceToken SyntaxList CloseBraceToken ) Identifier [b] OpenParenToken "
        "TemplateLiteral CommaToken NumericLiteral CloseParenToken SemicolonToken ) CloseBraceToken )"
    )


def test_strip_identifiers_and_root(column):
    assert column(S.strip_identifiers, "A ( Identifier [x] B [y z] )") == "A ( Identifier B )"
    assert column(S.strip_root, "SourceFile ( SyntaxList ( E ) EndOfFileToken )") == "( E ) EndOfFileToken"


def test_markup(column):
    html = '<!-- <p> --><div class="a"><br><img src="x"/><p>text < more</p></div>'
    assert column(S.markup_structure, html) == "div ( br img p ( ) )"
    assert column(S.nesting_depth, "div ( br img p ( ) )") == 2


def test_pieces_of_code_have_the_classes_of_their_tokens(spark):
    """Odd bodies against the tokens of the pattern, found by Spark."""
    parts = [
        "a", "if", "Z_9", "$", "9x.5", "...", "=>", "===", "!", "\u00e9", "\U0001f600", " ", "\n", "\r",
        "\u00a0", "\u2028", "\x0b", "/", "/*", "*/", "//", "'", '"', "`", "\\", "{", "}", "(", ";", "\x1c",
    ]
    rng = random.Random(5)
    bodies = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    parts_of = F.lit("method"), F.lit(""), F.array().cast("array<string>"), F.col("b")
    rows = df.select(
        "b",
        F.regexp_extract_all("b", F.lit(S.CODE_TOKEN), F.lit(1)).alias("tokens"),
        S.function_structure(*parts_of).alias("ast"),
        S.function_structure(*parts_of, identifiers=False).alias("plain"),
        S.strip_identifiers(S.function_structure(*parts_of)).alias("stripped"),
    ).collect()
    head = "MethodDeclaration ( OpenParenToken SyntaxList CloseParenToken "
    for row in rows:
        classes = [c for c in map(S.token_class, row.tokens) if c]
        assert row.ast == head + " ".join(classes).replace("SyntaxList ( )", "SyntaxList"), repr(row.b)
        assert row.plain == row.stripped


def test_structure_of_nulls_and_of_a_string_with_many_escapes(spark):
    """Java's patterns overflow the stack on many escapes."""
    long = "{ x('" + "\\n" * 50_000 + "'); }"
    rows = [(1, "f", ["p", None], long), (2, None, [], "{}"), (3, "f", None, "{}"), (4, "f", ["p"], None)]
    df = spark.createDataFrame(rows, "i int, n string, p array<string>, b string")
    out = df.select("i", S.function_structure(F.lit("function"), "n", "p", "b").alias("ast"))
    assert dict(map(tuple, out.collect())) == {
        1: "FunctionDeclaration ( FunctionKeyword Identifier [f] OpenParenToken SyntaxList ( "
        "Parameter ( Identifier [p] ) ) CloseParenToken Block ( OpenBraceToken SyntaxList ( Identifier [x] "
        "OpenParenToken StringLiteral CloseParenToken SemicolonToken ) CloseBraceToken )",
        2: "FunctionDeclaration ( FunctionKeyword OpenParenToken SyntaxList CloseParenToken "
        "Block ( OpenBraceToken SyntaxList CloseBraceToken )",
        3: None,
        4: None,
    }
