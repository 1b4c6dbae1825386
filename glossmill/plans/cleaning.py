"""Queries on comments and structures: cleaning, placeholders, normalising, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import comments as C
from glossmill.functions import normalise as N
from glossmill.functions import placeholders as P
from glossmill.functions import structure as S
from glossmill.functions.detokenise import rechunk
from glossmill.functions.sequences import token_count
from glossmill.operators.dataset import prepare_entries
from glossmill.plans import inputs
from glossmill.plans.oracle_inputs import markup_structure, with_inputs
from glossmill.plans.registry import query
from glossmill.sources.readers import FUNCTION_SCHEMA, read_table, spread

# --- SQL forms of the column functions --------------------------------------


def sql_text(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def sql_strip_markup(c: str) -> str:
    """Remove tags as often as the text has marks, whatever their depth."""
    first = f"regexp_replace({c}, {sql_text(C.HTML_COMMENT)}, '', 'g')"
    marks = f"list_transform(range(length({c}) - length(replace({c}, '<', ''))), lambda i: '')"
    once = f"regexp_replace(x, {sql_text(C.HTML_TAG)}, '', 'g')"
    return f"list_reduce(list_prepend({first}, {marks}), lambda x, y: CASE WHEN contains(x, '<') THEN {once} ELSE x END)"


def sql_strip_fences(c: str) -> str:
    return f"regexp_replace({c}, {sql_text(C.FENCED_EXAMPLE)}, '', 'g')"


def sql_strip_tag_lines(c: str) -> str:
    """Protect the kept tags with a mark, drop the other tag lines, restore the mark."""
    kept = (
        "'((?:^|\\r?\\n)[ \\t]*\\*[ \\t]*)@((?:param|returns?)(?:[^\\S\\r\\n]|\\S(?:[\\r\\n]|$)))'"
    )
    marked = f"regexp_replace({c}, {kept}, '\\1' || chr(1) || '\\2', 'g')"
    dropped = f"regexp_replace({marked}, '(^|\\r?\\n)[ \\t]*\\*[ \\t]*@\\S+[^\\r\\n]+', '', 'g')"
    return f"replace({dropped}, chr(1), '@')"


def sql_clean_comment(c: str) -> str:
    return sql_strip_tag_lines(sql_strip_fences(sql_strip_markup(c)))


def sql_to_placeholders(c: str, name: str = "name", params: str = "params") -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '(\\W+|\\w+)', 1), lambda t: "
        f"CASE WHEN t = {name} THEN 'FunctionNamePlaceholder' "
        f"WHEN list_contains({params}, t) THEN 'ArgumentNumber' || "
        f"(len({params}) - list_position(list_reverse({params}), t)) ELSE t END), '')"
    )


def sql_mask_urls(c: str) -> str:
    return f"regexp_replace({c}, '(?:https?)?://[A-Za-z0-9_./?=&%]*[A-Za-z0-9_]', 'URL', 'g')"


def sql_space_code(c: str) -> str:
    return f"""regexp_replace({c}, '([.,()<>\\[\\]{{}}"''`\\-$=_;%|&#~^\\\\])', ' \\1 ', 'g')"""


def sql_split_slashes(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '(/{{3,}}|/{{1,2}}|[^/]+)', 1), "
        "lambda t: CASE WHEN starts_with(t, '///') THEN rtrim(replace(t, '/', '/ ')) ELSE t END), '')"
    )


def sql_mark_lines(c: str) -> str:
    return f"regexp_replace(replace({c}, chr(9), ''), '\\r\\n|\\r|\\n', ' <eol> ', 'g')"


def sql_clean_text(c: str) -> str:
    return sql_mark_lines(sql_split_slashes(sql_space_code(sql_mask_urls(f"lower({c})"))))


def sql_tokenise(c: str) -> str:
    return (
        f"regexp_extract_all({c}, '(<start>|<eol>|<end>|/\\*\\*|/\\*|\\*/|//|"
        "[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}\\p{Z}_\\s])', 1)"
    )


def sql_wrap(c: str) -> str:
    return f"regexp_replace('<start> ' || {c} || ' <end>', ' {{2,}}', ' ', 'g')"


def sql_normalise(c: str) -> str:
    tokens = f"list_filter({sql_tokenise(sql_clean_text(c))}, lambda t: t <> '')"
    return sql_wrap(f"array_to_string({tokens}, ' ')")


def sql_token_class(t: str) -> str:
    words = " ".join(
        f"WHEN {t} = '{k}' THEN '{S.KEYWORD_CLASSES.get(k, k.capitalize() + 'Keyword')}'"
        for k in S.KEYWORDS
    )
    marks = " ".join(f"WHEN {t} = '{k}' THEN '{v}'" for k, v in S.PUNCTUATION_CLASSES.items())
    return (
        f"CASE WHEN {t} = '{{' THEN 'Block ( OpenBraceToken SyntaxList (' "
        f"WHEN {t} = '}}' THEN ') CloseBraceToken )' {words} {marks} "
        f"WHEN regexp_matches({t}, '^[A-Za-z_$]') THEN 'Identifier [' || {t} || ']' "
        f"WHEN regexp_matches({t}, '^[0-9]') THEN 'NumericLiteral' "
        f"WHEN starts_with({t}, '\"') OR starts_with({t}, '''') THEN 'StringLiteral' "
        f"WHEN starts_with({t}, '`') THEN 'TemplateLiteral' ELSE 'UnknownToken' END"
    )


def sql_function_structure(kind: str, name: str, params: str, body: str) -> str:
    pattern = S.CODE_TOKEN.replace("'", "''")
    tokens = (
        f"list_filter(regexp_extract_all({body}, '{pattern}', 1), "
        "lambda t: NOT (starts_with(t, '/*') OR starts_with(t, '//')))"
    )
    block = (
        f"replace(array_to_string(list_transform({tokens}, lambda t: {sql_token_class('t')}), ' '), "
        "'SyntaxList ( )', 'SyntaxList')"
    )
    listed = (
        f"CASE WHEN len({params}) = 0 THEN 'SyntaxList' ELSE 'SyntaxList ( ' || "
        f"array_to_string(list_transform({params}, lambda p: 'Parameter ( Identifier [' || p || '] )'), "
        "' CommaToken ') || ' )' END"
    )
    return (
        f"CASE WHEN {kind} = 'function' THEN 'FunctionDeclaration ( FunctionKeyword' "
        f"ELSE 'MethodDeclaration (' END || CASE WHEN {name} = '' THEN '' ELSE ' Identifier [' || {name} || ']' END "
        f"|| ' OpenParenToken ' || {listed} || ' CloseParenToken ' || {block}"
    )


SQL_BODY = "substr(text, strpos(text, '{'))"


def body_of(text: Column) -> Column:
    """Body of the derived one-function texts."""
    return F.substring(text, F.instr(text, "{"), F.length(text))


def with_parts(rows: DataFrame) -> DataFrame:
    """Add the ``kind`` and ``body`` that extraction would deliver."""
    return rows.withColumns({"kind": F.lit("function"), "body": body_of(F.col("text"))})


def over_comments(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column function over the comments of all functions."""
    return inputs.functions(spark, sf_dir).select("doc_id", fn(F.col("comments")).alias("out"))


def sql_over_comments(expression: str) -> str:
    return with_inputs("functions", f"SELECT doc_id, {expression} AS out FROM functions")


# --- cleaning ----------------------------------------------------------------


@query("t1_strip_markup", f"SELECT page_id, {sql_strip_markup('html')} AS out FROM pages")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", C.strip_markup(F.col("html")).alias("out"))


@query("t2_strip_fences", sql_over_comments(sql_strip_fences("comments")))
def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(C.strip_fences, spark, sf_dir)


@query("t3_strip_tag_lines", sql_over_comments(sql_strip_tag_lines("comments")))
def strip_tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(C.strip_tag_lines, spark, sf_dir)


@query("t4_placeholders", sql_over_comments(sql_to_placeholders("comments")))
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.functions(spark, sf_dir).select(
        "doc_id", P.to_placeholders(F.col("comments"), F.col("name"), F.col("params")).alias("out")
    )


@query("t5_identifiers", sql_over_comments("comments"))
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back again: the result must be the comment itself."""
    name, params = F.col("name"), F.col("params")
    return (
        inputs.functions(spark, sf_dir)
        .withColumn("canonical", P.to_placeholders(F.col("comments"), name, params))
        .select("doc_id", P.to_identifiers(F.col("canonical"), name, params).alias("out"))
    )


@query(
    "t6_signature",
    with_inputs(
        "functions", "SELECT doc_id, name, array_to_string(params, ',') AS params FROM functions"
    ),
)
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = P.signature(F.col("text"))
    return inputs.functions(spark, sf_dir).select(
        "doc_id", parts["name"].alias("name"), F.array_join(parts["params"], ",").alias("params")
    )


@query(
    "f9_membership",
    with_inputs(
        "functions",
        """SELECT tag, (tag IN ('param', 'return', 'returns'))::BIGINT AS kept, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(comments, '@([a-z]+)', 1)) AS tag FROM functions) GROUP BY 1, 2""",
    ),
)
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.regexp_extract_all("comments", F.lit("@([a-z]+)"), F.lit(1))
    return (
        inputs.functions(spark, sf_dir)
        .select(F.explode(tags).alias("tag"))
        .groupBy("tag", C.is_kept_tag(F.col("tag")).cast("long").alias("kept"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p7_column_copy",
    with_inputs(
        "functions",
        "SELECT doc_id, lower(comments) AS comments, comments AS comments_orig FROM functions",
    ),
)
def column_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.functions(spark, sf_dir)
        .withColumn("comments_orig", F.col("comments"))
        .withColumn("comments", F.lower("comments"))
        .select("doc_id", "comments", "comments_orig")
    )


_AST = sql_function_structure("'function'", "name", "params", SQL_BODY)


@query(
    "p8_entries",
    with_inputs(
        "functions",
        f"""SELECT id, line::BIGINT AS line, "character"::BIGINT AS "character", text AS code,
  {sql_to_placeholders(sql_clean_comment("comments"))} AS comments, {_AST} AS ast FROM functions""",
    ),
)
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_parts(inputs.functions(spark, sf_dir))
    return prepare_entries(found).withColumns(
        {"line": F.col("line").cast("long"), "character": F.col("character").cast("long")}
    )


# --- normalising -------------------------------------------------------------


@query("t7_lower", sql_over_comments("lower(comments)"))
def lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(F.lower, spark, sf_dir)


@query("t8_mask_urls", sql_over_comments(sql_mask_urls("comments")))
def mask_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(N.mask_urls, spark, sf_dir)


@query("t9_space_code", sql_over_comments(sql_space_code("comments")))
def space_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(N.space_code_characters, spark, sf_dir)


@query("t10_split_slashes", sql_over_comments(sql_split_slashes("comments")))
def split_slashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(N.split_slashes, spark, sf_dir)


@query("t11_mark_lines", sql_over_comments(sql_mark_lines("comments")))
def mark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(N.mark_lines, spark, sf_dir)


@query("t12_wrap", sql_over_comments(sql_wrap("comments")))
def wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(N.wrap, spark, sf_dir)


@query("t13_normalise", sql_over_comments(sql_normalise("comments")))
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_comments(N.normalise_comment, spark, sf_dir)


@query(
    "t14_tokenise",
    with_inputs(
        "functions",
        f"""SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ' ') AS tokens
FROM (SELECT doc_id, {sql_tokenise("comments")} AS tokens FROM functions)""",
    ),
)
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.functions(spark, sf_dir)
        .select("doc_id", N.tokenise(F.col("comments")).alias("tokens"))
        .select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))
    )


@query(
    "f10_drop_empty",
    with_inputs(
        "functions",
        """SELECT doc_id, len(string_split(comments, ' ')) AS n_all,
  len(list_filter(string_split(comments, ' '), lambda t: t <> '')) AS n_kept FROM functions""",
    ),
)
def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.split("comments", " ")
    return inputs.functions(spark, sf_dir).select(
        "doc_id",
        F.size(tokens).cast("long").alias("n_all"),
        F.size(N.drop_empty(tokens)).cast("long").alias("n_kept"),
    )


@query(
    "t15_token_count",
    with_inputs("length_mix", "SELECT id, len(string_split(comments, ' ')) AS n FROM length_mix"),
)
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.length_mix(spark, sf_dir).select(
        "id", token_count(F.col("comments")).cast("long").alias("n")
    )


@query(
    "t16_rechunk",
    """SELECT doc_id, len(runs) AS n, array_to_string(runs, '|') AS out
FROM (SELECT doc_id, regexp_extract_all(text, '(\\W+|\\w+)', 1) AS runs FROM documents)""",
)
def rechunk_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From single characters back to runs."""
    characters = F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1))
    return (
        inputs.texts(spark, sf_dir)
        .select("doc_id", rechunk(characters).alias("runs"))
        .select("doc_id", F.size("runs").cast("long").alias("n"), F.array_join("runs", "|").alias("out"))
    )


# --- positions, JSON ----------------------------------------------------------


@query(
    "t18_leading_trivia",
    with_inputs("functions", "SELECT doc_id, comments AS out FROM functions"),
)
def leading_trivia(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit(" \t\n"), F.col("comments"), F.lit("\n  "), F.col("text"))
    return (
        inputs.functions(spark, sf_dir)
        .select("doc_id", source.alias("source"), (F.length("comments") + 6).alias("start"))
        .select("doc_id", C.leading_trivia(F.col("source"), F.lit(0), F.col("start")).alias("out"))
    )


#: Offsets in quarters of a text: the last one is its end.
_QUARTERS = (0, 1, 2, 3, 4)


@query(
    "t19_line_character",
    """SELECT doc_id, off, len(string_split(prefix, chr(10))) - 1 AS line,
  length(string_split(prefix, chr(10))[-1]) AS "character"
FROM (SELECT doc_id, off, substr(text, 1, off) AS prefix FROM (
  SELECT doc_id, text, unnest(list_transform([0, 1, 2, 3, 4], lambda q: q * length(text) // 4)) AS off
  FROM documents))""",
)
def line_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the quarters of every text, its end included."""
    text = F.col("text")
    places = F.array(*[F.floor(F.length(text) * q / 4).cast("int") for q in _QUARTERS])
    return inputs.texts(spark, sf_dir).select("doc_id", "text", F.explode_outer(places).alias("off")).select(
        "doc_id",
        F.col("off").cast("long").alias("off"),
        C.line_of(text, F.col("off")).cast("long").alias("line"),
        C.character_of(text, F.col("off")).cast("long").alias("character"),
    )


@query(
    "t20_json_scalars",
    with_inputs(
        "functions",
        """SELECT doc_id, line::VARCHAR AS line, "character"::VARCHAR AS "character", comments, text
FROM functions""",
    ),
)
def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.functions(spark, sf_dir)
        .select("doc_id", F.to_json(F.struct("line", "character", "comments", "text")).alias("m"))
        .select(
            "doc_id",
            *[F.get_json_object("m", f"$.{c}").alias(c) for c in ("line", "character", "comments", "text")],
        )
    )


@query(
    "t21_json_codec",
    with_inputs(
        "functions",
        """SELECT doc_id, json_object('line', line, 'character', "character", 'comments', comments,
  'text', text)::VARCHAR AS encoded, comments AS decoded FROM functions""",
    ),
)
def json_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.functions(spark, sf_dir)
        .select("doc_id", F.to_json(F.struct("line", "character", "comments", "text")).alias("encoded"))
        .select(
            "doc_id", "encoded", F.from_json("encoded", FUNCTION_SCHEMA)["comments"].alias("decoded")
        )
    )


@query(
    "t22_insert_comment",
    """SELECT doc_id, substr(text, 1, off) || '/** note */' || chr(10) || repeat(' ', off % 7)
  || substr(text, off + 1) AS out
FROM (SELECT doc_id, text, strpos(text, chr(10))::INT AS off FROM documents)""",
)
def insert_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.instr("text", "\n")
    return inputs.texts(spark, sf_dir).select(
        "doc_id", C.insert_comment(F.col("text"), off, off % 7, F.lit("/** note */")).alias("out")
    )


# --- structures ---------------------------------------------------------------


@query(
    "t23_strip_identifiers",
    with_inputs(
        "functions",
        f"""SELECT doc_id, regexp_replace({_AST}, ' \\[[^\\]]*\\]', '', 'g') AS out FROM functions""",
    ),
)
def strip_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures are stripped in the task that makes them: whole ones are far larger."""
    parts = (F.col(c) for c in ("kind", "name", "params", "body"))
    return with_parts(inputs.functions(spark, sf_dir)).select(
        "doc_id", S.function_structure(*parts, identifiers=False).alias("out")
    )


@query("r2_markup_structure", f"SELECT page_id, {markup_structure()} AS ast FROM pages")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", S.markup_structure(F.col("html")).alias("ast"))


@query(
    "r2_code_structure",
    with_inputs("functions", f"SELECT doc_id, {_AST} AS ast FROM functions"),
)
def code_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(inputs.functions(spark, sf_dir)).select(
        "doc_id",
        S.function_structure(F.col("kind"), F.col("name"), F.col("params"), F.col("body")).alias("ast"),
    )


_DEPTH = f"""SELECT page_id, n_tokens, n_chars, coalesce(deepest, 0)::BIGINT AS depth FROM (
  SELECT page_id, len(string_split(ast, ' ')) AS n_tokens, length(ast) AS n_chars FROM trees)
LEFT JOIN (SELECT page_id, greatest(max(depth), 0) AS deepest FROM (
    SELECT page_id, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
      OVER (PARTITION BY page_id ORDER BY i) AS depth
    FROM (SELECT page_id, unnest(string_split(ast, ' ')) AS t,
            unnest(range(len(string_split(ast, ' ')))) AS i FROM trees)) GROUP BY 1) USING (page_id)"""
_TREES = f"SELECT page_id, {markup_structure()} AS ast FROM pages"


@query("r3_structure_profile", with_inputs("", _DEPTH, trees=_TREES))
def structure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_structure(spark, sf_dir).select(
        "page_id",
        token_count(F.col("ast")).cast("long").alias("n_tokens"),
        F.length("ast").cast("long").alias("n_chars"),
        S.nesting_depth(F.col("ast")).cast("long").alias("depth"),
    )


@query(
    "r3_structure_tokens",
    with_inputs(
        "",
        """SELECT token, count(*) AS n, count(DISTINCT page_id) AS n_pages
FROM (SELECT page_id, unnest(string_split(ast, ' ')) AS token FROM trees) GROUP BY 1""",
        trees=_TREES,
    ),
)
def structure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page first, so that a frequent token is combined before each shuffle."""
    return (
        page_structure(spark, sf_dir)
        .select("page_id", F.explode(F.split("ast", " ")).alias("token"))
        .groupBy("token", "page_id")
        .agg(F.count(F.lit(1)).alias("k"))
        .groupBy("token")
        .agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_pages"))
    )
