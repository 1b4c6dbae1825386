"""Reference-shaped inputs derived from the driver tables.

The driver tables hold prose, markup, events and vectors but no source code. The
views here give them the shapes the jobs expect (activity log, file contents,
functions with comments, structure strings, scores, spans). Each view covers its
whole table and the whole of every text. ``oracle.py`` states the same views in
SQL for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.structure import markup_structure
from glossmill.sources.readers import read_table, spread

LANGS = ("en", "de", "fr", "es")


def _s(col: Column) -> Column:
    return col.cast("string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all cores for per-text work."""
    return spread(read_table(spark, sf_dir, "documents"))


def watch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity log: clicks play the part of stars on 60 repositories."""
    ev = read_table(spark, sf_dir, "events")
    k = F.col("event_id") % 60
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), ((k % 25) % 4 + 1).cast("int"))
    owner = F.concat(F.lit("src"), _s(k % 25))
    name = (
        F.when(k % 13 == 0, F.concat(F.lit("legacy"), _s(k)))
        .when(
            (k >= 40) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")),
            F.concat(owner, F.lit("/old")),
        )
        .otherwise(F.concat(owner, F.lit("/"), lang))
    )
    return ev.select(
        F.col("event_type").alias("type"),
        F.struct(
            F.when(F.col("event_id") % 97 != 0, k).alias("id"), name.alias("name")
        ).alias("repo"),
        F.struct(F.col("user_id").alias("id")).alias("actor"),
        F.col("ts").alias("created_at"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File contents: equal documents are one content with several paths."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), _s(F.col("doc_id")), F.lit(".ts"))
    return docs.groupBy(F.md5("text").alias("id")).agg(
        F.sort_array(F.collect_list(path)).alias("paths"),
        F.min("text").alias("content"),
    )


def _argument(text: Column, nth: int) -> Column:
    """The first or second run of three or more small letters, or a default."""
    skip = "" if nth == 1 else r"[a-z]{3,}[^a-z]+(?:[a-z]{1,2}[^a-z]+)*"
    word = F.regexp_extract(F.lower(text), f"{skip}([a-z]{{3,}})", 1)
    return F.when(word != "", word).otherwise(F.lit(f"arg{nth}"))


def _statements(text: Column, a: Column, b: Column) -> Column:
    """One statement per word; its form follows from the length of the word."""

    def statement(w: Column) -> Column:
        return (
            F.when(F.length(w) % 3 == 0, F.concat(w, F.lit("();")))
            .when(F.length(w) % 3 == 1, F.concat(F.lit("let "), w, F.lit(" = "), a, F.lit(";")))
            .otherwise(F.concat(F.lit("if ("), w, F.lit(") { "), b, F.lit("(); }")))
        )

    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    return F.array_join(F.transform(words, statement), " ")


def _code(name: Column, a: Column, b: Column, body: Column) -> Column:
    return F.concat(
        F.lit("function "), name, F.lit("("), a, F.lit(", "), b, F.lit(") { "),
        body, F.lit(" return "), a, F.lit(" + "), b, F.lit("; }"),
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commented function per document; the comment holds the whole text."""
    docs = texts(spark, sf_dir)
    text, a, b, name = F.col("text"), F.col("a"), F.col("b"), F.col("name")
    doc = _s(F.col("doc_id"))
    fence = F.when(
        F.col("doc_id") % 5 == 0, F.concat(F.lit(" * ```\n * "), a, F.lit("()\n * ```\n"))
    ).otherwise("")
    comment = F.concat(
        F.lit("/**\n * <b>"), F.replace(text, F.lit("\n"), F.lit("\n * ")), F.lit("</b> "), name,
        F.lit("\n"), fence, F.lit(" * @class Foo\n * @param "), a, F.lit(" the "), b,
        F.lit("\n * see https://example.org/"), doc, F.lit("?q=1 ///\n */"),
    )
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), doc, F.lit(".ts"))
    return (
        docs.withColumns(
            {
                "a": _argument(text, 1),
                "b": _argument(text, 2),
                "name": F.concat(F.lit("fn_"), _s(F.col("doc_id") % 100)),
            }
        )
        .select(
            "doc_id",
            F.md5("text").alias("id"),
            F.array(path).alias("paths"),
            F.lit(0).alias("line"),
            F.lit(0).alias("character"),
            comment.alias("comments"),
            _code(name, a, b, _statements(text, a, b)).alias("text"),
            "name",
            F.array(a, b).alias("params"),
            "lang",
            "source",
        )
    )


def function_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several functions per content id: one per line of every document."""
    docs = texts(spark, sf_dir)
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), _s(F.col("doc_id")), F.lit(".ts"))
    lines = docs.select(
        "doc_id",
        F.md5("text").alias("id"),
        F.array(path).alias("paths"),
        "source",
        F.posexplode(F.split("text", "\n")).alias("line", "s"),
    ).withColumns(
        {
            "a": _argument(F.col("s"), 1),
            "b": _argument(F.col("s"), 2),
            "name": F.concat(F.lit("fn_"), _s((F.col("doc_id") + F.col("line")) % 100)),
        }
    )
    a, b, s, name = F.col("a"), F.col("b"), F.col("s"), F.col("name")
    return lines.select(
        "doc_id",
        "id",
        "paths",
        "source",
        "line",
        F.lit(0).alias("character"),
        F.concat(F.lit("/** "), s, F.lit(" "), name, F.lit("\n * @param "), a, F.lit("\n */")).alias(
            "comments"
        ),
        _code(name, a, b, _statements(s, a, b)).alias("text"),
        "name",
        F.array(a, b).alias("params"),
        "s",
    )


def source_files(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Source files to mine: every line of a document becomes a declaration.

    Lines take turns as function, class method, decoys (an empty body and a
    string that looks like a function) and exported function. Bodies carry
    brackets inside strings, templates, patterns and comments.
    """
    docs = texts(spark, sf_dir)

    def snippet(s: Column, i: Column) -> Column:
        n = _s(i)
        name = F.concat(F.lit("fn_"), n)
        body = F.concat(
            F.lit('(a, b) { const q = "}"; let t = `${ {a} } }`; /* } */ let r = /[/}"]/; '),
            _statements(s, F.lit("a"), F.lit("b")),
            F.lit(" return a + b; }"),
        )
        comment = F.concat(F.lit("/** "), s, F.lit(" */"))
        return (
            F.when(i % 4 == 0, F.concat(comment, F.lit("\nfunction "), name, body))
            .when(
                i % 4 == 1,
                F.concat(
                    F.lit("class C"), n, F.lit(" {\n  "), comment, F.lit("\n  "), name, body,
                    F.lit("\n}"),
                ),
            )
            .when(
                i % 4 == 2,
                F.concat(
                    F.lit("function empty_"), n, F.lit("() {}\nconst s_"), n,
                    F.lit(' = "function no() { x }"; // '), s,
                ),
            )
            .otherwise(
                F.concat(comment, F.lit("\nexport async function "), name, body)
            )
        )

    return docs.select(
        "doc_id",
        *more,
        F.array_join(F.transform(F.split("text", "\n"), snippet), "\n").alias("content"),
    )


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files as a store of contents holds them: ``id, paths, content``."""
    doc = _s(F.col("doc_id"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), doc, F.lit(".ts"))
    return source_files(spark, sf_dir, doc.alias("id"), F.array(path).alias("paths")).drop("doc_id")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector next to the vector with the following id."""
    v = read_table(spark, sf_dir, "embeddings")
    left = v.select("vec_id", F.col("embedding").alias("a"))
    right = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return left.join(right, "vec_id")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoder output: eight steps of eight token scores per example."""
    v = read_table(spark, sf_dir, "embeddings")
    return v.select(
        F.col("vec_id").alias("example"), F.posexplode("embedding").alias("pos", "score")
    ).select(
        "example",
        F.floor(F.col("pos") / 8).cast("int").alias("step"),
        (F.col("pos") % 8).alias("token"),
        F.col("score").cast("double").alias("score"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested half-open spans per document: the document and each of its lines.

    Only line lengths leave the scan; line starts are their running sum.
    """
    docs = read_table(spark, sf_dir, "documents")
    lengths = docs.select(
        "doc_id",
        F.length("text").alias("size"),
        F.posexplode(F.transform(F.split("text", "\n"), F.length)).alias("pos", "len"),
    )
    so_far = Window.partitionBy("doc_id").orderBy("pos")
    end = F.sum("len").over(so_far) + F.col("pos")
    return (
        lengths.withColumn("end_off", end.cast("int"))
        .withColumn("start_off", F.col("end_off") - F.col("len"))
        .select("doc_id", "start_off", "end_off", "size", "pos")
        .select(
            "doc_id",
            F.explode(
                F.when(
                    (F.col("pos") == 0) & (F.col("end_off") < F.col("size")),
                    F.array(
                        F.struct(F.lit(0).alias("s"), F.col("size").alias("e")),
                        F.struct(F.col("start_off").alias("s"), F.col("end_off").alias("e")),
                    ),
                ).otherwise(
                    F.array(F.struct(F.col("start_off").alias("s"), F.col("end_off").alias("e")))
                )
            ).alias("x"),
        )
        .select("doc_id", F.col("x.s").alias("start_off"), F.col("x.e").alias("end_off"))
    )


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caret positions: every event points into some document, or past its end."""
    docs = read_table(spark, sf_dir, "documents")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    placed = read_table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % n_docs).alias("doc_id")
    )
    return placed.join(docs.select("doc_id", "n_chars"), "doc_id").select(
        F.col("event_id").alias("cursor_id"),
        "doc_id",
        (F.col("event_id") % (F.col("n_chars") + 50)).cast("int").alias("off"),
    )


def length_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed entries: whole texts as comments, page structures as trees.

    Every fiftieth document has a second entry, of a negative id, without a comment.
    """
    docs = read_table(spark, sf_dir, "documents")
    pages = read_table(spark, sf_dir, "pages")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    ast = spread(pages).select("page_id", markup_structure(F.col("html")).alias("ast"))
    own = docs.select("doc_id", F.col("doc_id").alias("id"), "source", F.col("text").alias("comments"))
    blank = docs.where(F.col("doc_id") % 50 == 0).select(
        "doc_id", (-1 - F.col("doc_id")).alias("id"), "source", F.lit("").alias("comments")
    )
    return (
        own.unionByName(blank)
        .withColumn("page_id", F.col("doc_id") % n_pages)
        .join(ast, "page_id")
        .select(
            "id",
            F.lit(0).alias("line"),
            F.lit(0).alias("character"),
            "source",
            "comments",
            "ast",
        )
    )
