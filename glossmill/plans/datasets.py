"""Queries that build, filter, profile and store the dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.sequences import leading_digits, token_count
from glossmill.operators import dataset, language
from glossmill.plans import inputs
from glossmill.plans.cleaning import over_comments, sql_clean_comment, sql_normalise
from glossmill.functions.comments import clean_comment
from glossmill.plans.oracle_inputs import with_inputs
from glossmill.plans.registry import query
from glossmill.session import scratch_path
from glossmill.sources import readers, writers

FITS = """comments <> '' AND len(string_split(comments, ' ')) <= 200
  AND len(string_split(ast, ' ')) <= 500"""


# --- files ---------------------------------------------------------------------

_ENTRIES = f"""SELECT id::VARCHAR AS id, comments, ast FROM length_mix WHERE {FITS}"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.keep_fitting(inputs.length_mix(spark, sf_dir)).select(
        F.col("id").cast("string").alias("id"),
        "line",
        "character",
        F.lit("").alias("code"),
        "comments",
        "ast",
    )


@query(
    "s3_gzip_jsonl",
    with_inputs(
        "functions",
        """SELECT id, line::BIGINT AS line, array_to_string(paths, '|') AS paths, comments, text
FROM functions""",
    ),
)
def gzip_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions to compressed JSON lines and back, positions stored as texts."""
    path = scratch_path(spark, "functions")
    functions = inputs.functions(spark, sf_dir).select(
        "id", "paths", F.col("line").cast("string"), F.col("character").cast("string"), "comments", "text"
    )
    functions.write.option("compression", "gzip").json(path)
    return readers.read_functions_jsonl(spark, path).select(
        "id",
        F.col("line").cast("long").alias("line"),
        F.array_join("paths", "|").alias("paths"),
        "comments",
        "text",
    )


@query("s4_jsonl", with_inputs("length_mix", _ENTRIES))
def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "entries")
    writers.write_entries_jsonl(_entries(spark, sf_dir), path)
    return readers.read_entries_jsonl(spark, path).select("id", "comments", "ast")


@query(
    "s5_jsonl_crlf",
    with_inputs("length_mix", f"SELECT count(*) AS n_lines, count(*) AS n_ended FROM length_mix WHERE {FITS}"),
)
def jsonl_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored line ends with carriage return and line feed."""
    path = scratch_path(spark, "entries")
    writers.write_entries_jsonl(_entries(spark, sf_dir), path)
    return spark.read.option("lineSep", "\n").text(path).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("value").endswith("\r")).alias("n_ended")
    )


@query(
    "s6_csv",
    with_inputs(
        "functions",
        """SELECT text AS ast, comments, comments || ' "quoted", ' AS comments_orig FROM functions""",
    ),
)
def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "clean")
    clean = inputs.functions(spark, sf_dir).select(
        F.col("text").alias("ast"), "comments", F.concat("comments", F.lit(' "quoted", ')).alias("comments_orig")
    )
    writers.write_clean_csv(clean, path)
    return readers.read_clean_csv(spark, path)


_PROFILE = f"""SELECT count(*) FILTER (WHERE NOT kept) AS skipped,
  avg(c) FILTER (WHERE kept) AS avg_comment_len, max(c) AS max_comment_len,
  avg(a) FILTER (WHERE kept) AS avg_ast_len, max(a) AS max_ast_len,
  count(*) AS observations, count(*) FILTER (WHERE kept) AS entries
FROM (SELECT len(string_split(comments, ' ')) AS c, len(string_split(ast, ' ')) AS a,
        {FITS} AS kept FROM length_mix)"""


@query(
    "s7_metadata",
    with_inputs(
        "length_mix",
        f"""SELECT skipped, round(avg_comment_len, 2) AS avg_comment_len, max_comment_len,
  round(avg_ast_len, 2) AS avg_ast_len, max_ast_len, observations, entries FROM ({_PROFILE})""",
    ),
)
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metadata")
    writers.write_metadata(dataset.dataset_profile(inputs.length_mix(spark, sf_dir)), path)
    return readers.read_metadata(spark, path)


# --- filters -------------------------------------------------------------------


@query(
    "f6_length_limits",
    with_inputs("length_mix", f"SELECT id, comments, ast FROM length_mix WHERE {FITS}"),
)
def length_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.keep_fitting(inputs.length_mix(spark, sf_dir)).select("id", "comments", "ast")


@query(
    "f8_drop_null",
    with_inputs(
        "length_mix",
        "SELECT id, comments, ast FROM length_mix WHERE comments <> '' AND ast <> ''",
    ),
)
def drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.length_mix(spark, sf_dir)
        .select("id", F.nullif("comments", F.lit("")).alias("comments"), F.nullif("ast", F.lit("")).alias("ast"))
        .na.drop("any")
    )


# --- statistics ------------------------------------------------------------------


@query("a7_profile", with_inputs("length_mix", _PROFILE))
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dataset.dataset_profile(inputs.length_mix(spark, sf_dir))
    return p.withColumns({c: F.col(c).cast("long") for c in ("max_comment_len", "max_ast_len")})


@query(
    "a8_running_mean",
    """SELECT source, count(*) AS n, sum(len(string_split(text, ' ')))::BIGINT AS total,
  sum(len(string_split(text, ' ')))::BIGINT::DOUBLE / count(*) AS mean FROM documents GROUP BY 1""",
)
def mean_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_count(F.col("text")).cast("long")
    return (
        inputs.texts(spark, sf_dir)
        .select("source", tokens.alias("t"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"), F.avg("t").alias("mean"))
    )


@query(
    "w3_running_average",
    """SELECT doc_id, source, n_tokens, running_sum::DOUBLE / running_n AS running_avg FROM (
  SELECT doc_id, source, n_tokens,
    sum(n_tokens) OVER w AS running_sum, count(*) OVER w AS running_n
  FROM (SELECT doc_id, source, len(string_split(text, ' ')) AS n_tokens FROM documents)
  WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
def running_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.texts(spark, sf_dir).select(
        "doc_id", "source", token_count(F.col("text")).cast("long").alias("n_tokens")
    )
    return dataset.running_average(rows, "source", "doc_id", "n_tokens", "running_avg", 1000)


@query(
    "t24_two_decimals",
    """SELECT source, round(sum(n_chars)::DOUBLE / count(*), 2) AS avg_chars FROM documents GROUP BY 1""",
)
def two_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.read_table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.round(F.avg("n_chars"), 2).alias("avg_chars"))


@query("m1_leading_digits", """SELECT doc_id, n_chars - n_chars % (10 ** greatest(
  length(n_chars::VARCHAR) - CASE WHEN n_chars < 1000 THEN 2 ELSE 3 END, 0))::BIGINT AS rounded
FROM documents""")
def rounded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", leading_digits(F.col("n_chars")).alias("rounded"))


@query(
    "a9_run_name",
    with_inputs(
        "length_mix",
        f"""SELECT (n - n % (10 ** greatest(length(n::VARCHAR) - CASE WHEN n < 1000 THEN 2 ELSE 3 END,
  0))::BIGINT)::VARCHAR AS run_name FROM (SELECT count(*) AS n FROM length_mix WHERE {FITS})""",
    ),
)
def run_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.run_name(dataset.dataset_profile(inputs.length_mix(spark, sf_dir)))


# --- cap and pick ------------------------------------------------------------------


@query(
    "l2_corpus_cap",
    with_inputs(
        "length_mix",
        f"SELECT id, comments, ast FROM length_mix WHERE {FITS} ORDER BY id LIMIT 100",
    ),
)
def corpus_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dataset.keep_fitting(inputs.length_mix(spark, sf_dir))
    return dataset.capped(kept, 100).select("id", "comments", "ast")


@query("l3_random_pick", "SELECT doc_id, text FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 1")
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = readers.read_table(spark, sf_dir, "documents")
    return dataset.random_pick(docs, "doc_id", seed=7).select("doc_id", "text")


# --- language ------------------------------------------------------------------------

def sql_languages(fitted: str = "true") -> str:
    """CTEs up to ``labels_found``, fitted on the documents with ``fitted``."""
    return f"""docs AS (SELECT doc_id, lang, lower(text) AS t, {fitted} AS fitted FROM documents),
grams AS (SELECT doc_id, lang, fitted, substr(t, i, 3) AS trigram
  FROM (SELECT *, unnest(range(1, greatest(length(t) - 1, 1))) AS i FROM docs)),
per_doc AS (SELECT doc_id, lang, fitted, trigram, count(*) AS k FROM grams GROUP BY ALL),
langs AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS lang),
counts AS (SELECT trigram, l.lang, coalesce(sum(k) FILTER (WHERE p.lang = l.lang), 0) AS n
  FROM per_doc p, langs l WHERE fitted GROUP BY ALL),
totals AS (SELECT lang, (sum(n) + count(*))::DOUBLE AS total FROM counts GROUP BY ALL),
scores AS (SELECT trigram, lang, round(ln((n + 1) / total) * {language.UNIT})::BIGINT AS s
  FROM counts JOIN totals USING (lang)),
sums AS (SELECT doc_id, t.lang, sum(k * coalesce(s, -round(ln(total) * {language.UNIT})::BIGINT)) AS s
  FROM per_doc p CROSS JOIN totals t LEFT JOIN scores c ON c.trigram = p.trigram AND c.lang = t.lang
  GROUP BY ALL),
labels_found AS (SELECT d.doc_id, arg_max(s.lang, (s.s, s.lang)) AS label
  FROM documents d LEFT JOIN sums s USING (doc_id) GROUP BY ALL)"""


_TRIGRAMS = sql_languages()


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.texts(spark, sf_dir)
    profile = language.fit_language_profile(docs, "text", "lang", inputs.LANGS)
    return language.identify_language(docs, "doc_id", "text", profile)


@query("r4_language", f"WITH {_TRIGRAMS} SELECT doc_id, label FROM labels_found")
def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_labels(spark, sf_dir)


@query(
    "r4_language_held_out",
    f"""WITH {sql_languages("doc_id % 5 <> 0")} SELECT lang, count(*) AS n,
  count(*) FILTER (WHERE label = lang) AS n_right
FROM documents JOIN labels_found USING (doc_id) WHERE doc_id % 5 = 0 GROUP BY ALL""",
)
def identified_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on every fifth document of a profile fitted on the others."""
    docs = inputs.texts(spark, sf_dir)
    held = F.col("doc_id") % 5 == 0
    profile = language.fit_language_profile(docs.where(~held), "text", "lang", inputs.LANGS)
    labels = language.identify_language(docs.where(held), "doc_id", "text", profile)
    return (
        docs.where(held)
        .select("doc_id", "lang")
        .join(labels, "doc_id")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("lang")).alias("n_right")
        )
    )


@query(
    "f7_language_filter",
    f"""WITH {_TRIGRAMS} SELECT doc_id, CASE WHEN label = 'en' THEN text ELSE '' END AS kept
FROM documents JOIN labels_found USING (doc_id)""",
)
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.texts(spark, sf_dir).select("doc_id", "text")
    return docs.join(language_labels(spark, sf_dir), "doc_id").select(
        "doc_id", F.when(F.col("label") == "en", F.col("text")).otherwise("").alias("kept")
    )


_CLEAN = sql_clean_comment("comments")


@query(
    "u3_pipeline",
    with_inputs(
        "functions",
        f"SELECT doc_id, {sql_normalise('c')} AS out FROM (SELECT doc_id, {_CLEAN} AS c FROM functions)",
    ),
)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered stages as a chain of transforms."""
    return dataset.run_stages(
        over_comments(lambda c: c, spark, sf_dir),
        "out",
        [("clean", clean_comment), ("normalise", dataset.normalise_comment)],
    )


@query(
    "s6_clean_dataset",
    with_inputs(
        "length_mix",
        f"""SELECT ast, {sql_normalise('comments')} AS comments, comments AS comments_orig
FROM length_mix JOIN (SELECT doc_id AS id FROM labels_found WHERE label = 'en') USING (id)
WHERE comments <> ''""",
    ).replace("WITH ", f"WITH {_TRIGRAMS},\n", 1),
)
def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = inputs.length_mix(spark, sf_dir).filter(F.col("comments") != "")
    labels = language_labels(spark, sf_dir).select(F.col("doc_id").alias("id"), "label")
    return dataset.clean_dataset(entries, labels)
