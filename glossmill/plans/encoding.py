"""Queries on vocabularies, sequences, subwords, vectors and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import sequences as Q
from glossmill.functions.detokenise import detokenise
from glossmill.functions.normalise import normalise_comment
from glossmill.operators import decoding, embedding, spans, subwords, vocabulary
from glossmill.plans import inputs
from glossmill.plans.cleaning import sql_normalise
from glossmill.plans.oracle_inputs import with_inputs
from glossmill.plans.registry import query
from glossmill.session import materialise, scratch_path
from glossmill.sources import readers, writers

MIN_COUNT = 3
COMMENT_LIMIT = 200
AST_LIMIT = 500

# --- word vocabulary ---------------------------------------------------------------


def comment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, tokens``: tokens of the normalised comments."""
    return inputs.functions(spark, sf_dir).select(
        "doc_id", F.split(normalise_comment(F.col("comments")), " ").alias("tokens")
    )


def comment_vocabulary(tokens: DataFrame) -> DataFrame:
    return vocabulary.vocabulary(vocabulary.word_counts(tokens, "tokens", MIN_COUNT))


def encoded_comments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """``doc_id, ids`` and the vocabulary size.

    The normalised tokens are stored once; counting and encoding both read them.
    """
    tokens = materialise(comment_tokens(spark, sf_dir), codec="zstd")
    vocab = materialise(comment_vocabulary(tokens))
    return vocabulary.encode_words(tokens, "doc_id", "tokens", vocab), vocab.count()


_TOKENS = f"""SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token
FROM (SELECT doc_id, string_split({sql_normalise("comments")}, ' ') AS ts FROM functions)"""
_VOCAB = f"""SELECT token, (1 + row_number() OVER (ORDER BY n DESC, token))::INT AS id, n
FROM (SELECT token, count(*) AS n FROM toks GROUP BY 1 HAVING count(*) >= {MIN_COUNT})
UNION ALL SELECT 'UNK', 1, NULL"""
_ENCODED = """SELECT doc_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids
FROM toks LEFT JOIN vocab v USING (token) GROUP BY 1"""


def sql_encoded(body: str) -> str:
    return with_inputs("functions", body, toks=_TOKENS, vocab=_VOCAB, encoded=_ENCODED)


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ", "-")


@query(
    "a10_word_counts",
    with_inputs("functions", f"SELECT token AS word, count(*) AS n FROM toks GROUP BY 1 HAVING count(*) >= {MIN_COUNT}", toks=_TOKENS),
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.word_counts(comment_tokens(spark, sf_dir), "tokens", MIN_COUNT)


@query("a9_vocabulary_size", sql_encoded("SELECT count(*) AS n_words, max(id)::BIGINT AS max_id FROM vocab"))
def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comment_vocabulary(comment_tokens(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("n_words"), F.max("id").cast("long").alias("max_id")
    )


@query(
    "s8_vocabulary",
    sql_encoded(
        "SELECT token, id::BIGINT AS id, (SELECT count(*) FROM vocab) AS comment_vocab_size FROM vocab"
    ),
)
def stored_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vocabulary")
    vocab = materialise(comment_vocabulary(comment_tokens(spark, sf_dir)))
    writers.write_vocabulary(vocab, {"comment_vocab_size": vocab.count()}, path)
    tokens, params = readers.read_vocabulary(spark, path)
    size = params.filter(F.col("name") == "comment_vocab_size").select("value").scalar()
    return tokens.select("token", F.col("id").cast("long").alias("id"), size.alias("comment_vocab_size"))


@query(
    "j5_encode",
    sql_encoded("SELECT doc_id, len(ids) AS n, array_to_string(ids, ' ') AS ids FROM encoded"),
)
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _ = encoded_comments(spark, sf_dir)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), joined(F.col("ids")).alias("ids"))


def structure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, tokens``: the blank-separated structures of the entries."""
    return inputs.length_mix(spark, sf_dir).select("id", F.split("ast", " ").alias("tokens"))


def structure_vocabulary(tokens: DataFrame) -> DataFrame:
    """The structure side keeps every token, also those seen once."""
    return vocabulary.vocabulary(
        vocabulary.word_counts(tokens, "tokens", embedding.MIN_COUNT_STRUCTURES)
    )


def sql_structures(body: str) -> str:
    return with_inputs(
        "length_mix",
        body,
        ast_toks="""SELECT id AS doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token
FROM (SELECT id, string_split(ast, ' ') AS ts FROM length_mix)""",
        ast_vocab="""SELECT token, (1 + row_number() OVER (ORDER BY n DESC, token))::INT AS id, n
FROM (SELECT token, count(*) AS n FROM ast_toks GROUP BY 1) UNION ALL SELECT 'UNK', 1, NULL""",
    )


@query("a10_structure_counts", sql_structures("SELECT token AS word, n FROM ast_vocab WHERE token <> 'UNK'"))
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.word_counts(
        structure_tokens(spark, sf_dir), "tokens", embedding.MIN_COUNT_STRUCTURES
    )


@query(
    "j5_encode_structures",
    sql_structures(
        """SELECT doc_id AS id, count(*) AS n, string_agg(v.id, ' ' ORDER BY pos) AS ids
FROM ast_toks JOIN ast_vocab v USING (token) GROUP BY 1"""
    ),
)
def encode_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = materialise(structure_tokens(spark, sf_dir))
    vocab = materialise(structure_vocabulary(tokens))
    ids = vocabulary.encode_words(tokens, "id", "tokens", vocab)
    return ids.select("id", F.size("ids").cast("long").alias("n"), joined(F.col("ids")).alias("ids"))


@query(
    "s8_both_vocabularies",
    sql_structures("SELECT 1")[: -len("SELECT 1")].rstrip()
    + ",\n"
    + sql_encoded(
        f"""SELECT side, token, id::BIGINT AS id, {COMMENT_LIMIT}::BIGINT AS max_comment_length,
  {AST_LIMIT}::BIGINT AS max_ast_length, (SELECT count(*) FROM vocab) AS comment_vocab_size,
  (SELECT count(*) FROM ast_vocab) AS ast_vocab_size
FROM (SELECT 'comment' AS side, token, id FROM vocab UNION ALL SELECT 'ast', token, id FROM ast_vocab)"""
    ).removeprefix("WITH "),
)
def both_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export a predictor reads: both lookups and all parameters, written and read back."""
    made = {
        "comment": materialise(comment_vocabulary(materialise(comment_tokens(spark, sf_dir)))),
        "ast": materialise(structure_vocabulary(materialise(structure_tokens(spark, sf_dir)))),
    }
    params = {"max_comment_length": COMMENT_LIMIT, "max_ast_length": AST_LIMIT}
    params |= {f"{side}_vocab_size": vocab.count() for side, vocab in made.items()}
    path, out = scratch_path(spark, "export"), None
    for side, vocab in made.items():
        writers.write_vocabulary(vocab, params, f"{path}/{side}")
        tokens, stored = readers.read_vocabulary(spark, f"{path}/{side}")
        values = stored.groupBy().pivot("name", list(params)).agg(F.max("value")).first()
        rows = tokens.select(
            F.lit(side).alias("side"),
            "token",
            F.col("id").cast("long").alias("id"),
            *[F.lit(values[name]).cast("long").alias(name) for name in params],
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "a11_max_length",
    sql_encoded("SELECT least(max(len(ids)), 500)::BIGINT AS max_length FROM encoded"),
)
def max_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _ = encoded_comments(spark, sf_dir)
    return vocabulary.longest(ids, F.col("ids"), AST_LIMIT).select(
        F.col("max_length").cast("long").alias("max_length")
    )


@query(
    "w4_context",
    """WITH split_docs AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM split_docs),
near AS (SELECT doc_id, word, i, i + d AS j
  FROM (SELECT *, unnest([-7, -6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5, 6, 7]) AS d FROM words))
SELECT l.word AS center, count(DISTINCT r.word) AS n_contexts, count(*) AS n_pairs
FROM near l JOIN words r ON l.doc_id = r.doc_id AND r.i = l.j GROUP BY 1""",
)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are counted by the words' numbers; only the finished counts meet the words."""
    texts, tokens = inputs.texts(spark, sf_dir), F.split("text", " ")
    words = embedding.numbered_words(texts, tokens, 1)
    numbers = vocabulary.word_numbers(texts, tokens, words.select(F.col("word").alias("token"), "id"))
    counts = vocabulary.context_pairs(numbers, "ids", 7).groupBy(F.col("center").cast("long").alias("id")).agg(
        F.count(F.lit(1)).alias("n_contexts"), F.sum("n").alias("n_pairs")
    )
    return counts.join(words, "id").select(F.col("word").alias("center"), "n_contexts", "n_pairs")


# --- sequences ----------------------------------------------------------------------


@query(
    "q1_bounds",
    sql_encoded(
        """SELECT doc_id, array_to_string(list_concat(list_concat([v + 1], ids), [v + 2]), ' ') AS ids
FROM encoded, (SELECT count(*) AS v FROM vocab)"""
    ),
)
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, size = encoded_comments(spark, sf_dir)
    return ids.select("doc_id", joined(Q.with_bounds(F.col("ids"), size + 1, size + 2)).alias("ids"))


@query(
    "q2_truncate",
    sql_encoded(f"SELECT doc_id, array_to_string(ids[1:{COMMENT_LIMIT}], ' ') AS ids FROM encoded"),
)
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _ = encoded_comments(spark, sf_dir)
    return ids.select("doc_id", joined(Q.truncate(F.col("ids"), COMMENT_LIMIT)).alias("ids"))


@query(
    "q3_pad",
    sql_encoded(
        f"""SELECT doc_id, len(list_resize(ids, {AST_LIMIT}, 0)) AS n,
  array_to_string(list_resize(ids, {AST_LIMIT}, 0), ' ') AS ids FROM encoded"""
    ),
)
def pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _ = encoded_comments(spark, sf_dir)
    padded = Q.pad(F.col("ids"), AST_LIMIT, 0)
    return ids.select("doc_id", F.size(padded).cast("long").alias("n"), joined(padded).alias("ids"))


@query(
    "q4_shift",
    sql_encoded(
        f"""SELECT doc_id, array_to_string(list_transform(range(1, {COMMENT_LIMIT} + 1), lambda t:
    CASE WHEN t < len(ids) AND t < {COMMENT_LIMIT} THEN ids[t + 1]::VARCHAR
         WHEN t = {COMMENT_LIMIT} AND len(ids) > {COMMENT_LIMIT} THEN '-' ELSE '0' END), ' ') AS targets
FROM encoded"""
    ),
)
def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _ = encoded_comments(spark, sf_dir)
    return ids.select("doc_id", joined(Q.shifted_targets(F.col("ids"), COMMENT_LIMIT, 0)).alias("targets"))


@query(
    "q5_one_hot",
    sql_encoded(
        f"""SELECT token_id::BIGINT AS token_id, count(*) AS ones, count(DISTINCT slot) AS slots FROM (
  SELECT unnest(list_resize(ids, {COMMENT_LIMIT}, 0)) AS token_id, unnest(range({COMMENT_LIMIT})) AS slot
  FROM encoded) GROUP BY 1"""
    ),
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column sums of the indicator tensor, which itself stays implicit."""
    ids, _ = encoded_comments(spark, sf_dir)
    cells = Q.one_hot_cells(ids, "doc_id", Q.pad(F.col("ids"), COMMENT_LIMIT, 0))
    return cells.groupBy(F.col("token_id").cast("long").alias("token_id")).agg(
        F.count(F.lit(1)).alias("ones"), F.count_distinct("slot").alias("slots")
    )


@query(
    "q6_map_tokens",
    """SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda t:
  CASE WHEN length(t) > 3 THEN reverse(t) ELSE t END), ' ') AS out FROM documents""",
)
def map_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = F.transform(
        F.split("text", " "), lambda t: F.when(F.length(t) > 3, F.reverse(t)).otherwise(t)
    )
    return inputs.texts(spark, sf_dir).select("doc_id", F.array_join(mapped, " ").alias("out"))


@query("q7_join_tokens", "SELECT doc_id, replace(text, ' ', '') AS out FROM documents")
def join_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.texts(spark, sf_dir).select(
        "doc_id", F.array_join(F.split("text", " "), "").alias("out")
    )


@query(
    "j7_zip",
    with_inputs(
        "vector_pairs",
        """SELECT vec_id, i, a[i + 1]::DOUBLE AS l, b[i + 1]::DOUBLE AS r
FROM (SELECT *, unnest(range(len(a))) AS i FROM vector_pairs)""",
    ),
)
def zip_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.vector_pairs(spark, sf_dir)
        .select("vec_id", F.posexplode(Q.zip_elements(F.col("a"), F.col("b"))).alias("i", "e"))
        .select(
            "vec_id",
            F.col("i").cast("long").alias("i"),
            F.col("e.left").cast("double").alias("l"),
            F.col("e.right").cast("double").alias("r"),
        )
    )


# --- subwords --------------------------------------------------------------------------

_RUNS = r"unnest(regexp_extract_all({}, '([\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+)', 1))"
_SUBWORDS = f"""WITH words AS (SELECT word, count(*) AS n FROM (
  SELECT {_RUNS.format('text')} AS word FROM documents) GROUP BY 1),
pieces AS (SELECT substr(word, i, l) AS piece, sum(n)::BIGINT AS n FROM (
  SELECT word, n, i, unnest(range(1, length(word) - i + 2)) AS l FROM (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)) GROUP BY 1),
chosen AS (SELECT piece, n FROM pieces WHERE length(piece) = 1 UNION ALL
  SELECT piece, n FROM (SELECT piece, n, row_number() OVER (ORDER BY n DESC, piece) AS r
    FROM pieces WHERE length(piece) > 1)
  WHERE r <= {subwords.TARGET_SIZE} - (SELECT count(*) FROM pieces WHERE length(piece) = 1)),
subwords AS (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) AS id, n FROM chosen)"""


def document_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.build_subwords(inputs.texts(spark, sf_dir), "text")


@query("v3_subwords", f"{_SUBWORDS}\nSELECT piece, id, n FROM subwords")
def subword_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subwords(spark, sf_dir).select("piece", F.col("id").cast("long").alias("id"), "n")


@query(
    "v4_encode",
    f"""{_SUBWORDS.replace('WITH ', 'WITH RECURSIVE ', 1)},
steps AS (
  SELECT word, 1 AS p0, 0 AS step, NULL::BIGINT AS id FROM words
  UNION ALL
  SELECT word, p0 + width, step + 1, new_id FROM (
    SELECT s.word, s.p0, s.step, length(p.piece) AS width, p.id AS new_id
    FROM (SELECT word, p0, step, unnest(range(1, length(word) - p0 + 2)) AS l
          FROM steps WHERE p0 <= length(word)) s
    JOIN subwords p ON p.piece = substr(s.word, s.p0, s.l)
    QUALIFY row_number() OVER (PARTITION BY s.word, s.p0 ORDER BY s.l DESC) = 1)),
encoded_words AS (SELECT word, list(id ORDER BY step) AS ids FROM steps WHERE step > 0 GROUP BY 1),
doc_runs AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (
  SELECT doc_id, regexp_extract_all(text,
    '([\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+)', 1) AS ws FROM documents))
SELECT doc_id, array_to_string(ids, ' ') AS ids, len(ids) AS n_ids, text AS decoded
FROM (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM doc_runs JOIN encoded_words USING (word) GROUP BY 1)
JOIN documents USING (doc_id)""",
)
def encode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode: the decoded text must be the text itself."""
    vocab = materialise(document_subwords(spark, sf_dir))
    docs = inputs.texts(spark, sf_dir)
    ids = docs.select("doc_id", subwords.encode_subwords(vocab, F.col("text")).alias("ids"))
    return ids.select(
        "doc_id",
        joined(F.col("ids")).alias("ids"),
        F.size("ids").cast("long").alias("n_ids"),
        subwords.decode_subwords(vocab, F.col("ids")).alias("decoded"),
    )


# --- training tensors, both sides -----------------------------------------------------

SIDES = {"ast": AST_LIMIT, "comments": COMMENT_LIMIT}
_PATTERN = r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+)"


def sql_side(side: str) -> dict[str, str]:
    """CTEs from the entries' column to ``<side>_bounded``: ids between start and end."""
    size = subwords.TARGET_SIZE
    w, s = f"{side}_words", f"{side}_steps"
    runs = f"regexp_extract_all({side}, '{_PATTERN}', 1)"
    return {
        w: f"SELECT word, count(*) AS n FROM (SELECT unnest({runs}) AS word FROM length_mix) GROUP BY ALL",
        f"{side}_pieces": f"""SELECT substr(word, i, l) AS piece, sum(n)::BIGINT AS n
FROM (SELECT *, unnest(range(1, length(word) - i + 2)) AS l
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM {w})) GROUP BY ALL""",
        f"{side}_ids": f"""SELECT piece, row_number() OVER (ORDER BY n DESC, piece) AS id FROM {side}_pieces
WHERE length(piece) = 1 OR piece IN (SELECT piece FROM {side}_pieces WHERE length(piece) > 1
  ORDER BY n DESC, piece LIMIT greatest(0, {size} - (SELECT count(*) FROM {side}_pieces WHERE length(piece) = 1)))""",
        s: f"""SELECT word, 1 AS place, 0 AS step, NULL::BIGINT AS id FROM {w}
UNION ALL SELECT word, place + width, step + 1, id FROM (
  SELECT x.word, x.place, x.step, length(p.piece) AS width, p.id
  FROM (SELECT word, place, step, unnest(range(1, length(word) - place + 2)) AS l
    FROM {s} WHERE place <= length(word)) x JOIN {side}_ids p ON p.piece = substr(x.word, x.place, x.l)
  QUALIFY row_number() OVER (PARTITION BY x.word, x.place ORDER BY x.l DESC) = 1)""",
        f"{side}_coded": f"SELECT word, list(id ORDER BY step) AS ids FROM {s} WHERE step > 0 GROUP BY ALL",
        f"{side}_bounded": f"""SELECT id, list_concat([base], coalesce(ids, []), [base + 1]) AS ids, base + 1 AS fill
FROM length_mix CROSS JOIN (SELECT max(id) + 257 AS base FROM {side}_ids)
LEFT JOIN (SELECT r.id, flatten(list(c.ids ORDER BY i)) AS ids FROM (
    SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT id, {runs} AS ws FROM length_mix)) r
  JOIN {side}_coded c USING (word) GROUP BY ALL) e USING (id)""",
    }


def sql_tensors(value: str) -> str:
    """``id`` and one blank-joined column per side; ``value`` gives element i of n."""
    columns = ", ".join(
        f"""array_to_string(list_transform(range(1, {limit} + 1), lambda i: coalesce(({
            value.format(t=side, limit=limit)})::VARCHAR, '')), ' ') AS {side}"""
        for side, limit in SIDES.items()
    )
    ctes = {name: sql for side in SIDES for name, sql in sql_side(side).items()}
    body = f"SELECT id, {columns} FROM ast_bounded AS ast JOIN comments_bounded AS comments USING (id)"
    return with_inputs("length_mix", body, **ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def tensors(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Fixed-length sequences of structure and comment subwords, each with its own vocabulary."""
    entries = materialise(inputs.length_mix(spark, sf_dir).select("id", *SIDES))
    for side, limit in SIDES.items():
        vocab = materialise(subwords.build_subwords(entries.select(side), side))
        coded = entries.withColumn("_ids", subwords.encode_subwords(vocab, F.col(side)))
        first = subwords.first_free_id(vocab)
        entries = subwords.training_sequences(coded, "_ids", first, limit, f"{side}_").drop("_ids")

    def listed(side: str) -> Column:
        values = F.transform(f"{side}_{kind}", lambda x: F.coalesce(x.cast("string"), F.lit("")))
        return F.array_join(values, " ").alias(side)

    return entries.select("id", *map(listed, SIDES))


@query(
    "q8_training_inputs",
    sql_tensors("CASE WHEN i <= len({t}.ids) THEN {t}.ids[i] ELSE {t}.fill END"),
)
def training_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors(spark, sf_dir, "inputs")


@query(
    "q9_training_targets",
    sql_tensors(
        "CASE WHEN i < least(len({t}.ids), {limit}) THEN {t}.ids[i + 1] "
        "WHEN i = {limit} AND len({t}.ids) > {limit} THEN NULL ELSE {t}.fill END"
    ),
)
def training_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors(spark, sf_dir, "targets")


# --- vectors ------------------------------------------------------------------------------


#: Vectors trained by this application, by their source; both queries read the stored table.
_TRAINED: dict[tuple[str, ...], DataFrame] = {}


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors of the documents, trained once for the same files and stored."""
    source = inputs.texts(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(source.inputFiles()))
    if key not in _TRAINED:
        _TRAINED[key] = embedding.train_word_vectors(source, F.split("text", " "))
    return _TRAINED[key]


@query("v1_word_vectors")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_vectors(spark, sf_dir).select(
        "word", F.size("vector").cast("long").alias("dimensions"), F.array_join(F.transform("vector", lambda x: F.round(x.cast("double"), 4).cast("string")), " ").alias("vector")
    )


@query(
    "v1_trained_words",
    f"""SELECT word, count(*) AS n, {embedding.DIMENSIONS}::BIGINT AS dimensions, true AS finite
FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL HAVING n >= {embedding.MIN_COUNT}""",
)
def trained_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that is frequent enough has a vector of finite numbers."""
    counts = vocabulary.word_counts(
        inputs.texts(spark, sf_dir), F.split("text", " "), embedding.MIN_COUNT
    )
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return counts.join(document_vectors(spark, sf_dir), "word").select(
        "word", "n", F.size("vector").cast("long").alias("dimensions"), finite.alias("finite")
    )


#: Words of the vocabulary whose vectors are exact, so that SQL can state their products.
EXACT_WORDS = 256


def _ratio_sql(source: str, tokens: str, words: str) -> str:
    """CTEs to ``ratios``: the shifted log ratios of the words' co-occurrences."""
    return f"""split_rows AS (SELECT row_number() OVER () AS r, string_split({tokens}, ' ') AS ws FROM {source}),
tokens AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM split_rows),
words AS ({words}),
kept AS (SELECT * FROM tokens SEMI JOIN words USING (word)),
near AS (SELECT r, word, i + d AS j FROM (SELECT *, unnest([-7, -6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5, 6, 7]) AS d FROM kept)),
pairs AS (SELECT n.word AS center, k.word AS context, count(*) AS n
  FROM near n JOIN kept k ON k.r = n.r AND k.i = n.j GROUP BY ALL),
totals AS (SELECT center AS word, sum(n)::DOUBLE AS total FROM pairs GROUP BY ALL),
ratios AS (SELECT center, context,
    ln(n / (a.total * b.total / (SELECT sum(total) FROM totals))) - ln({float(embedding.NEGATIVE)}) AS value
  FROM pairs JOIN totals a ON a.word = center JOIN totals b ON b.word = context),
positive AS (SELECT * FROM ratios WHERE value > 0),
products AS (SELECT a.center, b.center AS context, sum(a.value * b.value) AS product
  FROM positive a JOIN positive b ON b.context = a.context GROUP BY ALL)"""


_FREQUENT = f"SELECT word FROM tokens GROUP BY word ORDER BY count(*) DESC, word LIMIT {EXACT_WORDS}"
_PRODUCTS = """SELECT p.center, p.context, round(coalesce(q.product, 0), 4) AS product
FROM positive p LEFT JOIN products q USING (center, context)"""


def exact_vectors(rows: DataFrame, tokens: Column, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors as wide as the vocabulary, whose products are those of the matrix' rows, and its entries."""
    entries = embedding.log_ratios(rows, tokens, words)
    vectors = materialise(embedding.factorised(entries, words, words.count(), power=1.0))
    named = (
        entries.join(words.select(F.col("id").alias("i"), F.col("word").alias("center")), "i")
        .join(words.select(F.col("id").alias("j"), F.col("word").alias("context")), "j")
        .select("center", "context")
    )
    return vectors, named


def _products(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    found = embedding.similarity(vectors, pairs)
    return found.select("center", "context", (F.round("product", 4) + F.lit(0.0)).alias("product"))


def frequent_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, tokens = inputs.texts(spark, sf_dir), F.split("text", " ")
    return exact_vectors(docs, tokens, embedding.numbered_words(docs, tokens, 1, EXACT_WORDS))


@query("v1_products", f"WITH {_ratio_sql('documents', 'text', _FREQUENT)}\n{_PRODUCTS}")
def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the vectors of frequent words that occur together: the matrix is rebuilt."""
    return _products(*frequent_vectors(spark, sf_dir))


@query(
    "v1_neighbours",
    f"""WITH {_ratio_sql('documents', 'text', _FREQUENT)},
sizes AS (SELECT center AS word, sqrt(product) AS size FROM products WHERE center = context),
cosines AS (SELECT p.center AS word, p.context AS neighbour,
    round(coalesce(q.product, 0) / (a.size * b.size), 6) AS cosine
  FROM positive p LEFT JOIN products q USING (center, context)
  JOIN sizes a ON a.word = p.center JOIN sizes b ON b.word = p.context WHERE p.center <> p.context)
SELECT word, neighbour, cosine FROM cosines
QUALIFY row_number() OVER (PARTITION BY word ORDER BY cosine DESC, neighbour) = 1""",
)
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of the words that a frequent word occurs with."""
    return embedding.nearest(*frequent_vectors(spark, sf_dir))


@query(
    "v1_structure_vectors",
    with_inputs("length_mix", "")[:-1]
    + f",\n{_ratio_sql('length_mix', 'ast', 'SELECT DISTINCT word FROM tokens')}\n{_PRODUCTS}",
)
def structure_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure side: every token of the trees has a vector, also those seen once."""
    trees = materialise(inputs.length_mix(spark, sf_dir).select("ast"))
    tokens = F.split("ast", " ")
    words = embedding.numbered_words(trees, tokens, embedding.MIN_COUNT_STRUCTURES)
    return _products(*exact_vectors(trees, tokens, words))


@query("v2_projection")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.project(document_vectors(spark, sf_dir))


_FAR = 0.001


@query(
    "m2_vector_diff",
    with_inputs(
        "vector_pairs",
        f"""SELECT vec_id, i, l, r FROM (SELECT vec_id, i, a[i + 1]::DOUBLE AS l, b[i + 1]::DOUBLE AS r
FROM (SELECT *, unnest(range(len(a))) AS i FROM vector_pairs)) WHERE abs(l - r) > {_FAR}""",
    ),
)
def vector_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.vector_pairs(spark, sf_dir)
        .select("vec_id", F.explode(Q.differing(F.col("a"), F.col("b"), _FAR)).alias("e"))
        .select(
            "vec_id",
            F.col("e.pos").cast("long").alias("i"),
            F.col("e.left").cast("double").alias("l"),
            F.col("e.right").cast("double").alias("r"),
        )
    )


@query(
    "m3_vector_equality",
    with_inputs(
        "vector_pairs",
        "SELECT vec_id, (a = a)::INT::BIGINT AS same, (a = b)::INT::BIGINT AS next FROM vector_pairs",
    ),
)
def vector_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.vector_pairs(spark, sf_dir).select(
        "vec_id",
        Q.equal_vectors(F.col("a"), F.col("a")).cast("long").alias("same"),
        Q.equal_vectors(F.col("a"), F.col("b")).cast("long").alias("next"),
    )


# --- decoding --------------------------------------------------------------------------------

_BEST = """SELECT example, step, token, score FROM scores
QUALIFY row_number() OVER (PARTITION BY example, step ORDER BY score DESC, token) = 1"""
_DECODED = """SELECT example, coalesce(list(token ORDER BY step) FILTER (WHERE step < stop), []) AS tokens
FROM (SELECT *, coalesce(min(step) FILTER (WHERE token = 0) OVER (PARTITION BY example), 8) AS stop
      FROM best) GROUP BY 1"""


@query("a12_arg_max", with_inputs("scores", _BEST))
def arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.best_tokens(inputs.scores(spark, sf_dir)).select(
        "example", F.col("step").cast("long").alias("step"), F.col("token").cast("long").alias("token"), "score"
    )


@query(
    "a12_arg_max_array",
    """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings""",
)
def arg_max_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = readers.read_table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", Q.arg_max(F.col("embedding")).cast("long").alias("best"))


@query(
    "v5_greedy_decode",
    with_inputs(
        "scores",
        "SELECT example, len(tokens) AS n, array_to_string(tokens, ' ') AS tokens FROM decoded",
        best=_BEST,
        decoded=_DECODED,
    ),
)
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.greedy_decode(inputs.scores(spark, sf_dir), end_token=0, limit=8).select(
        "example", F.size("tokens").cast("long").alias("n"), joined(F.col("tokens")).alias("tokens")
    )


ALPHABET = ["<end>", "<eol>", ">(", ">)", "returns", "the", "value", "of"]

_SPELLED = f"""SELECT example, list_transform(tokens, lambda t: {ALPHABET!r}[t + 1]) AS ts FROM decoded"""
_PIECES = """SELECT example, array_to_string(list_transform(ts, lambda t, i: CASE
    WHEN t = '<eol>' THEN chr(10)
    WHEN starts_with(t, '>') THEN (CASE WHEN i = 1 OR ts[i - 1] = '<eol>' OR starts_with(ts[i - 1], '>')
      THEN '' ELSE ' ' END) || t[2]
    ELSE (CASE WHEN i = 1 OR ts[i - 1] = '<eol>' THEN '' ELSE ' ' END) || t END), '') AS comment
FROM spelled"""


@query(
    "t17_detokenise",
    with_inputs("scores", _PIECES, best=_BEST, decoded=_DECODED, spelled=_SPELLED),
)
def detokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decoding.greedy_decode(inputs.scores(spark, sf_dir), end_token=0, limit=8)
    return decoded.select(
        "example", detokenise(decoding.spell(F.col("tokens"), ALPHABET)).alias("comment")
    )


# --- spans ---------------------------------------------------------------------------------------


@query(
    "j8_innermost_span",
    with_inputs(
        "spans cursors",
        """SELECT c.cursor_id, c.doc_id, c.off, s.start_off::BIGINT AS span_start,
  s.end_off::BIGINT AS span_end
FROM cursors c LEFT JOIN spans s
  ON s.doc_id = c.doc_id AND s.start_off <= c.off AND c.off < s.end_off
QUALIFY row_number() OVER (PARTITION BY c.cursor_id ORDER BY s.end_off - s.start_off, s.start_off) = 1""",
    ),
)
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.innermost_span(inputs.cursors(spark, sf_dir), inputs.spans(spark, sf_dir))
    return found.select(
        "cursor_id", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("off", "span_start", "span_end")]
    )
