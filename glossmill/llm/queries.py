"""The registered queries of the operators, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import (
    bitplanes,
    bpe,
    html_blocks,
    importance,
    line_runs,
    ngram_join,
    quality,
    secrets,
    tiling,
    token_counts,
    toxicity,
    warc,
    whitening,
)
from glossmill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, in archives that are normalised and read back."""
    rows = warc.with_targets(table(spark, sf_dir, "pages"))
    archives = warc.normalise(warc.write_archives(rows))
    return warc.read_records(archives).drop("url")


ORACLES["op1_warc_normalise"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100
        THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
    FROM d
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by pre-token frequencies."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the texts they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path)


@query
def op9_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as planes and read back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bitplanes.read_ids(bitplanes.write_ids(table(spark, sf_dir, "documents"), path))


@query
def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that leak into them."""
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the quality rules keep."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document by links of shingle sets."""
    return ngram_join.groups(table(spark, sf_dir, "documents"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: numbers by kind, digest of the base spans, all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id",
        secrets.counted(F.col("base"), 0).alias("n_assign"),
        secrets.counted(F.col("base"), 1).alias("n_access"),
        secrets.counted(F.col("base"), 2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, towards the benchmark's word pairs."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every embedding; a deviation beyond 64 bits is null."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after those of earlier documents go."""
    return line_runs.dedup_lines(table(spark, sf_dir, "documents"))


# CRC-32 is linear: each byte's share depends on the byte and on its distance from the end.
ORACLES["op11_importance_resampling"] = r"""
WITH RECURSIVE octet AS (
    SELECT n, list_reduce(list_prepend(n::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS n)
), texts AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
    UNION ALL
    SELECT 'b', NULL, -row_number() OVER (),
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark
), words AS (
    SELECT r, side, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM texts
), runs AS (
    SELECT r, side, w AS f FROM words
    UNION ALL
    SELECT r, side, f FROM (
        SELECT r, side, w || ' ' || lead(w) OVER (PARTITION BY r ORDER BY i) AS f FROM words) WHERE f IS NOT NULL
), feats AS (
    SELECT r, side, f, count(*) AS c FROM runs GROUP BY ALL
), distinct_feats AS (
    SELECT f, hex(encode(f)) AS hx, octet_length(encode(f)) AS len FROM (SELECT DISTINCT f FROM feats)
), share(d, b, v) AS (
    SELECT 0, n, v FROM octet
    UNION ALL
    SELECT d + 1, b, xor(s.v >> 8, o.v) FROM share s JOIN octet o ON o.n = s.v & 255
    WHERE d < (SELECT max(len) FROM distinct_feats)
), start(d, v) AS (
    SELECT 0, 4294967295::BIGINT
    UNION ALL
    SELECT d + 1, xor(s.v >> 8, o.v) FROM start s JOIN octet o ON o.n = s.v & 255
    WHERE d < (SELECT max(len) FROM distinct_feats)
), octets AS (
    SELECT f, len, unnest(range(len)) AS p, hx FROM distinct_feats
), parts AS (
    SELECT f, any_value(len) AS len, bit_xor(s.v) AS v
    FROM (SELECT f, len, len - 1 - p AS d, ('0x' || substr(hx, (2 * p + 1)::BIGINT, 2))::BIGINT AS b FROM octets) x
    JOIN share s USING (d, b) GROUP BY f
), buckets AS (
    SELECT f, xor(xor(p.v, z.v), 4294967295) % 10000 AS bucket FROM parts p JOIN start z ON z.d = p.len
), hist AS (
    SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0)::DOUBLE AS s,
        coalesce(sum(c) FILTER (side = 'b'), 0)::DOUBLE AS t
    FROM feats JOIN buckets USING (f) GROUP BY bucket
), gain AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM hist) + 10000)
        / ((s + 1) * ((SELECT sum(t) FROM hist) + 10000))))::BIGINT AS g FROM hist
), sums AS (
    SELECT r, sum(c)::BIGINT AS n_features, sum(c * g)::BIGINT AS total
    FROM feats JOIN buckets USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
), weighted AS (
    SELECT doc_id, r, len(ws) AS n_words, coalesce(n_features, 0) AS n_features,
        CASE WHEN total IS NULL THEN 0 WHEN total % n_features < 0 THEN total // n_features - 1
            ELSE total // n_features END AS weight,
        ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h
    FROM texts LEFT JOIN sums USING (r) WHERE side = 'd'
), scored AS (
    SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM weighted
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_words >= 20) OVER () AS asked
    FROM scored
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_words >= 20 AND place <= 25 * asked // 100 THEN place END AS rank
FROM placed
"""

ORACLES["op13_line_runs"] = r"""
WITH split AS (
    SELECT doc_id, l, p, trim(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
    FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), held AS (
    SELECT k, min(doc_id) AS first_doc FROM split WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT s.*, coalesce(s.doc_id <> h.first_doc, false) AS gone FROM split s LEFT JOIN held h USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
