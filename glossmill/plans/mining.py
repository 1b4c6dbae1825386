"""Queries on the activity log and on mined functions: stars, ranking, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import popularity, ranking, shards
from glossmill.operators.extraction import extract_functions, register_sql
from glossmill.operators.vocabulary import dense_ids
from glossmill.plans import inputs
from glossmill.plans.oracle_inputs import statements, with_inputs
from glossmill.plans.registry import query
from glossmill.session import materialise, scratch_path
from glossmill.sources.readers import read_shards

CLICK = "click"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(name: str) -> Column:
    return F.date_format(name, STAMP).alias(name)


def sql_stamp(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def stars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.stars_table(inputs.watch_log(spark, sf_dir), CLICK)


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.watch_events(inputs.watch_log(spark, sf_dir), CLICK)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.repository_profile(clicks(spark, sf_dir))


CLICKS = "type = 'click' AND repo_id IS NOT NULL"
PROFILE = f"""SELECT g.repo_id, list_sort(list_distinct(list(g.repo_name))) AS repo_names,
  len(list_distinct(list(g.actor_id)))::BIGINT AS stars, min(g.created_at) AS first_star_date,
  max(g.created_at) AS last_star_date FROM watch_log g WHERE {CLICKS} GROUP BY ALL"""


# --- scans -----------------------------------------------------------------


@query(
    "s1_shard_scan",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events, count(DISTINCT user_id) AS n_users
FROM events GROUP BY 1""",
)
def shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_shards(spark, f"{sf_dir}/event*.parquet")
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users")
    )


DAY = "yyyyMMdd"


def _sharded(spark: SparkSession, sf_dir: str) -> str:
    """The log written in shards of a day; the path."""
    path = scratch_path(spark, "log")
    shards.write_shards(inputs.watch_log(spark, sf_dir), path, DAY)
    return path


@query(
    "s1_shard_states",
    with_inputs(
        "stars_table",
        f"SELECT repo_id, stars, repo_name, {sql_stamp('last_star_date')}, {sql_stamp('first_star_date')} FROM stars_table",
    ),
)
def shard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars table from states of the shards, the later half of which arrives later."""
    path, state = _sharded(spark, sf_dir), scratch_path(spark, "states")
    names = sorted(shards.shards_in(spark, path))
    arrived = scratch_path(spark, "arrived")
    for part in (names[: len(names) // 2], names[len(names) // 2 :]):
        if part:
            some = shards.read_period(spark, path, part[0], part[-1]).drop(shards.SHARD)
            shards.write_shards(some, arrived, DAY)
            shards.update_states(spark, arrived, state, CLICK)
    found = shards.merged_table(spark, state)
    return found.select("repo_id", "stars", "repo_name", stamp("last_star_date"), stamp("first_star_date"))


@query(
    "s1_period",
    with_inputs(
        "watch_log",
        f"""SELECT repo_id, count(DISTINCT actor_id) AS stars FROM watch_log
WHERE {CLICKS} AND created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20' GROUP BY 1""",
    ),
)
def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars within ten of the shards."""
    log = shards.read_period(spark, _sharded(spark, sf_dir), "20240110", "20240119")
    return popularity.repository_stars(popularity.watch_events(log, CLICK))


@query(
    "s2_array_scan",
    with_inputs(
        "contents",
        """SELECT id, len(paths) AS n_paths, array_to_string(paths, '|') AS all_paths,
  length(content) AS content_length FROM contents""",
    ),
)
def array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.contents(spark, sf_dir).select(
        "id",
        F.size("paths").cast("long").alias("n_paths"),
        F.array_join("paths", "|").alias("all_paths"),
        F.length("content").cast("long").alias("content_length"),
    )


# --- projections -----------------------------------------------------------


@query(
    "p1_alias",
    with_inputs("watch_log", "SELECT repo_id, type AS event_type, actor_id FROM watch_log"),
)
def alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.watch_log(spark, sf_dir).select(
        F.col("repo.id").alias("repo_id"),
        F.col("type").alias("event_type"),
        F.col("actor.id").alias("actor_id"),
    )


_RANKED = with_inputs(
    "watch_log",
    f"""SELECT repo_id, stars, n.repo_name, {sql_stamp('last_star_date')}, rank() OVER latest AS rn
FROM profile, unnest(repo_names) AS n(repo_name)
WINDOW latest AS (PARTITION BY n.repo_name ORDER BY last_star_date DESC, repo_id DESC)""",
    profile=PROFILE,
)


@query("p2_star_plus", _RANKED)
def star_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.ranked_names(profile(spark, sf_dir)).select(
        "repo_id", "stars", "repo_name", stamp("last_star_date"), F.col("rn").cast("long").alias("rn")
    )


@query("p3_star_except", with_inputs("contents", "SELECT id, content FROM contents"))
def star_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.contents(spark, sf_dir).drop("paths")


@query(
    "p4_struct_fields",
    with_inputs("watch_log", f"SELECT repo_id, repo_name, actor_id, {sql_stamp('created_at')} FROM watch_log"),
)
def struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.watch_log(spark, sf_dir).select(
        F.col("repo.id").alias("repo_id"),
        F.col("repo.name").alias("repo_name"),
        F.col("actor.id").alias("actor_id"),
        stamp("created_at"),
    )


@query(
    "p5_array_offset",
    with_inputs(
        "contents",
        """SELECT id, path, string_split(path, '/')[1] AS owner, string_split(path, '/')[2] AS name,
  coalesce(string_split(path, '/')[9], 'none') AS ninth
FROM (SELECT id, unnest(paths) AS path FROM contents)""",
    ),
)
def array_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("path", "/")
    return (
        inputs.contents(spark, sf_dir)
        .select("id", F.explode("paths").alias("path"))
        .select(
            "id",
            "path",
            F.get(parts, 0).alias("owner"),
            F.get(parts, 1).alias("name"),
            F.coalesce(F.get(parts, 8), F.lit("none")).alias("ninth"),
        )
    )


@query(
    "p6_repo_key",
    with_inputs(
        "contents",
        """SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS repo,
  count(*) AS n FROM (SELECT unnest(paths) AS path FROM contents) GROUP BY 1""",
    ),
)
def repo_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.contents(spark, sf_dir)
        .select(F.explode("paths").alias("path"))
        .groupBy(ranking.repo_of_path(F.col("path")).alias("repo"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- filters ---------------------------------------------------------------


@query(
    "f1_equality",
    with_inputs(
        "watch_log",
        f"SELECT repo_name, actor_id, {sql_stamp('created_at')} FROM watch_log WHERE type = 'click'",
    ),
)
def equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.watch_log(spark, sf_dir)
        .filter(F.col("type") == CLICK)
        .select(F.col("repo.name").alias("repo_name"), F.col("actor.id").alias("actor_id"), stamp("created_at"))
    )


@query(
    "f2_not_null",
    with_inputs("watch_log", f"SELECT repo_id, repo_name, actor_id FROM watch_log WHERE {CLICKS}"),
)
def not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).select("repo_id", "repo_name", "actor_id")


@query(
    "f3_pattern",
    with_inputs(
        "watch_log",
        """SELECT repo_name, count(*) AS n FROM watch_log WHERE repo_name LIKE '%/%' GROUP BY 1""",
    ),
)
def pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs.watch_log(spark, sf_dir)
        .select(F.col("repo.name").alias("repo_name"))
        .filter(F.col("repo_name").like("%/%"))
        .groupBy("repo_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "f4_length",
    with_inputs(
        "function_lines",
        "SELECT doc_id, line, length(comments) AS n FROM function_lines WHERE length(comments) >= 2",
    ),
)
def length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.commented(inputs.function_lines(spark, sf_dir)).select(
        "doc_id", F.col("line").cast("long").alias("line"), F.length("comments").cast("long").alias("n")
    )


_STARS = f"""SELECT repo_id, stars, repo_name, {sql_stamp('last_star_date')},
  {sql_stamp('first_star_date')} FROM stars_table"""


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars_of(spark, sf_dir).select(
        "repo_id", "stars", "repo_name", stamp("last_star_date"), stamp("first_star_date")
    )


@query("f5_rank_filter", with_inputs("stars_table", "SELECT repo_id, repo_name FROM stars_table"))
def rank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars_of(spark, sf_dir).select("repo_id", "repo_name")


# --- unnest and lookups ----------------------------------------------------


@query(
    "j1_unnest",
    with_inputs("watch_log", "SELECT repo_id, unnest(repo_names) AS repo_name FROM profile", profile=PROFILE),
)
def unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, sf_dir).select("repo_id", F.explode("repo_names").alias("repo_name"))


@query(
    "j2_unnest_join",
    with_inputs(
        "functions",
        """SELECT id, path, count(*) AS copies FROM (SELECT id, unnest(paths) AS path FROM functions
WHERE length(comments) >= 2) GROUP BY 1, 2""",
    ),
)
def unnest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.function_paths(inputs.functions(spark, sf_dir))


_LOOKUP = """SELECT p.id, p.path, s.stars FROM
  (SELECT id, path, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS repo
   FROM (SELECT DISTINCT id, unnest(paths) AS path FROM functions WHERE length(comments) >= 2)) p
LEFT JOIN stars_table s ON s.repo_name = p.repo"""


@query(
    "j4_lookup",
    with_inputs("stars_table functions", f"SELECT id, max(stars) AS stars FROM ({_LOOKUP}) GROUP BY 1"),
)
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ranking.function_paths(inputs.functions(spark, sf_dir))
    stars = materialise(stars_of(spark, sf_dir))
    return ranking.lookup_stars(paths, stars).groupBy("id").agg(F.max("stars").alias("stars"))


# --- aggregates and windows ------------------------------------------------


@query(
    "a1_distinct_count",
    with_inputs(
        "watch_log",
        f"SELECT repo_id, count(DISTINCT actor_id) AS stars FROM watch_log WHERE {CLICKS} GROUP BY 1",
    ),
)
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.repository_stars(clicks(spark, sf_dir))


@query(
    "a2_min_max",
    with_inputs(
        "watch_log",
        f"""SELECT repo_id, {sql_stamp('first_star_date')}, {sql_stamp('last_star_date')} FROM (
  SELECT repo_id, min(created_at) AS first_star_date, max(created_at) AS last_star_date
  FROM watch_log WHERE {CLICKS} GROUP BY 1)""",
    ),
)
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        clicks(spark, sf_dir)
        .groupBy("repo_id")
        .agg(
            F.min("created_at").alias("first_star_date"), F.max("created_at").alias("last_star_date")
        )
        .select("repo_id", stamp("first_star_date"), stamp("last_star_date"))
    )


@query(
    "a3_distinct_array",
    with_inputs(
        "watch_log",
        """SELECT repo_id, array_to_string(repo_names, '|') AS repo_names, len(repo_names) AS n_names
FROM profile""",
        profile=PROFILE,
    ),
)
def distinct_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, sf_dir).select(
        "repo_id",
        F.array_join("repo_names", "|").alias("repo_names"),
        F.size("repo_names").cast("long").alias("n_names"),
    )


def _path_rows(view: str, size: int, keys: str = "id") -> str:
    """SQL of the run-length path arrays: ``size`` distinct paths a row."""
    return f"""SELECT {keys}, part, string_agg(path || '*' || copies, '|' ORDER BY path) AS paths,
  sum(copies)::BIGINT AS n FROM (
    SELECT *, ((row_number() OVER (PARTITION BY {keys} ORDER BY path) - 1) // {size})::BIGINT AS part
    FROM (SELECT {keys}, path, count(*) AS copies FROM (
      SELECT {keys}, unnest(paths) AS path FROM {view} WHERE length(comments) >= 2) GROUP BY ALL))
GROUP BY {keys}, part"""


def written(paths: str) -> Column:
    """A run-length array as text: ``path*copies`` joined by bars."""
    return F.array_join(F.transform(paths, lambda p: F.concat_ws("*", p.path, p.copies.cast("string"))), "|")


@query("a4_array_agg", with_inputs("function_lines", _path_rows("function_lines", 2)))
def array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of every id with their copies, two paths a row."""
    paths = materialise(ranking.function_paths(inputs.function_lines(spark, sf_dir)))
    return ranking.path_arrays(paths, size=2).select(
        "id",
        F.col("part").cast("long").alias("part"),
        written("paths").alias("paths"),
        F.aggregate("paths", F.lit(0).cast("long"), lambda n, p: n + p.copies).alias("n"),
    )


_FIRST = """QUALIFY row_number() OVER (PARTITION BY id ORDER BY line, "character",
  substr(md5(comments || chr(0) || text), 1, 15)) = 1"""


@query(
    "a5_any_value",
    with_inputs(
        "function_lines",
        f"""SELECT id, line, "character", comments, text FROM function_lines WHERE length(comments) >= 2
{_FIRST}""",
    ),
)
def any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_functions(ranking.numbered(inputs.function_lines(spark, sf_dir))).select(
        "id",
        F.col("line").cast("long").alias("line"),
        F.col("character").cast("long").alias("character"),
        "comments",
        "text",
    )


_RANKED_FUNCTIONS = f"""SELECT p.id, p.part, p.paths, t.n_paths, f.line, f."character", f.comments, f.text, l.stars
FROM paths p JOIN (SELECT id, sum(n)::BIGINT AS n_paths FROM paths GROUP BY 1) t USING (id)
JOIN (SELECT id, max(stars) AS stars FROM lookups GROUP BY 1) l USING (id)
LEFT JOIN (SELECT * FROM functions WHERE length(comments) >= 2 {_FIRST}) f ON f.id = p.id AND p.part = 0"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked functions with scalar columns for comparison."""
    stars = materialise(stars_of(spark, sf_dir))
    return ranking.rank_functions(inputs.functions(spark, sf_dir), stars).select(
        "id",
        F.col("part").cast("long").alias("part"),
        written("paths").alias("paths"),
        "n_paths",
        F.col("line").cast("long").alias("line"),
        F.col("character").cast("long").alias("character"),
        "comments",
        "text",
        "stars",
    )


_RANKED_SQL = with_inputs(
    "stars_table functions",
    _RANKED_FUNCTIONS,
    lookups=_LOOKUP,
    paths=_path_rows("functions", ranking.PART),
)


@query("a6_ranked_functions", _RANKED_SQL)
def ranked_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir)


@query(
    "a6_ranked_per_function",
    with_inputs(
        "stars_table function_lines",
        """SELECT f.id, f.line, string_agg(f.path || '*' || f.copies, '|' ORDER BY f.path) AS paths,
  sum(f.copies)::BIGINT AS n_paths, max(s.stars) AS stars, min(c.comments) AS comments
FROM (SELECT id, line, path, count(*) AS copies, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS repo
  FROM (SELECT id, line, unnest(paths) AS path FROM function_lines WHERE length(comments) >= 2) GROUP BY ALL) f
LEFT JOIN stars_table s ON s.repo_name = f.repo
JOIN (SELECT id, line, comments FROM function_lines WHERE length(comments) >= 2
  QUALIFY row_number() OVER (PARTITION BY id, line
    ORDER BY substr(md5(comments || chr(0) || text), 1, 15)) = 1) c ON c.id = f.id AND c.line = f.line
GROUP BY 1, 2""",
    ),
)
def ranked_per_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = materialise(stars_of(spark, sf_dir))
    return ranking.rank_functions(
        inputs.function_lines(spark, sf_dir), stars, ("id", "line", "character")
    ).select(
        "id",
        F.col("line").cast("long").alias("line"),
        written("paths").alias("paths"),
        "n_paths",
        "comments",
        "stars",
    )


@query("f12_popular", f"SELECT id, stars FROM ({_RANKED_SQL}) WHERE stars >= 20 AND part = 0")
def popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = materialise(stars_of(spark, sf_dir))
    ranked_rows = ranking.rank_functions(inputs.functions(spark, sf_dir), stars)
    return ranking.popular(ranked_rows, 20).filter("part = 0").select("id", "stars")


@query("w1_row_number", _RANKED)
def row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_plus(spark, sf_dir)


@query("w2_latest_per_key", with_inputs("stars_table", _STARS))
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stars(spark, sf_dir)


@query(
    "l1_window_sort",
    with_inputs(
        "watch_log",
        f"""SELECT repo_id, {sql_stamp('last_star_date')},
  dense_rank() OVER (ORDER BY last_star_date DESC) AS place FROM profile""",
        profile=PROFILE,
    ),
)
def window_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = profile(spark, sf_dir).select("repo_id", "last_star_date")
    placed = dense_ids(latest, F.col("last_star_date").desc(), F.col("repo_id"), first=1, out="place")
    return placed.select(
        "repo_id", stamp("last_star_date"), F.col("place").cast("long").alias("place")
    )


# --- extraction ------------------------------------------------------------

_SNIPPETS = """SELECT doc_id, i, s,
  CASE i % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 2 END AS height,
  '(a, b) { const q = "}"; let t = `${ {a} } }`; /* } */ let r = /[/}"]/; ' || {statements}
    || ' return a + b; }' AS tail,
  lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS before
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s,
             unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"""
_MINED = """SELECT doc_id, (top + CASE i % 4 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS line,
  CASE i % 4 WHEN 1 THEN 2 ELSE 0 END AS "character",
  CASE WHEN i % 4 = 3 THEN '// ' || before || chr(10) ELSE '' END || '/** ' || s || ' */' AS comments,
  CASE i % 4 WHEN 0 THEN 'function ' WHEN 3 THEN 'export async function ' ELSE '' END
    || 'fn_' || i || tail AS text,
  CASE i % 4 WHEN 1 THEN 'method' ELSE 'function' END AS kind, 'fn_' || i AS name, 'a,b' AS params,
  substr(tail, 8) AS body
FROM (SELECT *, coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM snippets)
WHERE i % 4 <> 2"""


MINED_VIEWS = {
    "snippets": _SNIPPETS.replace("{statements}", statements("s", "'a'", "'b'")),
    "mined": _MINED,
}


def mined_sql(body: str) -> str:
    return with_inputs("", body, **MINED_VIEWS)


@query("r1_extract", mined_sql("SELECT * FROM mined"))
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_functions(inputs.source_files(spark, sf_dir)).select(
        "doc_id",
        F.col("line").cast("long").alias("line"),
        F.col("character").cast("long").alias("character"),
        "comments",
        "text",
        "kind",
        "name",
        F.array_join("params", ",").alias("params"),
        "body",
    )


@query(
    "f11_block_body",
    mined_sql("SELECT doc_id, kind, count(*) AS n, max(length(body)) AS longest FROM mined GROUP BY 1, 2"),
)
def block_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        extract_functions(inputs.source_files(spark, sf_dir))
        .groupBy("doc_id", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.length("body")).cast("long").alias("longest"))
    )


@query(
    "j3_lateral_udtf", mined_sql('SELECT doc_id, line, "character", comments, text FROM mined')
)
def lateral_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql(spark, "glossmill_functions_of")
    files = inputs.source_files(spark, sf_dir)
    return spark.sql(
        """SELECT f.doc_id, bigint(m.line) AS line, bigint(m.character) AS character,
             m.comments, m.text
           FROM {files} f, LATERAL glossmill_functions_of(f.content) m""",
        files=files,
    )


@query("u1_array_function", mined_sql("SELECT doc_id, name, kind, comments FROM mined"))
def array_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array form of the registered function, unnested in SQL."""
    register_sql(spark, "glossmill_functions_of")
    return spark.sql(
        """SELECT doc_id, f.name, f.kind, f.comments FROM (
             SELECT doc_id, explode(glossmill_functions_of_array(content)) AS f FROM {files})""",
        files=inputs.source_files(spark, sf_dir),
    )
