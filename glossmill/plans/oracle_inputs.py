"""The derived inputs of ``inputs.py`` as SQL common table expressions.

``with_inputs("functions", body)`` prefixes a query with the views it names; views that
depend on others pull them in.
"""

from __future__ import annotations


def argument(s: str, nth: int) -> str:
    skip = "" if nth == 1 else r"[a-z]{3,}[^a-z]+(?:[a-z]{1,2}[^a-z]+)*"
    return f"coalesce(nullif(regexp_extract(lower({s}), '{skip}([a-z]{{3,}})', 1), ''), 'arg{nth}')"


def statements(s: str, a: str, b: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({s}), '([a-z]+)', 1), lambda w: "
        f"CASE length(w) % 3 WHEN 0 THEN w || '();' "
        f"WHEN 1 THEN 'let ' || w || ' = ' || {a} || ';' "
        f"ELSE 'if (' || w || ') {{ ' || {b} || '(); }}' END), ' ')"
    )


def code(name: str, a: str, b: str, body: str) -> str:
    return (
        f"'function ' || {name} || '(' || {a} || ', ' || {b} || ') {{ ' || {body} || "
        f"' return ' || {a} || ' + ' || {b} || '; }}'"
    )


_PATH = "source || '/' || lang || '/' || doc_id || '.ts'"

_MARKUP_TOKENS = r"regexp_extract_all(html, '(<!--(?s:.*?)-->|</?[A-Za-z][A-Za-z0-9]*[^<>]*>)', 1)"


def markup_structure(html: str = "html") -> str:
    """SQL for the bracketed tag string of a page."""
    name = "lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1))"
    tokens = _MARKUP_TOKENS.replace("(html,", f"({html},")
    kept = f"list_filter({tokens}, lambda t: NOT starts_with(t, '<!--'))"
    return (
        f"array_to_string(list_transform({kept}, lambda t: "
        f"CASE WHEN starts_with(t, '</') THEN ')' "
        f"WHEN ends_with(t, '/>') OR {name} IN "
        f"('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') "
        f"THEN {name} ELSE {name} || ' (' END), ' ')"
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "watch_log": (
        (),
        """SELECT event_type AS type,
  CASE WHEN event_id % 97 <> 0 THEN k END AS repo_id,
  CASE WHEN k % 13 = 0 THEN 'legacy' || k
       WHEN k >= 40 AND ts < TIMESTAMP '2024-01-10' THEN 'src' || (k % 25) || '/old'
       ELSE 'src' || (k % 25) || '/' || ['en','de','fr','es'][(k % 25) % 4 + 1] END AS repo_name,
  user_id AS actor_id, ts AS created_at
FROM (SELECT *, event_id % 60 AS k FROM events)""",
    ),
    "stars_table": (
        ("watch_log",),
        """WITH clicked AS (SELECT * FROM watch_log WHERE type = 'click' AND repo_id IS NOT NULL),
numbers AS (SELECT repo_id, count(DISTINCT actor_id) AS stars, min(created_at) AS first_star_date,
    max(created_at) AS last_star_date FROM clicked GROUP BY ALL),
owners AS (SELECT repo_name, arg_max(repo_id, (last_star_date, repo_id)) AS repo_id
  FROM (SELECT DISTINCT repo_name, repo_id FROM clicked WHERE contains(repo_name, '/')) n
  JOIN numbers USING (repo_id) GROUP BY ALL)
SELECT repo_id, stars, repo_name, last_star_date, first_star_date FROM owners JOIN numbers USING (repo_id)""",
    ),
    "contents": (
        (),
        f"""SELECT md5(text) AS id, list_sort(array_agg({_PATH})) AS paths, min(text) AS content
FROM documents GROUP BY 1""",
    ),
    "functions": (
        (),
        f"""SELECT doc_id, md5(text) AS id, [{_PATH}] AS paths, 0 AS line, 0 AS "character",
  '/**' || chr(10) || ' * <b>' || replace(text, chr(10), chr(10) || ' * ') || '</b> ' || name
  || chr(10) || CASE WHEN doc_id % 5 = 0 THEN
       ' * ```' || chr(10) || ' * ' || a || '()' || chr(10) || ' * ```' || chr(10) ELSE '' END
  || ' * @class Foo' || chr(10) || ' * @param ' || a || ' the ' || b || chr(10)
  || ' * see https://example.org/' || doc_id || '?q=1 ///' || chr(10) || ' */' AS comments,
  {code("name", "a", "b", statements("text", "a", "b"))} AS text,
  name, [a, b] AS params, lang, source
FROM (SELECT *, {argument("text", 1)} AS a, {argument("text", 2)} AS b,
        'fn_' || (doc_id % 100) AS name FROM documents)""",
    ),
    "function_lines": (
        (),
        f"""SELECT doc_id, id, paths, source, line, 0 AS "character",
  '/** ' || s || ' ' || name || chr(10) || ' * @param ' || a || chr(10) || ' */' AS comments,
  {code("name", "a", "b", statements("s", "a", "b"))} AS text, name, [a, b] AS params, s
FROM (SELECT *, {argument("s", 1)} AS a, {argument("s", 2)} AS b,
        'fn_' || ((doc_id + line) % 100) AS name
  FROM (SELECT doc_id, md5(text) AS id, [{_PATH}] AS paths, source,
          unnest(string_split(text, chr(10))) AS s,
          unnest(range(len(string_split(text, chr(10))))) AS line FROM documents))""",
    ),
    "vector_pairs": (
        (),
        """SELECT l.vec_id, l.embedding AS a, r.embedding AS b
FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1""",
    ),
    "scores": (
        (),
        """SELECT example, pos // 8 AS step, pos % 8 AS token, score FROM (
  SELECT vec_id AS example, unnest(range(len(embedding))) AS pos,
         unnest(embedding)::DOUBLE AS score FROM embeddings)""",
    ),
    "spans": (
        (),
        """SELECT DISTINCT doc_id, start_off, end_off FROM (
  SELECT doc_id, 0 AS start_off, length(text) AS end_off FROM documents
  UNION ALL
  SELECT doc_id, (end_off - len)::BIGINT, end_off::BIGINT FROM (
    SELECT doc_id, len, sum(len) OVER (PARTITION BY doc_id ORDER BY pos) + pos AS end_off FROM (
      SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS len,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)))""",
    ),
    "cursors": (
        (),
        """SELECT event_id AS cursor_id, d.doc_id, event_id % (n_chars + 50) AS off
FROM (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events) e
JOIN documents d ON d.doc_id = e.doc_id""",
    ),
    "length_mix": (
        (),
        f"""SELECT d.id, 0 AS line, 0 AS "character", source, comments, ast
FROM (SELECT doc_id, doc_id AS id, source, text AS comments FROM documents
  UNION ALL SELECT doc_id, -1 - doc_id, source, '' FROM documents WHERE doc_id % 50 = 0) d JOIN (SELECT page_id, {markup_structure()} AS ast FROM pages) p
  ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)""",
    ),
}


def with_inputs(names: str, body: str, **extra: str) -> str:
    """``body`` preceded by the views ``names`` (blank-separated) and ``extra`` ones."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        needs, sql = VIEWS[name]
        for n in needs:
            add(n)
        ordered.setdefault(name, sql)

    for n in names.split():
        add(n)
    ordered.update(extra)
    ctes = ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in ordered.items())
    return f"WITH {ctes}\n{body}" if ctes else body
