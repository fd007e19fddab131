"""Queries over the driver's tables, one for each operator, and SQL of the same results.

SQL is left out where it cannot express an operator (string ratios, cells that may miss results, encoders); the tests hold those against brute force.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import render
from palimpsest.functions import text as T
from palimpsest.functions.modes import named_entities, project_modes
from palimpsest.functions.tables import register_tables
from palimpsest.functions.thresholds import INNER, TOKENS, benchmark_column, required_column
from palimpsest.operators import index, search, stats, vectors, windows
from palimpsest.plans import corpus
from palimpsest.session import gone, shared_dir, ship, table
from palimpsest.sources import ingest, sinks
from palimpsest.sources.store import Store
from palimpsest.streaming.grow import grow, read_grown

STOP = T.stop_set("forms")
#: Defaults of the reading interface.
WINDOW, STRIDE, TOLERANCE, TOKEN_TOLERANCE = 10, 5, 4, 2
#: The text whose reuse is looked up, and the entity whose company is.
TEXT_ID, ENTITY = "src0/0", "The"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- pieces of SQL ----------------------------------------------------------------------------------

DOCS = r"""docs AS (SELECT source || '/' || doc_id AS text_id, source AS core_project,
  list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS tokens FROM documents)"""
ITEMS = r"""items AS (SELECT 'benchmark/' || item_id AS text_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS tokens FROM benchmark)"""
STOPS = "[" + ", ".join(f"'{s}'" for s in STOP) + "]"
# Edit distances in this SQL dialect count bytes; the letters of the tables beyond ASCII become single bytes first.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
BYTES = " || ".join(f"chr({i})" for i in range(1, len(LETTERS) + 1))


def sql_lev(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{LETTERS}', {BYTES}), translate({b}, '{LETTERS}', {BYTES}))"


def sql_windows(source: str, window: int, stride: int) -> str:
    """(text_id, window_no, tokens) of full windows, the last one moved back."""
    return f"""wins AS (
  SELECT text_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY s) - 1 AS INTEGER) AS window_no, tokens[s + 1:s + {window}] AS tokens
  FROM (SELECT DISTINCT text_id, tokens, unnest(CASE WHEN len(tokens) > {window}
      THEN list_concat(range(0, len(tokens) - {window} + 1, {stride}), [len(tokens) - {window}])
      WHEN len(tokens) > 0 THEN [0] ELSE [] END) AS s FROM {source}))"""


def sql_mark(k: str) -> str:
    """Mark from the number of tokens that may differ; doubles throughout."""
    return f"(CASE WHEN tol = 0 THEN CAST(0.1 AS DOUBLE) WHEN CAST(1 AS DOUBLE) - ceil(CAST({k} AS DOUBLE) / CAST(len(tokens) AS DOUBLE) * CAST(10 AS DOUBLE)) / CAST(10 AS DOUBLE) = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - ceil(CAST({k} AS DOUBLE) / CAST(len(tokens) AS DOUBLE) * CAST(10 AS DOUBLE)) / CAST(10 AS DOUBLE) END)"


#: Shortest tokens until their lengths exceed the tolerance.
K_INNER = "least(len(tokens), 1 + len(list_filter(range(1, len(tokens) + 1), lambda i: list_sum(list_sort(list_transform(tokens, lambda t: length(t)))[1:i]) <= tol)))"
COUNTED = f"list_filter(list_distinct(tokens), lambda t: NOT list_contains({STOPS}, t))"
NEED = "CAST(CASE WHEN ceil(mark * len(counted)) = len(counted) AND mark <> 1 THEN len(counted) - 1 ELSE ceil(mark * len(counted)) END AS INTEGER)"


def sql_candidates(k: str) -> str:
    """Texts of ``docs`` that share enough tokens with queries (asked: query_id, tokens, tol), of which ``k`` may differ."""
    return f"""
marked AS (SELECT query_id, tokens, tol, {COUNTED} AS counted, {sql_mark(k)} AS mark FROM asked),
needed AS (SELECT *, {NEED} AS need FROM marked),
posted AS (SELECT DISTINCT text_id, unnest(tokens) AS token FROM docs),
wanted AS (SELECT query_id, need, unnest(counted) AS token FROM needed),
cands AS (SELECT query_id, text_id, CAST(count(*) AS INTEGER) AS shared FROM wanted JOIN posted USING (token)
  WHERE token <> '■' AND token <> '' GROUP BY query_id, text_id, need HAVING count(*) >= greatest(need, 1))"""


def sql_search(tail: str) -> str:
    """Hits of queries (asked) in ``docs`` by edit distances inside tokens."""
    return f"""{sql_candidates(K_INNER)},
places AS (SELECT c.query_id, c.text_id, n.tokens AS q, n.tol, d.tokens AS t, unnest(range(0, len(d.tokens) - len(n.tokens) + 1)) AS i
  FROM cands c JOIN needed n USING (query_id) JOIN docs d USING (text_id) WHERE len(d.tokens) >= len(n.tokens)),
near AS (SELECT * FROM places WHERE len(list_filter(range(1, len(q) + 1), lambda j: q[j] <> '■' AND q[j] <> t[i + j])) <= tol),
costs AS (SELECT query_id, text_id, i, tol, t[i + 1:i + len(q)] AS matched, CAST(list_sum(list_transform(range(1, len(q) + 1),
  lambda j: CASE WHEN q[j] = '■' THEN 0 ELSE {sql_lev("q[j]", "t[i + j]")} END)) AS INTEGER) AS edit_distance FROM near),
best AS (SELECT *, min(edit_distance) OVER (PARTITION BY query_id, text_id) AS least FROM costs),
hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY text_id, i) - 1 AS INTEGER) AS result_id, text_id,
  array_to_string(matched, ' ') AS matched_sequence, edit_distance FROM best WHERE edit_distance = least AND edit_distance <= tol)
{tail}"""


def sql_token_search(tail: str) -> str:
    """Hits of queries (asked) in ``docs`` by the token edit distance: its table, a row a step.

    A cell takes a match or replacement, then a query token without counterpart, if that is less; then the nearest
    cell to the left, if that and the way are less.
    """
    cost = "(CASE WHEN q[i + 1] IN ('■', t[j]) THEN 0 ELSE 1 END)"
    way = "(own[k + 1] + j - k) * 1000000 + j - k"
    return f"""{sql_candidates("tol")},
aligned AS (
  SELECT c.query_id, c.text_id, n.tokens AS q, n.tol, d.tokens AS t, 0 AS i, list_transform(range(0, len(d.tokens) + 1), lambda j: CAST(0 AS BIGINT)) AS d, range(0, len(d.tokens) + 1) AS s
  FROM cands c JOIN needed n USING (query_id) JOIN docs d USING (text_id) WHERE len(d.tokens) > 0
  UNION ALL
  SELECT query_id, text_id, q, tol, t, i + 1, list_transform(least_way, lambda v: v // 1000000), list_transform(range(0, len(t) + 1), lambda j: start[j - least_way[j + 1] % 1000000 + 1])
  FROM (SELECT *, list_transform(range(0, len(t) + 1), lambda j: list_min(list_transform(range(greatest(0, j - i - 1), j + 1), lambda k: {way}))) AS least_way
    FROM (SELECT *, list_transform(range(0, len(t) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(d[j] + {cost}, d[j + 1] + 1) END) AS own,
      list_transform(range(0, len(t) + 1), lambda j: CASE WHEN j = 0 THEN 0 WHEN d[j] + {cost} <= d[j + 1] + 1 THEN s[j] ELSE s[j + 1] END) AS start FROM aligned WHERE i < len(q)))),
ends AS (SELECT query_id, text_id, t, d, s, list_min(d[2:]) AS best, unnest(range(1, len(t) + 1)) AS j FROM aligned WHERE i = len(q) AND list_min(d[2:]) <= tol),
hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY text_id, j) - 1 AS INTEGER) AS result_id, text_id,
  array_to_string(t[s[j + 1] + 1:j], ' ') AS matched_sequence, CAST(best AS INTEGER) AS edit_distance FROM ends WHERE d[j + 1] = best)
{tail}"""


K_WORDS = f"len({COUNTED})"
def sql_asked(tolerance: int) -> str:
    return f"""{ITEMS}, {sql_windows("items", WINDOW, STRIDE)},
asked AS (SELECT text_id || '#' || window_no AS query_id, tokens, CASE WHEN {K_WORDS} = 2 THEN 0 ELSE {tolerance} END AS tol FROM wins WHERE {K_WORDS} >= 2)"""


ASKED_ITEMS = sql_asked(TOLERANCE)


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def md5_of(items: Column) -> Column:
    return F.md5(F.array_join(items, " ").cast("binary"))


# -- scalar layer -----------------------------------------------------------------------------------


@query("tokens_head", f"WITH {DOCS} SELECT text_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens[1:15], ' ') AS head FROM docs")
def tokens_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).select("text_id", F.size("tokens").alias("n_tokens"), T.join_tokens(T.head(F.col("tokens"))).alias("head"))


EDGE_SQL = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$'"
NORMAL_SQL = f"list_transform(list_transform(tokens, lambda t: regexp_replace(lower(t), {EDGE_SQL}, '', 'g')), lambda t: CASE WHEN t = '' THEN '■' ELSE t END)"
ENTITY_SQL = r"list_transform(tokens, lambda t: CASE WHEN NOT (regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}]')) AND regexp_matches(t, '(^|-)\p{Lu}') THEN 'PN_RN' ELSE t END)"


@query("modes", rf"""WITH {DOCS}, m AS (
  SELECT text_id, 'forms' AS mode, tokens AS t FROM docs
  UNION ALL SELECT text_id, 'forms_normalised', list_transform(tokens, lambda t: translate(t, '₀₁₂₃₄₅₆₇₈₉', '')) FROM docs
  UNION ALL SELECT text_id, 'normalised', {NORMAL_SQL} FROM docs
  UNION ALL SELECT text_id, 'lemma', list_transform(list_transform(tokens, lambda t: regexp_replace(t, '[0-9\p{{P}}]', '', 'g')), lambda t: CASE WHEN t IN ('', 'x', 'X') THEN '■' ELSE t END) FROM docs
  UNION ALL SELECT text_id, 'forms_pos', {ENTITY_SQL} FROM docs
  UNION ALL SELECT text_id, 'signs', list_filter(flatten(list_transform(tokens, lambda t: regexp_split_to_array(translate(t, '-.', '  '), '\s+'))), lambda x: x <> '') FROM docs)
SELECT text_id, mode, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM m""")  # fmt: skip
def all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.modes(corpus.documents(spark, sf_dir)).select("text_id", "mode", F.size("tokens").alias("n_tokens"), md5_of(F.col("tokens")).alias("digest"))


@query("core_projects", r"""SELECT source || '/' || doc_id AS text_id, source AS core_project, source || '/' || doc_id AS unescaped FROM documents""")
def core_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return docs.select("text_id", "core_project", T.unescape_id(F.replace("text_id", F.lit("/"), F.lit("-"))).alias("unescaped"))


@query("query_entities", f"WITH {ITEMS} SELECT text_id, array_to_string({ENTITY_SQL}, ' ') AS rewritten FROM items")
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.passages(spark, sf_dir).select("text_id", T.join_tokens(T.to_entities(F.col("tokens"))).alias("rewritten"))


@query("token_distance_pairs", f"""WITH {ITEMS}, p AS (SELECT text_id, tokens, unnest(range(1, len(tokens))) AS i FROM items)
SELECT text_id, CAST(i AS INTEGER) AS place, CAST({sql_lev("tokens[i]", "tokens[i + 1]")} AS INTEGER) AS distance FROM p""")  # fmt: skip
def token_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.passages(spark, sf_dir).where(F.size("tokens") > 1).select("text_id", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("place"))
    return rows.select("text_id", "place", F.levenshtein(F.element_at("tokens", F.col("place")), F.element_at("tokens", F.col("place") + 1)).alias("distance"))


# -- windows ----------------------------------------------------------------------------------------

WIN_SQL = f"""w AS (SELECT text_id, tokens, unnest(list_filter(range(0, len(tokens), {STRIDE}), lambda s: s = 0 OR s - {STRIDE} + {WINDOW} < len(tokens))) AS s FROM docs)"""


@query("chunk_windows", f"""WITH {DOCS}, {WIN_SQL} SELECT text_id, CAST(s AS INTEGER) AS start, CAST(least(s + {WINDOW}, len(tokens)) AS INTEGER) AS stop, md5(array_to_string(tokens[s + 1:s + {WINDOW}], ' ')) AS digest FROM w""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.make_windows(corpus.documents(spark, sf_dir), WINDOW, STRIDE).select("text_id", "start", "stop", md5_of(F.col("tokens")).alias("digest"))


@query("chunks", f"""WITH {DOCS}, {WIN_SQL} SELECT text_id || ':f:' || s || '-' || least(s + {WINDOW}, len(tokens)) AS chunk_id, text_id,
  md5(array_to_string(tokens[s + 1:s + {WINDOW}], ' ')) AS shown, md5(array_to_string(list_filter(tokens[s + 1:s + {WINDOW}], lambda t: t <> '∎'), ' ')) AS embedded FROM w
WHERE len(list_filter(tokens[s + 1:s + {WINDOW}], lambda t: t <> '∎')) > 0""")  # fmt: skip
def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.chunks(corpus.documents(spark, sf_dir), windows.TAGS["forms"], *windows.chunk_size("forms"))
    return made.select("chunk_id", "text_id", F.md5(F.col("text_display").cast("binary")).alias("shown"), F.md5(F.col("text_embed").cast("binary")).alias("embedded"))


@query("query_windows", f"""WITH {DOCS}, {sql_windows("docs", WINDOW, STRIDE)} SELECT text_id, window_no, md5(array_to_string(tokens, ' ')) AS digest FROM wins""")
def all_query_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.query_windows(corpus.documents(spark, sf_dir), WINDOW, STRIDE).select("text_id", "window_no", md5_of(F.col("tokens")).alias("digest"))


@query("countable_windows", f"""WITH {DOCS}, {sql_windows("docs", WINDOW, STRIDE)}, c AS (SELECT text_id, window_no, {K_WORDS} AS k FROM wins)
SELECT text_id, window_no, CAST(CASE WHEN k = 2 THEN 0 ELSE {TOLERANCE} END AS INTEGER) AS tolerance FROM c WHERE k >= 2""")  # fmt: skip
def countable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.window_queries(corpus.documents(spark, sf_dir), WINDOW, STRIDE, TOLERANCE, STOP).select(F.col("own_id").alias("text_id"), "window_no", F.col("tol").alias("tolerance"))


@query("thresholds", f"""WITH {ITEMS}, {sql_windows("items", WINDOW, STRIDE)},
a AS (SELECT text_id, window_no, tokens, unnest([0, 1, 4]) AS tol FROM wins),
m AS (SELECT text_id, window_no, tol, 'inner' AS kind, {COUNTED} AS counted, {sql_mark(K_INNER)} AS mark FROM a
  UNION ALL SELECT text_id, window_no, tol, 'tokens', {COUNTED}, {sql_mark("tol")} FROM a)
SELECT text_id, window_no, CAST(tol AS INTEGER) AS tol, kind, mark, {NEED} AS need FROM m""")  # fmt: skip
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = windows.query_windows(corpus.passages(spark, sf_dir), WINDOW, STRIDE).withColumn("tol", F.explode(F.array(F.lit(0), F.lit(1), F.lit(4))))
    distinct = F.size(F.array_except(F.array_distinct("tokens"), F.array(*[F.lit(s) for s in STOP])))
    marks = F.array(*[F.struct(F.lit(k).alias("kind"), benchmark_column(F.col("tokens"), F.col("tol"), k).alias("mark")) for k in (INNER, TOKENS)])
    rows = wins.select("text_id", "window_no", "tol", distinct.alias("n"), F.explode(marks).alias("m")).select("text_id", "window_no", "tol", "m.kind", "m.mark", "n")
    return rows.withColumn("need", required_column(F.col("mark"), F.col("n"))).drop("n")


# -- index and search -------------------------------------------------------------------------------


@query("document_frequency", f"WITH {DOCS}, p AS (SELECT DISTINCT text_id, unnest(tokens) AS token FROM docs) SELECT token, count(*) AS df FROM p WHERE token NOT IN ('■', '') GROUP BY token")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequency(corpus.documents(spark, sf_dir))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to all cores before they are split into tokens."""
    return corpus.documents(spark, sf_dir, index.TASKS_EACH)


def asked(spark: SparkSession, sf_dir: str, tolerance: int = TOLERANCE) -> DataFrame:
    return search.window_queries(corpus.passages(spark, sf_dir), WINDOW, STRIDE, tolerance, STOP).select("query_id", "tokens", "tol")


@query("candidates", f"WITH {DOCS}, {ASKED_ITEMS}, {sql_search('SELECT query_id, text_id, shared FROM cands')}")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.candidates(index.with_threshold(asked(spark, sf_dir), INNER, STOP), searched(spark, sf_dir)).select("query_id", "text_id", "shared")


@query("search_inner", f"WITH {DOCS}, {ASKED_ITEMS}, {sql_search('SELECT * FROM hits')}")
def search_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(asked(spark, sf_dir), searched(spark, sf_dir), INNER, STOP)


@query("search_tokens", f"WITH RECURSIVE {DOCS}, {sql_asked(TOKEN_TOLERANCE)}, {sql_token_search('SELECT * FROM hits')}")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(asked(spark, sf_dir, TOKEN_TOLERANCE), searched(spark, sf_dir), TOKENS, STOP)


@query("candidates_kept", f"WITH {DOCS}, {ASKED_ITEMS}, {sql_search('SELECT query_id, text_id, shared FROM cands')}")
def candidates_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by postings that a store keeps in buckets by token."""
    store = Store(spark, shared_dir(spark))
    store.write_texts(corpus.documents(spark, sf_dir).select("text_id", F.lit("forms").alias("mode"), "tokens"))
    store.write_postings("forms")
    found = index.candidates(index.with_threshold(asked(spark, sf_dir), INNER, STOP), store.texts("forms"), store.postings("forms"))
    return found.select("query_id", "text_id", "shared")


@query("search_tokens_lateral", f"WITH RECURSIVE {DOCS}, {sql_asked(TOKEN_TOLERANCE)}, {sql_token_search('SELECT query_id, text_id, matched_sequence, edit_distance FROM hits')}")
def search_tokens_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of :func:`search_tokens` by the table function, as a user of SQL asks for them."""
    register_tables(spark)
    wanted, texts = index.with_threshold(asked(spark, sf_dir, TOKEN_TOLERANCE), TOKENS, STOP), searched(spark, sf_dir)
    pairs = search.dealt_pairs(index.candidates(wanted, texts).select("query_id", "text_id"))
    return spark.sql(
        """SELECT p.query_id, p.text_id, h.matched_sequence, h.edit_distance
        FROM {pairs} p JOIN {wanted} q ON p.query_id = q.query_id JOIN {texts} t ON p.text_id = t.text_id, LATERAL token_hits(q.tokens, t.tokens, q.tol) h""",
        pairs=pairs, wanted=wanted, texts=texts,
    )


@query("best_hits", f"WITH {DOCS}, {ASKED_ITEMS}, {sql_search('SELECT * FROM hits ORDER BY edit_distance, text_id, query_id, result_id LIMIT 100')}")
def best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_inner(spark, sf_dir).orderBy("edit_distance", "text_id", "query_id", "result_id").limit(100)


@query("hits_without_ignored", f"""WITH {DOCS}, {ASKED_ITEMS}, {sql_search("SELECT h.* FROM hits h WHERE h.text_id NOT IN (SELECT d.source || '/' || d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0)")}""")
def hits_without_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    ignored = table(spark, sf_dir, "documents").join(poor, "doc_id").select(corpus.doc_id_text().alias("text_id"))
    return search.without(search_inner(spark, sf_dir), ignored)


REUSE_ASKED = f"""own AS (SELECT * FROM docs WHERE text_id = '{TEXT_ID}'), {sql_windows("own", WINDOW, STRIDE)},
asked AS (SELECT text_id || '#' || min(window_no) AS query_id, tokens, CASE WHEN {K_WORDS} = 2 THEN 0 ELSE {TOLERANCE} END AS tol FROM wins WHERE {K_WORDS} >= 2 GROUP BY text_id, tokens)"""


@query("text_reuse", f"""WITH {DOCS}, {REUSE_ASKED}, {sql_search(f"SELECT '{TEXT_ID}' AS own_id, array_to_string(a.tokens, ' ') AS query, result_id, text_id, matched_sequence, edit_distance FROM hits JOIN asked a USING (query_id) WHERE text_id <> '{TEXT_ID}'")}""")
def text_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = searched(spark, sf_dir)
    return search.find_reuse(texts.where(F.col("text_id") == TEXT_ID), texts, WINDOW, STRIDE, TOLERANCE, INNER, STOP)


REUSE_ALL = f"""own AS (SELECT source || '/' || doc_id AS text_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS tokens FROM documents WHERE doc_id % 100 = 0),
{sql_windows("own", WINDOW, STRIDE)},
asked AS (SELECT text_id || '#' || min(window_no) AS query_id, text_id AS own_id, tokens, CASE WHEN {K_WORDS} = 2 THEN 0 ELSE {TOLERANCE} END AS tol FROM wins WHERE {K_WORDS} >= 2 GROUP BY text_id, tokens)"""


@query("document_reuse", f"""WITH {DOCS}, {REUSE_ALL}, {sql_search("SELECT own_id, array_to_string(a.tokens, ' ') AS query, result_id, h.text_id, matched_sequence, edit_distance FROM hits h JOIN asked a USING (query_id) WHERE h.text_id <> own_id")}""")
def document_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose doc_id is divisible by 100, searched in all documents."""
    own = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(corpus.doc_id_text().alias("text_id"), corpus.tokens(F.col("text")).alias("tokens"))
    return search.find_reuse(own, searched(spark, sf_dir), WINDOW, STRIDE, TOLERANCE, INNER, STOP)


@query("passage_reuse", f"""WITH {DOCS}, {ITEMS}, {sql_windows("items", WINDOW, STRIDE)},
asked AS (SELECT text_id || '#' || min(window_no) AS query_id, text_id AS own_id, tokens, CASE WHEN {K_WORDS} = 2 THEN 0 ELSE {TOLERANCE} END AS tol FROM wins WHERE {K_WORDS} >= 2 GROUP BY text_id, tokens),
{sql_search("SELECT own_id, array_to_string(a.tokens, ' ') AS query, result_id, h.text_id, matched_sequence, edit_distance FROM hits h JOIN asked a USING (query_id)")}""")  # fmt: skip
def passage_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_reuse(corpus.passages(spark, sf_dir), searched(spark, sf_dir), WINDOW, STRIDE, TOLERANCE, INNER, STOP, ignore_core_project=True)


def sql_once(tolerance: int) -> str:
    """Queries of passages, windows with the same tokens once."""
    return f"""{ITEMS}, {sql_windows("items", WINDOW, STRIDE)},
asked AS (SELECT text_id || '#' || min(window_no) AS query_id, text_id AS own_id, tokens, CASE WHEN {K_WORDS} = 2 THEN 0 ELSE {tolerance} END AS tol FROM wins WHERE {K_WORDS} >= 2 GROUP BY text_id, tokens)"""


BOTH_TAIL = "SELECT own_id, array_to_string(a.tokens, ' ') AS query, result_id, h.text_id, matched_sequence, edit_distance, '{0}' AS distance FROM hits h JOIN asked a USING (query_id) WHERE h.text_id <> own_id"


@query("both_distances", f"""WITH RECURSIVE {DOCS}, one AS (WITH {sql_once(TOLERANCE)}, {sql_search(BOTH_TAIL.format(INNER))}),
two AS (WITH RECURSIVE {sql_once(TOKEN_TOLERANCE)}, {sql_token_search(BOTH_TAIL.format(TOKENS))})
SELECT * FROM one UNION ALL SELECT * FROM two""")
def both_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.both_distances(corpus.passages(spark, sf_dir), searched(spark, sf_dir), WINDOW, STRIDE, TOLERANCE, TOKEN_TOLERANCE, STOP)


@query("texts_with_token", f"WITH {DOCS} SELECT text_id FROM docs WHERE list_contains(tokens, 'the')")
def texts_with_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.texts_with(corpus.documents(spark, sf_dir), "the")


@query("text_by_id", f"WITH {DOCS} SELECT text_id, array_to_string(tokens, ' ') AS whole FROM docs WHERE text_id = '{TEXT_ID}'")
def text_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).where(F.col("text_id") == TEXT_ID).select("text_id", T.join_tokens(F.col("tokens")).alias("whole"))


# -- listings and statistics ------------------------------------------------------------------------


@query("corpus_statistics", f"WITH {DOCS} SELECT count(*) AS texts, count(*) FILTER (len(tokens) = 0) AS empty, count(*) FILTER (len(tokens) > 0 AND len(list_filter(tokens, lambda t: t <> '■')) = 0) AS unknown_only, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM docs")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_statistics(corpus.documents(spark, sf_dir))


@query("project_statistics", "SELECT count(DISTINCT source) AS projects, count(DISTINCT source) AS with_texts, count(DISTINCT source) AS head, CAST(0 AS BIGINT) AS sub, count(*) AS texts FROM documents")
def project_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.project_statistics(corpus.projects(spark, sf_dir), corpus.documents(spark, sf_dir))


@query("project_texts", "SELECT source AS project, 'Source ' || source AS name, 0 AS page, CAST(count(*) AS INTEGER) AS n, md5(string_agg(source || '/' || doc_id, ' ' ORDER BY source || '/' || doc_id)) AS ids FROM documents GROUP BY source")
def project_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = stats.project_texts(corpus.projects(spark, sf_dir), corpus.documents(spark, sf_dir))
    return listed.select("project", "name", "page", F.size("text_ids").alias("n"), md5_of(F.col("text_ids")).alias("ids"))


@query("project_map", """SELECT source AS project, 0 AS page, '{"value":"' || source || '","label":"Source ' || source || '","texts":[' || string_agg('{"value":"' || source || '/' || doc_id || '"}', ',' ORDER BY source || '/' || doc_id) || ']}' AS json FROM documents GROUP BY source""")
def project_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.project_map(corpus.projects(spark, sf_dir), corpus.documents(spark, sf_dir))


@query("type_ahead", "SELECT DISTINCT source AS project, 'Source ' || source AS name FROM documents WHERE contains(lower('Source ' || source), 'src1') OR contains(lower(source), 'src1') ORDER BY 2, 1 LIMIT 50")
def type_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_ahead(corpus.projects(spark, sf_dir), F.col("name"), F.col("project"), "SRC1")


@query("type_ahead_index", """WITH d AS (SELECT DISTINCT 'Source ' || source AS label, source || '/' || doc_id AS value FROM documents)
SELECT label, value FROM d WHERE contains(lower(label), 'c1/1') OR contains(lower(value), 'c1/1')""")
def type_ahead_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the type-ahead of texts finds in an index of all texts."""
    path = shared_dir(spark)
    texts = corpus.documents(spark, sf_dir)
    stats.write_type_ahead(texts, F.concat(F.lit("Source "), F.col("core_project")), F.col("text_id"), path)
    return stats.look_ahead(spark, path, "C1/1", None)


ENTITIES_SQL = rf"""ents AS (SELECT text_id, regexp_replace(t, {EDGE_SQL}, '', 'g') AS lemma FROM (SELECT text_id, unnest(tokens) AS t FROM docs) WHERE regexp_matches(t, '^\p{{Lu}}[\p{{Ll}}]')),
rel AS (SELECT '{ENTITY}' AS query_ne, lemma AS rel_ne, count(DISTINCT text_id) AS hits FROM ents WHERE lemma <> '{ENTITY}' AND text_id IN (SELECT text_id FROM ents WHERE lemma = '{ENTITY}') GROUP BY lemma)"""


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.co_occurrence(corpus.entities(corpus.documents(spark, sf_dir)), ENTITY, "PN_RN")


@query("co_occurrence", f"WITH {DOCS}, {ENTITIES_SQL} SELECT * FROM rel")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company(spark, sf_dir)


@query("network_edges", f"WITH {DOCS}, {ENTITIES_SQL} SELECT * FROM rel WHERE hits >= 30")
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.network(company(spark, sf_dir), ENTITY)[0]


@query("network_points", f"WITH {DOCS}, {ENTITIES_SQL} SELECT rel_ne AS point, hits AS size FROM rel WHERE hits >= 30 UNION ALL SELECT '{ENTITY}', count(*) FROM rel")
def network_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.network(company(spark, sf_dir), ENTITY)[1]


@query("network_all_edges", rf"""WITH {DOCS}, ents AS (SELECT DISTINCT text_id, regexp_replace(t, {EDGE_SQL}, '', 'g') AS lemma FROM (SELECT text_id, unnest(tokens) AS t FROM docs) WHERE regexp_matches(t, '^\p{{Lu}}[\p{{Ll}}]'))
SELECT a.lemma AS query_ne, b.lemma AS rel_ne, count(*) AS hits FROM ents a JOIN ents b ON a.text_id = b.text_id AND a.lemma <> b.lemma GROUP BY a.lemma, b.lemma HAVING count(*) >= 30""")
def network_all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all entities' networks at once."""
    return stats.all_co_occurrences(corpus.entities(corpus.documents(spark, sf_dir)), "PN_RN")


# -- vectors ----------------------------------------------------------------------------------------


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


TOP_SQL = """s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, list_sum(list_transform(range(1, len(c.embedding) + 1), lambda i: CAST(c.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)"""


@query("vector_top_k", f"WITH {TOP_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 50")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.top_k(vector_queries(spark, sf_dir), stored(spark, sf_dir), vectors.TOP_K)
    return found.select("query_id", "rank", "chunk_id", F.round("embed_score", 6).alias("score"))


@query("vector_labels", f"WITH {TOP_SQL} SELECT query_id, label, count(*) AS hits FROM r WHERE rank <= 50 GROUP BY query_id, label")
def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    found = vectors.top_k(vector_queries(spark, sf_dir), rows, vectors.TOP_K)
    return found.join(rows.select("chunk_id", "label"), "chunk_id", "left").groupBy("query_id", "label").agg(F.count("*").alias("hits"))


def cell_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All embeddings in cells, written by cell and read back, and the centres."""
    path = shared_dir(spark)
    rows = stored(spark, sf_dir).select("chunk_id", "vector")
    sinks.write_cells(*vectors.build_cells(rows, vectors.cell_count(rows.count())), path)
    return sinks.read_cells(spark, path)


@query("vector_cells")
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by cells; the search stops where few results are left to expect."""
    return vectors.search_cells(vector_queries(spark, sf_dir), *cell_index(spark, sf_dir), 10)


@query("vector_cells_exact", f"WITH {TOP_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def vector_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by cells; the search stops where no cell can hold a better one."""
    found = vectors.search_cells(vector_queries(spark, sf_dir), *cell_index(spark, sf_dir), 10, missed=0)
    return found.select("query_id", "rank", "chunk_id", F.round("embed_score", 6).alias("score"))


OVERLAP_WORDS = r"list_filter(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')), lambda w: NOT regexp_matches(w, '^[\p{{Nd}}⁰¹²³⁴-⁹₀-₉]+$'))"
CLASSES_SQL = "[" + ", ".join(f"'{c}'" for c in vectors.ENTITY_PARTS) + "]"
WEIGHT_SQL = "coalesce(list_sum(list_transform({0}, lambda w: CASE WHEN list_bool_and(list_transform(string_split(w, '_'), lambda p: list_contains(" + CLASSES_SQL + ", p))) THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)), 0)"


@query("weighted_overlap", f"""WITH n AS (SELECT max(item_id) + 1 AS m FROM benchmark),
p AS (SELECT d.doc_id, {OVERLAP_WORDS.format("b.text")} AS q, {OVERLAP_WORDS.format("d.text")} AS t FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n.m)
SELECT doc_id, round({WEIGHT_SQL.format("list_intersect(q, t)")} / CASE WHEN {WEIGHT_SQL.format("q")} = 0 THEN 1 ELSE {WEIGHT_SQL.format("q")} END, 9) AS overlap FROM p""")  # fmt: skip
def weighted_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))
    n = items.agg(F.max("item_id")).first()[0] + 1
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"), (F.col("doc_id") % n).alias("item_id"))
    return docs.join(items, "item_id").select("doc_id", F.round(vectors.weighted_overlap(F.col("q"), F.col("t")), 9).alias("overlap"))


@query("lexical_similarity")
def lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(following, "item_id").select("item_id", vectors.lexical_column(F.col("text"), F.col("other")).alias("similarity"))


def reranked(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    share = vectors.MODELS[model]
    meta = windows.chunks(corpus.documents(spark, sf_dir), windows.TAGS["forms"], *windows.chunk_size("forms"))
    encoder = vectors.hashing_encoder()
    coded = vectors.encode(meta.select("chunk_id", "text_embed"), "text_embed", encoder, share["passage_prefix"]).select("chunk_id", "vector")
    rewritten = T.join_tokens(T.to_entities(F.col("tokens")) if model == "e5" else F.col("tokens"))
    asked_for = corpus.passages(spark, sf_dir).select(F.col("text_id").alias("query_id"), rewritten.alias("text"))
    queries = vectors.encode(asked_for, "text", encoder, share["query_prefix"])
    return vectors.rerank(vectors.top_k(queries, coded, share["candidates"]), meta.drop("text_embed"), queries, model)


@query("rerank_e5")
def rerank_e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir, "e5")


@query("rerank_minilm")
def rerank_minilm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir, "minilm")


# -- ingest -----------------------------------------------------------------------------------------


@query("scrape_links", r"""WITH lines AS (SELECT page_id, i, string_split(html, chr(10))[i] AS line FROM (SELECT page_id, html, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS i FROM pages)),
f AS (SELECT page_id, i, string_split(substr(line, strpos(line, 'href="/') + 7), '</a>')[1] AS rest FROM lines WHERE contains(line, 'href="/')),
n AS (SELECT page_id, i, replace(string_split(rest, '">')[1], '/', '-') AS shortcut, CASE WHEN contains(rest, '">') THEN string_split(rest, '">')[-1] ELSE '' END AS name FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY shortcut ORDER BY page_id, i) AS r FROM n)
SELECT CAST(row_number() OVER (ORDER BY page_id, i) - 1 AS INTEGER) AS idx, name, shortcut FROM o WHERE r = 1""")  # fmt: skip
def scrape_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.scrape_projects(table(spark, sf_dir, "pages").select("page_id", "html"), 'href="/')


@query("json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("json_prune", """SELECT doc_id, '{"cdl":[{"f":{"form":"' || source || '"},"node":"l"},{"n":' || doc_id || '}],"z":{}}' AS json FROM documents""")
def json_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated JSON of every document with keys at every depth that no mode reads; they go."""
    said = F.concat(F.lit('{"type":"x","cdl":[{"f":{"lang":"akk","form":"'), "source", F.lit('","sig":[1,{"id":2}]},"node":"l"},{"n":'), F.col("doc_id").cast("string"), F.lit(',"id":"a"}],"z":{"ref":{"form":"b"}}}'))
    return ingest.prune_json(table(spark, sf_dir, "documents").select("doc_id", said.alias("json")))


FORM_SQL, CF_SQL = "t", "lower(t)"
NORM_SQL = f"(regexp_replace(lower(t), {EDGE_SQL}, '', 'g') || CASE WHEN length(t) % 2 = 0 THEN '' ELSE '~' END)"
CLASS_SQL = r"CASE WHEN regexp_matches(t, '^\p{Lu}') THEN 'PN_RN' WHEN length(t) % 3 = 0 THEN 'PN_DN' END"


def sql_marked(word: str, entities: bool = False, strip: bool = False) -> str:
    """Tokens by ``word``, with entity classes and without index digits where asked for."""
    marked = f"CASE WHEN {word} IN ('x', 'X') THEN '■' ELSE {word} END"
    named = f"coalesce({CLASS_SQL}, {marked})" if entities else marked
    return f"list_transform(tokens, lambda t: {f"translate({named}, '{T.SUBSCRIPTS}', '')" if strip else named})"


def sql_signs(strip: bool = False) -> str:
    """Each token's sign, then those of its sequence; one of them is the letter for unknown signs."""
    marked = lambda x: f"CASE WHEN {x} IN ('x', 'X') THEN '■' ELSE {x} END"
    signs = f"flatten(list_transform(tokens, lambda t: CASE WHEN length(t) % 2 = 1 THEN CASE WHEN length(t) % 3 = 0 THEN [{marked('t')}, {marked("('s' || t)")}, '■'] ELSE [{marked('t')}, {marked("('s' || t)")}] END ELSE [{marked('t')}] END))"
    return f"list_transform({signs}, lambda t: translate(t, '{T.SUBSCRIPTS}', ''))" if strip else signs


GDL_SQL = "list_filter(flatten(list_transform(tokens, lambda t: [CASE WHEN length(t) % 4 <> 0 THEN 'G' || t END, CASE WHEN length(t) % 2 = 1 THEN 'S' || t END])), lambda s: s IS NOT NULL)"
MODES_SQL = {
    "forms": sql_marked(FORM_SQL), "lemma": sql_marked(CF_SQL), "normalised": sql_marked(NORM_SQL),
    "forms_pos": sql_marked(FORM_SQL, True), "lemma_pos": sql_marked(CF_SQL, True), "normalised_pos": sql_marked(NORM_SQL, True),
    "signs": sql_signs(), "signs_gdl": GDL_SQL, "signs_normalised": sql_signs(True),
    "forms_normalised": sql_marked(FORM_SQL, strip=True), "forms_pos_normalised": sql_marked(FORM_SQL, True, True),
}


def sql_modes(wanted: tuple[str, ...]) -> str:
    return f"""WITH {DOCS}, m AS ({" UNION ALL ".join(f"SELECT text_id, '{m}' AS mode, {MODES_SQL[m]} AS t FROM docs" for m in wanted)})
SELECT text_id, mode, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM m"""


SOME_MODES = ("forms", "normalised", "forms_pos", "signs")


@query("json_modes", sql_modes(SOME_MODES))
def json_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ingest.parse_texts(corpus.annotated(corpus.documents(spark, sf_dir)))
    return project_modes(parsed, SOME_MODES).select("text_id", "mode", F.size("tokens").alias("n_tokens"), md5_of(F.col("tokens")).alias("digest"))


@query("json_all_modes", sql_modes(T.MODES))
def json_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ingest.parse_texts(corpus.annotated(corpus.documents(spark, sf_dir)))
    return project_modes(parsed).select("text_id", "mode", F.size("tokens").alias("n_tokens"), md5_of(F.col("tokens")).alias("digest"))


@query("json_entities", rf"""WITH {DOCS}, e AS (SELECT text_id, unnest(tokens) AS t FROM docs) SELECT text_id, {CLASS_SQL} AS category, lower(t) AS lemma FROM e WHERE {CLASS_SQL} IS NOT NULL""")
def json_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_entities(ingest.parse_texts(corpus.annotated(corpus.documents(spark, sf_dir))))


# -- files ------------------------------------------------------------------------------------------


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, json): every seventh text cut off, every eleventh with a null list of signs."""
    texts = corpus.annotated(corpus.documents(spark, sf_dir))
    n = F.substring_index("text_id", "/", -1).cast("long")
    null_signs = F.lit('{"cdl":[{"node":"l","f":{"form":"a","gdl":null}}]}')
    return texts.withColumn("json", F.when(n % 7 == 0, F.expr("left(json, length(json) - 1)")).when(n % 11 == 0, null_signs).otherwise(F.col("json")))


FAULTY = "(doc_id % 7 = 0 OR doc_id % 11 = 0)"


@query("catalog_files", """WITH s AS (SELECT DISTINCT source FROM documents) SELECT source AS shortcut, 'Source ' || source AS name, true AS listed FROM s""")
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog written as CSV and as a list, read back and joined."""
    path = shared_dir(spark)
    projects = corpus.projects(spark, sf_dir).select("name", F.col("project").alias("shortcut"))
    sinks.write_catalog(projects, f"{path}/csv")
    sinks.write_shortcuts(projects, f"{path}/txt")
    listed = sinks.read_shortcuts(spark, f"{path}/txt").withColumn("listed", F.lit(True))
    return spark.read.csv(f"{path}/csv", header=True).join(listed, "shortcut", "left").select("shortcut", "name", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("archive_texts", r"""SELECT 'zip' || (doc_id // 1000) AS project, source || '/corpusjson/' || doc_id || '.json' AS path, '{"n":' || doc_id || '}' AS json, CAST(NULL AS VARCHAR) AS error FROM documents
UNION ALL SELECT 'bad', NULL, NULL, 'BadZipFile: File is not a zip file'""")
def archive_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts zipped a thousand ids at a time and unpacked again, beside an archive that is none."""
    ship(spark)

    def zipped(key: tuple, rows: pa.Table) -> pa.Table:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for i, source in zip(rows["doc_id"].to_pylist(), rows["source"].to_pylist(), strict=True):
                z.writestr(f"{source}/corpusjson/{i}.json", f'{{"n":{i}}}')
                z.writestr(f"{source}/other/{i}.json", "{}")
        return pa.table({"path": [f"/land/zip{key[0].as_py()}.zip"], "content": pa.array([held.getvalue()], pa.binary())})

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / 1000).alias("k"))
    bad = spark.range(1).select(F.lit("/land/bad.zip").alias("path"), F.lit("no archive").cast("binary").alias("content"))
    return ingest.unpack(docs.groupBy("k").applyInArrow(zipped, "path string, content binary").unionByName(bad))


@query("text_ids", r"""SELECT doc_id, 'proj/' || source || '/X' || doc_id AS text_id FROM documents""")
def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("//corpusjson/X"), F.col("doc_id").cast("string"), F.lit(".json"))
    return table(spark, sf_dir, "documents").select("doc_id", T.text_id_of_path(path, F.lit("proj/")).alias("text_id"))


#: Folders of a scanned corpus: some bear the root's own name or end in it, some have letters that a path writes otherwise.
FOLDERS = ("proj/sub", "island", "x/land", "b c/d+e", "land")


@query("scanned_files", "SELECT [" + ", ".join(f"'{f}'" for f in FOLDERS) + "][item_id % 5 + 1] AS folder, CAST(item_id AS VARCHAR) AS n FROM benchmark")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as files of their own in corpusjson folders, beside a folder that is none, found by a scan."""
    path = shared_dir(spark)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"))
    for i, folder in enumerate(FOLDERS):
        items.where(F.col("n") % len(FOLDERS) == i).write.option("maxRecordsPerFile", 1).json(f"{path}/land/{folder}/corpusjson")
    items.write.json(f"{path}/land/proj/sub/other")
    found = ingest.read_json_texts(spark, f"{path}/land")
    return found.select(T.core_project(F.col("text_id")).alias("folder"), F.get_json_object("json", "$.n").alias("n"))


@query("grown_corpus", f"""WITH {DOCS}, n AS (SELECT *, CAST(string_split(text_id, '/')[2] AS BIGINT) AS i FROM docs), g AS (SELECT core_project, CAST(i // 500 AS INTEGER) AS file, list(text_id ORDER BY i) AS held, list(tokens ORDER BY i) AS texts FROM n GROUP BY ALL),
u AS (SELECT core_project || '/' || file AS text_id, list_transform(flatten(texts), lambda t: CASE WHEN t IN ('x', 'X') THEN '■' ELSE t END) AS t FROM g),
p AS (SELECT text_id, count(DISTINCT x) AS postings FROM (SELECT text_id, unnest(t) AS x FROM u) WHERE x NOT IN ('■', '') GROUP BY text_id)
SELECT u.text_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest, CAST(coalesce(postings, 0) AS BIGINT) AS postings FROM u LEFT JOIN p USING (text_id)""")
def grown_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that come in two steps, each added to a corpus by a stream of its own; then the corpus with its postings."""
    path = shared_dir(spark)
    n = F.substring_index("text_id", "/", -1).cast("long")
    docs = corpus.documents(spark, sf_dir).select("core_project", n.alias("n"), "tokens").withColumn("file", F.floor(F.col("n") / 500).cast("int"))
    files = docs.groupBy("core_project", "file").agg(F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("e")).select("core_project", F.concat_ws("/", "core_project", F.col("file").cast("string")).alias("text_id"), "file", F.flatten(F.col("e.tokens")).alias("tokens"))
    for step in (0, 1):
        sinks.write_json_texts(corpus.annotated(files.where(F.col("file") % 2 == step)), f"{path}/land", packed=True)
        grow(spark, f"{path}/land", f"{path}/corpus", ("forms",)).awaitTermination()
        gone(spark, f"{path}/land")  # what was read stands in the corpus
    held = read_grown(spark, f"{path}/corpus", "postings").groupBy("text_id").agg(F.count("*").alias("postings"))
    texts = read_grown(spark, f"{path}/corpus").select("text_id", F.size("tokens").alias("n_tokens"), md5_of(F.col("tokens")).alias("digest"))
    return texts.join(held, "text_id", "left").select("text_id", "n_tokens", "digest", F.coalesce("postings", F.lit(0)).alias("postings"))


@query("metadata_fields", """SELECT DISTINCT source AS project, 'Source ' || source AS name FROM documents""")
def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.projects(spark, sf_dir).select("project", F.to_json(F.struct(F.struct(F.col("name"), F.lit(1).alias("v")).alias("config"))).alias("json"))
    return ingest.metadata_names(files)


@query("parse_errors", f"""SELECT source || '/' || doc_id AS text_id FROM documents WHERE {FAULTY}""")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that could not be parsed, from their own table."""
    path = shared_dir(spark)
    sinks.write_errors(ingest.parse_texts(broken(spark, sf_dir), lemmas=False), path)
    return spark.read.parquet(path).where("parse_error is not null").select("text_id")


@query("parse_statistics", f"""WITH {DOCS} SELECT count(*) AS texts, count(*) FILTER ({FAULTY.replace("doc_id", "n")}) AS errors, count(*) FILTER ({FAULTY.replace("doc_id", "n")} OR len(tokens) = 0) AS empty,
CAST(sum(CASE WHEN {FAULTY.replace("doc_id", "n")} THEN 0 ELSE len(tokens) END) AS BIGINT) AS lemmas FROM (SELECT *, CAST(string_split(text_id, '/')[2] AS BIGINT) AS n FROM docs)""")
def parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.parse_statistics(ingest.parse_texts(broken(spark, sf_dir), lemmas=False))


@query("corpus_files", f"""WITH {DOCS} SELECT text_id, md5(array_to_string(tokens, ' ')) AS digest FROM docs WHERE core_project LIKE 'src1%'""")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora written project by project, and those whose name starts with src1 read as one."""
    path = shared_dir(spark)
    texts = corpus.documents(spark, sf_dir).withColumn("mode", F.lit("forms"))
    texts.write.partitionBy("core_project", "mode").parquet(path)
    return sinks.read_corpus(spark, path, "core_project=src1", "forms").select("text_id", md5_of(F.col("tokens")).alias("digest"))


@query("chunk_files", f"""WITH {DOCS}, {WIN_SQL} SELECT text_id || ':f:' || s || '-' || least(s + {WINDOW}, len(tokens)) AS chunk_id, text_id, CAST(s AS VARCHAR) AS start, md5(array_to_string(tokens[s + 1:s + {WINDOW}], ' ')) AS shown FROM w
WHERE len(list_filter(tokens[s + 1:s + {WINDOW}], lambda t: t <> '∎')) > 0""")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as the two CSVs, read back and joined."""
    path = shared_dir(spark)
    sinks.write_chunks(windows.chunks(corpus.documents(spark, sf_dir), windows.TAGS["forms"], *windows.chunk_size("forms")), f"{path}/embed", f"{path}/meta")
    said = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))  # noqa: E731  # 16 bytes of a text move, not the text
    embed = sinks.read_chunks(spark, f"{path}/embed").select("chunk_id", said("text").alias("said"))
    meta = sinks.read_chunks(spark, f"{path}/meta").select("chunk_id", "text_id", "start", said("text_display").alias("shown"))
    return meta.join(embed, "chunk_id").where("said = shown").select("chunk_id", "text_id", "start", F.lower(F.hex("shown")).alias("shown"))


@query("network_files", f"WITH {DOCS}, {ENTITIES_SQL}, big AS (SELECT * FROM rel WHERE hits >= 5) SELECT 'edge' AS kind, rel_ne AS name, CAST(hits AS VARCHAR) AS n FROM big UNION ALL SELECT 'point', rel_ne, CAST(hits AS VARCHAR) FROM big UNION ALL SELECT 'point', '{ENTITY}', CAST(count(*) AS VARCHAR) FROM rel")
def network_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and points of an entity's network written as CSV and read back."""
    path = shared_dir(spark)
    sinks.write_network(*stats.network(company(spark, sf_dir), ENTITY, 5), path)
    edges = spark.read.csv(f"{path}/edges", header=True).select(F.lit("edge").alias("kind"), F.col("rel_ne").alias("name"), F.col("hits").alias("n"))
    return edges.unionByName(spark.read.csv(f"{path}/points", header=True).select(F.lit("point").alias("kind"), F.col("point").alias("name"), F.col("size").alias("n")))


@query("cell_files", "SELECT vec_id AS chunk_id, true AS whole FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def cell_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell index written and read back: every vector stands in the cell of a centre that was written too."""
    path = shared_dir(spark)
    rows = stored(spark, sf_dir).select("chunk_id", "vector")
    sinks.write_cells(*vectors.build_cells(rows, 32), path)
    placed, centres = sinks.read_cells(spark, path)
    return placed.join(centres.withColumn("whole", F.lit(True)), "cell_id", "left").join(rows.withColumnRenamed("vector", "was"), "chunk_id").select("chunk_id", (F.col("whole") & (F.col("vector") == F.col("was"))).alias("whole"))


# -- presentation -----------------------------------------------------------------------------------


def sql_html(column: str) -> str:
    """A value as HTML escapes it."""
    out = f"CAST({column} AS VARCHAR)"
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{raw}', '{safe}')"
    return out


CELLS_SQL = " || ".join(f"'<td>' || {sql_html(c)} || '</td>'" for c in ("text_id", "matched_sequence", "edit_distance"))


@query("rendered_hits", f"""WITH {DOCS}, {ASKED_ITEMS}, {sql_search(f"""SELECT '<h3>query: &lt;all&gt; passages, mode: forms, distance: edit_distance_inner, tolerance: {TOLERANCE}</h3><p>' || (SELECT count(*) FROM hits) || ' results' || CASE WHEN (SELECT count(*) FROM hits) > 100 THEN ', the first 100 are shown' ELSE '' END
|| '</p><table><thead><tr><th>text_id</th><th>matched_sequence</th><th>edit_distance</th></tr></thead><tbody>' || string_agg('<tr>' || {CELLS_SQL} || '</tr>', '' ORDER BY edit_distance, text_id, query_id, result_id) || '</tbody></table>' AS html
FROM (SELECT * FROM hits ORDER BY edit_distance, text_id, query_id, result_id LIMIT 100)""")}""")  # fmt: skip
def rendered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of all passages as the page shows them: escaped, counted, the first hundred."""
    hits = search_inner(spark, sf_dir).orderBy("edit_distance", "text_id", "query_id", "result_id")
    return spark.createDataFrame([(render.query_hits(hits, "<all> passages", "forms", "edit_distance_inner", TOLERANCE),)], "html string")


REUSE_CELLS = " || ".join(f"'<td>' || {sql_html(c)} || '</td>'" for c in ("query", "text_id", "matched_sequence", "edit_distance"))


@query("rendered_text_hits", f"""WITH {DOCS}, {REUSE_ASKED}, {sql_search(f"""SELECT '<h3>text: {TEXT_ID}, mode: forms, distance: edit_distance_inner, itself left out: True, core project left out: False</h3><p>' || count(*) || ' results' || CASE WHEN count(*) > 50 THEN ', the first 50 are shown' ELSE '' END
|| '</p><table><thead><tr><th>query</th><th>text_id</th><th>matched_sequence</th><th>edit_distance</th></tr></thead><tbody>' || string_agg(CASE WHEN r <= 50 THEN '<tr>' || {REUSE_CELLS} || '</tr>' END, '' ORDER BY r) || '</tbody></table>' AS html
FROM (SELECT *, row_number() OVER (ORDER BY edit_distance, text_id, query, result_id) AS r FROM (SELECT h.*, array_to_string(a.tokens, ' ') AS query FROM hits h JOIN asked a USING (query_id) WHERE text_id <> '{TEXT_ID}'))""")}""")  # fmt: skip
def rendered_text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of a text's windows as the page shows them, the first fifty."""
    hits = text_reuse(spark, sf_dir).orderBy("edit_distance", "text_id", "query", "result_id")
    return spark.createDataFrame([(render.text_hits(hits, TEXT_ID, "forms", "edit_distance_inner", True, False),)], "html string")


@query("exported_hits", f"WITH {DOCS}, {ASKED_ITEMS}, {sql_search('SELECT query_id, CAST(result_id AS VARCHAR) AS result_id, text_id, matched_sequence, CAST(edit_distance AS VARCHAR) AS edit_distance FROM hits')}")
def exported_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of all passages exported as CSV by the tasks, and read back."""
    path = shared_dir(spark)
    sinks.export_csv(search_inner(spark, sf_dir), path)
    return sinks.read_chunks(spark, path)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages found again in documents."""
    return search_inner(spark, sf_dir)
