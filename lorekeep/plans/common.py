"""What several queries read: episodes and chunks by id, and the questions asked of them. NOW is the time that all ages count to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import query_terms, tokens
from lorekeep.operators import hierarchy
from lorekeep.session import written
from lorekeep.sources.tables import one_per_id, table

NOW = 1735689600000


def episodes(spark: SparkSession, sf_dir: str, *cols: str, where: str = "true") -> DataFrame:
    """One row per id. ``where`` may be on what rows sent again have alike; it is applied to the rows as they are, so its columns never reach the shuffle."""
    e = table(spark, sf_dir, "episodes").where(where)
    return one_per_id(e.select("id", *cols) if cols else e, latest=("accessed_at", "access_count"))


def chunks(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks")
    return one_per_id(c.select("id", *cols) if cols else c)


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "text").select(F.col("id").alias("doc_id"), tokens(F.col("text")).alias("tokens"))


def episode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(tokens(F.col("summary")), tokens(F.col("entities")))
    return episodes(spark, sf_dir, "summary", "entities").select(F.col("id").alias("doc_id"), both.alias("tokens"))


def questions(spark: SparkSession, sf_dir: str, stop_words: bool = False, most: int | None = None, every: bool = False) -> DataFrame:
    """One question for each described project (or for ``every`` project): its description; its vector is that of the project's first episode that has one."""
    p = table(spark, sf_dir, "projects").where("true" if every else "description <> ''")
    # rows that are sent again have the same vector, so they needn't be made one first
    first = table(spark, sf_dir, "episodes").where((F.size("embedding") == 128) & F.col("id").isNotNull())
    first = first.groupBy("project_path").agg(F.min_by("embedding", F.struct("created_at", "id")).alias("embedding"))
    q = p.join(first, F.col("full_path") == F.col("project_path"), "left").join(hierarchy.families(table(spark, sf_dir, "projects")), "name", "left")
    return written(q.select(F.col("full_path").alias("query_id"), query_terms(F.col("description"), stop_words, most).alias("terms"), "embedding", "family"))


#: The same as CTEs.
E = """e AS (SELECT id, any_value(session_id) AS session_id, any_value(project) AS project, any_value(project_path) AS project_path, any_value(scope) AS scope,
  any_value(summary) AS summary, any_value(entities) AS entities, any_value(importance) AS importance, any_value(source_type) AS source_type, any_value(full_content) AS full_content,
  any_value(embedding) AS embedding, any_value(created_at) AS created_at, max(accessed_at) AS accessed_at, max(access_count) AS access_count, any_value(graduated_at) AS graduated_at
  FROM episodes WHERE id IS NOT NULL GROUP BY id)"""
C = """c AS (SELECT id, any_value(path) AS path, any_value(layer) AS layer, any_value(project) AS project, any_value(project_path) AS project_path, any_value(start_line) AS start_line,
  any_value(end_line) AS end_line, any_value(hash) AS hash, any_value(text) AS text, any_value(embedding) AS embedding, any_value(updated_at) AS updated_at FROM chunks WHERE id IS NOT NULL GROUP BY id)"""
UP = """up AS (SELECT full_path, full_path AS ancestor, 0 AS depth, parent_project AS next FROM projects UNION ALL
  SELECT up.full_path, p.full_path, up.depth + 1, p.parent_project FROM up JOIN projects p ON p.full_path = up.next WHERE up.depth < 20)"""


def terms_sql(text: str, stop_words: list[str] | None = None, most: int | None = None) -> str:
    drop = ", ".join(f"'{w}'" for w in ["or", "and", "not", "near", *(stop_words or [])])
    cut = f"[1:{most}]" if most else ""
    return rf"""coalesce(list_filter(list_transform(regexp_split_to_array(regexp_replace({text}, '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+'), lambda x: lower(x)),
    lambda x: x <> '' AND x NOT IN ({drop})){cut}, [])"""


def questions_sql(stop_words: list[str] | None = None, most: int | None = None, every: bool = False) -> str:
    return f"""fam AS (SELECT p.name, list_sort(list(DISTINCT up.full_path)) AS family FROM projects p JOIN up ON up.ancestor = p.full_path GROUP BY 1),
f AS (SELECT project_path, arg_min(embedding, (created_at, id)) AS embedding FROM e WHERE len(embedding) = 128 GROUP BY 1),
q AS (SELECT p.full_path AS query_id, {terms_sql("p.description", stop_words, most)} AS terms, f.embedding, fam.family
  FROM projects p LEFT JOIN f ON f.project_path = p.full_path LEFT JOIN fam ON fam.name = p.name{"" if every else " WHERE p.description <> ''"})"""


def bm25_sql(tokens_of: str) -> str:
    """``s``: (query_id, id, bm25), from a CTE body giving (id, tokens) and the CTE ``q``."""
    return f"""d AS ({tokens_of}),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY 1, 2),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * times * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 9) AS bm25
  FROM tf JOIN df USING (term) JOIN asked USING (term), st GROUP BY 1, 2)"""


CHUNK_TOKENS = r"SELECT id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS tokens FROM c"
EPISODE_TOKENS = r"SELECT id, list_concat(coalesce(regexp_extract_all(lower(summary), '[\p{L}\p{N}]+'), []), coalesce(regexp_extract_all(lower(entities), '[\p{L}\p{N}]+'), [])) AS tokens FROM e"
AGED = f"CASE WHEN split_part(path, '/', -1) LIKE '%MEMORY.md' OR NOT regexp_matches(split_part(path, '/', -1), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 1.0 ELSE exp(-0.6931471805599453 / 30 * (({NOW} - updated_at) / 86400000.0)) END"


def cosine_sql(a: str, b: str) -> str:
    return f"coalesce(round(CASE WHEN len({a}) = len({b}) AND list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) > 0 AND list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])) > 0 THEN list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) END, 9), 0.0)"
