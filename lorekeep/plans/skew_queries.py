"""Queries p1_*: per-project and per-session results over all episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import skew
from lorekeep.sources.tables import one_per_id, table, trim_blanks

SHARE = 0.04


def project_key() -> Column:
    return F.lower(trim_blanks(F.col("project")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.keys_with_share(
        table(spark, sf_dir, "episodes"), {"project": project_key(), "session_id": F.col("session_id")}, "id", SHARE
    )


def _profile(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    e = one_per_id(
        table(spark, sf_dir, "episodes").select("id", key.alias("key_value"), "importance", "scope", "summary", "full_content", "created_at", "accessed_at", "access_count"),
        latest=("accessed_at", "access_count"),
    )
    one = lambda c: ("sum", c.cast("bigint"))
    return skew.group_aggregate(
        e,
        "key_value",
        {
            "n_episodes": ("count", F.col("id")),
            "n_high": one(F.col("importance") == "high"),
            "n_global": one(F.col("scope") == "global"),
            "n_with_content": ("count", F.col("full_content")),
            "summary_chars": ("sum", F.length("summary").cast("bigint")),
            "accesses": ("sum", F.col("access_count")),
            "first_created_at": ("min", F.col("created_at")),
            "last_created_at": ("max", F.col("created_at")),
            "last_accessed_at": ("max", F.col("accessed_at")),
        },
        F.col("id"),
    )


def p1_project_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, project_key())


def p1_session_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, F.col("session_id"))


def p1_project_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest episodes of every project."""
    e = one_per_id(table(spark, sf_dir, "episodes").select("id", project_key().alias("key_value"), "created_at"))
    return skew.top_per_key(e, "key_value", [F.col("created_at").desc(), F.col("id")], 3).select("key_value", "rank", "id", "created_at")


def p1_session_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode of a project path that is known, with the project's own row."""
    e = one_per_id(table(spark, sf_dir, "episodes").select("id", "session_id", "project_path"))
    p = table(spark, sf_dir, "projects").select(F.col("full_path").alias("project_path"), F.col("name").alias("project_name"), "parent_project")
    return skew.join_on_key(e, p, "project_path", "inner").select("id", "session_id", "project_path", "project_name", "parent_project")


QUERIES = {f.__name__: f for f in (p1_found, p1_project_profile, p1_session_profile, p1_project_latest, p1_session_sources)}

_E = """e AS (SELECT id, any_value(session_id) AS session_id, any_value(lower(trim(project, ' ' || chr(9) || chr(10) || chr(13)))) AS project,
  any_value(project_path) AS project_path, any_value(importance) AS importance, any_value(scope) AS scope, any_value(summary) AS summary,
  any_value(full_content) AS full_content, any_value(created_at) AS created_at, max(accessed_at) AS accessed_at, max(access_count) AS access_count
  FROM episodes WHERE id IS NOT NULL GROUP BY id)"""


def _profile_sql(key: str) -> str:
    return f"""WITH {_E} SELECT {key} AS key_value, count(*) AS n_episodes, CAST(count(*) FILTER (importance = 'high') AS BIGINT) AS n_high,
  CAST(count(*) FILTER (scope = 'global') AS BIGINT) AS n_global, count(full_content) AS n_with_content,
  CAST(sum(length(summary)) AS BIGINT) AS summary_chars, CAST(sum(access_count) AS BIGINT) AS accesses, min(created_at) AS first_created_at,
  max(created_at) AS last_created_at, max(accessed_at) AS last_accessed_at FROM e WHERE {key} IS NOT NULL GROUP BY 1"""


SQL = {
    "p1_found": f"""WITH {_E}, k AS (SELECT 'project' AS field, project AS key_value, id FROM e UNION ALL SELECT 'session_id', session_id, id FROM e)
SELECT field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {SHARE} * (SELECT count(*) FROM e)""",
    "p1_project_profile": _profile_sql("project"),
    "p1_session_profile": _profile_sql("session_id"),
    "p1_project_latest": f"""WITH {_E}, r AS (SELECT project AS key_value, CAST(row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS INTEGER) AS rank, id, created_at
  FROM e WHERE project IS NOT NULL) SELECT * FROM r WHERE rank <= 3""",
    "p1_session_sources": f"""WITH {_E} SELECT e.id, e.session_id, e.project_path, p.name AS project_name, p.parent_project FROM e JOIN projects p ON p.full_path = e.project_path""",
}
