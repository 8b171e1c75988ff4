"""Queries ir_* (retrieval) and hier_* (projects)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions.text import STOP_WORDS, jaccard, query_terms, word_set
from lorekeep.operators import bm25, hierarchy, retrieval, windows
from lorekeep.operators.skew import top_per_key
from lorekeep.plans.common import AGED, C, CHUNK_TOKENS, E, EPISODE_TOKENS, NOW, UP, bm25_sql, chunk_tokens, chunks, cosine_sql, episode_tokens, episodes, questions, questions_sql, terms_sql
from lorekeep.session import written
from lorekeep.sources.tables import table


HOUR_MS = 3_600_000


def ir_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 best chunks for each question."""
    found = bm25.top(bm25.scores(questions(spark, sf_dir), chunk_tokens(spark, sf_dir)), 30)
    return found.withColumnRenamed("doc_id", "id")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(questions(spark, sf_dir), chunks(spark, sf_dir, "path", "project_path", "text", "embedding", "updated_at"), chunk_tokens(spark, sf_dir), NOW)


def ir_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).select("query_id", "id", "path", "score", "rank")


def ir_search_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.diversified(_search(spark, sf_dir))


def ir_search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recent_by_vector(questions(spark, sf_dir), chunks(spark, sf_dir, "path", "embedding", "updated_at"), NOW)


def ir_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results as lines: number, file, score and the first 500 characters."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("path"), F.lit(" — score "), F.format_string("%.3f", F.round("score", 3)), F.lit("\n"), F.substring("text", 1, 500))
    return _search(spark, sf_dir).where("rank <= 3").select("query_id", "rank", line.alias("line"))


def _embedded(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    return episodes(spark, sf_dir, at, where="embedding IS NOT NULL")


def ir_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir, "scope", "project_path", "importance", "embedding", "created_at", "access_count")
    return retrieval.recall(questions(spark, sf_dir), e, episode_tokens(spark, sf_dir), _embedded(spark, sf_dir, "created_at"), NOW)


def ir_recall_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with a limit beyond what is allowed: it gives 50 at most."""
    e = episodes(spark, sf_dir, "scope", "project_path", "importance", "embedding", "created_at", "access_count")
    return retrieval.recall(questions(spark, sf_dir), e, episode_tokens(spark, sf_dir), _embedded(spark, sf_dir, "created_at"), NOW, 1000)


def ir_search_or_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for every project; those without a description have no lexical hits and get recent chunks."""
    c = chunks(spark, sf_dir, "path", "project_path", "text", "embedding", "updated_at")
    return retrieval.search_or_recent(questions(spark, sf_dir, every=True), c, chunk_tokens(spark, sf_dir), NOW)


def ir_recollect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each project's newest episode recollects, if it opens a new topic: the gate, candidates, rank fusion and the similarity bound in one go."""
    from lorekeep.functions.vectors import cosine

    e = episodes(spark, sf_dir, "project_path", "summary", "importance", "embedding", "created_at", "accessed_at", "access_count")
    two = top_per_key(e.where("embedding IS NOT NULL AND project_path IS NOT NULL").select("project_path", "id", "summary", "embedding", "created_at"), "project_path", [F.col("created_at").desc(), F.col("id").desc()], 2)
    two = two.groupBy("project_path").agg(F.max(F.when(F.col("rank") == 1, F.col("summary"))).alias("summary"), *[F.max(F.when(F.col("rank") == k, F.col("embedding"))).alias(n) for k, n in ((1, "embedding"), (2, "before"))])
    new = two.where(F.col("before").isNull() | (cosine(F.col("embedding"), F.col("before")) <= 0.85))
    q = written(new.select(F.col("project_path").alias("query_id"), query_terms(F.substring("summary", 1, 6000), True, 20).alias("terms"), "embedding"))
    return retrieval.recollections(q, e, episode_tokens(spark, sf_dir), _embedded(spark, sf_dir, "accessed_at"))


def ir_recall_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes whose time of last reading recall sets."""
    return retrieval.touched(ir_recall(spark, sf_dir), episodes(spark, sf_dir), NOW)


def ir_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir, "importance", "embedding", "created_at", "accessed_at", "access_count")
    return retrieval.fused(questions(spark, sf_dir, True, 20), e, episode_tokens(spark, sf_dir), _embedded(spark, sf_dir, "accessed_at"))


def ir_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the words of neighbouring chunks of a file."""
    c = chunks(spark, sf_dir, "path", "start_line", "text").select("id", "path", "start_line", word_set(F.col("text")).alias("words"))
    w = W.partitionBy("path").orderBy(F.col("start_line").asc_nulls_last(), "id")
    c = c.withColumns({"next_id": F.lead("id").over(w), "next_words": F.lead("words").over(w)}).where("next_id IS NOT NULL")
    return c.select("id", "next_id", F.round(jaccard(F.col("words"), F.col("next_words")), 9).alias("similarity"))


def ir_topic_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of a session whose vector is closer than 0.85 to that of the one before (the last that had a vector): no new topic."""
    from lorekeep.functions.vectors import cosine

    e = episodes(spark, sf_dir, "session_id", "created_at", "embedding").where("embedding IS NOT NULL")
    e = windows.with_previous(e, "session_id", F.floor(F.col("created_at") / HOUR_MS), ["created_at", "id"], "embedding", "previous")
    e = e.where("previous IS NOT NULL").select("session_id", "id", cosine(F.col("embedding"), F.col("previous")).alias("similarity"))
    return e.where("similarity > 0.85")


def hier_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.ancestors(table(spark, sf_dir, "projects"))


def hier_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.roots(table(spark, sf_dir, "projects"))


def hier_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.families(table(spark, sf_dir, "projects")).select("name", F.array_join("family", "|").alias("family"))


def hier_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known project above every path of documents."""
    return hierarchy.nearest(table(spark, sf_dir, "documents").select("path"), table(spark, sf_dir, "projects"), "path")


def hier_parents_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose stored parent isn't the nearest project above their path."""
    p = table(spark, sf_dir, "projects")
    near = hierarchy.nearest(p.select("full_path"), p, "full_path").withColumnRenamed("project", "nearest")
    return p.join(near, "full_path").where("NOT parent_project <=> nearest").select("full_path", "parent_project", "nearest")


def hier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by topmost project."""
    counts = episodes(spark, sf_dir, "project_path").where("project_path IS NOT NULL").groupBy("project_path").agg(F.count(F.lit(1)).alias("n"))
    return hierarchy.rolled_up(counts, table(spark, sf_dir, "projects"))


def hier_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project of each session by the files of its project's documents that it names: paths of its episodes' projects and of its logs."""
    e = table(spark, sf_dir, "episodes").where("project_path IS NOT NULL").select("session_id", F.concat("project_path", F.lit("/"), "id").alias("path"))
    t = table(spark, sf_dir, "transcript_entries").where("cwd IS NOT NULL").select("session_id", F.concat("cwd", F.lit("/"), "line_no").alias("path"))
    return hierarchy.inferred(e.unionByName(t), table(spark, sf_dir, "projects"), "session_id", "path")


QUERIES = {f.__name__: f for f in (ir_bm25, ir_search, ir_search_diverse, ir_search_fallback, ir_search_text, ir_search_or_recent, ir_recall, ir_recall_most, ir_recall_touched, ir_recollect, ir_fused, ir_word_overlap, ir_topic_change,
                                   hier_ancestors, hier_roots, hier_families, hier_nearest, hier_parents_changed, hier_rollup, hier_inferred)}


def inferred_sql(g: str) -> str:
    """What follows a CTE ``p`` of distinct (``g``, path)."""
    return f"""n AS (SELECT {g}, count(*) AS n_paths FROM p GROUP BY 1),
v AS (SELECT {g}, project, count(*) AS votes FROM (SELECT {g}, (SELECT arg_max(full_path, length(full_path)) FROM projects x WHERE starts_with(p.path, x.full_path || '/')) AS project FROM p) WHERE project IS NOT NULL GROUP BY 1, 2),
b AS (SELECT {g}, arg_max(project, (votes, project)) AS project, max(votes) AS votes FROM v GROUP BY 1),
g AS (SELECT {g}, path, string_split(path, '/') AS s FROM p),
k AS (SELECT {g}, dir, count(*) AS k FROM (SELECT {g}, path, array_to_string(s[1:unnest(generate_series(2, len(s) - 1))], '/') AS dir FROM g) GROUP BY 1, 2),
c AS (SELECT k.{g}, arg_max(dir, length(dir)) AS dir FROM k JOIN n ON n.{g} = k.{g} AND k.k = n.n_paths GROUP BY 1),
h AS (SELECT {g}, (SELECT arg_max(full_path, length(full_path)) FROM projects x WHERE starts_with(c.dir || '/', x.full_path || '/')) AS home FROM c)
SELECT n.{g}, CASE WHEN n_paths >= 2 THEN coalesce(CASE WHEN len(string_split(home, '/')) > 3 THEN home END, CASE WHEN votes >= n_paths * 0.6 THEN project END) END AS project, n_paths, coalesce(votes, 0) AS votes
FROM n LEFT JOIN b USING ({g}) LEFT JOIN h USING ({g})"""


_TOP = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS k FROM s) WHERE k <= 30)"


def _chunk_sql(every: bool) -> str:
    return f"WITH RECURSIVE {UP}, {E}, {C}, {questions_sql(every=every)}, {bm25_sql(CHUNK_TOKENS)}, {_TOP}"


_CHUNK = _chunk_sql(False)
_SEARCH_TAIL = f"""x AS (SELECT t.query_id, c.id, c.path, c.text, c.updated_at, bm25, {cosine_sql("c.embedding", "q.embedding")} AS sim FROM t JOIN c ON c.id = t.id JOIN q ON q.query_id = t.query_id
  WHERE c.project_path IS NULL OR q.family IS NULL OR len(q.family) = 0 OR list_contains(q.family, c.project_path)),
y AS (SELECT *, round((0.7 * sim + 0.3 * CASE WHEN min(bm25) OVER w = max(bm25) OVER w THEN 1.0 ELSE (bm25 - max(bm25) OVER w) / (min(bm25) OVER w - max(bm25) OVER w) END) * {AGED}, 9) AS score FROM x WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM y)"""
_SEARCH = f"{_CHUNK}, {_SEARCH_TAIL}"


def _recall_sql(limit: int, columns: str = "*") -> str:
    return f"""WITH RECURSIVE {UP}, {E}, {questions_sql()}, {bm25_sql(EPISODE_TOKENS)},
t AS (SELECT query_id, id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS k FROM s) WHERE k <= {3 * limit}),
n AS (SELECT id FROM e WHERE embedding IS NOT NULL ORDER BY created_at DESC, id LIMIT {3 * limit}),
b AS (SELECT query_id, id, max(bm25) AS bm25 FROM (SELECT * FROM t UNION ALL SELECT query_id, id, NULL FROM q, n) GROUP BY 1, 2),
x AS (SELECT b.query_id, e.id, bm25, importance, created_at, access_count, {cosine_sql("e.embedding", "q.embedding")} AS sim FROM b JOIN e USING (id) JOIN q ON q.query_id = b.query_id
  WHERE scope = 'global' OR q.family IS NULL OR len(q.family) = 0 OR coalesce(list_contains(q.family, project_path), false)),
y AS (SELECT *, 0.7 * sim + 0.3 * coalesce(CASE WHEN bm25 IS NULL THEN NULL WHEN min(bm25) OVER w = max(bm25) OVER w THEN 0.5 ELSE (bm25 - max(bm25) OVER w) / (min(bm25) OVER w - max(bm25) OVER w) END, 0.0) AS rel,
  (access_count + 1) / (greatest(max(access_count) OVER w, 1) + 1) AS used FROM x WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT query_id, id, round(0.5 * CASE WHEN importance = 'high' THEN greatest(rel, 0.3) ELSE rel END + 0.3 * exp(-0.6931471805599453 / 30 * (({NOW} - created_at) / 86400000.0)) + 0.2 * used, 9) AS score FROM y),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM z)
SELECT {columns} FROM r WHERE rank <= {limit}"""


_FUSED = f"""{bm25_sql(EPISODE_TOKENS)},
t AS (SELECT query_id, id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM s) WHERE k <= 50),
n AS (SELECT id FROM e WHERE embedding IS NOT NULL ORDER BY accessed_at DESC, id LIMIT 200),
b AS (SELECT query_id, id, max(bm25) AS bm25 FROM (SELECT * FROM t UNION ALL SELECT query_id, id, NULL FROM q, n) GROUP BY 1, 2),
x AS (SELECT b.query_id, e.id, bm25, importance, created_at, access_count, {cosine_sql("e.embedding", "q.embedding")} AS similarity FROM b JOIN e USING (id) JOIN q ON q.query_id = b.query_id WHERE e.embedding IS NOT NULL),
y AS (SELECT *, CASE WHEN bm25 IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY bm25 NULLS LAST) END AS r1, rank() OVER (PARTITION BY query_id ORDER BY similarity DESC) AS r2,
  rank() OVER (PARTITION BY query_id ORDER BY created_at DESC) AS r3, rank() OVER (PARTITION BY query_id ORDER BY access_count DESC) AS r4 FROM x),
z AS (SELECT query_id, id, similarity, round(coalesce(CAST(0.4 AS DOUBLE) / (60 + r1), 0.0) + CAST(1 AS DOUBLE) / (60 + r2) + CAST(0.6 AS DOUBLE) / (60 + r3) + CAST(0.4 AS DOUBLE) / (60 + r4)
  + CASE WHEN importance = 'high' THEN CAST(1 AS DOUBLE) / 61 - CAST(1 AS DOUBLE) / 71 ELSE 0 END, 12) AS score FROM y)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM z) WHERE rank <= 3 AND similarity >= 0.25"""

SQL = {
    "ir_bm25": f"{_CHUNK} SELECT query_id, id, bm25 FROM t",
    "ir_search": f"{_SEARCH} SELECT query_id, id, path, score, rank FROM z",
    "ir_search_text": f"{_SEARCH} SELECT query_id, rank, '[' || rank || '] ' || path || ' — score ' || format('{{:.3f}}', round(score, 3) + 0.0) || chr(10) || substring(text, 1, 500) AS line FROM z WHERE rank <= 3",
    "ir_search_diverse": f"""{_SEARCH}, g AS (SELECT query_id, list(struct_pack(id := id, score := score, w := list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> ''))) ORDER BY rank) AS left_
  FROM z WHERE rank <= 150 GROUP BY 1),
r AS (SELECT query_id, 0 AS n, left_, left_[1:0] AS chosen FROM g UNION ALL
  SELECT query_id, n + 1, list_concat(left_[1:best - 1], left_[best + 1:]), list_append(chosen, left_[best]) FROM (SELECT *, list_position(gains, list_max(gains)) AS best FROM (
    SELECT *, list_transform(left_, lambda x: 0.7::DOUBLE * x.score - (1 - 0.7::DOUBLE) * coalesce(list_max(list_transform(chosen, lambda y: CASE WHEN len(x.w) = 0 AND len(y.w) = 0 THEN 1.0::DOUBLE
      ELSE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) END)), 0)) AS gains FROM r WHERE n < 10 AND len(left_) > 0)))
SELECT query_id, id, score, rank FROM (SELECT query_id, unnest(chosen).id AS id, unnest(chosen).score AS score, CAST(unnest(generate_series(1, len(chosen))) AS INTEGER) AS rank
  FROM (SELECT query_id, arg_max(chosen, n) AS chosen FROM r GROUP BY 1))""",
    "ir_search_fallback": f"""WITH RECURSIVE {UP}, {E}, {C}, {questions_sql()}, p AS (SELECT * FROM c WHERE embedding IS NOT NULL ORDER BY updated_at DESC, id LIMIT 30),
x AS (SELECT query_id, id, path, round({cosine_sql("p.embedding", "q.embedding")} * {AGED}, 9) AS score FROM q, p)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM x) WHERE rank <= 10""",
    "ir_recall": _recall_sql(5),
    "ir_recall_touched": _recall_sql(5, f"DISTINCT id, CAST({NOW} AS BIGINT) AS accessed_at"),
    "ir_fused": f"WITH RECURSIVE {UP}, {E}, {questions_sql(STOP_WORDS, 20)}, {_FUSED}",
    "ir_recollect": f"""WITH {E}, w AS (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY created_at DESC, id DESC) AS k FROM e WHERE embedding IS NOT NULL AND project_path IS NOT NULL),
q AS (SELECT a.project_path AS query_id, {terms_sql("substring(a.summary, 1, 6000)", STOP_WORDS, 20)} AS terms, a.embedding FROM w a LEFT JOIN w b ON b.project_path = a.project_path AND b.k = 2
  WHERE a.k = 1 AND (b.id IS NULL OR {cosine_sql("a.embedding", "b.embedding")} <= 0.85)), {_FUSED.replace("SELECT * FROM (", "SELECT query_id, id, similarity, rank FROM (")}""",
    "ir_search_or_recent": f"""{_chunk_sql(True)}, {_SEARCH_TAIL}, p AS (SELECT * FROM c WHERE embedding IS NOT NULL ORDER BY updated_at DESC, id LIMIT 30),
v AS (SELECT query_id, p.id, path, round({cosine_sql("p.embedding", "q.embedding")} * {AGED}, 9) AS score FROM q, p WHERE query_id NOT IN (SELECT query_id FROM s))
SELECT query_id, id, path, score, rank FROM z WHERE rank <= 10 UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM v) WHERE rank <= 10""",
    "ir_recall_most": _recall_sql(50),
    "ir_word_overlap": f"""WITH {C}, w AS (SELECT id, path, start_line, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS w FROM c),
n AS (SELECT id, w, lead(id) OVER o AS next_id, lead(w) OVER o AS v FROM w WINDOW o AS (PARTITION BY path ORDER BY start_line NULLS LAST, id))
SELECT id, next_id, round(CASE WHEN len(w) = 0 AND len(v) = 0 THEN 1.0 ELSE len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) END, 9) AS similarity FROM n WHERE next_id IS NOT NULL""",
    "ir_topic_change": f"""WITH {E}, p AS (SELECT session_id, id, embedding, last_value(embedding IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM e),
x AS (SELECT session_id, id, {cosine_sql("embedding", "previous")} AS similarity FROM p WHERE embedding IS NOT NULL AND previous IS NOT NULL) SELECT * FROM x WHERE similarity > 0.85""",
    "hier_ancestors": f"WITH RECURSIVE {UP} SELECT full_path, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2",
    "hier_roots": f"WITH RECURSIVE {UP} SELECT full_path, arg_max(ancestor, (depth, ancestor)) AS root FROM up GROUP BY 1",
    "hier_families": f"WITH RECURSIVE {UP} SELECT p.name, array_to_string(list_sort(list(DISTINCT up.full_path)), '|') AS family FROM projects p JOIN up ON up.ancestor = p.full_path GROUP BY 1",
    "hier_nearest": "SELECT path, (SELECT arg_max(full_path, length(full_path)) FROM projects p WHERE starts_with(d.path, p.full_path || '/')) AS project FROM (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL) d",
    "hier_parents_changed": """WITH n AS (SELECT full_path, parent_project, (SELECT arg_max(p.full_path, length(p.full_path)) FROM projects p WHERE starts_with(d.full_path, p.full_path || '/')) AS nearest FROM projects d)
SELECT * FROM n WHERE parent_project IS DISTINCT FROM nearest""",
    "hier_rollup": f"""WITH RECURSIVE {UP}, {E}, r AS (SELECT full_path, arg_max(ancestor, (depth, ancestor)) AS root FROM up GROUP BY 1)
SELECT coalesce(root, project_path) AS root, count(*) AS n FROM e LEFT JOIN r ON r.full_path = e.project_path WHERE project_path IS NOT NULL GROUP BY 1""",
    "hier_inferred": f"""WITH p AS (SELECT DISTINCT session_id, path FROM (SELECT session_id, project_path || '/' || id AS path FROM episodes WHERE project_path IS NOT NULL UNION ALL
  SELECT session_id, cwd || '/' || line_no FROM transcript_entries WHERE cwd IS NOT NULL) WHERE path LIKE '/%'),
{inferred_sql("session_id")}""",
}
