"""Queries p2_* to p8_* and the SQL that some of them are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.jsonl import ISO
from lorekeep.llm.clusters import described, similarity_clusters, split_loose
from lorekeep.llm.conversations import conversations
from lorekeep.llm.encode import decode, encode, token_chunks
from lorekeep.llm.leak import COVERAGE, TILE, WORDS, leaks
from lorekeep.llm.neardup import members, similar_pairs
from lorekeep.llm.neighbours import most_similar
from lorekeep.llm.quality import quality
from lorekeep.session import durable
from lorekeep.sources.tables import table


#: Width of the vectors in use.
DIM = 128


#: Cells that a query of p2_neighbours looks into; without a bound on the cosine most neighbours are far.
WIDE_PROBES = 320


def _neighbours(spark: SparkSession, sf_dir: str, least: float, **more) -> DataFrame:
    out = None
    for name in ("episodes", "chunks"):
        t = most_similar(table(spark, sf_dir, name), "id", "embedding", DIM, 5, least, **more).select(F.lit(name).alias("table_name"), "id", "neighbour", "cosine", "rank")
        out = t if out is None else out.unionByName(t)
    return out


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of all rows for every row whose id's hash is divisible by 50, however similar they are."""
    return _neighbours(spark, sf_dir, -1.0, probes=WIDE_PROBES, asked=lambda i: F.pmod(F.xxhash64(i), F.lit(50)) == 0)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.93 or more of which one row is among the five most similar of the other."""
    return _neighbours(spark, sf_dir, 0.93).select("table_name", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "transcript_entries")).select("session_id", "turn", "entry_id")


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept conversations with speakers, times (microseconds) and texts."""
    return conversations(table(spark, sf_dir, "transcript_entries"), with_text=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "episodes"), "id", ["summary", "full_content"], 3, 5, shingle=3, least_words=10)


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies: for every compared text the smallest id with that text."""
    return members(table(spark, sf_dir, "episodes"), "id", ["summary", "full_content"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters(table(spark, sf_dir, "episodes"), "id", "embedding", DIM, 0.75).select("cluster_id", F.col("id").alias("episode_id"))


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "episodes")
    return e, durable(similarity_clusters(e, "id", "embedding", DIM, 0.75))


def p5_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size, cohesion and three most typical members with their summaries."""
    e, c = _clusters(spark, sf_dir)
    return described(e, c, "id", "embedding", DIM, "summary")


def p5_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that hang together by chains, split around their medoids."""
    e, c = _clusters(spark, sf_dir)
    return split_loose(e, c, "id", "embedding", DIM, 0.75)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, from its ids."""
    return decode(p6_ids(spark, sf_dir))


def p6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in overlapping pieces of 400 tokens."""
    return token_chunks(table(spark, sf_dir, "documents"))


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every item that it holds a passage of, in one piece or in several that cover half of it: tiles, words and coverage."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), tile=TILE, coverage=COVERAGE)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pairs(spark, sf_dir).where(F.col("longest_tile") >= F.least(F.lit(WORDS), F.col("item_words"))).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that leaked: how many documents hold some, most or all of it."""
    return p7_pairs(spark, sf_dir).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("coverage") >= 0.5).alias("n_docs_half"),
        F.count_if(F.col("coverage") >= 1).alias("n_docs_whole"),
        F.max("longest_tile").alias("longest_tile"),
        F.max("coverage").alias("max_coverage"),
    )


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_quality(spark, sf_dir).where(F.col("n_signs") >= 2).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p3_found, p3_turns, p4_found, p4_members, p5_found, p5_described, p5_parts, p6_ids, p6_decoded, p6_chunks, p7_found, p7_pairs, p7_items, p8_found, p8_quality)}

_BLANKS = "[ \\t\\r\\n]"

_P7 = r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
s AS (SELECT item_id, w, CAST(least(12, len(w)) AS INTEGER) AS n FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM s)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
  FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)"""

_P8 = rf"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_BLANKS}+'), lambda x: x <> '') AS w,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS n_chars, length(regexp_replace(text, '[ \t\r\n\p{{L}}\p{{N}}]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?', '…'))) AS n_punctuated,
  (SELECT count(*) FROM (SELECT regexp_replace(lower(unnest(w)), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') AS x) WHERE x IN (SELECT word FROM common_words)) AS n_common FROM d WHERE len(w) > 0)
SELECT doc_id FROM c WHERE CAST(n_symbols * 100 > n_chars * 15 AS INTEGER) + CAST(n_punctuated * 10 < n_lines * 4 AS INTEGER)
  + CAST(n_common * 10 < n_words * 2 AS INTEGER) + CAST(n_chars < n_words * 3 OR n_chars > n_words * 9 AS INTEGER) >= 2"""

def _p3(columns: str) -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(13)"
    return rf"""WITH a AS (SELECT *, coalesce(type, role) AS s, content LIKE '[{{%' AS arr,
  CASE WHEN regexp_matches(msg_timestamp, '{ISO}') THEN epoch_us(TRY_CAST(msg_timestamp AS TIMESTAMPTZ)) END AS t FROM transcript_entries WHERE session_id IS NOT NULL),
b AS (SELECT *, s IN ('user', 'assistant') AS spoken, last_value(t IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_us,
  CASE WHEN NOT arr THEN trim(content, {blanks}) WHEN json_valid(content) THEN trim(array_to_string(list_filter(list_transform(
    list_filter(CAST(content AS JSON[]), lambda x: json_extract_string(x, '$.type') = 'text'), lambda x: json_extract_string(x, '$.text')), lambda x: x <> ''), chr(10)), {blanks}) END AS txt FROM a),
g AS (SELECT session_id FROM b GROUP BY 1 HAVING count(*) = count(DISTINCT line_no) AND min(line_no) = 1 AND max(line_no) = count(*)
  AND count(*) FILTER (spoken AND arr AND NOT json_valid(content)) = 0),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, uuid, CASE WHEN uuid IS NULL THEN s END, CASE WHEN uuid IS NULL THEN txt END, CASE WHEN uuid IS NULL THEN at_us END ORDER BY line_no) AS k
  FROM b WHERE spoken AND txt <> '' AND session_id IN (SELECT session_id FROM g)) WHERE k = 1),
o AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS turn, lag(s) OVER w AS p, lead(s) OVER w AS f, count(*) OVER (PARTITION BY session_id) AS n
  FROM m WINDOW w AS (PARTITION BY session_id ORDER BY at_us NULLS FIRST, line_no)),
bad AS (SELECT DISTINCT session_id FROM o WHERE n < 2 OR (p IS NULL AND s <> 'user') OR (f IS NULL AND s <> 'assistant') OR (p = 'user' AND s = 'user'))
SELECT {columns} FROM o WHERE session_id NOT IN (SELECT session_id FROM bad)"""


_P4_MEMBERS = r"""WITH t AS (SELECT DISTINCT id, 'summary' AS field, summary AS text FROM episodes UNION SELECT DISTINCT id, 'full_content', full_content FROM episodes),
c AS (SELECT * FROM t WHERE id IS NOT NULL AND len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) >= 10)
SELECT field, id, min(id) OVER w AS class_id, count(*) OVER w AS n_copies FROM c WINDOW w AS (PARTITION BY field, text)"""


SQL: dict[str, str] = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents", "p4_members": _P4_MEMBERS, "p3_found": _p3("session_id, turn, entry_id"), "p3_turns": _p3("session_id, turn, entry_id, s AS speaker, at_us, txt AS text"), "p7_found": _P7, "p8_found": _P8}
