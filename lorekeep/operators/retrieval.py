"""Hybrid search over chunks, recall of episodes, and rank fusion, for many questions at once.

Every function takes ``questions`` (query_id, terms, embedding and perhaps ``family``: the paths in scope; null or empty
means no scope) and an explicit ``now`` in milliseconds.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from lorekeep.functions.text import decay, evergreen, word_set
from lorekeep.functions.vectors import cosine
from lorekeep.operators import bm25
from lorekeep.operators.skew import if_small
from lorekeep.session import shared_dir, written

#: Most questions whose vectors and families are broadcast.
QUESTIONS = 20_000


def by_query() -> WindowSpec:
    return W.partitionBy("query_id")


def in_family(path: Column, family: Column) -> Column:
    """Whether a path is in scope; everything is where the family is null or empty."""
    return F.coalesce(F.size(family) == 0, F.lit(True)) | family.isNull() | F.coalesce(F.array_contains(family, path), F.lit(False))


def normalised(score: Column, equal: float) -> Column:
    """Scores of a question's candidates mapped so that the best is 1 and the worst 0; ``equal`` if they don't differ, null for null."""
    low, high = F.min(score).over(by_query()), F.max(score).over(by_query())
    return F.when(score.isNotNull(), F.when(low == high, F.lit(equal)).otherwise((score - high) / (low - high)))


def ranked(df: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    place = F.row_number().over(by_query().orderBy(F.col(score).desc(), F.col(tie)))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def clamped(limit: int, most: int = 50) -> int:
    """A limit that a caller asks for, between 1 and ``most``."""
    return max(1, min(most, limit))


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids``: a semi join, which Spark applies before the rows of one id are made one, so that only what is wanted is shuffled."""
    return rows.join(if_small(ids.select("id").distinct()), "id", "left_semi")


def search(questions: DataFrame, chunks: DataFrame, tokens: DataFrame, now: int, limit: int = 10, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, id, path, project_path, text, score, rank): BM25's ``3 * limit`` best chunks, cut to the scope, scored by
    0.7 cosine + 0.3 normalised BM25 and by age (evergreen files don't age). The scope is applied after the cut, so fewer may remain.
    """
    limit = clamped(limit)
    hits = written(bm25.top(bm25.scores(questions, tokens), 3 * limit)) if hits is None else hits
    hits = hits.withColumnRenamed("doc_id", "id")
    c = hits.join(only(chunks, hits), "id").join(if_small(questions.select("query_id", F.col("embedding").alias("asked"), "family"), QUESTIONS), "query_id")
    c = c.where(in_family(F.col("project_path"), F.col("family")) | F.col("project_path").isNull())
    c = c.withColumn("lexical", normalised(F.col("bm25"), 1.0))
    age = F.when(evergreen(F.col("path")), F.lit(1.0)).otherwise(decay(F.col("updated_at"), now))
    score = F.round((0.7 * cosine(F.col("embedding"), F.col("asked")) + 0.3 * F.col("lexical")) * age, 9)
    return ranked(c.select("query_id", "id", "path", "project_path", "text", score.alias("score")), 3 * limit)


def recent_by_vector(questions: DataFrame, chunks: DataFrame, now: int, limit: int = 10) -> DataFrame:
    """What answers a question without lexical hits: the ``3 * limit`` chunks updated last that have a vector, by cosine and age."""
    pool = chunks.where("embedding IS NOT NULL").orderBy(F.col("updated_at").desc(), "id").limit(3 * limit)
    c = questions.select("query_id", F.col("embedding").alias("asked")).crossJoin(F.broadcast(pool))
    age = F.when(evergreen(F.col("path")), F.lit(1.0)).otherwise(decay(F.col("updated_at"), now))
    return ranked(c.select("query_id", "id", "path", F.round(cosine(F.col("embedding"), F.col("asked")) * age, 9).alias("score")), limit)


def search_or_recent(questions: DataFrame, chunks: DataFrame, tokens: DataFrame, now: int, limit: int = 10) -> DataFrame:
    """(query_id, id, path, score, rank): the search of every question that has a lexical hit, and :func:`recent_by_vector` for the others."""
    limit = clamped(limit)
    hits = written(bm25.top(bm25.scores(questions, tokens), 3 * limit))
    found = search(questions, chunks, tokens, now, limit, hits).where(F.col("rank") <= limit)
    others = questions.join(if_small(hits.select("query_id").distinct()), "query_id", "left_anti")
    return found.select("query_id", "id", "path", "score", "rank").unionByName(recent_by_vector(others, chunks, now, limit))


def recollections(questions: DataFrame, episodes: DataFrame, tokens: DataFrame, embedded: DataFrame) -> DataFrame:
    """(query_id, id, similarity, rank), as JSON files in a folder for each question in the shared folder: rank fusion, cut by similarity. A question that finds nothing has no folder."""
    found = fused(questions, episodes, tokens, embedded).select("query_id", "id", "similarity", "rank")
    path = f"{shared_dir(questions.sparkSession)}/recollections-{uuid.uuid4().hex}"
    found.repartition("query_id").write.partitionBy("query_id").json(path)
    return questions.sparkSession.read.schema(found.schema).json(path).select(found.columns)


def diversified(results: DataFrame, limit: int = 10, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over the at most 150 results of each question: (query_id, id, score, rank).

    Greedy: each next result has the greatest ``balance * score - (1 - balance) * (largest Jaccard similarity of its words
    to a chosen one's)``; of equals the one ranked first.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        left = [(i, float(s), set(w)) for i, s, w in zip(pdf["id"], pdf["score"], pdf["words"])]
        chosen: list[tuple] = []
        near = [0.0] * len(left)
        while left and len(chosen) < limit:
            gains = [balance * s - (1 - balance) * n for (_, s, _), n in zip(left, near)]
            k = max(range(len(left)), key=lambda j: (gains[j], -j))
            taken = left.pop(k)
            near.pop(k)
            chosen.append(taken)
            for j, (_, _, w) in enumerate(left):
                both = len(w & taken[2])
                near[j] = max(near[j], 1.0 if not w and not taken[2] else both / (len(w) + len(taken[2]) - both))
        return pd.DataFrame({"query_id": pd.Series([pdf["query_id"].iloc[0]] * len(chosen), dtype=object), "id": pd.Series([c[0] for c in chosen], dtype=object), "score": [c[1] for c in chosen], "rank": range(1, len(chosen) + 1)})

    narrow = results.where(F.col("rank") <= 150).select("query_id", "id", "score", "rank", word_set(F.col("text")).alias("words"))
    return narrow.groupBy("query_id").applyInPandas(choose, "query_id string, id string, score double, rank int")


def recall(questions: DataFrame, episodes: DataFrame, tokens: DataFrame, embedded: DataFrame, now: int, limit: int = 5) -> DataFrame:
    """(query_id, id, score, rank) of episodes: BM25's ``3 * limit`` best in scope and the ``3 * limit`` newest with a vector. ``embedded`` has (id, created_at) of those.

    0.5 relevance (0.7 cosine + 0.3 normalised BM25, at least 0.3 for important ones) + 0.3 age + 0.2 use.
    """
    limit = clamped(limit)
    hits = bm25.top(bm25.scores(questions, tokens), 3 * limit).withColumnRenamed("doc_id", "id")
    newest = embedded.orderBy(F.col("created_at").desc(), "id").limit(3 * limit).select("id")
    pool = questions.select("query_id").crossJoin(F.broadcast(newest)).withColumn("bm25", F.lit(None).cast("double"))
    both = written(hits.select("query_id", "id", "bm25").unionByName(pool).groupBy("query_id", "id").agg(F.max("bm25").alias("bm25")))
    c = both.join(only(episodes, both), "id").join(if_small(questions.select("query_id", F.col("embedding").alias("asked"), "family"), QUESTIONS), "query_id")
    c = c.where((F.col("scope") == "global") | in_family(F.col("project_path"), F.col("family")))
    relevance = 0.7 * cosine(F.col("embedding"), F.col("asked")) + 0.3 * F.coalesce(F.col("lexical"), F.lit(0.0))
    relevance = F.when(F.col("importance") == "high", F.greatest(relevance, F.lit(0.3))).otherwise(relevance)
    used = (F.col("access_count") + 1) / (F.greatest(F.max("access_count").over(by_query()), F.lit(1)) + 1)
    c = c.withColumn("lexical", normalised(F.col("bm25"), 0.5))
    return ranked(c.select("query_id", "id", F.round(0.5 * relevance + 0.3 * decay(F.col("created_at"), now) + 0.2 * used, 9).alias("score")), limit)


def fused(questions: DataFrame, episodes: DataFrame, tokens: DataFrame, embedded: DataFrame, pool: int = 200, hits: int = 50, k: int = 60, limit: int = 3, least: float = 0.25) -> DataFrame:
    """(query_id, id, similarity, score, rank): reciprocal rank fusion of the lexical, vector, recency and use ranks.

    Candidates are the ``pool`` episodes read last that have a vector (``embedded``: id, accessed_at), and the first ``hits`` lexical hits (by id) beside
    them. Equal values share a rank and the next is skipped. The similarity bound is applied after the cut to ``limit``.
    """
    lexical = bm25.scores(questions, tokens).withColumn("place", F.row_number().over(by_query().orderBy("doc_id"))).where(F.col("place") <= hits).select("query_id", F.col("doc_id").alias("id"), "bm25")
    latest = embedded.orderBy(F.col("accessed_at").desc(), "id").limit(pool).select("id")
    pairs = questions.select("query_id").crossJoin(F.broadcast(latest)).withColumn("bm25", F.lit(None).cast("double"))
    both = written(lexical.unionByName(pairs).groupBy("query_id", "id").agg(F.max("bm25").alias("bm25")))
    c = both.join(only(episodes, both).where("embedding IS NOT NULL"), "id").join(if_small(questions.select("query_id", F.col("embedding").alias("asked")), QUESTIONS), "query_id")
    c = c.select("query_id", "id", "bm25", "importance", "created_at", "access_count", cosine(F.col("embedding"), F.col("asked")).alias("similarity"))
    rank = lambda *o: F.rank().over(by_query().orderBy(*o))
    c = c.withColumns({
        "r_lexical": F.when(F.col("bm25").isNotNull(), rank(F.col("bm25").asc_nulls_last())),
        "r_vector": rank(F.col("similarity").desc()),
        "r_recency": rank(F.col("created_at").desc()),
        "r_use": rank(F.col("access_count").desc()),
    })
    score = F.coalesce(0.4 / (k + F.col("r_lexical")), F.lit(0.0)) + 1.0 / (k + F.col("r_vector")) + 0.6 / (k + F.col("r_recency")) + 0.4 / (k + F.col("r_use"))
    score = score + F.when(F.col("importance") == "high", F.lit(1.0 / (k + 1) - 1.0 / (k + 11))).otherwise(0.0)
    return ranked(c.select("query_id", "id", "similarity", F.round(score, 12).alias("score")), limit).where(F.col("similarity") >= least)


def touched(results: DataFrame, episodes: DataFrame, now: int) -> DataFrame:
    """(id, accessed_at): what reading ``results`` changes, to be merged apart from the query."""
    return results.select("id").distinct().join(episodes.select("id"), "id", "left_semi").select("id", F.lit(now).alias("accessed_at"))
