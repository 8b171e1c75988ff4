"""Okapi BM25 of a stated set of questions against a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.operators.skew import if_small
from lorekeep.session import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Up to as many asked terms the scan itself drops all others; beyond, a join does.
INLINE_TERMS = 10_000


def scores(questions: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, bm25) of every document with a term of a question; more negative is better, rounded to 9 digits.

    ``questions`` has (query_id, terms), ``corpus`` (doc_id, tokens), one row per document. A term that a question
    repeats counts as often. Questions without terms and documents without tokens match nothing. The corpus is read and split
    once: lengths and asked tokens are written down, and all counts come from there.
    """
    asked = written(questions.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    terms = [r["term"] for r in asked.select("term").distinct().limit(INLINE_TERMS + 1).collect()]
    if len(terms) <= INLINE_TERMS:
        kept = F.filter("tokens", lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")
        lengths = written(corpus.select("doc_id", F.size("tokens").alias("dl"), kept.alias("kept")))
        words = lengths.select("doc_id", "dl", F.explode("kept").alias("term"))
    else:
        lengths = corpus.select(F.size("tokens").alias("dl"))
        words = corpus.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(if_small(asked.select("term").distinct()), "term", "left_semi")
    sizes = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
    n, mean = sizes["n"], sizes["mean"] or 1.0
    tf = written(words.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = if_small(written(if_small(asked).join(df, "term").select("query_id", "term", (idf * F.col("times")).alias("weight"))))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(mean))))
    return tf.join(weight, "term").groupBy("query_id", "doc_id").agg(F.round(-F.sum(part), 9).alias("bm25"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of each question, equal scores by doc_id."""
    best = F.row_number().over(W.partitionBy("query_id").orderBy("bm25", "doc_id"))
    return scored.withColumn("place", best).where(F.col("place") <= k).drop("place")
