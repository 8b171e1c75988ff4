"""Per-key results and joins where a few keys hold most rows.

Method: the heavy keys come from one pass of a frequent-items sketch; rows of heavy keys are found with a broadcast
join against that (bounded) list and are spread over salts; all other rows take the ordinary shuffle on their key; the
two results are united. The sketch only decides which way a key goes, never what comes out, so a key that it misses or
lists for nothing changes the run time alone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy from this share of the rows on; at most 2 / HEAVY_SHARE keys can pass the sketch's test.
HEAVY_SHARE = 0.005
SALTS = 64
#: Counters of the sketch; its error is a small multiple of rows / TRACKED.
TRACKED = 16_384

#: How partial results of an aggregate are merged.
MERGED_BY = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "distinct": F.sum}


#: Most rows that are broadcast.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """The keys that may hold at least ``share`` of the rows: at most ``2 / share`` values. Null is never listed."""
    k = int(2 / share)
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {k}, {max(TRACKED, 4 * k)})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [r["item"] for r in sketch["top"] or [] if 2 * r["count"] >= share * sketch["n"]]


def _split(df: DataFrame, key: str, share: float) -> tuple[DataFrame | None, DataFrame]:
    """Rows of heavy keys (None if there are none), and the others; null keys belong to the others."""
    heavy = heavy_keys(df, key, share)
    if not heavy:
        return None, df
    field = T.StructField("__heavy", df.schema[key].dataType)
    listed = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in heavy], T.StructType([field])))
    on = F.col(key) == F.col("__heavy")
    return df.join(listed, on, "left_semi"), df.join(listed, on, "left_anti")


def _aggregate(kind: str, of: Column) -> Column:
    return F.count_distinct(of) if kind == "distinct" else {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[kind](of)


def group_aggregate(
    df: DataFrame, key: str, aggs: Mapping[str, tuple[str, Column]], spread_by: Column, share: float = HEAVY_SHARE, salts: int = SALTS
) -> DataFrame:
    """``df.groupBy(key).agg(...)`` with the work for heavy keys spread over ``salts`` groups.

    ``aggs`` maps a result column to (``count`` | ``sum`` | ``min`` | ``max`` | ``distinct``, column). ``spread_by`` is
    hashed into the salt; a ``distinct`` aggregate must count a function of it, as every value then falls into one salt
    and the partial counts add up. Null keys form no group. An empty input gives an empty result; equal rows count as
    often as they occur; other columns, whatever their names, are ignored.
    """
    names = list(aggs)
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), spread_by.alias("__spread"), *[c.alias(f"__v{i}") for i, (_, c) in enumerate(aggs.values())]
    )
    heavy, rest = _split(rows, "__key", share)
    parts = [_aggregate(kind, F.col(f"__v{i}")).alias(f"__v{i}") for i, (kind, _) in enumerate(aggs.values())]
    out = rest.groupBy("__key").agg(*parts)
    if heavy is not None:
        salted = heavy.groupBy("__key", F.pmod(F.xxhash64("__spread"), F.lit(salts)).alias("__salt")).agg(*parts)
        out = out.unionByName(
            salted.groupBy("__key").agg(*[MERGED_BY[kind](f"__v{i}").alias(f"__v{i}") for i, (kind, _) in enumerate(aggs.values())])
        )
    return out.select(F.col("__key").alias(key), *[F.col(f"__v{i}").alias(n) for i, n in enumerate(names)])


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int, salts: int = SALTS, share: float = HEAVY_SHARE) -> DataFrame:
    """The first ``n`` rows of each key by ``order`` (which must be total), numbered in ``rank``.

    Heavy keys are first cut to ``n`` rows within each salt, then to ``n`` rows over the salts, so that no task sorts a
    whole heavy key. Null keys form no group; a column ``rank`` of the input is replaced.
    """
    from pyspark.sql import Window as W

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)

    rows = df.where(F.col(key).isNotNull())
    heavy, rest = _split(rows, key, share)
    out = cut(rest, key)
    if heavy is not None:
        salted = heavy.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in heavy.columns if c != key]), F.lit(salts)))
        out = out.unionByName(cut(cut(salted, key, "__salt").drop("rank"), key).drop("__salt"))
    return out


def join_on_key(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: float = HEAVY_SHARE, broadcast_rows: int = 100_000, salts: int = SALTS) -> DataFrame:
    """``left.join(right, key, how)`` for ``how`` in (``inner``, ``left``) where a few keys hold most rows of ``left``.

    The rows of ``right`` that have a heavy key are counted: up to ``broadcast_rows`` they are broadcast, beyond that
    they are copied to every salt and shuffled. All other keys take an ordinary shuffled join. Null keys match nothing.
    Columns of ``right`` that ``left`` also has come out with the suffix ``_right``.
    """
    right = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c != key and c in left.columns})
    heavy, rest = _split(left, key, share)
    out = rest.join(right, key, how)
    if heavy is None:
        return out
    keys = F.broadcast(heavy.select(key).distinct())
    matching = right.join(keys, key, "left_semi")
    if matching.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hot = heavy.join(F.broadcast(matching), key, how)
    else:
        salted = heavy.withColumn("__salt", F.pmod(F.xxhash64(*heavy.columns), F.lit(salts)).cast("int"))
        copies = matching.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hot = salted.join(copies, [key, "__salt"], how).drop("__salt")
    return out.unionByName(hot)


def keys_with_share(df: DataFrame, fields: Mapping[str, Column], id_col: str, share: float) -> DataFrame:
    """(``field``, ``key_value``) of the keys that hold at least ``share`` of all distinct ids.

    Ids that are null count nowhere; a key that is null is none. An empty input has no such keys.
    """
    total = df.agg(F.count_distinct(id_col)).scalar()
    out = None
    for name, c in fields.items():
        per_key = group_aggregate(
            df.select(c.alias("key_value"), F.col(id_col).alias("__id")), "key_value", {"n": ("distinct", F.col("__id"))}, F.col("__id")
        ).where((F.col("n") > 0) & (F.col("n") >= share * total)).select(F.lit(name).alias("field"), "key_value")
        out = per_key if out is None else out.unionByName(per_key)
    return out
