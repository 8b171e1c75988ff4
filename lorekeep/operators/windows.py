"""Running budgets, votes and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, TimestampType

#: Parts that a group is first cut in.
SALTS = 32


def within_budget(df: DataFrame, group: str, newest_first: list[Column], size: Column, budget: int) -> DataFrame:
    """The rows of each group, newest first, until their sizes reach ``budget``: a row stays if those before it are below.

    Each group is first cut within SALTS parts of it, which drops only rows that are beyond the budget there already, so that no
    task sorts a whole large group.
    """
    salt = F.pmod(F.xxhash64(*_plain_columns(df)), F.lit(SALTS)).alias("__salt")

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        before = F.sum("__size").over(W.partitionBy(*by).orderBy(*newest_first).rowsBetween(W.unboundedPreceding, -1))
        return rows.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < budget).drop("__before")

    rows = df.select("*", size.alias("__size"), salt)
    return cut(cut(rows, group, "__salt"), group).drop("__size", "__salt")


def _plain_columns(df: DataFrame) -> list[str]:
    """The columns of plain types, whose hashes spread rows."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, NumericType, TimestampType))]


def with_previous(df: DataFrame, group: str, block: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Each row with the value of the row before it in its group's order, null for the first.

    Rows are ordered within blocks of each group; ``block`` must not fall along ``order``. What a block carries over to the next is one row, so
    that a group of any size is never sorted as a whole.
    """
    rows = df.withColumn("__block", block)
    within = W.partitionBy(group, "__block").orderBy(*order)
    last = rows.groupBy(group, "__block").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(W.partitionBy(group).orderBy("__block"))).drop("__last")
    first = F.row_number().over(within) == 1
    rows = rows.select("*", F.lag(value).over(within).alias("__within"), first.alias("__first")).join(carried, [group, "__block"])
    return rows.withColumn(out, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__within"))).drop("__block", "__within", "__first", "__carried")


def majority(df: DataFrame, group: str, value: str, order: Column) -> DataFrame:
    """(group, value, votes): the most frequent non-null value of each group; of equally frequent ones the one seen first."""
    votes = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    best = votes.groupBy(group).agg(F.min(F.struct((-F.col("votes")).alias("v"), "first", F.col(value).alias("value"))).alias("b"))
    return best.select(group, F.col("b.value").alias(value), (-F.col("b.v")).alias("votes"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``: last writer wins. Combined on the map side, so a hot key costs no more."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in df.columns if c != key])


def last_sections(lines: DataFrame, group: str, most: int) -> DataFrame:
    """Rows (group, section, n_lines): the newest sections of each text that together have at most ``most`` lines, the preamble (section 0) counted and kept, and at least one section."""
    w = W.partitionBy(group)
    newer = F.sum("n_lines").over(w.orderBy(F.col("section").desc()).rowsBetween(W.unboundedPreceding, 0))
    preamble = F.coalesce(F.max(F.when(F.col("section") == 0, F.col("n_lines"))).over(w), F.lit(0))
    last = F.max("section").over(w)
    c = lines.withColumns({"__newer": newer, "__preamble": preamble, "__last": last})
    keep = (F.col("section") == 0) | (F.col("section") == F.col("__last")) | (F.col("__newer") + F.col("__preamble") <= most)
    return c.where(keep).drop("__newer", "__preamble", "__last")
