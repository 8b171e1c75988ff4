"""Reading the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import ship_package

#: space, tab, carriage return, line feed
BLANKS = " \t\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to as many ids are looked up by a filter that reaches the scan.
LOOKED_UP = 1_000


def looked_up(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of ``df`` with an id in ``ids`` (column ``id_col``)."""
    some = [r[0] for r in ids.select(id_col).distinct().limit(LOOKED_UP + 1).collect()]
    return df.where(F.col(id_col).isin(some)) if len(some) <= LOOKED_UP else df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def one_per_id(df: DataFrame, id_col: str = "id", latest: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``id_col``; of rows sent again the columns in ``latest`` keep their largest value.

    Rows sent again carry the same texts, keys and vectors, so the aggregate may take either row's. Rows without an
    id can't be told apart and are left out. The aggregate combines on the map side, so a row that was sent a million
    times shuffles once per map task.
    """
    rest = [c for c in df.columns if c != id_col]
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        *[(F.max(c) if c in latest else F.first(c)).alias(c) for c in rest]
    ).select(*df.columns)
