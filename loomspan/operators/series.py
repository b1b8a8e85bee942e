"""Numbers along an order within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour_correlation(df: DataFrame, key: str, order: list[str], value: str, reach: int = 4, weight: float = 0.1) -> DataFrame:
    """key, correlation: ``weight`` times the sum of products of each value with the ``reach`` values before it."""
    along = Window.partitionBy(key).orderBy(*order)
    near = sum((F.coalesce(F.lag(value, k).over(along), F.lit(0.0)) for k in range(1, reach + 1)), F.lit(0.0))
    return df.select(key, (F.col(value) * near).alias("v")).groupBy(key).agg((weight * F.sum("v")).alias("correlation"))


def weighted_choice(df: DataFrame, key: str, order: list[str], weight: str, share: Column) -> DataFrame:
    """key, chosen_run: the running sum of weights at the row that a share (0 to 1) of the key's total falls on."""
    whole = Window.partitionBy(key)
    run = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(key, F.sum(weight).over(run).alias("run"), F.sum(weight).over(whole).alias("total"), share.alias("share"))
    return rows.where(F.col("run") > F.col("share") * F.col("total")).groupBy(key).agg(F.min("run").alias("chosen_run"))


def shares(df: DataFrame, key: str, symbol: str) -> DataFrame:
    """key, symbol, share: each symbol's part of a key's rows."""
    counts = df.groupBy(key, symbol).agg(F.count("*").alias("n"))
    return counts.select(key, symbol, (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def shifted(key: str, order: str, value: str, offsets: list[int], scale: float = 100.0) -> Column:
    """Scaled whole numbers of the values at some offsets along the order; 0 outside."""
    along = Window.partitionBy(key).orderBy(order)
    parts = [F.coalesce(F.lead(value, k).over(along) if k > 0 else F.lag(value, -k).over(along), F.lit(0.0)) if k else F.col(value) for k in offsets]
    return F.transform(F.array(*parts), lambda x: (x * scale).cast("int"))
