"""Sums in log space by key, as a pair of a maximum and a scaled sum that merges in any order.

Spark's own aggregates need the maximum first, hence a window or a second pass over all rows. Here each task merges its rows
into one pair a key before the shuffle, so a frequent key moves one row a task, and the plan has one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task holds before it lets its pairs go; more of them only means more pairs.
HELD = 200_000


def merged(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """One row a key of rows with the pair (most, scaled): the sum is e^most times scaled."""
    groups = rows.groupby(keys, dropna=False, sort=False)
    code = groups.ngroup().to_numpy()
    out = groups.first()[[]].reset_index()
    most = np.full(len(out), -np.inf)
    np.maximum.at(most, code, rows["most"].to_numpy())
    by = np.where(np.isfinite(most), most, 0.0)
    out["most"], out["scaled"] = most, np.bincount(code, rows["scaled"].to_numpy() * np.exp(rows["most"].to_numpy() - by[code]), len(out))
    return out


def log_sum_exp_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and lse: ln of the sum of e^value over the rows of each key. Null values don't count; a key of only such rows has
    none, one of minus infinity only has that. Keys may be null."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            rows = frame.rename(columns={value: "most"}).assign(scaled=1.0)
            held = merged(rows if held is None else pd.concat([held, rows], ignore_index=True), keys) if len(rows) else held
            if held is not None and len(held) > HELD:
                yield held
                held = None
        if held is not None:
            yield held

    kinds = dict(df.dtypes)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    pairs = rows.mapInPandas(partial, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, most double, scaled double")
    whole = pairs.groupBy(*keys).agg(F.max("most").alias("top"), F.collect_list(F.struct("most", "scaled")).alias("z"))
    by = F.when(F.col("top") > float("-inf"), F.col("top")).otherwise(0.0)
    scaled = F.aggregate("z", F.lit(0.0), lambda acc, p: acc + p["scaled"] * F.exp(p["most"] - by))
    return whole.select(*keys, F.when(F.col("top") > float("-inf"), F.col("top") + F.ln(scaled)).otherwise(F.col("top")).alias("lse"))
