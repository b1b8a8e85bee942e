"""Reader of model weights: a table ``model_param`` of idx (from 0) and value, as Parquet or CSV with a header."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.potentials import INPUTS, TRANSITIONS, WIDEST, Model

WEIGHTS = TRANSITIONS * WIDEST * (1 + INPUTS)


def model_weights(table: DataFrame) -> Model:
    """The model of a table. It has a fixed number of weights, which is checked before any reach the driver."""
    rows = table.select(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    found = rows.agg(F.count("value").alias("n"), F.count_distinct("idx").alias("distinct"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    if (found.n, found.distinct, found.low, found.high) != (WEIGHTS, WEIGHTS, 0, WEIGHTS - 1):
        raise ValueError(f"weights 0..{WEIGHTS - 1}, each once, not {found.n} values at {found.distinct} places from {found.low} to {found.high}")
    got = sorted(rows.collect())
    return Model.of(np.array([r.value for r in got]))


def read_model(spark: SparkSession, path: str) -> Model:
    return model_weights(spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path))
