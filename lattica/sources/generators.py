"""Matrices made by rule; every generator is a function of its arguments, seeds included."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.model import SparseMatrix


def uniform(spark: SparkSession, n_rows: int, n_cols: int, per_row: int, seed: int = 0) -> SparseMatrix:
    """`per_row` different columns in every row, value 1.

    Draws are hashes of (row, draw, seed). Four times as many draws as needed and more are made; the first
    `per_row` different columns in draw order stay.
    """
    if per_row > n_cols:
        raise ValueError("a row cannot have more entries than columns")
    if per_row * 2 > n_cols:  # nearly full rows: rank all columns by hash
        draws = spark.range(n_rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long"))).alias("col"))
        ranked = draws.withColumn("draw", F.xxhash64("row", "col", F.lit(seed)))
        order = Window.partitionBy("row").orderBy("draw", "col")
        entries = ranked.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_row)
    else:  # a row's draws are an array of its own: nothing is moved, and a task holds one row's draws
        draws = F.transform(F.sequence(F.lit(0), F.lit(4 * per_row + 63)), lambda draw: F.pmod(F.xxhash64("row", draw, F.lit(seed)), F.lit(n_cols)))
        entries = spark.range(n_rows).withColumnRenamed("id", "row").select("row", F.explode(F.slice(F.array_distinct(draws), 1, per_row)).alias("col"))
    return SparseMatrix(entries.select("row", "col", F.lit(1.0).alias("val")), n_rows, n_cols)


def dense(spark: SparkSession, n_rows: int, n_cols: int, value: float = 1.0) -> SparseMatrix:
    cells = spark.range(n_rows * n_cols)
    return SparseMatrix(cells.select(F.floor(F.col("id") / n_cols).alias("row"), F.pmod("id", F.lit(n_cols)).alias("col"), F.lit(value).alias("val")), n_rows, n_cols)


def wheel(spark: SparkSession, spokes: int) -> SparseMatrix:
    """Row 0 reaches every rim node 1..spokes; rim node i reaches the next one around."""
    hub = spark.range(spokes).select(F.lit(0).cast("long").alias("row"), (F.col("id") + 1).alias("col"))
    rim = spark.range(spokes).select((F.col("id") + 1).alias("row"), (F.pmod(F.col("id") + 1, F.lit(spokes)) + 1).alias("col"))
    return SparseMatrix(hub.unionByName(rim).withColumn("val", F.lit(1.0)), spokes + 1, spokes + 1)


def lattice(spark: SparkSession, width: int, dims: int, self_loop: bool = False) -> SparseMatrix:
    """Neighbours in a cube lattice of `dims` dimensions; node numbers run fastest along the first."""
    n = width**dims
    nodes = spark.range(n)
    parts: list[DataFrame] = []
    for d in range(dims):
        at = F.pmod(F.floor(F.col("id") / width**d), F.lit(width))
        for step in (-1, 1):
            inside = (at + step >= 0) & (at + step < width)
            parts.append(nodes.filter(inside).select(F.col("id").alias("row"), (F.col("id") + step * width**d).alias("col")))
    if self_loop:
        parts.append(nodes.select(F.col("id").alias("row"), F.col("id").alias("col")))
    return SparseMatrix(functools.reduce(DataFrame.unionByName, parts).withColumn("val", F.lit(1.0)), n, n)
