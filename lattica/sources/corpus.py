"""A catalog of matrices as DataFrames: selection, names, what is missing, and resumable feature files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.session import cut

#: Selection of the matrices that a corpus is built from.
LEAST_NNZ, MOST_NNZ, LEAST_ROWS = 50_000, 60_000_000, 9_000

#: Search settings, with the values that a search starts from.
SETTINGS = {
    "padding_rate_up_bound": 4,
    "branch_compress_max_size": 5,
    "most_gflops": 500,
    "most_blocks": 4,
    "struggle_steps": 10,
}


def settings(text: str | None = None) -> dict:
    """Settings, overridden by a JSON object."""
    return SETTINGS | (json.loads(text) if text else {})


def select_matrices(catalog: DataFrame) -> DataFrame:
    """Catalog rows (name, group_name, n_rows, nnz) within the bounds; a name in several groups gets its group as suffix."""
    chosen = catalog.filter(F.col("nnz").between(LEAST_NNZ, MOST_NNZ) & (F.col("n_rows") >= LEAST_ROWS))
    shared = F.count("*").over(Window.partitionBy("name")) > 1
    return chosen.withColumn("file_name", F.when(shared, F.concat_ws("_", "name", "group_name")).otherwise(F.col("name")))


def missing(wanted: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    return wanted.join(present, key, "left_anti")


def name_map(catalog: DataFrame, alias: str, name: str) -> DataFrame:
    """alias -> name, one row for each alias: the first name in order."""
    return catalog.groupBy(F.col(alias).alias("alias")).agg(F.min(name).alias("name"))


def half_stored(catalog: DataFrame) -> DataFrame:
    """Matrices that are symmetric in pattern and value and whose file holds one triangle only."""
    return catalog.filter((F.col("psym") == 1) & (F.col("nsym") == 1) & (F.col("header_nnz") != F.col("nnz")))


def out_of_bounds(entries: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """1-based entries whose index lies outside the dimensions."""
    return entries.filter(~(F.col("row").between(1, n_rows) & F.col("col").between(1, n_cols)))


def append_new(rows: DataFrame, path: str, key: str = "name") -> int:
    """Appends the rows whose key the Parquet table at path does not have; how many they were."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        new = missing(rows, done, key)
    except Exception as error:  # the first call finds no table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        new = rows
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def name_ids(catalog: DataFrame, name: str) -> DataFrame:
    """name and id: the names' numbers in order, from 0, by ranges of names that are counted first."""
    names = catalog.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct()
    ranged = cut(names.repartitionByRange("name").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    return ranged.withColumn("at", inside).join(F.broadcast(starts), "part").select("name", (F.col("start") + F.col("at")).alias("id"))
