"""Partitioned matrices kept as tables: what a plan has made of a matrix, written once and read by level."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators import levels

TABLES = ("blb", "wlb", "tlb")


def write_plan(state: levels.Levels, path: str, template: str = "") -> None:
    """Entries by block, the table of each level, the row map of a sort, and a line of facts."""
    blocks = state.entries.select("block").distinct().limit(2).collect()
    if len(blocks) == 1:  # its folder by name: rows that go to several folders are sorted by them
        state.entries.drop("block").write.mode("overwrite").parquet(f"{path}/entries/block={blocks[0]['block']}")
    else:
        state.entries.write.mode("overwrite").partitionBy("block").parquet(f"{path}/entries")
    state = replace(state, entries=_entries(state.matrix.spark, path))  # levels are read off what is stored
    for level in TABLES:
        if level in state.entries.columns:
            levels.table(state, level).write.mode("overwrite").parquet(f"{path}/{level}")
    m = state.matrix
    if m.row_map is not None:
        m.row_map.write.mode("overwrite").parquet(f"{path}/row_map")
    facts = {"n_rows": m.n_rows, "n_cols": m.n_cols, "levels": list(state.has), "template": template, "sorted": m.row_map is not None, "cut_rows": state.cut_rows}
    m.spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/entries").withColumn("block", F.col("block").cast("long"))


def read_plan(spark: SparkSession, path: str) -> tuple[levels.Levels, str]:
    """A partition and its template, as they were written."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    entries = _entries(spark, path)
    row_map = spark.read.parquet(f"{path}/row_map") if facts["sorted"] else None
    matrix = SparseMatrix(entries.select("row", "col", "val"), facts["n_rows"], facts["n_cols"], row_map)
    return levels.Levels(entries, matrix, tuple(facts["levels"]), facts.get("cut_rows", True)), facts["template"]


def read_level(spark: SparkSession, path: str, level: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{level}")
