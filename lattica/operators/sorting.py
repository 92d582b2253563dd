"""Row orders: by length, inside bands, and by length bins. Ties keep the rows' order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.model import SparseMatrix
from lattica.operators.division import WHOLE_ROW, bucket_of
from lattica.operators.order import BEFORE, global_position, with_groups
from lattica.session import in_tasks, keep


def by_length(matrix: SparseMatrix) -> DataFrame:
    """new_row and old_row, longest rows first."""
    return global_position(matrix.row_nnz(), [F.desc("k")], ["k"], "row", "new_row").select("new_row", F.col("row").alias("old_row"), "k")


def inverse(row_map: DataFrame) -> DataFrame:
    return row_map.select(F.col("old_row").alias("row"), F.col("new_row").alias("place"))


def by_length_in_bands(matrix: SparseMatrix, height: int) -> DataFrame:
    """The same inside each band of `height` rows; rows stay in their band."""
    lengths = matrix.row_nnz().withColumn("zone", F.floor(F.col("row") / height))
    placed = global_position(lengths, [F.desc("k")], ["k"], "row", "place", within=["zone"])
    return placed.select((F.col("zone") * height + F.col("place")).alias("new_row"), F.col("row").alias("old_row"), "k")


def by_length_in_blocks(tagged: DataFrame, chosen: Sequence[int] | None = None) -> DataFrame:
    """block, row and place: non-empty rows of each block by their entries in it, longest first. chosen: blocks to sort, all by default; the others keep the rows' order."""
    lengths = tagged.groupBy("block", "row").agg(F.count("*").alias("k"))
    if chosen is not None:
        lengths = lengths.withColumn("k", F.when(F.col("block").isin(*chosen), F.col("k")).otherwise(F.lit(0)))
    return global_position(lengths, [F.desc("k")], ["k"], "row", "place", within=["block"]).select("block", "row", "place")


def bin_of(bounds: Sequence[int]) -> Callable[[Column], Column]:
    """A length's bin by lower bounds."""
    return lambda k: bucket_of(k, bounds)


def step_of(matrix: SparseMatrix, step: int) -> Callable[[Column], Column]:
    """A length's bin of `step` lengths from the shortest row on."""
    low = matrix.row_nnz().agg(F.min("k")).first()[0] or 0
    return lambda k: F.floor((k - low) / step)


def coarse(matrix: SparseMatrix, bounds: Sequence[int]) -> DataFrame:
    """new_row, old_row and bin: bins by lower bounds (the first 0), the highest first, empty rows last."""
    lengths = matrix.row_nnz().withColumn("bin", F.when(F.col("k") == 0, F.lit(-1)).otherwise(bin_of(bounds)(F.col("k"))))
    return global_position(lengths, [F.desc("bin")], ["bin"], "row", "new_row").select("new_row", F.col("row").alias("old_row"), "bin")


def coarse_by_step(matrix: SparseMatrix, step: int) -> DataFrame:
    """new_row, old_row and bin: bins of `step` lengths from the shortest row on, the highest first, empty rows last. The bin is arithmetic, for any number of bins."""
    lengths = matrix.row_nnz().withColumn("bin", F.when(F.col("k") == 0, F.lit(-1)).otherwise(step_of(matrix, step)(F.col("k"))))
    return global_position(lengths, [F.desc("bin")], ["bin"], "row", "new_row").select("new_row", F.col("row").alias("old_row"), "bin")


def coarse_offsets(matrix: SparseMatrix, bounds: Sequence[int]) -> DataFrame:
    """bin and first_row: where each bin begins in the coarse order."""
    return coarse(matrix, bounds).groupBy("bin").agg(F.min("new_row").alias("first_row"), F.count("*").alias("n_rows"))


def apply(matrix: SparseMatrix, row_map: DataFrame) -> SparseMatrix:
    """The matrix with its rows in the new order; the map goes along, so that products can be put back."""
    pairs = row_map.select("new_row", "old_row")
    moved = matrix.entries.join(pairs, matrix.entries["row"] == pairs["old_row"]).select(F.col("new_row").alias("row"), "col", "val")
    return matrix.with_entries(moved, row_map=pairs)


#: Bands of rows of a task that sorts and numbers entries.
BANDS_OF_A_TASK = 4


def length(k: Column) -> Column:
    return k


def sort(matrix: SparseMatrix, kind: Callable[[Column], Column]) -> SparseMatrix:
    """The matrix with its rows in descending order of kind(k), k being a row's length, and its entries numbered on the way. Rows without entries come last.

    Entries are dealt once, to bands of rows: there they are counted by row, and the rows and entries of each kind are numbered and kept. Where
    the rows and entries of a band and kind begin is the sum of those before them, a small table. No map has to meet the entries, which carry their old
    row, and nothing is moved to number them in the new order. Of a matrix whose rows may be too wide for a task, a map is made and applied.
    """
    if matrix.n_cols > WHOLE_ROW:
        lengths = matrix.row_nnz().withColumn("kind", F.when(F.col("k") == 0, F.lit(-1)).otherwise(kind(F.col("k"))))
        placed = global_position(lengths, [F.desc("kind")], ["kind"], "row", "new_row")
        return apply(matrix, placed.select("new_row", F.col("row").alias("old_row"))).held()
    most = matrix.n_entries if matrix.n_entries is not None else matrix.entries.count() if matrix.kept else None
    tasks = int(matrix.spark.conf.get("spark.sql.shuffle.partitions")) if most is None else in_tasks(matrix.spark, most)
    height = max(1, matrix.n_rows // (tasks * BANDS_OF_A_TASK))
    dealt = matrix.entries.select(F.col("row").alias("old_row"), "col", "val", F.floor(F.col("row") / height).alias("_band")).repartitionByRange(tasks, "_band")
    row, same = Window.partitionBy("_band", "old_row"), Window.partitionBy("_band", "_kind")
    counted = dealt.withColumns({"rn": F.row_number().over(row.orderBy("col", "val")) - 1, "k": F.count("*").over(row)}).withColumn("_kind", kind(F.col("k")))
    earlier = F.row_number().over(same.orderBy("old_row", "rn")) - 1 - F.col("rn")  # one number a row
    kept = keep(counted.withColumn("_earlier", earlier).withColumn("_place", F.dense_rank().over(same.orderBy("old_row")) - 1))
    sizes = kept.filter("rn = 0").groupBy("_band", "_kind").agg(F.count("*").alias("_n"), F.sum("k").alias("_k"))
    before = Window.orderBy(F.desc("_kind"), "_band").rowsBetween(*BEFORE)
    starts = sizes.select("_band", "_kind", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(into) for c, into in (("_n", "_first_row"), ("_k", "_first"))])
    numbers = with_groups(kept, starts, ["_band", "_kind"])
    numbers = numbers.select((F.col("_first_row") + F.col("_place")).alias("row"), "col", "val", "old_row", "rn", "k", (F.col("_first") + F.col("_earlier") + F.col("rn")).alias("nz"))
    full = numbers.filter("rn = 0").select(F.col("row").alias("new_row"), "old_row")
    empty = matrix.rows().withColumnRenamed("row", "old_row").join(full, "old_row", "left_anti")
    empty = global_position(empty, [], [], "old_row", "_place").select((F.col("_place") + kept.filter("rn = 0").count()).alias("new_row"), "old_row")
    return matrix.with_entries(numbers.select("row", "col", "val"), row_map=full.unionByName(empty), kept=True, numbers=numbers, n_sorted=matrix.n_rows)
