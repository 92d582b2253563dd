"""Storage layouts as tagged entries: ELL, SELL-P, HYB, power-of-two bins, merge path, and padding.

Padded entries have value 0 and change no product; they are made only where the layout itself is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators.division import places
from lattica.operators.order import running_sum
from lattica.session import cut


def ell(matrix: SparseMatrix) -> SparseMatrix:
    """Every non-empty row filled up to the longest row: entries with slot and is_pad. Pads repeat the row's last column."""
    top = matrix.row_nnz().agg(F.max("k")).first()[0] or 0
    return pad_cols(matrix, top)


#: Stored entries, pads included, for each entry of the matrix, beyond which a padded layout is refused.
MOST_PADDING = 4


def ell_slots(matrix: SparseMatrix) -> DataFrame:
    """Entries with slot, without the pads."""
    return places(matrix).withColumnRenamed("rn", "slot")


def check_padding(widths: DataFrame, matrix: SparseMatrix, most: int = MOST_PADDING) -> None:
    """Raises where the slices of a layout store more than `most` times the entries (whole numbers)."""
    padded, nnz = widths.agg(F.sum("padded")).first()[0] or 0, matrix.entries.count()
    if nnz and padded // nnz > most:
        raise ValueError(f"{padded} stored for {nnz} entries: the padding is more than {most} times")


def sell_chunks(matrix: SparseMatrix, height: int, threads: int) -> SparseMatrix:
    """Entries with slice and chunk: a row of a slice is dealt to `threads` chunks of equal width."""
    widths = slice_widths(matrix, height, threads).select("slice", (F.col("width") / threads).cast("long").alias("_each"))
    placed = places(sell(matrix, height)).join(widths, "slice")
    return matrix.with_entries(placed.withColumn("chunk", F.floor(F.col("rn") / F.greatest("_each", F.lit(1)))).drop("rn", "_each"))


def pad_cols(matrix: SparseMatrix, target: int, empty_rows: bool = False) -> SparseMatrix:
    """Rows shorter than target get zeros at their last column (column 0 for empty rows, when these are asked for)."""
    placed = places(matrix).select("row", "col", "val", F.col("rn").alias("slot"), F.lit(False).alias("is_pad"))
    ends = placed.groupBy("row").agg(F.max("col").alias("col"), F.count("*").alias("k"))
    if empty_rows:
        ends = matrix.rows().join(ends, "row", "left").select("row", F.coalesce("col", F.lit(0)).alias("col"), F.coalesce("k", F.lit(0)).alias("k"))
    short = ends.filter(F.col("k") < target)
    pads = short.select("row", "col", F.lit(0.0).alias("val"), F.explode(F.sequence(F.col("k"), F.lit(target - 1).cast("long"))).alias("slot"), F.lit(True).alias("is_pad"))
    return matrix.with_entries(placed.unionByName(pads))


def pad_rows(matrix: SparseMatrix, multiple: int, zeros: int = 1, at_top: bool = False, to: int | None = None) -> SparseMatrix:
    """Rows added until their number is a multiple (or `to`); each holds `zeros` entries of value 0 at columns 0, 1, ..."""
    target = to if to is not None else -(-matrix.n_rows // multiple) * multiple
    added = target - matrix.n_rows
    if added <= 0:
        return matrix
    shift = added if at_top else 0
    first = 0 if at_top else matrix.n_rows
    new = matrix.spark.range(added).select((F.col("id") + first).alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(zeros - 1).cast("long"))).alias("col"), F.lit(0.0).alias("val"))
    moved = matrix.entries.select((F.col("row") + shift).alias("row"), "col", "val")
    numbers = None
    if matrix.numbers is not None and not at_top:
        nz = (F.col("row") - first) * zeros + F.col("col") + matrix.numbers.count()
        numbers = matrix.numbers.unionByName(new.withColumns({"rn": F.col("col").cast("int"), "k": F.lit(zeros).cast("long"), "nz": nz}), allowMissingColumns=True)
    return matrix.with_entries(moved.unionByName(new), n_rows=target, kept=matrix.kept, numbers=numbers)


def sell(matrix: SparseMatrix, height: int) -> SparseMatrix:
    """Entries with slice: bands of `height` rows that share one width."""
    return matrix.with_entries(matrix.entries.withColumn("slice", F.floor(F.col("row") / height)))


def slice_widths(matrix: SparseMatrix, height: int, threads: int) -> DataFrame:
    """slice, width (its longest row, rounded up to a multiple of threads) and padded entries."""
    lengths = matrix.row_nnz().withColumn("slice", F.floor(F.col("row") / height))
    width = F.ceil(F.max("k") / threads) * threads
    return lengths.groupBy("slice").agg(width.alias("width"), (width * height).alias("padded"))


def csr(matrix: SparseMatrix) -> DataFrame:
    """row, start, and the row's cols and vals in column order, for every row. A row's arrays are as long as the row."""
    arrays = matrix.entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("e"))
    starts = running_sum(matrix.row_nnz(), "row", "k", "start")
    none = F.array().cast("array<struct<col: bigint, val: double>>")
    both = starts.join(arrays, "row", "left").select("row", "start", F.coalesce("e", none).alias("e"))
    return both.select("row", "start", F.col("e.col").alias("cols"), F.col("e.val").alias("vals"))


def padded_total(matrix: SparseMatrix, height: int, threads: int) -> DataFrame:
    """One row: entries that the sliced layout stores, pads included."""
    return slice_widths(matrix, height, threads).agg(F.sum("padded").alias("padded"))


def hyb(matrix: SparseMatrix, width: int) -> tuple[SparseMatrix, SparseMatrix]:
    """The first `width` entries of every row, and the overflow."""
    placed = places(matrix)
    near, far = placed.filter(F.col("rn") < width), placed.filter(F.col("rn") >= width)
    return matrix.with_entries(near.drop("rn")), matrix.with_entries(far.drop("rn"))


def power_bins(matrix: SparseMatrix) -> SparseMatrix:
    """Entries with bin: floor(log2 of the row's length)."""
    bins = matrix.entries.groupBy("row").agg((F.length(F.bin(F.count("*"))) - 1).alias("bin"))
    return matrix.with_entries(matrix.entries.join(bins, "row"))


def _merged(matrix: SparseMatrix, workers: int) -> tuple[DataFrame, int]:
    """row, k and start, and the share of a worker."""
    offsets = cut(running_sum(matrix.row_nnz(), "row", "k", "start"))
    nnz = offsets.agg(F.sum("k")).first()[0] or 0
    return offsets, max(1, -(-(nnz + matrix.n_rows) // workers))


def merge_path(matrix: SparseMatrix, workers: int) -> SparseMatrix:
    """Entries with worker: equal shares of the merged list of entries and row ends.

    Entry nz of row r stands at place nz + r of that list, and the end of row r at r + its row's end.
    """
    offsets, share = _merged(matrix, workers)
    placed = places(matrix).join(offsets, "row").withColumn("worker", F.floor((F.col("start") + F.col("rn") + F.col("row")) / share))
    return matrix.with_entries(placed.select("row", "col", "val", "worker"))


def merge_path_workers(matrix: SparseMatrix, workers: int) -> DataFrame:
    """worker, entries and row_ends of each share of the merge path: a row's entries lie in consecutive places, so rows are counted, not entries."""
    offsets, share = _merged(matrix, workers)
    at = F.col("row") + F.col("start")
    ends = offsets.select(F.floor((at + F.col("k")) / share).alias("worker"), F.lit(0).cast("long").alias("e"), F.lit(1).cast("long").alias("r"))
    full = offsets.filter("k > 0").withColumn("worker", F.explode(F.sequence(F.floor(at / share), F.floor((at + F.col("k") - 1) / share))))
    inside = F.least(at + F.col("k"), (F.col("worker") + 1) * share) - F.greatest(at, F.col("worker") * share)
    entries = full.select("worker", inside.alias("e"), F.lit(0).cast("long").alias("r"))
    return entries.unionByName(ends).groupBy("worker").agg(F.sum("e").alias("entries"), F.sum("r").alias("row_ends"))
