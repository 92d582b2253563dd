"""Structural features and checks of a matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators.division import bucket_of
from lattica.operators.order import previous, running_sum


def csr_offsets(matrix: SparseMatrix) -> DataFrame:
    """row and start: the number of the row's first entry; an empty row has the next row's start."""
    return running_sum(matrix.row_nnz(), "row", "k", "start").select("row", "start")


def range_histogram(matrix: SparseMatrix, bounds: Sequence[int]) -> DataFrame:
    """bucket and n_rows: rows whose length lies in [bounds[i], bounds[i + 1]); empty buckets have 0 rows."""
    counts = matrix.row_nnz().groupBy(bucket_of(F.col("k"), bounds).alias("bucket")).agg(F.count("*").alias("n_rows"))
    every = matrix.spark.range(len(bounds)).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def block_row_max(matrix: SparseMatrix, height: int) -> DataFrame:
    """block and longest: the longest row of each band."""
    return matrix.row_nnz().groupBy(F.floor(F.col("row") / height).alias("block")).agg(F.max("k").alias("longest"))


def sorted_by_length(matrix: SparseMatrix) -> DataFrame:
    """One row: whether row lengths never fall (ascending) and never rise (descending)."""
    pairs = previous(matrix.row_nnz(), "row", "k", "before")
    up = F.coalesce(F.bool_and(F.col("before").isNull() | (F.col("k") >= F.col("before"))), F.lit(True))
    down = F.coalesce(F.bool_and(F.col("before").isNull() | (F.col("k") <= F.col("before"))), F.lit(True))
    return pairs.agg(up.alias("ascending"), down.alias("descending"))


def matrix_info(matrix: SparseMatrix) -> DataFrame:
    """One row: nnz, dimensions, shortest, longest and average (truncated) row, and whether rows are sorted by length."""
    info = matrix.row_nnz().agg(
        F.sum("k").alias("nnz"), F.lit(matrix.n_rows).cast("long").alias("n_rows"), F.lit(matrix.n_cols).cast("long").alias("n_cols"),
        F.min("k").alias("min_nnz"), F.max("k").alias("max_nnz"), F.floor(F.sum("k") / F.count("*")).alias("avg_nnz"),
    )
    order = sorted_by_length(matrix).select((F.col("ascending") | F.col("descending")).alias("is_sorted"))
    return info.join(F.broadcast(order))  # one row each


def matrix_features(matrix: SparseMatrix) -> DataFrame:
    """One row: density, mean, least, most and variance of row lengths, padding of ELL storage, empty rows."""
    k = F.col("k")
    return matrix.row_nnz().agg(
        F.lit(matrix.n_rows).cast("long").alias("n_rows"), F.lit(matrix.n_cols).cast("long").alias("n_cols"), F.sum(k).alias("nnz"),
        (F.sum(k) / F.lit(float(matrix.n_rows)) / F.lit(float(matrix.n_cols))).alias("density"), F.avg(k).alias("avg_nnz_row"),
        F.min(k).alias("min_nnz_row"), F.max(k).alias("max_nnz_row"), F.var_pop(k).alias("var_nnz_row"),
        (F.max(k) * F.count("*") / F.sum(k)).alias("ell_padding_ratio"), F.count_if(k == 0).alias("empty_rows"),
    )


def row_length_stats(matrix: SparseMatrix) -> DataFrame:
    """One row: mean, standard deviation, variation and skewness of row lengths (population forms)."""
    return matrix.row_nnz().agg(F.avg("k").alias("mean"), F.stddev_pop("k").alias("std"), (F.stddev_pop("k") / F.avg("k")).alias("variation"), F.skewness("k").alias("skewness"))


def diagonal_distance(matrix: SparseMatrix) -> DataFrame:
    """One row: mean and variance of |col - row|."""
    distance = F.abs(F.col("col") - F.col("row"))
    return matrix.entries.agg(F.avg(distance).alias("mean_distance"), F.var_pop(distance).alias("var_distance"))


def row_col_correlation(matrix: SparseMatrix) -> DataFrame:
    """One row: Pearson r of (col, row) and the slope of the Deming regression of row on col."""
    got = matrix.entries.agg(
        F.corr(F.col("col").cast("double"), F.col("row").cast("double")).alias("pearson_r"), F.var_pop("col").alias("sx"), F.var_pop("row").alias("sy"), F.covar_pop("col", "row").alias("sxy")
    )
    gap = F.col("sy") - F.col("sx")
    slope = (gap + F.sqrt(gap * gap + 4 * F.col("sxy") * F.col("sxy"))) / (2 * F.col("sxy"))
    return got.select("pearson_r", F.when(F.col("sxy") != 0, slope).alias("deming_slope"))


def degree_histogram(matrix: SparseMatrix) -> DataFrame:
    """bin and n_rows: floor(log10 of the length), -1 for empty rows."""
    digits = F.when(F.col("k") == 0, F.lit(-1)).otherwise(F.length(F.col("k").cast("string")) - 1)
    return matrix.row_nnz().groupBy(digits.cast("int").alias("bin")).agg(F.count("*").alias("n_rows"))


def band_padding(matrix: SparseMatrix, height: int) -> DataFrame:
    """One row: padded size over nnz when every band of rows is as wide as its longest row."""
    widest = block_row_max(matrix, height).agg((F.sum("longest") * height).alias("padded"))
    return widest.join(F.broadcast(matrix.entries.agg(F.count("*").alias("nnz")))).select("padded", "nnz", (F.col("padded") / F.col("nnz")).alias("padding_ratio"))


def transfer_bytes(matrix: SparseMatrix, seconds: float, value_bytes: int = 8, index_bytes: int = 4) -> DataFrame:
    """One row: bytes that one product moves at least, GB/s and GFLOPS at a time per product."""
    nnz = matrix.entries.agg(F.count("*").alias("nnz"))
    size = F.col("nnz") * (2 * value_bytes + index_bytes) + F.lit(matrix.n_rows * (index_bytes + value_bytes))
    return nnz.select("nnz", size.alias("bytes"), (size / seconds / 1e9).alias("gb_per_s"), (2 * F.col("nnz") / seconds / 1e9).alias("gflops"))


def empty_rows(matrix: SparseMatrix) -> DataFrame:
    return matrix.rows().join(matrix.entries.select("row").distinct(), "row", "left_anti")


def order_violations(entries: DataFrame, position: str, row: str = "row", col: str = "col") -> DataFrame:
    """Entries that come, in file order (consecutive positions), after an entry with a larger row, or a larger column of the same row."""
    before = entries.select((F.col(position) + 1).alias(position), F.col(row).alias("before_row"), F.col(col).alias("before_col"))
    late = (F.col(row) < F.col("before_row")) | ((F.col(row) == F.col("before_row")) & (F.col(col) < F.col("before_col")))
    return entries.join(before, position).filter(late)


def division_violations(tagged: DataFrame, blocks: DataFrame, block: str = "block") -> DataFrame:
    """One row: entries outside their block's ranges. blocks: block, row_lo, row_hi, col_lo, col_hi (inclusive)."""
    both = tagged.join(blocks, block, "left")
    outside = ~F.coalesce(F.col("row").between(F.col("row_lo"), F.col("row_hi")) & F.col("col").between(F.col("col_lo"), F.col("col_hi")), F.lit(False))
    return both.agg(F.count_if(outside).alias("violations"))


def level_violations(level: DataFrame) -> DataFrame:
    """One row: ids of a level table (level_id, nz_begin, nz_size) that do not begin where the one before ends."""
    moved = level.select((F.col("level_id") + 1).alias("level_id"), (F.col("nz_begin") + F.col("nz_size")).alias("expected"))
    return level.join(moved, "level_id").agg(F.count_if(F.col("nz_begin") != F.col("expected")).alias("violations"))


def column_range(matrix: SparseMatrix, low: int, high: int) -> SparseMatrix:
    """Entries with low <= col <= high; the filter reaches the scan."""
    return matrix.with_entries(matrix.entries.filter(F.col("col").between(low, high)))


def meta_bits(values: Column) -> Column:
    """Bits that the largest value needs."""
    return F.length(F.bin(F.max(values)))
