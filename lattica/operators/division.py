"""Dividing matrices: by row length, by fixed or variable ranges, and into three nested levels.

Levels are columns beside the entries: blb (block), wlb (warp) and tlb (thread). Ids count from 0 in the
order of rows, then places in a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.model import SparseMatrix
from lattica.operators.order import BEFORE, global_position, intervals, ranged_places, running_sum, with_groups
from lattica.session import in_tasks, keep


def bucket_of(value: Column, bounds: Sequence[int]) -> Column:
    """Index of the highest bound that is not above the value; bounds ascend, the first is the least value."""
    out = F.lit(0)
    for i, bound in enumerate(bounds[1:], 1):
        out = F.when(value >= bound, F.lit(i)).otherwise(out)
    return out


#: Rows of up to this many columns are numbered as they are; beyond it a row is numbered in bands of columns.
WHOLE_ROW = 1 << 24
#: Columns of a band in which a row's entries are numbered, so that no task has to sort a whole hot row.
COLUMN_BAND = 65_536


def places(matrix: SparseMatrix) -> DataFrame:
    """Entries with rn, their 0-based place in the row by column."""
    e = matrix.entries
    if matrix.n_cols <= WHOLE_ROW:
        return e.withColumn("rn", F.row_number().over(Window.partitionBy("row").orderBy("col", "val")) - 1)
    e = e.withColumn("_band", F.floor(F.col("col") / COLUMN_BAND))
    sizes = e.groupBy("row", "_band").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("row").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("row", "_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = e.withColumn("_at", F.row_number().over(Window.partitionBy("row", "_band").orderBy("col", "val")) - 1)
    return inside.join(starts, ["row", "_band"]).withColumn("rn", F.col("_before") + F.col("_at")).drop("_band", "_at", "_before")


def numbered(matrix: SparseMatrix) -> DataFrame:
    """Entries with rn, k (their row's length) and nz, their number in row-major order; computed now, as later levels read it several times.

    Entries are dealt once, to ranges of rows: there they are counted by row and numbered, and kept. A range's first number is
    the sum of the ranges before it, which are as few as tasks. A matrix that has been numbered when its rows were sorted is not dealt again.
    """
    if matrix.numbers is not None:
        return matrix.numbers
    if matrix.n_cols > WHOLE_ROW:
        offsets = running_sum(matrix.row_nnz(), "row", "k", "_first")
        return places(matrix).join(offsets, "row").withColumn("nz", F.col("_first") + F.col("rn")).drop("_first")
    most = matrix.n_entries if matrix.n_entries is not None else matrix.entries.count() if matrix.kept else None
    ranges = [] if most is None else [in_tasks(matrix.spark, most)]  # a task's share stays as large when the matrix grows
    dealt = matrix.with_entries(matrix.entries.repartitionByRange(*ranges, "row"))
    inside = places(dealt).withColumn("k", F.count("*").over(Window.partitionBy("row"))).withColumn("_id", F.monotonically_increasing_id())
    kept = keep(inside).withColumn("_part", F.shiftright("_id", 33))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_start"))
    at = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), "_part").withColumn("nz", F.col("_start") + at).drop("_id", "_part", "_start")


def long_short(matrix: SparseMatrix, bounds: Sequence[int]) -> DataFrame:
    """Entries with part: the highest of the bounds (the first is 0) that the row's length reaches."""
    lengths = matrix.entries.groupBy("row").agg(F.count("*").alias("k"))
    parts = lengths.select("row", bucket_of(F.col("k"), bounds).alias("part"))
    return matrix.entries.join(parts, "row")


def row_bands(matrix: SparseMatrix, length: int) -> DataFrame:
    """Entries with block: bands of `length` rows; empty bands are dropped and ids are gapless."""
    return _gapless(matrix.entries.withColumn("raw", F.floor(F.col("row") / length)))


def divided_again(entries: DataFrame, block: int, length: int) -> DataFrame:
    """One block of banded rows divided into bands of `length` rows: it goes, and its children follow after the other blocks."""
    low = entries.filter(F.col("block") == block).agg(F.min("row")).first()[0]
    last = entries.agg(F.max("block")).first()[0]
    if low is None:
        return entries
    low = low // length * length
    raw = F.when(F.col("block") == block, last + 1 + F.floor((F.col("row") - low) / length)).otherwise(F.col("block"))
    return _gapless(entries.withColumn("raw", raw).drop("block"))


#: Cut points that are written out as a CASE; more of them are joined.
MOST_CASES = 64


def row_ranges(matrix: SparseMatrix, cuts: Sequence[int] | DataFrame, with_low: bool = False) -> DataFrame:
    """Entries with block: rows between consecutive cut points (the first 0, the last n_rows). with_low: also row_lo and row_hi, the block's first row and the one after its last.

    cuts: numbers, or a table (column cut) of any size that is never collected.
    """
    if not isinstance(cuts, DataFrame):
        points = list(cuts)[:-1]
        if len(points) <= MOST_CASES:
            entries = matrix.entries
            if with_low:
                at, bounds = bucket_of(F.col("row"), points), F.array(*[F.lit(x).cast("long") for x in (*points, matrix.n_rows)])
                entries = entries.withColumns({"row_lo": F.element_at(bounds, at + 1), "row_hi": F.element_at(bounds, at + 2)})
            return _gapless(entries.withColumn("raw", bucket_of(F.col("row"), points)))
        cuts = matrix.spark.createDataFrame([(int(x),) for x in points], "cut long")
    blocks = row_blocks(matrix, cuts)
    return matrix.entries.join(blocks if with_low else blocks.drop("row_lo", "row_hi"), "row")


def row_blocks(matrix: SparseMatrix, cuts: DataFrame) -> DataFrame:
    """row, block, row_lo and row_hi of every row with entries; blocks without entries get no number. Only rows are moved, not entries."""
    lengths, cuts = matrix.row_nnz(), cuts.filter(F.col("cut") < matrix.n_rows).distinct()
    numbered = ranged_places(cuts, [F.col("cut")], "raw")
    ends = numbered.select((F.col("raw") - 1).alias("raw"), F.col("cut").alias("row_hi"))
    placed = intervals(lengths, cuts).filter("k > 0").select("row", F.col("range").alias("raw"), F.col("low").alias("row_lo"))
    placed = placed.join(ends, "raw", "left").withColumn("row_hi", F.coalesce("row_hi", F.lit(matrix.n_rows)))
    return _gapless(placed)


def _gapless(entries: DataFrame) -> DataFrame:
    used = entries.select("raw").distinct()
    return with_groups(entries, global_position(used, [], [], "raw", "block"), "raw").drop("raw")


def col_blocks(matrix: SparseMatrix, width: int) -> SparseMatrix:
    """Entries with block: `width` columns each. Rows are shared, so that y needs a second sum."""
    return matrix.with_entries(_gapless(matrix.entries.withColumn("raw", F.floor(F.col("col") / width))), by_cols=True)


def compress(entries: DataFrame) -> DataFrame:
    """Indices relative to the least row and column of each block: block, rel_row, rel_col, val."""
    low = entries.groupBy("block").agg(F.min("row").alias("row_lo"), F.min("col").alias("col_lo"))
    return entries.join(low, "block").select("block", (F.col("row") - F.col("row_lo")).alias("rel_row"), (F.col("col") - F.col("col_lo")).alias("rel_col"), "val")


def row_chunks(matrix: SparseMatrix, size: int) -> SparseMatrix:
    """Entries with chunk: `size` consecutive entries of one row (the column split of a level)."""
    return matrix.with_entries(places(matrix).withColumn("chunk", F.floor(F.col("rn") / size)))


def chunk_ids(matrix: SparseMatrix, size: int) -> DataFrame:
    """row, chunk and a gapless id over all chunks in row order, with the chunk's entries."""
    counted = row_chunks(matrix, size).entries.groupBy("row", "chunk").agg(F.count("*").alias("nnz"))
    rows = counted.groupBy("row").agg(F.count("*").alias("chunks"))
    starts = running_sum(rows, "row", "chunks", "start")
    return counted.join(starts, "row").select("row", "chunk", (F.col("start") + F.col("chunk")).alias("chunk_id"), "nnz")


def nnz_tiles(matrix: SparseMatrix, size: int) -> SparseMatrix:
    """Entries with tlb: `size` consecutive entries, whatever rows they are of."""
    return matrix.with_entries(numbered(matrix).withColumn("tlb", F.floor(F.col("nz") / size)).select("row", "col", "val", "tlb"))


def tile_table(matrix: SparseMatrix, size: int) -> DataFrame:
    """tlb, first_row, n_rows (the span of rows) and nnz of every tile."""
    return nnz_tiles(matrix, size).entries.groupBy("tlb").agg(F.min("row").alias("first_row"), (F.max("row") - F.min("row") + 1).alias("n_rows"), F.count("*").alias("nnz"))


def even_blocks(matrix: SparseMatrix, height: int) -> DataFrame:
    """blb, first_row, n_rows and nnz of bands of `height` rows, the last one with the remainder; empty bands too."""
    lengths = matrix.row_nnz().withColumn("blb", F.floor(F.col("row") / height))
    return lengths.groupBy("blb").agg(F.min("row").alias("first_row"), F.count("*").alias("n_rows"), F.sum("k").alias("nnz"))


def shared_rows(tagged: DataFrame, level: str) -> DataFrame:
    """row and whether more than one value of the level holds it, so that its sum needs another step."""
    return tagged.groupBy("row").agg((F.count_distinct(level) > 1).alias("shared"))


def nested(matrix: SparseMatrix, blb_rows: int, wlb_rows: int, tlb_size: int) -> SparseMatrix:
    """Entries with blb (bands of rows), wlb (bands inside a blb) and tlb (chunks of a row)."""
    placed = places(matrix).withColumn("blb", F.floor(F.col("row") / blb_rows))
    placed = placed.withColumn("wlb", F.floor(F.pmod("row", F.lit(blb_rows)) / wlb_rows))
    return matrix.with_entries(placed.withColumn("tlb", F.floor(F.col("rn") / tlb_size)).drop("rn"))


def threads_per_row(matrix: SparseMatrix, size: int, rows_in_warp: int, multiple: int = 32) -> DataFrame:
    """row, wlb and chunks: ceil(k / size), with each warp's total filled up to a multiple, dealt round-robin from its first row."""
    base = matrix.row_nnz().select("row", F.ceil(F.col("k") / size).alias("c")).withColumn("wlb", F.floor(F.col("row") / rows_in_warp))
    warp = base.groupBy("wlb").agg(F.sum("c").alias("total"), F.count("*").alias("n"))
    both = base.join(warp, "wlb").withColumn("more", F.pmod(-F.col("total"), F.lit(multiple))).withColumn("i", F.pmod("row", F.lit(rows_in_warp)))
    extra = F.floor(F.col("more") / F.col("n")) + (F.col("i") < F.col("more") % F.col("n")).cast("long")
    return both.select("row", "wlb", (F.col("c") + extra).alias("chunks"))
