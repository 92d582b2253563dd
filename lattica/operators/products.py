"""Sparse matrix-vector products and the reduction trees that lead to them.

Every strategy sums the same products val x x[col] by row; they differ in what is summed first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators import cuts, division, layout, levels
from lattica.session import cut

#: A vector of at most this many entries (16 bytes each) may be broadcast.
MOST_BROADCAST = 1_000_000


#: Rows and columns of a block of a wide matrix.
ROW_BAND, COL_BAND = 65_536, 4096


def gather(matrix: SparseMatrix, x: DataFrame, more: tuple[str, ...] = (), plain: DataFrame | None = None) -> DataFrame:
    """Entries with their product val * x[col]. x (col, x) is broadcast when n_cols bounds its size, and meets the entries by blocks else.

    plain: the same entries or more, where they cost less to count.
    """
    if matrix.n_cols > MOST_BROADCAST:
        return gather_grid(matrix, x, ROW_BAND, COL_BAND, more, plain)
    return matrix.entries.join(F.broadcast(x), "col").select("row", *more, (F.col("val") * F.col("x")).alias("product"))


#: Entries of a band of columns that meet one copy of its part of x.
ENTRIES_A_COPY = 1_000_000


def gather_grid(matrix: SparseMatrix, x: DataFrame, row_band: int, col_band: int, more: tuple[str, ...] = (), plain: DataFrame | None = None) -> DataFrame:
    """Entries with their product, by blocks of row_band x col_band: a block's entries meet its band of x as one array.

    x is cut into bands once. The row bands of a band of columns share copies of its part of x, one for each ENTRIES_A_COPY entries
    it holds, so that copies grow with the entries and not with the blocks. A hot column is spread over these copies by
    its row bands; a copy that many entries meet all the same is split, as one row stands on the other side.
    """
    copies = F.ceil(F.col("_n") / ENTRIES_A_COPY).cast("int")
    counted = (matrix.entries if plain is None else plain).groupBy(F.floor(F.col("col") / col_band).alias("_cb")).agg(F.count("*").alias("_n")).select("_cb", copies.alias("_copies"))
    counted = cut(counted)
    hot = F.broadcast(counted.filter("_copies > 1"))  # at most one for each ENTRIES_A_COPY entries
    entries = matrix.entries.select("row", "val", *more, F.floor(F.col("col") / col_band).alias("_cb"), (F.pmod(F.col("col"), F.lit(col_band)) + 1).cast("int").alias("_at"))
    mine = F.pmod(F.floor(F.col("row") / row_band), F.coalesce("_copies", F.lit(1))).cast("int")
    entries = entries.join(hot, "_cb", "left").select("row", "val", *more, "_cb", "_at", mine.alias("_copy"))
    dense = matrix.cols().join(x.select("col", "x"), "col", "left")
    bands = dense.groupBy(F.floor(F.col("col") / col_band).alias("_cb")).agg(F.sort_array(F.collect_list(F.struct("col", "x")))["x"].alias("_xs"))
    bands = bands.join(counted, "_cb").select("_cb", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), "_xs")
    both = entries.join(bands.hint("shuffle_hash"), ["_cb", "_copy"]).withColumn("_x", F.element_at("_xs", F.col("_at"))).filter(F.col("_x").isNotNull())
    return both.select("row", *more, (F.col("val") * F.col("_x")).alias("product"))


def complete(matrix: SparseMatrix, sums: DataFrame, value: str = "y") -> DataFrame:
    """row and y for every row, 0 for rows without entries."""
    return matrix.rows().join(sums, "row", "left").select("row", F.coalesce(value, F.lit(0.0)).alias("y"))


def product(matrix: SparseMatrix, x: DataFrame, all_rows: bool = True) -> DataFrame:
    """y = A x: row and y."""
    sums = gather(matrix, x).groupBy("row").agg(F.sum("product").alias("y"))
    return complete(matrix, sums) if all_rows else sums


def general_product(matrix: SparseMatrix, x: DataFrame, y0: DataFrame, alpha: float, beta: float) -> DataFrame:
    """alpha A x + beta y0, for y0 with columns row and y0; a row that y0 lacks counts as 0."""
    both = product(matrix, x).join(y0, "row", "left")
    return both.select("row", (F.lit(alpha) * F.col("y") + F.lit(beta) * F.coalesce("y0", F.lit(0.0))).alias("y"))


def tree_product(matrix: SparseMatrix, x: DataFrame, level: str) -> DataFrame:
    """y by two sums: by (level, row), then by row. matrix.entries carries the column `level`.

    A hot row is spread over its level's values, so that its sum is no longer one task's work.
    """
    partial = gather(matrix, x, (level,)).groupBy("row", level).agg(F.sum("product").alias("part"))
    return complete(matrix, partial.groupBy("row").agg(F.sum("part").alias("y")))


def restored_product(matrix: SparseMatrix, x: DataFrame) -> DataFrame:
    """y of a row-sorted matrix by the original rows: the map is joined after the sums."""
    sums = gather(matrix, x).groupBy("row").agg(F.sum("product").alias("y"))
    back = matrix.row_map.join(sums, F.col("new_row") == F.col("row"), "left")
    return back.select(F.col("old_row").alias("row"), F.coalesce("y", F.lit(0.0)).alias("y"))


def _by_bins(matrix: SparseMatrix, x: DataFrame, long_bin: int) -> DataFrame:
    """Rows of the bins under `long_bin` are summed at once, rows of longer ones by chunks of 2^long_bin entries first: a plan for each kind of bin."""
    binned = layout.power_bins(matrix)
    short = matrix.with_entries(binned.entries.filter(F.col("bin") < long_bin).drop("bin"))
    long = matrix.with_entries(binned.entries.filter(F.col("bin") >= long_bin).drop("bin"))
    chunked = gather(division.row_chunks(long, 1 << long_bin), x, ("chunk",)).groupBy("row", "chunk").agg(F.sum("product").alias("part"))
    sums = gather(short, x).groupBy("row").agg(F.sum("product").alias("y")).unionByName(chunked.groupBy("row").agg(F.sum("part").alias("y")))
    return complete(matrix, sums)


def _by_adaptive_blocks(matrix: SparseMatrix, x: DataFrame, most: int) -> DataFrame:
    """Blocks of rows with at most `most` entries are summed by (block, row); a longer row is a block, and summed by chunks first."""
    tagged = levels.blb_rows_at(levels.opened(matrix), cuts.adaptive_cuts(matrix, most))
    chunked = matrix.with_entries(tagged.entries.withColumn("chunk", F.floor(F.col("at") / most)))
    parts = gather(chunked, x, ("blb", "chunk")).groupBy("blb", "chunk", "row").agg(F.sum("product").alias("part"))
    return complete(matrix, parts.groupBy("row").agg(F.sum("part").alias("y")))


#: Strategies by name: partition the entries, then sum along the partition. Each gives product().
def by_strategy(matrix: SparseMatrix, x: DataFrame, name: str, **options) -> DataFrame:
    """y by a named strategy, one of STRATEGIES."""
    if name == "direct":
        return product(matrix, x)
    if name == "ell":  # slots side by side, a band of them at a time; pads carry nothing, and are not made for the product
        return tree_product(matrix.with_entries(layout.ell_slots(matrix).withColumn("slots", F.floor(F.col("slot") / 32))), x, "slots")
    if name == "tiles":
        return tree_product(division.nnz_tiles(matrix, options.get("size", 256)), x, "tlb")
    if name == "merge_path":
        return tree_product(layout.merge_path(matrix, options.get("workers", 64)), x, "worker")
    if name == "chunks":
        return tree_product(division.row_chunks(matrix, options.get("size", 4)), x, "chunk")
    if name == "sell":
        height, threads = options.get("height", 32), options.get("threads", 4)
        layout.check_padding(layout.slice_widths(matrix, height, threads), matrix)
        return tree_product(layout.sell_chunks(matrix, height, threads), x, "chunk")
    if name == "acsr":
        return _by_bins(matrix, x, options.get("long", 5))
    if name == "adaptive":
        return _by_adaptive_blocks(matrix, x, options.get("most", 1024))
    if name == "col_blocks":
        return tree_product(division.col_blocks(matrix, options.get("width", 256)), x, "block")
    if name == "hyb":
        near, far = layout.hyb(matrix, options.get("width", 4))
        parts = gather(near, x).unionByName(gather(far, x))
        return complete(matrix, parts.groupBy("row").agg(F.sum("product").alias("y")))
    if name == "grid":
        got = gather_grid(matrix.held(), x, options.get("row_band", 4096), options.get("col_band", 4096))
        return complete(matrix, got.groupBy("row").agg(F.sum("product").alias("y")))
    if name == "salted":
        salted = matrix.with_entries(matrix.entries.withColumn("salt", F.pmod(F.xxhash64("col"), F.lit(options.get("salts", 16)))))
        return tree_product(salted, x, "salt")
    raise ValueError(f"no strategy {name}")


STRATEGIES = ("direct", "ell", "tiles", "merge_path", "chunks", "sell", "acsr", "adaptive", "col_blocks", "hyb", "salted", "grid")
