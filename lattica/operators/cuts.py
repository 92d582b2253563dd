"""Where to cut rows into blocks.

Cuts that look at a row and the one before are joins of the row-length vector with itself. Greedy cuts
depend on where the last cut was made: they are scans by maps of bands (transfer.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators.order import BAND, global_position, previous
from lattica.operators.transfer import adjacent, greedy, scanned
from lattica.session import cut


def exponential_bounds(start: int, rate: int, cap: int | None, longest: int) -> list[int]:
    """0, start, start * rate, ...; with a cap the last bound is the cap, else the first beyond the longest row is left out."""
    bounds, at = [0], start
    top = cap if cap is not None else longest + 1
    while at < top:
        bounds.append(at)
        at *= rate
    return [*bounds, cap] if cap is not None else bounds


def window_of(k: Column, start: int, rate: int, cap: int | None = None) -> Column:
    """Index of the exponential window that a length lies in, in closed form up to 2^62."""
    out, at, i = F.lit(0), start, 1
    while at < (cap if cap is not None else 1 << 62):
        out = F.when(k >= at, F.lit(i)).otherwise(out)
        at, i = at * rate, i + 1
    return F.when(k >= cap, F.lit(i)).otherwise(out) if cap is not None else out


def exponential_cuts(matrix: SparseMatrix, start: int, rate: int, cap: int | None = None) -> DataFrame:
    """cut: row 0, each row whose window differs from that of the row before, and n_rows."""
    lengths = matrix.row_nnz().select("row", window_of(F.col("k"), start, rate, cap).alias("w"))
    changed = previous(lengths, "row", "w", "before").filter(F.col("before").isNull() | (F.col("before") != F.col("w")))
    return changed.select(F.col("row").alias("cut")).unionByName(matrix.spark.range(1).select(F.lit(matrix.n_rows).cast("long").alias("cut"))).distinct()


def exponential_blocks(matrix: SparseMatrix, start: int, rate: int, cap: int | None = None) -> DataFrame:
    """window, n_rows and nnz of rows by exponential window."""
    windows = matrix.row_nnz().select(window_of(F.col("k"), start, rate, cap).alias("window"), "k")
    return windows.groupBy("window").agg(F.count("*").alias("n_rows"), F.sum("k").alias("nnz"))


#: Bounds that a plan can hold; a matrix with more different lengths needs a larger step.
MOST_BOUNDS = 10_000


def coarse_bounds(matrix: SparseMatrix, every: int = 1) -> list[int]:
    """Every `every`-th different row length in order, the first replaced by 0."""
    placed = global_position(matrix.row_nnz().select("k").distinct(), [], [], "k", "i")
    lengths = [r["k"] for r in placed.filter(F.col("i") % every == 0).orderBy("i").select("k").limit(MOST_BOUNDS + 1).collect()]
    if len(lengths) > MOST_BOUNDS:
        raise ValueError(f"more than {MOST_BOUNDS} bounds: take a larger step")
    return [0, *lengths[1:]]


def step_bounds(matrix: SparseMatrix, step: int) -> DataFrame:
    """i and bound: the shortest row's length, then every `step` up to the longest one's; the first is replaced by 0."""
    ends = matrix.row_nnz().agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low is not null")
    each = ends.select("low", F.posexplode(F.sequence("low", "high", F.lit(step).cast("long"))).alias("i", "at"))
    return each.select(F.col("i").cast("long").alias("i"), F.when(F.col("i") == 0, F.lit(0)).otherwise(F.col("at")).cast("long").alias("bound"))


def chunk_sizes(k: Column, size: int, merge_tail: bool) -> Column:
    """Sizes of a row's chunks: full ones and the rest; a rest under half a chunk joins the last full one, if asked."""
    full, rest = F.floor(k / size), k % size
    plain = F.concat(F.array_repeat(F.lit(size).cast("long"), full.cast("int")), F.when(rest > 0, F.array(rest.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    if not merge_tail:
        return plain
    joined = F.concat(F.array_repeat(F.lit(size).cast("long"), (full - 1).cast("int")), F.array((rest + size).cast("long")))
    return F.when((rest > 0) & (full > 0) & (rest * 2 < size), joined).otherwise(plain)


def _with_ends(matrix: SparseMatrix, cuts: DataFrame) -> DataFrame:
    ends = matrix.spark.range(2).select((F.col("id") * matrix.n_rows).alias("cut"))
    return cuts.unionByName(ends).distinct()


def least_nnz_cuts(matrix: SparseMatrix, least: int, band: int = BAND) -> DataFrame:
    """Blocks are closed when they hold `least` entries or more; an empty tail joins the last block. They are found once for entries that are kept."""
    if matrix.kept:
        if (least, band) not in matrix.found_cuts:
            matrix.found_cuts[least, band] = cut(_least_nnz_cuts(matrix, least, band))
        return matrix.found_cuts[least, band]
    return _least_nnz_cuts(matrix, least, band)


def _least_nnz_cuts(matrix: SparseMatrix, least: int, band: int) -> DataFrame:
    cuts = _with_ends(matrix, scanned(matrix.row_nnz(), greedy(least, with_row=False), band))
    # The last block must hold an entry: cuts that only empty rows follow are taken back.
    top = matrix.entries.agg(F.max("row")).first()[0]
    return cuts.filter((F.col("cut") <= (top if top is not None else 0)) | (F.col("cut") == matrix.n_rows))


def adaptive_cuts(matrix: SparseMatrix, most: int = 1024, band: int = BAND) -> DataFrame:
    """Blocks hold at most `most` entries; a longer row is a block of its own."""
    return _with_ends(matrix, scanned(matrix.row_nnz(), greedy(most + 1, with_row=True), band))


def adjacent_average_cuts(matrix: SparseMatrix, rate: float, width: int, band: int = BAND) -> DataFrame:
    """A cut where a row's length leaves [avg / rate, avg * rate], avg over the up to `width` - 1 rows before it since the last cut."""
    return _with_ends(matrix, scanned(matrix.row_nnz(), adjacent(rate, width), band))
