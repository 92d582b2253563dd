"""Partitions into three nested levels: blocks (blb), warps in blocks (wlb) and threads in warps (tlb).

A partition is a column beside each entry for every level that has been set, so that the levels of the
whole matrix, or of all blocks of a divided one, are set at once. `at` and `len` are an entry's place in
its row's segment and the segment's length: a split by columns turns rows into more and shorter segments.

Ids: a block counts from 0 in its part of the matrix (rows) or over the matrix (columns); a warp counts inside
its block (rows) or over the matrix (columns); a thread is a chunk of its segment, or a run of entries (nnz).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.model import SparseMatrix
from lattica.operators.division import numbered
from lattica.operators.order import ranged_places, running_sum, with_groups
from lattica.session import cut, keep

KEYS = {"blb": ["block", "blb"], "wlb": ["block", "blb", "wlb"], "tlb": ["block", "blb", "wlb", "row", "tlb"]}


@dataclass(frozen=True)
class Levels:
    """entries: block, row, col, val, is_pad, nz, row_lo, at, len, the levels that are set, and old_row where rows were numbered as they were sorted."""

    entries: DataFrame
    matrix: SparseMatrix
    has: tuple[str, ...] = ()
    #: Whether rows have been cut by columns, so that a row may have several segments.
    cut_rows: bool = False
    #: Whether ids over the matrix count without gaps. Sums only need parts told apart: there a part is named by its segment's first entry.
    gapless: bool = True

    def put(self, level: str, **columns: Column) -> Levels:
        return replace(self, entries=self.entries.withColumns(columns), has=(*self.has, level))


def opened(matrix: SparseMatrix, gapless: bool = True) -> Levels:
    """No level set yet. A divided matrix carries block and row_lo (its block's first row), any other one is one block."""
    placed = numbered(matrix)
    for name, value in (("block", F.lit(0).cast("long")), ("row_lo", F.lit(0).cast("long")), ("is_pad", F.lit(False))):
        if name not in placed.columns:
            placed = placed.withColumn(name, value)
    placed = placed.withColumnsRenamed({"rn": "at", "k": "len"})
    sort = [c for c in ("old_row",) if c in placed.columns]
    return Levels(placed.select("block", "row", "col", "val", "is_pad", "nz", "row_lo", "at", "len", *sort), matrix, gapless=gapless)


def chunks(length: Column, size: int, merge_tail: bool) -> Column:
    """Chunks of a segment; a rest under half a chunk joins the last full one, if asked."""
    full = F.floor(length / size)
    if not merge_tail:
        return F.ceil(length / size)
    return F.when((full > 0) & ((length % size) * 2 < size), full).otherwise(full + (length % size > 0).cast("long"))


def _split(levels: Levels, level: str, size: int, merge_tail: bool, chosen: Column | None = None) -> Levels:
    """Segments cut into chunks, each with an id of its own over the matrix. chosen: which segments are cut.

    An entry's number less its place is its segment's first number. Segments have no more chunks than entries, so that with gaps
    a chunk's id is that number and the chunk's own, and no entry is moved; without gaps the chunks of all earlier rows are counted.
    """
    e, by = levels.entries, [k for k in ("block", "blb", "wlb") if k in levels.entries.columns]
    number = chunks(F.col("len"), size, merge_tail)
    if chosen is not None:
        number = F.when(chosen, number).otherwise(1)
        mine = F.when(chosen, F.least(F.floor(F.col("at") / size), number - 1)).otherwise(0)
    else:
        mine = F.least(F.floor(F.col("at") / size), number - 1)
    if not levels.gapless:
        e = e.withColumns({"_begin": F.col("nz") - F.col("at"), "_before": F.lit(0)})
    elif levels.cut_rows:
        rows = e.select("row", *by, number.alias("_n")).distinct().groupBy("row").agg(F.sum("_n").alias("_n"))
        earlier = e.filter("at = 0").select("row", *by, F.col("col").alias("_first"), number.alias("_k"))
        over = Window.partitionBy("row").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
        earlier = earlier.select("row", *by, F.coalesce(F.sum("_k").over(over), F.lit(0)).alias("_before"))
        e = e.join(earlier, ["row", *by])
    else:
        rows = e.filter("at = 0").select("row", number.alias("_n"))
        e = e.withColumn("_before", F.lit(0))
    if levels.gapless:
        e = e.join(running_sum(rows, "row", "_n", "_begin").select("row", "_begin"), "row")
    e = e.withColumns({"_mine": mine, "_number": number})
    own = F.when(F.col("_number") == 1, F.col("len")).when(F.col("_mine") == F.col("_number") - 1, F.col("len") - F.col("_mine") * size).otherwise(size)
    e = e.withColumns({level: F.col("_begin") + F.col("_before") + F.col("_mine"), "len": own, "at": F.when(F.col("_number") == 1, F.col("at")).otherwise(F.col("at") - F.col("_mine") * size)})
    return replace(levels, entries=e.drop("_mine", "_number", "_begin", "_before"), has=(*levels.has, level), cut_rows=True)


def blb_whole(levels: Levels) -> Levels:
    return levels.put("blb", blb=F.lit(0).cast("long"), blb_lo=F.col("row_lo"))


def blb_rows(levels: Levels, height: int) -> Levels:
    """Bands of `height` rows of each part."""
    band = F.floor((F.col("row") - F.col("row_lo")) / height)
    return levels.put("blb", blb=band, blb_lo=F.col("row_lo") + band * height)


def blb_rows_at(levels: Levels, cuts: DataFrame) -> Levels:
    """Blocks of explicit rows: `cut` holds the first row of each, 0 first."""
    rows = levels.matrix.rows()
    marked = rows.join(cuts.filter(F.col("cut") < levels.matrix.n_rows).select(F.col("cut").alias("row"), F.lit(1).cast("long").alias("_one")).distinct(), "row", "left")
    summed = running_sum(marked.withColumn("_one", F.coalesce("_one", F.lit(0))), "row", "_one", "_earlier")
    ids = summed.select("row", (F.col("_earlier") + F.col("_one") - 1).alias("blb"))
    firsts = ids.groupBy("blb").agg(F.min("row").alias("blb_lo"))
    both = levels.entries.join(with_groups(ids, firsts, "blb"), "row")
    return replace(levels, entries=both, has=(*levels.has, "blb"))


def blb_cols(levels: Levels, size: int, merge_tail: bool = True, chosen: Column | None = None) -> Levels:
    """Every row, or those that `chosen` names, cut into chunks of `size` entries: a block holds one row."""
    return _with_lo(_split(levels, "blb", size, merge_tail, chosen))


def _with_lo(levels: Levels) -> Levels:
    return replace(levels, entries=levels.entries.withColumn("blb_lo", F.col("row")))


def _blocks(levels: Levels) -> Levels:
    return levels if "blb" in levels.has else blb_whole(levels)


def wlb_whole(levels: Levels) -> Levels:
    return _blocks(levels).put("wlb", wlb=F.lit(0).cast("long"))


def wlb_rows(levels: Levels, height: int | DataFrame) -> Levels:
    """Bands of rows inside blocks: one height for all, or `height` by (block, blb); a block that is not listed is one warp."""
    levels = _blocks(levels)
    if isinstance(height, int):
        return levels.put("wlb", wlb=F.floor((F.col("row") - F.col("blb_lo")) / height))
    e = levels.entries.join(height.select("block", "blb", F.col("height").alias("_height")), ["block", "blb"], "left")
    e = e.withColumn("wlb", F.coalesce(F.floor((F.col("row") - F.col("blb_lo")) / F.col("_height")), F.lit(0))).drop("_height")
    return replace(levels, entries=e, has=(*levels.has, "wlb"))


def wlb_cols(levels: Levels, size: int, merge_tail: bool = False) -> Levels:
    """Every row of a block is cut into chunks of `size` entries: a warp holds one row."""
    return _split(_blocks(levels), "wlb", size, merge_tail)


def _warps(levels: Levels) -> Levels:
    return levels if "wlb" in levels.has else wlb_whole(levels)


def tlb_rows(levels: Levels) -> Levels:
    """A thread for each segment, as wide as the warp's longest one."""
    return tlb_cols(levels)


def tlb_cols(levels: Levels, width: int | None = None) -> Levels:
    """Chunks of `width` entries; without it a warp's longest segment is the width, so that a thread has one segment."""
    levels = _warps(levels)
    if width is not None:
        return levels.put("tlb", tlb=F.floor(F.col("at") / width), width=F.lit(width).cast("long"))
    widths = levels.entries.groupBy(*KEYS["wlb"]).agg(F.max("len").alias("width"))
    return replace(levels, entries=with_groups(levels.entries, widths, KEYS["wlb"]).withColumn("tlb", F.lit(0).cast("long")), has=(*levels.has, "tlb"))


def tlb_nnz(levels: Levels, size: int) -> Levels:
    """Equal shares of entries, whatever rows they are of; no other level is set."""
    if levels.has:
        raise ValueError("equal shares of entries stand alone")
    return _warps(levels).put("tlb", tlb=F.floor(F.col("nz") / size))


def completed(levels: Levels) -> Levels:
    """What has not been set: one block, one warp in it, one entry a thread."""
    levels = _warps(levels)
    return levels if "tlb" in levels.has else tlb_cols(levels, 1)


def table(levels: Levels, level: str) -> DataFrame:
    """A level's parts: their keys, first_row, n_rows (the span of rows) and nnz."""
    keys = [k for k in KEYS[level] if k in levels.entries.columns]
    return levels.entries.groupBy(*keys).agg(F.min("row").alias("first_row"), (F.max("row") - F.min("row") + 1).alias("n_rows"), F.count("*").alias("nnz"))


def padded(levels: Levels, more: tuple[str, ...] = ()) -> DataFrame:
    """Entries with slot, filled up so that every thread of a warp holds `width` entries; pads repeat the segment's last column with value 0.

    A segment's last entry brings the pads of its thread, so that nothing is grouped. more: further columns that pads repeat too. Where a division by
    columns has parted rows, an entry's place does not tell whether it is the last one of its block's part, and threads are counted.
    """
    keys = KEYS["tlb"]
    if not levels.matrix.by_cols:
        slot, own = F.col("at") - F.col("tlb") * F.col("width"), F.col("slot") == F.col("_own")
        each = levels.entries.withColumn("_own", slot)
        end = F.when(F.col("at") == F.col("len") - 1, F.col("width") - 1).otherwise(F.col("_own"))
        each = each.withColumn("slot", F.explode(F.sequence("_own", end)))
        return each.select(*keys, "col", F.when(own, F.col("val")).otherwise(0.0).alias("val"), "slot", (F.col("is_pad") | ~own).alias("is_pad"), *more)
    placed = levels.entries.withColumn("slot", F.col("at") - F.col("tlb") * F.col("width"))
    ends = placed.groupBy(*keys, "width").agg(F.count("*").alias("_k"), F.max_by("col", "at").alias("col")).filter("_k < width")
    pads = ends.select(*keys, "col", F.lit(0.0).alias("val"), F.explode(F.sequence(F.col("_k"), F.col("width") - 1)).alias("slot"), F.lit(True).alias("is_pad"))
    return placed.select(*keys, "col", "val", "slot", "is_pad").unionByName(pads)


def interleaved(levels: Levels) -> DataFrame:
    """padded() with position: inside a warp the first entries of all threads come first, then all second ones.

    A thread's number in its warp is arithmetic: a segment has a thread for each `width` entries, and the threads before a
    segment are a running sum over all segments in order, less that of the warp's first one. So no task holds a warp, which
    may be the whole matrix.
    """
    warp = KEYS["wlb"]
    number = F.ceil(F.max("len") / F.max("width"))
    segments = levels.entries.groupBy(*warp, "row").agg(number.alias("_threads"))
    segments = ranged_places(segments, [*[F.col(c) for c in warp], F.col("row")], "_nth")
    segments = cut(running_sum(segments, "_nth", "_threads", "_first").drop("_nth"))
    warps = segments.groupBy(*warp).agg(F.min("_first").alias("_base"), F.sum("_threads").alias("_all"))
    # A warp's numbers go to its segments, which are fewer than its entries, and with them to the entries.
    segments = with_groups(segments.select(*warp, "row", "_first"), warps, warp)
    if levels.matrix.by_cols:
        both = padded(levels).join(segments, [*warp, "row"])
    else:  # entries are fewer than what they are filled up to
        both = padded(replace(levels, entries=levels.entries.join(segments, [*warp, "row"])), ("_first", "_base", "_all"))
    thread = F.col("_first") - F.col("_base") + F.col("tlb")
    return both.withColumn("position", F.col("slot") * F.col("_all") + thread).drop("_first", "_base", "_all")


def reduce_rows(levels: Levels, warp: int = 32) -> DataFrame:
    """tlb, first_row and relative_row: a thread's first row less the first row of its group of `warp` threads."""
    rows = levels.entries.groupBy("tlb").agg(F.min("row").alias("first_row")).withColumn("wlb", F.floor(F.col("tlb") / warp))
    base = rows.groupBy("wlb").agg(F.min("first_row").alias("_base"))
    return rows.join(base, "wlb").select("tlb", "wlb", "first_row", (F.col("first_row") - F.col("_base")).alias("relative_row"))


def kept(levels: Levels) -> Levels:
    """The same partition, computed now, for plans that read it several times."""
    return replace(levels, entries=keep(levels.entries))
