"""Global positions and prefix sums without moving all rows to one task.

Rows are put into bands of `BAND` consecutive indices. Sizes of bands, a table that is smaller by that
factor, are summed in order; what is inside a band is numbered there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.session import cut

BAND = 65_536
BEFORE = (Window.unboundedPreceding, -1)
#: Groups that may be broadcast to their rows.
MOST_GROUPS = 500_000


def with_groups(df: DataFrame, groups: DataFrame, on: str | list[str]) -> DataFrame:
    """df joined to a table of one row for each group. A few groups may hold all rows, so that they are broadcast; many are joined by a shuffle."""
    groups = cut(groups)
    return df.join(F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups, on)


def running_sum(df: DataFrame, row: str, value: str, into: str, band: int = BAND) -> DataFrame:
    """df with `into`: the sum of `value` over all smaller rows (exclusive prefix sum); rows are unique."""
    df = df.withColumn("_band", F.floor(F.col(row) / band))
    sizes = df.groupBy("_band").agg(F.sum(value).alias("_size"))
    starts = sizes.select("_band", F.coalesce(F.sum("_size").over(Window.orderBy("_band").rowsBetween(*BEFORE)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_band").orderBy(row).rowsBetween(*BEFORE)), F.lit(0))
    return df.withColumn("_inside", inside).join(starts, "_band").withColumn(into, F.col("_start") + F.col("_inside")).drop("_band", "_start", "_inside")


def global_position(df: DataFrame, order: list[Column], names: list[str], row: str, into: str, within: list[str] | None = None, band: int = BAND) -> DataFrame:
    """df with `into`: its 0-based place when ordered by `order` (over the columns `names`), then by row.

    names: few different values, such as row lengths. within: columns that each have an order of their own.
    """
    within = within or []
    df = df.withColumn("_band", F.floor(F.col(row) / band))
    keys = list(dict.fromkeys([*within, *names, "_band"]))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    over = Window.partitionBy(*within) if within else Window.partitionBy()
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(over.orderBy(*order, "_band").rowsBetween(*BEFORE)), F.lit(0))).drop("_size")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(row)) - 1
    return df.withColumn("_inside", inside).join(starts, keys).withColumn(into, F.col("_start") + F.col("_inside")).drop("_band", "_start", "_inside")


def previous(df: DataFrame, row: str, value: str, into: str, band: int = BAND) -> DataFrame:
    """df with `into`: the value of the row before (rows are consecutive numbers); the last rows of bands are joined to the next band's first."""
    df = df.withColumn("_band", F.floor(F.col(row) / band))
    edges = df.filter(F.pmod(F.col(row), F.lit(band)) == band - 1).select((F.col("_band") + 1).alias("_band"), F.col(value).alias("_edge"))
    inside = F.lag(value).over(Window.partitionBy("_band").orderBy(row))
    first = F.pmod(F.col(row), F.lit(band)) == 0
    return df.withColumn("_inside", inside).join(edges, "_band", "left").withColumn(into, F.when(first, F.col("_edge")).otherwise(F.col("_inside"))).drop("_band", "_inside", "_edge")


def intervals(rows: DataFrame, cuts: DataFrame, row: str = "row", band: int = BAND) -> DataFrame:
    """rows with `range`, how many cuts lie at or before the row less one, and `low`, the last of them.

    An interval join for any number of cuts (column cut): cuts and rows meet in bands of rows, and what a band takes over,
    its last cut and their number, is carried into it from the bands before. rows are unique; rows before the first
    cut have range -1.
    """
    marks = cuts.select(F.col("cut").alias(row), F.lit(1).alias("_mark")).distinct()
    marked = rows.join(marks, row, "left").withColumn("_band", F.floor(F.col(row) / band))
    own = F.when(F.col("_mark") == 1, F.col(row))
    sizes = marked.groupBy("_band").agg(F.count("_mark").alias("_n"), F.max(own).alias("_top"))
    before = Window.orderBy("_band").rowsBetween(*BEFORE)
    carried = sizes.select("_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"), F.max("_top").over(before).alias("_last"))
    here = Window.partitionBy("_band").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumns({"_inside": F.count("_mark").over(here), "_own": F.max(own).over(here)}).join(carried, "_band")
    return inside.withColumns({"range": F.col("_earlier") + F.col("_inside") - 1, "low": F.coalesce("_own", "_last")}).drop("_band", "_mark", "_inside", "_own", "_earlier", "_last")


def ranged_places(df: DataFrame, order: list[Column], into: str, per: str | None = None) -> DataFrame:
    """df with `into`: its 0-based place in the order of all columns of `order`, which no two rows share, whatever values these have.

    Rows are dealt to ranges of the order by a sample, kept, and counted; a range is sorted by itself, and begins where the
    ranges before it end. Equal first columns are split by the later ones, so that no value fills a range of its own.
    per: places count from 0 for each value of this column, which has to come first in the order. Only values at the ends of ranges
    (and null) lie in several of them; how many of their rows earlier ranges hold is counted, for these few values a range.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    if per is not None:
        same = F.col(per).eqNullSafe(F.col("_value"))
        ends = ranged.groupBy("_part").agg(F.array(F.min(per), F.max(per), F.lit(None)).alias("_ends"))
        ends = ends.select(F.explode("_ends").alias("_value")).distinct()
        shared = ranged.select("_part", per).join(F.broadcast(ends), same).groupBy("_part", "_value").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_value").orderBy("_part").rowsBetween(*BEFORE))
        shared = shared.select(F.col("_part").alias("_at"), "_value", before.alias("_before")).filter("_before > 0")
        inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy("_part", per).orderBy(*order)) - 1)
        both = inside.join(F.broadcast(shared), (F.col("_part") == F.col("_at")) & same, "left")
        return both.withColumn(into, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_part", "_inside", "_at", "_value", "_before")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_part").withColumn(into, F.col("_start") + F.col("_inside"))
    placed = placed.drop("_part", "_start", "_inside")
    return placed
