"""Operations on a sequence of (position, value): runs, scans, segments, histograms, selection.

Positions are consecutive numbers from 0. A run is a longest stretch of equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.order import BAND, previous, ranged_places, running_sum


def run_ids(seq: DataFrame, pos: str = "pos", key: str = "key", band: int = BAND) -> DataFrame:
    """seq with run, the 0-based number of its run, and begins, whether a run begins there."""
    marked = previous(seq, pos, key, "_before").withColumn("begins", ~F.coalesce(F.col("_before").eqNullSafe(F.col(key)) & (F.col(pos) > 0), F.lit(False)))
    summed = running_sum(marked.withColumn("_one", F.col("begins").cast("long")), pos, "_one", "_earlier", band)
    return summed.withColumn("run", F.col("_earlier") + F.col("_one") - 1).drop("_before", "_one", "_earlier")


def run_length_encode(seq: DataFrame, pos: str = "pos", key: str = "key", at_least: int = 1) -> DataFrame:
    """run, key, begin and length of the runs of at least `at_least` values."""
    runs = run_ids(seq, pos, key).groupBy("run").agg(F.first(key).alias("key"), F.min(pos).alias("begin"), F.count("*").alias("length"))
    return runs.filter(F.col("length") >= at_least)


def reduce_by_key(seq: DataFrame, value: str, pos: str = "pos", key: str = "key") -> DataFrame:
    """run, key and total of the values of each run (equal keys apart stay apart)."""
    return run_ids(seq, pos, key).groupBy("run").agg(F.first(key).alias("key"), F.sum(value).alias("total"))


def unique_consecutive(seq: DataFrame, pos: str = "pos", key: str = "key") -> DataFrame:
    """The first value of each run."""
    return run_ids(seq, pos, key).filter("begins").select(pos, key)


def scan(seq: DataFrame, value: str, pos: str = "pos", inclusive: bool = True) -> DataFrame:
    """seq with scan: the sum of all values up to here."""
    summed = running_sum(seq, pos, value, "scan")
    return summed.withColumn("scan", F.col("scan") + F.col(value)) if inclusive else summed


def segmented_reduce(seq: DataFrame, segment: str, value: str) -> DataFrame:
    return seq.groupBy(segment).agg(F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def segmented_sort(seq: DataFrame, segment: str, value: str, descending: bool = False, pos: str = "pos") -> DataFrame:
    """seq with place: the 0-based place of a value in its segment, equal values in their order. A segment may hold any share of the rows."""
    order = F.desc(value) if descending else F.asc(value)
    return ranged_places(seq, [F.asc(segment), order, F.asc(pos)], "place", segment)


def histogram_even(values: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin and n for `bins` equal bins over [low, high); values outside are left out, empty bins have 0."""
    width = (high - low) / bins
    inside = values.filter((F.col(value) >= low) & (F.col(value) < high))
    counts = inside.groupBy(F.floor((F.col(value) - low) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def partition_flagged(seq: DataFrame, flag: str, pos: str = "pos") -> DataFrame:
    """seq with place: flagged values first, each part in its order."""
    flagged = running_sum(seq.withColumn("_one", F.col(flag).cast("long")), pos, "_one", "_before")
    total = seq.agg(F.count_if(flag).alias("_total"))
    place = F.when(F.col(flag), F.col("_before")).otherwise(F.col("_total") + F.col(pos) - F.col("_before"))
    return flagged.join(F.broadcast(total)).withColumn("place", place).drop("_one", "_before", "_total")


def lanes(seq: DataFrame, flag: str, warp: int = 32, pos: str = "pos") -> DataFrame:
    """seq with wlb, lane and reduce_offset: lanes to the next flagged lane of the warp (or its end)."""
    tagged = seq.withColumn("wlb", F.floor(F.col(pos) / warp)).withColumn("lane", F.pmod(F.col(pos), F.lit(warp)))
    after = Window.partitionBy("wlb").orderBy("lane").rowsBetween(1, Window.unboundedFollowing)
    following = F.min(F.when(F.col(flag), F.col("lane"))).over(after)
    return tagged.withColumn("reduce_offset", F.coalesce(following, F.lit(warp)) - F.col("lane"))


def grouped(seq: DataFrame, value: str, size: int, pos: str = "pos") -> DataFrame:
    """part and values: `size` consecutive values as one array, in order."""
    parts = seq.groupBy(F.floor(F.col(pos) / size).alias("part")).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("e"))
    return parts.select("part", F.col("e").getField(value).alias("values"))


def pack_bits(seq: DataFrame, flag: str, offset: str, offset_bits: int) -> DataFrame:
    """seq with packed (the flag above the offset's bits) and its bits as text."""
    packed = F.shiftleft(F.col(flag).cast("long"), offset_bits).bitwiseOR(F.col(offset).cast("long"))
    return seq.withColumn("packed", packed).withColumn("bits", F.lpad(F.bin("packed"), offset_bits + 1, "0"))


def arg_extremes(seq: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """One row: least and most, and the first position of each."""
    low, high = F.min(F.struct(value, pos)), F.max(F.struct(F.col(value), (-F.col(pos)).alias(pos)))
    return seq.agg(low.alias("lo"), high.alias("hi")).select(F.col("lo")[value].alias("least"), F.col("lo")[pos].alias("least_at"), F.col("hi")[value].alias("most"), (-F.col("hi")[pos]).alias("most_at"))


def scan_max(seq: DataFrame, value: str, pos: str = "pos", band: int = BAND) -> DataFrame:
    """seq with scan: the largest value up to here, by bands whose own largest values are scanned first."""
    seq = seq.withColumn("_band", F.floor(F.col(pos) / band))
    tops = seq.groupBy("_band").agg(F.max(value).alias("_top"))
    before = tops.select("_band", F.max("_top").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max(value).over(Window.partitionBy("_band").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return seq.withColumn("_inside", inside).join(before, "_band").withColumn("scan", F.greatest("_before", "_inside")).drop("_band", "_inside", "_before")


def histogram_range(values: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """bin and n for bins between consecutive bounds; values outside are left out, empty bins have 0."""
    inside = values.filter((F.col(value) >= bounds[0]) & (F.col(value) < bounds[-1]))
    bin_of = F.lit(0)
    for i, b in enumerate(bounds[1:-1], 1):
        bin_of = F.when(F.col(value) >= b, F.lit(i)).otherwise(bin_of)
    counts = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(len(bounds) - 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_multi(values: DataFrame, channels: dict[str, tuple[float, float, int]]) -> DataFrame:
    """channel, bin and n: equal bins over (low, high, bins) of several columns, from one pass over the values."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.floor((F.col(c) - low) / ((high - low) / bins)).alias("bin"), ((F.col(c) >= low) & (F.col(c) < high)).alias("inside")) for c, (low, high, bins) in channels.items()])
    counts = values.select(F.explode(each).alias("x")).filter("x.inside").groupBy("x.channel", "x.bin").agg(F.count("*").alias("n"))
    every = values.sparkSession.createDataFrame([(c, i) for c, (_, _, bins) in channels.items() for i in range(bins)], "channel string, bin long")
    return every.join(counts, ["channel", "bin"], "left").select("channel", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def sorted_places(seq: DataFrame, key: str, pos: str = "pos", descending: bool = False) -> DataFrame:
    """seq with place: the 0-based place by key, equal keys in their order. Keys of any type and number."""
    return ranged_places(seq, [F.desc(key) if descending else F.asc(key), F.asc(pos)], "place")


def segmented_scan(seq: DataFrame, value: str, flag: str, pos: str = "pos", inclusive: bool = True, band: int = BAND) -> DataFrame:
    """seq with scan: the sum of the values since the last flag, which begins anew at each flagged position.

    A band is summed up by whether it holds a flag and by the sum behind its last one; these pairs are added up in order,
    where a flag forgets what came before it, and each band takes over what the bands before it leave.
    """
    begins = F.coalesce(F.col(flag), F.lit(False))
    seq = seq.withColumn("_band", F.floor(F.col(pos) / band))
    here = Window.partitionBy("_band").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inside = seq.withColumn("_part", F.sum(begins.cast("long")).over(here))
    parts = Window.partitionBy("_band", "_part").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_sum", F.sum(value).over(parts))
    sums = seq.groupBy("_band").agg(F.max(F.when(begins, F.col(pos))).alias("_last"))
    tails = seq.join(sums, "_band").groupBy("_band").agg(F.max("_last").isNotNull().alias("_flagged"), F.sum(F.when(F.col("_last").isNull() | (F.col(pos) >= F.col("_last")), F.col(value))).alias("_tail"))
    groups = tails.withColumn("_group", F.sum(F.col("_flagged").cast("long")).over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)))
    left = groups.withColumn("_left", F.sum("_tail").over(Window.partitionBy("_group").orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)))
    carried = left.select("_band", F.lag("_left", 1, 0).over(Window.orderBy("_band")).alias("_carried"))
    out = inside.join(carried, "_band").withColumn("scan", F.col("_sum") + F.when(F.col("_part") == 0, F.col("_carried")).otherwise(0))
    if not inclusive:
        out = out.withColumn("scan", F.col("scan") - F.col(value))
    return out.drop("_band", "_part", "_sum", "_carried")
