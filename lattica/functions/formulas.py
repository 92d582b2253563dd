"""Index arrays as closed forms: an array (i, a), i from 0, whose values follow a formula need not be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.runs import run_length_encode

MOST_RUNS = 5
#: Upper ends of the unsigned widths, and the Spark type that holds each.
WIDTHS = (("u8", 255, "short"), ("u16", 65_535, "int"), ("u32", 4_294_967_295, "long"), ("u64", None, "long"))


def suggest_type(top: Column) -> Column:
    """Name of the narrowest unsigned width for a largest value."""
    out = F.lit(WIDTHS[-1][0])
    for name, end, _ in reversed(WIDTHS[:-1]):
        out = F.when(top <= end, F.lit(name)).otherwise(out)
    return out


def suggest_signed(low: Column, top: Column) -> Column:
    """Name of the narrowest signed width for a range."""
    out = F.lit("i64")
    for name, bits in (("i32", 31), ("i16", 15), ("i8", 7)):
        out = F.when((low >= -(1 << bits)) & (top < (1 << bits)), F.lit(name)).otherwise(out)
    return out


def type_for_bits(bits: int) -> str:
    """Name of the narrowest unsigned width with so many bits."""
    return next(name for name, width in (("u8", 8), ("u16", 16), ("u32", 32), ("u64", 64)) if bits <= width)


def linear(seq: DataFrame) -> DataFrame:
    """One row: fits, b and c, for a = b + c i with c >= 0 over more than one value."""
    ends = seq.agg(F.min_by("a", "i").alias("b"), F.min_by("a", F.when(F.col("i") >= 1, F.col("i"))).alias("second"), F.count("*").alias("n"))
    ends = ends.withColumn("c", F.col("second") - F.col("b"))
    wrong = seq.join(F.broadcast(ends)).agg(F.count_if(F.col("a") != F.col("b") + F.col("c") * F.col("i")).alias("wrong"))
    return ends.join(F.broadcast(wrong)).select(((F.col("wrong") == 0) & (F.col("n") > 1) & (F.col("c") >= 0)).alias("fits"), "b", "c")


def constant(seq: DataFrame) -> DataFrame:
    """One row: fits and value."""
    return seq.agg(F.coalesce(F.min("a") == F.max("a"), F.lit(False)).alias("fits"), F.min("a").alias("value"))


def branches(seq: DataFrame, most: int = MOST_RUNS) -> DataFrame:
    """One row: fits (at most `most` runs in more than two values) and the number of runs."""
    runs = run_length_encode(seq, "i", "a").agg(F.count("*").alias("runs"), F.sum("length").alias("n"))
    return runs.select(((F.col("runs") <= most) & (F.col("n") > 2)).alias("fits"), "runs")


def cycle_linear(seq: DataFrame) -> DataFrame:
    """One row: fits, period, b and c, for a = (i mod p) c + b with 1 < p < n and p a divisor of n.

    The period is the first place where the first value comes back; every value is checked.
    """
    first = seq.agg(F.min_by("a", "i").alias("b"), F.min_by("a", F.when(F.col("i") >= 1, F.col("i"))).alias("second"), F.count("*").alias("n"))
    back = seq.join(F.broadcast(first)).filter((F.col("i") > 0) & (F.col("a") == F.col("b"))).agg(F.min("i").alias("period"))
    shape = first.join(F.broadcast(back)).withColumn("c", F.col("second") - F.col("b"))
    wrong = seq.join(F.broadcast(shape)).agg(F.count_if(F.col("a") != F.pmod(F.col("i"), F.col("period")) * F.col("c") + F.col("b")).alias("wrong"))
    good = (F.col("wrong") == 0) & (F.col("period") > 1) & (F.col("period") < F.col("n")) & (F.col("n") % F.col("period") == 0)
    return shape.join(F.broadcast(wrong)).select(F.coalesce(good, F.lit(False)).alias("fits"), "period", "b", "c")


def cycle_increase(seq: DataFrame) -> DataFrame:
    """One row: fits, period and b, for a = i div p + b; p is the first run's length and divides n > 2."""
    first = seq.agg(F.min_by("a", "i").alias("b"), F.count("*").alias("n"))
    change = seq.join(F.broadcast(first)).filter(F.col("a") != F.col("b")).agg(F.min("i").alias("change"))
    shape = first.join(F.broadcast(change)).withColumn("period", F.coalesce("change", "n"))
    wrong = seq.join(F.broadcast(shape)).agg(F.count_if(F.col("a") != F.floor(F.col("i") / F.col("period")) + F.col("b")).alias("wrong"))
    good = (F.col("wrong") == 0) & (F.col("n") > 2) & (F.col("n") % F.col("period") == 0)
    return shape.join(F.broadcast(wrong)).select(F.coalesce(good, F.lit(False)).alias("fits"), "period", "b")


#: Order in which forms are tried: the cheapest to evaluate first.
FORMS = (("constant", constant), ("linear", linear), ("cycle_linear", cycle_linear), ("cycle_increase", cycle_increase), ("branches", branches))


def best_form(seq: DataFrame) -> str | None:
    """Name of the first form that fits, or None when the array has to be stored."""
    for name, form in FORMS:
        if form(seq).first()["fits"]:
            return name
    return None
