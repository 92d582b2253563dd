"""A sparse matrix as DataFrames: entries (row, col, val) with explicit dimensions.

Rows without entries are invisible in `entries`, so that the dimensions are carried beside them. Explicit
zeros are entries. Several entries at one place are allowed and add up in products.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import keep

ENTRY = "row long, col long, val double"


@dataclass(frozen=True)
class SparseMatrix:
    entries: DataFrame
    n_rows: int
    n_cols: int
    #: new_row and old_row, where rows have been sorted.
    row_map: DataFrame | None = None
    #: Whether the entries are read from where they are kept, so that reading them again is cheap.
    kept: bool = False
    #: Whether it has been divided by columns, so that a row may lie in several blocks.
    by_cols: bool = False
    #: How many entries there are at most, where that is known.
    n_entries: int | None = None
    #: The same entries with rn, k and nz (see division.numbered), where these are known without moving entries; also old_row, null in pads, where rows have been sorted.
    numbers: DataFrame | None = None
    #: How many rows had been sorted; later ones are pads.
    n_sorted: int | None = None
    #: row_nnz() of entries that are kept, once it has been asked for.
    _lengths: list[DataFrame] = field(default_factory=list, init=False, repr=False, compare=False)
    #: Cut points of entries that are kept, by what was asked for.
    found_cuts: dict[tuple, DataFrame] = field(default_factory=dict, init=False, repr=False, compare=False)

    @staticmethod
    def of(df: DataFrame, row: str | Column = "row", col: str | Column = "col", val: str | Column = "val",
           n_rows: int | None = None, n_cols: int | None = None, add_up: bool = False) -> SparseMatrix:
        """A matrix of any DataFrame. Dimensions default to one more than the largest index; null indices are left out."""
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        entries = df.select(as_column(row).cast("long").alias("row"), as_column(col).cast("long").alias("col"), as_column(val).cast("double").alias("val"))
        entries = entries.filter(F.col("row").isNotNull() & F.col("col").isNotNull())
        n_entries = None
        if n_rows is None or n_cols is None:
            top = entries.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count("*").alias("n")).first()
            n_entries = top["n"]
            n_rows = n_rows if n_rows is not None else (-1 if top["r"] is None else top["r"]) + 1
            n_cols = n_cols if n_cols is not None else (-1 if top["c"] is None else top["c"]) + 1
        if add_up:
            entries = entries.groupBy("row", "col").agg(F.sum("val").alias("val"))
        return SparseMatrix(entries, n_rows, n_cols, n_entries=n_entries)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def with_entries(self, entries: DataFrame, **changes) -> SparseMatrix:
        return replace(self, entries=entries, **({"kept": False, "numbers": None} | changes))

    def held(self) -> SparseMatrix:
        """The same matrix with its entries computed once and kept."""
        return self if self.kept else self.with_entries(keep(self.entries), kept=True)

    def rows(self) -> DataFrame:
        """Every row index, empty rows included."""
        return self.spark.range(self.n_rows).select(F.col("id").alias("row"))

    def cols(self) -> DataFrame:
        return self.spark.range(self.n_cols).select(F.col("id").alias("col"))

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.n_cols, self.n_rows)

    def row_nnz(self) -> DataFrame:
        """row and k, its number of entries, for every row. Entries are counted before they meet the rows; what is counted of kept entries is kept too."""
        if self.kept:
            if not self._lengths:
                self._lengths.append(keep(self._counted()))
            return self._lengths[0]
        return self._counted()

    def _counted(self) -> DataFrame:
        if self.numbers is not None:
            counts = self.numbers.filter("rn = 0").select("row", "k")
        else:
            counts = self.entries.groupBy("row").agg(F.count("*").alias("k"))
        return self.rows().join(counts, "row", "left").select("row", F.coalesce("k", F.lit(0)).alias("k"))
