"""Coordinate and Matrix-Market text, and numbered arrays, read and written by Spark."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.csv as csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.model import SparseMatrix
from lattica.operators.order import BAND, BEFORE, ranged_places
from lattica.session import cut, in_tasks, parts

BANNER = "%%MatrixMarket"
#: Values of a dense array that one task writes.
CELLS_OF_A_TASK = 4_000_000
#: Bytes of a file, as it is stored, up to which a dense array is read by whole files, and what such a file is called.
LARGEST_FILE, FILE_NAME = 1 << 26, r"^[^.]*(\.(txt|mtx))?(\.gz)?$"
#: Bytes of text that are parsed at once.
CHUNK = 1 << 20


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.split(F.trim("value"), r"\s+").alias("f"))


def _lines(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """value and place (file, block and line in it), by which the lines of all files of a folder, or of one file, are in order."""
    name = F.col("_metadata.file_path")
    block = F.struct(name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).filter(name == file if file else F.lit(True)).select("value", block.alias("place"))


def _first(lines: DataFrame) -> tuple[str | None, DataFrame]:
    """The first line in order, and the others."""
    first = lines.agg(F.min(F.struct("place", "value")).alias("x")).first()["x"]
    if first is None:
        return None, lines
    place = F.struct(*[F.lit(first["place"][c]).alias(c) for c in ("file", "block", "line")])
    return first["value"], lines.filter(F.col("place") != place)


def read_coo(spark: SparkSession, path: str, one_based: bool = True) -> SparseMatrix:
    """A COO text: the first line that is neither blank nor led by a space has rows and columns; then `row col val`.

    A third number of the header is not used. A missing value is 1.
    """
    header, body = _first(_lines(spark, path).filter(~F.col("value").rlike(r"^(\s|$)") & ~F.col("value").startswith("%")))
    if header is None:
        raise ValueError(f"{path} has no header")
    n_rows, n_cols = (int(x) for x in header.split()[:2])
    return SparseMatrix(_entries(body, one_based), n_rows, n_cols)


def _entries(lines: DataFrame, one_based: bool) -> DataFrame:
    shift, f = (1 if one_based else 0), F.col("f")
    return _fields(lines).select(
        (f[0].cast("long") - shift).alias("row"), (f[1].cast("long") - shift).alias("col"), F.coalesce(F.get(f, 2).cast("double"), F.lit(1.0)).alias("val")
    )


def _head(lines: DataFrame) -> tuple[list[str], str | None, DataFrame]:
    """The banner's words, the header, and the lines after it that are no comments."""
    lines = lines.filter(F.trim("value") != "")
    banner = lines.filter(F.col("value").startswith(BANNER)).first()
    header, body = _first(lines.filter(~F.col("value").startswith("%")))
    return banner["value"].lower().split() if banner else [], header, body


def read_matrix_market(spark: SparkSession, path: str, values: str = "file") -> SparseMatrix:
    """Matrix-Market text: symmetric and skew storage is expanded, dense arrays are column-major.

    values: "file", or "pattern" for 1 everywhere. A dense array in small files is read by files, and its lines are not moved.
    """
    first = _first_file(spark, path)
    kind, header, body = _head(_lines(spark, path, first))
    by_files = first is not None and header is not None and "array" in kind
    if first is not None and not by_files:
        kind, header, body = _head(_lines(spark, path))
    n_rows, n_cols = (int(x) for x in header.split()[:2])
    row, col = F.pmod("i", F.lit(n_rows)).alias("row"), F.floor(F.col("i") / n_rows).alias("col")
    if by_files:
        entries = _cells(spark, path, first).select(row, col, "val")
    elif "array" in kind:
        placed = ranged_places(body, [F.col(f"place.{c}") for c in ("file", "block", "line")], "i")
        entries = placed.select(row, col, F.trim("value").cast("double").alias("val"))
    else:
        entries = _entries(body, True)
    if "symmetric" in kind or "skew-symmetric" in kind:
        entries = expand_symmetric(entries, -1.0 if "skew-symmetric" in kind else 1.0)
    if values == "pattern":
        entries = entries.withColumn("val", F.lit(1.0))
    return SparseMatrix(entries, n_rows, n_cols)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, length and content; what is not asked for is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length", "content")


def _first_file(spark: SparkSession, path: str) -> str | None:
    """The first file in order that is not empty, if none is too large to be read at once and all are text or gzip by their names."""
    files = _files(spark, path).select("file", "length").filter("length > 0")
    fits = (F.col("length") <= LARGEST_FILE) & F.element_at(F.split("file", "/"), -1).rlike(FILE_NAME)
    got = files.agg(F.min("file").alias("first"), F.bool_and(fits).alias("fit")).first()
    return got["first"] if got["fit"] else None


def _numbers(content: bytes, has_header: bool) -> Iterator[np.ndarray]:
    """The values of a file of one number a line, a piece of the text at a time; without blank lines, comments and a header."""
    stream = gzip.open(io.BytesIO(content)) if content.startswith(b"\x1f\x8b") else io.BytesIO(content)
    rest, piece = b"", b"\n"
    while piece:
        piece = stream.read(CHUNK)
        text, _, rest = (rest + piece).rpartition(b"\n") if piece else (rest, b"", b"")
        if has_header or b"%" in text or b" " in text:
            lines = [x for x in text.splitlines() if x.strip() and not x.startswith(b"%")]
            text, has_header = b"\n".join(lines[1:] if has_header else lines), has_header and not lines
        if text.strip():
            options = csv.ReadOptions(column_names=["val"], use_threads=False, block_size=len(text))
            kinds = csv.ConvertOptions(column_types={"val": pa.float64()}, null_values=[])
            yield csv.read_csv(io.BytesIO(text), options, csv.ParseOptions(quote_char=False), kinds)["val"].to_numpy()


def _cells(spark: SparkSession, path: str, first: str) -> DataFrame:
    """i and val: the values of a dense array in small files and their places. Values are counted by files first; the first file has the header."""
    files = _files(spark, path).filter("length > 0").withColumn("top", F.col("file") == first)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                n = sum(map(len, _numbers(file["content"], file["top"])))
                yield pa.RecordBatch.from_pylist([{"file": file["file"], "n": n}])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                i = file["start"]
                for values in _numbers(file["content"], file["top"]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(values))), pa.array(values)], ["i", "val"])
                    i += len(values)

    sizes = cut(files.select("file", "top", "content").mapInArrow(counted, "file string, n long"))
    starts = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(*BEFORE)), F.lit(0)).alias("start"))
    return files.join(F.broadcast(starts), "file").select("start", "top", "content").mapInArrow(placed, "i long, val double")


def write_matrix_market(matrix: SparseMatrix, path: str, kind: str = "general") -> None:
    """Matrix-Market coordinate text in (row, col) order, in as many files as there are ranges of rows; the first one has the header."""
    head = [(-3, f"{BANNER} matrix coordinate real {kind}"), (-2, "% rows, columns and entries"), (-1, f"{matrix.n_rows} {matrix.n_cols} {matrix.entries.count()}")]
    header = matrix.spark.createDataFrame(head, "row long, value string").select("row", F.lit(0).cast("long").alias("col"), "value")
    body = matrix.entries.select("row", "col", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "val").alias("value"))
    header.unionByName(body).orderBy("row", "col").select("value").write.mode("overwrite").text(path)


def write_matrix_market_array(matrix: SparseMatrix, path: str) -> None:
    """All values by columns, zeros included, as compressed text in as many files as the cells call for; entries of one place are added up.

    Only entries are moved: an entry brings the zeros before it, and the ends of bands of cells bring those after a band's last entry.
    """
    spark, cells = matrix.spark, matrix.n_rows * matrix.n_cols
    bands = parts(cells, BAND)
    each = BAND * parts(bands, in_tasks(spark, cells, CELLS_OF_A_TASK))
    # done: how many cells there are up to and with a row's own; value: null at the ends of bands, which have no cell.
    done, value, at_end = F.col("done"), F.col("value"), F.col("value").isNull()
    there = matrix.entries.select((F.col("col") * matrix.n_rows + F.col("row") + 1).alias("done"), "val").filter(done.between(1, cells))
    there = there.groupBy("done").agg(F.coalesce(F.sum("val"), F.lit(0.0)).cast("string").alias("value"))
    ends = spark.range(bands).select(F.least((F.col("id") + 1) * BAND, F.lit(cells)).alias("done"), F.lit(None).cast("string").alias("value"))
    rows = there.unionByName(ends).withColumn("part", F.floor(F.greatest(done - 1, F.lit(0)) / each))
    before = F.coalesce(F.lag("done").over(Window.partitionBy("part").orderBy(done, at_end)), F.col("part") * each)
    rows = rows.withColumn("zeros", done - before - F.when(at_end, 0).otherwise(1)).filter((F.col("zeros") > 0) | ~at_end)
    head = spark.createDataFrame([(0, f"{BANNER} matrix array real general\n{matrix.n_rows} {matrix.n_cols}", 0, 0)], "done long, value string, part long, zeros long")
    ordered = head.unionByName(rows).repartitionById(parts(cells, each), F.col("part").cast("int")).sortWithinPartitions(done, at_end)
    zeros = F.repeat(F.lit("0\n"), (F.col("zeros") - F.when(at_end, 1).otherwise(0)).cast("int"))
    ordered.select(F.concat(zeros, F.coalesce(value, F.lit("0"))).alias("value")).write.mode("overwrite").text(path, compression="gzip")


def expand_symmetric(entries: DataFrame, sign: float = 1.0) -> DataFrame:
    """Entries with those off the diagonal mirrored, times sign."""
    mirrored = entries.filter("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val"))
    return entries.unionByName(mirrored)


def prepare(matrix: SparseMatrix, values: str = "pattern") -> SparseMatrix:
    """Entries in (row, col) order, values 1 unless "file"; raises for a matrix with empty rows."""
    if matrix.entries.select("row").distinct().count() != matrix.n_rows:
        raise ValueError("the matrix has empty rows")
    entries = matrix.entries.withColumn("val", F.lit(1.0)) if values == "pattern" else matrix.entries
    return matrix.with_entries(entries.orderBy("row", "col"))


def write_coo(matrix: SparseMatrix, path: str) -> None:
    """COO text, 1-based, in (row, col) order, with a header of three numbers."""
    header = matrix.spark.createDataFrame([(-1, -1, f"{matrix.n_rows} {matrix.n_cols} {matrix.entries.count()}")], "row long, col long, value string")
    body = matrix.entries.select("row", "col", F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "val").alias("value"))
    header.unionByName(body).orderBy("row", "col").select("value").write.mode("overwrite").text(path)


def write_layout(tagged: DataFrame, path: str, by: str = "block") -> None:
    """A layout's entries as Parquet, one folder for each block."""
    tagged.write.mode("overwrite").partitionBy(by).parquet(path)


def write_array(values: DataFrame, path: str, kind: str = "long") -> None:
    """(i, a) as text lines in order of i, as values of one type."""
    values.orderBy("i").select(F.concat_ws(" ", "i", F.col("a").cast(kind)).alias("value")).write.mode("overwrite").text(path)


def read_array(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    f = F.split("value", " ")
    return spark.read.text(path).select(f[0].cast("long").alias("i"), f[1].cast(kind).alias("a"))
