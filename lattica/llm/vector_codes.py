"""Codes of vectors by product quantisation in whole numbers.

A vector's components become whole numbers, floor(4096 x); it is cut into equal parts, and each position of a part has
a codebook of its own. Codebooks begin with the parts of the vectors of the smallest ids; each round assigns every part to
its nearest entry and moves entries to the floor of their parts' mean.

Vectors are kept as columnar blocks: one NumPy array of a row per dimension, a few thousand vectors wide. A round is one
`treeAggregate` over the blocks: distances to all entries accumulate dimension by dimension, `np.add.at` adds a block's
parts to 64-bit sums and counts by position, entry and dimension, and these small tensors merge through a tree of
tasks. Their size follows from the parameters alone, so that the driver gets a few kilobytes whatever the input is.
All arithmetic is on whole numbers: the result does not depend on how vectors are dealt to blocks.

Defined results: rows whose vector is null, or holds a null or a component that is not finite, are dropped, and so are
vectors of another length than that of the kept row with the smallest id, and empty ones. A length that the number of
parts does not divide is a ValueError, and so is a component whose whole number is beyond 2^27, where squares would
overflow. Equal distances go to the lower index. Of equal ids the smaller vector begins a codebook; null ids come last.
With fewer rows than entries, codebooks are as short as there are rows. Repeated rows count one by one, null labels
form one group, other columns are not looked at. Without a kept row the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block, and levels of the tree that sums merge through.
BLOCK, DEPTH = 4096, 2
LARGEST = 1 << 27


@dataclass(frozen=True)
class Codebooks:
    """values: whole numbers by position of the part, entry and dimension in the part."""

    values: np.ndarray

    def sha256(self) -> str:
        """Of all components as decimal numbers, separated by commas, by position, entry and dimension."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def nearest(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part of each vector, and its squared distance; both by position and vector. block: a row per dimension."""
        parts, entries, each = self.values.shape
        codes, least = np.empty((parts, block.shape[1]), np.int64), np.empty((parts, block.shape[1]), np.int64)
        for p in range(parts):
            distance = np.zeros((entries, block.shape[1]), np.int64)
            for j in range(each):
                apart = block[p * each + j] - self.values[p, :, j, None]
                distance += apart * apart
            codes[p] = distance.argmin(axis=0)  # the first one of equal distances
            least[p] = distance[codes[p], np.arange(block.shape[1])]
        return codes, least

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        mean = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None])
        return Codebooks(np.where(counts[:, :, None] > 0, mean, self.values))


def whole_numbers(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """A row per dimension, a column per vector; all vectors have that many finite components."""
    flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component's whole number is beyond {LARGEST}")
    return np.ascontiguousarray(flat.astype(np.int64).reshape(-1, dimensions).T)


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is there, not empty, and finite throughout."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))


def blocks(rows: DataFrame, vec_col: str, dimensions: int) -> DataFrame:
    """Columnar blocks of the vectors, as bytes of 32-bit whole numbers, computed once and kept in the shared folder."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                block = whole_numbers(batch.column(0).slice(a, BLOCK), dimensions)
                yield pa.RecordBatch.from_arrays([pa.array([block.astype("<i4").tobytes()], pa.binary())], ["block"])

    return cut(rows.select(vec_col).mapInArrow(packed, "block binary"))


def first_codebooks(rows: DataFrame, id_col: str, vec_col: str, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; vectors of another length than the first one's are left out."""
    order = (F.col(id_col).asc_nulls_last(), F.col(vec_col))
    first = rows.orderBy(*order).select(F.size(vec_col)).first()
    if first is None:
        return None
    dimensions = first[0]
    if dimensions % parts:
        raise ValueError(f"{parts} parts do not divide {dimensions} dimensions")
    top = rows.filter(F.size(vec_col) == dimensions).orderBy(*order).select(vec_col).limit(entries).collect()
    values = whole_numbers(pa.array([r[0] for r in top], pa.list_(pa.float64())), dimensions)
    return Codebooks(values.reshape(parts, dimensions // parts, len(top)).transpose(0, 2, 1).copy())


def _tensors(books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(books.values.shape, np.int64), np.zeros(books.values.shape[:2], np.int64)


def improved(kept: DataFrame, books: Codebooks, depth: int = DEPTH) -> Codebooks:
    """Codebooks after one round over all blocks."""
    parts, _, each = books.values.shape

    def add(held: tuple | None, row) -> tuple:
        sums, counts = held or _tensors(books)
        block = np.frombuffer(row[0], "<i4").reshape(parts * each, -1).astype(np.int64)
        codes, _ = books.nearest(block)
        for p in range(parts):
            np.add.at(counts[p], codes[p], 1)
            for j in range(each):
                np.add.at(sums[p, :, j], codes[p], block[p * each + j])
        return sums, counts

    def merge(one: tuple | None, two: tuple | None) -> tuple | None:
        if one is None or two is None:
            return one or two
        return one[0] + two[0], one[1] + two[1]

    sums, counts = kept.rdd.treeAggregate(None, add, merge, depth)
    return books.moved(sums, counts)


def fit(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after all rounds; None without a usable row. rows: those of usable()."""
    books = first_codebooks(rows, id_col, vec_col, parts, entries)
    if books is None or not rounds:
        return books
    dimensions = books.values.shape[0] * books.values.shape[2]
    kept = blocks(rows.filter(F.size(vec_col) == dimensions), vec_col, dimensions)
    for _ in range(rounds):
        books = improved(kept, books)
    return books


def encode(rows: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, codes (an entry number for each part) and error (the squared distances, summed) of each usable vector of the codebooks' length."""
    dimensions = books.values.shape[0] * books.values.shape[2]
    own = rows.filter(F.size(vec_col) == dimensions).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                codes, error = books.nearest(whole_numbers(part.column(2), dimensions))
                flat = np.ascontiguousarray(codes.T).astype(np.int32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, codes.shape[0], dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(error.sum(axis=0))], ["vec_id", "label", "codes", "error"])

    kinds = [own.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return own.mapInArrow(coded, f"vec_id {kinds[0]}, label {kinds[1]}, codes array<int>, error bigint")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with `whole`: the whole numbers of the entries that the codes name."""
    dimensions = books.values.shape[2]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.asarray(batch.column(batch.schema.get_field_index("codes")).flatten()).reshape(batch.num_rows, -1)
            flat = books.values[np.arange(codes.shape[1]), codes].ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, codes.shape[1] * dimensions, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "whole"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(looked_up, f"{fields}, whole array<bigint>")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error (summed over equal labels) and codebooks_sha256."""
    rows = usable(vectors.select(id_col, vec_col, label_col), vec_col)
    books = fit(rows, id_col, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = cut(encode(rows, books, id_col, vec_col, label_col))
    # Labels may be as many as rows, and one may hold a third of them: summed where they lie first, then joined.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return both.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
