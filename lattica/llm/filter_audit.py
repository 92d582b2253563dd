"""What each filter of a chain removes under every order of the filters, by part of the corpus and by label.

Each document fails a set of filters, its mask. A table that is made once holds, for every mask and every order of the
filters, the step at which the first failure comes (32 masks by 120 orders for five filters; a mask without failures
has the step after the last one). Tasks look masks up in it and count the steps by part, order and label with
`np.bincount`; their arrays are summed by part and place. All columns of the report follow from these sums:

* a filter's failures are what it removes where it comes first, its sole failures what it removes where it comes last;
* what it fails and another one has removed before is the difference to the failures.

The five filters of `failures`: A few words, B few different words, C many capitals, D symbols, E the text of a smaller id.

Defined results: a null text is the empty text, a null part the empty string. A null id is neither smaller than an id nor
has it a smaller one; rows of the same id and text do not fail E by one another. A document is labelled if any label
row of its id says so; labels of null ids are not used. Repeated rows count one by one. Without rows there is no part.
Columns of the input that are not named are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.text import as_strings, distinct, slices, split_words
from lattica.session import cut

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 100, 80, 10
SYMBOLS = "#$%&*|"
#: All rows, and those with each label.
COUNTS = ("removed", "good", "toxic")
SLICE_BYTES = 4 << 20
#: Rows whose steps are looked up at once, and parts whose arrays a task holds before it sends them on.
ROWS, PARTS = 4096, 512


def orders(filters: str = FILTERS) -> list[str]:
    """All orders of the filters, in lexicographic order of their places."""
    return ["".join(x) for x in itertools.permutations(filters)]


def first_failures(filters: str = FILTERS) -> np.ndarray:
    """The 0-based step of the first failure for each mask (bit i: fails filter i) and order; the number of filters for none."""
    ranked = np.array(list(itertools.permutations(range(len(filters)))))
    fails = (np.arange(1 << len(filters))[:, None, None] >> ranked[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), len(filters))


# The masks of documents


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3, filters A to D, of each text."""
    flat, offsets = split_words(texts)
    n_words = np.diff(offsets)
    _, index = distinct(flat)
    owner = np.repeat(np.arange(len(texts)), n_words)
    width = int(index.max(initial=0)) + 1
    n_distinct = np.bincount(np.unique(owner * width + index) // width, minlength=len(texts))
    begins = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    body = np.frombuffer(raw, np.uint8)[begins[0] : begins[-1]] if raw is not None else np.zeros(0, np.uint8)
    # Capitals in the low half of a sum, symbols in the high one.
    weight = np.zeros(256, np.int64)
    weight[ord("A") : ord("Z") + 1] = 1
    weight[[ord(c) for c in SYMBOLS]] = 1 << 32
    sums = np.concatenate(([0], np.cumsum(weight[body])))[begins - begins[0]]
    each = np.diff(sums)
    points = np.asarray(pc.utf8_length(texts), dtype=np.int64)
    fails = (n_words < LEAST_WORDS, 100 * n_distinct < LEAST_DISTINCT * n_words, 100 * (each & 0xFFFFFFFF) > MOST_UPPER * points, each >> 32 > 0)
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and mask of every document. Texts are read once; what is kept of them is a digest of 128 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int"

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(3))
            for a, b in slices(texts, SLICE_BYTES):
                mask = text_masks(texts.slice(a, b - a)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(mask, pa.int32())], ["doc_id", "part", "digest", "mask"])

    kept = cut(rows.mapInArrow(masks, schema))
    copies = kept.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null").select("digest", "least")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return kept.join(copies, "digest", "left").select("doc_id", "part", (F.col("mask") + later * 16).alias("mask"))


# The report


def _steps(table: np.ndarray, kinds: int) -> Callable:
    """mapInArrow function: (part, mask, label...) rows to part, place and count of steps by kind, order and step."""
    n_orders, n_steps = table.shape[1], int(table.max()) + 1
    places = np.arange(n_orders, dtype=np.int64) * n_steps + table  # the cell of each mask and order

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for part, cells in sums.items():
                cells = cells.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(cells), pa.string()), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["part", "place", "n"])
            sums.clear()

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes, mask = np.asarray(coded.indices), np.asarray(batch.column(1))
            labels = [np.ones(len(mask), bool), *(np.asarray(batch.column(2 + i).fill_null(False)) for i in range(kinds - 1))]
            for code, part in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                cells = sums.setdefault(part, np.zeros((kinds, n_orders * n_steps), np.int64))
                for a in range(0, len(own), ROWS):
                    rows = own[a : a + ROWS]
                    for kind, label in enumerate(labels):
                        cells[kind] += np.bincount(places[mask[rows[label[rows]]]].ravel(), minlength=n_orders * n_steps)
                if len(sums) > PARTS:
                    yield from out()
        yield from out()

    return counted


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of the report. masks: part, mask, good and toxic of every document."""
    table, names = first_failures(filters), orders(filters)
    k, n = len(filters), len(filters) + 1
    cells = masks.select("part", "mask", "good", "toxic").mapInArrow(_steps(table, len(COUNTS)), "part string, place int, n long")
    sums = cells.groupBy("part", "place").agg(F.sum("n").alias("n"))
    # A place is a kind, then an order, then a step.
    at = F.col("place") % (len(names) * n)
    kind, order, step = F.floor(F.col("place") / (len(names) * n)), F.floor(at / n), at % n
    by_step = sums.groupBy("part", order.cast("int").alias("order"), step.cast("int").alias("step")).agg(*[F.sum(F.when(kind == i, F.col("n"))).alias(c) for i, c in enumerate(COUNTS)])
    named = F.array(*[F.lit(x) for x in names])[F.col("order")]
    by_step = by_step.withColumn("filter_order", named).withColumn("filter", F.expr("substring(filter_order, step + 1, 1)"))
    chain = Window.partitionBy("part", "order").orderBy("step")
    later = chain.rowsBetween(1, Window.unboundedFollowing)
    alike = Window.partitionBy("part", "filter")
    full = by_step.withColumn("kept", F.coalesce(F.sum("removed").over(later), F.lit(0))).filter(F.col("step") < k)
    full = full.withColumns({
        "fails": F.max(F.when(F.col("step") == 0, F.col("removed"))).over(alike),
        "unique_fails": F.max(F.when(F.col("step") == k - 1, F.col("removed"))).over(alike),
        "shapley": F.sum("removed").over(alike),
    })
    return full.select(
        "part", "filter_order", (F.col("step") + 1).alias("step"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The report on the five filters. labels: doc_id, quality and toxic."""
    own = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(failures(docs, id_col, text_col, part_col).join(own, "doc_id", "left"))
