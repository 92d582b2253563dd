"""Substring dedup by anchored window hashing, in place of relative Lempel-Ziv parsing.

A window is `WINDOW` consecutive words of one document. Every word covered by a window that also starts
somewhere else in the corpus is removed; windows are judged on the input.

A factor is a stretch of words of which an equal stretch lies elsewhere. Parsing greedily word by word
would need every document to meet every reference block. Instead the places where factors may begin are
chosen by content: a window's anchor is the `ANCHOR`-word gram in it with the least hash, and windows
with equal words have equal anchors, so that a document only has to meet the part of the index that holds
its anchors.

1. Anchors are counted over the corpus; only those found twice can be part of a factor.
2. The stretch of windows that share an anchor is looked up as a whole: when it is found twice, it is a
   factor and its words are a duplicate span.
3. At factor boundaries, that is for anchors with a stretch that is found once, each window is looked up
   by itself.

Counts are made by partial aggregation, and hits return to their rows by joins whose skewed sides Spark
can split, so that no task gets all copies of a passage. The anchors of steps 2 and 3 are broadcast as a
Bloom filter of at most `MOST_BITS` bits: a false hit only adds rows to a count.

Defined results: null or empty texts have no words; texts shorter than a window lose none; repeated rows
are each other's elsewhere. Words and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.near_dedup import BASE, mix
from lattica.llm.text import as_strings, distinct, held, row_key, slices, split_words
from lattica.session import cut

WINDOW, ANCHOR = 35, 8
SLICE_BYTES = 4 << 20
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
PROBES = 2


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out = out * BASE + words[j : j + len(out)]
    return mix(out)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive numbers."""
    out, have = x, 1
    while have * 2 <= n:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (n - have)], out[n - have :]) if n > have else out


class Anchored:
    """Windows and anchors of the texts of a slice."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        self.flat, self.offsets = split_words(texts)
        vocabulary, index = distinct(self.flat)
        items = vocabulary.cast(pa.large_binary()).to_pylist()
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))[index]
        owner = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        if len(words) < window:
            words = owner = np.zeros(0, np.uint64)
        self.whole = rolled(words, window)
        grams = rolled(words, anchor)
        least = sliding_least(grams, window - anchor + 1) if len(self.whole) else grams[:0]
        own = owner[: len(least)].astype(np.int64)
        self.inside = own == owner[window - 1 :] if len(least) else np.zeros(0, bool)
        self.owner, self.anchor, self.grams, self.span = own, least, grams, window - anchor + 1

    def anchors(self) -> np.ndarray:
        """The anchor grams, one for each place."""
        chosen = np.zeros(len(self.grams), bool)
        size = len(self.anchor)
        for j in range(self.span):
            chosen[j : j + size] |= self.inside & (self.grams[j : j + size] == self.anchor)
        return self.grams[chosen]

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and hash of each stretch with one anchor."""
        at = np.flatnonzero(self.inside)
        if not len(at):
            return at, at, self.whole[:0]
        new = np.ones(len(at), bool)
        new[1:] = (self.anchor[at][1:] != self.anchor[at][:-1]) | (self.owner[at][1:] != self.owner[at][:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        total = np.add.reduceat(self.whole[at], first)
        return at[first], n, mix(total + n.astype(np.uint64) * BASE + mix(self.whole[at[first]]))


class Bloom:
    """Bit filter of 64-bit keys."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for probe in range(PROBES):
            bit = (keys >> np.uint64(29 * probe)) & self.mask
            out &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom(keys: DataFrame) -> Bloom:
    """Filter of the column `key`; its bits are set by aggregation, and its size is bounded."""
    n, bits = keys.count(), LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    probes = F.array(*[F.shiftrightunsigned("key", 29 * probe).bitwiseAND(F.lit(bits - 1)) for probe in range(PROBES)])
    bit = keys.select(F.explode(probes).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    table = bit.groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(table["word"], dtype=np.int64)] = np.asarray(table["bits"], dtype=np.int64).view(np.uint64)
    return Bloom(words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _each(rows: DataFrame, fn, schema: str) -> DataFrame:
    """fn(slice's Anchored, its row keys) gives columns; names come from the schema."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = as_strings(batch.column(1)), np.asarray(batch.column(0))
            for a, b in slices(texts, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(fn(texts.slice(a, b - a), keys[a:b]), names)

    return rows.select("row_key", "text").mapInArrow(run, schema)


def duplicate_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """row_key, first and n: stretches of n windows, the first at word `first` of the row, that also start elsewhere."""
    context = rows.sparkSession.sparkContext

    def anchors(texts, keys):
        key, n = np.unique(Anchored(texts, window, anchor).anchors(), return_counts=True)
        return [_signed(key), pa.array(n)]

    counted = _each(rows, anchors, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    repeated = cut(counted.filter("n > 1").select("key"))
    model, name = context.broadcast(bloom(repeated)), uuid.uuid4().hex

    def stretches(texts, keys):
        seen = Anchored(texts, window, anchor)
        first, n, whole = seen.stretches()
        keep = held(name, lambda: model.value).has(seen.anchor[first])
        first, n, whole = first[keep], n[keep], whole[keep]
        own = seen.owner[first]
        return [_signed(seen.anchor[first]), _signed(whole), pa.array(keys[own]), pa.array((first - seen.offsets[own]).astype(np.int32)), pa.array(n.astype(np.int32))]

    found = cut(_each(rows, stretches, "anchor long, whole long, row_key long, first int, n int"))
    times = cut(found.groupBy("anchor", "whole").agg(F.count("*").alias("times")))
    factors = found.join(times.filter("times > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi").select("row_key", "first", "n")
    # A stretch found once is a boundary if its anchor is repeated.
    open_anchors = times.filter("times = 1").select(F.col("anchor").alias("key")).distinct().join(repeated, "key", "left_semi")
    open_model, open_name = context.broadcast(bloom(cut(open_anchors))), uuid.uuid4().hex

    def windows(texts, keys):
        seen = Anchored(texts, window, anchor)
        at = np.flatnonzero(seen.inside)
        at = at[held(open_name, lambda: open_model.value).has(seen.anchor[at])]
        own = seen.owner[at]
        return [_signed(seen.whole[at]), pa.array(keys[own]), pa.array((at - seen.offsets[own]).astype(np.int32))]

    single = _each(rows, windows, "whole long, row_key long, first int")
    twice = single.groupBy("whole").agg(F.count("*").alias("times")).filter("times > 1").select("whole")
    checked = single.join(cut(twice), "whole", "left_semi").select("row_key", "first", F.lit(1).alias("n"))
    return factors.unionByName(checked)


OUT = "struct<n_words: bigint, n_removed: bigint, kept: string>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space), one row for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row_key", row_key("doc_id", "text"))
    spans = duplicate_windows(rows, window, anchor)
    spans = spans.groupBy("row_key").agg(F.collect_set(F.struct("first", "n")).alias("spans"))

    @F.arrow_udf(OUT)
    def cleaned(texts: pa.Array, lists: pa.Array) -> pa.Array:
        texts, sizes, removed, kept = as_strings(texts), [], [], []
        for a, b in slices(texts, SLICE_BYTES):
            flat, offsets = split_words(texts.slice(a, b - a))
            own = lists.slice(a, b - a)
            count = np.asarray(pc.fill_null(pc.list_value_length(own), 0), dtype=np.int64)
            spans = own.flatten()
            first, n = (np.asarray(spans.field(i), dtype=np.int64) for i in (0, 1))
            first = first + np.repeat(offsets[:-1], count)
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + n + window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            lost = np.concatenate(([0], np.cumsum(gone)))[offsets]
            left = pa.ListArray.from_arrays(pa.array(offsets - lost, pa.int32()), flat.filter(pa.array(~gone)))
            sizes += np.diff(offsets).tolist()
            removed += np.diff(lost).tolist()
            kept.append(pc.binary_join(left, pa.scalar(" ", pa.large_string())))
        kept = pa.concat_arrays(kept).cast(pa.string()) if kept else pa.array([], pa.string())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), kept], ["n_words", "n_removed", "kept"])

    return rows.join(spans, "row_key", "left").select("doc_id", cleaned("text", "spans").alias("got")).select("doc_id", "got.*")
