"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, which one pass over the texts deals out by a hash of the text. A batch's line keys
are counted (each once for a document), the keys that are settled already are taken away by a merge anti-join with
each settled run, and the rest becomes a sorted run of (128-bit hash, documents) at level 0. When a level
holds `fanout` runs they are compacted into one run of the next level; keys that have reached `min_docs`
documents leave it as a settled run, and settled runs are compacted in the same way. After the last batch all levels are compacted,
and the settled runs hold just the keys to drop. Runs are hash-partitioned by key into partitions of about
`RUN_ROWS` keys, sorted within partitions and kept in the shared folder.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case.

Defined results: a null or empty text is one empty line; keys under `min_chars` code points are
never dropped; each row counts as a document, so that repeated rows count again; a text that loses
all lines is the empty text.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import as_strings, distinct, held, let_go, slices
from lattica.session import cut, parts, shared_dir

KEY = ["h1", "h2"]
#: Settled keys up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
RUN_ROWS = 500_000
BATCHES, FANOUT = 6, 2


def line_hashes(texts: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of the texts, where each text's begin, each line's 128-bit hash as two columns, and which can be dropped."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    keys, index = distinct(pc.ascii_lower(pc.ascii_trim_whitespace(lines)))
    digest = b"".join(map(xxhash.xxh3_128_digest, keys.cast(pa.large_binary()).to_pylist()))
    pairs = np.frombuffer(digest, dtype="<i8").reshape(-1, 2)
    long = np.asarray(pc.utf8_length(keys)) >= max(1, min_chars)
    return lines, offsets - offsets[0], pairs[index], long[index]


COUNTS = "h1 long, h2 long, n long, batch int"


def batch_keys(docs: DataFrame, text_col: str, min_chars: int, batch: Column | None = None) -> DataFrame:
    """h1, h2, n (the documents that hold each key, with counts of byte-balanced pieces still apart) and batch."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for rows in batches:
            texts, dealt = as_strings(rows.column(0)), np.asarray(rows.column(1), dtype=np.int64)
            for a, b in slices(texts):
                _, offsets, pairs, long = line_hashes(texts.slice(a, b - a), min_chars)
                owner = np.repeat(np.arange(b - a), np.diff(offsets))[long]
                pairs = np.column_stack((pairs[long], dealt[a:b][owner]))
                order = np.lexsort((owner, pairs[:, 2], pairs[:, 1], pairs[:, 0]))
                pairs, owner = pairs[order], owner[order]
                new_key = np.ones(len(pairs), bool)
                new_key[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
                new = new_key.copy()
                new[1:] |= owner[1:] != owner[:-1]
                starts = np.flatnonzero(new_key)
                counts = np.add.reduceat(new.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
                columns = pairs[starts, 0], pairs[starts, 1], counts, pairs[starts, 2].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "n", "batch"])

    return docs.select(F.col(text_col), (F.lit(0) if batch is None else batch).cast("int")).mapInArrow(keys, COUNTS)


def dealt_keys(docs: DataFrame, batches: int, text_col: str, min_chars: int) -> tuple[list[DataFrame], int]:
    """The keys of each batch, written to the shared folder in one pass, and their number."""
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/line-keys-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(text_col), F.lit(batches))
    batch_keys(docs, text_col, min_chars, part).write.partitionBy("batch").parquet(path)
    kept = spark.read.schema(COUNTS).parquet(path)
    return [kept.filter(F.col("batch") == i).select(*KEY, "n") for i in range(batches)], kept.count()


class LineRuns:
    """Sorted runs of line keys by level, and the settled runs."""

    def __init__(self, spark, min_docs: int, fanout: int = FANOUT, partitions: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def _run(self, rows: DataFrame, *counted: Column) -> DataFrame:
        dealt = rows.repartition(self.partitions, *KEY)  # the aggregation and the merge joins keep this partitioning
        return cut(dealt.groupBy(*KEY).agg(*counted).sortWithinPartitions(*KEY) if counted else dealt.dropDuplicates(KEY).sortWithinPartitions(*KEY))

    def _summed(self, rows: DataFrame) -> DataFrame:
        return self._run(rows.groupBy(*KEY).agg(F.sum("n").alias("n")), F.sum("n").alias("n"))

    def _without(self, keys: DataFrame, runs: Sequence[DataFrame]) -> DataFrame:
        for run in runs:
            keys = keys.join(run.hint("merge"), KEY, "left_anti")
        return keys

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows whose key no earlier batch had."""
        return self._without(keys, [*self.settled, *(r for level in self.levels for r in level)])

    def add(self, counts: DataFrame) -> None:
        """Takes in a batch's counts; compacts the levels that are full."""
        self.levels[0].append(self._summed(self._without(counts, self.settled)))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def _compact(self, level: int) -> None:
        merged = self._summed(functools.reduce(DataFrame.unionByName, self.levels[level]))
        self.levels[level] = []
        if len(self.levels) == level + 1:
            self.levels.append([])
        over = F.col("n") >= self.min_docs
        # A key that is split over levels settles when these meet; no count is lost before.
        self.settled.append(merged.filter(over).select(*KEY))
        if len(self.settled) > self.fanout:
            self.settled = [self._run(functools.reduce(DataFrame.unionByName, self.settled))]
        self.levels[level + 1].append(merged.filter(~over))

    def finish(self) -> DataFrame:
        """Compacts everything; the keys to drop."""
        rest = [r for level in self.levels for r in level]
        if len(rest) > 1 or self.levels[0]:
            self.levels = [rest]
            self._compact(0)
        if not self.settled:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self.settled[0] if len(self.settled) == 1 else self._run(functools.reduce(DataFrame.unionByName, self.settled))


def _dropped(texts: pa.Array, min_chars: int, drop) -> tuple[list[int], list[int], pa.Array]:
    """Lines before dropping, lines dropped and the text left, of each text. drop: from hashes to a mask."""
    lines, offsets, pairs, long = line_hashes(texts, min_chars)
    gone = long & drop(pairs)
    lost = np.concatenate(([0], np.cumsum(gone)))[offsets]
    left = offsets - lost
    lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), lines.filter(pa.array(~gone)))
    return np.diff(offsets).tolist(), np.diff(lost).tolist(), pc.binary_join(lists, pa.scalar("\n", pa.large_string()))


def _member(table: np.ndarray):
    """Mask of the pairs that are in a sorted table of pairs."""
    first = np.ascontiguousarray(table[:, 0])

    def inside(pairs: np.ndarray) -> np.ndarray:
        found = np.zeros(len(pairs), bool)
        if len(table):
            at = np.searchsorted(first, pairs[:, 0])
            live = np.flatnonzero((at < len(first)) & (first[np.minimum(at, len(first) - 1)] == pairs[:, 0]))
            while len(live):  # equal first halves lie side by side
                spot = at[live]
                found[live] |= table[spot, 1] == pairs[live, 1]
                at[live] += 1
                more = (at[live] < len(first)) & ~found[live]
                live = live[more]
                live = live[first[at[live]] == pairs[live, 0]]
        return found

    return inside


OUT = "struct<n_lines bigint, n_dropped bigint, kept string>"


def _result(n: list[int], k: list[int], kept: list[pa.Array]) -> pa.Array:
    texts = pa.concat_arrays(kept).cast(pa.string()) if kept else pa.array([], pa.string())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(k, pa.int64()), texts], ["n_lines", "n_dropped", "kept"])


def drop_lines(docs: DataFrame, settled: DataFrame, into: str, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """docs with a column `into`: struct of n_lines, n_dropped and kept (the lines left, joined by line ends)."""
    if settled.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        table = settled.toArrow()
        pairs = np.stack([np.asarray(table[c], dtype=np.int64) for c in KEY], axis=1)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        keys, name = docs.sparkSession.sparkContext.broadcast(pairs), uuid.uuid4().hex

        @F.arrow_udf(OUT)
        def dropped(texts: pa.Array) -> pa.Array:
            drop, n, k, kept = held(name, lambda: _member(keys.value)), [], [], []
            texts = as_strings(texts)
            for a, b in slices(texts):
                x, y, z = _dropped(texts.slice(a, b - a), min_chars, drop)
                n, k, kept = n + x, k + y, [*kept, z]
            return _result(n, k, kept)

        return docs.withColumn(into, dropped(F.col(text_col)))
    return _drop_by_shuffle(docs, settled, into, text_col, min_chars)


def _drop_by_shuffle(docs: DataFrame, settled: DataFrame, into: str, text_col: str, min_chars: int) -> DataFrame:
    """The same for any number of keys: hashes of lines are joined with the settled run, hits go back to their texts."""

    @F.arrow_udf("array<struct<h1: bigint, h2: bigint, at: int>>")
    def hashes(texts: pa.Array) -> pa.Array:
        texts, out = as_strings(texts), []
        for a, b in slices(texts):
            _, offsets, pairs, long = line_hashes(texts.slice(a, b - a), min_chars)
            for i in range(b - a):
                rows = np.flatnonzero(long[offsets[i] : offsets[i + 1]])
                out.append([{"h1": int(pairs[offsets[i] + r, 0]), "h2": int(pairs[offsets[i] + r, 1]), "at": int(r)} for r in rows])
        return pa.array(out, pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32())])))

    @F.arrow_udf(OUT)
    def dropped(texts: pa.Array, hits: pa.Array) -> pa.Array:
        texts, n, k, kept = as_strings(texts), [], [], []
        for text, gone in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
            lines, gone = text.split("\n"), set(gone or ())
            n.append(len(lines))
            k.append(len(gone))
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
        return _result(n, k, [pa.array(kept, pa.large_string())])

    name = F.struct(F.xxhash64(text_col).alias("col1"), F.xxhash64(F.lit(1), text_col).alias("col2"))  # equal texts lose equal lines
    lines = docs.select(name.alias("text_key"), F.col(text_col).alias("t")).dropDuplicates(["text_key"])
    lines = lines.select("text_key", F.explode(hashes("t")).alias("line")).select("text_key", "line.*")
    hits = lines.join(settled, KEY, "left_semi").groupBy("text_key").agg(F.collect_set("at").alias("hits"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), name.alias("text_key")).join(hits, "text_key", "left")
    return keyed.select("row.*", dropped(F.col(f"row.{text_col}"), F.col("hits")).alias(into))


def settled_keys(batches: Sequence[DataFrame], min_docs: int, fanout: int = FANOUT, partitions: int | None = None) -> DataFrame:
    """Keys (h1, h2) of lines found in at least `min_docs` documents of all batches of counts."""
    runs = LineRuns(batches[0].sparkSession, min_docs, fanout, partitions)
    for counts in batches:
        runs.add(counts)
    return runs.finish()


def line_dedup(
    docs: DataFrame, into: str, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, text_col: str = "text"
) -> DataFrame:
    """docs with the struct column of drop_lines(); the batches are dealt by a hash of the text."""
    counts, rows = dealt_keys(docs, batches, text_col, min_chars)
    settled = settled_keys(counts, min_docs, partitions=parts(rows, RUN_ROWS))
    return drop_lines(docs, settled, into, text_col, min_chars)


def first_lines(batches: Sequence[DataFrame], text_col: str = "text") -> list[DataFrame]:
    """For each batch the keys (h1, h2) that no earlier batch had: exact line dedup of a growing corpus."""
    runs, out = LineRuns(batches[0].sparkSession, 1 << 62), []
    for batch in batches:
        keys = batch_keys(batch, text_col, 1).groupBy(*KEY).agg(F.sum("n").alias("n"))
        out.append(cut(runs.unseen(keys).select(*KEY)))
        runs.add(keys)
    return out
