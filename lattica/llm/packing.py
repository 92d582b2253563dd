"""Packing token sequences by cutting-stock column generation.

A document's ids are cut into full sequences and a rest. How rests fill sequences depends on their lengths alone, so that
the problem is one over a histogram of at most `size` - 1 lengths, whatever the number of documents. A pattern is a
multiset of lengths whose sum is exactly `size`. The linear program asks for as many full patterns as the histogram
holds; it starts with no pattern at all, and a knapsack by dynamic programming over all sums prices new ones with the
program's dual values (for every length, the best pattern that holds it) until none gains or the gap to the bound is
small. Numbers of patterns are rounded down, then up while documents last, and what is left is tried once more by the
same knapsack.

Rests are ranked within their length over all executors, and a pattern takes consecutive ranks of each of its lengths,
so that a document's place follows from its length and rank by a look-up in a table whose size the parameters bound.
Documents that no pattern takes are laid end to end, in order of length and rank, and cut at every `size` ids; the last
ids fill sequences of powers of two. So no sequence is padded. The checksums of pieces are taken where the text is
encoded; only documents that are cut in the last step are encoded a second time.

Defined results: a null text is the empty text, which is its end id alone. Repeated rows, also of one id, are packed one by
one; equal rows change places freely. Without rows the result is empty. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.text import as_strings, held, slices
from lattica.llm.token_ids import MODEL, WordEncoder
from lattica.session import cut, parts

SIZE, END = 2048, 1
SLICE_BYTES = 12 << 20
#: Rows of a length that are ranked in one group.
BIN_ROWS = 50_000
#: Wanted pieces (at most 40 bytes each) up to which they are broadcast.
MOST_BROADCAST = 200_000
#: The share of the bound that the linear program may stay below, its most pivots, and knapsacks after it.
GAP, PIVOTS, EXTRA = 0.002, 4500, 400
#: What an item costs besides its dual value: of equal patterns the one with fewer items.
ITEM = 1e-7


# The linear program


class Knapsack:
    """Least cost of every sum from 0 to `size`, each length at most `most` times."""

    def __init__(self, lengths: np.ndarray, most: np.ndarray, cost: np.ndarray, size: int):
        self.items: list[tuple[int, int]] = []
        for i in np.argsort(-lengths, kind="stable").tolist():  # longer ones first
            left, n = min(int(most[i]), size // int(lengths[i])), 1
            while left > 0:
                self.items.append((i, min(n, left)))
                left, n = left - n, 2 * n
        self.lengths, self.most, self.size = lengths, most, size
        self.best = np.full(size + 1, np.inf)
        self.best[0] = 0.0
        self.takes = np.zeros((len(self.items), size + 1), bool)
        for k, (i, n) in enumerate(self.items):
            w = int(lengths[i]) * n
            new = self.best[: size + 1 - w] + (cost[i] + ITEM) * n
            np.less(new, self.best[w:], out=self.takes[k, w:])
            np.minimum(self.best[w:], new, out=self.best[w:])
        self.taken = np.flatnonzero(self.takes.any(axis=1))[::-1].tolist()

    def pattern(self, total: int) -> dict[int, int]:
        """Which lengths, by index, make up the sum, and how often."""
        found: dict[int, int] = {}
        for k in self.taken:
            if not total:
                break
            if self.takes[k, total]:
                i, n = self.items[k]
                found[i] = found.get(i, 0) + n
                total -= n * int(self.lengths[i])
        return found

    def full(self, cost: np.ndarray, below: float, every: bool) -> Iterator[dict[int, int]]:
        """Full patterns that cost less than `below`: the best one, and for each length the best one with one more of it."""
        if self.best[self.size] < below:
            yield self.pattern(self.size)
        if every:
            near = self.best[self.size - self.lengths] + cost
            for i in np.argsort(near, kind="stable")[:EVERY].tolist():
                if near[i] < below:
                    found = self.pattern(self.size - int(self.lengths[i]))
                    found[i] = found.get(i, 0) + 1
                    if found[i] <= self.most[i]:
                        yield found


#: Patterns that one knapsack gives.
EVERY = 200


class FullPatterns:
    """max sum(x) over full patterns, with no more of a length than there are: revised simplex over priced columns."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, size: int):
        self.lengths, self.counts, self.size = lengths, counts.astype(np.float64), size
        m = len(lengths)
        self.inverse, self.basis, self.x, self.y = np.eye(m), [None] * m, self.counts.copy(), np.zeros(m)
        self.value, self.pool, self.seen = 0.0, [], set()
        self.index, self.number = np.zeros((0, 0), np.int64), np.zeros((0, 0))

    def _add(self, found: Iterator[dict[int, int]]) -> int:
        before = len(self.pool)
        for p in found:
            if (key := tuple(sorted(p.items()))) not in self.seen:
                self.seen.add(key)
                self.pool.append((np.array(list(p), np.int64), np.array(list(p.values()), np.float64)))
        if len(self.pool) > before:
            width = max(len(i) for i, _ in self.pool)
            self.index, self.number = np.zeros((len(self.pool), width), np.int64), np.zeros((len(self.pool), width))
            for k, (i, n) in enumerate(self.pool):
                self.index[k, : len(i)], self.number[k, : len(i)] = i, n
        return len(self.pool) - before

    def _gains(self) -> np.ndarray:
        return 1.0 - (self.y[self.index] * self.number).sum(axis=1) if len(self.pool) else np.zeros(0)

    def _pivot(self, column: int, gain: float) -> None:
        i, n = self.pool[column]
        u = self.inverse[:, i] @ n
        up = np.flatnonzero(u > 1e-9)
        ratio = np.maximum(self.x[up], 0.0) / u[up]
        step = ratio.min()
        tied = up[ratio <= step + 1e-12]
        r = int(tied[np.argmax(u[tied])])
        row = self.inverse[r] / u[r]
        self.x -= step * u
        self.x[r] = step
        u[r] = 0.0
        rows, cols = np.flatnonzero(u), np.flatnonzero(row)
        self.inverse[np.ix_(rows, cols)] -= np.outer(u[rows], row[cols])
        self.inverse[r] = row
        self.y += gain * row
        self.basis[r] = column
        self.value += step * gain

    def solve(self, gap: float = GAP, pivots: int = PIVOTS) -> list[tuple[dict[int, int], float]]:
        """Patterns and how often each is used, in fractions."""
        bound = float(self.lengths @ self.counts) / self.size
        most = np.minimum(self.counts, self.size // self.lengths).astype(np.int64)
        for _ in range(pivots):
            gains = self._gains()
            if not len(gains) or gains.max() <= 1e-7:
                cost = np.maximum(self.y, 0.0)
                sack = Knapsack(self.lengths, most, cost, self.size)
                least = sack.best[self.size]
                if np.isfinite(least) and cost.any():
                    bound = min(bound, float(self.counts @ cost) / min(1.0, least))
                if self.value >= (1.0 - gap) * bound or not self._add(sack.full(cost, 1.0 - 1e-6, True)):
                    break
                gains = self._gains()
                if gains.max() <= 1e-7:
                    break
            best = int(gains.argmax())
            self._pivot(best, float(gains[best]))
        used = [(c, float(x)) for c, x in zip(self.basis, self.x, strict=True) if c is not None and x > 1e-9]
        return [({int(i): int(n) for i, n in zip(*self.pool[c], strict=True)}, x) for c, x in used]


def full_patterns(histogram: dict[int, int], size: int, gap: float = GAP, pivots: int = PIVOTS, extra: int = EXTRA) -> list[tuple[dict[int, int], int]]:
    """Patterns (times by length, their sum is `size`) and how often each is used; no length is used more often than it is there."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0 and k < size), np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    used: dict[tuple, int] = {}
    if not len(lengths):
        return []
    left = counts.copy()

    def take(pattern: dict[int, int], most: int) -> None:
        i, n = np.array(list(pattern)), np.array(list(pattern.values()))
        times = min(most, int((left[i] // n).min()))
        if times > 0:
            left[i] -= n * times
            key = tuple(sorted((int(lengths[k]), v) for k, v in pattern.items()))
            used[key] = used.get(key, 0) + times

    solved = FullPatterns(lengths, counts, size).solve(gap, pivots)
    for pattern, x in solved:
        take(pattern, int(x + 1e-6))
    for pattern, _ in sorted(solved, key=lambda p: int(p[1]) - p[1]):
        take(pattern, 1)
    for _ in range(extra):
        there = np.flatnonzero(left)
        if not len(there):
            break
        sack = Knapsack(lengths[there], left[there], np.zeros(len(there)), size)
        if not np.isfinite(sack.best[size]):
            break
        found = sack.pattern(size)
        take({int(there[k]): n for k, n in found.items()}, int(left.max()))
    return [(dict(k), n) for k, n in used.items()]


# Places of ranked documents


@dataclass(frozen=True)
class Layout:
    """Where the piece of each length and rank lies.

    Ranges of ranks, sorted by key (length, first rank): last, times (in one sequence), sequence (of the first rank) and
    offset. `taken` and `begin` by length: ranks that patterns take, and where the others begin in the chain.
    """

    size: int
    keys: np.ndarray
    last: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    taken: np.ndarray
    begin: np.ndarray
    chain: int
    edges: np.ndarray

    RANK_BITS = 44

    @staticmethod
    def of(histogram: dict[int, int], patterns: list[tuple[dict[int, int], int]], size: int) -> Layout:
        taken, ranges, sequence = np.zeros(size + 1, np.int64), [], 0
        for pattern, n in [({size: 1}, histogram.get(size, 0)), *patterns]:
            at = 0
            for length, times in sorted(pattern.items(), reverse=True):
                if n:
                    ranges.append(((length << Layout.RANK_BITS) + int(taken[length]), int(taken[length]) + times * n, times, sequence, at))
                    taken[length] += times * n
                at += times * length
            sequence += n
        counts = np.array([histogram.get(k, 0) for k in range(size + 1)], np.int64)
        rest = (counts - taken) * np.arange(size + 1)
        total = int(rest.sum())
        # The chain's sequences: full ones, then a power of two for each bit of what is left.
        bits = [1 << b for b in range(size.bit_length(), -1, -1) if total % size >> b & 1]
        edges = total // size * size + np.concatenate(([0], np.cumsum(bits))).astype(np.int64)
        columns = [np.array(c, np.int64) for c in zip(*sorted(ranges), strict=True)] if ranges else [np.zeros(0, np.int64)] * 5
        return Layout(size, *columns, taken, np.cumsum(rest) - rest, sequence, edges)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start (in the piece), length, sequence and offset of the pieces that the given ones are laid out in."""
        at = np.searchsorted(self.keys, (length << self.RANK_BITS) + rank, "right") - 1
        free = rank >= self.taken[length]
        rows = np.flatnonzero(~free)
        at, k = at[rows], rank[rows] - (self.keys[at[rows]] & ((1 << self.RANK_BITS) - 1))
        whole = rows, np.zeros(len(rows), np.int64), length[rows], self.sequence[at] + k // self.times[at], self.offset[at] + k % self.times[at] * length[rows]
        rows = np.flatnonzero(free)
        n = length[rows]
        begin = self.begin[n] + (rank[rows] - self.taken[n]) * n
        # Cuts strictly inside: multiples of the size up to the tail, then the tail's edges.
        body = int(self.edges[0])
        cut_rows = [np.arange(len(rows))]
        cut_at = [begin]
        inside = np.maximum((np.minimum(begin + n - 1, body) // self.size) - begin // self.size, 0)
        cut_rows.append(np.repeat(np.arange(len(rows)), inside))
        nth = np.arange(len(cut_rows[1])) - np.repeat(np.cumsum(inside) - inside, inside) + 1
        cut_at.append((begin[cut_rows[1]] // self.size + nth) * self.size)
        for edge in self.edges[1:-1].tolist():
            own = np.flatnonzero((begin < edge) & (edge < begin + n))
            cut_rows.append(own)
            cut_at.append(np.full(len(own), edge))
        row, start = np.concatenate(cut_rows), np.concatenate(cut_at).astype(np.int64)
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        stop = np.where(np.append(row[1:] == row[:-1], False), np.append(start[1:], 0), begin[row] + n[row]) if len(row) else start
        tail = np.searchsorted(self.edges, start, "right") - 1
        in_tail = start >= body
        sequence = self.chain + np.where(in_tail, body // self.size + tail, start // self.size)
        offset = np.where(in_tail, start - self.edges[np.maximum(tail, 0)], start % self.size)
        chained = rows[row], start - begin[row], stop - start, sequence, offset
        return tuple(np.concatenate(x) for x in zip(whole, chained, strict=True))


# Spark


def _digest(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _crc(ids: memoryview, a: int, b: int, n: int, end: bytes) -> int:
    """Checksum of the ids a to b of a document of n ids, the last of which is the end id."""
    return zlib.crc32(end, zlib.crc32(ids[4 * a : 4 * (b - 1)])) if b == n else zlib.crc32(ids[4 * a : 4 * b])


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), start, length, crc and doc_tokens: full sequences of every document, and its rest."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, last = rows.schema["doc_id"].dataType.simpleString(), np.array([end], "<u4").tobytes()
    names = ["doc_id", "digest", "start", "length", "crc", "doc_tokens"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("ids", model), lambda: WordEncoder(model))
        for batch in batches:
            texts = as_strings(batch.column(2))
            for a, b in slices(texts, SLICE_BYTES):
                ids, starts = encoder.encode(texts.slice(a, b - a))
                raw = memoryview(np.ascontiguousarray(ids)).cast("B") if len(ids) else memoryview(b"")
                n = np.diff(starts) + 1
                each = -(-n // size)
                row = np.repeat(np.arange(b - a), each)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * size
                stop = np.minimum(start + size, n[row])
                crc = [_crc(raw[4 * starts[r] : 4 * starts[r + 1]], i, j, k, last) for r, i, j, k in zip(row.tolist(), start.tolist(), stop.tolist(), n[row].tolist(), strict=True)]
                of = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64()), pa.array(n[row])], names)

    return rows.mapInArrow(encoded, f"doc_id {kind}, digest binary, start bigint, length bigint, crc bigint, doc_tokens bigint")


def ranked(rows: DataFrame, bins: int) -> DataFrame:
    """rows with rank: gapless from 0 within each length. Equal rows are counted first; a length is numbered in bins."""
    own = rows.columns
    rows = rows.withColumn("bin", F.pmod(F.xxhash64(F.lit(7), F.col("doc_id").cast("string"), "digest", "start"), F.lit(bins)).cast("int"))
    different = rows.groupBy(*own, "bin").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = different.withColumn("number", before(Window.partitionBy("length", "bin").orderBy("digest", "doc_id", "start")))
    sizes = rows.groupBy("length", "bin").agg(F.count("*").alias("n"))
    starts = sizes.select("length", "bin", before(Window.partitionBy("length").orderBy("bin")).alias("first"))
    placed = numbered.join(starts, ["length", "bin"])
    return placed.select(*own, (F.col("first") + F.col("number")).alias("rank"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")).select(*own, (F.col("rank") + F.col("copy")).alias("rank"))


def _laid_out(layout: Callable[[], Layout], names: list[str]) -> Callable:
    """mapInArrow function: ranked pieces to placed ones; the checksum of a piece that is cut is null."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = layout()
        for batch in batches:
            column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            length = np.asarray(column("length"), dtype=np.int64)
            row, start, n, sequence, offset = own.place(length, np.asarray(column("rank"), dtype=np.int64))
            of = pa.array(row)
            crc = np.asarray(column("crc"), dtype=np.int64)[row]
            yield pa.RecordBatch.from_arrays([
                column("doc_id").take(of), column("digest").take(of), pa.array(np.asarray(column("start"), dtype=np.int64)[row] + start), pa.array(n),
                pa.array(crc, mask=n != length[row]), column("doc_tokens").take(of), pa.array(sequence), pa.array(offset),
            ], names)

    return placed


def checksums(docs: DataFrame, wanted: DataFrame, end: int = END, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """digest, start, length and crc of the wanted pieces (digest, start, length): their texts are encoded again, each once."""
    lists = wanted.groupBy("digest").agg(F.collect_list(F.struct("start", "length")).alias("wanted"))
    texts = docs.select(_digest(text_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if wanted.count() <= MOST_BROADCAST:
        lists = F.broadcast(lists)
        texts = texts.join(F.broadcast(wanted.select("digest").distinct()), "digest", "left_semi")
    rows = texts.dropDuplicates(["digest"]).join(lists, "digest").select("digest", "text", "wanted")
    last = np.array([end], "<u4").tobytes()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("ids", model), lambda: WordEncoder(model))
        for batch in batches:
            texts = as_strings(batch.column(1))
            for a, b in slices(texts, SLICE_BYTES):
                ids, starts = encoder.encode(texts.slice(a, b - a))
                raw = memoryview(np.ascontiguousarray(ids)).cast("B") if len(ids) else memoryview(b"")
                out = []
                for i, (digest, lists) in enumerate(zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True)):
                    own, n = raw[4 * starts[i] : 4 * starts[i + 1]], int(starts[i + 1] - starts[i]) + 1
                    out += [(digest, x["start"], x["length"], _crc(own, x["start"], x["start"] + x["length"], n, last)) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["digest", "start", "length", "crc"])

    return rows.mapInArrow(again, "digest binary, start bigint, length bigint, crc bigint")


def pack(docs: DataFrame, size: int = SIZE, end: int = END, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    docs = docs.select(id_col, text_col)
    kept = cut(pieces(docs, size, end, model, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    layout = Layout.of(histogram, full_patterns(histogram, size), size)
    shared = docs.sparkSession.sparkContext.broadcast(layout)
    names = ["doc_id", "digest", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]
    kinds = [kept.schema["doc_id"].dataType.simpleString(), "binary", *["bigint"] * 6]
    rows = ranked(kept, parts(sum(histogram.values()), BIN_ROWS))
    placed = cut(rows.mapInArrow(_laid_out(lambda: shared.value, names), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))))
    whole, cuts = placed.filter("crc is not null"), placed.filter("crc is null")
    found = checksums(docs, cuts.select("digest", "start", "length").distinct(), end, model, text_col)
    both = whole.unionByName(cuts.drop("crc").join(found, ["digest", "start", "length"]))
    return both.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
