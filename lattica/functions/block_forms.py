"""Closed forms of the index arrays of all blocks at once.

A stretch of an array is summed up by a few numbers: its ends, least and largest value, the differences of neighbours
(two of them at most, else there is no cycle) and where they stand, the changes and the first runs. Summaries of
stretches that follow one another merge into that of the whole, so that arrays of any length are read once, in
pieces, and every form of every array is decided together. All positions of a kind count as equally spaced where the
least and the largest gap between them are the same.

Forms, in the order in which they are chosen, with their parameters (i counts from 0, n values):

* constant [a]
* linear [b, c]: b + c i, c >= 0, n > 1
* cycle_linear [p, b, c]: b + c (i mod p), 1 < p < n, p divides n
* cycle_increase [p, b]: b + i div p, p divides n > 2
* branches [i0, a0, i1, a1, ...]: at most five runs, n > 2
* stored []: none of these
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.formulas import MOST_RUNS
from lattica.operators.order import BAND

STORED = "stored"


@dataclass
class Places:
    """Ascending positions: how many, the first and last one, the least and largest gap."""

    n: int = 0
    first: int = -1
    last: int = -1
    least: int = 1 << 62
    most: int = 0

    @staticmethod
    def of(at: np.ndarray) -> Places:
        if not len(at):
            return Places()
        gaps = np.diff(at)
        return Places(len(at), int(at[0]), int(at[-1]), int(gaps.min(initial=1 << 62)), int(gaps.max(initial=0)))

    def then(self, other: Places) -> Places:
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.first - self.last
        return Places(self.n + other.n, self.first, other.last, min(self.least, other.least, gap), max(self.most, other.most, gap))

    def every(self, p: int) -> bool:
        """Whether the positions are p, 2 p, 3 p, ..."""
        return self.n > 0 and self.first == p and (self.n == 1 or self.least == self.most == p)

    def numbers(self) -> list[int]:
        return [self.n, self.first, self.last, self.least, self.most]


@dataclass
class Stretch:
    """Summary of the values from position `begin` on."""

    begin: int
    n: int
    first: int
    last: int
    low: int
    high: int
    #: Places by difference to the value before; None for more than two differences.
    steps: dict[int, Places] | None
    changes: Places
    #: First position and value of the first runs, one more than a form may have.
    runs: list[int] = field(default_factory=list)

    @staticmethod
    def of(begin: int, a: np.ndarray) -> Stretch:
        d = np.diff(a)
        at = np.arange(begin + 1, begin + len(a))
        kinds = np.unique(d) if len(d) else d
        steps = {int(k): Places.of(at[d == k]) for k in kinds} if len(kinds) <= 2 else None
        changed = np.concatenate(([True], d != 0))
        first = np.flatnonzero(changed)[: MOST_RUNS + 1]
        return Stretch(begin, len(a), int(a[0]), int(a[-1]), int(a.min()), int(a.max()), steps, Places.of(at[d != 0]), np.stack((first + begin, a[first]), axis=1).ravel().tolist())

    def then(self, other: Stretch) -> Stretch:
        step, edge = other.first - self.last, Places(1, other.begin, other.begin)
        steps = None
        if self.steps is not None and other.steps is not None and len({*self.steps, step, *other.steps}) <= 2:
            steps = {k: self.steps.get(k, Places()).then(edge if k == step else Places()).then(other.steps.get(k, Places())) for k in {*self.steps, step, *other.steps}}
        changes = self.changes.then(edge if step else Places()).then(other.changes)
        runs = [*self.runs, *other.runs[0 if step else 2 :]][: 2 * MOST_RUNS + 2]
        return Stretch(self.begin, self.n + other.n, self.first, other.last, min(self.low, other.low), max(self.high, other.high), steps, changes, runs)

    def numbers(self) -> list[int]:
        steps = [-1] if self.steps is None else [len(self.steps), *(x for k in sorted(self.steps) for x in (k, *self.steps[k].numbers()))]
        return [self.begin, self.n, self.first, self.last, self.low, self.high, *self.changes.numbers(), *steps, *self.runs]

    @staticmethod
    def read(x: list[int]) -> Stretch:
        n, at = x[11], 12
        steps = None
        if n >= 0:
            steps = {x[at + 6 * i]: Places(*x[at + 6 * i + 1 : at + 6 * i + 6]) for i in range(n)}
            at += 6 * n
        return Stretch(*x[:6], steps, Places(*x[6:11]), x[at:])

    def form(self) -> tuple[str, list[int]]:
        n, b = self.n, self.first
        if self.low == self.high:
            return "constant", [b]
        if self.steps is not None:
            c = next(k for k, at in self.steps.items() if at.first == 1)
            if len(self.steps) == 1 and c >= 0:
                return "linear", [b, c]
            if len(self.steps) == 2:
                back = next(k for k in self.steps if k != c)
                p = self.steps[back].first
                if 1 < p < n and n % p == 0 and back == -(p - 1) * c and self.steps[back].every(p) and self.steps[back].n == n // p - 1:
                    return "cycle_linear", [p, b, c]
                p = self.changes.first
                if n > 2 and n % p == 0 and set(self.steps) == {0, 1} and self.changes.every(p) and self.changes.n == n // p - 1:
                    return "cycle_increase", [p, b]
        if n > 2 and self.changes.n < MOST_RUNS:
            return "branches", list(self.runs)
        return STORED, []


def _runs_of(keys: list[np.ndarray]) -> np.ndarray:
    """Where a row's key differs from that of the row before, and the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if n > 1 else False
    return np.append(np.flatnonzero(new), n)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of rows (block, array, i, a) that lie in order in the partition."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, i, a = (np.asarray(batch.column(c)) for c in (0, 2, 3))
        array = np.asarray(batch.column(1).dictionary_encode().indices)
        at = _runs_of([block, array, i - np.arange(len(i))])
        rows = [Stretch.of(int(i[x]), a[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(block[at[:-1]]), batch.column(1).take(pa.array(at[:-1])), pa.array(i[at[:-1]]), pa.array([r.numbers() for r in rows], pa.list_(pa.int64()))], ["block", "array", "begin", "summary"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The form of each array, from its stretches in order."""
    key, held, out = None, None, []

    def batch() -> pa.RecordBatch:
        rows = [(*k, *s.form(), s.n, s.high) for k, s in out]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "array", "form", "params", "n", "high"])

    for own in batches:
        for block, array, summary in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), own.column(3).to_pylist(), strict=True):
            stretch = Stretch.read(summary)
            if (block, array) == key:
                held = held.then(stretch)
                continue
            if key is not None:
                out.append((key, held))
            key, held = (block, array), stretch
        if len(out) > 10_000:
            yield batch()
            out = []
    if key is not None:
        out.append((key, held))
    if out:
        yield batch()


def block_forms(arrays: DataFrame, band: int = BAND) -> DataFrame:
    """block, array, form, params, n and high (the largest value) of every array. arrays: block, array, i (from 0) and a."""
    rows = arrays.select(F.col("block").cast("long").alias("block"), F.col("array").cast("string").alias("array"), F.col("i").cast("long").alias("i"), F.col("a").cast("long").alias("a"))
    pieces = rows.repartition("block", "array", F.floor(F.col("i") / band)).sortWithinPartitions("block", "array", "i")
    summed = pieces.mapInArrow(_summed, "block long, array string, begin long, summary array<long>")
    whole = summed.repartition("block", "array").sortWithinPartitions("block", "array", "begin")
    return whole.mapInArrow(_decided, "block long, array string, form string, params array<long>, n long, high long")


def value_of(form: Column, params: Column, i: Column) -> Column:
    """The value at position i of an array of a form."""
    p = lambda k: F.element_at(params, k)
    # Runs: the value of the last one that begins at or before i.
    begins = F.transform(F.sequence(F.lit(0), (F.size(params) / 2).cast("int") - 1), lambda k: F.struct(F.get(params, 2 * k).alias("at"), F.get(params, 2 * k + 1).alias("a")))
    last = F.element_at(F.filter(begins, lambda r: r["at"] <= i), -1)["a"]
    return (
        F.when(form == "constant", p(1))
        .when(form == "linear", p(1) + p(2) * i)
        .when(form == "cycle_linear", p(2) + p(3) * F.pmod(i, p(1)))
        .when(form == "cycle_increase", p(2) + F.floor(i / p(1)))
        .when(form == "branches", last)
    )
