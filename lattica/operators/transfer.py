"""Sequential scans over the row lengths as maps of bands.

A greedy cut depends on where the last one was made, so that rows seem to need one task that reads them in order.
But what a band of consecutive rows does to the state that it is entered with is a small map, which is found without
that state; maps are composed in order, a few at a time, and then the states go back down:

1. each band's map, all bands at once;
2. up: the maps of `FAN` neighbours are composed to one, level by level, until one group is left;
3. down: from the state before the first row, the state before each group, then before each band;
4. each band is read again with its state, and gives its cuts.

A task holds one band, or the maps of `FAN` neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.order import BAND
from lattica.session import cut

FAN = 64


@dataclass(frozen=True)
class Scan:
    """A scan by its parts; a map and a state are arrays of whole numbers.

    before: rows of the band before that a band looks at, which come first in its arrays.
    read(rows, lengths, before) -> map; apply(map, state) -> state; compose(first, second) -> map;
    cuts(rows, lengths, before, state) -> rows.
    """

    start: int
    read: Callable[[np.ndarray, np.ndarray, int], np.ndarray]
    apply: Callable[[np.ndarray, int], int]
    compose: Callable[[np.ndarray, np.ndarray], np.ndarray]
    cuts: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]
    before: int = 0


def _banded(lengths: DataFrame, band: int, before: int) -> DataFrame:
    """band, row and k; the last `before` rows of a band are in the next one as well, with its number."""
    own = F.floor(F.col("row") / band)
    rows = lengths.select(own.alias("band"), "row", "k")
    if not before:
        return rows
    late = lengths.filter(F.pmod(F.col("row"), F.lit(band)) >= band - before).select((own + 1).alias("band"), "row", "k")
    return rows.unionByName(late)


def _arrays(table: pa.Table, band: int, number: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and lengths in order, and how many of them are of the band before."""
    row, k = np.asarray(table["row"]), np.asarray(table["k"])
    order = np.argsort(row)
    row, k = row[order], k[order]
    return row, k, int(np.searchsorted(row, number * band))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64))).cast(pa.list_(pa.int64()))


def _in_order(table: pa.Table, key: str) -> pa.Table:
    return table.take(pa.array(np.argsort(np.asarray(table[key]))))


def scanned(lengths: DataFrame, scan: Scan, band: int = BAND, fan: int = FAN) -> DataFrame:
    """cut: what scan.cuts() gives for all bands. lengths: row (consecutive from 0) and k."""
    if scan.before >= band:
        raise ValueError("a scan looks back over less than a band")
    # Lengths are read twice, for the maps and for the cuts.
    rows = _banded(cut(lengths.select("row", "k")), band, scan.before)

    def mapped(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        return pa.table({"band": pa.array([number], pa.int64()), "map": _lists([scan.read(*_arrays(table, band, number))])})

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        maps = [np.array(x, np.int64) for x in _in_order(table, "band")["map"].to_pylist()]
        out = maps[0]
        for x in maps[1:]:
            out = scan.compose(out, x)
        return pa.table({"band": pa.array([key[0].as_py()], pa.int64()), "map": _lists([out])})

    def entered(key: tuple, table: pa.Table) -> pa.Table:
        """The state before each band of a group, from the one before the group."""
        table = _in_order(table, "band")
        state, states = int(table["state"][0].as_py()), []
        for x in table["map"].to_pylist():
            states.append(state)
            state = scan.apply(np.array(x, np.int64), state)
        return pa.table({"band": table["band"], "state": pa.array(states, pa.int64())})

    up = F.floor(F.col("band") / fan)
    levels = [cut(rows.groupBy("band").applyInArrow(mapped, "band long, map array<long>"))]
    # A level has a map for each band, group of bands, ...: as many as rows over the product of their sizes.
    n = levels[0].count()
    while n > fan:
        levels.append(cut(levels[-1].groupBy(up.alias("group")).applyInArrow(joined, "band long, map array<long>")))
        n = levels[-1].count()
    states = levels[-1].sparkSession.range(1).select(F.col("id").alias("group"), F.lit(scan.start).cast("long").alias("state"))
    for maps in reversed(levels):
        grouped = maps.withColumn("group", up).join(states, "group")
        states = cut(grouped.groupBy("group").applyInArrow(entered, "band long, state long")).withColumnRenamed("band", "group")

    def cuts(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        state = int(table["state"][0].as_py())
        return pa.table({"cut": pa.array(scan.cuts(*_arrays(table, band, number), state), pa.int64())})

    return rows.join(states.withColumnRenamed("group", "band"), "band").groupBy("band").applyInArrow(cuts, "cut long")


# Greedy blocks: the state is what the open block holds where a band begins.

#: No block is open: the first row begins one.
CLOSED = 1 << 62


def greedy(limit: int, with_row: bool) -> Scan:
    """A block ends before the first row r at which what it would hold reaches the limit.

    with_row: the entries of r count (a block holds less than the limit, but for a single long row), else those
    of the rows before r (a block holds the limit or more).

    A map is the band's entries, then pairs (state, state after the band) in ascending order: a state of at least the
    first and less than the next one leads to the second; states below the first pair only grow by the band's entries.
    """

    def sums(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        total = np.cumsum(k)
        return total - k, total if with_row else total - k, int(total[-1])

    def following(begin: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The first row of the next block, for each row as the first of a block; the number of rows for none in the band."""
        return np.maximum(np.searchsorted(reach, begin + limit), np.arange(1, len(begin) + 1))

    def read(rows: np.ndarray, k: np.ndarray, before: int) -> np.ndarray:
        begin, reach, total = sums(k)
        n = len(k)
        jump, last = np.append(following(begin, reach), n), np.arange(n + 1)
        while (jump[:n] < n).any():  # pointer doubling: the last block's first row
            last = np.where(jump < n, last[np.minimum(jump, n)], last)
            jump = jump[jump]
        out = total - begin[last[:n]]
        # The first row that a state cuts at, from the last row that any state does down to the first one.
        least = limit - reach
        stop = int(np.searchsorted(-least, 0)) + 1 if least[-1] <= 0 else n
        least, out = np.maximum(least[:stop], 0)[::-1], out[:stop][::-1]
        return _merged(np.array([total]), least, out)

    def _merged(total: np.ndarray, least: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Pairs in order; of equal states the first row's stays, neighbours that lead to the same state are one."""
        keep = np.append(least[1:] != least[:-1], True)[: len(least)]
        least, out = least[keep], out[keep]
        new = np.append(True, out[1:] != out[:-1])[: len(least)]
        return np.concatenate((total, np.stack((least[new], out[new]), axis=1).ravel()))

    def apply_all(m: np.ndarray, states: np.ndarray) -> np.ndarray:
        least, out = m[1::2], m[2::2]
        at = np.searchsorted(least, states, "right") - 1
        return np.where(at < 0, states + m[0], out[at]) if len(least) else states + m[0]

    def apply(m: np.ndarray, state: int) -> int:
        return int(apply_all(m, np.array([state], np.int64))[0])

    def compose(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        least = two[1::2] - one[0]
        low = least < (one[1] if len(one) > 1 else CLOSED)
        starts = np.concatenate((np.maximum(least[low], 0), one[1::2]))
        return _merged(np.array([one[0] + two[0]]), starts, np.concatenate((two[2::2][low], apply_all(two, one[2::2]))))

    def found(rows: np.ndarray, k: np.ndarray, before: int, state: int) -> np.ndarray:
        begin, reach, _ = sums(k)
        nexts, at, out = following(begin, reach).tolist(), int(np.searchsorted(reach, limit - state)), []
        while at < len(k):
            out.append(at)
            at = nexts[at]
        return rows[np.array(out, np.int64)]

    return Scan(CLOSED, read, apply, compose, found)


# Breaks against the mean of the rows before: the state is how many rows since the last cut are looked at, at most `width` - 1.


def adjacent(rate: float, width: int) -> Scan:
    """A cut where a length leaves [mean / rate, mean * rate] of the up to `width` - 1 rows before it since the last cut.

    A map is the state after the band for each state before it; state 0 is before the first row of all.
    """
    most = width - 1
    if most < 1:
        raise ValueError("at least one row before is looked at")

    def breaks(k: np.ndarray, before: int) -> np.ndarray:
        """Whether each row of the band is cut off from the last 1, 2, ... rows."""
        total = np.concatenate((np.zeros(most + 1, np.int64), np.cumsum(k)))
        at = np.arange(before, len(k)) + most + 1
        out = np.zeros((len(at), most + 1), bool)
        for j in range(1, most + 1):
            mean = (total[at - 1] - total[at - 1 - j]) / j
            own = k[before:]
            out[:, j] = (own < mean / rate) | (own > mean * rate)
        return out

    def read(rows: np.ndarray, k: np.ndarray, before: int) -> np.ndarray:
        grown = np.minimum(np.arange(most + 1) + 1, most)
        steps = np.where(breaks(k, before), 1, grown)
        while len(steps) > 1:  # neighbours are composed until one map is left
            if len(steps) % 2:
                steps = np.concatenate((steps, np.arange(most + 1)[None]))
            steps = np.take_along_axis(steps[1::2], steps[::2], axis=1)
        return steps[0]

    def found(rows: np.ndarray, k: np.ndarray, before: int, state: int) -> np.ndarray:
        out, cut_at = [], breaks(k, before)
        for i, row in enumerate(cut_at.tolist()):
            if row[state]:
                out.append(i)
                state = 1
            else:
                state = min(state + 1, most)
        return rows[before:][np.array(out, np.int64)]

    return Scan(0, read, lambda m, state: int(m[state]), lambda one, two: two[one], found, most)

