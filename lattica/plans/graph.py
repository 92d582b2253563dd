"""Plans: an input, dense steps on the whole matrix, then steps on levels, then a template or product strategy.

A plan is checked against the rules of order before it runs, and is lowered to DataFrame operations: dense steps
change the entries or give them a block, level steps give them their blb, wlb and tlb, and the template sums along these.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators import cuts, division, features, layout, levels, order, products, sorting
from lattica.plans import facts, templates
from lattica.session import cut
from lattica.sources import generators, text

INPUTS = ("read_coo", "generate", "cached")
DENSE = ("coarse_sort", "fine_sort", "row_pad_total", "row_div", "col_div", "compress")
LEVELS = ("row_pad", "blb_row", "blb_col", "wlb_row", "wlb_col", "tlb_row", "tlb_col", "tlb_nnz")
SORTS, DIVISIONS = ("coarse_sort", "fine_sort"), ("row_div", "col_div")


@dataclass(frozen=True)
class Step:
    name: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    dense: tuple[Step, ...] = ()
    levels: tuple[Step, ...] = ()
    strategy: str = "direct"

    def record(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def of(record: str) -> Plan:
        raw = json.loads(record)
        steps = lambda k: tuple(Step(s["name"], s["params"]) for s in raw[k])
        return Plan(steps("dense"), steps("levels"), raw["strategy"])


def violations(plan: Plan) -> list[str]:
    """What is wrong with a plan's order; empty if it may run."""
    found: list[str] = []
    names = [s.name for s in plan.dense]
    for i, name in enumerate(names):
        before = names[:i]
        if name not in DENSE + INPUTS:
            found.append(f"{name} is no dense step")
        if name in INPUTS and i:
            found.append(f"{name} must come first")
        if name in SORTS and any(x in SORTS + DIVISIONS + ("compress",) for x in before):
            found.append(f"{name} is allowed once, before division and compression")
        if name == "row_div" and "row_div" in before:
            found.append("rows are divided once")
        if name in DIVISIONS and "compress" in before:
            found.append(f"{name} must come before compression")
        if name == "compress" and (i != len(names) - 1 or name in before):
            found.append("compress is the last dense step, once")
    steps = [s.name for s in plan.levels]
    for i, name in enumerate(steps):
        before = steps[:i]
        if name not in LEVELS:
            found.append(f"{name} is no level step")
        if name == "row_pad" and before:
            found.append("rows are padded before any level is partitioned")
        for level, later in (("blb", ("wlb", "tlb")), ("wlb", ("tlb",)), ("tlb", ())):
            if name.startswith(level) and any(x.startswith((level, *later)) for x in before):
                found.append(f"{name} comes too late")
        if name == "wlb_row" and any(x.startswith("blb") for x in before):
            found.append("warps are not divided by rows inside blocks")
        if name == "tlb_nnz" and before:
            found.append("equal shares of entries stand alone")
    if plan.levels and "compress" not in names:
        found.append("levels need a compressed matrix")
    if plan.strategy not in products.STRATEGIES + tuple(templates.TREES):
        found.append(f"no strategy {plan.strategy}")
    return found


#: Matrices that `cached` steps name.
_CACHED: dict[str, SparseMatrix] = {}


def remember(name: str, matrix: SparseMatrix) -> SparseMatrix:
    """Keeps a matrix, computed once, for plans that begin with a `cached` step."""
    _CACHED[name] = matrix.with_entries(cut(matrix.entries))
    return _CACHED[name]


def forget(name: str) -> None:
    """Lets go of a remembered matrix; plans that have been made from it keep their entries."""
    _CACHED.pop(name, None)


def source(spark: SparkSession, step: Step) -> SparseMatrix:
    """The matrix of an input step."""
    p = step.params
    if step.name == "read_coo":
        return text.read_coo(spark, p["path"])
    if step.name == "generate":
        return generators.uniform(spark, p["rows"], p["cols"], p["per_row"], p.get("seed", 0))
    return _CACHED[p["name"]]


def reads_once(step: Step) -> bool:
    """Whether a step is a sort that needs no look at the lengths before; it keeps the entries that it makes."""
    p = step.params
    return step.name == "fine_sort" or step.name == "coarse_sort" and bool(p.get("bounds") or max(p.get("every", 1), p.get("step", 1)) <= 1 and "bounds" not in p)


def prepare(matrix: SparseMatrix | None, plan: Plan, spark: SparkSession | None = None) -> SparseMatrix:
    """The input and the dense steps; the row map of a sort goes along, division and compression add columns to the entries.

    block: the part of a divided matrix; row_lo and col_lo: what compression takes away from a block's indices; row_hi: the row after the block's last.
    """
    if found := violations(plan):
        raise ValueError("; ".join(found))
    if matrix is not None and (plan.levels or len(plan.dense) > 1) and not (plan.dense and reads_once(plan.dense[0])):
        matrix = matrix.held()  # every step reads it again, and often a few columns of it
    for i, step in enumerate(plan.dense):
        p = step.params
        if step.name in DIVISIONS and i:  # cut points are looked for in it, and it is divided at them
            matrix = matrix.held()
        if step.name in INPUTS:
            matrix = source(spark or SparkSession.active(), step)
        elif step.name == "coarse_sort":
            every = p.get("every", 1)
            if "bounds" in p or every > 1:
                kind = sorting.bin_of(p.get("bounds") or cuts.coarse_bounds(matrix, every))
            elif p.get("step", 1) > 1:  # bins of equal width from the shortest row on
                kind = sorting.step_of(matrix, p["step"])
            else:  # a bin for each length
                kind = sorting.length
            matrix = sorting.sort(matrix, kind)
        elif step.name == "fine_sort":
            matrix = sorting.sort(matrix, sorting.length)
        elif step.name == "row_pad_total":
            matrix = layout.pad_rows(matrix, p["multiple"])
        elif step.name == "row_div":
            if "cuts" in p:
                points, several = p["cuts"], len(p["cuts"]) > 2
            else:  # as many as the rows' lengths make: they stay a table
                points = cut(cuts.exponential_cuts(matrix, p["start"], p["rate"], p.get("cap")))
                found = points.count()
                several = found > 2
                if found <= division.MOST_CASES + 1:  # a few numbers are written out, so that no entry is moved to meet its block
                    points = sorted(r["cut"] for r in points.collect())
            if several:  # one block is no division
                matrix = _divided(matrix, lambda m, points=points: division.row_ranges(m, points, with_low=True))
        elif step.name == "col_div":
            matrix = replace(_divided(matrix, lambda m, width=p["width"]: division.col_blocks(m, width).entries), by_cols=True)
        elif step.name == "compress":
            matrix = compressed(matrix)
    return matrix


def _divided(matrix: SparseMatrix, divide: Callable[[SparseMatrix], DataFrame]) -> SparseMatrix:
    """Entries with block; where they have one already, a block stands for both divisions."""
    if "block" not in matrix.entries.columns:
        return matrix.with_entries(divide(matrix))
    entries = divide(matrix.with_entries(matrix.entries.withColumnRenamed("block", "_earlier")))
    new = (entries.agg(F.max("block")).first()[0] or 0) + 1
    return matrix.with_entries(entries.withColumn("block", F.col("_earlier") * new + F.col("block")).drop("_earlier"))


def compressed(matrix: SparseMatrix) -> SparseMatrix:
    """Entries with block (0 if undivided) and its least column, which index widths follow from. A block of a compressed matrix is as it was."""
    e = matrix.entries
    if "col_lo" in e.columns:
        return matrix
    new = {name: F.lit(value).cast("long") for name, value in (("block", 0), ("row_lo", 0), ("row_hi", matrix.n_rows)) if name not in e.columns}
    if "block" in new:  # one block: its least column is a number
        new["col_lo"] = F.lit(e.agg(F.min("col")).first()[0]).cast("long")
        return matrix.with_entries(e.withColumns(new), kept=matrix.kept, numbers=None if matrix.numbers is None else matrix.numbers.withColumns(new))
    e = e.withColumns(new)
    return matrix.with_entries(order.with_groups(e, e.groupBy("block").agg(F.min("col").alias("col_lo")), "block"))


def relative(matrix: SparseMatrix) -> DataFrame:
    """block, rel_row, rel_col and val of a compressed matrix."""
    return matrix.entries.select("block", (F.col("row") - F.col("row_lo")).alias("rel_row"), (F.col("col") - F.col("col_lo")).alias("rel_col"), "val")


def index_widths(matrix: SparseMatrix) -> DataFrame:
    """block, and the bits that its relative rows and columns take: 8, 16 or 32 (64 beyond)."""
    bits = lambda c: F.when(c < 1 << 8, 8).when(c < 1 << 16, 16).when(c < 1 << 32, 32).otherwise(64).cast("long")
    sizes = relative(matrix).groupBy("block").agg(F.max("rel_row").alias("r"), F.max("rel_col").alias("c"))
    return sizes.select("block", bits(F.col("r")).alias("row_bits"), bits(F.col("c")).alias("col_bits"))


def lower(matrix: SparseMatrix, plan: Plan, gapless: bool = True) -> levels.Levels:
    """The level steps of a plan on a prepared matrix; levels that it leaves out are whole, threads hold one entry. gapless: see Levels."""
    rows = matrix.n_rows
    for step in plan.levels:
        if step.name == "row_pad":
            matrix = padded_rows(matrix, step.params["multiple"])
        if step.params.get("empty_rows"):
            matrix = with_empty_rows(matrix)
    state = levels.opened(matrix, gapless)
    for step in plan.levels:
        p = step.params
        if step.name == "blb_row":
            state = levels.blb_rows(state, p["height"]) if "height" in p else levels.blb_rows_at(state, cuts.least_nnz_cuts(matrix, p["least"]))
        elif step.name == "blb_col":
            state = levels.blb_cols(state, p["size"], p.get("merge_tail", True), F.col("len") >= p["from"] if "from" in p else None)
        elif step.name == "wlb_row":
            state = levels.wlb_rows(state, p["height"])
        elif step.name == "wlb_col":
            state = levels.wlb_cols(state, p["size"])
        elif step.name == "tlb_row":
            state = levels.tlb_rows(state)
        elif step.name == "tlb_col":
            state = levels.tlb_cols(state, p.get("size"))
        elif step.name == "tlb_nnz":
            state = levels.tlb_nnz(state, p["size"])
    if matrix.n_rows != rows and not state.has:
        state = levels.blb_whole(state)
    return levels.completed(state)


def with_empty_rows(matrix: SparseMatrix) -> SparseMatrix:
    """A pad for each row without entries, at the least column of its block, so that layouts have slots for it.

    A row between two blocks belongs to the one whose first row is the last at or before it; the first block takes rows before it.
    """
    e = matrix.entries
    if "is_pad" not in e.columns:
        e = e.withColumn("is_pad", F.lit(False))
    blocks = e.groupBy("block").agg(*[F.min(c).alias(c) for c in ("row_lo", "row_hi", "col_lo")])
    empty = matrix.rows().join(e.select("row").distinct(), "row", "left_anti")
    by_row = order.intervals(empty, blocks.select(F.col("row_lo").alias("cut"))).drop("range")
    first = blocks.agg(F.min("row_lo")).first()[0]
    owned = by_row.withColumn("low", F.coalesce("low", F.lit(first))).join(blocks, F.col("low") == F.col("row_lo"))
    pads = owned.withColumns({"col": F.col("col_lo"), "val": F.lit(0.0), "is_pad": F.lit(True)}).select(*e.columns)
    return matrix.with_entries(e.unionByName(pads))


def padded_rows(matrix: SparseMatrix, multiple: int) -> SparseMatrix:
    """Rows added at the end until their number is a multiple: is_pad entries of value 0 in the last block."""
    e, added = matrix.entries, -matrix.n_rows % multiple
    if "is_pad" not in e.columns:
        e = e.withColumn("is_pad", F.lit(False))
    last = e.agg(F.max("block").alias("block"), F.max("row_lo").alias("row_lo")).first()
    if not added or last["block"] is None:
        return matrix.with_entries(e, numbers=matrix.numbers)
    new = matrix.spark.range(matrix.n_rows, matrix.n_rows + added).select(F.col("id").alias("row"))
    values = {"col": F.lit(0).cast("long"), "val": F.lit(0.0), "block": F.lit(last["block"]), "row_lo": F.lit(last["row_lo"]), "row_hi": F.lit(matrix.n_rows + added).cast("long"), "col_lo": F.lit(0).cast("long"), "is_pad": F.lit(True)}
    new, numbers = new.withColumns(values), None
    if matrix.numbers is not None:  # pads come after all entries
        n = matrix.numbers.count()
        places = {"rn": F.lit(0), "k": F.lit(1).cast("long"), "nz": F.col("row") + (n - matrix.n_rows)}
        numbers = matrix.numbers.withColumn("is_pad", F.lit(False)).unionByName(new.withColumns(places), allowMissingColumns=True)
    return matrix.with_entries(e.unionByName(new.select(*e.columns)), n_rows=matrix.n_rows + added, numbers=numbers)


def run(matrix: SparseMatrix | None, plan: Plan, x: DataFrame, spark: SparkSession | None = None, check: bool = True) -> DataFrame:
    """row and y, by the original rows. check: whether the partition supports the template is looked up first."""
    ready = prepare(matrix, plan, spark)
    rows = ready.n_rows
    if plan.strategy in templates.TREES and (plan.levels or plan.strategy not in products.STRATEGIES):
        divisions = any(s.name in DIVISIONS for s in plan.dense)
        divided = divisions or not facts.known(plan)
        if check and not divided:  # the row lengths tell; they are counted and then divided, from what is computed once
            ready = ready.held()
        if check and not divided and not facts.supports(ready, plan):
            raise ValueError(f"the partition does not support {plan.strategy}")
        if divisions:
            ready = ready.held()
        state = lower(ready, plan, gapless=False)
        if check and divided:  # rows may lie in several blocks: the partition has to be laid out to be looked at
            state = levels.kept(replace(state, entries=state.entries.drop("nz", "row_lo", "blb_lo", "at", "len")))  # templates read the levels
            if not templates.supports(state.entries, plan.strategy):
                raise ValueError(f"the partition does not support {plan.strategy}")
        if ready.row_map is not None and "old_row" in state.entries.columns:  # sums by the rows as they were; pads are of none
            before = state.entries.filter(F.col("old_row").isNotNull()).drop("row").withColumnRenamed("old_row", "row")
            return templates.product(before, replace(ready, n_rows=ready.n_sorted), x, plan.strategy)
        sums = templates.product(state.entries, ready, x, plan.strategy)
    else:
        plain = ready.with_entries(ready.entries.select("row", "col", "val"))
        options = {k: v for s in plan.levels for k, v in s.params.items() if k in ("size", "height", "width", "workers")}
        sums = products.by_strategy(plain, x, plan.strategy, **options)
    if ready.row_map is not None:
        return ready.row_map.join(sums, F.col("new_row") == F.col("row")).select(F.col("old_row").alias("row"), "y")
    return sums.filter(F.col("row") < (matrix.n_rows if matrix is not None else rows))


def padding_allows(matrix: SparseMatrix, height: int, most: float = 4.0) -> bool:
    """Whether bands of this height stay within the padding that a plan may cost."""
    ratio = features.band_padding(matrix, height).first()["padding_ratio"]
    return ratio is not None and ratio <= most
