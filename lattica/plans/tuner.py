"""Plan search: parameter grids, matrix strategies, skeletons by row length, a budget of steps, a log of trials, the best plan."""

from __future__ import annotations

import functools
import itertools
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators import cuts, features, products
from lattica.operators.division import numbered
from lattica.plans import facts, learn
from lattica.plans.graph import Plan, Step, prepare, run, violations
from lattica.session import keep
from lattica.sources import corpus

LOG = "ops array<string>, strategies array<string>, template string, params array<double>, metric double"


def grid(spark: SparkSession, ranges: dict[str, tuple[float, float, float]], keep: str | None = None, derived: dict[str, str] | None = None) -> DataFrame:
    """Every combination of values low, low + step, ... up to and with `up`, for name: (low, up, step).

    derived: further columns by SQL expression; keep: SQL condition on a combination.
    """
    out = spark.range(1).drop("id")
    for name, (low, up, step) in ranges.items():
        n = int((up - low) / step + 1e-9) + 1
        values = F.array(*[F.lit(float(low + i * step)) for i in range(n)])
        out = out.select("*", F.explode(values).alias(name))
    for name, expression in (derived or {}).items():
        out = out.withColumn(name, F.expr(expression))
    return out.filter(keep) if keep else out


@dataclass
class Budget:
    """Steps left: a start, more for each improvement, and a wall clock limit."""

    steps: int = 10
    seconds: float = 32_400.0
    least_gain: int = 5
    most_gain: int = 25

    def __post_init__(self):
        self.began, self.best = time.monotonic(), 0.0

    def tell(self, metric: float) -> bool:
        """Counts one trial; whether the search goes on."""
        self.steps -= 1
        if metric > self.best:
            if self.best:
                self.steps += int(min(self.most_gain, max(self.least_gain, 5 * (metric - self.best))))
            self.best = metric
        return self.steps > 0 and time.monotonic() - self.began < self.seconds


PADS, HEIGHTS_BY_NNZ, WIDTHS = (32, 64), (128, 512, 896), tuple(range(1, 17, 3))


@dataclass(frozen=True)
class Block:
    """What the gates look at: row lengths of one part of a matrix."""

    least: int
    longest: int
    average: int
    is_sorted: bool


def _doubled(low: int, high: int) -> list[int]:
    return [low << i for i in range(32) if low << i <= high]


def _warps(b: Block) -> list[int]:
    return list(range(32, max(32, min(b.longest, 128)) + 1, 32))


#: Skeletons: number, gate, template, and the level steps for each choice of sizes.
SKELETONS: tuple[tuple[int, Callable[[Block], bool], str, Callable[[Block], list[tuple[Step, ...]]]], ...] = (
    (8, lambda b: b.least >= 128, "shared_memory_long_row", lambda b: [(Step("blb_col", {"size": n}),) for n in _doubled(128, min(4096, -(-b.longest // 32) * 32))]),
    (1, lambda b: b.longest <= 512, "direct_warp_compress", lambda b: [(Step("row_pad", {"multiple": n}), Step("blb_row", {"height": n}), Step("tlb_row")) for n in range(64, 257, 64)]),
    (5, lambda b: b.longest <= 512, "direct_warp_block_compress", lambda b: [(Step("row_pad", {"multiple": 32}), Step("tlb_row"))]),
    (9, lambda b: not b.is_sorted, "unaligned_warp_reduce", lambda b: [(Step("tlb_nnz", {"size": n}),) for n in sorted({max(1, min(b.average, 32) * i // 4) for i in range(1, 5)})]),
    (4, lambda b: b.least >= 30 and b.longest <= 512, "direct_warp_reduce", lambda b: [(Step("wlb_col", {"size": n}),) for n in _warps(b)]),
    (6, lambda b: b.least >= 32 and b.longest <= 1024, "shared_memory_warp_reduce", lambda b: [(Step("row_pad", {"multiple": n}), Step("blb_row", {"height": n}), Step("wlb_col", {"size": w})) for n in (2, 4) for w in _warps(b)]),
    (7, lambda b: b.least >= 32 and b.longest <= 1024, "shared_memory_warp_reduce", lambda b: [(Step("blb_row", {"least": n}), Step("wlb_col", {"size": w})) for n in HEIGHTS_BY_NNZ for w in _warps(b)]),
    (2, lambda b: b.longest <= 1024, "shared_memory_warp_compress", lambda b: [(Step("row_pad", {"multiple": n}), Step("blb_row", {"height": n}), Step("tlb_col", {"size": w})) for n in PADS for w in WIDTHS]),
    (3, lambda b: b.longest <= 1024, "shared_memory_warp_compress", lambda b: [(Step("blb_row", {"least": n}), Step("tlb_col", {"size": w})) for n in HEIGHTS_BY_NNZ for w in WIDTHS]),
)


def facts_of(matrix: SparseMatrix) -> Block:
    """The gates' numbers of a whole matrix, or of a part of one: its rows without entries count, rows outside it do not."""
    if "row_lo" in matrix.entries.columns:
        rows = matrix.entries.groupBy("row").agg(F.count("*").alias("k"), F.first("row_hi").alias("hi"), F.first("row_lo").alias("lo"))
        got = rows.agg(F.min("k").alias("least"), F.max("k").alias("longest"), F.sum("k").alias("nnz"), F.count("*").alias("rows"), (F.max("hi") - F.min("lo")).alias("height")).first()
        if not got["rows"]:
            return Block(0, 0, 0, False)
        return Block(0 if got["height"] > got["rows"] else got["least"], got["longest"], got["nnz"] // got["height"], False)
    info = features.matrix_info(matrix).first()
    return Block(info["min_nnz"] or 0, info["max_nnz"] or 0, info["avg_nnz"] or 0, bool(info["is_sorted"]))


def skeleton_plans(block: Block, dense: tuple[Step, ...] = ()) -> list[tuple[int, Plan]]:
    """Skeletons that the gates admit, with each choice of sizes; all plans are legal."""
    out = [(number, Plan((*dense, Step("compress")), steps, template)) for number, gate, template, sizes in SKELETONS if gate(block) for steps in sizes(block)]
    return [(number, plan) for number, plan in out if not violations(plan)]


def candidates(matrix: SparseMatrix, dense: tuple[Step, ...] = ()) -> list[Plan]:
    """The plans of the skeletons for a matrix, each once."""
    plans = [plan for _, plan in skeleton_plans(facts_of(matrix), dense)]
    return [Plan.of(record) for record in dict.fromkeys(map(Plan.record, plans))]


SECOND = (32, 4, 4096)
THIRD = tuple((start, rate, 2048) for start in (512, 128, 32) for rate in (4, 8, 16))
MOST_BLOCKS = 4


def sorted_cuts(matrix: SparseMatrix, grid_points: Iterable[tuple[int, int, int]]) -> dict[tuple[int, int, int], list[int]]:
    """Cut points of exponential divisions after a sort by length, from the rows in each window: a handful of numbers."""
    points = list(grid_points)
    lengths = matrix.row_nnz()
    windows = F.array(*[F.struct(F.lit(i).alias("i"), cuts.window_of(F.col("k"), *p).cast("long").alias("w")) for i, p in enumerate(points)])
    sizes = lengths.select(F.explode(windows).alias("x")).groupBy("x.i", "x.w").agg(F.count("*").alias("n")).collect()
    out = {}
    for i, p in enumerate(points):
        own = sorted(((r["w"], r["n"]) for r in sizes if r["i"] == i), reverse=True)
        out[p] = list(itertools.accumulate([0, *[n for _, n in own]]))
    return out


def matrix_strategies(matrix: SparseMatrix) -> list[tuple[int, tuple[int, int, int] | None, list[int], tuple[Step, ...] | None]]:
    """strategy, (start, rate, cap), cut points, and the dense steps where it is admitted.

    1: the matrix as it is. 2: exponential row division, if it gives 2 to 4 blocks. 3: a sort by length unless the rows are in
    that order, then each of nine exponential divisions into at most 4 blocks; of equal divisions the first one.
    """
    out = [(1, None, [0, matrix.n_rows], ())]
    start, rate, cap = SECOND
    # One more cut than can be admitted tells enough.
    found = cuts.exponential_cuts(matrix, start, rate, cap)
    points = [r["cut"] for r in found.orderBy("cut").limit(MOST_BLOCKS + 2).collect()]
    fits = 2 <= len(points) - 1 <= MOST_BLOCKS
    out.append((2, SECOND, points, (Step("row_div", {"start": start, "rate": rate, "cap": cap}),) if fits else None))
    in_order = bool(features.sorted_by_length(matrix).first()["descending"])
    sort, seen = () if in_order else (Step("coarse_sort", {"every": 1}),), set()
    for p, points in sorted_cuts(matrix, THIRD).items():
        fits = len(points) - 1 <= MOST_BLOCKS and tuple(points) not in seen
        seen.add(tuple(points))
        divide = (Step("row_div", {"cuts": points}),) if len(points) > 2 else ()
        out.append((3, p, points, (*sort, *divide) if fits else None))
    return out


def split_time(total: float, shares: tuple[float, ...] = (0.1, 0.25, 1.0), used: float = 0.95) -> list[float]:
    """Seconds for each matrix strategy: a share of what is left, the next ones get the rest."""
    out, left = [], total * used
    for share in shares:
        out.append(left * share)
        left -= out[-1]
    return out


def trial(matrix: SparseMatrix, x: DataFrame, plan: Plan, timer: Callable[[], float], check: bool = True) -> tuple:
    """One row of the log: operations, options, template, numbers and products per second (0 for an unsupported partition)."""
    began = timer()
    try:
        run(matrix, plan, x, check=check).write.format("noop").mode("overwrite").save()
        metric = 1.0 / max(timer() - began, 1e-9)
    except ValueError:
        metric = 0.0
    steps = [*plan.dense, *plan.levels]
    params = [float(v) for s in steps for v in s.params.values() if isinstance(v, int | float)]
    return [s.name for s in steps], sorted({k for s in steps for k in s.params}), plan.strategy, params, metric


def search(matrix: SparseMatrix, x: DataFrame, plans: Iterable[Plan], budget: Budget, timer: Callable[[], float] = time.perf_counter) -> DataFrame:
    """The log of trials: each plan's operations, options and products per second."""
    rows = []
    for plan in plans:
        rows.append(trial(matrix, x, plan, timer))
        if not budget.tell(rows[-1][-1]):
            break
    return matrix.spark.createDataFrame(rows, LOG)


def parts_of(matrix: SparseMatrix, dense: tuple[Step, ...]) -> list[SparseMatrix]:
    """The blocks of a prepared matrix, at most MOST_BLOCKS by the gates, each with all dimensions and one block number.

    A block's entries are numbered and kept here, so that no trial deals, sorts or numbers them again.
    """
    ready = prepare(matrix, Plan((*dense, Step("compress"))))
    ready = ready.held()
    blocks, parts = sorted(r["block"] for r in ready.entries.select("block").distinct().collect()), []
    for n in blocks:
        own = ready.with_entries(ready.entries.filter(F.col("block") == n), kept=True)
        placed = keep(numbered(own))
        parts.append(own.with_entries(placed.drop("rn", "k", "nz"), kept=True, numbers=placed))
    return parts


def shortlist(matrix: SparseMatrix, plans: list[Plan], model=None, is_sorted: bool = False, settings: dict | None = None) -> list[tuple[Plan, list[float]]]:
    """Plans that are worth a trial, with their features: those whose facts admit the template, by one scan of the row lengths.

    Where no plan is admitted by the narrower conditions, all supported ones are left. model: of the log; the plans come in
    the order of its predictions, and in list order without one.
    """
    bound = (settings or corpus.settings())["padding_rate_up_bound"]
    rows = facts.plan_facts(matrix, plans, is_sorted, bound).orderBy("plan").collect()
    left = [r for r in rows if r["admitted"]] or [r for r in rows if r["reason"] == "narrower"]
    out = [(plans[r["plan"]], learn.plan_features(plans[r["plan"]], r.asDict())) for r in left]
    return learn.in_order(model, out, matrix.spark)


def search_blocks(matrix: SparseMatrix, x: DataFrame, dense: tuple[Step, ...], budget: Budget, timer: Callable[[], float] = time.perf_counter, log: DataFrame | None = None, parts: list[SparseMatrix] | None = None) -> list[tuple[Plan, float]]:
    """The best plan of each block by the metric, the direct one where nothing else is supported.

    parts: the blocks, where they are known. log: features and targets of earlier trials; a model of it that explains them orders the trials.
    """
    model, out = learn.surrogate(log) if log is not None else None, []
    for part in parts if parts is not None else parts_of(matrix, dense):
        chosen = (Plan((Step("compress"),), (), "direct"), 0.0)
        for plan, _ in shortlist(part, candidates(part), model):
            metric = trial(part, x, plan, timer, check=False)[-1]
            if metric > chosen[1]:
                chosen = (plan, metric)
            if not budget.tell(metric):
                break
        out.append(chosen)
    return out


def guided_search(matrix: SparseMatrix, x: DataFrame, plans: list[Plan], log: DataFrame | None, budget: Budget, timer: Callable[[], float] = time.perf_counter) -> DataFrame:
    """The log of trials in the order that a model of an earlier log predicts: record, features and target of each."""
    rows = []
    for plan, own in shortlist(matrix, plans, learn.surrogate(log) if log is not None else None):
        metric = trial(matrix, x, plan, timer, check=False)[-1]
        rows.append((plan.record(), own, metric))
        if not budget.tell(metric):
            break
    return matrix.spark.createDataFrame(rows, "record string, features array<double>, target double")


def run_blocks(matrix: SparseMatrix, x: DataFrame, dense: tuple[Step, ...], plans: Callable[[int], Plan], parts: list[SparseMatrix] | None = None) -> DataFrame:
    """row and y: each block by its plan, the blocks' sums added up, rows as they were before a sort. parts: the blocks, where they are known."""
    parts = parts if parts is not None else parts_of(matrix, dense)
    plain = [p if p.row_map is None else replace(p, row_map=None) for p in parts]
    each = [run(p, plans(i), x, check=False).filter("y != 0") for i, p in enumerate(plain)]
    if not each:
        return products.complete(matrix, matrix.entries.select("row", F.lit(0.0).alias("y")).filter("false"))
    sums = functools.reduce(DataFrame.unionByName, each).groupBy("row").agg(F.sum("y").alias("y"))
    if parts[0].row_map is None:
        return products.complete(matrix, sums)
    back = parts[0].row_map.join(sums, F.col("new_row") == F.col("row"), "left")
    return back.select(F.col("old_row").alias("row"), F.coalesce("y", F.lit(0.0)).alias("y"))


def whole_search(matrix: SparseMatrix, x: DataFrame, seconds: float = 32_400.0, steps: int = 10, timer: Callable[[], float] = time.perf_counter) -> tuple[tuple[Step, ...], list[Plan], float]:
    """The dense steps and block plans with the best metric over all admitted strategies, each within its share of the time."""
    best_found: tuple = ((), [], 0.0)
    matrix = matrix.held()
    admitted = matrix_strategies(matrix)
    for number, share in zip((1, 2, 3), split_time(seconds), strict=True):
        until = timer() + share
        for strategy, _, _, dense in admitted:
            if strategy != number or dense is None or timer() >= until:
                continue
            parts = parts_of(matrix, dense)
            plans = [plan for plan, _ in search_blocks(matrix, x, dense, Budget(steps=steps, seconds=until - timer()), timer, parts=parts)]
            began = timer()
            run_blocks(matrix, x, dense, plans.__getitem__, parts).write.format("noop").mode("overwrite").save()
            metric = 1.0 / max(timer() - began, 1e-9)
            if metric > best_found[2]:
                best_found = (dense, plans, metric)
    return best_found


#: Threads that a template is tried with: first, last and step.
THREADS = {"direct_warp_block_compress": (32, 256, 32), "direct_warp_reduce": (32, 512, 64), "unaligned_warp_reduce": (64, 256, 64)}
MOST_GROUPS = 65_534


def template_params(work: DataFrame) -> DataFrame:
    """template, threads and groups (of that many threads, capped) for each choice of threads. work: template and work (its threads in all)."""
    ranges = F.create_map(*[F.lit(y) for t, r in THREADS.items() for y in (t, F.sequence(*[F.lit(n) for n in r]))])
    each = work.withColumn("threads", F.explode(ranges[F.col("template")]))
    return each.select("template", "threads", F.least(F.ceil(F.col("work") / F.col("threads")), F.lit(MOST_GROUPS)).alias("groups"))


def best(log: DataFrame) -> DataFrame:
    """One row: the trial with the largest metric."""
    top = log.agg(F.max_by(F.struct("ops", "strategies", "template", "params"), "metric").alias("trial"), F.max("metric").alias("metric"))
    return top.select("trial.*", "metric")


def append_log(log: DataFrame, path: str) -> None:
    """Adds trials to the Parquet log at path."""
    log.write.mode("append").parquet(path)


def write_report(log: DataFrame, path: str) -> None:
    """The best trial as JSON, over what was there."""
    best(log).coalesce(1).write.mode("overwrite").json(path)
