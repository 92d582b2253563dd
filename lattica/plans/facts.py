"""Facts of many plans at once, from the row lengths alone.

What the templates' conditions look at follows from how long rows are and in which block each lies; no plan has to be
laid out for it. Plans share their blocks: all of them together need a dozen ways to put rows into blocks and a
dozen widths of chunks. One aggregate over rows x ways gives each block's counts for all widths, a second one over the
blocks gives a row for each way, and every plan's facts are arithmetic on these few rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators import cuts, levels
from lattica.operators.order import intervals, running_sum
from lattica.plans import templates
from lattica.session import cut

if TYPE_CHECKING:
    from lattica.plans.graph import Plan

FACTS = ("tlbs_of_row", "wlbs_of_row", "shared_rows", "blbs", "tlbs_of_blb", "rows_of_blb", "uneven_blbs", "min_tlb", "max_tlb", "wlbs", "rows_of_wlb")
#: Besides those of templates.facts(): rows of padding, warps of a block, entries stored for each entry of the matrix.
MORE = ("pad_rows", "wlbs_of_blb", "padding_ratio")
MOST_PADDING = 4.0


@dataclass(frozen=True)
class Shape:
    """What a plan's level steps come to: how rows are put into blocks, and what is cut in them."""

    pad: int = 1
    height: int | None = None
    least: int | None = None
    blb_cols: int | None = None
    merge_tail: bool = True
    wlb_cols: int | None = None
    #: "row" for a thread per segment, a width, or ("nnz", size).
    thread: object = 1

    @staticmethod
    def of(plan: Plan) -> Shape:
        own = {}
        for step in plan.levels:
            p = step.params
            if p.get("empty_rows"):
                raise ValueError("rows without entries have facts by laying them out only")
            if step.name == "row_pad":
                own["pad"] = p["multiple"]
            elif step.name == "blb_row":
                own["height" if "height" in p else "least"] = p.get("height", p.get("least"))
            elif step.name == "blb_col" and "from" not in p:
                own |= {"blb_cols": p["size"], "merge_tail": p.get("merge_tail", True)}
            elif step.name == "wlb_col":
                own["wlb_cols"] = p["size"]
            elif step.name == "tlb_row":
                own["thread"] = "row"
            elif step.name == "tlb_col":
                own["thread"] = p["size"]
            elif step.name == "tlb_nnz":
                own["thread"] = ("nnz", p["size"])
            else:
                raise ValueError(f"{step.name} has facts by laying it out only")
        if sum(k in own for k in ("wlb_cols", "blb_cols")) + (own.get("thread", 1) != 1) > 1:
            raise ValueError("one cut of rows a plan")
        return Shape(**own)

    @property
    def blocks(self) -> tuple:
        return self.pad, self.height, self.least


def known(plan: Plan) -> bool:
    """Whether a plan's facts follow from the row lengths."""
    try:
        Shape.of(plan)
    except ValueError:
        return False
    return True


def _per_row(shapes: list[Shape]) -> dict[str, Column]:
    """Columns of a row of k entries, the first of which is number `start`: chunks for each width that some plan has."""
    k, start, out = F.col("k"), F.col("start"), {}
    for s in shapes:
        if s.blb_cols:
            n, whole = levels.chunks(k, s.blb_cols, s.merge_tail), f"b{s.blb_cols}_{int(s.merge_tail)}"
            out |= {whole: n, f"{whole}_top": F.when(n == 1, k).otherwise(F.greatest(F.lit(s.blb_cols), k - (n - 1) * s.blb_cols))}
        for w in (s.wlb_cols, s.thread if isinstance(s.thread, int) else None):
            if w and w != 1:
                out[f"c{w}"] = F.ceil(k / w)
        if isinstance(s.thread, tuple):
            w = s.thread[1]
            first, n = w - F.pmod(start, F.lit(w)), F.floor((start + k - 1) / w) - F.floor(start / w) + 1
            last = F.pmod(start + k - 1, F.lit(w)) + 1
            out |= {f"n{w}": n, f"n{w}_low": F.when(n == 1, k).otherwise(F.least(first, last)), f"n{w}_top": F.when(n == 1, k).when(n > 2, F.lit(w)).otherwise(F.greatest(first, last))}
    return {name: c.cast("long") for name, c in out.items()}


def block_counts(matrix: SparseMatrix, plans: list[Plan]) -> dict[tuple, dict]:
    """For each way to put rows into blocks that a plan has: counts over its blocks."""
    shapes = [Shape.of(p) for p in plans]
    ways = sorted({s.blocks for s in shapes}, key=repr)
    low = F.col("row_lo") if "row_lo" in matrix.entries.columns else F.lit(0).cast("long")
    if matrix.numbers is not None:  # a row's first entry tells
        rows = matrix.numbers.filter("rn = 0").select("row", "k", low.alias("row_lo"), F.col("nz").alias("start"))
    else:
        rows = matrix.entries.groupBy("row").agg(F.count("*").alias("k"), F.min(low).alias("row_lo"))
        rows = running_sum(rows, "row", "k", "start")
    for least in sorted({s.least for s in shapes if s.least}):
        blocks = intervals(rows, cuts.least_nnz_cuts(matrix, least)).withColumnRenamed("range", f"least{least}")
        rows = blocks.drop("low")
    # Rows of padding hold one entry, at the matrix's end.
    end = rows if matrix.numbers is not None and not any(s.least for s in shapes) else cut(rows)
    nnz, low_all = end.agg(F.sum("k"), F.max("row_lo")).first()
    made, ids = _per_row(shapes), []
    for i, (pad, height, least) in enumerate(ways):
        block = F.floor((F.col("row") - F.col("row_lo")) / height) if height else F.col(f"least{least}") if least else F.lit(0).cast("long")
        ids.append(F.struct(F.lit(i).alias("way"), block.cast("long").alias("blb")))
    real = end.select("row", "k", *[c.alias(n) for n, c in made.items()], F.explode(F.array(*ids)).alias("x")).select("k", *made, "x.way", "x.blb", F.lit(False).alias("pad"))
    padded = {}
    for i, (pad, height, _) in enumerate(ways):
        added = -matrix.n_rows % pad if nnz else 0
        padded[i] = added
        if added:
            row = F.col("id") - (low_all or 0)
            more = matrix.spark.range(matrix.n_rows, matrix.n_rows + added).select(F.lit(1).cast("long").alias("k"), F.lit(nnz).alias("start"), F.lit(i).alias("way"), (F.floor(row / height) if height else F.lit(0)).cast("long").alias("blb"), F.lit(True).alias("pad"))
            real = real.unionByName(more.select("k", *[c.alias(n) for n, c in made.items()], "way", "blb", "pad"))
    tops = [n for n in made if n.endswith("_top")]
    lows = [n for n in made if n.endswith("_low")]
    counted = ["k", *[n for n in made if n not in (*tops, *lows)]]
    agg = [F.count("*").alias("rows"), *[F.sum(n).alias(f"{n}_sum") for n in counted], *[F.max(n).alias(f"{n}_max") for n in counted], *[F.max(n).alias(n) for n in tops], *[F.min(n).alias(n) for n in lows]]
    agg += [F.count_if(F.col(n) > 1).alias(f"{n}_many") for n in counted if n.startswith("b")]
    by_block = real.groupBy("way", "blb").agg(*agg)
    over = [F.count("*").alias("blbs"), F.max("rows").alias("rows_most"), F.sum("rows").alias("rows"), F.min("k_max").alias("widest_low"), F.sum("k_max").alias("widths")]
    over += [x for n in counted for x in (F.sum(f"{n}_sum").alias(f"{n}_total"), F.max(f"{n}_sum").alias(f"{n}_block"), F.max(f"{n}_max").alias(f"{n}_most"))]
    over += [F.max(n).alias(n) for n in tops] + [F.min(n).alias(n) for n in lows] + [F.sum(f"{n}_many").alias(f"{n}_many") for n in counted if n.startswith("b")]
    return {ways[r["way"]]: r.asDict() | {"pad_rows": padded[r["way"]], "nnz": nnz, "n_rows": matrix.n_rows} for r in by_block.groupBy("way").agg(*over).collect()}


def facts_from(counts: dict, shape: Shape) -> dict[str, float]:
    """A plan's facts from the counts of its blocks."""
    c, one = counts, {"shared_rows": 0, "blbs": counts["blbs"], "rows_of_blb": counts["rows_most"], "uneven_blbs": 0, "pad_rows": counts["pad_rows"]}
    n = lambda w: "k" if w == 1 else f"c{w}"
    if isinstance(shape.thread, tuple):
        w = f"n{shape.thread[1]}"
        return one | {
            "tlbs_of_row": c[f"{w}_most"], "wlbs_of_row": 1, "tlbs_of_blb": c[f"{w}_block"], "uneven_blbs": int(c[f"{w}_low"] != c[f"{w}_top"]), "min_tlb": c[f"{w}_low"], "max_tlb": c[f"{w}_top"],
            "wlbs": 1, "rows_of_wlb": c["rows_most"], "wlbs_of_blb": 1, "padding_ratio": 1.0,
        }
    if shape.blb_cols:
        b = f"b{shape.blb_cols}_{int(shape.merge_tail)}"
        total = c[f"{b}_total"]
        return one | {
            "tlbs_of_row": c["k_most"], "wlbs_of_row": c[f"{b}_most"], "shared_rows": c[f"{b}_many"], "blbs": total, "tlbs_of_blb": c[f"{b}_top"], "rows_of_blb": 1, "min_tlb": 1, "max_tlb": 1,
            "wlbs": total, "rows_of_wlb": 1, "wlbs_of_blb": 1, "padding_ratio": 1.0,
        }
    if shape.wlb_cols:
        w = n(shape.wlb_cols)
        return one | {
            "tlbs_of_row": c["k_most"], "wlbs_of_row": c[f"{w}_most"], "tlbs_of_blb": c["k_block"], "min_tlb": 1, "max_tlb": 1, "wlbs": c[f"{w}_total"], "rows_of_wlb": 1,
            "wlbs_of_blb": c[f"{w}_block"], "padding_ratio": c["k_total"] / max(c["nnz"], 1),
        }
    warps = {"wlbs_of_row": 1, "wlbs": c["blbs"], "rows_of_wlb": c["rows_most"], "wlbs_of_blb": 1}
    if shape.thread == "row":
        # Every band, empty ones too, is as high as the step says; one block is as high as the matrix.
        stored = c["widths"] * shape.height if shape.height else c["k_most"] * (c["n_rows"] + c["pad_rows"])
        return one | warps | {"tlbs_of_row": 1, "tlbs_of_blb": c["rows_most"], "min_tlb": c["widest_low"], "max_tlb": c["k_most"], "padding_ratio": stored / max(c["nnz"], 1)}
    w = n(shape.thread)
    return one | warps | {"tlbs_of_row": c[f"{w}_most"], "tlbs_of_blb": c[f"{w}_block"], "min_tlb": shape.thread, "max_tlb": shape.thread, "padding_ratio": c[f"{w}_total"] * shape.thread / max(c["nnz"], 1)}


def verdict(template: str, facts: dict | None, is_sorted: bool = False, most_padding: float = MOST_PADDING) -> str:
    """Why a plan is not worth a trial: support, padding or narrower; empty if it is."""
    if facts is None:
        return "" if template == "empty" else "support"
    name = templates.AS.get(template, template)
    own = facts | {"is_sorted": is_sorted}
    if template == "empty" or not templates.holds(templates.TEMPLATES[name][1], own) or not templates.holds(templates.BESIDES.get(name, "true"), own):
        return "support"
    if facts["padding_ratio"] > most_padding:
        return "padding"
    return "" if templates.holds(templates.NARROWER[name], own) else "narrower"


def supports(matrix: SparseMatrix, plan: Plan) -> bool:
    """Whether the partition that a plan would make of an undivided matrix supports its template."""
    shape = Shape.of(plan)
    counts = block_counts(matrix, [plan])
    return verdict(plan.strategy, facts_from(counts[shape.blocks], shape) if counts else None, most_padding=float("inf")) != "support"


def plan_facts(matrix: SparseMatrix, plans: list[Plan], is_sorted: bool = False, most_padding: float = MOST_PADDING) -> DataFrame:
    """plan (its place in the list), record, template, the facts, admitted and reason (support, padding, narrower or empty)."""
    counts, rows = block_counts(matrix, plans), []
    for i, plan in enumerate(plans):
        shape = Shape.of(plan)
        facts = facts_from(counts[shape.blocks], shape) if shape.blocks in counts else None
        why = verdict(plan.strategy, facts, is_sorted, most_padding)
        got = facts or dict.fromkeys((*FACTS, *MORE))
        rows.append((i, plan.record(), plan.strategy, *[got[f] if got[f] is None else int(got[f]) for f in (*FACTS, *MORE[:2])], None if got["padding_ratio"] is None else float(got["padding_ratio"]), why == "", why))
    kinds = ", ".join(f"{f} long" for f in (*FACTS, *MORE[:2]))
    return matrix.spark.createDataFrame(rows, f"plan long, record string, template string, {kinds}, padding_ratio double, admitted boolean, reason string")
