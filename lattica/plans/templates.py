"""Reduction templates: which of them a partition into three levels supports, which are worth trying, and their products.

Levels are the columns blb, wlb (inside blb) and tlb (inside a row) of division.nested() or levels.Levels.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators import products

#: Threads of one block that a block-wide buffer can hold.
MOST_THREADS = 3950

#: Template -> (what is summed in turn, condition on the facts of a partition).
TEMPLATES = {
    "direct": ("row", "true"),
    "direct_warp_compress": ("row", "uneven_blbs = 0"),
    "direct_warp_block_compress": ("row", "min_tlb = max_tlb"),
    "shared_memory": ("blb, row, tlb", f"tlbs_of_row > 1 and shared_rows = 0 and tlbs_of_blb <= {MOST_THREADS}"),
    "shared_memory_warp_compress": ("blb, row", f"tlbs_of_row > 1 and shared_rows = 0 and tlbs_of_blb <= {MOST_THREADS} and uneven_blbs = 0"),
    "shared_memory_long_row": ("blb", "rows_of_blb = 1"),
    "shared_memory_warp_reduce": ("blb, row, wlb", "shared_rows = 0 and rows_of_wlb = 1 and wlbs_of_row > 1"),
    "direct_warp_reduce": ("wlb", "rows_of_wlb = 1"),
    "unaligned_warp_reduce": ("tlb, row", "blbs = 1 and wlbs = 1"),
}
#: Further conditions of support, on facts that only some layouts have.
MOST_WARPS = 47_995
BESIDES = {
    "direct": "pad_rows = 0",
    "shared_memory": "pad_rows = 0",
    "shared_memory_warp_reduce": f"wlbs_of_blb <= {MOST_WARPS}",
    "unaligned_warp_reduce": "pad_rows = 0",
}
#: Where a supported template is worth a trial: it has the levels that its sums are about.
NARROWER = {
    "direct": "blbs <> 1 and wlbs <> blbs and wlbs <> 1",
    "direct_warp_compress": "wlbs = blbs and blbs <> 1",
    "direct_warp_block_compress": "blbs = 1 and wlbs = 1",
    "shared_memory": "blbs <> 1 and wlbs <> blbs",
    "shared_memory_warp_compress": "wlbs = blbs and blbs <> 1",
    "shared_memory_long_row": "wlbs = blbs and max_tlb = 1",
    "shared_memory_warp_reduce": "blbs > 1 and wlbs <> blbs and max_tlb = 1",
    "direct_warp_reduce": "blbs = 1 and wlbs > 8 and max_tlb = 1",
    "unaligned_warp_reduce": "not is_sorted",
}
#: Supported where another template is.
AS = {"unaligned_total_warp_reduce": "unaligned_warp_reduce"}
#: Sums in turn, each by its columns; a column in brackets is one that the layout fixes for the others, and is carried along.
TREES = {
    "direct": (("block", "blb", "wlb", "tlb", "row"), ("row",)),
    "direct_warp_compress": (("block", "blb", "tlb", "row"), ("row",)),
    "direct_warp_block_compress": (("block", "tlb", "row"), ("row",)),
    "shared_memory": (("block", "blb", "wlb", "tlb", "row"), ("block", "blb", "row"), ("row",)),
    "shared_memory_warp_compress": (("block", "blb", "tlb", "row"), ("block", "blb", "row"), ("row",)),
    "shared_memory_long_row": (("block", "blb", "(row)"), ("row",)),
    "shared_memory_warp_reduce": (("block", "blb", "wlb", "(row)"), ("block", "blb", "row"), ("row",)),
    "direct_warp_reduce": (("block", "blb", "wlb", "(row)"), ("row",)),
    "unaligned_warp_reduce": (("tlb", "row"), ("row",)),
    "unaligned_total_warp_reduce": (("tlb", "row"), ("warp", "row"), ("row",)),
    "empty": (),
}
#: Threads of a warp whose sums of one row are added up first.
WARP = 32
#: A template on the left is left out when one on the right of it is supported: it does the same with fewer levels.
DOMINATED = (
    ("direct", ("direct_warp_compress", "direct_warp_block_compress", "direct_warp_reduce")),
    ("direct_warp_compress", ("direct_warp_block_compress",)),
    ("shared_memory", ("shared_memory_warp_compress", "shared_memory_long_row", "shared_memory_warp_reduce")),
    ("shared_memory_warp_compress", ("shared_memory_long_row",)),
)


def product(tagged: DataFrame, matrix: SparseMatrix, x: DataFrame, template: str) -> DataFrame:
    """row and y of a partitioned matrix, summed along a template's tree. Pads are left out: a pad times an infinite x would not be 0."""
    if template not in TREES:
        raise ValueError(f"no template {template}")
    if template == "empty":
        return matrix.rows().select("row", F.lit(0.0).alias("y"))
    keys = [c for c in ("block", "blb", "wlb", "tlb") if c in tagged.columns]
    real = tagged.filter(~F.col("is_pad")) if "is_pad" in tagged.columns else tagged
    sums = products.gather(matrix.with_entries(real.select("row", "col", "val", *keys)), x, tuple(keys), matrix.entries).withColumnRenamed("product", "y")
    for by in TREES[template]:
        if "warp" in by:
            sums = sums.withColumn("warp", F.floor(F.col("tlb") / WARP))
        fixed = [c[1:-1] for c in by if c.startswith("(")]
        names = [c for c in by if not c.startswith("(") and c in sums.columns]
        sums = sums.groupBy(*names).agg(F.sum("y").alias("y"), *[F.min(c).alias(c) for c in fixed])
    return products.complete(matrix, sums)


def facts(tagged: DataFrame) -> DataFrame:
    """One row of counts that the templates' conditions are about."""
    size = F.max("width") if "width" in tagged.columns else F.count("*")  # a thread's pads count
    if "block" in tagged.columns:  # the parts of a divided matrix have blocks of their own
        tagged = tagged.withColumn("blb", F.struct("block", "blb"))
    chunks = tagged.groupBy("blb", "wlb", "row", "tlb").agg(size.alias("size"))
    by_row = chunks.groupBy("row").agg(F.count("*").alias("t"), F.count_distinct("blb", "wlb").alias("w"), F.count_distinct("blb").alias("b"))
    rows = by_row.agg(F.max("t").alias("tlbs_of_row"), F.max("w").alias("wlbs_of_row"), F.count_if(F.col("b") > 1).alias("shared_rows"))
    by_blb = chunks.groupBy("blb").agg(F.count("*").alias("t"), F.count_distinct("row").alias("r"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    blbs = by_blb.agg(
        F.count("*").alias("blbs"), F.max("t").alias("tlbs_of_blb"), F.max("r").alias("rows_of_blb"), F.count_if(F.col("lo") != F.col("hi")).alias("uneven_blbs"),
        F.min("lo").alias("min_tlb"), F.max("hi").alias("max_tlb"),
    )
    warps = chunks.groupBy("blb", "wlb").agg(F.count_distinct("row").alias("r")).agg(F.count("*").alias("wlbs"), F.max("r").alias("rows_of_wlb"))
    return rows.join(F.broadcast(blbs)).join(F.broadcast(warps))  # one row each


_SIGNS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def holds(condition: str, facts: dict) -> bool:
    """Whether a condition of the tables above holds: comparisons of a fact with a fact or number, joined by `and`."""
    for part in condition.split(" and "):
        words = part.split()
        if words[0] == "not":
            held = not facts[words[1]]
        elif len(words) == 1:
            held = words[0] == "true"
        else:
            value = lambda w: facts[w] if w in facts else int(w)
            held = _SIGNS[words[1]](value(words[0]), value(words[2]))
        if not held:
            return False
    return True


def supported(tagged: DataFrame) -> DataFrame:
    """template and its sums, for each template that the partition supports."""
    named = F.array(*[F.struct(F.lit(name).alias("template"), F.lit(sums).alias("sums"), F.coalesce(F.expr(test), F.lit(False)).alias("ok")) for name, (sums, test) in TEMPLATES.items()])
    return facts(tagged).select(F.explode(named).alias("t")).filter("t.ok").select("t.template", "t.sums")


def _several(columns: list[str]) -> Column:
    """Whether any of the columns has more than one value in a group; a look at both ends, where a count of different values would be dealt out once more."""
    return functools.reduce(operator.or_, [F.min(c) != F.max(c) for c in columns])


def facts_for(tagged: DataFrame, condition: str) -> dict:
    """The facts that a condition names, and no others. Numbers that conditions only compare with 1 are told as 1 or 2 (several)."""
    blb = ["block", "blb"] if "block" in tagged.columns else ["blb"]
    wlb = [*blb, "wlb"]
    tables = {
        "row": (["row"], {"tlbs_of_row": _several([*wlb, "tlb"]), "wlbs_of_row": _several(wlb), "shared_rows": _several(blb)}),
        "blb": (blb, {"rows_of_blb": _several(["row"])}),
        "wlb": (wlb, {"rows_of_wlb": _several(["row"])}),
        "all": ([], {"blbs": _several(blb), "wlbs": _several(wlb)}),
    }
    named, found = set(condition.split()), {}
    for keys, several in tables.values():
        if own := {name: is_so for name, is_so in several.items() if name in named}:
            groups = tagged.groupBy(*keys).agg(*[is_so.alias(name) for name, is_so in own.items()])
            told = [(F.count_if(name) if name == "shared_rows" else F.max(F.col(name).cast("int")) + 1).alias(name) for name in own]
            found |= groups.agg(*told).first().asDict()
    if named & {"tlbs_of_blb", "uneven_blbs", "min_tlb", "max_tlb"}:
        size = F.max("width") if "width" in tagged.columns else F.count("*")  # a thread's pads count
        chunks = tagged.groupBy(*wlb, "row", "tlb").agg(size.alias("size")).groupBy(*blb).agg(F.count("*").alias("t"), F.min("size").alias("lo"), F.max("size").alias("hi"))
        sums = (F.max("t").alias("tlbs_of_blb"), F.count_if(F.col("lo") != F.col("hi")).alias("uneven_blbs"), F.min("lo").alias("min_tlb"), F.max("hi").alias("max_tlb"))
        found |= chunks.agg(*sums).first().asDict()
    return found


def most_warps(tagged: DataFrame) -> int:
    """Most warps of a block, or a bound of it that MOST_WARPS allows: they are counted only where their numbers span more."""
    span = tagged.groupBy("block", "blb").agg((F.max("wlb") - F.min("wlb") + 1).alias("n")).agg(F.max("n")).first()[0] or 0
    if span <= MOST_WARPS:
        return span
    return tagged.select("block", "blb", "wlb").distinct().groupBy("block", "blb").count().agg(F.max("count")).first()[0]


def supports(tagged: DataFrame, template: str) -> bool:
    """Whether a partition supports a template; `empty` only suits a matrix without entries. Only the facts that its conditions name are looked up."""
    if template == "empty":
        return tagged.isEmpty()
    name = AS.get(template, template)
    if name in BESIDES and "is_pad" in tagged.columns:
        besides = BESIDES[name]
        pads = 0 if "pad_rows" not in besides or tagged.filter("is_pad").isEmpty() else 1
        warps = most_warps(tagged) if "wlbs_of_blb" in besides else 0
        if not holds(besides, {"pad_rows": pads, "wlbs_of_blb": warps}):
            return False
    condition = TEMPLATES[name][1]
    own = facts_for(tagged, condition)
    return None not in own.values() and holds(condition, own)


def worth_trying(names: set[str]) -> set[str]:
    """What is left when dominated templates are taken away, until nothing changes."""
    left = set(names)
    while True:
        out = {name for name, better in DOMINATED if name in left and left & set(better)}
        if not out:
            return left
        left -= out
