"""Queries of plans, templates, the search, readers and writers, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica.catalog import Y_SQL, base, matrix, on, query, table, vector
from lattica.functions import formulas
from lattica.functions.block_forms import block_forms
from lattica.model import SparseMatrix
from lattica.operators import cuts, division, levels, products, runs, sorting
from lattica.operators.cuts import exponential_cuts
from lattica.plans import facts, graph, learn, templates, tuner
from lattica.plans.graph import Plan, Step
from lattica.session import shared_dir
from lattica.sources import compressed, corpus, store, text


def plan(*steps: Step, dense: tuple[Step, ...] = (), template: str = "direct") -> Plan:
    return Plan((*dense, Step("compress")), steps, template)


def lowered(m: SparseMatrix, p: Plan) -> levels.Levels:
    return graph.lower(graph.prepare(m, p), p)


def level_table(name: str, level: str, sql: str, *steps: Step, dense: tuple[Step, ...] = ()) -> None:
    on(lambda m: levels.table(lowered(m, plan(*steps, dense=dense)), level), name, base(sql))


BLB, NNZ = "min(r) AS first_row, max(r) - min(r) + 1 AS n_rows, count(*) AS nnz", "CAST(0 AS BIGINT) AS block"
#: Chunks of a row by size 4 whose rest under half joins the last full chunk.
TAIL = "least(rn // 4, CASE WHEN k // 4 > 0 AND (k % 4) * 2 < 4 THEN k // 4 ELSE k // 4 + CASE WHEN k % 4 > 0 THEN 1 ELSE 0 END END - 1)"
ROWS = "(SELECT nz.*, len.k FROM nz JOIN len ON len.r = nz.r)"

# Levels.
level_table("plan_blb_rows", "blb", f"SELECT {NNZ}, r // 512 AS blb, {BLB} FROM m GROUP BY 1, 2", Step("blb_row", {"height": 512}))
level_table("plan_blb_cols", "blb", f"SELECT {NNZ}, dense_rank() OVER (ORDER BY r, q) - 1 AS blb, {BLB} FROM (SELECT r, {TAIL} AS q FROM {ROWS}) GROUP BY r, q", Step("blb_col", {"size": 4}))
level_table(
    "plan_blb_cols_chosen", "blb",
    f"SELECT {NNZ}, dense_rank() OVER (ORDER BY r, q) - 1 AS blb, {BLB} FROM (SELECT r, CASE WHEN k >= 6 THEN {TAIL} ELSE 0 END AS q FROM {ROWS}) GROUP BY r, q",
    Step("blb_col", {"size": 4, "from": 6}),
)
level_table("plan_wlb_rows", "wlb", f"SELECT {NNZ}, CAST(0 AS BIGINT) AS blb, r // 32 AS wlb, {BLB} FROM m GROUP BY 1, 2, 3", Step("wlb_row", {"height": 32}))
level_table(
    "plan_wlb_cols", "wlb", f"SELECT {NNZ}, r // 512 AS blb, dense_rank() OVER (ORDER BY r, q) - 1 AS wlb, {BLB} FROM (SELECT r, rn // 3 AS q FROM nz) GROUP BY r, q",
    Step("blb_row", {"height": 512}), Step("wlb_col", {"size": 3}),
)
level_table(
    "plan_nested_cols", "wlb",
    f"SELECT {NNZ}, dense_rank() OVER (ORDER BY r, q) - 1 AS blb, dense_rank() OVER (ORDER BY r, q, p) - 1 AS wlb, {BLB} FROM (SELECT r, q, (rn - q * 4) // 3 AS p FROM (SELECT r, rn, {TAIL} AS q FROM {ROWS})) GROUP BY r, q, p",
    Step("blb_col", {"size": 4}), Step("wlb_col", {"size": 3}),
)
level_table("plan_tlb_nnz", "tlb", f"SELECT {NNZ}, CAST(0 AS BIGINT) AS blb, CAST(0 AS BIGINT) AS wlb, r AS \"row\", nz // 64 AS tlb, {BLB} FROM nz GROUP BY r, nz // 64", Step("tlb_nnz", {"size": 64}))


def ragged(m: SparseMatrix) -> levels.Levels:
    """Blocks of 512 rows, of which those of even number are cut into warps of a height of their own."""
    state = levels.blb_rows(levels.opened(m), 512)
    heights = state.entries.select("block", "blb").distinct().filter("blb % 2 = 0").withColumn("height", 16 * (F.col("blb") % 4 + 1))
    return levels.wlb_rows(state, heights)


on(lambda m: levels.table(ragged(m), "wlb"), "plan_wlb_rows_ragged", base(f"""
SELECT {NNZ}, r // 512 AS blb, CASE WHEN r // 512 % 2 = 0 THEN (r % 512) // (16 * (r // 512 % 4 + 1)) ELSE 0 END AS wlb, {BLB} FROM m GROUP BY 2, 3"""))


def stored(m: SparseMatrix):
    state = lowered(m, plan(Step("wlb_row", {"height": 32}), Step("tlb_row")))
    return levels.padded(state).groupBy("block", "blb", "wlb").agg(F.count("*").alias("stored"), F.count_if("is_pad").alias("pads"), (F.max("slot") + 1).alias("width"))


on(stored, "plan_tlb_rows_padded", base(f"""
SELECT {NNZ}, CAST(0 AS BIGINT) AS blb, r // 32 AS wlb, max(k) * count(*) AS stored, CAST(max(k) * count(*) - sum(k) AS BIGINT) AS pads, max(k) AS width
FROM len WHERE k > 0 GROUP BY r // 32"""))
on(
    lambda m: levels.interleaved(lowered(m, plan(Step("wlb_row", {"height": 32}), Step("tlb_col", {"size": 2})))).select("row", "col", "val", "is_pad", "position"),
    "plan_tlb_interleaved",
    base("""
, t AS (SELECT r, rn // 2 AS q, row_number() OVER (PARTITION BY r // 32 ORDER BY r, rn // 2) - 1 AS t, count(*) OVER (PARTITION BY r // 32) AS n, count(*) AS filled, max(c) AS last
        FROM nz GROUP BY r, rn // 2)
SELECT nz.r AS "row", c AS col, v AS val, false AS is_pad, rn % 2 * n + t AS position FROM nz JOIN t ON t.r = nz.r AND t.q = nz.rn // 2
UNION ALL SELECT r, last, 0, true, n + t FROM t WHERE filled = 1""".strip()),
)
PLACED = ("row", "col", "val", "is_pad", "position")
on(lambda m: levels.interleaved(lowered(m, plan(Step("tlb_col", {"size": 2})))).select(*PLACED), "plan_interleaved_one_warp", base("""
, t AS (SELECT r, rn // 2 AS q, row_number() OVER (ORDER BY r, rn // 2) - 1 AS t, count(*) OVER () AS n, count(*) AS filled, max(c) AS last FROM nz GROUP BY r, rn // 2)
SELECT nz.r AS "row", c AS col, v AS val, false AS is_pad, rn % 2 * n + t AS position FROM nz JOIN t ON t.r = nz.r AND t.q = nz.rn // 2
UNION ALL SELECT r, last, 0, true, n + t FROM t WHERE filled = 1""".strip()))
on(lambda m: levels.interleaved(lowered(m, plan(Step("wlb_row", {"height": 32}), Step("tlb_row", {"empty_rows": True})))).select(*PLACED), "plan_interleaved_empty_rows", base("""
, t AS (SELECT r, k, r - r // 32 * 32 AS t, count(*) OVER (PARTITION BY r // 32) AS n, greatest(max(k) OVER (PARTITION BY r // 32), 1) AS width FROM len),
last AS (SELECT r, max(c) AS c FROM m GROUP BY r)
SELECT nz.r AS "row", c AS col, v AS val, false AS is_pad, rn * n + t AS position FROM nz JOIN t ON t.r = nz.r
UNION ALL SELECT t.r, coalesce(c, (SELECT min(c) FROM m)), 0, true, s * n + t FROM (SELECT *, unnest(range(k, width)) AS s FROM t) t LEFT JOIN last ON last.r = t.r""".strip()))
on(lambda m: graph.run(m, plan(Step("wlb_row", {"height": 32}), Step("tlb_row", {"empty_rows": True}), dense=(Step("row_div", {"start": 4, "rate": 2, "cap": 8}),), template="direct"), vector(m), check=False), "spmv_slots_for_empty_rows", base(Y_SQL))
on(lambda m: levels.reduce_rows(lowered(m, plan(Step("tlb_nnz", {"size": 8})))), "plan_reduce_rows", base("""
SELECT tlb, tlb // 32 AS wlb, first_row, first_row - min(first_row) OVER (PARTITION BY tlb // 32) AS relative_row FROM (SELECT nz // 8 AS tlb, min(r) AS first_row FROM nz GROUP BY 1)"""))


def row_pads(m: SparseMatrix):
    state = lowered(m, plan(Step("row_pad", {"multiple": 4096}), Step("blb_row", {"height": 4096})))
    return state.entries.filter("is_pad").select("block", "blb", "row", "col", "val")


on(row_pads, "plan_row_pad", base(f"""
SELECT {NNZ}, i // 4096 AS blb, i AS "row", CAST(0 AS BIGINT) AS col, CAST(0 AS DOUBLE) AS val
FROM (SELECT unnest(range((SELECT nr FROM d), (SELECT (nr + 4095) // 4096 * 4096 FROM d))) AS i)"""))

# Dense steps.
SORT, DIVIDE = Step("coarse_sort"), Step("row_div", {"start": 2, "rate": 2, "cap": 8})
WINDOW = "CASE WHEN k >= 8 THEN 3 WHEN k >= 4 THEN 2 WHEN k >= 2 THEN 1 ELSE 0 END"


on(lambda m: cuts.step_bounds(m, 3), "coarse_sort_step_bounds", base("""
SELECT CAST(i AS BIGINT) AS i, CAST(CASE WHEN i = 0 THEN 0 ELSE lo + 3 * i END AS BIGINT) AS bound FROM (SELECT lo, unnest(range(0, (hi - lo) // 3 + 1)) AS i FROM (SELECT min(k) AS lo, max(k) AS hi FROM len))"""))
on(lambda m: sorting.coarse_by_step(m, 3), "coarse_sort_by_step", base("""
, b AS (SELECT r, CASE WHEN k = 0 THEN -1 ELSE (k - (SELECT min(k) FROM len)) // 3 END AS bin FROM len)
SELECT row_number() OVER (ORDER BY bin DESC, r) - 1 AS new_row, r AS old_row, CAST(bin AS BIGINT) AS bin FROM b""".strip()))
on(lambda m: graph.run(m, plan(Step("tlb_nnz", {"size": 32}), dense=(Step("fine_sort"), Step("row_pad_total", {"multiple": 1024})), template="unaligned_warp_reduce"), vector(m)), "spmv_fine_sorted_padded", base(Y_SQL))


def division_table(m: SparseMatrix, *dense: Step):
    ready = graph.prepare(m, plan(dense=dense))
    return ready.entries.groupBy("block").agg(F.min("row_lo").alias("row_lo"), F.count_distinct("row").alias("rows"), F.min("col_lo").alias("col_lo"), F.count("*").alias("nnz"))


on(lambda m: division_table(m, SORT, DIVIDE), "plan_row_div", base(f"""
, w AS (SELECT r, k, {WINDOW} AS w FROM len),
s AS (SELECT w, coalesce(CAST(sum(count(*)) OVER (ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS row_lo, count(*) FILTER (WHERE k > 0) AS n_rows, CAST(sum(k) AS BIGINT) AS nnz FROM w GROUP BY w)
SELECT row_number() OVER (ORDER BY row_lo) - 1 AS block, row_lo, n_rows AS "rows", (SELECT min(c) FROM m JOIN w ON w.r = m.r WHERE w.w = s.w) AS col_lo, nnz FROM s WHERE nnz > 0""".strip()))
on(lambda m: division_table(m, DIVIDE), "plan_row_div_unsorted", base(f"""
, w AS (SELECT r, k, {WINDOW} AS w FROM len),
g AS (SELECT r, k, sum(CASE WHEN w IS DISTINCT FROM p OR r = 0 THEN 1 ELSE 0 END) OVER (ORDER BY r) AS g FROM (SELECT r, k, w, lag(w) OVER (ORDER BY r) AS p FROM w)),
b AS (SELECT g, min(r) AS row_lo, count(*) FILTER (WHERE k > 0) AS n_rows, CAST(sum(k) AS BIGINT) AS nnz FROM g GROUP BY g)
SELECT row_number() OVER (ORDER BY row_lo) - 1 AS block, row_lo, n_rows AS "rows", col_lo, nnz
FROM b JOIN (SELECT g, min(c) AS col_lo FROM m JOIN g ON g.r = m.r GROUP BY g) c USING (g)""".strip()))
on(lambda m: graph.run(m, plan(Step("wlb_col", {"size": 4}), dense=(DIVIDE,), template="direct_warp_reduce"), vector(m)), "spmv_divided_unsorted", base(Y_SQL))
on(lambda m: division.row_ranges(m, m.rows().filter("row % 3 = 0 or row % 7 = 2").select(F.col("row").alias("cut")), with_low=True), "var_row_div_many", base("""
, c AS (SELECT r, CASE WHEN r % 3 = 0 OR r % 7 = 2 THEN 1 ELSE 0 END AS cut FROM allr),
g AS (SELECT r, sum(cut) OVER (ORDER BY r) AS g, max(CASE WHEN cut = 1 THEN r END) OVER (ORDER BY r) AS row_lo,
             coalesce(min(CASE WHEN cut = 1 THEN r END) OVER (ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), (SELECT nr FROM d)) AS row_hi FROM c)
SELECT m.r AS "row", c AS col, v AS val, row_lo, row_hi, dense_rank() OVER (ORDER BY g) - 1 AS block FROM m JOIN g ON g.r = m.r""".strip()))
on(lambda m: division_table(m, Step("row_div", {"cuts": [0, 100, 150, 700, m.n_rows]}), Step("col_div", {"width": 512})).select("row_lo", "rows", "col_lo", "nnz"), "plan_rows_and_cols", base("""
, b AS (SELECT r, c, CASE WHEN r >= 700 THEN 700 WHEN r >= 150 THEN 150 WHEN r >= 100 THEN 100 ELSE 0 END AS row_lo FROM m)
SELECT CAST(row_lo AS BIGINT) AS row_lo, count(DISTINCT r) AS "rows", min(c) AS col_lo, count(*) AS nnz FROM b GROUP BY row_lo, c // 512""".strip()))
on(lambda m: graph.relative(graph.prepare(m, plan(dense=(Step("col_div", {"width": 64}),)))), "plan_compress", base("""
SELECT b AS block, r AS rel_row, c - cl AS rel_col, v AS val FROM (SELECT dense_rank() OVER (ORDER BY c // 64) - 1 AS b, r, c, v, min(c) OVER (PARTITION BY c // 64) AS cl FROM m)"""))
on(lambda m: graph.index_widths(graph.prepare(m, plan(dense=(Step("col_div", {"width": 512}),)))), "plan_index_widths", base("""
SELECT block, CAST(CASE WHEN x < 256 THEN 8 WHEN x < 65536 THEN 16 ELSE 32 END AS BIGINT) AS row_bits, CAST(CASE WHEN y < 256 THEN 8 WHEN y < 65536 THEN 16 ELSE 32 END AS BIGINT) AS col_bits
FROM (SELECT dense_rank() OVER (ORDER BY c // 512) - 1 AS block, max(r) AS x, max(c) - min(c) AS y FROM m GROUP BY c // 512)"""))
on(lambda m: division.divided_again(division.row_bands(m, 5000), 1, 1000), "redivided_rows", base("""
SELECT r AS "row", c AS col, v AS val, dense_rank() OVER (ORDER BY CASE WHEN r // 5000 = 1 THEN 1000000 + r ELSE r // 5000 END // CASE WHEN r // 5000 = 1 THEN 1000 ELSE 1 END + CASE WHEN r // 5000 = 1 THEN 1000000 ELSE 0 END) - 1 AS block FROM m"""))


@query("SELECT count(*) AS n_rows, 3 * count(*) AS nnz, true AS full_rows, CAST(3 * count(*) AS DOUBLE) AS total FROM customer")
def plan_generated_input(spark, sf_dir):
    n = table(spark, sf_dir, "customer").count()
    made = graph.prepare(None, Plan((Step("generate", {"rows": n, "cols": 50, "per_row": 3, "seed": 4}), Step("compress"))), spark)
    rows = made.entries.groupBy("row").agg(F.count_distinct("col").alias("k"), F.sum("val").alias("v"))
    return rows.agg(F.count("*").alias("n_rows"), F.sum("k").alias("nnz"), (F.min("k") == F.max("k")).alias("full_rows"), F.sum("v").alias("total"))


def through_inputs(spark, m: SparseMatrix):
    """The product of a matrix that a plan reads from a file, minus that of a matrix it remembers, plus the plain one."""
    path = f"{shared_dir(spark)}/plan-input-{uuid.uuid4().hex}"
    text.write_coo(m, path)
    name = uuid.uuid4().hex
    graph.remember(name, m)
    one = graph.run(None, plan(Step("blb_row", {"height": 64}), dense=(Step("read_coo", {"path": path}),)), vector(m), spark)
    two = graph.run(None, plan(Step("tlb_nnz", {"size": 64}), dense=(Step("cached", {"name": name}),), template="unaligned_warp_reduce"), vector(m), spark)
    graph.forget(name)
    return one.join(two.withColumnRenamed("y", "y2"), "row").select("row", "y", "y2")


@query(base('SELECT r AS "row", y, y AS y2 FROM y', "supp_part"))
def plan_inputs(spark, sf_dir):
    return through_inputs(spark, matrix(spark, sf_dir, "supp_part"))


# Products along the templates' trees.
TEMPLATE_PLANS = {
    "spmv_tpl1_direct": plan(Step("blb_row", {"height": 512}), Step("wlb_col", {"size": 4}), Step("tlb_col", {"size": 2})),
    "spmv_tpl2_warp_compress": plan(Step("row_pad", {"multiple": 64}), Step("blb_row", {"height": 64}), Step("tlb_row"), template="direct_warp_compress"),
    "spmv_tpl3_warp_block_compress": plan(Step("row_pad", {"multiple": 32}), Step("tlb_row"), template="direct_warp_block_compress"),
    "spmv_tpl4_shared_memory": plan(Step("blb_row", {"height": 256}), Step("wlb_col", {"size": 4}), Step("tlb_col", {"size": 2}), template="shared_memory"),
    "spmv_tpl5_shared_memory_warp_compress": plan(Step("blb_row", {"least": 512}), Step("tlb_col", {"size": 4}), template="shared_memory_warp_compress"),
    "spmv_tpl6_long_row": plan(Step("blb_col", {"size": 4}), template="shared_memory_long_row"),
    "spmv_tpl7_shared_memory_warp_reduce": plan(Step("blb_row", {"height": 128}), Step("wlb_col", {"size": 3}), template="shared_memory_warp_reduce"),
    "spmv_tpl8_warp_reduce": plan(Step("wlb_col", {"size": 4}), template="direct_warp_reduce"),
    "spmv_tpl9_unaligned": plan(Step("tlb_nnz", {"size": 16}), template="unaligned_warp_reduce"),
    "spmv_tpl10_unaligned_total": plan(Step("tlb_nnz", {"size": 16}), template="unaligned_total_warp_reduce"),
    "spmv_sorted_divided": plan(Step("blb_row", {"height": 128}), Step("wlb_col", {"size": 3}), dense=(SORT, DIVIDE), template="shared_memory_warp_reduce"),
    "spmv_divided_cols": plan(Step("blb_row", {"height": 128}), Step("tlb_col", {"size": 2}), dense=(Step("col_div", {"width": 512}),), template="direct"),
}
for _name, _plan in TEMPLATE_PLANS.items():
    on(lambda m, p=_plan: graph.run(m, p, vector(m)), _name, base(Y_SQL))
on(lambda m: graph.run(m.with_entries(m.entries.filter("false")), plan(template="empty"), vector(m)), "spmv_tpl11_empty", base('SELECT r AS "row", CAST(0 AS DOUBLE) AS y FROM allr'))
on(lambda m: products.by_strategy(m, vector(m), "adaptive"), "spmv_csr_adaptive", base(Y_SQL, "supp_part"), "supp_part")


def by_block_plans(m: SparseMatrix):
    """A plan of its own for each block of a sorted and divided matrix."""
    dense = (SORT, Step("row_div", {"start": 4, "rate": 2, "cap": 8}))
    own = [plan(Step("blb_col", {"size": 4}), template="shared_memory_long_row"), plan(Step("tlb_nnz", {"size": 16}), template="unaligned_warp_reduce"), plan(Step("wlb_col", {"size": 2}), template="direct_warp_reduce")]
    return tuner.run_blocks(m, vector(m), dense, lambda i: own[i % len(own)])


on(by_block_plans, "spmv_plan_for_each_block", base(Y_SQL))

# Search.
GATES_SQL = """
SELECT CAST(s AS BIGINT) AS skeleton, CAST(count(*) AS BIGINT) AS plans FROM g, (
  SELECT 1 AS s, unnest(range(64, 257, 64)) AS p UNION ALL SELECT 5, 32 UNION ALL SELECT 4, unnest(range(32, greatest(32, (SELECT least(hi, 128) FROM g)) + 1, 32))
  UNION ALL SELECT 6, p FROM (SELECT unnest([2, 4]) AS p), (SELECT unnest(range(32, greatest(32, (SELECT least(hi, 128) FROM g)) + 1, 32)))
  UNION ALL SELECT 7, p FROM (SELECT unnest([128, 512, 896]) AS p), (SELECT unnest(range(32, greatest(32, (SELECT least(hi, 128) FROM g)) + 1, 32)))
  UNION ALL SELECT 2, p FROM (SELECT unnest([32, 64]) AS p), (SELECT unnest(range(1, 17, 3)))
  UNION ALL SELECT 3, p FROM (SELECT unnest([128, 512, 896]) AS p), (SELECT unnest(range(1, 17, 3)))
  UNION ALL SELECT 8, p FROM (SELECT 128 * pow(2, unnest(range(0, 6))) AS p) WHERE p <= (SELECT least(4096, (hi + 31) // 32 * 32) FROM g)
  UNION ALL SELECT 9, p FROM (SELECT DISTINCT greatest(1, least(mean, 32) * i // 4) AS p FROM g, (SELECT unnest(range(1, 5)) AS i)))
WHERE CASE s WHEN 8 THEN lo >= 128 WHEN 1 THEN hi <= 512 WHEN 5 THEN hi <= 512 WHEN 9 THEN NOT in_order WHEN 4 THEN lo >= 30 AND hi <= 512
  WHEN 6 THEN lo >= 32 AND hi <= 1024 WHEN 7 THEN lo >= 32 AND hi <= 1024 ELSE hi <= 1024 END GROUP BY s"""
GATES = """
, g AS (SELECT min(k) AS lo, max(k) AS hi, CAST(sum(k) // count(*) AS BIGINT) AS mean, bool_and(coalesce(k >= p, true)) OR bool_and(coalesce(k <= p, true)) AS in_order
        FROM (SELECT k, lag(k) OVER (ORDER BY r) AS p FROM len))""".strip()


def admitted(m: SparseMatrix):
    plans = [(number,) for number, _ in tuner.skeleton_plans(tuner.facts_of(m))]
    return m.spark.createDataFrame(plans, "skeleton long").groupBy("skeleton").agg(F.count("*").alias("plans"))


for _of in ("order_part", "supp_part", "emb"):
    on(admitted, f"plan_candidates_{_of}", base(GATES + GATES_SQL, _of), _of)


def _steps(p: Plan) -> str:
    return ", ".join(" ".join([s.name, *map(str, s.params.values())]) for s in p.levels)


def admitted_steps(m: SparseMatrix):
    """The candidates themselves: skeleton, template and the level steps with their sizes."""
    return m.spark.createDataFrame([(n, p.strategy, _steps(p)) for n, p in tuner.skeleton_plans(tuner.facts_of(m))], "skeleton long, template string, steps string")


STEPS_SQL = """
, warps AS (SELECT unnest(range(32, greatest(32, least(hi, 128)) + 1, 32)) AS w FROM g), widths AS (SELECT unnest(range(1, 17, 3)) AS w), sizes AS (SELECT unnest([128, 512, 896]) AS p)
SELECT CAST(s AS BIGINT) AS skeleton, template, steps FROM g, (
  SELECT 8 AS s, 'shared_memory_long_row' AS template, 'blb_col ' || p AS steps FROM (SELECT CAST(128 * pow(2, unnest(range(0, 6))) AS BIGINT) AS p), g WHERE p <= least(4096, (hi + 31) // 32 * 32)
  UNION ALL SELECT 1, 'direct_warp_compress', 'row_pad ' || p || ', blb_row ' || p || ', tlb_row' FROM (SELECT unnest(range(64, 257, 64)) AS p)
  UNION ALL SELECT 5, 'direct_warp_block_compress', 'row_pad 32, tlb_row'
  UNION ALL SELECT 9, 'unaligned_warp_reduce', 'tlb_nnz ' || p FROM (SELECT DISTINCT greatest(1, least(mean, 32) * i // 4) AS p FROM g, (SELECT unnest(range(1, 5)) AS i))
  UNION ALL SELECT 4, 'direct_warp_reduce', 'wlb_col ' || w FROM warps
  UNION ALL SELECT 6, 'shared_memory_warp_reduce', 'row_pad ' || p || ', blb_row ' || p || ', wlb_col ' || w FROM (SELECT unnest([2, 4]) AS p), warps
  UNION ALL SELECT 7, 'shared_memory_warp_reduce', 'blb_row ' || p || ', wlb_col ' || w FROM sizes, warps
  UNION ALL SELECT 2, 'shared_memory_warp_compress', 'row_pad ' || p || ', blb_row ' || p || ', tlb_col ' || w FROM (SELECT unnest([32, 64]) AS p), widths
  UNION ALL SELECT 3, 'shared_memory_warp_compress', 'blb_row ' || p || ', tlb_col ' || w FROM sizes, widths)
WHERE CASE s WHEN 8 THEN lo >= 128 WHEN 1 THEN hi <= 512 WHEN 5 THEN hi <= 512 WHEN 9 THEN NOT in_order WHEN 4 THEN lo >= 30 AND hi <= 512
  WHEN 6 THEN lo >= 32 AND hi <= 1024 WHEN 7 THEN lo >= 32 AND hi <= 1024 ELSE hi <= 1024 END"""
for _of in ("order_part", "supp_part", "emb"):
    on(admitted_steps, f"plan_steps_{_of}", base(GATES + STEPS_SQL, _of), _of)


# The log, its report, the budget and the whole search.
def price_log(parts):
    """A trial for each part, its price the metric."""
    none = F.array().cast("array<string>")
    metric = F.col("p_retailprice") + F.col("p_partkey") / 1000000.0
    return parts.select(none.alias("ops"), none.alias("strategies"), F.col("p_brand").alias("template"), F.array(F.col("p_partkey").cast("double")).alias("params"), metric.alias("metric"))


@query("""
SELECT p_brand AS template, CAST(p_partkey AS DOUBLE) AS trial, p_retailprice + p_partkey / 1000000.0 AS metric, (SELECT count(*) FROM part) AS trials
FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice + p_partkey / 1000000.0 DESC) = 1""")
def trial_log_report(spark, sf_dir):
    """A log that grows by two appends, and the report of its best trial."""
    parts, path = table(spark, sf_dir, "part"), folder(spark, "log")
    for half in (0, 1):
        tuner.append_log(price_log(parts.filter(F.col("p_partkey") % 2 == half)), f"{path}/trials")
    log = spark.read.parquet(f"{path}/trials")
    tuner.write_report(log, f"{path}/report")
    report = spark.read.schema("template string, params array<double>, metric double").json(f"{path}/report")
    return report.select("template", F.col("params")[0].alias("trial"), "metric", F.lit(log.count()).alias("trials"))


@query("SELECT p_name AS name, min(p_partkey) AS first_key, count(*) AS n FROM part GROUP BY 1")
def resumed_append(spark, sf_dir):
    """Features by name, appended in two calls that overlap: names that are there already are left as they are."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n"))
    path = folder(spark, "features")
    corpus.append_new(names.filter(F.col("first_key") % 3 != 0), path)
    corpus.append_new(names.withColumn("n", F.when(F.col("first_key") % 3 != 0, F.lit(-1)).otherwise(F.col("n"))), path)
    return spark.read.parquet(path)


@query("SELECT p_partkey AS name, CAST(p_size % 2 AS BIGINT) AS psym, CAST(p_size % 3 AS BIGINT) AS nsym, CAST(p_size AS BIGINT) AS header_nnz, p_partkey % 60 AS nnz FROM part WHERE p_size % 2 = 1 AND p_size % 3 = 1 AND p_size <> p_partkey % 60")
def half_stored_matrices(spark, sf_dir):
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    return corpus.half_stored(table(spark, sf_dir, "part").select(key.alias("name"), (size % 2).alias("psym"), (size % 3).alias("nsym"), size.alias("header_nnz"), (key % 60).alias("nnz")))


@query("""
WITH RECURSIVE metrics AS (SELECT row_number() OVER (ORDER BY p_brand) AS i, p_brand, CAST(sum(p_size) % 23 AS DOUBLE) AS metric FROM part GROUP BY p_brand),
s AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(10 AS BIGINT) AS steps, CAST(0 AS DOUBLE) AS best
  UNION ALL SELECT metrics.i, steps - 1 + CASE WHEN metric > best AND best > 0 THEN CAST(floor(least(25, greatest(5, 5 * (metric - best)))) AS BIGINT) ELSE 0 END, greatest(best, metric)
  FROM s JOIN metrics ON metrics.i = s.i + 1 WHERE steps > 0)
SELECT p_brand AS template, steps, s.best FROM s JOIN metrics USING (i)""")
def budget_trace(spark, sf_dir):
    """Steps left after each trial, a brand a trial; they end with the budget."""
    parts, budget, rows = table(spark, sf_dir, "part"), tuner.Budget(), []
    brands = parts.groupBy("p_brand").agg((F.sum("p_size") % 23).cast("double").alias("metric")).orderBy("p_brand")
    for r in brands.toLocalIterator():
        more = budget.tell(r["metric"])
        rows.append((r["p_brand"], budget.steps, budget.best))
        if not more:
            break
    return spark.createDataFrame(rows, "template string, steps long, best double")


def searched(m: SparseMatrix):
    """The product by what a whole search with its full budget finds, whichever plans these are."""
    m = m.held()
    dense, plans, _ = tuner.whole_search(m, vector(m))
    return tuner.run_blocks(m, vector(m), dense, plans.__getitem__)


on(searched, "spmv_whole_search", base(Y_SQL, "supp_part"), "supp_part")


# Facts of candidates from the row lengths: a plan of each kind, its chunks laid out in SQL.
FACT_PLANS = [
    (plan(Step("blb_col", {"size": 4}), template="shared_memory_long_row"), 1, f"(r, {TAIL})", "0", "rn", "1", "n"),
    (plan(Step("row_pad", {"multiple": 64}), Step("blb_row", {"height": 64}), Step("tlb_row"), template="direct_warp_compress"), 64, "r // 64", "0", "0", "max(k) OVER (PARTITION BY r // 64)",
     "64 * (SELECT sum(k) FROM (SELECT max(k) AS k FROM e64 GROUP BY r // 64))"),
    (plan(Step("row_pad", {"multiple": 32}), Step("tlb_row"), template="direct_warp_block_compress"), 32, "0", "0", "0", "max(k) OVER ()", "(SELECT max(k) FROM e32) * (SELECT (nr + 31) // 32 * 32 FROM d)"),
    (plan(Step("tlb_nnz", {"size": 16}), template="unaligned_warp_reduce"), 1, "0", "0", "nz // 16", "count(*) OVER (PARTITION BY r, nz // 16)", "n"),
    (plan(Step("wlb_col", {"size": 3}), template="direct_warp_reduce"), 1, "0", "(r, rn // 3)", "rn", "1", "n"),
    (plan(Step("row_pad", {"multiple": 4}), Step("blb_row", {"height": 4}), Step("wlb_col", {"size": 3}), template="shared_memory_warp_reduce"), 4, "r // 4", "(r, rn // 3)", "rn", "1", "(SELECT count(*) FROM e4)"),
    (plan(Step("row_pad", {"multiple": 32}), Step("blb_row", {"height": 32}), Step("tlb_col", {"size": 4}), template="shared_memory_warp_compress"), 32, "r // 32", "0", "rn // 4", "4",
     "(SELECT sum((k + 3) // 4 * 4) FROM e32 WHERE rn = 0)"),
    (plan(Step("blb_row", {"height": 256}), Step("tlb_col", {"size": 2}), template="shared_memory"), 1, "r // 256", "0", "rn // 2", "2", "(SELECT sum((k + 1) // 2 * 2) FROM e1 WHERE rn = 0)"),
]


def _facts_sql(of: str) -> str:
    tables = [
        f"e{pad} AS (SELECT nz.r, rn, nz, k FROM nz JOIN len ON len.r = nz.r UNION ALL SELECT i, 0, (SELECT count(*) FROM m) + i - nr, 1 FROM d, (SELECT unnest(range((SELECT nr FROM d), (SELECT (nr + {pad - 1}) // {pad} * {pad} FROM d))) AS i))"
        for pad in sorted({x[1] for x in FACT_PLANS})
    ]
    parts = []
    for i, (p, pad, b, w, q, size, stored) in enumerate(FACT_PLANS):
        name, tree = p.strategy, f"t{i}"
        tables.append(f"{tree} AS (SELECT b, w, r, q, any_value(size) AS n FROM (SELECT {b} AS b, {w} AS w, r, {q} AS q, {size} AS size FROM e{pad}) GROUP BY ALL)")
        support = f"({templates.TEMPLATES[name][1]}) AND ({templates.BESIDES.get(name, 'true')})"
        narrower = templates.NARROWER[name].replace("not is_sorted", "true")
        parts.append(f"""SELECT CAST({i} AS BIGINT) AS plan, '{name}' AS template, *, reason = '' AS admitted FROM (SELECT *, CASE WHEN NOT ({support}) THEN 'support' WHEN padding_ratio > 4 THEN 'padding' WHEN NOT ({narrower}) THEN 'narrower' ELSE '' END AS reason FROM (
  SELECT * FROM (SELECT max(t) AS tlbs_of_row, max(w) AS wlbs_of_row, count(*) FILTER (WHERE b > 1) AS shared_rows FROM (SELECT r, count(*) AS t, count(DISTINCT (b, w)) AS w, count(DISTINCT b) AS b FROM {tree} GROUP BY r)),
  (SELECT count(*) AS blbs, max(t) AS tlbs_of_blb, max(rr) AS rows_of_blb, count(*) FILTER (WHERE lo <> hi) AS uneven_blbs, CAST(min(lo) AS BIGINT) AS min_tlb, CAST(max(hi) AS BIGINT) AS max_tlb, max(ww) AS wlbs_of_blb
   FROM (SELECT b, count(*) AS t, count(DISTINCT r) AS rr, min(n) AS lo, max(n) AS hi, count(DISTINCT w) AS ww FROM {tree} GROUP BY b)),
  (SELECT count(*) AS wlbs, max(rr) AS rows_of_wlb FROM (SELECT b, w, count(DISTINCT r) AS rr FROM {tree} GROUP BY b, w)),
  (SELECT (nr + {pad - 1}) // {pad} * {pad} - nr AS pad_rows FROM d), (SELECT round(CAST({stored} AS DOUBLE) / n, 9) AS padding_ratio FROM (SELECT count(*) AS n FROM m))))""")
    return base(", " + ",\n".join(tables) + "\n" + "\nUNION ALL ".join(parts), of)


def facts_of_plans(m: SparseMatrix):
    got = facts.plan_facts(m, [x[0] for x in FACT_PLANS]).drop("record")
    return got.withColumn("padding_ratio", F.round("padding_ratio", 9))


for _of in ("order_part", "supp_part"):
    on(facts_of_plans, f"plan_facts_{_of}", _facts_sql(_of), _of)


def ranking(m: SparseMatrix):
    """Admitted plans of a matrix in the order of a model of what all supported ones store and read: plan, record and place."""
    m = m.held()
    block = tuner.facts_of(m)
    plans = [Plan((Step("compress"),), steps, template) for _, _, template, sizes in tuner.SKELETONS for steps in sizes(block)]
    rows = [r.asDict() for r in facts.plan_facts(m, plans).orderBy("plan").collect()]
    log = [(learn.plan_features(plans[r["plan"]], r), 1e3 / (20 * r["padding_ratio"] + r["tlbs_of_row"] + r["wlbs_of_row"])) for r in rows if r["blbs"]]
    model = learn.surrogate(m.spark.createDataFrame(log * 2, "features array<double>, target double"))
    found = tuner.shortlist(m, plans, model)
    return m.spark.createDataFrame([(i, p.record()) for i, (p, _) in enumerate(found)], "place long, record string")


on(ranking, "plan_ranking", None)


def strategies(m: SparseMatrix):
    rows = [(s, *(p or (0, 0, 0)), len(points) - 1 if s != 2 or len(points) <= tuner.MOST_BLOCKS + 1 else tuner.MOST_BLOCKS + 1, dense is not None) for s, p, points, dense in tuner.matrix_strategies(m)]
    return m.spark.createDataFrame(rows, "strategy long, start long, rate long, cap long, blocks long, admitted boolean")


def _window_sql(start: int, rate: int, cap: int) -> str:
    bounds, at = [], start
    while at < cap:
        bounds.append(at)
        at *= rate
    bounds.append(cap)
    return "CASE " + " ".join(f"WHEN k >= {b} THEN {i}" for i, b in reversed(list(enumerate(bounds, 1)))) + " ELSE 0 END"


STRATEGIES_SQL = (
    "SELECT CAST(1 AS BIGINT) AS strategy, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS rate, CAST(0 AS BIGINT) AS cap, CAST(1 AS BIGINT) AS blocks, true AS admitted\n"
    f"UNION ALL SELECT 2, 32, 4, 4096, least(n, 5), n BETWEEN 2 AND 4 FROM (SELECT count(*) FILTER (WHERE p IS NULL OR p <> w) AS n FROM (SELECT w, lag(w) OVER (ORDER BY r) AS p FROM (SELECT r, {_window_sql(*tuner.SECOND)} AS w FROM len)))\n"
    "UNION ALL SELECT 3, a, b, 2048, blocks, blocks <= 4 AND i = min(i) OVER (PARTITION BY cuts) FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS i, {a} AS a, {b} AS b, count(*) AS blocks, string_agg(n, ',' ORDER BY w DESC) AS cuts FROM (SELECT w, count(*) AS n FROM (SELECT {_window_sql(a, b, c)} AS w FROM len) GROUP BY w)"
        for i, (a, b, c) in enumerate(tuner.THIRD)
    )
    + ")"
)
for _of in ("order_part", "supp_part"):
    on(strategies, f"plan_strategies_{_of}", base(STRATEGIES_SQL, _of), _of)
on(
    lambda m: tuner.template_params(m.entries.agg(F.count("*").alias("work")).select(F.explode(F.array(*[F.lit(t) for t in tuner.THREADS])).alias("template"), "work")),
    "template_params",
    base("""
SELECT template, threads, CAST(least((n + threads - 1) // threads, 65534) AS BIGINT) AS groups FROM (SELECT count(*) AS n FROM m), (
  SELECT 'direct_warp_block_compress' AS template, unnest(range(32, 257, 32)) AS threads UNION ALL SELECT 'direct_warp_reduce', unnest(range(32, 513, 64)) UNION ALL SELECT 'unaligned_warp_reduce', unnest(range(64, 257, 64)))"""),
)


# Readers and writers.
def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


ENTRIES_SQL = 'SELECT r AS "row", c AS col, v AS val FROM m'


def coo_back(m: SparseMatrix):
    path = folder(m.spark, "coo")
    text.write_coo(m, path)
    back = text.read_coo(m.spark, path)
    return back.entries.select("row", "col", "val", F.lit(back.n_rows).alias("n_rows"), F.lit(back.n_cols).alias("n_cols"))


on(coo_back, "coo_round_trip", base('SELECT r AS "row", c AS col, v AS val, nr AS n_rows, nc AS n_cols FROM m, d'))


def mm_lines(m: SparseMatrix, kind: str, entries):
    """The entries written as Matrix-Market text, in order and in as many parts as there are ranges of rows, and read again."""
    path = folder(m.spark, "mm")
    text.write_matrix_market(SparseMatrix(entries, m.n_rows, m.n_cols), path, kind)
    return text.read_matrix_market(m.spark, path).entries


def square(m: SparseMatrix) -> SparseMatrix:
    n = max(m.n_rows, m.n_cols)
    return SparseMatrix(m.entries, n, n)


on(lambda m: mm_lines(m, "general", m.entries), "mm_general", base(ENTRIES_SQL))
on(lambda m: mm_lines(square(m), "symmetric", m.entries.filter("col <= row")), "mm_symmetric", base(
    'SELECT r AS "row", c AS col, v AS val FROM m WHERE c <= r UNION ALL SELECT c, r, v FROM m WHERE c < r', "supp_part"), "supp_part")
on(lambda m: mm_lines(square(m), "skew-symmetric", m.entries.filter("col < row")), "mm_skew", base(
    'SELECT r AS "row", c AS col, v AS val FROM m WHERE c < r UNION ALL SELECT c, r, -v FROM m WHERE c < r', "supp_part"), "supp_part")


def mm_dense(m: SparseMatrix):
    """The matrix as an array of all its values by columns, zeros included, written in parts and read again."""
    path = folder(m.spark, "mm-array")
    text.write_matrix_market_array(m, path)
    return text.read_matrix_market(m.spark, path).entries


on(mm_dense, "mm_array", base("""
SELECT allr.r AS "row", q.c AS col, coalesce(v, 0) AS val FROM allr CROSS JOIN (SELECT unnest(range(0, (SELECT nc FROM d))) AS c) q LEFT JOIN m ON m.r = allr.r AND m.c = q.c""", "supp_part"), "supp_part")


def array_back(m: SparseMatrix):
    path = folder(m.spark, "array")
    text.write_array(m.row_nnz().select(F.col("row").alias("i"), F.col("k").alias("a")), path)
    return text.read_array(m.spark, path)


on(array_back, "array_round_trip", base("SELECT r AS i, k AS a FROM len"))
on(lambda m: text.prepare(m).entries, "prepared_pattern", base('SELECT r AS "row", c AS col, CAST(1 AS DOUBLE) AS val FROM m', "supp_part"), "supp_part")


def plan_back(m: SparseMatrix):
    path = folder(m.spark, "plan")
    p = TEMPLATE_PLANS["spmv_tpl7_shared_memory_warp_reduce"]
    store.write_plan(lowered(m, p), path, p.strategy)
    state, template = store.read_plan(m.spark, path)
    return templates.product(state.entries, state.matrix, vector(m), template)


def level_back(m: SparseMatrix):
    path = folder(m.spark, "levels")
    store.write_plan(lowered(m, plan(Step("blb_row", {"height": 512}))), path)
    return store.read_level(m.spark, path, "blb")


on(plan_back, "plan_store_round_trip", base(Y_SQL))
on(level_back, "level_dump_round_trip", base(f"SELECT {NNZ}, r // 512 AS blb, {BLB} FROM m GROUP BY 1, 2"))


# Compression: closed forms of all blocks, and a store that leaves out what has one.
def in_bands(m: SparseMatrix, height: int) -> SparseMatrix:
    cuts = m.rows().filter(F.col("row") % height == 0).select(F.col("row").alias("cut"))
    return graph.compressed(m.with_entries(division.row_ranges(m, cuts, with_low=True)))


FORMS_SQL = """
, e AS (SELECT block, row_number() OVER (PARTITION BY block ORDER BY r, c) - 1 AS i, r - lo AS "row", c - min(c) OVER (PARTITION BY block) AS col
        FROM (SELECT r // {h} * {h} AS lo, dense_rank() OVER (ORDER BY r // {h}) - 1 AS block, r, c FROM m)),
a AS (SELECT block, 'row' AS arr, i, "row" AS a FROM e UNION ALL SELECT block, 'col', i, col FROM e),
q AS (SELECT *, a - lag(a) OVER (PARTITION BY block, arr ORDER BY i) AS step FROM a),
s AS (SELECT block, arr, count(*) AS n, min(a) AS low, max(a) AS high, max(a) FILTER (WHERE i = 0) AS b, max(step) FILTER (WHERE i = 1) AS s, min(step) AS least, max(step) AS most,
             count(*) FILTER (WHERE step <> 0) AS changes, min(i) FILTER (WHERE step <> 0) AS q FROM q GROUP BY block, arr),
p AS (SELECT block, arr, min(i) FILTER (WHERE i > 0 AND a = b) AS p FROM q JOIN s USING (block, arr) GROUP BY block, arr),
f AS (SELECT block, arr, bool_and(a = b + s * (i % p)) AS cl, bool_and(a = b + i // q) AS ci, string_agg(i || ',' || a, ',' ORDER BY i) FILTER (WHERE i = 0 OR step <> 0) AS runs
      FROM q JOIN s USING (block, arr) JOIN p USING (block, arr) GROUP BY block, arr),
forms AS (
  SELECT block, arr, n, high, b, s, p, q, runs,
         CASE WHEN low = high THEN 'constant' WHEN least = most AND s >= 0 THEN 'linear' WHEN p > 1 AND p < n AND n % p = 0 AND cl THEN 'cycle_linear'
              WHEN n > 2 AND n % q = 0 AND ci THEN 'cycle_increase' WHEN n > 2 AND changes < 5 THEN 'branches' ELSE 'stored' END AS form
  FROM s JOIN p USING (block, arr) JOIN f USING (block, arr))
""".strip()
ONE_FORM = """
SELECT block, arr AS "array", form, n, high,
       CASE form WHEN 'constant' THEN '' || b WHEN 'linear' THEN b || ',' || s WHEN 'cycle_linear' THEN p || ',' || b || ',' || s WHEN 'cycle_increase' THEN q || ',' || b WHEN 'branches' THEN runs ELSE '' END AS params FROM forms"""
BYTES = """
, codes AS (SELECT block, arr, n, CASE WHEN form <> 'stored' THEN form WHEN high < 128 THEN 'byte' WHEN high < 32768 THEN 'short' ELSE 'int' END AS code FROM forms)
SELECT block, n, max(code) FILTER (WHERE arr = 'row') AS row_code, max(code) FILTER (WHERE arr = 'col') AS col_code, n * 24 AS bytes_before,
       CAST(n * 8 + sum(n * CASE code WHEN 'byte' THEN 1 WHEN 'short' THEN 2 WHEN 'int' THEN 4 ELSE 0 END) AS BIGINT) AS bytes_after FROM codes GROUP BY block, n"""


def forms_of(m: SparseMatrix):
    entries = compressed.placed(m)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("array"), F.col(a).alias("a")) for a in compressed.ARRAYS])).alias("x")
    forms = block_forms(entries.select("block", "i", each).select("block", "i", "x.array", "x.a"))
    return forms.withColumn("params", F.array_join(F.col("params").cast("array<string>"), ","))


def compressed_back(m: SparseMatrix) -> SparseMatrix:
    path = folder(m.spark, "compressed")
    compressed.write(m, path)
    return compressed.read(m.spark, path)


for _name, _of, _height in (("block_forms", "order_part", 2), ("block_forms_wide", "order_part", 150), ("block_forms_dense", "emb", 5)):
    on(lambda m, h=_height: forms_of(in_bands(m, h)), _name, base(FORMS_SQL.format(h=_height) + ONE_FORM, _of), _of)
on(lambda m: compressed_back(in_bands(m, 2)).entries, "plan_store_compressed_mixed", base("""
SELECT dense_rank() OVER (ORDER BY r // 2) - 1 AS block, r AS "row", c AS col, v AS val FROM m"""))
on(lambda m: products.product(compressed_back(in_bands(m, 5)), vector(m)), "plan_store_compressed", base(Y_SQL, "emb"), "emb")
on(lambda m: compressed.sizes(compressed.encodings(compressed.placed(in_bands(m, 2)))), "plan_store_bytes", base(FORMS_SQL.format(h=2) + BYTES))


# Sequences: the primitives that the runs leave out.
def sequence(m: SparseMatrix):
    return m.row_nnz().select(F.col("row").alias("pos"), F.col("k").alias("key"), (F.col("row") % 10).alias("value"))


on(lambda m: runs.arg_extremes(sequence(m), "key"), "arg_min_max", base("SELECT min(k) AS least, min(r) FILTER (WHERE k = lo) AS least_at, max(k) AS most, min(r) FILTER (WHERE k = hi) AS most_at FROM len, (SELECT min(k) AS lo, max(k) AS hi FROM len)"))
on(lambda m: runs.scan(sequence(m), "key", inclusive=False).select("pos", "scan"), "exclusive_scan", base("SELECT r AS pos, CAST(sum(k) OVER (ORDER BY r) - k AS BIGINT) AS scan FROM len"))
on(lambda m: runs.scan_max(sequence(m), "key").select("pos", "scan"), "scan_max", base("SELECT r AS pos, max(k) OVER (ORDER BY r) AS scan FROM len"))
on(lambda m: runs.histogram_range(sequence(m), "key", [0, 1, 2, 5, 9]), "histogram_range", base("""
SELECT CAST(bin AS BIGINT) AS bin, count(r) AS n FROM (SELECT unnest(range(0, 4)) AS bin) LEFT JOIN (SELECT r, CASE WHEN k < 1 THEN 0 WHEN k < 2 THEN 1 WHEN k < 5 THEN 2 ELSE 3 END AS b FROM len WHERE k < 9) ON b = bin GROUP BY bin"""))
on(lambda m: runs.histogram_multi(sequence(m), {"key": (0, 16, 4), "value": (0, 10, 5)}), "histogram_multi", base("""
SELECT 'key' AS channel, CAST(bin AS BIGINT) AS bin, count(r) AS n FROM (SELECT unnest(range(0, 4)) AS bin) LEFT JOIN (SELECT r, k // 4 AS b FROM len WHERE k < 16) ON b = bin GROUP BY bin
UNION ALL SELECT 'value', CAST(bin AS BIGINT), count(r) FROM (SELECT unnest(range(0, 5)) AS bin) LEFT JOIN (SELECT r, r % 10 // 2 AS b FROM len) ON b = bin GROUP BY bin"""))
on(lambda m: runs.sorted_places(sequence(m), "key", descending=True).select("pos", "key", "place"), "radix_sort_pairs", base("SELECT r AS pos, k AS key, row_number() OVER (ORDER BY k DESC, r) - 1 AS place FROM len"))
on(lambda m: runs.sorted_places(products.product(m, vector(m)).select(F.col("row").alias("pos"), F.col("y").alias("key")), "key").select("pos", "place"), "sorted_any", base("SELECT r AS pos, row_number() OVER (ORDER BY y, r) - 1 AS place FROM y"))
on(lambda m: runs.segmented_sort(sequence(m).withColumn("segment", F.lit(1)), "segment", "key", descending=True).select("pos", "place"), "segmented_sort_one", base("SELECT r AS pos, row_number() OVER (ORDER BY k DESC, r) - 1 AS place FROM len"))
on(lambda m: runs.segmented_scan(sequence(m).withColumn("flag", F.col("key") > 5), "value", "flag").select("pos", "scan"), "segmented_scan", base("""
SELECT r AS pos, CAST(sum(r % 10) OVER (PARTITION BY g ORDER BY r) AS BIGINT) AS scan FROM (SELECT r, sum(CASE WHEN k > 5 THEN 1 ELSE 0 END) OVER (ORDER BY r) AS g FROM len)"""))
on(lambda m: runs.segmented_scan(sequence(m).withColumn("flag", F.col("pos") == 3), "key", "flag", inclusive=False, band=512).select("pos", "scan"), "segmented_scan_long", base("""
SELECT r AS pos, CAST(sum(k) OVER (PARTITION BY r >= 3 ORDER BY r) - k AS BIGINT) AS scan FROM len"""))


def no_form(m: SparseMatrix):
    """Each form on an array that it does not fit."""
    seq = m.row_nnz().select(F.col("row").alias("i"), F.col("k").alias("a"))
    tests = [form(seq).select(F.lit(name).alias("form"), "fits") for name, form in formulas.FORMS]
    out = tests[0]
    for t in tests[1:]:
        out = out.unionByName(t)
    return out


on(no_form, "cmp_unfitting", base("""
SELECT 'constant' AS form, min(k) = max(k) AS fits FROM len UNION ALL SELECT 'linear', bool_and(k = b + (s - b) * r) AND s >= b FROM len, (SELECT min(k) FILTER (WHERE r = 0) AS b, min(k) FILTER (WHERE r = 1) AS s FROM len) GROUP BY b, s
UNION ALL SELECT 'cycle_linear', coalesce(bool_and(k = r % p * (s - b) + b) AND p > 1 AND p < count(*) AND count(*) % p = 0, false) FROM len, (
  SELECT b, s, (SELECT min(r) FROM len WHERE r > 0 AND k = b) AS p FROM (SELECT min(k) FILTER (WHERE r = 0) AS b, min(k) FILTER (WHERE r = 1) AS s FROM len)) GROUP BY b, s, p
UNION ALL SELECT 'cycle_increase', coalesce(bool_and(k = r // p + b) AND count(*) % p = 0, false) FROM len, (SELECT b, (SELECT min(r) FROM len WHERE k <> b) AS p FROM (SELECT min(k) FILTER (WHERE r = 0) AS b FROM len)) GROUP BY b, p
UNION ALL SELECT 'branches', count(*) FILTER (WHERE q IS NULL OR q <> k) <= 5 FROM (SELECT k, lag(k) OVER (ORDER BY r) AS q FROM len)"""))
on(lambda m: sorting.by_length(m).join(exponential_cuts(m, 4, 4).select(F.col("cut").alias("old_row")), "old_row", "left_semi"), "sorted_cut_rows", base("""
, w AS (SELECT r, CASE WHEN k >= 256 THEN 4 WHEN k >= 64 THEN 3 WHEN k >= 16 THEN 2 WHEN k >= 4 THEN 1 ELSE 0 END AS w FROM len)
SELECT new_row, r AS old_row, k FROM (SELECT row_number() OVER (ORDER BY k DESC, r) - 1 AS new_row, r, k FROM len) WHERE r IN (SELECT r FROM (SELECT r, w, lag(w) OVER (ORDER BY r) AS p FROM w) WHERE p IS NULL OR p <> w)""".strip()))


@query("SELECT p_name AS name, dense_rank() OVER (ORDER BY p_name) - 1 AS id FROM (SELECT DISTINCT p_name FROM part)")
def name_ids(spark, sf_dir):
    return corpus.name_ids(table(spark, sf_dir, "part"), "p_name")

