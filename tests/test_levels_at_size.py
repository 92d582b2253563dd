"""Steps that many queries share: nothing is dealt by a key that few values have, and what is read again is kept."""

import glob
import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lattica.model import SparseMatrix
from lattica.operators import division, layout, levels, order, products, sorting
from lattica.plans import facts, graph, templates, tuner
from lattica.plans.graph import Plan, Step
from lattica.session import shared_dir


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(8)
    cells = {(r, 17) for r in range(150)} | {(rng.randrange(150), rng.randrange(90)) for _ in range(500)}
    m = SparseMatrix(spark.createDataFrame([(r, c, float(rng.randrange(1, 9))) for r, c in sorted(cells)], "row long, col long, val double"), 155, 90)
    return m, m.cols().withColumn("x", (F.col("col") + 1).cast("double"))


def ys(df):
    return {r["row"]: r["y"] for r in df.collect()}


def test_cuts_by_columns_of_a_matrix_divided_by_columns_lose_nothing(made):
    m, x = made
    plan = Plan((Step("col_div", {"width": 16}), Step("compress")), (Step("blb_row", {"height": 32}), Step("wlb_col", {"size": 3})), "direct")
    assert ys(graph.run(m, plan, x, check=False)) == ys(products.product(m, x))


def test_few_blocks_go_to_their_entries(spark, made):
    m, _ = made
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for entries in (division.row_ranges(m, [0, 10, 40, 155]), division.col_blocks(m, 30).entries, graph.compressed(m).entries):
            assert "SortMergeJoin" not in entries._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("each", [1, 40, 1000])
def test_copies_of_x_grow_with_entries(made, monkeypatch, each):
    m, x = made
    monkeypatch.setattr(products, "ENTRIES_A_COPY", each)
    got = products.gather_grid(m, x, 8, 16)
    assert ys(got.groupBy("row").agg(F.sum("product").alias("y"))) == {r: y for r, y in ys(products.product(m, x)).items() if y}


def test_numbers_of_entries(made, monkeypatch):
    m, _ = made
    want = [(r["row"], r["col"]) for r in m.entries.orderBy("row", "col").collect()]
    sizes = {r: len(list(g)) for r, g in itertools.groupby(want, key=lambda x: x[0])}
    for most in (division.WHOLE_ROW, 4):
        monkeypatch.setattr(division, "WHOLE_ROW", most)
        got = sorted(division.numbered(m).collect(), key=lambda r: r["nz"])
        assert [(r["row"], r["col"]) for r in got] == want and [r["nz"] for r in got] == list(range(len(want)))
        assert all(r["k"] == sizes[r["row"]] for r in got)
        assert all(r["rn"] == (0 if i == 0 or want[i - 1][0] != r["row"] else got[i - 1]["rn"] + 1) for i, r in enumerate(got))


def test_a_search_makes_the_blocks_of_a_strategy_once(made, monkeypatch):
    m, x = made
    calls, parts_of = [], tuner.parts_of
    monkeypatch.setattr(tuner, "parts_of", lambda matrix, dense: calls.append(dense) or parts_of(matrix, dense))
    monkeypatch.setattr(tuner, "matrix_strategies", lambda matrix: [(1, None, [0, 155], ())])
    assert m.held().held().kept and not m.held().with_entries(m.entries).kept
    clock = itertools.count()
    dense, plans, _ = tuner.whole_search(m, x, seconds=60.0, steps=1, timer=lambda: float(next(clock)))
    assert calls == [()]
    assert ys(tuner.run_blocks(m, x, dense, plans.__getitem__)) == ys(products.product(m, x))


def test_a_check_looks_up_what_its_template_asks_for(made):
    m, _ = made
    plan = Plan((Step("row_div", {"start": 2, "rate": 2, "cap": 8}), Step("compress")), (Step("blb_row", {"height": 16}), Step("wlb_col", {"size": 3})), "direct_warp_reduce")
    laid = levels.kept(graph.lower(graph.prepare(m, plan), plan)).entries
    every = templates.facts(laid).first().asDict()
    for name, (_, condition) in templates.TEMPLATES.items():
        own = templates.facts_for(laid, condition)
        assert set(own) <= set(condition.split()) | {"tlbs_of_blb", "uneven_blbs", "min_tlb", "max_tlb"}
        assert (condition == "true" or templates.holds(condition, own)) == templates.holds(condition, every), name
    assert templates.most_warps(laid) >= laid.groupBy("block", "blb").agg(F.count_distinct("wlb").alias("n")).agg(F.max("n")).first()[0]


def test_few_cuts_are_written_out_and_lengths_counted_once(spark, made):
    m, _ = made
    held = m.held()
    assert held.row_nnz() is held.row_nnz() and sorted(held.row_nnz().collect()) == sorted(m.row_nnz().collect())
    dense = (Step("coarse_sort"), Step("row_div", {"start": 2, "rate": 2, "cap": 8}), Step("compress"))
    got = graph.prepare(m, Plan(dense)).entries
    assert got.select("block").distinct().count() > 1
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_entries(spark, made, monkeypatch):
    from lattica import session

    m, _ = made
    monkeypatch.setattr(session, "ROWS_OF_A_TASK", 100)
    assert session.in_tasks(spark, 1000) == 10 and session.in_tasks(spark, 4000) == 40
    got = division.numbered(m.held())
    assert sorted(r["nz"] for r in got.collect()) == list(range(m.entries.count()))


def test_places_within_values_that_lie_in_several_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2, 5]), i) for i in range(400)]
    got = order.ranged_places(spark.createDataFrame(rows, "v long, i long"), [F.col("v"), F.col("i")], "at", "v")
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(v, i): sum(w == v and j < i for w, j in rows) for v, i in rows}
    assert {(r["v"], r["i"]): r["at"] for r in got.collect()} == want


def test_pads_come_with_the_last_entry(made):
    m, _ = made
    plan = Plan((Step("compress"),), (Step("wlb_row", {"height": 32}), Step("tlb_col", {"size": 4})))
    state = graph.lower(graph.prepare(m, plan), plan)
    counted = replace(state, matrix=replace(state.matrix, by_cols=True))
    for lay in (levels.padded, levels.interleaved):
        one, two = lay(state), lay(counted)
        assert sorted(map(str, one.select(*two.columns).collect())) == sorted(map(str, two.collect()))
    assert "Exchange" not in levels.padded(levels.kept(state))._jdf.queryExecution().executedPlan().toString()


STEPS = [
    (Step("wlb_col", {"size": 3}),),
    (Step("blb_col", {"size": 4}), Step("wlb_col", {"size": 3})),
    (Step("blb_col", {"size": 4, "from": 6}), Step("wlb_col", {"size": 2}), Step("tlb_col", {"size": 2})),
]


@pytest.mark.parametrize("steps", STEPS)
def test_sums_tell_parts_apart_without_moving_entries(made, steps):
    m, _ = made
    ready = graph.prepare(m, Plan((Step("compress"),), steps))
    with_gaps = graph.lower(ready, Plan((Step("compress"),), steps), gapless=False).entries
    assert "hashpartitioning(row" not in with_gaps._jdf.queryExecution().executedPlan().toString()
    parts = []
    for entries in (with_gaps, graph.lower(ready, Plan((Step("compress"),), steps)).entries):
        own = {}
        for r in entries.collect():
            own.setdefault((r["block"], r["blb"], r["wlb"], r["row"], r["tlb"]), set()).add((r["row"], r["col"], r["at"], r["len"]))
        parts.append(sorted(map(sorted, own.values())))
    assert parts[0] == parts[1]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


KINDS = [
    (lambda m: sorting.length, sorting.by_length),
    (lambda m: sorting.bin_of([0, 4, 5, 7]), lambda m: sorting.coarse(m, [0, 4, 5, 7])),
    (lambda m: sorting.step_of(m, 2), lambda m: sorting.coarse_by_step(m, 2)),
]


@pytest.mark.parametrize("kind, mapped", KINDS)
def test_a_sort_numbers_the_entries(made, monkeypatch, kind, mapped):
    m, _ = made
    m = m.with_entries(m.entries.filter("row % 11 <> 5"))  # rows without entries in between
    want = sorting.apply(m, mapped(m))
    numbers = division.numbered(want)
    for tasks in (1, 5):
        monkeypatch.setattr(sorting, "in_tasks", lambda spark, rows, tasks=tasks: tasks)
        got = sorting.sort(replace(m, n_entries=1000), kind(m))
        assert rows_of(got.entries, "row", "col", "val") == rows_of(want.entries, "row", "col", "val")
        assert rows_of(got.row_map, "new_row", "old_row") == rows_of(want.row_map, "new_row", "old_row")
        assert rows_of(division.numbered(got), "row", "col", "rn", "k", "nz") == rows_of(numbers, "row", "col", "rn", "k", "nz")
        assert rows_of(got.row_nnz(), "row", "k") == rows_of(want.row_nnz(), "row", "k")
    both = [layout.pad_rows(x, 64, 3) for x in (got, want)]
    assert both[0].numbers is not None and both[0].n_rows == 192
    assert rows_of(division.numbered(both[0]), "row", "col", "rn", "k", "nz") == rows_of(division.numbered(both[1]), "row", "col", "rn", "k", "nz")
    monkeypatch.setattr(sorting, "WHOLE_ROW", 4)  # no row may be numbered by a task
    got = sorting.sort(m, kind(m))
    assert got.numbers is None and rows_of(got.entries, "row", "col", "val") == rows_of(want.entries, "row", "col", "val")
    assert rows_of(got.row_map, "new_row", "old_row") == rows_of(want.row_map, "new_row", "old_row")


SORTED = (Step("fine_sort"), Step("row_pad_total", {"multiple": 64}), Step("compress"))


def test_a_sorted_product_keeps_its_entries_once(spark, made):
    m, x = made
    kept = lambda: set(glob.glob(f"{shared_dir(spark)}/kept-*"))
    before = kept()
    got = graph.run(m, Plan(SORTED, (Step("tlb_nnz", {"size": 32}),), "unaligned_warp_reduce"), x)
    assert len(kept() - before) == 1  # lengths, order, numbers and facts are read off it
    assert "new_row" not in got._jdf.queryExecution().toString()  # and no map meets the sums
    assert ys(got) == ys(products.product(m, x))


@pytest.mark.parametrize("rest, steps, strategy", [
    (SORTED[1:], (Step("row_pad", {"multiple": 100}), Step("blb_row", {"height": 16})), "direct_warp_compress"),
    (SORTED[1:], (Step("tlb_col", {"size": 4}),), "chunks"),
    (SORTED[2:], (Step("wlb_row", {"height": 8}), Step("tlb_row", {"empty_rows": True})), "direct"),
    ((Step("col_div", {"width": 30}), SORTED[2]), (Step("blb_col", {"size": 4}),), "direct"),
])
def test_sorted_plans_give_the_product(made, rest, steps, strategy):
    m, x = made
    assert ys(graph.run(m, Plan((Step("coarse_sort"), *rest), steps, strategy), x, check=False)) == ys(products.product(m, x))


def test_sorts_that_read_their_input_once():
    reads = {1: [{}, {"bounds": [0, 3]}, {"every": 1}], 0: [{"every": 2}, {"step": 3}, {"bounds": []}]}
    for want, options in reads.items():
        assert [graph.reads_once(Step("coarse_sort", p)) for p in options] == [bool(want)] * len(options)
    assert graph.reads_once(Step("fine_sort")) and not graph.reads_once(Step("row_div", {"cuts": [0, 5]}))


def test_a_sorted_input_step_gives_the_product(made):
    m, x = made
    graph.remember("sorted input", m)
    try:
        got = ys(graph.run(None, Plan((Step("cached", {"name": "sorted input"}), *SORTED), (Step("tlb_nnz", {"size": 32}),), "unaligned_warp_reduce"), x, m.spark))
    finally:
        graph.forget("sorted input")
    assert got == ys(products.product(m, x))


def test_facts_of_a_sorted_matrix_come_from_its_numbers(made):
    m, _ = made
    plans = [Plan(SORTED, (Step("tlb_nnz", {"size": n}),), "unaligned_warp_reduce") for n in (4, 32)] + [Plan(SORTED, (Step("blb_row", {"least": 20}), Step("tlb_row")), "direct")]
    ready = graph.prepare(m, plans[0])
    assert ready.numbers is not None
    assert facts.block_counts(ready, plans) == facts.block_counts(ready.with_entries(ready.entries), plans)
