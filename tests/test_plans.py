"""Plan rules, search and learning."""

import itertools

import pytest
from pyspark.sql import functions as F

from lattica.operators import levels, products
from lattica.plan_queries import TEMPLATE_PLANS
from lattica.plans import learn, tuner
from lattica.plans.graph import Plan, Step, lower, padding_allows, prepare, run, violations
from tests.test_engine import of_lengths


def test_rules():
    assert violations(Plan()) == []
    assert violations(Plan((Step("coarse_sort"), Step("row_div"), Step("compress")), (Step("blb_row"), Step("tlb_col")))) == []
    for bad in (
        Plan((Step("row_div"), Step("coarse_sort"))),
        Plan((Step("compress"), Step("col_div"))),
        Plan((Step("row_div"), Step("row_div"))),
        Plan((Step("compress"),), (Step("blb_row"), Step("row_pad"))),
        Plan((Step("compress"),), (Step("tlb_col"), Step("blb_row"))),
        Plan((Step("compress"),), (Step("blb_row"), Step("wlb_row"))),
        Plan((), (Step("tlb_col"),)),
        Plan(strategy="none such"),
    ):
        assert violations(bad), bad


def test_records_come_back():
    plan = Plan((Step("col_div", {"width": 4}), Step("compress")), (Step("tlb_col", {"size": 2}),), "chunks")
    assert Plan.of(plan.record()) == plan


DENSE = ((Step("coarse_sort", {"every": 1}),), (Step("row_div", {"start": 2, "rate": 2, "cap": 4}), Step("col_div", {"width": 3})))


@pytest.mark.parametrize("dense", DENSE)
def test_every_skeleton_gives_the_product(spark, dense):
    m = of_lengths(spark, [3, 1, 0, 8, 2, 2])
    x = m.cols().withColumn("x", F.lit(2.0))
    want = sorted(products.product(m, x).collect())
    plans = [plan for number, plan in tuner.skeleton_plans(tuner.facts_of(m), dense)]
    assert len(plans) > 30 and len({p.strategy for p in plans}) == 4
    one_each = {(p.strategy, *[s.name for s in p.levels]): p for p in plans}
    for plan in one_each.values():
        try:
            assert sorted(run(m, plan, x).collect()) == want
        except ValueError as unsupported:
            assert "does not support" in str(unsupported)
    assert padding_allows(m, 1) and not padding_allows(m, 6, most=1.5)


@pytest.mark.parametrize("name", sorted(TEMPLATE_PLANS))
def test_template_plans_on_odd_rows(spark, name):
    m = of_lengths(spark, [3, 1, 0, 8, 2, 2, 0, 40, 1])
    x = m.cols().withColumn("x", F.col("col") + 1.0)
    plan = TEMPLATE_PLANS[name]
    assert sorted(run(m, plan, x, check=False).collect()) == sorted(products.product(m, x).collect())


def table_of(m, plan, level):
    return sorted(map(tuple, levels.table(lower(prepare(m, plan), plan), level).collect()))


def test_no_level_step_is_idle(spark):
    """Each step that is taken away changes the level tables."""
    m = of_lengths(spark, [3, 1, 0, 8, 2, 2, 5, 9])
    for plan in list(TEMPLATE_PLANS.values())[:8]:
        for i, step in enumerate(plan.levels):
            less = Plan(plan.dense, (*plan.levels[:i], *plan.levels[i + 1 :]), plan.strategy)
            small = {"height": 2, "size": 2, "least": 3, "multiple": 3}
            shrunk = lambda p: Plan(p.dense, tuple(Step(s.name, {k: small[k] for k in s.params}) for s in p.levels), p.strategy)  # noqa: B023, E731
            tables = [table_of(m, shrunk(p), "tlb") for p in (plan, less)]
            assert tables[0] != tables[1] or step.name == "tlb_row", (plan, step)


def test_unsupported_partitions_are_refused(spark):
    m = of_lengths(spark, [3, 1, 8])
    x = m.cols().withColumn("x", F.lit(2.0))
    plan = Plan((Step("compress"),), (Step("blb_row", {"height": 2}),), "shared_memory_long_row")
    with pytest.raises(ValueError, match="does not support"):
        run(m, plan, x)
    with pytest.raises(ValueError, match="padding"):
        products.by_strategy(of_lengths(spark, [1] * 40 + [900]), spark.range(900).select(F.col("id").alias("col"), F.lit(1.0).alias("x")), "sell", height=64)


def test_pads_carry_nothing(spark):
    m = of_lengths(spark, [2, 1, 1])
    m = m.with_entries(m.entries.withColumn("val", F.lit(1.0)))
    x = m.cols().withColumn("x", F.when(F.col("col") == 0, float("inf")).otherwise(1.0))
    plan = Plan((Step("compress"),), (Step("row_pad", {"multiple": 4}), Step("tlb_row")), "direct_warp_block_compress")
    assert not [r for r in run(m, plan, x).collect() if r["y"] != r["y"]]
    assert not [r for r in products.by_strategy(m, x, "ell").collect() if r["y"] != r["y"]]


def test_a_hot_row_is_numbered_by_bands(spark, monkeypatch):
    from lattica.operators import division

    monkeypatch.setattr(division, "COLUMN_BAND", 7)
    m = of_lengths(spark, [1] * 30 + [300] + [2] * 30)
    got = sorted((r["row"], r["col"], r["rn"], r["nz"]) for r in division.numbered(m).collect())
    want, at = [], {}
    for nz, (row, col) in enumerate(sorted((r["row"], r["col"]) for r in m.entries.collect())):
        want.append((row, col, at.setdefault(row, 0), nz))
        at[row] += 1
    assert got == want


def test_budget_grants():
    budget = tuner.Budget(steps=2)
    assert budget.tell(10.0) and budget.steps == 1
    assert budget.tell(10.4) and budget.steps == 5  # the least grant
    assert budget.tell(12.4) and budget.steps == 14  # five for each unit gained
    assert budget.tell(99.0) and budget.steps == 38  # the largest grant
    assert not tuner.Budget(steps=1).tell(1.0) and not tuner.Budget(seconds=0.0).tell(1.0)


def test_strategies_and_the_whole_search(spark):
    m = of_lengths(spark, [2, 600, 3, 40, 40, 1])
    by = {(s, p): (points, dense) for s, p, points, dense in tuner.matrix_strategies(m)}
    assert by[1, None][1] == () and by[2, (32, 4, 4096)] == ([0, 1, 2, 3, 5, 6], None)
    points, dense = by[3, (32, 4, 2048)]
    assert points == [0, 1, 3, 6] and [s.name for s in dense] == ["coarse_sort", "row_div"]
    assert by[3, (32, 8, 2048)][1] is None  # the same division as with another rate
    ordered = {p: d for s, p, _, d in tuner.matrix_strategies(of_lengths(spark, [40, 3, 2])) if s == 3 and d is not None}
    assert all(step.name != "coarse_sort" for d in ordered.values() for step in d)
    small, clock = of_lengths(spark, [3, 1, 2]), itertools.count()
    x = small.cols().withColumn("x", F.lit(2.0))
    dense, plans, metric = tuner.whole_search(small, x, seconds=60.0, steps=1, timer=lambda: float(next(clock)))
    assert metric > 0 and sorted(tuner.run_blocks(small, x, dense, plans.__getitem__).collect()) == sorted(products.product(small, x).collect())


def test_templates(spark):
    from lattica.operators import division
    from lattica.plans import templates

    of = lambda lengths, *levels: {r["template"] for r in templates.supported(division.nested(of_lengths(spark, lengths), *levels).entries).collect()}
    even = of([4, 4, 4, 4], 2, 1, 2)
    assert {"direct_warp_block_compress", "shared_memory", "direct_warp_reduce"} <= even and "unaligned_warp_reduce" not in even
    assert "shared_memory_long_row" in of([9, 9], 1, 1, 2) and "direct_warp_compress" not in of([3, 5], 2, 2, 2)
    assert "unaligned_warp_reduce" in of([3, 5], 8, 8, 2)
    assert templates.worth_trying({"direct", "direct_warp_compress", "direct_warp_block_compress"}) == {"direct_warp_block_compress"}
    assert templates.worth_trying({"direct"}) == {"direct"}


def test_search_stops_and_finds_the_best(spark, tmp_path):
    m = of_lengths(spark, [3, 1, 2])
    x = m.cols().withColumn("x", F.lit(2.0))
    clock = iter([0.0, 1.0, 1.0, 1.5, 2.0, 4.0, 5.0, 9.0])
    log = tuner.search(m, x, [Plan(), Plan(strategy="tiles"), Plan(strategy="hyb"), Plan(strategy="ell")], tuner.Budget(steps=3, least_gain=0, most_gain=0), lambda: next(clock))
    assert log.count() == 3
    assert tuner.best(log).first()["template"] == "tiles"
    assert sum(tuner.split_time(100)) == pytest.approx(95)
    for _ in range(2):
        tuner.append_log(log, str(tmp_path / "log"))
        tuner.write_report(log, str(tmp_path / "best"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    assert spark.read.json(str(tmp_path / "best")).first()["template"] == "tiles"


def test_grid(spark):
    got = tuner.grid(spark, {"a": (1, 3, 1), "b": (0, 1, 0.5)}, keep="a > 1")
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in (2.0, 3.0) for b in (0.0, 0.5, 1.0)]


def test_learning(spark):
    lines = spark.range(120).select(F.concat(F.lit("log:"), F.col("id") % 10, F.lit(","), F.col("id") % 3, F.lit(","), (F.col("id") % 10) * 2 + 1).alias("value"))
    rows = learn.columns(learn.parse_log(lines.unionByName(spark.createDataFrame([("other:1,2",)], "value string")), "log:"), 2).cache()
    assert rows.count() == 120
    model = learn.boosted(2, rounds=5).fit(rows)
    error = model.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("target")))).first()[0]
    assert error < 1.0
    low, high = [r["prediction"] for r in learn.sweep(model, {"f0": 0.0, "f1": 1.0}, "f0", [1, 8], spark).orderBy("f0").collect()]
    assert low < high
    seen, unseen = rows.randomSplit([0.7, 0.3], seed=3)
    chosen = learn.cross_validated(seen, 2)
    assert learn.accepted(chosen, seen, unseen) and not learn.accepted(chosen, seen, unseen, least=1.0)
    assert learn.forest(2, trees=3).fit(rows).transform(rows).count() == 120
