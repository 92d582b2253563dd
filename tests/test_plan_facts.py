"""Facts from row lengths against those of partitions that are laid out."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import features
from lattica.plans import facts, learn, templates, tuner
from lattica.plans.graph import Plan, Step, lower, prepare
from tests.test_engine import of_lengths

C = (Step("compress"),)
PLANS = [
    Plan(C, steps, template)
    for template, steps in (
        ("shared_memory_long_row", (Step("blb_col", {"size": 4}),)),
        ("shared_memory_long_row", (Step("blb_col", {"size": 3, "merge_tail": False}),)),
        ("direct_warp_compress", (Step("row_pad", {"multiple": 4}), Step("blb_row", {"height": 4}), Step("tlb_row"))),
        ("direct_warp_block_compress", (Step("row_pad", {"multiple": 8}), Step("tlb_row"))),
        ("unaligned_warp_reduce", (Step("tlb_nnz", {"size": 3}),)),
        ("unaligned_total_warp_reduce", (Step("tlb_nnz", {"size": 1}),)),
        ("direct_warp_reduce", (Step("wlb_col", {"size": 2}),)),
        ("shared_memory_warp_reduce", (Step("row_pad", {"multiple": 2}), Step("blb_row", {"height": 2}), Step("wlb_col", {"size": 4}))),
        ("shared_memory_warp_reduce", (Step("blb_row", {"least": 7}), Step("wlb_col", {"size": 4}))),
        ("shared_memory_warp_compress", (Step("row_pad", {"multiple": 2}), Step("blb_row", {"height": 2}), Step("tlb_col", {"size": 3}))),
        ("shared_memory_warp_compress", (Step("blb_row", {"least": 7}), Step("tlb_col", {"size": 2}))),
        ("shared_memory", (Step("blb_row", {"height": 3}), Step("tlb_col", {"size": 1}))),
        ("direct", (Step("row_pad", {"multiple": 5}),)),
    )
]


@pytest.mark.parametrize("lengths", [[3, 1, 0, 8, 2, 2, 0, 40, 1], [1, 1, 9, 1, 0, 0, 0, 0, 0, 0, 2]])
def test_facts_equal_those_of_laid_out_plans(spark, lengths):
    m = of_lengths(spark, lengths)
    got = {r["plan"]: r for r in facts.plan_facts(m, PLANS).collect()}
    assert len(got) == len(PLANS)
    for i, plan in enumerate(PLANS):
        state = lower(prepare(m, plan), plan).entries
        want = templates.facts(state).first().asDict()
        assert {f: got[i][f] for f in facts.FACTS} == want, plan
        assert got[i]["pad_rows"] == state.filter("is_pad").select("row").distinct().count()
        assert (got[i]["reason"] != "support") == templates.supports(state, plan.strategy), plan
        assert got[i]["admitted"] == (got[i]["reason"] == "")


def test_parts_of_a_divided_matrix(spark):
    m = of_lengths(spark, [9, 9, 9, 9, 2, 2, 0, 1, 1, 1])
    plans = [p for p in PLANS if "least" not in str(p)]
    for part in tuner.parts_of(m, (Step("row_div", {"cuts": [0, 4, 10]}),)):
        got = {r["plan"]: r for r in facts.plan_facts(part, plans).collect()}
        for i, plan in enumerate(plans):
            want = templates.facts(lower(prepare(part, plan), plan).entries).first().asDict()
            assert {f: got[i][f] for f in facts.FACTS} == want, plan


def test_padding_and_narrower_conditions(spark):
    m = of_lengths(spark, [1] * 30 + [40] + [1] * 33)
    wide = Plan(C, (Step("row_pad", {"multiple": 64}), Step("blb_row", {"height": 64}), Step("tlb_row")), "direct_warp_compress")
    flat = Plan(C, (Step("row_pad", {"multiple": 2}), Step("blb_row", {"height": 2}), Step("tlb_row")), "direct_warp_compress")
    got = facts.plan_facts(m, [wide, flat, PLANS[4]], is_sorted=True).collect()
    assert [r["reason"] for r in got] == ["padding", "", "narrower"]
    assert got[0]["padding_ratio"] == features.band_padding(m, 64).first()["padding_ratio"] and got[1]["padding_ratio"] == features.band_padding(m, 2).first()["padding_ratio"]
    assert [r["reason"] for r in facts.plan_facts(m, [wide], most_padding=50.0).collect()] == ["narrower"]  # one block only


def test_no_entries(spark):
    m = of_lengths(spark, [0, 0])
    got = facts.plan_facts(m, [PLANS[0], Plan(C, (), "empty")]).collect()
    assert [(r["reason"], r["blbs"]) for r in got] == [("support", None), ("", None)]


def test_every_skeleton_has_facts(spark):
    m = of_lengths(spark, [200, 150, 128, 300])
    plans = tuner.candidates(m)
    got = facts.plan_facts(m, plans)
    assert got.count() == len(plans) and {r["template"] for r in got.filter(F.col("admitted")).collect()} >= {"shared_memory_long_row", "shared_memory_warp_reduce"}


def cost_log(spark, m, plans):
    """A log whose metric falls with what a plan stores and with its threads on one row."""
    rows = [r.asDict() for r in facts.plan_facts(m, plans).orderBy("plan").collect()]
    cost = [r["padding_ratio"] + 0.3 * r["tlbs_of_row"] + 0.05 * r["rows_of_blb"] for r in rows]
    return [(learn.plan_features(plans[r["plan"]], r), 100.0 / c) for r, c in zip(rows, cost, strict=True)]


def test_a_model_of_the_log_orders_the_trials(spark):
    m = of_lengths(spark, [40, 3, 33, 64, 5, 70, 32, 32, 90, 1, 2, 35])
    plans = tuner.candidates(m)
    log = cost_log(spark, m, plans)
    table = spark.createDataFrame(log * 3, "features array<double>, target double")
    model = learn.surrogate(table)
    assert model is not None
    ordered = learn.in_order(model, list(zip(plans, [f for f, _ in log], strict=True)), spark)
    of = dict(zip([p.record() for p in plans], [t for _, t in log], strict=True))
    best = max(of.values())
    trials = lambda ps: next(i for i, p in enumerate(ps) if of[p.record()] == best)
    assert trials([p for p, _ in ordered]) < trials(plans) and trials([p for p, _ in ordered]) < 5
    assert learn.in_order(None, [(1, [0.0])], spark) == [(1, [0.0])]


def test_a_log_that_explains_nothing_is_not_used(spark):
    noise = [([float(i % 7 == k) for k in range(learn.WIDTH)], float((i * 7919) % 13)) for i in range(60)]
    assert learn.surrogate(spark.createDataFrame(noise, "features array<double>, target double")) is None
    assert learn.surrogate(spark.createDataFrame(noise[:3], "features array<double>, target double")) is None


def test_guided_search_tries_what_is_admitted(spark):
    m = of_lengths(spark, [3, 1, 0, 8, 2, 2, 0, 40, 1])
    x = m.cols().withColumn("x", F.lit(2.0))
    ticks = iter(range(1000))
    log = tuner.guided_search(m, x, PLANS[:6], None, tuner.Budget(steps=3), timer=lambda: float(next(ticks)))
    rows = log.collect()
    admitted = {r["record"] for r in facts.plan_facts(m, PLANS[:6]).filter("admitted").collect()}
    assert len(rows) == min(3, len(admitted)) and {r["record"] for r in rows} <= admitted and all(r["target"] == 1.0 and len(r["features"]) == learn.WIDTH for r in rows)


def test_rows_without_entries_count_in_their_block(spark):
    m = of_lengths(spark, [9, 9, 0, 9, 2, 2, 2, 1, 0, 0])
    for divide in ({"cuts": [0, 4, 7, 10]}, {"start": 2, "rate": 4, "cap": 8}):
        got = [tuner.facts_of(p) for p in tuner.parts_of(m, (Step("row_div", divide),))]
        ranges = [[9, 9, 0, 9], [2, 2, 2], [1, 0, 0]] if "cuts" in divide else [[9, 9], [9], [2, 2, 2], [1, 0, 0]]
        assert [(b.least, b.longest, b.average) for b in got] == [(min(r), max(r), sum(r) // len(r)) for r in ranges]
