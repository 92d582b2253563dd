"""The search with its whole budget: how many plans it tries, and what its trials share."""

import glob

import pytest
from pyspark.sql import functions as F

from lattica import plan_queries
from lattica.model import SparseMatrix
from lattica.operators import cuts, division, products
from lattica.plans import graph, tuner
from lattica.plans.graph import Plan, Step
from lattica.session import shared_dir


@pytest.fixture(scope="module")
def made(spark):
    lengths = [40 + r % 9 for r in range(70)] + [2, 0, 3]
    entries = [(r, 5 * c + r % 5, float(r + c)) for r, n in enumerate(lengths) for c in range(n)]
    m = SparseMatrix(spark.createDataFrame(entries, "row long, col long, val double"), len(lengths), 250)
    return m, m.cols().withColumn("x", (F.col("col") % 7 + 1).cast("double"))


def ys(df):
    return {r["row"]: r["y"] for r in df.collect()}


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_the_search_query_has_the_whole_budget(made, monkeypatch):
    m, x = made
    tried, listed, shortlist = [], [], tuner.shortlist
    monkeypatch.setattr(tuner, "matrix_strategies", lambda matrix: [(1, None, [0, matrix.n_rows], ())])
    monkeypatch.setattr(tuner, "shortlist", lambda *a: listed.extend(shortlist(*a)) or listed)
    monkeypatch.setattr(tuner, "trial", lambda matrix, x, plan, *a, **k: tried.append(plan) or ([], [], "", [], float(len(tried))))
    got = ys(plan_queries.searched(m))
    assert len(listed) > 10 and tried == [plan for plan, _ in listed]  # each is better than the last, so that the budget grows
    assert got == ys(products.product(m, x))
    tried.clear(), listed.clear()
    monkeypatch.setattr(tuner, "trial", lambda matrix, x, plan, *a, **k: tried.append(plan) or ([], [], "", [], 1.0))
    plan_queries.searched(m)
    assert len(tried) == tuner.Budget().steps  # none is better than the first


PLANS = [
    ((Step("tlb_nnz", {"size": 8}),), "unaligned_warp_reduce"),
    ((Step("row_pad", {"multiple": 64}), Step("blb_row", {"height": 64}), Step("tlb_row")), "direct_warp_compress"),
    ((Step("row_pad", {"multiple": 73}), Step("blb_row", {"height": 73}), Step("tlb_row")), "direct_warp_compress"),
    ((Step("blb_row", {"least": 100}), Step("wlb_col", {"size": 32})), "shared_memory_warp_reduce"),
    ((), "direct"),
]


@pytest.mark.parametrize("dense", [(Step("row_div", {"cuts": [0, 20, 71, 73]}),), (Step("coarse_sort", {"every": 1}), Step("row_div", {"cuts": [0, 30, 73]}))])
def test_trials_share_numbered_blocks(spark, made, dense):
    m, x = made
    kept = lambda: set(glob.glob(f"{shared_dir(spark)}/kept-*"))
    parts = tuner.parts_of(m, dense)
    assert sum(p.entries.count() for p in parts) == m.entries.count()
    for part in parts:
        part.row_nnz()
        plain = part.with_entries(part.entries)
        assert rows_of(part.numbers, "row", "col", "val", "rn", "k", "nz") == rows_of(division.numbered(plain), "row", "col", "val", "rn", "k", "nz")
        before = kept()
        ready = graph.prepare(part, Plan((Step("compress"),), PLANS[1][0]))
        padded, again = graph.padded_rows(ready, 64), graph.padded_rows(plain, 64)
        assert len(kept() - before) == 0 and padded.numbers is not None
        assert rows_of(padded.numbers, "row", "col", "is_pad", "rn", "k", "nz") == rows_of(division.numbered(again), "row", "col", "is_pad", "rn", "k", "nz")
    for steps, strategy in PLANS:
        before = kept()
        got = ys(tuner.run_blocks(m, x, dense, lambda i, p=Plan((Step("compress"),), steps, strategy): p, parts))
        assert not any("col" in spark.read.parquet(path).columns for path in kept() - before)  # no trial deals and keeps the entries again
        assert got == ys(products.product(m, x))


def test_cuts_by_entries_are_found_once(made):
    m, _ = made
    held = m.held()
    first = cuts.least_nnz_cuts(held, 100)
    assert cuts.least_nnz_cuts(held, 100) is first and cuts.least_nnz_cuts(held, 200) is not first
    assert rows_of(first, "cut") == rows_of(cuts.least_nnz_cuts(m, 100), "cut")
    assert not held.with_entries(m.entries).found_cuts
