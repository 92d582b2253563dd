"""Closed forms by mergeable summaries, and the store that uses them."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import formulas
from lattica.functions.block_forms import Stretch, block_forms, value_of
from lattica.model import SparseMatrix
from lattica.operators import division
from lattica.plans import graph
from lattica.sources import compressed


def literal(a):
    """The form by its definition."""
    n, b = len(a), a[0]
    if len(set(a)) == 1:
        return "constant", [b]
    c = a[1] - b
    if c >= 0 and all(x == b + c * i for i, x in enumerate(a)):
        return "linear", [b, c]
    p = next((i for i in range(1, n) if a[i] == b), None)
    if p and 1 < p < n and n % p == 0 and all(x == b + c * (i % p) for i, x in enumerate(a)):
        return "cycle_linear", [p, b, c]
    p = next(i for i in range(n) if a[i] != b)
    if n > 2 and n % p == 0 and all(x == b + i // p for i, x in enumerate(a)):
        return "cycle_increase", [p, b]
    runs = [i for i in range(n) if not i or a[i] != a[i - 1]]
    if n > 2 and len(runs) <= 5:
        return "branches", [x for i in runs for x in (i, a[i])]
    return "stored", []


SHAPES = {
    "constant": [4] * 9, "linear": [3 + 5 * i for i in range(9)], "falling": [9 - i for i in range(9)], "cycle": [2 + 3 * (i % 4) for i in range(12)], "down_cycle": [9 - 2 * (i % 3) for i in range(9)],
    "pairs": [i % 2 for i in range(8)], "increase": [7 + i // 3 for i in range(12)], "ragged": [7 + i // 3 for i in range(11)], "branches": [1, 1, 5, 5, 5, 2, 2], "six": [1, 2, 1, 2, 2, 1, 3, 9, 1],
    "one": [5], "two": [5, 2], "late": [0, 1, 2, 0, 1, 2, 0, 1, 3],
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_forms_of_known_shapes(name):
    a = SHAPES[name]
    assert Stretch.of(0, np.array(a)).form() == literal(a)


@given(st.one_of(st.lists(st.integers(0, 3), min_size=1, max_size=24), st.sampled_from(sorted(SHAPES.values()))), st.lists(st.integers(1, 23), max_size=5))
@settings(max_examples=300, deadline=None)
def test_stretches_merge_to_the_whole(a, cuts):
    at = [0, *sorted({c for c in cuts if c < len(a)}), len(a)]
    whole = None
    for x, y in zip(at[:-1], at[1:], strict=True):
        own = Stretch.read(Stretch.of(x, np.array(a[x:y])).numbers())
        whole = own if whole is None else Stretch.read(whole.then(own).numbers())
    assert whole.form() == literal(a)


@pytest.mark.parametrize("band", [3, 65_536])
def test_all_blocks_in_one_pass(spark, band):
    rng = random.Random(1)
    arrays = {(b, name): SHAPES[s] for b, s in enumerate(sorted(SHAPES)) for name in ("row",)} | {(b, "col"): [rng.randrange(3) for _ in range(rng.randrange(1, 30))] for b in range(40)}
    rows = [(b, name, i, x) for (b, name), a in arrays.items() for i, x in enumerate(a)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "block long, array string, i long, a long")
    got = {(r["block"], r["array"]): (r["form"], r["params"], r["n"], r["high"]) for r in block_forms(df, band).collect()}
    assert got == {k: (*literal(a), len(a), max(a)) for k, a in arrays.items()}
    # Each form gives its array again.
    made = df.join(block_forms(df), ["block", "array"]).filter("form <> 'stored'").filter(value_of(F.col("form"), F.col("params"), F.col("i")) != F.col("a"))
    assert made.count() == 0


def test_forms_agree_with_those_of_single_arrays(spark):
    for a in SHAPES.values():
        seq = spark.createDataFrame(list(enumerate(a)), "i long, a long")
        assert (formulas.best_form(seq) or "stored") == literal(a)[0]


def divided(m, height):
    cuts = m.rows().filter(F.col("row") % height == 0).select(F.col("row").alias("cut"))
    return graph.compressed(m.with_entries(division.row_ranges(m, cuts, with_low=True)))


def entries_of(m):
    return sorted((r["row"], r["col"], r["val"]) for r in m.entries.collect())


def test_a_dense_matrix_keeps_its_values_only(spark, tmp_path):
    cells = [(r, c, float(r * 8 + c)) for r in range(40) for c in range(8)]
    m = SparseMatrix(spark.createDataFrame(cells, "row long, col long, val double"), 40, 8)
    codes = compressed.write(divided(m, 4), str(tmp_path), chunk=7)
    assert {(r["row_code"], r["col_code"]) for r in codes.collect()} == {("cycle_increase", "cycle_linear")}
    assert sorted(os.listdir(tmp_path)) == ["blocks", "facts", "form-form"]
    assert set(spark.read.parquet(f"{tmp_path}/form-form").columns) == {"block", "start", "n", "val"}
    assert entries_of(compressed.read(spark, str(tmp_path))) == sorted(cells)
    assert {(r["bytes_before"] / r["n"], r["bytes_after"] / r["n"]) for r in compressed.sizes(codes).collect()} == {(24.0, 8.0)}


@pytest.mark.parametrize("chunk", [5, 4096])
def test_mixed_encodings_come_back(spark, tmp_path, chunk):
    rng = random.Random(4)
    cells = {(r, c) for r in range(30) for c in range(6)} | {(r, rng.choice((rng.randrange(100), rng.randrange(40_000), rng.randrange(1 << 33)))) for r in range(30, 90) for _ in range(9)} | {(95, 3)}
    entries = [(r, c, float(r + c % 7)) for r, c in sorted(cells)] + [(95, 3, 1.0), (95, 3, 1.0)]
    m = SparseMatrix(spark.createDataFrame(entries, "row long, col long, val double"), 100, 1 << 33)
    codes = {(r["row_code"], r["col_code"]) for r in compressed.write(divided(m, 3), str(tmp_path), chunk).collect()}
    assert {"cycle_increase"} < {r for r, _ in codes} and {"cycle_linear", "long"} <= {c for _, c in codes}
    assert entries_of(compressed.read(spark, str(tmp_path))) == sorted(entries)


def test_an_empty_matrix_is_stored(spark, tmp_path):
    m = SparseMatrix(spark.createDataFrame([], "row long, col long, val double"), 4, 4)
    compressed.write(divided(m, 2), str(tmp_path))
    back = compressed.read(spark, str(tmp_path))
    assert back.n_rows == 4 and back.entries.count() == 0
