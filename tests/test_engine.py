"""Sources, generators, strategies, cuts and formulas against hand-made cases and plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import formulas
from lattica.model import SparseMatrix
from lattica.operators import cuts, division, features, layout, products, runs, sorting, transfer
from lattica.plans import graph
from lattica.sources import corpus, generators, text

EMPTY_ROWS = ([(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0), (4, 0, 4.0), (4, 3, 5.0)], 5, 4)


def matrix(spark, entries, n_rows, n_cols):
    return SparseMatrix(spark.createDataFrame(entries, "row long, col long, val double"), n_rows, n_cols)


def of_lengths(spark, lengths):
    entries = [(r, c, float(r + c)) for r, k in enumerate(lengths) for c in range(k)]
    return matrix(spark, entries, len(lengths), max([*lengths, 1]))


def dict_of(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def ones(m):
    return m.cols().withColumn("x", F.lit(1.0))


def test_product_has_every_row(spark):
    m = matrix(spark, *EMPTY_ROWS)
    assert dict_of(products.product(m, ones(m)), "row", "y") == {0: 3.0, 1: 0.0, 2: 3.0, 3: 0.0, 4: 9.0}


def test_duplicates_add_up_and_zeros_count(spark):
    m = matrix(spark, [(0, 0, 1.0), (0, 0, 2.0), (1, 1, 0.0)], 2, 2)
    assert dict_of(products.product(m, ones(m)), "row", "y") == {0: 3.0, 1: 0.0}
    assert dict_of(m.row_nnz(), "row", "k") == {0: 2, 1: 1}


@pytest.mark.parametrize("name", products.STRATEGIES)
def test_strategies_agree(spark, name):
    rng = random.Random(4)
    cells = {(rng.randrange(40), rng.randrange(30)) for _ in range(200)} | {(7, c) for c in range(30)}
    m = matrix(spark, [(r, c, float(rng.randrange(1, 9))) for r, c in sorted(cells)], 45, 30)
    x = m.cols().withColumn("x", (F.col("col") + 1).cast("double"))
    options = {"height": 4, "threads": 2} if name == "sell" else {}  # of 32 rows the long one would pad all others
    assert dict_of(products.by_strategy(m, x, name, **options), "row", "y") == dict_of(products.product(m, x), "row", "y")
    if name == "sell":
        with pytest.raises(ValueError, match="the padding is more than 4 times"):
            products.by_strategy(m, x, name, height=32, threads=4)


def test_sort_is_stable_and_restored(spark):
    m = of_lengths(spark, [2, 0, 3, 2, 3, 0])
    got = [r["old_row"] for r in sorting.by_length(m).orderBy("new_row").collect()]
    assert got == [2, 4, 0, 3, 1, 5]
    moved = sorting.apply(m, sorting.coarse(m, [0, 3]))
    assert dict_of(products.restored_product(moved, ones(m)), "row", "y") == dict_of(products.product(m, ones(m)), "row", "y")


def test_positions_do_not_depend_on_bands(spark):
    from lattica.operators.order import global_position, running_sum

    seq = spark.createDataFrame([(i, (i * 7) % 5) for i in range(50)], "row long, k long")
    want = dict_of(running_sum(seq, "row", "k", "s"), "row", "s")
    assert dict_of(running_sum(seq, "row", "k", "s", band=7), "row", "s") == want
    assert want[10] == sum((i * 7) % 5 for i in range(10))
    place = lambda band: dict_of(global_position(seq, [F.desc("k")], ["k"], "row", "p", band=band), "row", "p")
    assert place(6) == place(1000)


LENGTHS = [[0, 5, 1, 7, 0, 0, 9, 2, 2, 2, 30, 1, 0], [1, 1, 1], [4], [0, 0, 3, 0], [3, 3, 3, 3, 3, 3, 0, 0]]


def literal_least(lengths, least, whole=False):
    out, held, full = [0], 0, False
    for row, k in enumerate(lengths):
        if full:
            out.append(row)
            held = 0
        held += k
        full = held >= least
    top = max([r for r, k in enumerate(lengths) if k], default=0)
    return sorted({c for c in out if whole or c <= top} | {len(lengths)})


def literal_adaptive(lengths, most):
    out, held, count = {0}, 0, 0
    for row, k in enumerate(lengths):
        if count and held + k > most:
            out.add(row)
            held = count = 0
        held, count = held + k, count + 1
    return sorted(out | {len(lengths)})


def literal_average(lengths, rate, width):
    out, last = {0}, []
    for row, k in enumerate(lengths):
        if last and not sum(last) / len(last) / rate <= k <= sum(last) / len(last) * rate:
            out.add(row)
            last = []
        last = (last + [k])[-(width - 1) :]
    return sorted(out | {len(lengths)})


@pytest.mark.parametrize("lengths", LENGTHS)
def test_greedy_cuts_equal_loops(spark, lengths):
    m = of_lengths(spark, lengths)
    cut = lambda df: sorted(r["cut"] for r in df.collect())
    assert cut(cuts.least_nnz_cuts(m, 6)) == literal_least(lengths, 6)
    assert cut(cuts.adaptive_cuts(m, 8)) == literal_adaptive(lengths, 8)
    assert cut(cuts.adjacent_average_cuts(m, 2.0, 3)) == literal_average(lengths, 2.0, 3)


def test_exponential_bounds():
    assert cuts.exponential_bounds(32, 4, 2048, 0) == [0, 32, 128, 512, 2048]
    assert cuts.exponential_bounds(2, 2, None, 9) == [0, 2, 4, 8]


def test_division_keeps_entries(spark):
    m = of_lengths(spark, [2, 0, 5, 1, 9])
    for tagged in (division.row_bands(m, 2), division.long_short(m, [0, 2, 5]), division.col_blocks(m, 3).entries, division.nnz_tiles(m, 4).entries):
        assert tagged.agg(F.sum("val")).first()[0] == m.entries.agg(F.sum("val")).first()[0]
        assert tagged.count() == m.entries.count()


def test_padding_changes_no_product(spark):
    m = of_lengths(spark, [2, 0, 5, 1])
    want = dict_of(products.product(m, ones(m)), "row", "y")
    assert dict_of(products.product(layout.pad_cols(m, 6, empty_rows=True), ones(m)), "row", "y") == want
    padded = layout.pad_rows(m, 8)
    assert padded.n_rows == 8 and {k: v for k, v in dict_of(products.product(padded, ones(m)), "row", "y").items() if k < 4} == want


def test_order_check_and_empty_rows(spark):
    rows = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (2, 0, 5), (3, 0, 2)], "pos long, row long, col long")
    assert sorted(r["pos"] for r in features.order_violations(rows, "pos").collect()) == [2, 3]
    assert sorted(r["row"] for r in features.empty_rows(matrix(spark, *EMPTY_ROWS)).collect()) == [1, 3]


@pytest.mark.parametrize(
    ("values", "form"),
    [([0, 3, 6, 9], "linear"), ([7, 7, 7], "constant"), ([1, 1, 2, 2, 2, 9], "branches"), ([0, 2, 4, 0, 2, 4], "cycle_linear"), ([5, 5, 6, 6, 7, 7], "cycle_increase"), (list(range(9, 0, -1)), None)],
)
def test_formulas(spark, values, form):
    assert formulas.best_form(spark.createDataFrame(list(enumerate(values)), "i long, a long")) == form


def test_widths():
    assert [formulas.type_for_bits(b) for b in (1, 8, 9, 33)] == ["u8", "u8", "u16", "u64"]


def test_generators(spark):
    assert generators.wheel(spark, 9).entries.count() == 18
    assert generators.lattice(spark, 5, 2).entries.count() == 4 * (5 - 2) ** 2 + 12 * (5 - 2) + 8
    assert generators.lattice(spark, 3, 3, self_loop=True).entries.count() == 2 * 3 * 9 * 2 + 27
    for width in (4, 40):
        m = generators.uniform(spark, 20, width, 4, seed=1)
        assert {r["n"] for r in m.entries.groupBy("row").agg(F.count_distinct("col").alias("n")).collect()} == {4}
        assert sorted(m.entries.collect()) == sorted(generators.uniform(spark, 20, width, 4, seed=1).entries.collect())
    with pytest.raises(ValueError):
        generators.uniform(spark, 2, 3, 4)


def test_coo_round_trip(spark, tmp_path):
    m = matrix(spark, *EMPTY_ROWS)
    text.write_coo(m, str(tmp_path / "m"))
    back = text.read_coo(spark, str(tmp_path / "m"))
    assert (back.n_rows, back.n_cols) == (5, 4) and sorted(back.entries.collect()) == sorted(m.entries.collect())
    with pytest.raises(ValueError):
        text.prepare(m)


def write(path, content):
    path.write_text(content)
    return str(path)


def test_matrix_market(spark, tmp_path):
    sym = text.read_matrix_market(spark, write(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2\n2 1 3\n3 2\n"))
    assert sorted(map(tuple, sym.entries.collect())) == [(0, 0, 2.0), (0, 1, 3.0), (1, 0, 3.0), (1, 2, 1.0), (2, 1, 1.0)]
    skew = text.read_matrix_market(spark, write(tmp_path / "k.mtx", "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 3\n"))
    assert sorted(map(tuple, skew.entries.collect())) == [(0, 1, -3.0), (1, 0, 3.0)]
    array = text.read_matrix_market(spark, write(tmp_path / "a.mtx", "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n"))
    assert sorted(map(tuple, array.entries.collect())) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    pattern = text.read_matrix_market(spark, write(tmp_path / "p.mtx", "%%MatrixMarket matrix coordinate real general\n2 2 1\n2 1 3\n"), values="pattern")
    assert pattern.entries.first()["val"] == 1.0


def test_arrays_and_layouts(spark, tmp_path):
    seq = spark.createDataFrame([(0, 5), (1, 7)], "i long, a long")
    text.write_array(seq, str(tmp_path / "a"))
    assert sorted(text.read_array(spark, str(tmp_path / "a")).collect()) == [(0, 5), (1, 7)]
    tagged = division.row_bands(matrix(spark, *EMPTY_ROWS), 2)
    text.write_layout(tagged, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 5


def test_runs_on_ties_and_nothing(spark):
    seq = spark.createDataFrame([(i, k) for i, k in enumerate("aabbba")], "pos long, key string")
    assert [(r["key"], r["length"]) for r in runs.run_length_encode(seq).orderBy("run").collect()] == [("a", 2), ("b", 3), ("a", 1)]
    assert runs.run_length_encode(seq.filter("false")).count() == 0


def test_empty_matrix(spark):
    m = matrix(spark, [], 3, 2)
    assert dict_of(products.product(m, ones(m)), "row", "y") == {0: 0.0, 1: 0.0, 2: 0.0}
    assert SparseMatrix.of(m.entries).n_rows == 0
    assert dict_of(features.csr_offsets(m), "row", "start") == {0: 0, 1: 0, 2: 0}


def test_corpus_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v long")
    assert corpus.append_new(rows, str(tmp_path / "f")) == 2
    assert corpus.append_new(rows.unionByName(spark.createDataFrame([("c", 3)], "name string, v long")), str(tmp_path / "f")) == 1
    half = spark.createDataFrame([("s", 1.0, 1.0, 5, 9), ("t", 1.0, 1.0, 9, 9), ("u", 0.5, 1.0, 5, 9)], "name string, psym double, nsym double, header_nnz long, nnz long")
    assert [r["name"] for r in corpus.half_stored(half).collect()] == ["s"]
    assert corpus.settings('{"most_blocks": 2}')["most_blocks"] == 2


@given(st.lists(st.integers(0, 7), min_size=1, max_size=40), st.integers(2, 5), st.integers(1, 12), st.integers(2, 4))
@settings(max_examples=150, deadline=None)
def test_maps_of_bands_compose_to_the_scan(lengths, band, limit, width):
    k = np.array(lengths, np.int64)
    literal = {
        "least": (transfer.greedy(limit, with_row=False), literal_least(lengths, limit, whole=True)),
        "most": (transfer.greedy(limit + 1, with_row=True), literal_adaptive(lengths, limit)),
        "mean": (transfer.adjacent(1.5, width), literal_average(lengths, 1.5, width)),
    }
    for scan, want in literal.values():
        before = min(scan.before, band - 1)
        if before < scan.before:
            continue
        parts = [(np.arange(max(0, a - before), min(a + band, len(k))), min(a, before)) for a in range(0, len(k), band)]
        maps = [scan.read(rows, k[rows], n) for rows, n in parts]
        state, cut_at = scan.start, []
        whole = maps[0]
        for i, ((rows, n), m) in enumerate(zip(parts, maps, strict=True)):
            assert scan.apply(whole, scan.start) == scan.apply(m, state) or i == 0
            cut_at += scan.cuts(rows, k[rows], n, state).tolist()
            state = scan.apply(m, state)
            if i + 1 < len(maps):
                whole = scan.compose(whole, maps[i + 1])
        assert sorted({0, *cut_at}) == [x for x in want if x < len(k)]


@pytest.mark.parametrize(("band", "fan"), [(3, 2), (4, 3), (1000, 64)])
def test_bands_give_the_same_cuts(spark, band, fan):
    rng = random.Random(2)
    lengths = [rng.choice((0, 0, 1, 2, 3, 9)) for _ in range(70)]
    rows = of_lengths(spark, lengths).row_nnz()
    found = lambda scan: sorted({0, *(r["cut"] for r in transfer.scanned(rows, scan, band, fan).collect())})
    assert found(transfer.greedy(7, with_row=False)) == literal_least(lengths, 7, whole=True)[:-1]
    assert found(transfer.greedy(9, with_row=True)) == literal_adaptive(lengths, 8)[:-1]
    assert found(transfer.adjacent(2.0, 3)) == literal_average(lengths, 2.0, 3)[:-1]


def test_nothing_to_cut(spark):
    m = of_lengths(spark, [])
    for cut_at in (cuts.least_nnz_cuts(m, 3), cuts.adaptive_cuts(m, 3), cuts.adjacent_average_cuts(m, 2.0, 3)):
        assert [r["cut"] for r in cut_at.collect()] == [0]


@pytest.mark.parametrize("band", [3, 8, 1000])
def test_intervals_equal_a_search(spark, band):
    from lattica.operators.order import intervals

    cut_at = [2, 3, 3, 17, 18, 40, 99]
    got = {r["row"]: (r["range"], r["low"]) for r in intervals(spark.range(60).withColumnRenamed("id", "row"), spark.createDataFrame([(c,) for c in cut_at], "cut long"), band=band).collect()}
    points = sorted(set(cut_at))
    assert got == {r: (sum(c <= r for c in points) - 1, max((c for c in points if c <= r), default=None)) for r in range(60)}


def test_thousands_of_cuts_are_a_table(spark):
    rng = random.Random(9)
    lengths = [rng.choice((0, 1, 2, 5, 9)) for _ in range(3000)]
    m = of_lengths(spark, lengths)
    divided = graph.prepare(m, graph.Plan((graph.Step("row_div", {"start": 2, "rate": 2, "cap": 8}), graph.Step("compress")))).entries
    window = lambda k: 3 if k >= 8 else 2 if k >= 4 else 1 if k >= 2 else 0
    begins = [r for r in range(3000) if not r or window(lengths[r]) != window(lengths[r - 1])]
    want, low = {}, 0
    for r, k in enumerate(lengths):
        low = r if r in set(begins) else low
        if k:
            want[r] = low
    got = {r["row"]: (r["block"], r["row_lo"]) for r in divided.select("row", "block", "row_lo").distinct().collect()}
    assert {r: lo for r, (_, lo) in got.items()} == want
    numbers = {lo: i for i, lo in enumerate(sorted(set(want.values())))}
    assert len(numbers) > 1000 and all(b == numbers[lo] for b, lo in got.values())
    listed = division.row_ranges(m, [*begins, 3000], with_low=True)
    assert {r["row"]: (r["block"], r["row_lo"]) for r in listed.select("row", "block", "row_lo").distinct().collect()} == got


def test_uniform_draws_move_nothing(spark):
    m = generators.uniform(spark, 50, 90, 6, seed=2)
    assert "Exchange" not in m.entries._jdf.queryExecution().executedPlan().toString()
    draws = spark.range(50).selectExpr("id as row", "explode(sequence(0, 87)) as draw").selectExpr("row", "draw", "pmod(xxhash64(row, draw, 2), 90) as col").collect()
    want = {r: list(dict.fromkeys(d["col"] for d in sorted(draws, key=lambda d: d["draw"]) if d["row"] == r))[:6] for r in range(50)}
    got = m.entries.collect()
    assert sorted((e["row"], e["col"]) for e in got) == sorted((r, c) for r, cs in want.items() for c in cs) and {e["val"] for e in got} == {1.0}


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_grid_splits_a_hot_column(spark, limit):
    rng = random.Random(3)
    cells = {(r, 17) for r in range(300)} | {(rng.randrange(300), rng.randrange(200)) for _ in range(300)}
    m = matrix(spark, [(r, c, float(rng.randrange(1, 9))) for r, c in sorted(cells)], 310, 200)
    x = m.cols().filter("col % 5 != 3").withColumn("x", (F.col("col") + 1).cast("double"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        assert dict_of(products.by_strategy(m, x, "grid", row_band=32, col_band=16), "row", "y") == dict_of(products.product(m, x), "row", "y")
        assert products.gather_grid(m, x, 32, 16).groupBy("row").count().count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["direct", "tiles", "adaptive", "hyb"])
def test_wide_matrices_agree(spark, monkeypatch, name):
    """Beyond the bound of a broadcast x meets the entries by blocks, in every strategy."""
    rng = random.Random(5)
    cells = {(r, 3) for r in range(40)} | {(rng.randrange(40), rng.randrange(90)) for _ in range(150)}
    m = matrix(spark, [(r, c, float(rng.randrange(1, 9))) for r, c in sorted(cells)], 42, 90)
    x = m.cols().withColumn("x", (F.col("col") + 1).cast("double"))
    want = dict_of(products.product(m, x), "row", "y")
    monkeypatch.setattr(products, "MOST_BROADCAST", 10)
    monkeypatch.setattr(products, "ROW_BAND", 16)
    monkeypatch.setattr(products, "COL_BAND", 8)
    assert dict_of(products.by_strategy(m, x, name), "row", "y") == want


def test_places_of_any_keys(spark):
    rng = random.Random(6)
    keys = {"unique": rng.sample(range(10**6), 300), "one": [7] * 300, "nulls": [None if rng.random() < 0.3 else rng.randrange(4) for _ in range(300)]}
    for own in keys.values():
        seq = spark.createDataFrame(list(enumerate(own)), "pos long, key long").repartition(7)
        want = sorted(range(300), key=lambda i: (own[i] is not None, own[i] or 0, i))
        assert dict_of(runs.sorted_places(seq, "key"), "pos", "place") == {i: n for n, i in enumerate(want)}
        down = sorted(range(300), key=lambda i: (own[i] is None, -(own[i] or 0), i))
        assert dict_of(runs.sorted_places(seq, "key", descending=True), "pos", "place") == {i: n for n, i in enumerate(down)}


def test_segments_that_hold_any_share_are_sorted(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice((1, 1, 1, 1, 2, None, 5)), rng.randrange(5)) for i in range(300)]
    seq = spark.createDataFrame(rows, "pos long, segment long, value long").repartition(5)
    want = {}
    for s in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        want |= {r[0]: n for n, r in enumerate(own)}
    assert dict_of(runs.segmented_sort(seq, "segment", "value"), "pos", "place") == want


@pytest.mark.parametrize("band", [4, 7, 1000])
@pytest.mark.parametrize("share", [0.0, 0.03, 0.5])
def test_segmented_scan_spans_bands(spark, band, share):
    rng = random.Random(12)
    rows = [(i, rng.randrange(-3, 9), rng.random() < share) for i in range(120)]
    want, total = {}, 0
    for pos, v, flag in rows:
        total = v if flag else total + v
        want[pos] = total
    seq = spark.createDataFrame(rows, "pos long, value long, flag boolean")
    assert dict_of(runs.segmented_scan(seq, "value", "flag", band=band), "pos", "scan") == want
    assert dict_of(runs.segmented_scan(seq, "value", "flag", inclusive=False, band=band), "pos", "scan") == {p: want[p] - v for p, v, _ in rows}
