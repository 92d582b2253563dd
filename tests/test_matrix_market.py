"""Dense arrays as Matrix-Market text: parts, zeros, comments, and how they are read."""

import random

import pytest

from lattica.model import SparseMatrix
from lattica.sources import text


def made(spark, entries, n_rows, n_cols):
    return SparseMatrix(spark.createDataFrame(entries, "row long, col long, val double"), n_rows, n_cols)


def dense(entries, n_rows, n_cols):
    out = {(r, c): 0.0 for r in range(n_rows) for c in range(n_cols)}
    for r, c, v in entries:
        out[r, c] += v or 0.0
    return out


def rows_of(m):
    rows = m.entries.select("row", "col", "val").collect()
    assert len({(r, c) for r, c, _ in rows}) == len(rows)
    return {(r, c): v for r, c, v in rows}


RNG = random.Random(4)
CASES = [
    ([(RNG.randrange(13), RNG.randrange(17), RNG.choice([0.0, -2.5, 1e10, 3.0, None])) for _ in range(40)], 13, 17),  # several entries at a place
    ([(4, 0, 1.5)], 5, 40),  # whole bands and files of zeros
    ([(r, c, 1.0 + r) for r in range(4) for c in range(4)], 4, 4),  # no zeros
    ([(0, 0, float("inf")), (6, 8, -1.0)], 7, 9),  # first and last
    ([], 3, 2),
    ([], 0, 0),
]


@pytest.mark.parametrize("entries, n_rows, n_cols", CASES)
@pytest.mark.parametrize("band", [5])
def test_an_array_comes_back_whole(spark, tmp_path, monkeypatch, entries, n_rows, n_cols, band):
    monkeypatch.setattr(text, "BAND", band)
    monkeypatch.setattr(text, "CELLS_OF_A_TASK", 20)
    path = str(tmp_path / "array")
    text.write_matrix_market_array(made(spark, entries, n_rows, n_cols), path)
    back = text.read_matrix_market(spark, path)
    assert (back.n_rows, back.n_cols) == (n_rows, n_cols) and rows_of(back) == dense(entries, n_rows, n_cols)


def test_the_values_of_an_array_are_not_moved(spark, tmp_path):
    path = str(tmp_path / "array")
    text.write_matrix_market_array(made(spark, [(r, 3 * r, 2.0) for r in range(90)], 90, 300), path)
    back = text.read_matrix_market(spark, path)
    plan = back.entries._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "RDDScan[row" not in plan
    lines = spark.read.text(path)
    assert lines.count() == 90 * 300 + 2 and lines.filter("value <> '0'").count() == 90 + 2
    assert lines.first()["value"].startswith(text.BANNER)


def test_small_and_large_files_are_read_alike(spark, tmp_path, monkeypatch):
    parts = {
        "a.mtx": "%%MatrixMarket matrix array real general\n% a note\n\n3 4\n1\n % no comment\n".replace(" % no comment\n", "  2.5 \n\n"),
        "b.mtx": "", "c.mtx": "% only a note\n\n", "d.mtx": "NaN\r\n-3e2\r\n% note\r\n0\r\n", "e.mtx": "6\n7\n8\n9\n-Infinity\n 0.0\n12",
    }
    for name, content in parts.items():
        (tmp_path / name).write_bytes(content.encode())
    want = [1.0, 2.5, "nan", -300.0, 0.0, 6.0, 7.0, 8.0, 9.0, float("-inf"), 0.0, 12.0]
    for largest, chunk in ((text.LARGEST_FILE, text.CHUNK), (text.LARGEST_FILE, 3), (1, text.CHUNK)):
        monkeypatch.setattr(text, "LARGEST_FILE", largest)
        monkeypatch.setattr(text, "CHUNK", chunk)
        assert (text._first_file(spark, str(tmp_path)) is None) == (largest == 1)
        got = rows_of(text.read_matrix_market(spark, str(tmp_path)))
        assert [got[i % 3, i // 3] if got[i % 3, i // 3] == got[i % 3, i // 3] else "nan" for i in range(12)] == want


def test_other_names_and_kinds_are_read_by_lines(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 1\n2 1 3\n")
    assert rows_of(text.read_matrix_market(spark, str(tmp_path / "a.mtx"))) == {(1, 0): 3.0}
    assert text._first_file(spark, str(tmp_path / "a.mtx")).endswith("/a.mtx")
    (tmp_path / "a.mtx.bz2").write_bytes(b"x")
    assert text._first_file(spark, str(tmp_path)) is None
