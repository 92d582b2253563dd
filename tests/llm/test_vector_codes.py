"""Vector codes against plain loops over whole numbers, and against SQL."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lattica.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    n = len(order[0][1])
    kept, order = [r for r in kept if len(r[1]) == n], [r for r in order if len(r[1]) == n]
    cut = lambda v: [[math.floor(4096 * float(np.float32(x))) for x in v][p * n // parts : (p + 1) * n // parts] for p in range(parts)]
    books = [[cut(r[1])[p] for r in order[:entries]] for p in range(parts)]
    data = [cut(r[1]) for r in kept]

    def nearest(x, book):
        distances = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        members = [defaultdict(list) for _ in range(parts)]
        for v in data:
            for p in range(parts):
                members[p][nearest(v[p], books[p])[0]].append(v[p])
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if (m := members[p].get(e)) else old for e, old in enumerate(books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    got = [[nearest(v[p], books[p]) for p in range(parts)] for v in data]
    errors = [sum(d for _, d in g) for g in got]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    return [(r[0], "".join(f"{c:02x}" for c, _ in g), e, by_label[r[2]], sha) for r, g, e in zip(kept, got, errors, strict=True)]


def sample(n=150, dimensions=16, seed=3):
    rng = random.Random(seed)
    rows = [(3 * i % 151, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dimensions)], rng.choice((0, 1, 2, None))) for i in range(n)]
    rows += [rows[5], rows[5], (7, rows[9][1], 1), (None, rows[2][1], None)] + [(900 + i, rows[8][1], 2) for i in range(40)]
    bad = [None, [], [None] * dimensions, [0.1] * (dimensions - 1) + [float("nan")], [float("inf")] + [0.0] * (dimensions - 1), [0.5] * (dimensions - 1), [0.5] * 2 * dimensions]
    return rows + [(-1 - i if i < 5 else 2000 + i, v, 0) for i, v in enumerate(bad)]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("block", "dimensions", "n"), [(4096, 16, 150), (7, 16, 150), (4096, 8, 5)])
def test_codes_equal_loops(spark, monkeypatch, block, dimensions, n):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = sample(n, dimensions) if n > 100 else sample(20, dimensions)[:n]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(5)
    assert rows_of(vector_codes.compress(df)) == sorted(brute(rows), key=repr)


def test_sql_equals_the_query(spark, tmp_path):
    rows = [r for r in sample() if not r[1] or len(r[1]) == 16]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.OP13_SQL)
    assert [x[0] for x in want.description] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(queries.op13_vector_codes(spark, str(tmp_path))) == sorted(want.fetchall(), key=repr)


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 0, "", 0), (2, [float("nan")] * 8, 0, "", 0)]):
        got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_sizes_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="do not divide"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 9, 0, "", 0)], SCHEMA))
    with pytest.raises(Exception, match="is beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 0, "", 0)], SCHEMA))


def test_decoded_vectors_have_the_stated_error(spark):
    rows = [r for r in sample() if r[1] and len(r[1]) == 16 and all(x is not None and math.isfinite(x) for x in r[1])]
    df = vector_codes.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    books = vector_codes.fit(df, entries=4, rounds=3)
    assert books.values.shape == (8, 4, 2)
    want = {(r[0], tuple(r[1])): [math.floor(4096 * x) for x in r[1]] for r in rows}
    errors = sorted(r["error"] for r in vector_codes.encode(df, books).collect())
    back = vector_codes.decode(vector_codes.encode(df, books), books).join(df, "vec_id").collect()
    for r in back:
        if (r["vec_id"], tuple(r["embedding"])) in want and [x[0] for x in rows].count(r["vec_id"]) == 1:
            assert r["error"] == sum((a - b) ** 2 for a, b in zip(r["whole"], want[r["vec_id"], tuple(r["embedding"])], strict=True))
    assert sum(errors) < sum(r["error"] for r in vector_codes.encode(df, vector_codes.fit(df, entries=4, rounds=0)).collect())
