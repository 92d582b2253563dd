"""The filter audit against loops over documents, orders and steps."""

import itertools
import random
import re
from collections import Counter

import duckdb
import pytest

from lattica.llm import filter_audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails_of(rows):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        yield part or "", d, {
            f for f, failed in (
                ("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)),
                ("D", any(c in "#$%&*|" for c in t)), ("E", d is not None and d > least[t]),
            ) if failed
        }


def brute(rows, good, toxic):
    cells, shapley, parts = {}, Counter(), {}
    for part, d, fails in fails_of(rows):
        parts.setdefault(part, []).append((d, fails))
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in docs if f in x[1]]
                cells[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in docs), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in cells.items()}


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def sample():
    rng = random.Random(5)
    vocabulary = [a + b for a in ("ta", "Ri", "MO", "sel", "é", "日") for b in "abcdefghijklmnopqrstuvwx"]
    texts = [None, "", " \t\n", "A", "$", "ÉÉÉ", "x" * 70_000, "w " * 500]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 99, 100, 101, 140)))) + rng.choice(("", "", " #", "*")) for _ in range(40)]
    rows = [(i, t, rng.choice(("en", "de", None, ""))) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en") for i in (0, 1, 9, 9, 10, 11)] + [(9, texts[9], "de"), (None, texts[9], "de"), (None, "own", None), (-5, texts[12], "fr")]
    return rows


LABELS = [(3, 1, 0), (9, 1, 1), (9, 0, 0), (10, 0, 1), (20, None, 1), (None, 1, 1), (10_000, 1, 1)]


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_loops(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(filter_audit, "ROWS", 3)
        monkeypatch.setattr(filter_audit, "PARTS", 1)
        monkeypatch.setattr(filter_audit, "SLICE_BYTES", 100)
    rows = sample()
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, mask int, digest int, part string")
    labels = spark.createDataFrame([(*x, 0) for x in LABELS], "doc_id long, quality int, toxic int, good int")
    got = rows_of(filter_audit.filter_audit(docs, labels))
    assert got == brute(rows, {d for d, q, _ in LABELS if q == 1 and d is not None}, {d for d, _, t in LABELS if t == 1 and d is not None})


def test_sql_equals_the_query(spark, tmp_path):
    rows = sample()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(queries.OP11_SQL)
    names = [x[0] for x in want.description]
    want = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in (dict(zip(names, x, strict=True)) for x in want.fetchall())}
    assert rows_of(queries.op11_filter_audit(spark, str(tmp_path))) == want


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).collect() == []
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and all(r["good_lost"] == r["toxic_lost"] == 0 for r in one)
    assert {r["removed"] for r in one if r["filter_order"][r["step"] - 1] == "A"} == {1}


def test_the_table_of_first_failures():
    table, names = filter_audit.first_failures(), filter_audit.orders()
    assert table.shape == (32, 120) and len(set(names)) == 120 and names[0] == "ABCDE"
    for mask in range(32):
        for i, order in enumerate(names):
            assert table[mask, i] == next((s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)


def test_other_numbers_of_filters(spark):
    rows = [("p", m, m == 3, None) for m in (0, 1, 2, 3, 3)]
    got = rows_of(filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), "XY"))
    assert got == {("p", "XY", 1): (2, 3, 0, 1, 2, 0, 4), ("p", "XY", 2): (1, 1, 2, 1, 0, 0, 4), ("p", "YX", 1): (2, 3, 0, 1, 2, 0, 4), ("p", "YX", 2): (1, 1, 2, 1, 0, 0, 4)}
