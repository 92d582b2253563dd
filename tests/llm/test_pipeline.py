"""The pipeline's stages against brute force, and the contracts of the registered queries."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import decontaminate, nbest, queries
from tests.llm.test_operators import brute_classes, brute_lines, edit_distance_inside

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_nbest_pieces": {"doc_id", "n_pieces", "ids_crc32", "scores", "nbest_crc32", "round_trip"},
    "op2_ppm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3_target_ratio": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"},
    "op4_edit_matches": {"doc_id", "contaminated", "item_ids", "distances"},
    "op5_jump_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6_repeated_windows": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_line_runs": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op8_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op10_weighted_minhash": {"doc_id", "class_id", "class_size"},
}


def tables(spark, tmp_path, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long, node long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path, prose):
    item = prose[20]
    texts = [
        *prose[:5],
        prose[0],  # a copy
        prose[1].replace(" ", "  ", 1),  # the same words
        f"start {item} end",  # a leak
        None,
        "12345 !!",
        *[f"unique number {'abcdefghijklmnop'[i]} {prose[i + 6]}\nAll rights reserved" for i in range(12)],
    ]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2) for i, t in enumerate(texts)]
    folder = tables(spark, tmp_path, rows, [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everything = set(range(len(texts)))
    assert kept == [everything - {8, 9}, everything - {8, 9}, everything - {5, 6, 8, 9}, everything - {5, 6, 7, 8, 9}]
    left = {r["doc_id"]: r for r in docs.collect()}
    assert all(left[i]["text"] == texts[i].removesuffix("\nAll rights reserved") for i in left)
    assert all(left[i]["n_chars"] == len(left[i]["text"]) for i in left)
    coder = nbest.NBestCoder()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == left.keys()
    for i, r in got.items():
        ranked = coder.encode(left[i]["text"])
        assert tuple(r["ids"]) == ranked[0][1] and r["scores"] == pytest.approx([s for s, _ in ranked]) and r["round_trip"] and r["n_pieces"] == len(r["ids"])


def test_a_missing_language_is_filled_in(spark, tmp_path):
    rows = [(i, t, x, "s", 1, 1, 2) for i, (t, x) in enumerate([("the house and the garden", "en"), ("das Haus und der Garten", "de"), ("und das Haus", None), ("the garden", ""), ("?!", None)])]
    folder = tables(spark, tmp_path, rows, [])
    got = corpus_pipeline.keep_languages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert {r["doc_id"]: r["lang"] for r in got} == {0: "en", 1: "de", 2: "de", 3: "en"}


def test_texts_are_parsed_once(spark, tmp_path):
    folder = tables(spark, tmp_path, [(i, "some words of a language", "en", "s", 1, 1, 2) for i in range(3)], [])
    got = corpus_pipeline.keep_languages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_repeated_rows_leave_one(spark, tmp_path, prose):
    rows = [(7, prose[0], "en", "s", 1, 1, 2)] * 2 + [(8, prose[3], "en", "s", 1, 1, 2)]
    folder = tables(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, folder).collect()) == [7, 8]


def test_different_texts_under_one_id(spark, tmp_path, prose):
    texts = [(1, prose[0]), (2, prose[0]), (2, prose[3]), (None, prose[3]), (None, None), (5, None), (6, prose[4]), (6, prose[4])]
    folder = tables(spark, tmp_path, [(i, t, "en", "s", 1, 1, 2) for i, t in texts], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.keep_one_of_each(spark, docs, folder).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, prose[0]), (2, prose[3]), (None, None), (5, None), (6, prose[4])], key=repr)


def test_the_whole_pipeline_equals_brute_force(spark, tmp_path):
    """200 documents with copies, near copies, common lines, leaks, and texts without a letter: the stages document by document."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice(["ta", "ri", "mo", "sel", "ku", "an"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [text(rng.randrange(3, 70)) for _ in range(120)]
    items = [(i, text(9)) for i in range(3)]
    for i in range(80):
        kind, own = i % 8, texts[rng.randrange(len(texts))]
        if kind == 0:
            own = own.replace("a", "e", 1)
        elif kind == 1:
            own = f"{own}\nAll rights reserved\n{text(4)}"
        elif kind == 2:
            own = f"{text(12)} {items[i % 3][1].upper()} {text(5)}"
        elif kind == 3:
            own = f"{text(12)} {items[i % 3][1][1:]} {text(5)}"
        elif kind == 4:
            own = rng.choice(("12 34", "", None, "?!\n"))
        elif kind == 5:
            own = f"{own} {rng.choice(vocabulary)}"
        texts.append(own)
    texts = [f"{t}\n all rights reserved" if t and i % 11 == 0 else t for i, t in enumerate(texts)]
    folder = tables(spark, tmp_path, [(i, t, "xx", "s", len(t or ""), 1, 2) for i, t in enumerate(texts)], items)

    left = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    left = [(i, kept) for (i, _), (_, _, kept) in zip(left, brute_lines([t for _, t in left], 10), strict=True)]
    frame = spark.createDataFrame([(i, t) for i, t in left], "doc_id long, text string")
    classes = brute_classes(frame, [t for _, t in left])
    left = [(i, t) for k, (i, t) in enumerate(left) if classes.index(classes[k]) == k or not t.split()]
    found = lambda t: any(edit_distance_inside(item, decontaminate.normal(t)) <= int(decontaminate.ERROR_RATE * len(item)) for item in (decontaminate.normal(x) for _, x in items))
    left = [(i, t) for i, t in left if not found(t)]
    coder = nbest.NBestCoder()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == [i for i, _ in left] and 60 < len(left) < 160
    for i, t in left:
        ranked = coder.encode(t)
        assert tuple(got[i]["ids"]) == ranked[0][1] and got[i]["round_trip"] and got[i]["scores"] == pytest.approx([s for s, _ in ranked])


def test_no_documents(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_contracts(spark, name):
    got = queries.queries()[name](spark, SF)
    assert set(got.columns) == COLUMNS[name]
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert len(ids) == documents.count() and set(ids) == {r["doc_id"] for r in documents.select("doc_id").collect()}
    assert not [c for c, t in got.dtypes if re.match("int|smallint", t) and c not in ("shard", "grown_shard")] or name in ("op4_edit_matches",)
    if name in queries.oracle_sql():
        assert "documents" in queries.oracle_sql()[name]
    if name == "op8_language":
        right = got.join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
        assert right > 0.98
