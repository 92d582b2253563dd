"""A divided matrix in a store whose index arrays are as narrow as each block allows, or not there at all.

Entries lie in chunks of consecutive entries of a block, in the order of rows and columns: a row of the store is a
chunk, with its block, first position, size, values and the relative rows and columns as arrays. Each block's array
has an encoding: the name of a closed form, in which case it is not stored, or the narrowest of byte, short, int and
long. Blocks of equal encodings share a folder and a schema. On reading, arrays that are not stored are made again from
their form and the chunk's position and size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.block_forms import STORED, block_forms, value_of
from lattica.model import SparseMatrix
from lattica.operators.order import ranged_places
from lattica.session import cut

CHUNK = 4096
#: Encodings of stored arrays: type, largest value and bytes.
TYPES = (("byte", (1 << 7) - 1, 1), ("short", (1 << 15) - 1, 2), ("int", (1 << 31) - 1, 4), ("long", (1 << 63) - 1, 8))
ARRAYS = ("row", "col")
MADE = "form"


def encoding(form: Column, high: Column) -> Column:
    """The form's name, or the narrowest type."""
    out = F.lit(TYPES[-1][0])
    for name, top, _ in reversed(TYPES[:-1]):
        out = F.when(high <= top, F.lit(name)).otherwise(out)
    return F.when(form != STORED, form).otherwise(out)


def placed(matrix: SparseMatrix) -> DataFrame:
    """block, i, row, col and val of a divided and compressed matrix: indices relative to the block, entries numbered in it."""
    e = matrix.entries.select("block", (F.col("row") - F.col("row_lo")).alias("row"), (F.col("col") - F.col("col_lo")).alias("col"), "val")
    return ranged_places(e, [F.col("block"), F.col("row"), F.col("col"), F.col("val")], "i", "block")


def encodings(entries: DataFrame) -> DataFrame:
    """block, n, and for rows and columns the form, its parameters and the encoding. entries: those of placed()."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("array"), F.col(a).alias("a")) for a in ARRAYS])).alias("x")
    forms = block_forms(entries.select("block", "i", each).select("block", "i", "x.array", "x.a"))
    forms = forms.withColumn("code", encoding(F.col("form"), F.col("high")))
    pick = lambda a, c: F.max(F.when(F.col("array") == a, F.col(c)))
    own = [pick(a, c).alias(f"{a}_{c}") for a in ARRAYS for c in ("form", "code")]
    params = [F.max(F.when(F.col("array") == a, F.col("params"))).alias(f"{a}_params") for a in ARRAYS]
    return forms.groupBy("block").agg(F.max("n").alias("n"), *own, *params)


def sizes(codes: DataFrame) -> DataFrame:
    """block, n, the codes, and bytes of its entries before (two long indices and a value) and after."""
    width = lambda c: F.coalesce(*[F.when(F.col(c) == t, F.lit(b)) for t, _, b in TYPES], F.lit(0))
    return codes.select("block", "n", "row_code", "col_code", (F.col("n") * 24).alias("bytes_before"), (F.col("n") * (8 + width("row_code") + width("col_code"))).alias("bytes_after"))


def write(matrix: SparseMatrix, path: str, chunk: int = CHUNK) -> DataFrame:
    """Writes the matrix and gives the encodings of its blocks. matrix: compressed, as plans make it."""
    entries = cut(placed(matrix))
    codes = cut(encodings(entries))
    lows = matrix.entries.groupBy("block").agg(F.min("row_lo").alias("row_lo"), F.min("col_lo").alias("col_lo"))
    codes.join(lows, "block").write.mode("overwrite").parquet(f"{path}/blocks")
    lists = F.sort_array(F.collect_list(F.struct("i", "row", "col", "val")))
    chunks = entries.groupBy("block", F.floor(F.col("i") / chunk).alias("chunk")).agg(lists.alias("e"))
    stored = lambda c: F.when(F.col(c).isin([t for t, _, _ in TYPES]), F.col(c)).otherwise(F.lit(MADE))
    kinds = codes.select("block", stored("row_code").alias("row_kind"), stored("col_code").alias("col_kind"))
    # A pass over the chunks, which are kept once; there are at most 25 folders.
    both = cut(chunks.join(kinds, "block"))
    used = kinds.select("row_kind", "col_kind").distinct().collect()
    for r in used:
        own = both.filter((F.col("row_kind") == r["row_kind"]) & (F.col("col_kind") == r["col_kind"]))
        columns = [F.col("block"), F.col("e")[0]["i"].alias("start"), F.size("e").alias("n"), F.col("e.val").alias("val")]
        columns += [F.col(f"e.{a}").cast(f"array<{r[f'{a}_kind']}>").alias(a) for a in ARRAYS if r[f"{a}_kind"] != MADE]
        own.select(*columns).write.mode("overwrite").parquet(f"{path}/{r['row_kind']}-{r['col_kind']}")
    facts = {"n_rows": matrix.n_rows, "n_cols": matrix.n_cols, "kinds": sorted(f"{r['row_kind']}-{r['col_kind']}" for r in used), "sorted": matrix.row_map is not None}
    matrix.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    if matrix.row_map is not None:
        matrix.row_map.write.mode("overwrite").parquet(f"{path}/row_map")
    return codes


def read(spark: SparkSession, path: str) -> SparseMatrix:
    """The matrix, with the block of each entry; arrays that are not stored come from their forms."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    blocks = spark.read.parquet(f"{path}/blocks").select("block", "row_form", "row_params", "row_lo", "col_form", "col_params", "col_lo")
    parts = []
    for kind in facts["kinds"]:
        chunks = spark.read.parquet(f"{path}/{kind}").join(blocks, "block")
        own = dict(zip(ARRAYS, kind.split("-"), strict=True))
        rows = chunks.select("*", F.posexplode("val").alias("at", "v")).withColumn("i", F.col("start") + F.col("at"))
        index = lambda a, own=own: (F.get(F.col(a), F.col("at")).cast("long") if own[a] != MADE else value_of(F.col(f"{a}_form"), F.col(f"{a}_params"), F.col("i"))) + F.col(f"{a}_lo")
        parts.append(rows.select("block", index("row").alias("row"), index("col").alias("col"), F.col("v").alias("val")))
    entries = spark.createDataFrame([], "block long, row long, col long, val double")
    for part in parts:
        entries = entries.unionByName(part)
    row_map = spark.read.parquet(f"{path}/row_map") if facts["sorted"] else None
    return SparseMatrix(entries, facts["n_rows"], facts["n_cols"], row_map)
