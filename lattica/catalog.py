"""Queries of the sparse-matrix engine by name, with the SQL that gives the same rows.

Matrices over the tables: order_part (orders x parts, quantities), supp_part (suppliers x parts), cust_month
(customers x months, rounded prices), emb (vectors x positions, 1). The vector is x[c] = c % 7 + 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import formulas
from lattica.model import SparseMatrix
from lattica.operators import cuts, division, features, layout, products, runs, sorting
from lattica.plans import graph, learn, templates, tuner
from lattica.sources import corpus, generators, text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

MATRIX_SQL = {
    "order_part": "SELECT l_orderkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "supp_part": "SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "cust_month": "SELECT o_custkey AS r, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS c, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2",
    "emb": "SELECT vec_id AS r, i - 1 AS c, CAST(1 AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
}
BASE_SQL = """
m AS ({matrix}),
d AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM m),
x AS (SELECT c, CAST(c % 7 + 1 AS DOUBLE) AS x FROM (SELECT unnest(range(0, (SELECT nc FROM d))) AS c)),
allr AS (SELECT unnest(range(0, (SELECT nr FROM d))) AS r),
len AS (SELECT allr.r, coalesce(n, 0) AS k FROM allr LEFT JOIN (SELECT r, count(*) AS n FROM m GROUP BY r) q ON q.r = allr.r),
prod AS (SELECT m.r, sum(v * x) AS y FROM m JOIN x USING (c) GROUP BY m.r),
y AS (SELECT allr.r AS r, coalesce(prod.y, 0) AS y FROM allr LEFT JOIN prod ON prod.r = allr.r),
nz AS (SELECT m.r, c, v, row_number() OVER (PARTITION BY m.r ORDER BY c) - 1 AS rn, row_number() OVER (ORDER BY m.r, c) - 1 AS nz FROM m)"""


def base(body: str, matrix: str = "order_part", recursive: str = "") -> str:
    """SQL with the common tables of a matrix; body: further tables and the last SELECT, or just that."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{BASE_SQL.format(matrix=MATRIX_SQL[matrix]).strip()}{', ' + recursive if recursive else ''}{body if body.startswith(',') else chr(10) + body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str, name: str = "order_part") -> SparseMatrix:
    if name in ("order_part", "supp_part"):
        key = "l_orderkey" if name == "order_part" else "l_suppkey"
        return SparseMatrix.of(table(spark, sf_dir, "lineitem"), key, "l_partkey", "l_quantity", add_up=True)
    if name == "cust_month":
        orders = table(spark, sf_dir, "orders")
        return SparseMatrix.of(orders, "o_custkey", F.year("o_orderdate") * 12 + F.month("o_orderdate"), F.lit(1.0), add_up=True)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding"))
    return SparseMatrix.of(vectors, "vec_id", "pos", F.lit(1.0))


def vector(of: SparseMatrix) -> DataFrame:
    return of.cols().withColumn("x", (F.col("col") % 7 + 1).cast("double"))


def whole(df: DataFrame) -> DataFrame:
    """Every integer as a long, so that types equal those of the SQL."""
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: whole(f(spark, sf_dir))
        if sql:
            _SQL[key] = sql
        return f

    return register


def on(fn: Callable[[SparseMatrix], DataFrame], name: str, sql: str | None, of: str = "order_part") -> None:
    """Registers a query that is a function of one matrix."""
    _QUERIES[name] = lambda spark, sf_dir: whole(fn(matrix(spark, sf_dir, of)))
    if sql:
        _SQL[name] = sql


# Products and reduction trees.
Y_SQL = 'SELECT r AS "row", y FROM y'
on(lambda m: products.product(m, vector(m), all_rows=False), "spmv_order_part", base('SELECT r AS "row", y FROM prod'))
on(lambda m: products.product(m, vector(m)), "spmv_supp_part", base(Y_SQL, "supp_part"), "supp_part")
on(lambda m: products.product(m, vector(m)), "spmv_with_empty_rows", base(Y_SQL))
on(
    lambda m: products.general_product(m, vector(m), m.rows().select("row", (F.col("row") % 5).cast("double").alias("y0")), 2.0, 3.0),
    "spmv_alpha_beta",
    base('SELECT r AS "row", 2 * y + 3 * (r % 5) AS y FROM y'),
)
on(
    lambda m: products.product(m.transpose(), vector(m.transpose())),
    "spmv_transpose",
    base('SELECT a.c AS "row", coalesce(y, 0) AS y FROM (SELECT unnest(range(0, (SELECT nc FROM d))) AS c) a LEFT JOIN (SELECT c, sum(v * (r % 7 + 1)) AS y FROM m GROUP BY c) t ON t.c = a.c'),
)
for _strategy, _name in (
    ("ell", "spmv_ell"), ("sell", "spmv_sell_p"), ("hyb", "spmv_hyb"), ("tiles", "spmv_csr5_tiles"), ("merge_path", "spmv_merge_path"),
    ("acsr", "spmv_acsr_bins"), ("col_blocks", "spmv_col_blocked"), ("chunks", "spmv_two_level"), ("salted", "spmv_salted"),
    ("grid", "spmv_grid"),
):
    on(lambda m, s=_strategy: products.by_strategy(m, vector(m), s), _name, base(Y_SQL))


@query(base(Y_SQL))
def spmv_after_sort_restored(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return products.restored_product(sorting.apply(m, sorting.by_length(m)), vector(m))


@query(base(Y_SQL))
def spmv_planned(spark, sf_dir):
    m = matrix(spark, sf_dir)
    plan = graph.Plan((graph.Step("coarse_sort", {"bounds": [0, 2, 4, 8]}), graph.Step("compress")), (graph.Step("tlb_col", {"size": 4}),), "chunks")
    return graph.run(m, plan, vector(m))


@query(base("""
SELECT b AS blb, w AS wlb, CAST(t AS BIGINT) AS tlb, r AS "row", sum(v * x) AS part FROM (
  SELECT r // 1024 AS b, (r % 1024) // 32 AS w, rn // 2 AS t, r, v, x FROM nz JOIN x USING (c)) GROUP BY ALL"""))
def spmv_three_level_partials(spark, sf_dir):
    m = matrix(spark, sf_dir)
    tagged = division.nested(m, 1024, 32, 2)
    return products.gather(tagged, vector(m), ("blb", "wlb", "tlb")).groupBy("blb", "wlb", "tlb", "row").agg(F.sum("product").alias("part"))


# Row lengths, features and checks.
on(lambda m: m.row_nnz(), "row_nnz", base('SELECT r AS "row", k FROM len'))
on(lambda m: features.range_histogram(m, [0, 1, 2, 4, 8, 16]), "row_nnz_range_hist", base("""
SELECT b.bucket, count(len.r) AS n_rows FROM (SELECT CAST(unnest(range(0, 6)) AS BIGINT) AS bucket) b
LEFT JOIN len ON b.bucket = CASE WHEN k >= 16 THEN 5 WHEN k >= 8 THEN 4 WHEN k >= 4 THEN 3 WHEN k >= 2 THEN 2 WHEN k >= 1 THEN 1 ELSE 0 END
GROUP BY 1"""))
on(features.csr_offsets, "csr_row_offsets", base('SELECT r AS "row", CAST(sum(k) OVER (ORDER BY r) - k AS BIGINT) AS start FROM len'))
on(features.matrix_info, "matrix_info", base("""
SELECT CAST(sum(k) AS BIGINT) AS nnz, any_value(nr) AS n_rows, any_value(nc) AS n_cols, min(k) AS min_nnz, max(k) AS max_nnz,
       CAST(sum(k) // count(*) AS BIGINT) AS avg_nnz, bool_and(coalesce(k >= p, true)) OR bool_and(coalesce(k <= p, true)) AS is_sorted
FROM (SELECT k, lag(k) OVER (ORDER BY r) AS p FROM len), d"""))


def rounded(df: DataFrame, n: int = 9) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


on(lambda m: rounded(features.matrix_features(m)), "matrix_features", base("""
SELECT any_value(nr) AS n_rows, any_value(nc) AS n_cols, CAST(sum(k) AS BIGINT) AS nnz, round(sum(k) / any_value(nr) / any_value(nc), 9) AS density,
       round(avg(k), 9) AS avg_nnz_row, min(k) AS min_nnz_row, max(k) AS max_nnz_row, round(var_pop(k), 9) AS var_nnz_row,
       round(max(k) * count(*) / sum(k), 9) AS ell_padding_ratio, count(*) FILTER (WHERE k = 0) AS empty_rows FROM len, d"""))
on(lambda m: rounded(features.row_length_stats(m), 6), "row_length_stats", base("""
SELECT round(mu, 6) AS mean, round(sd, 6) AS std, round(sd / mu, 6) AS variation, round(avg(pow((k - mu) / sd, 3)), 6) AS skewness
FROM len, (SELECT avg(k) AS mu, stddev_pop(k) AS sd FROM len) GROUP BY mu, sd"""))
on(lambda m: rounded(features.diagonal_distance(m), 3), "diag_distance", base("SELECT round(avg(abs(c - r)), 3) AS mean_distance, round(var_pop(abs(c - r)), 3) AS var_distance FROM m"))
on(lambda m: rounded(features.row_col_correlation(m), 3), "pearson_row_col", base("""
SELECT round(p, 3) AS pearson_r, round((sy - sx + sqrt(pow(sy - sx, 2) + 4 * sxy * sxy)) / (2 * sxy), 3) AS deming_slope
FROM (SELECT corr(c, r) AS p, var_pop(c) AS sx, var_pop(r) AS sy, covar_pop(c, r) AS sxy FROM m)"""))
on(features.degree_histogram, "log10_degree_hist", base("""
SELECT CASE WHEN k = 0 THEN -1 ELSE length(CAST(k AS VARCHAR)) - 1 END AS bin, count(*) AS n_rows FROM len GROUP BY 1"""))
on(features.empty_rows, "empty_rows", base('SELECT r AS "row" FROM len WHERE k = 0'))
on(lambda m: rounded(features.band_padding(m, 32)), "band_padding_ratio", base("""
SELECT CAST(sum(w) * 32 AS BIGINT) AS padded, (SELECT count(*) FROM m) AS nnz, round(sum(w) * 32 / (SELECT count(*) FROM m), 9) AS padding_ratio
FROM (SELECT max(k) AS w FROM len GROUP BY r // 32)"""))
on(lambda m: rounded(features.matrix_features(m)).select("ell_padding_ratio"), "ell_padding_ratio", base("SELECT round(max(k) * count(*) / sum(k), 9) AS ell_padding_ratio FROM len"))
on(lambda m: features.block_row_max(m, 128), "block_row_max", base("SELECT r // 128 AS block, max(k) AS longest FROM len GROUP BY 1"))
on(features.sorted_by_length, "sorted_by_length", base("""
SELECT bool_and(coalesce(k >= p, true)) AS ascending, bool_and(coalesce(k <= p, true)) AS descending FROM (SELECT k, lag(k) OVER (ORDER BY r) AS p FROM len)"""))
on(lambda m: rounded(features.transfer_bytes(m, 0.001)), "transfer_bytes", base("""
SELECT n AS nnz, n * 20 + nr * 12 AS bytes, round((n * 20 + nr * 12) / 0.001 / 1e9, 9) AS gb_per_s, round(2 * n / 0.001 / 1e9, 9) AS gflops FROM (SELECT count(*) AS n FROM m), d"""))
on(lambda m: features.column_range(m, 100, 199).entries, "col_range_filter", base('SELECT r AS "row", c AS col, v AS val FROM m WHERE c BETWEEN 100 AND 199'))
on(lambda m: m.row_nnz().agg(features.meta_bits(F.col("k")).alias("bits")), "meta_bits", base("SELECT CAST(floor(log2(max(k))) + 1 AS BIGINT) AS bits FROM len"))


@query("""
SELECT event_id AS pos, r AS "row", c AS col FROM (
  SELECT event_id, user_id AS r, CAST(hour(ts) AS BIGINT) AS c, lag(user_id) OVER (ORDER BY event_id) AS pr, lag(CAST(hour(ts) AS BIGINT)) OVER (ORDER BY event_id) AS pc,
         lag(event_id) OVER (ORDER BY event_id) AS pe FROM events)
WHERE pe = event_id - 1 AND (r < pr OR (r = pr AND c < pc))""")
def input_order_violations(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("row"), F.hour("ts").cast("long").alias("col"))
    return features.order_violations(events, "pos").select("pos", "row", "col")


@query(base("SELECT count(*) AS violations FROM m WHERE r % 1000 >= 990 OR c > 1500"))
def division_check(spark, sf_dir):
    """Blocks whose ranges are stated too small: ten rows short at their ends, and up to column 1500."""
    tagged = matrix(spark, sf_dir).entries.withColumn("block", F.floor(F.col("row") / 1000))
    low = F.col("block") * 1000
    blocks = tagged.select("block").distinct().select("block", low.alias("row_lo"), (low + 989).alias("row_hi"), F.lit(0).alias("col_lo"), F.lit(1500).alias("col_hi"))
    return features.division_violations(tagged, blocks)


@query(base("""
SELECT count(*) FILTER (WHERE begins <> p + n) AS violations FROM (
  SELECT begins, lag(begins) OVER (ORDER BY t) AS p, lag(n) OVER (ORDER BY t) AS n FROM (SELECT nz // 256 AS t, min(nz) + CASE WHEN nz // 256 % 7 = 3 THEN 1 ELSE 0 END AS begins, count(*) AS n FROM nz GROUP BY 1))"""))
def level_check(spark, sf_dir):
    """Tiles as they lie, but that every seventh is stated to begin one entry late."""
    tiles = division.numbered(matrix(spark, sf_dir)).groupBy(F.floor(F.col("nz") / 256).alias("level_id")).agg(F.min("nz").alias("nz_begin"), F.count("*").alias("nz_size"))
    return features.level_violations(tiles.withColumn("nz_begin", F.col("nz_begin") + (F.col("level_id") % 7 == 3).cast("long")))


# Orders of rows.
on(lambda m: sorting.by_length(m), "row_sort_permutation", base("SELECT row_number() OVER (ORDER BY k DESC, r) - 1 AS new_row, r AS old_row, k FROM len"))
on(lambda m: sorting.inverse(sorting.by_length(m)), "row_sort_inverse", base('SELECT r AS "row", row_number() OVER (ORDER BY k DESC, r) - 1 AS place FROM len'))
on(lambda m: sorting.by_length_in_bands(m, 256), "banded_sort", base("""
SELECT r // 256 * 256 + row_number() OVER (PARTITION BY r // 256 ORDER BY k DESC, r) - 1 AS new_row, r AS old_row, k FROM len"""))
BIN = "CASE WHEN k = 0 THEN -1 WHEN k >= 8 THEN 3 WHEN k >= 4 THEN 2 WHEN k >= 2 THEN 1 ELSE 0 END"
on(lambda m: sorting.coarse(m, [0, 2, 4, 8]), "coarse_sort", base(f"SELECT row_number() OVER (ORDER BY {BIN} DESC, r) - 1 AS new_row, r AS old_row, CAST({BIN} AS BIGINT) AS bin FROM len"))
on(lambda m: sorting.coarse_offsets(m, [0, 2, 4, 8]), "coarse_sort_bin_offsets", base(f"""
SELECT bin, min(p) AS first_row, count(*) AS n_rows FROM (SELECT CAST({BIN} AS BIGINT) AS bin, row_number() OVER (ORDER BY {BIN} DESC, r) - 1 AS p FROM len) GROUP BY bin"""))


on(lambda m: sorting.by_length_in_blocks(division.row_bands(m, 1000), [0, 2]), "block_sort", base("""
SELECT b AS block, r AS "row", row_number() OVER (PARTITION BY b ORDER BY CASE WHEN b IN (0, 2) THEN n ELSE 0 END DESC, r) - 1 AS place
FROM (SELECT dense_rank() OVER (ORDER BY r // 1000) - 1 AS b, r, n FROM (SELECT r, count(*) AS n FROM m GROUP BY r))"""))


# Division into blocks and levels.
on(lambda m: division.long_short(m, [0, 3, 6]), "long_short_decompose", base("""
SELECT m.r AS "row", c AS col, v AS val, CAST(CASE WHEN k >= 6 THEN 2 WHEN k >= 3 THEN 1 ELSE 0 END AS BIGINT) AS part FROM m JOIN len ON len.r = m.r"""))
on(lambda m: division.row_bands(m, 1000), "fixed_row_div", base('SELECT r AS "row", c AS col, v AS val, dense_rank() OVER (ORDER BY r // 1000) - 1 AS block FROM m'))
on(lambda m: division.row_ranges(m, [0, 100, 150, 700, m.n_rows]), "var_row_div", base("""
SELECT r AS "row", c AS col, v AS val, dense_rank() OVER (ORDER BY CASE WHEN r >= 700 THEN 3 WHEN r >= 150 THEN 2 WHEN r >= 100 THEN 1 ELSE 0 END) - 1 AS block FROM m"""))
on(lambda m: division.col_blocks(m, 64).entries.select("row", "col", "val", "block"), "fixed_col_div", base('SELECT r AS "row", c AS col, v AS val, dense_rank() OVER (ORDER BY c // 64) - 1 AS block FROM m'))
on(lambda m: division.compress(division.row_bands(m, 1000)), "compress_relative", base("""
SELECT b AS block, r - rl AS rel_row, c - cl AS rel_col, v AS val FROM (
  SELECT dense_rank() OVER (ORDER BY r // 1000) - 1 AS b, r, c, v, min(r) OVER (PARTITION BY r // 1000) AS rl, min(c) OVER (PARTITION BY r // 1000) AS cl FROM m)"""))
on(lambda m: division.even_blocks(m, 128), "even_blb", base("SELECT r // 128 AS blb, min(r) AS first_row, count(*) AS n_rows, CAST(sum(k) AS BIGINT) AS nnz FROM len GROUP BY 1"))
on(lambda m: division.chunk_ids(m, 4), "blb_col_chunks", base("""
SELECT r AS "row", q AS chunk, row_number() OVER (ORDER BY r, q) - 1 AS chunk_id, n AS nnz FROM (SELECT r, rn // 4 AS q, count(*) AS n FROM nz GROUP BY 1, 2)"""))
on(
    lambda m: division.nested(m, 1024, 32, 2).entries.groupBy("blb", "wlb").agg(F.count_distinct("row", "tlb").alias("chunks"), F.count("*").alias("nnz")),
    "wlb_col_chunks",
    base("SELECT r // 1024 AS blb, (r % 1024) // 32 AS wlb, count(DISTINCT (r, rn // 2)) AS chunks, count(*) AS nnz FROM nz GROUP BY 1, 2"),
)
on(lambda m: division.tile_table(m, 256), "tlb_nnz_chunks", base("SELECT nz // 256 AS tlb, min(r) AS first_row, max(r) - min(r) + 1 AS n_rows, count(*) AS nnz FROM nz GROUP BY 1"))
on(
    lambda m: layout.ell(m).entries,
    "tlb_ell_slots",
    base("""
SELECT r AS "row", c AS col, v AS val, rn AS slot, false AS is_pad FROM nz
UNION ALL SELECT e.r, e.c, 0, s, true FROM (SELECT r, max(c) AS c, count(*) AS k FROM m GROUP BY r) e,
  (SELECT unnest(range(0, (SELECT max(k) FROM len))) AS s) WHERE s >= e.k"""),
)
on(lambda m: division.threads_per_row(m, 2, 32), "threads_per_row_padded", base("""
SELECT r AS "row", w AS wlb, CAST(ch + more // n + CASE WHEN r % 32 < more % n THEN 1 ELSE 0 END AS BIGINT) AS chunks FROM (
  SELECT r, w, ch, n, (32 - total % 32) % 32 AS more FROM (
    SELECT r, r // 32 AS w, (k + 1) // 2 AS ch, count(*) OVER (PARTITION BY r // 32) AS n, CAST(sum((k + 1) // 2) OVER (PARTITION BY r // 32) AS BIGINT) AS total FROM len))"""))
on(lambda m: layout.pad_rows(m, 4096).entries, "row_pad_multiple", base("""
SELECT r AS "row", c AS col, v AS val FROM m
UNION ALL SELECT i, 0, 0 FROM d, (SELECT unnest(range((SELECT nr FROM d), (SELECT (nr + 4095) // 4096 * 4096 FROM d))) AS i)"""))
on(lambda m: layout.pad_rows(m, 1, zeros=2, at_top=True, to=m.n_rows + 10).entries, "row_pad_top", base("""
SELECT r + 10 AS "row", c AS col, v AS val FROM m UNION ALL SELECT i, j, 0 FROM (SELECT unnest(range(0, 10)) AS i), (SELECT unnest(range(0, 2)) AS j)"""))
on(lambda m: layout.pad_cols(m, 4, empty_rows=True).entries.filter("is_pad").select("row", "col", "slot"), "col_pad_target", base("""
SELECT len.r AS "row", coalesce(e.c, 0) AS col, s AS slot FROM len LEFT JOIN (SELECT r, max(c) AS c FROM m GROUP BY r) e ON e.r = len.r, (SELECT unnest(range(0, 4)) AS s) WHERE s >= k"""))
on(lambda m: layout.slice_widths(m, 32, 4), "sell_slice_widths", base("""
SELECT slice, CAST(w AS BIGINT) AS width, CAST(w * 32 AS BIGINT) AS padded FROM (SELECT r // 32 AS slice, (max(k) + 3) // 4 * 4 AS w FROM len GROUP BY 1)"""))
on(lambda m: layout.padded_total(m, 32, 4), "total_padded_nnz", base("SELECT CAST(sum(w) * 32 AS BIGINT) AS padded FROM (SELECT (max(k) + 3) // 4 * 4 AS w FROM len GROUP BY r // 32)"))
on(lambda m: layout.csr(m).select("row", "start", F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols")), "coo_to_csr", base("""
SELECT len.r AS "row", CAST(sum(k) OVER (ORDER BY len.r) - k AS BIGINT) AS start, coalesce(cols, '') AS cols
FROM len LEFT JOIN (SELECT r, string_agg(c, ',' ORDER BY c) AS cols FROM m GROUP BY r) q ON q.r = len.r"""))
on(lambda m: layout.power_bins(m).entries.groupBy("bin").agg(F.count_distinct("row").alias("n_rows"), F.count("*").alias("nnz")), "pow2_bins", base("""
SELECT CAST(floor(log2(k)) AS BIGINT) AS bin, count(*) AS n_rows, CAST(sum(k) AS BIGINT) AS nnz FROM len WHERE k > 0 GROUP BY 1"""))
on(lambda m: layout.merge_path_workers(m, 64), "merge_path_workers", base("""
, t AS (SELECT ((SELECT count(*) FROM m) + nr + 63) // 64 AS share FROM d),
p AS (SELECT (nz + r) // share AS worker, 1 AS e, 0 AS x FROM nz, t
      UNION ALL SELECT (r + ends) // share, 0, 1 FROM (SELECT r, CAST(sum(k) OVER (ORDER BY r) AS BIGINT) AS ends FROM len), t)
SELECT worker, CAST(sum(e) AS BIGINT) AS entries, CAST(sum(x) AS BIGINT) AS row_ends FROM p GROUP BY worker""".strip()))
on(lambda m: division.shared_rows(division.nnz_tiles(m, 256).entries, "tlb"), "share_row_flags", base('SELECT r AS "row", count(DISTINCT nz // 256) > 1 AS shared FROM nz GROUP BY r'))


FACTS_SQL = """
, t AS (SELECT r // {blb} AS b, r % {blb} // {wlb} AS w, r, rn // {tlb} AS q, count(*) AS n FROM nz GROUP BY ALL),
br AS (SELECT max(t) AS tlbs_of_row, max(w) AS wlbs_of_row, count(*) FILTER (WHERE b > 1) AS shared_rows
       FROM (SELECT r, count(*) AS t, count(DISTINCT (b, w)) AS w, count(DISTINCT b) AS b FROM t GROUP BY r)),
bb AS (SELECT count(*) AS blbs, max(t) AS tlbs_of_blb, max(rr) AS rows_of_blb, count(*) FILTER (WHERE lo <> hi) AS uneven_blbs, min(lo) AS min_tlb, max(hi) AS max_tlb
       FROM (SELECT b, count(*) AS t, count(DISTINCT r) AS rr, min(n) AS lo, max(n) AS hi FROM t GROUP BY b)),
bw AS (SELECT count(*) AS wlbs, max(rr) AS rows_of_wlb FROM (SELECT b, w, count(DISTINCT r) AS rr FROM t GROUP BY b, w))
""".strip()
on(lambda m: templates.facts(division.nested(m, 512, 32, 2).entries), "level_facts", base(FACTS_SQL.format(blb=512, wlb=32, tlb=2) + "\nSELECT * FROM br, bb, bw"))
on(lambda m: templates.supported(division.nested(m, 512, 1, 2).entries), "template_support", base(FACTS_SQL.format(blb=512, wlb=1, tlb=2) + """
SELECT template, sums FROM br, bb, bw, (VALUES ('direct', 'row'), ('direct_warp_compress', 'row'), ('direct_warp_block_compress', 'row'), ('shared_memory', 'blb, row, tlb'),
  ('shared_memory_warp_compress', 'blb, row'), ('shared_memory_long_row', 'blb'), ('shared_memory_warp_reduce', 'blb, row, wlb'), ('direct_warp_reduce', 'wlb'),
  ('unaligned_warp_reduce', 'tlb, row')) v(template, sums)
WHERE CASE template WHEN 'direct' THEN true WHEN 'direct_warp_compress' THEN uneven_blbs = 0 WHEN 'direct_warp_block_compress' THEN min_tlb = max_tlb
  WHEN 'shared_memory' THEN tlbs_of_row > 1 AND shared_rows = 0 AND tlbs_of_blb <= 3950
  WHEN 'shared_memory_warp_compress' THEN tlbs_of_row > 1 AND shared_rows = 0 AND tlbs_of_blb <= 3950 AND uneven_blbs = 0
  WHEN 'shared_memory_long_row' THEN rows_of_blb = 1 WHEN 'shared_memory_warp_reduce' THEN shared_rows = 0 AND rows_of_wlb = 1 AND wlbs_of_row > 1
  WHEN 'direct_warp_reduce' THEN rows_of_wlb = 1 ELSE blbs = 1 AND wlbs = 1 END"""))


# Cuts.
WINDOW_SQL = "CASE WHEN k >= 8 THEN 3 WHEN k >= 4 THEN 2 WHEN k >= 2 THEN 1 ELSE 0 END"
on(lambda m: cuts.exponential_cuts(m, 2, 2, 8), "exp_range_cuts", base(f"""
SELECT r AS cut FROM (SELECT r, {WINDOW_SQL} AS w, lag({WINDOW_SQL}) OVER (ORDER BY r) AS p FROM len) WHERE p IS NULL OR p <> w UNION SELECT nr FROM d"""))
on(lambda m: cuts.exponential_cuts(m, 4, 4), "exp_range_cuts_unbounded", base("""
, w AS (SELECT r, CASE WHEN k >= 256 THEN 4 WHEN k >= 64 THEN 3 WHEN k >= 16 THEN 2 WHEN k >= 4 THEN 1 ELSE 0 END AS w FROM len)
SELECT r AS cut FROM (SELECT r, w, lag(w) OVER (ORDER BY r) AS p FROM w) WHERE p IS NULL OR p <> w UNION SELECT nr FROM d""".strip()))
on(lambda m: cuts.exponential_blocks(m, 2, 2, 8), "exp_range_blocks", base(f'SELECT CAST({WINDOW_SQL} AS BIGINT) AS "window", count(*) AS n_rows, CAST(sum(k) AS BIGINT) AS nnz FROM len GROUP BY 1'))
on(
    lambda m: m.spark.createDataFrame([(i, b) for i, b in enumerate(cuts.coarse_bounds(m, 2))], "i long, bound long"),
    "coarse_sort_bounds",
    base("""
, l AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS j FROM (SELECT DISTINCT k FROM len))
SELECT j // 2 AS i, CASE WHEN j = 0 THEN 0 ELSE k END AS bound FROM l WHERE j % 2 = 0""".strip()),
)
on(lambda m: m.row_nnz().select("row", F.array_join(cuts.chunk_sizes(F.col("k"), 4, True), ",").alias("sizes")), "col_chunks_tail_merged", base("""
SELECT r AS "row", CASE WHEN k % 4 > 0 AND k >= 4 AND k % 4 * 2 < 4 THEN array_to_string(list_concat(list_resize([4][1:0], k // 4 - 1, 4), [k % 4 + 4]), ',')
  ELSE array_to_string(list_concat(list_resize([4][1:0], k // 4, 4), CASE WHEN k % 4 > 0 THEN [k % 4] ELSE [] END), ',') END AS sizes FROM len"""))
LEAST, MOST = 2000, 1500
on(lambda m: cuts.least_nnz_cuts(m, LEAST), "least_nnz_blb", base("""
SELECT r AS cut FROM s WHERE cut AND r <= (SELECT max(r) FROM m) UNION SELECT 0 UNION SELECT nr FROM d""", "supp_part", f"""
s AS (SELECT r, k AS held, false AS cut FROM len WHERE r = 0
      UNION ALL SELECT len.r, CASE WHEN s.held >= {LEAST} THEN len.k ELSE s.held + len.k END, s.held >= {LEAST} FROM s JOIN len ON len.r = s.r + 1)"""), "supp_part")
on(lambda m: cuts.adaptive_cuts(m, MOST), "adaptive_blb", base("""
SELECT r AS cut FROM s WHERE cut UNION SELECT 0 UNION SELECT nr FROM d""", "supp_part", f"""
s AS (SELECT r, k AS held, false AS cut FROM len WHERE r = 0
      UNION ALL SELECT len.r, CASE WHEN s.held + len.k > {MOST} THEN len.k ELSE s.held + len.k END, s.held + len.k > {MOST} FROM s JOIN len ON len.r = s.r + 1)"""), "supp_part")
on(lambda m: cuts.adjacent_average_cuts(m, 1.05, 4), "adjacent_avg_cuts", base("""
SELECT r AS cut FROM s WHERE cut UNION SELECT 0 UNION SELECT nr FROM d""", "supp_part", """
s AS (SELECT r, [k] AS w, false AS cut FROM len WHERE r = 0
      UNION ALL SELECT len.r, CASE WHEN len.k < list_avg(s.w) / 1.05 OR len.k > list_avg(s.w) * 1.05 THEN [len.k] ELSE list_append(s.w, len.k)[-3:] END,
                       len.k < list_avg(s.w) / 1.05 OR len.k > list_avg(s.w) * 1.05 FROM s JOIN len ON len.r = s.r + 1)"""), "supp_part")


# Index arrays as formulas: arrays of the emb and order_part matrices.
def seq_of(df: DataFrame, i: str, a: str) -> DataFrame:
    return df.select(F.col(i).cast("long").alias("i"), F.col(a).cast("long").alias("a"))


EMB_STARTS = ", s AS (SELECT r AS i, CAST(sum(k) OVER (ORDER BY r) - k AS BIGINT) AS a FROM len)\n"
EMB_ENTRIES = ", s AS (SELECT nz AS i, {a} AS a FROM nz)\n"
on(lambda m: formulas.linear(seq_of(features.csr_offsets(m), "row", "start")), "cmp_linear", base(EMB_STARTS + """
SELECT bool_and(a = b + (s2 - b) * i) AND s2 >= b AS fits, b, s2 - b AS c FROM s, (SELECT min(a) FILTER (WHERE i = 0) AS b, min(a) FILTER (WHERE i = 1) AS s2 FROM s) GROUP BY b, s2""", "emb"), "emb")
on(lambda m: formulas.constant(seq_of(m.row_nnz(), "row", "k")), "cmp_constant", base("SELECT min(k) = max(k) AS fits, min(k) AS value FROM len", "emb"), "emb")
on(lambda m: formulas.branches(seq_of(m.row_nnz().select("row", F.floor(F.col("row") / 200).alias("a")), "row", "a")), "cmp_branch_runs", base("""
SELECT count(DISTINCT r // 200) <= 5 AND count(*) > 2 AS fits, count(DISTINCT r // 200) AS runs FROM len""", "emb"), "emb")
on(lambda m: formulas.cycle_linear(seq_of(division.numbered(m), "nz", "col")), "cmp_cycle_linear", base(EMB_ENTRIES.format(a="c") + """
SELECT bool_and(a = i % p) AS fits, p AS period, CAST(0 AS BIGINT) AS b, CAST(1 AS BIGINT) AS c FROM s, (SELECT min(i) AS p FROM s WHERE i > 0 AND a = 0) GROUP BY p""", "emb"), "emb")
on(lambda m: formulas.cycle_increase(seq_of(division.numbered(m), "nz", "row")), "cmp_cycle_increase", base(EMB_ENTRIES.format(a="r") + """
SELECT bool_and(a = i // p) AS fits, p AS period, CAST(0 AS BIGINT) AS b FROM s, (SELECT min(i) AS p FROM s WHERE a <> 0) GROUP BY p""", "emb"), "emb")
on(lambda m: m.entries.agg(formulas.suggest_type(F.max("row")).alias("row_type"), formulas.suggest_type(F.max("col")).alias("col_type")), "dtype_suggest", base("""
SELECT CASE WHEN max(r) <= 255 THEN 'u8' WHEN max(r) <= 65535 THEN 'u16' WHEN max(r) <= 4294967295 THEN 'u32' ELSE 'u64' END AS row_type,
       CASE WHEN max(c) <= 255 THEN 'u8' WHEN max(c) <= 65535 THEN 'u16' WHEN max(c) <= 4294967295 THEN 'u32' ELSE 'u64' END AS col_type FROM m"""))


# Sequences: runs, scans, segments, histograms.
def lengths_seq(m: SparseMatrix) -> DataFrame:
    return m.row_nnz().select(F.col("row").alias("pos"), F.col("k").alias("key"), (F.col("row") % 10).alias("value"))


RUNS = """, q AS (SELECT r, k, r % 10 AS val, CASE WHEN k IS DISTINCT FROM lag(k) OVER (ORDER BY r) OR r = 0 THEN 1 ELSE 0 END AS b FROM len),
g AS (SELECT r, k, val, b, CAST(sum(b) OVER (ORDER BY r) - 1 AS BIGINT) AS run FROM q)
"""
on(lambda m: runs.run_length_encode(lengths_seq(m)), "run_length_encode", base(RUNS + 'SELECT run, any_value(k) AS key, min(r) AS "begin", count(*) AS length FROM g GROUP BY run'))
on(lambda m: runs.run_length_encode(lengths_seq(m), at_least=2), "nontrivial_runs", base(RUNS + 'SELECT run, any_value(k) AS key, min(r) AS "begin", count(*) AS length FROM g GROUP BY run HAVING count(*) > 1'))
on(lambda m: runs.reduce_by_key(lengths_seq(m), "value"), "reduce_by_key_runs", base(RUNS + "SELECT run, any_value(k) AS key, CAST(sum(val) AS BIGINT) AS total FROM g GROUP BY run"))
on(lambda m: runs.unique_consecutive(lengths_seq(m)), "unique_consecutive", base(RUNS + "SELECT r AS pos, k AS key FROM g WHERE b = 1"))
on(lambda m: runs.scan(lengths_seq(m), "value").select("pos", "scan"), "inclusive_scan", base("SELECT r AS pos, CAST(sum(r % 10) OVER (ORDER BY r) AS BIGINT) AS scan FROM len"))
on(lambda m: runs.segmented_reduce(lengths_seq(m), "key", "value"), "segmented_reduce", base("SELECT k AS key, CAST(sum(r % 10) AS BIGINT) AS total, min(r % 10) AS least, max(r % 10) AS most FROM len GROUP BY k"))
on(lambda m: runs.segmented_sort(lengths_seq(m), "key", "value").select("pos", "place"), "segmented_sort", base("SELECT r AS pos, row_number() OVER (PARTITION BY k ORDER BY r % 10, r) - 1 AS place FROM len"))
on(lambda m: runs.histogram_even(lengths_seq(m), "key", 0, 16, 8), "histogram_even", base("""
SELECT b.bin, count(len.r) AS n FROM (SELECT CAST(unnest(range(0, 8)) AS BIGINT) AS bin) b LEFT JOIN len ON k // 2 = b.bin GROUP BY 1"""))
on(lambda m: runs.partition_flagged(lengths_seq(m).withColumn("flag", F.col("key") > 4), "flag").select("pos", "place"), "partition_flagged", base("SELECT r AS pos, row_number() OVER (ORDER BY k > 4 DESC, r) - 1 AS place FROM len"))
on(lambda m: runs.grouped(lengths_seq(m), "key", 64).select("part", F.array_join(F.col("values").cast("array<string>"), ",").alias("values")), "group_by_slice", base("""
SELECT r // 64 AS part, string_agg(k, ',' ORDER BY r) AS "values" FROM len GROUP BY 1"""))
on(lambda m: runs.lanes(lengths_seq(m).withColumn("flag", F.col("key") > 4), "flag").select("pos", "wlb", "lane", "reduce_offset"), "warp_reduce_offsets", base("""
SELECT r AS pos, r // 32 AS wlb, r % 32 AS lane, coalesce(min(CASE WHEN k > 4 THEN r % 32 END) OVER (PARTITION BY r // 32 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 32) - r % 32 AS reduce_offset FROM len"""))
on(lambda m: runs.pack_bits(lengths_seq(m).withColumn("flag", F.col("key") > 4), "flag", "value", 4).select("pos", "packed", "bits"), "pack_bits", base("""
SELECT r AS pos, CASE WHEN k > 4 THEN 16 ELSE 0 END + r % 10 AS packed, lpad(bin(CASE WHEN k > 4 THEN 16 ELSE 0 END + r % 10), 5, '0') AS bits FROM len"""))


# Generators and sources. What is made by rule is as large as the tables say.
def rows_in(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


@query("""
WITH s AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM part), n AS (SELECT unnest(range(0, (SELECT w * w FROM s))) AS i)
SELECT i AS "row", i + step AS col, CAST(1 AS DOUBLE) AS val FROM n, s, (SELECT unnest([-1, 1]) AS step) WHERE i % w + step BETWEEN 0 AND w - 1
UNION ALL SELECT i, i + step * w, 1 FROM n, s, (SELECT unnest([-1, 1]) AS step) WHERE i // w + step BETWEEN 0 AND w - 1""")
def grid2d(spark, sf_dir):
    return generators.lattice(spark, math.isqrt(rows_in(spark, sf_dir, "part")), 2).entries


@query("""
WITH s AS (SELECT CAST(floor(pow(count(*), 1.0 / 3) + 1e-9) AS BIGINT) AS w FROM part), n AS (SELECT unnest(range(0, (SELECT w * w * w FROM s))) AS i), d AS (SELECT unnest([-1, 1]) AS step)
SELECT i AS "row", i + step AS col, CAST(1 AS DOUBLE) AS val FROM n, s, d WHERE i % w + step BETWEEN 0 AND w - 1
UNION ALL SELECT i, i + step * w, 1 FROM n, s, d WHERE i // w % w + step BETWEEN 0 AND w - 1
UNION ALL SELECT i, i + step * w * w, 1 FROM n, s, d WHERE i // (w * w) + step BETWEEN 0 AND w - 1
UNION ALL SELECT i, i, 1 FROM n""")
def grid3d(spark, sf_dir):
    return generators.lattice(spark, int(rows_in(spark, sf_dir, "part") ** (1 / 3) + 1e-9), 3, self_loop=True).entries


@query("""
WITH i AS (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS i)
SELECT CAST(0 AS BIGINT) AS "row", i + 1 AS col, CAST(1 AS DOUBLE) AS val FROM i UNION ALL SELECT i + 1, (i + 1) % (SELECT count(*) FROM customer) + 1, 1 FROM i""")
def wheel(spark, sf_dir):
    return generators.wheel(spark, rows_in(spark, sf_dir, "customer")).entries


@query('SELECT a AS "row", b AS col, CAST(2.5 AS DOUBLE) AS val FROM (SELECT unnest(range(0, (SELECT count(*) FROM supplier))) AS a), (SELECT unnest(range(0, (SELECT count(*) FROM nation))) AS b)')
def dense(spark, sf_dir):
    return generators.dense(spark, rows_in(spark, sf_dir, "supplier"), rows_in(spark, sf_dir, "nation"), 2.5).entries


@query("SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS least, CAST(4 AS BIGINT) AS most, true AS inside FROM customer")
def uniform_generator(spark, sf_dir):
    cols = rows_in(spark, sf_dir, "part")
    entries = generators.uniform(spark, rows_in(spark, sf_dir, "customer"), cols, 4, seed=3).entries
    rows = entries.groupBy("row").agg(F.count_distinct("col").alias("k"), F.min("col").alias("lo"), F.max("col").alias("hi"))
    return rows.agg(F.count("*").alias("n_rows"), F.min("k").alias("least"), F.max("k").alias("most"), ((F.min("lo") >= 0) & (F.max("hi") < cols)).alias("inside"))


@query(base("""
SELECT r AS "row", c AS col, sum(v) AS val FROM (SELECT r, c, v FROM m WHERE c < r UNION ALL SELECT c, r, v FROM m WHERE c < r) GROUP BY 1, 2""", "supp_part"))
def symmetric_expand(spark, sf_dir):
    m = matrix(spark, sf_dir, "supp_part")
    lower = m.entries.filter("col < row")
    return text.expand_symmetric(lower).groupBy("row", "col").agg(F.sum("val").alias("val"))


@query("""
SELECT p_name AS name, p_brand AS group_name, CAST(p_size AS BIGINT) * 10000 AS nnz, p_partkey + 9000 AS n_rows,
       CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '_' || p_brand ELSE p_name END AS file_name
FROM part WHERE CAST(p_size AS BIGINT) * 10000 BETWEEN 50000 AND 60000000""")
def corpus_selection(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    catalog = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("group_name"), (F.col("p_size").cast("long") * 10000).alias("nnz"), (F.col("p_partkey") + 9000).alias("n_rows"))
    return corpus.select_matrices(catalog)


@query("SELECT o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_matrices(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"))
    return corpus.missing(wanted, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name")))


@query("SELECT p_type AS alias, min(p_name) AS name FROM part GROUP BY 1")
def name_map(spark, sf_dir):
    return corpus.name_map(table(spark, sf_dir, "part"), "p_type", "p_name")


@query('SELECT l_orderkey AS "row", CAST(l_linenumber AS BIGINT) AS col FROM lineitem WHERE NOT (l_orderkey BETWEEN 1 AND 1000 AND l_linenumber BETWEEN 1 AND 4)')
def out_of_bounds_entries(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"))
    return corpus.out_of_bounds(lines, 1000, 4)


# Search and learning.
@query(base("""
SELECT a, b, CAST(CAST(a AS BIGINT) % 64 AS BIGINT) AS warps FROM (SELECT CAST(unnest(range(32, 32 * (SELECT max(k) FROM len) + 1, 32)) AS DOUBLE) AS a), (SELECT CAST(unnest(range(1, (SELECT max(k) FROM len) + 1, 3)) AS DOUBLE) AS b)
WHERE a * b <= 1024""", "supp_part"))
def param_grid(spark, sf_dir):
    """Threads and widths up to what the longest row allows."""
    longest = features.matrix_info(matrix(spark, sf_dir, "supp_part")).first()["max_nnz"]
    return tuner.grid(spark, {"a": (32, 32 * longest, 32), "b": (1, longest, 3)}, keep="a * b <= 1024", derived={"warps": "cast(a as bigint) % 64"})


@query("SELECT p_brand AS template, CAST(p_partkey AS DOUBLE) AS trial, p_retailprice + p_partkey / 1000000.0 AS metric FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice + p_partkey / 1000000.0 DESC) = 1")
def best_trial(spark, sf_dir):
    none = F.array().cast("array<string>")
    metric = F.col("p_retailprice") + F.col("p_partkey") / 1000000.0
    log = table(spark, sf_dir, "part").select(none.alias("ops"), none.alias("strategies"), F.col("p_brand").alias("template"), F.array(F.col("p_partkey").cast("double")).alias("params"), metric.alias("metric"))
    return tuner.best(log).select("template", F.col("params")[0].alias("trial"), "metric")


@query("""
SELECT CAST(len(f) - 1 AS BIGINT) AS width, count(*) AS n, round(sum(CAST(f[-1] AS DOUBLE)), 4) AS target FROM (
  SELECT string_split('1,2,' || l_quantity || ',' || l_extendedprice, ',') AS f FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def trial_log_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit(":1,2,"), F.col("l_quantity").cast("string"), F.lit(","), F.col("l_extendedprice").cast("string")).alias("value"))
    parsed = learn.parse_log(lines, "R:")
    return parsed.groupBy(F.size("features").alias("width")).agg(F.count("*").alias("n"), F.round(F.sum("target"), 4).alias("target"))


def queries() -> dict[str, Query]:
    import lattica.plan_queries  # noqa: F401  registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import lattica.plan_queries  # noqa: F401

    return dict(_SQL)
