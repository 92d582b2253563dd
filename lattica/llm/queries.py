"""The operators applied to the documents, by query name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import decontaminate, filter_audit, language, line_dedup, near_dedup, nbest, packing, ppm, quality, sharding, substring_dedup, token_counts, vector_codes
from lattica.llm.text import crc_mod, sha256_hex

SHARDS, TOKEN_LIMIT = 40, 2048


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.digest(documents(spark, sf_dir))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir), crc_mod("doc_id", 7) != 2)


def op3_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    target = quality.trusted_ids(labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)))
    return quality.quality_rules(documents(spark, sf_dir), target)


def op4_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARDS)


def op6_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"), "got")
    return got.select("doc_id", "got.n_lines", "got.n_dropped", sha256_hex(F.col("got.kept")).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 3) == 1
    samples = language.fit(docs.filter(~held_out))
    got = language.language_id(docs, samples)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), TOKEN_LIMIT)


def op10_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_nbest_pieces, op2_ppm_score, op3_target_ratio, op4_edit_matches, op5_jump_shards,
        op6_repeated_windows, op7_line_runs, op8_language, op9_token_counts, op10_weighted_minhash,
        op11_filter_audit, op12_stock_packing, op13_vector_codes,
    )
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


OP7_SQL = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT d, doc_id, i, parts[i] AS line,
         translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT d, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs)),
frequent AS (
  SELECT line_key FROM lines WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT d) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.line_key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.line_key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (line_key) GROUP BY d
"""


OP6_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT d, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT d, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35)),
repeated AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT d, unnest(range(s, s + 35)) AS i FROM starts WHERE h IN (SELECT h FROM repeated)),
places AS (SELECT d, w, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT p.d, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed,
         string_agg(p.w[p.i], ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS t
  FROM places p LEFT JOIN gone g ON p.d = g.d AND p.i = g.i GROUP BY p.d)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.d = kept.d
"""


OP11_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS d, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM rows),
own AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN own ON own.doc_id = words.doc_id),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
cells AS (
  SELECT part, filter_order, step, filter_order[step] AS f,
         sum(n) FILTER (WHERE len(list_intersect(string_split(fails, ''), string_split(filter_order[1:step], ''))) = 0) AS kept,
         sum(n) FILTER (WHERE here) AS removed, sum(n) FILTER (WHERE contains(fails, filter_order[step]) AND NOT here) AS redundant,
         sum(n) FILTER (WHERE fails = filter_order[step]) AS unique_fails, sum(good) FILTER (WHERE here) AS good_lost, sum(toxic) FILTER (WHERE here) AS toxic_lost
  FROM (SELECT *, contains(fails, filter_order[step]) AND len(list_intersect(string_split(fails, ''), string_split(filter_order[1:step - 1], ''))) = 0 AS here FROM kinds, steps)
  GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM cells
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignments and means, one common table each, as many times as there are rounds; vectors of one length."""
    head = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS d, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
p AS MATERIALIZED (SELECT d, i AS part, w[i * (len(w) // {parts}) + 1:(i + 1) * (len(w) // {parts})] AS x FROM v, (SELECT unnest(range(0, {parts})) AS i)),
c0 AS MATERIALIZED (SELECT part, e, x AS y FROM p JOIN (SELECT d, row_number() OVER (ORDER BY vec_id, w) - 1 AS e FROM v) USING (d) WHERE e < {entries})"""
    near = """a{n} AS MATERIALIZED (
  SELECT d, part, any_value(x) AS x, arg_min(e, (dist, e)) AS e, min(dist) AS dist
  FROM (SELECT d, p.part, x, e, CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist FROM p JOIN c{n} c ON c.part = p.part)
  GROUP BY d, part)"""
    move = """s{m} AS (SELECT part, e, j, CAST(sum(t) AS BIGINT) AS t, count(*) AS n FROM (SELECT part, e, unnest(x) AS t, unnest(range(0, len(x))) AS j FROM a{n}) GROUP BY ALL),
c{m} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(m.y, c.y) AS y FROM c{n} c
  LEFT JOIN (SELECT part, e, list((t - ((t % n) + n) % n) // n ORDER BY j) AS y FROM s{m} GROUP BY part, e) m ON m.part = c.part AND m.e = c.e)"""
    chain = [head.strip()]
    for n in range(rounds):
        chain += [near.format(n=n), move.format(n=n, m=n + 1)]
    chain += [near.format(n=rounds), f"""h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS hash FROM c{rounds}),
r AS (SELECT d, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY d)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, hash AS codebooks_sha256 FROM r JOIN v USING (d), h"""]
    return ",\n".join(chain)


OP13_SQL = _op13_sql()


def oracle_sql() -> dict[str, str]:
    own = {"op6_repeated_windows": OP6_SQL, "op7_line_runs": OP7_SQL, "op11_filter_audit": OP11_SQL, "op13_vector_codes": OP13_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
