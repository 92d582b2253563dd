"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are five consecutive words (lower case, punctuation at the ends of words left out); a
text with fewer words has one shingle of all. A shingle found n times weighs 1 + ln n, times 1 + `IDF_PART` x idf, where
idf (0 to 1) comes from document frequencies over all documents, hashed into `DF_BUCKETS` buckets. The
idf part is kept small on purpose: the more copies a passage has, the lighter full idf would make it, and
links inside large groups would be lost.

`BANDS` x `ROWS` consistent weighted samples (Ioffe, 2010) are drawn for each text and each band's samples
are hashed to a bucket: two texts of similarity s share a bucket with probability 1 - (1 - s^3)^12, 0.9998
at 0.8. Candidates are verified by their exact weighted Jaccard similarity, and verified links are joined
to components.

Work in a bucket grows with its members and not with their square: texts with equal words count once
(they are one node); in buckets of at most `SMALL` nodes all pairs are verified; larger buckets are first
verified in stars: every member against a first node, then against the member most similar to that (in a
group of edited copies the one nearest to the original), then, while a bucket still holds several
components, against nodes outside the centre's component.

Stars do not compare all pairs. The members of buckets that still hold several components are therefore
joined exactly by prefixes (`unlinked`): shingles are ordered from rare to common, and two texts that are
similar enough share a shingle before the weight that is left, from there on, is too little for a link.
Every such pair of different components is verified, so no link between bucket mates is lost.

Defined results: a text without words is a class of its own, as is a null text; classes are named by
the least doc_id in them; repeated rows are in one class.
"""

from __future__ import annotations

import functools
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.text import as_strings, distinct, give_back, held, let_go, row_key, slices, split_words
from lattica.session import cut, settle

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 3
SMALL, STARS = 8, 4
DF_BITS, IDF_PART = 16, 0.05
DF_BUCKETS = 1 << DF_BITS
SLICE_BYTES = 2 << 20
#: Hashed frequencies that order shingles for the prefix join; they change what is compared first, not the result.
RARE_BITS = 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Column names that no table of documents has.
KEPT, KEPT_KEY, COPIES = "near_dedup_kept", "near_dedup_key", "near_dedup_copies"
_ODD = np.random.default_rng(20240607).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _gamma_quantiles() -> tuple[np.ndarray, np.ndarray]:
    """2^16 quantiles of Gamma(2, 1) and their logarithms."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return low.astype(np.float32), np.log(low).astype(np.float32)


def features(texts: pa.Array) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """For each text: a hash of its words (None without any), its different shingles' hashes in order, and their counts."""
    flat, offsets = split_words(pc.utf8_lower(texts))
    vocabulary, index = distinct(flat)
    bare = pc.utf8_trim(vocabulary, characters=string.punctuation)
    bare = pc.if_else(pc.equal(pc.binary_length(bare), 0), vocabulary, bare).cast(pa.large_binary()).to_pylist()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, bare), np.uint64, len(bare))[index]
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        rolled = rolled * BASE + words[j : j + len(rolled)]
    rolled = mix(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if a == b:
            yield None, rolled[:0], np.zeros(0, np.int64)
            continue
        node = xxhash.xxh3_64_intdigest(words[a:b].tobytes())
        if b - a >= WORDS:
            yield node, *np.unique(rolled[a : b - WORDS + 1], return_counts=True)
        else:
            yield node, np.array([node], np.uint64), np.ones(1, np.int64)


def weights(keys: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(counts)) * (1.0 + IDF_PART * idf[(keys >> np.uint64(64 - DF_BITS)).astype(np.int64)])


def samples(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One consistent weighted sample for each hash function, as 32-bit hashes of (shingle, t)."""
    quantile, log_quantile = _gamma_quantiles()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    log_weight = np.log(weight).astype(np.float32)
    for a in range(0, len(keys), 2048):
        key, log_s = keys[a : a + 2048], log_weight[a : a + 2048]
        u = (key ^ _ODD[1][:, None]) * _ODD[0][:, None]
        u ^= u >> np.uint64(29)
        u *= _ODD[2][:, None]
        u ^= u >> np.uint64(32)
        lanes = u.view(np.uint16).reshape(*u.shape, 4)
        r, log_c = quantile[lanes[..., 0]], log_quantile[lanes[..., 1]]
        beta = u.view(np.uint32).reshape(*u.shape, 2)[..., 1].astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(log_s / r + beta)
        log_a = log_c - r * (t - beta + np.float32(1))
        bits = log_a.view(np.uint32)
        rank = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        name = (key >> np.uint64(16)).astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        least = np.minimum(least, ((rank << np.uint64(32)) | name).min(axis=1))
    return least & np.uint64(0xFFFFFFFF)


def buckets(sample: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * BASE
    for row in sample.reshape(BANDS, ROWS).T:
        key = mix(key + row)
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common)) if common else 0.0


def hashed_frequencies(texts: DataFrame, bits: int) -> DataFrame:
    """bucket and n: in how many texts the shingles of each of 2^bits buckets occur; bucket -1 counts the texts with words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            texts = as_strings(batch.column(0))
            for a, b in slices(texts, SLICE_BYTES):
                for node, keys, _ in features(texts.slice(a, b - a)):
                    if node is not None:
                        n += 1
                        np.add.at(total, (keys >> np.uint64(64 - bits)).astype(np.int64), 1)
            give_back()
        full = np.flatnonzero(total)
        bucket, count = np.append(full, -1), np.append(total[full], n)
        for i in range(0, len(bucket), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(bucket[i : i + 10_000].astype(np.int32)), pa.array(count[i : i + 10_000])], ["bucket", "n"])

    return texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit_idf(rows: DataFrame) -> np.ndarray:
    """idf (0 to 1) of each bucket of shingles, from all texts."""

    table = hashed_frequencies(rows.select("text"), DF_BITS).toArrow()
    bucket, n = np.asarray(table["bucket"], dtype=np.int64), np.asarray(table["n"], dtype=np.int64)
    docs = int(n[bucket == -1].sum())
    df = np.zeros(DF_BUCKETS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    # Several shingles of a text can share a bucket: a frequency is at most 1.
    return np.clip(np.log((1 + docs) / (1 + df)) / np.log(2 + docs), 0, 1)


def verify(pairs: DataFrame, texts: DataFrame, model, name: str) -> DataFrame:
    """a, b and their similarity. texts: node and text of every node that pairs hold."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held(name, lambda: model.value)
        last: dict[int, tuple] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sides = [as_strings(batch.column(2)), as_strings(batch.column(3))]
            out = np.zeros(len(a))
            for i in range(len(a)):
                got = []
                for node, side in ((a[i], sides[0]), (b[i], sides[1])):
                    if node not in last:
                        if len(last) >= 256:
                            last.pop(next(iter(last)))
                        _, keys, counts = next(features(side.slice(i, 1)))
                        last[node] = keys, weights(keys, counts, idf)
                    got.append(last[node])
                out[i] = similarity(*got)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "sim"])
            del sides
            give_back()
        last.clear()
        give_back()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compared, "a long, b long, sim double")


def signatures(docs: DataFrame, id_col: str, text_col: str):
    """doc_id, row_key, node (hash of the words) and bands of every row; with the idf broadcast and its name."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model, name = docs.sparkSession.sparkContext.broadcast(fit_idf(rows)), uuid.uuid4().hex
    rows = rows.withColumn("row_key", row_key("doc_id", "text"))

    @F.arrow_udf("struct<node: bigint, bands: array<bigint>>")
    def signed(texts: pa.Array) -> pa.Array:
        idf, nodes, bands, texts = held(name, lambda: model.value), [], [], as_strings(texts)
        for a, b in slices(texts, SLICE_BYTES):
            for node, keys, counts in features(texts.slice(a, b - a)):
                nodes.append(None if node is None else node - (1 << 64 if node >> 63 else 0))
                bands.append(None if node is None else buckets(samples(keys, weights(keys, counts, idf))))
            give_back()
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["node", "bands"])

    signed_rows = cut(rows.select("doc_id", "row_key", signed("text").alias("s")).select("doc_id", "row_key", "s.*"))
    return rows, signed_rows, model, name


def _stars(members: DataFrame, reps: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of each bucket's star that have not been verified and are not in one component."""
    pairs = members.join(reps, "bucket").filter((F.col("node") != F.col("rep")) & (F.col("component") != F.col("rep_component")))
    pairs = pairs.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
    return pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")


def prefix(keys: np.ndarray, weight: np.ndarray, frequency: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles among which a text has its first one in common with any similar text; with the weight left from
    each on, and whether it also is early enough where the other text weighs as much or more. Those that no
    other text has are left out."""
    often = frequency[(keys >> np.uint64(64 - RARE_BITS)).astype(np.int64)]
    order = np.lexsort((keys, often))
    rest = np.cumsum(weight[order][::-1])[::-1]
    slack = (1 - 1e-9) * (rest[0] if len(rest) else 0.0)
    at = np.flatnonzero((rest >= similar * slack) & (often[order] > 1))
    return keys[order[at]], rest[at], rest[at] >= 2 * similar / (1 + similar) * slack


def unlinked(nodes: DataFrame, known: DataFrame, model, similar: float) -> DataFrame:
    """a and b: every pair of nodes in different components that can be similar enough, without the known pairs.

    nodes: text, node, component. Similarity of at least t needs a common weight of t / (1 + t) of both
    texts' weights. In any order of shingles the common weight is at most what is left from the first common one on.
    """
    spark = nodes.sparkSession
    table = hashed_frequencies(nodes.select("text"), RARE_BITS).filter("bucket >= 0").toArrow()
    frequency = np.zeros(1 << RARE_BITS, np.int32)
    frequency[np.asarray(table["bucket"], dtype=np.int64)] = np.minimum(np.asarray(table["n"], dtype=np.int64), np.iinfo(np.int32).max)
    rare, name = spark.sparkContext.broadcast(frequency), uuid.uuid4().hex
    names = ["key", "node", "component", "whole", "rest", "short"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, frequency = held(name, lambda: (model.value, rare.value))
        for batch in batches:
            texts = as_strings(batch.column(0))
            for a, b in slices(texts, SLICE_BYTES):
                for i, (_, keys, counts) in enumerate(features(texts.slice(a, b - a)), a):
                    weight = weights(keys, counts, idf)
                    first, rest, short = prefix(keys, weight, frequency, similar)
                    at = pa.array(np.full(len(first), i))
                    yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), batch.column(1).take(at), batch.column(2).take(at), pa.array(np.full(len(first), weight.sum())), pa.array(rest), pa.array(short)], names)
            give_back()

    rows = cut(nodes.select("text", "node", "component").mapInArrow(prefixes, "key long, node long, component long, whole double, rest double, short boolean"))
    # Two rows of a shingle's largest component need no comparison: one side leaves that component out.
    main = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"))
    main = main.filter("kinds > 1").select("key", "main")
    one = rows.join(main, "key").filter(F.col("component") != F.col("main")).drop("main").toDF(*[f"{c}_1" if c != "key" else c for c in names])
    two = rows.toDF(*[f"{c}_2" if c != "key" else c for c in names])
    enough = F.least("rest_1", "rest_2") >= similar / (1 + similar) * (1 - 1e-9) * (F.col("whole_1") + F.col("whole_2"))
    lighter = (F.col("short_1") & (F.col("whole_1") <= F.col("whole_2"))) | (F.col("short_2") & (F.col("whole_2") <= F.col("whole_1")))
    both = one.join(two, "key").filter((F.col("component_1") != F.col("component_2")) & enough & lighter)
    pairs = both.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()
    return pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """doc_id, row_key, node and component of every row of docs; both null for a text without words."""
    rows, signed, model, name = signatures(docs, id_col, text_col)
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("bands").alias("bands"))
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = settle(spread.join(sizes, "bucket"))
    texts = members.select("node").distinct().join(nodes.select("node", "row_key"), "node")
    texts = cut(rows.select("row_key", "text").join(texts, "row_key").dropDuplicates(["node"]).select("node", "text"))
    alone = members.filter(F.col("size") <= SMALL).select("bucket", "node")
    pairs = alone.join(alone.withColumnRenamed("node", "other"), "bucket").filter("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    # First star: around a node chosen by a hash, so that a node meets other nodes in its other buckets.
    large = members.filter(F.col("size") > SMALL).select("bucket", "node").withColumn("component", F.col("node"))
    reps = large.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("rep"))
    star = large.join(reps, "bucket").filter("node != rep").select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"))
    known = settle(verify(settle(pairs.unionByName(star).distinct()), texts, model, name))
    linked = components(known.filter(F.col("sim") >= similar))
    for k in range(1, STARS):
        if large.isEmpty():
            break
        # Buckets whose members are not yet in one component.
        placed = large.drop("component").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket")
        large = settle(placed.join(mixed, "bucket").select("bucket", "node", "component"))
        if k == 1:  # the member most similar to the first centre
            near = large.join(reps, "bucket").filter("node != rep").select("bucket", "node", F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"))
            centre = near.join(known, ["a", "b"]).groupBy("bucket").agg(F.max_by("node", F.struct("sim", "node")).alias("rep"))
        else:  # a member outside the last centre's component
            outside = large.join(reps, "bucket").join(linked.select(F.col("node").alias("rep"), F.col("component").alias("of")), "rep", "left")
            outside = outside.filter(F.col("component") != F.coalesce("of", "rep"))
            centre = outside.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", F.lit(k))).alias("rep"))
        reps = settle(centre)
        starred = reps.join(large.select("bucket", F.col("node").alias("rep"), F.col("component").alias("rep_component")), ["bucket", "rep"])
        fresh = settle(verify(settle(_stars(large, starred, known)), texts, model, name))
        known = settle(known.unionByName(fresh))
        if not fresh.filter(F.col("sim") >= similar).isEmpty():
            linked = components(known.filter(F.col("sim") >= similar))
    # What the stars have left: pairs of different components, exactly.
    if not large.isEmpty():
        placed = large.drop("component").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket")
        left = settle(placed.join(mixed, "bucket").select("node", "component").distinct(), 20_000)
        fresh = settle(verify(settle(unlinked(cut(texts.join(left, "node")), known, model, similar)), texts, model, name))
        if not fresh.filter(F.col("sim") >= similar).isEmpty():
            linked = components(known.unionByName(fresh).filter(F.col("sim") >= similar))
    return signed.select("doc_id", "row_key", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_size, one row for each row of docs."""
    named = labelled(docs, id_col, text_col, similar)
    classes = named.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    got = named.join(classes, "component", "left")
    return got.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each class: that with the least id (nulls last), of several with that id one. Texts without words all stay."""
    named = cut(labelled(docs, id_col, text_col, similar))
    words = named.filter(F.col("component").isNotNull())
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"]
    kept = words.groupBy("component").agg(least.alias("row_key")).select("row_key")
    copies = words.groupBy("row_key").agg(F.count("*").alias("n"))
    keep = kept.join(copies, "row_key").unionByName(named.filter(F.col("component").isNull()).select("row_key", F.lit(1).cast("long").alias("n")).distinct())
    keep = cut(keep.toDF(KEPT, COPIES))
    left = docs.withColumn(KEPT_KEY, row_key(id_col, text_col)).join(keep, F.col(KEPT_KEY) == F.col(KEPT))
    once = left.filter(F.col(COPIES) == 1)
    if not keep.filter(F.col(COPIES) > 1).isEmpty():
        once = once.unionByName(left.filter(F.col(COPIES) > 1).dropDuplicates([KEPT_KEY]))
    return once.drop(KEPT, KEPT_KEY, COPIES)
