"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Word unigrams and bigrams are hashed into `BUCKETS` buckets. Counts over all documents give the raw
multinomial, counts over the trusted documents the target's, both smoothed. A document's score is
the mean log ratio of its n-grams, so that length does not matter, and it is kept when the score
reaches the threshold. One half of the trusted documents (by a hash of the id) teaches the target
multinomial; the other half, which the model has not seen, sets the threshold: the score that all but
`MISSED` of them reach, read from a histogram of fixed bins. Only DataFrame functions are used.

Every trusted document counts: target counts and the threshold cover all of them, corpus counts and scores all
documents. Ids of trusted documents are broadcast up to `MOST_BROADCAST` of them, and meet the documents in a shuffle else.

Defined results: null or empty texts have no words and fail the base rules; a document with fewer than
50 words, or more than half of whose words lie in repeated three-word windows, fails; without trusted
documents every score is 0 and the base rules alone decide; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import words
from lattica.session import cut

BUCKETS = 1 << 16
#: Ids that may be broadcast (about 32 bytes each in memory); more are joined by a shuffle, with the same results.
MOST_BROADCAST = 4_000_000
SMOOTHING = 0.5
#: Share of the trusted documents that may fall under the threshold.
MISSED = 0.005
BINS_PER_UNIT = 1000
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text (windows by their 64-bit hash)."""
    size = F.size(w)
    windows = F.when(size >= 3, F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def twice(p: Column) -> Column:
        own = lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, own), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gained = F.transform(at, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(at, i - 1))))
        return F.aggregate(gained, F.lit(0), lambda a, x: a + x)

    # Arrays are bound by one-element transforms, so that each is computed once.
    bound = F.transform(F.array(windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
        F.element_at(F.transform(F.array(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), lambda p: F.element_at(F.transform(F.array(twice(p)), covered), 1)), 1)))
    return F.element_at(bound, 1)


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the words w, what the base rules count, and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    counted = rows.select(
        "doc_id",
        "w",
        F.xxhash64("t").alias("text_key"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets(w: Column) -> Column:
    """Buckets of the unigrams and bigrams of an array of words."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    two = F.transform(w, lambda x, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(w, i - 1), x), F.lit(BUCKETS)).cast("int")))
    return F.concat(one, F.slice(two, 2, F.greatest(F.size(w) - 1, F.lit(0))))


def teaches() -> Column:
    """Whether a trusted document is of the half that teaches; the other half sets the threshold."""
    return F.pmod(F.xxhash64(F.lit("half"), F.col("target_id")), F.lit(2)) == 0


def log_ratios(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket and ratio, for at most BUCKETS buckets that occur. target: the trusted ids, in `target_id`."""
    marked = docs.join(sendable(target.filter(teaches())), F.col(id_col) == F.col("target_id"), "left")
    grams = marked.select(F.col("target_id").isNotNull().alias("trusted"), words(F.col(text_col)).alias("w"))
    grams = grams.select("trusted", F.explode(buckets(F.col("w"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("trusted").alias("m"))
    counts = cut(counts)
    total = counts.agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    if not total["m"]:
        return counts.select("bucket", F.lit(0.0).alias("ratio"))
    near = (F.col("m") + SMOOTHING) / (total["m"] + SMOOTHING * BUCKETS)
    raw = (F.col("n") + SMOOTHING) / (total["n"] + SMOOTHING * BUCKETS)
    return counts.select("bucket", (F.log(near) - F.log(raw)).alias("ratio"))


def trusted_ids(trusted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """target_id: all ids of trusted documents, each once."""
    return cut(trusted.select(F.col(id_col).alias("target_id")).filter(F.col("target_id").isNotNull()).distinct())


bounded_target = trusted_ids  # the name from when they were a sample


def sendable(target: DataFrame) -> DataFrame:
    """The ids, to be broadcast where they are few enough."""
    return F.broadcast(target) if target.count() <= MOST_BROADCAST else target


def quality_rules(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base rules' columns with score and kept, for every row of docs."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ratios = log_ratios(docs, target)
    rules = base_rules(docs)
    keys = [c for c in rules.columns if c != "w"]
    grams = rules.select(*keys, F.explode_outer(buckets(F.col("w"))).alias("bucket"))
    scored = grams.join(F.broadcast(ratios), "bucket", "left").groupBy(*keys).agg(F.avg("ratio").alias("score"), F.count("*").alias("rows"))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    scored = scored.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9)).withColumn("copies", (F.col("rows") / n_grams).cast("int"))
    scored = cut(scored.select(*keys, "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy", "text_key"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold(scored, target)))


def threshold(scored: DataFrame, target: DataFrame) -> Column:
    """Lower end of the bin that the lowest MISSED of the trusted documents reach into."""
    trusted = scored.filter(~F.col("base_failed")).join(sendable(target.filter(~teaches())), F.col("doc_id") == F.col("target_id"), "left_semi")
    bins = trusted.groupBy(F.floor(F.col("score") * BINS_PER_UNIT).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    allowed = MISSED * sum(r["n"] for r in bins)
    below = 0
    for r in bins:
        if below + r["n"] > allowed:
            return F.lit(r["bin"] / BINS_PER_UNIT)
        below += r["n"]
    return F.lit(float("-inf"))
