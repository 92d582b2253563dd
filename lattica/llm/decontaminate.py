"""Benchmark decontamination by pigeonhole edit matching.

Text and items are put in lower case with white space as single spaces. An item of n characters may be
found with floor(`ERROR_RATE` x n) edits. It is split into one piece more than that, so that every
match holds at least one piece unchanged: an Aho-Corasick automaton of all pieces finds the exact piece
hits of a text in one pass, and Myers' bit-parallel distance verifies the windows around the hits.

The items are read in blocks of at most `BLOCK_CHARS` characters; each block is broadcast and meets all
texts in a pass of its own, whose hits are written to the shared folder before the next block is read and broadcast,
so that a large benchmark costs more passes and not more memory.

Defined results: null or empty texts match nothing; null or blank items are left out; repeated items
report each their id; rows stay one to one.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import held
from lattica.session import shared_dir

ERROR_RATE = 0.06
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces that make up the item, with their offsets, as equal in length as can be."""
    n, count = len(item), budget + 1
    ends = [n * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False) if b > a]


def myers_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def least_distance(masks: dict[str, int], size: int, text: str, enough: int = 0) -> int:
    """Least edit distance of the pattern to any substring of text; stops at `enough`."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, size
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if best <= enough:
                    return best
        ph <<= 1
        up = ((mh << 1) | ~(xv | ph)) & full
        down = ph & xv & full
    return best


class Matcher:
    """Finds items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items, where = [], defaultdict(list)
        for item_id, text in items:
            if text := normal(text):
                budget = int(rate * len(text))
                k = len(self.items)
                self.items.append((item_id, len(text), budget, myers_masks(text)))
                for offset, piece in pieces(text, budget):
                    where[piece].append((k, offset, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if self.items:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """item, least distance and begin of the first window that holds it, for every item within its budget."""
        if not self.items:
            return []
        windows = defaultdict(set)
        for end, places in self.automaton.iter(text):
            for k, offset, size in places:
                windows[k].add(end + 1 - size - offset)
        found = []
        for k in sorted(windows):
            item_id, size, budget, masks = self.items[k]
            begins, best = sorted(windows[k]), (budget + 1, 0)
            i = 0
            while i < len(begins):
                j = i
                while j + 1 < len(begins) and begins[j + 1] - begins[j] <= size:
                    j += 1  # windows that overlap are looked at together
                a = max(0, begins[i] - budget)
                if (d := least_distance(masks, size, text[a : begins[j] + size + budget])) < best[0]:
                    best = (d, a)
                if not best[0]:
                    break
                i = j + 1
            if best[0] <= budget:
                found.append((item_id, *best))
        return found


MATCH = "array<struct<item_id: bigint, distance: int, begin: bigint>>"
ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("begin", pa.int64())]))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks, read one partition after another."""
    block: list[tuple[int, str]] = []
    size = 0
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    for row in items.orderBy("i", "t").toLocalIterator():
        if block and size + len(row["t"]) > most:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    yield block


def matches(text: Column, model, rate: float = ERROR_RATE) -> Column:
    """Items of a block (a broadcast) that each text holds, with distances and places in the normal text."""
    name = uuid.uuid4().hex

    @F.arrow_udf(MATCH)
    def found(texts: pa.Array) -> pa.Array:
        matcher = held(name, lambda: Matcher(model.value, rate))
        out = []
        for t in texts:
            hits = matcher.find(normal(t.as_py())) if t.is_valid else []
            out.append([{"item_id": i, "distance": d, "begin": b} for i, d, b in hits])
        return pa.array(out, ARROW_MATCH)

    return found(text)


def with_matches(
    docs: DataFrame, benchmark: DataFrame, into: str, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs with a column `into`: the items that each text holds, in the order of their ids."""
    spark, rest = docs.sparkSession, blocks(benchmark, item_col, item_text_col, block_chars)
    block, following = next(rest), next(rest, None)
    if following is None:
        return docs.withColumn(into, matches(F.col(text_col), spark.sparkContext.broadcast(block), rate))
    key = F.struct(F.xxhash64(text_col).alias("col1"), F.xxhash64(F.lit(1), text_col).alias("col2"))  # equal texts hold equal items
    path = f"{shared_dir(spark)}/edit-matches-{uuid.uuid4().hex}"
    while block is not None:
        model = spark.sparkContext.broadcast(block)
        hits = docs.select(key.alias("text_key"), F.explode(matches(F.col(text_col), model, rate)).alias("m"))
        hits.write.mode("append").parquet(path)
        model.destroy()
        block, following = following, next(rest, None)
    merged = spark.read.schema(f"text_key struct<col1: bigint, col2: bigint>, m {MATCH[6:-1]}").parquet(path)
    merged = merged.groupBy("text_key").agg(F.sort_array(F.collect_set("m")).alias("m"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("text_key")).join(merged, "text_key", "left")
    return keyed.select("row.*", F.coalesce("m", F.array().cast(MATCH)).alias(into))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, the item_ids found and the distance of each, for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = with_matches(rows, benchmark, "found", **options)
    return got.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.col("found.item_id").alias("item_ids"), F.col("found.distance").alias("distances"))
