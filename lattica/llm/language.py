"""Language ID by cross-parsing: the language whose text needs the fewest phrases wins.

For each language a suffix automaton is built over a bounded sample of labelled running text (parameters
`sample_docs` and `sample_chars`). A text is its letters in lower case with one space for each stretch of other
characters. It is parsed greedily: each phrase is the longest match that the automaton has, across words,
and one character where it has none. The phrases of a text, times the bits of a pointer into the sample and
divided by the letters, are its cross entropy under the language.

All texts of a batch are parsed side by side, a character each at a time. For that a text is cut into
segments of `SEGMENT` characters, whatever its length; a phrase ends where its segment does.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the first
language in sorted order; without any labelled row every text is `und`. Rows with a null or empty
label teach nothing.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.text import Lookup, as_strings, give_back, held, slices
from lattica.session import cut

SAMPLE_DOCS, SAMPLE_CHARS = 80, 150_000
SEGMENT = 2048
UNDETERMINED = "und"
SLICE_BYTES = 2 << 20
#: Bits of a code point in a transition's key.
POINT_BITS = 21
SPACE = ord(" ")
#: What the arrays of all automata of a worker may take.
TABLE_BYTES = 200 << 20


def running(texts: pa.Array) -> pa.Array:
    """Letters in lower case, with one space for each stretch of other characters and at both ends."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"\P{L}+", " ")
    space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    return pc.binary_join_element_wise(space, pc.utf8_trim(spaced, characters=" "), space, nothing)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and where each text's begin."""
    size = np.asarray(pc.utf8_length(texts), dtype=np.int64)
    whole = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(whole, "<u4").astype(np.int64), np.concatenate(([0], np.cumsum(size)))


class SuffixAutomaton:
    """Accepts every substring of a text.

    Steps on the most frequent characters, at most `columns` of them, are kept as an array by state and
    character, the others as a hash table.
    """

    def __init__(self, text: str, columns: int = 64):
        nexts, link, length, last = [{}], [-1], [0], 0
        for c in text:
            new = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        # Characters are numbered from the most frequent one on; number 0 is for those that the text lacks.
        points, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
        self.number = np.zeros(0x110000, np.int32)
        self.number[points[np.argsort(-n, kind="stable")]] = np.arange(1, len(points) + 1)
        size = sum(map(len, nexts))
        state = np.repeat(np.arange(len(nexts)), np.fromiter(map(len, nexts), np.int64, len(nexts)))
        number = self.number[np.fromiter((ord(c) for x in nexts for c in x), np.int64, size)]
        to = np.fromiter((s for x in nexts for s in x.values()), np.int64, size)
        self.columns = max(1, min(columns, len(points) + 1))
        near = number < self.columns
        self.near = np.full((len(nexts), self.columns), -1, np.int32)
        self.near[state[near], number[near]] = to[near]
        self.near = self.near.ravel()
        self.far = None if near.all() else Lookup((state[~near] << POINT_BITS) | number[~near], to[~near])
        self.first = np.full(len(points) + 1, -1, np.int32)
        self.first[number[state == 0]] = to[state == 0]

    def phrases(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of the greedy parse of each segment. Segments come from the longest to the shortest one."""
        numbers = self.number.take(points)
        count, state = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest))  # how many segments are longer than each place
        for place, n in enumerate(active.tolist()):
            c, now = numbers.take(starts[:n] + place), state[:n]
            if self.far is None:
                to = self.near.take(now.astype(np.int64) * self.columns + c)
            else:
                to = self.near.take(now.astype(np.int64) * self.columns + np.minimum(c, self.columns - 1))
                rare = np.flatnonzero(c >= self.columns)
                got, there = self.far.find((now[rare].astype(np.int64) << POINT_BITS) | c[rare])
                to[rare] = np.where(there, got, -1)
            stopped = np.flatnonzero(to < 0)
            # A phrase ends before this character, which begins the next one, or is one by itself if the sample lacks it.
            first = self.first.take(c[stopped])
            count[stopped] += (now[stopped] > 0).astype(np.int32) + (first < 0)
            to[stopped] = np.maximum(first, 0)
            state[:n] = to
        return count + (state > 0)


class CrossParser:
    """Languages by the automata of their samples."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        # A state for each two characters at most, and four bytes for each of its columns.
        columns = TABLE_BYTES // (8 * max(1, sum(len(x) for x in samples.values())))
        self.automata = []
        for x in self.languages:
            self.automata.append(SuffixAutomaton(samples[x], columns))
            give_back()  # what building takes is several times what is kept
        self.bits = np.array([math.log2(2 + len(samples[x])) for x in self.languages])

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross entropy of each text under each language, and its letters."""
        points, offsets = code_points(running(texts))
        letters = np.diff(np.concatenate(([0], np.cumsum(points != SPACE)))[offsets])
        each = -(-np.diff(offsets) // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), each)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * SEGMENT
        starts = offsets[owner] + place
        sizes = np.minimum(SEGMENT, offsets[owner + 1] - starts)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, owner = starts[order], sizes[order], owner[order]
        phrases = [np.bincount(owner, a.phrases(points, starts, sizes), len(texts)) for a in self.automata]
        return np.array([p * b for p, b in zip(phrases, self.bits, strict=True)]).reshape(len(self.languages), -1) / np.maximum(letters, 1), letters

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        entropy, letters = self.entropies(texts)
        best = entropy.argmin(axis=0)
        ordered = np.sort(entropy, axis=0)
        if len(self.languages) > 1:
            score = ordered[1] / np.maximum(ordered[0] + ordered[1], 1e-300)
        else:
            score = np.ones(len(texts))
        return [self.languages[b] if n else UNDETERMINED for b, n in zip(best, letters, strict=True)], np.where(letters > 0, score, 0.0)


def shared_out(texts: list[str], most: int) -> str:
    """At most `most` characters of the texts: each gives an equal share, and what short ones leave goes to the first that have more."""
    share = most // max(len(texts), 1)
    spare = most - sum(min(len(t), share) for t in texts)
    taken = []
    for t in texts:
        more = min(max(len(t) - share, 0), spare)
        spare -= more
        taken.append(t[: share + more])
    return "".join(taken)


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
) -> dict[str, str]:
    """Running text of each language: at most `sample_chars` characters of at most `sample_docs` labelled texts.

    The texts are those with the smallest hash of id and text among the labelled rows that hold a letter; a first
    pass counts these and so gives the share of rows to look at, so that only about ten times the sample is
    sorted. Equal rows have one hash and may fall out of that share together: a label that comes out short is looked
    at whole, so every label of a text with a letter has a sample, whatever its rows' ids are. A longer text gives
    its beginning from the first letter on.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & (F.col("l") != "") & F.col("t").rlike(r"\p{L}"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    rank = F.xxhash64("id", "t")
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (10 * sample_docs + 50) / n))])
    # The hash is taken before the text is cut.
    beginning = F.substring(F.regexp_replace("t", r"^\P{L}+", ""), 1, sample_chars)
    ranked = rows.select("l", rank.alias("rank"), "id", beginning.alias("t"))
    near = ranked.filter((F.col("rank") / F.lit(2.0**64) + F.lit(0.5)) <= share[F.col("l")])
    order = ("rank", "id", "t")
    sample = cut(near.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(*order))).filter(F.col("k") <= sample_docs).select("l", "k", "t"))
    got = {r["l"]: r["n"] for r in sample.groupBy("l").agg(F.count("*").alias("n")).collect()}
    short = [x for x, n in sizes.items() if got.get(x, 0) < min(n, sample_docs)]
    if short:
        sample = sample.filter(~F.col("l").isin(short))
    for x in short:  # only labels of many equal rows
        first = ranked.filter(F.col("l") == x).orderBy(*order).limit(sample_docs)
        sample = sample.unionByName(first.select("l", F.row_number().over(Window.orderBy(*order)).alias("k"), "t"))
    texts: dict[str, list[str]] = {}
    for row in sample.orderBy("l", "k").toLocalIterator():
        texts.setdefault(row["l"], []).append(running(pa.array([row["t"]], pa.large_string()))[0].as_py())
    return {k: shared_out(v, sample_chars) for k, v in texts.items()}


def predict(text: Column, spark, samples: dict[str, str]) -> Column:
    """struct<lang, score> of each text. Told to be nondeterministic, so that a filter on it does not parse all texts again in workers of its own."""
    model, name = spark.sparkContext.broadcast(samples), uuid.uuid4().hex

    @F.arrow_udf("struct<lang string, score double>")
    def predicted(texts: pa.Array) -> pa.Array:
        parser = held(name, lambda: CrossParser(model.value))
        langs: list[str] = []
        scores: list[float] = []
        for a, b in slices(texts, SLICE_BYTES):
            got, score = parser.predict(as_strings(texts.slice(a, b - a)))
            langs += got
            scores += score.tolist()
            give_back()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predicted.asNondeterministic()(text)


def language_id(
    docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred and score (the runner-up's share of both entropies, 0.5 to 1; 0 for `und`)."""
    got = docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col), docs.sparkSession, samples).alias("got"))
    return got.select("doc_id", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))
