"""LM scoring by prediction by partial matching (PPM) over bytes, with a unigram base score beside it.

A text is coded as the bytes of its words (A-Z in lower case), each word followed by a space, and one end symbol.
The model is a pretrained trie of byte contexts of up to `ORDER` symbols that run across words, from the end and
a space before the first word on. A symbol is looked up after its longest known context; where that has not seen it, an escape
leads to the next shorter one, in which the symbols of the longer one are excluded; after the empty context
all other bytes are equally likely. So the probabilities of all texts add up to 1.

Counts: the longest contexts count occurrences in training texts, each shorter one counts in how many different
longer ones a symbol was seen (update exclusion). Escapes are estimated by leaving one out: contexts are put in classes by order,
different symbols and total, and how often a class would escape if one of its occurrences were missing is summed
over the whole trie; method C stands in where a class has seen little.

The trie is dealt out by the last `DEAL` symbols of a context, which all longer contexts with them share; contexts
of fewer symbols are few and go everywhere. Each part codes all (context, symbol) pairs of the corpus that fall to
it, those of unseen texts too. The `HOT_PAIRS` most frequent codes are broadcast; the other pairs of a
text go through a shuffle and meet their codes there, as do tokens beyond the `HOT_TOKENS` most frequent ones.
Both limits change the way and not the result.

Defined results: a null text is the empty text, whose one token is its end; repeated rows each get their
row; with nothing to learn from, symbols are uniform over 256 and every count is 0. Tokens and rows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import Lookup, as_strings, distinct, give_back, held, let_go, per_text, row_key, slices, split_words
from lattica.session import cut

ORDER, DEAL = 6, 3
HOT_TOKENS, HOT_PAIRS = 500_000, 2_000_000
SLICE_BYTES, CHUNK = 4 << 20, 2 << 20
#: Rows that a counting task holds before equal ones are added up.
MOST_ROWS = 3_000_000
MOST_PARTS = 4096
ALPHABET = 256
END_TOKEN = "\n"  # no word holds one
BEFORE = b"\n" * (ORDER - 1) + b" "
COLD, TEXT, PAIR = 0, 1, 2


def token_hashes(vocabulary: pa.Array) -> np.ndarray:
    items = vocabulary.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items)).view(np.int64)


END_HASH = int(token_hashes(pa.array([END_TOKEN]))[0])


def streams(flat: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after another, and where each text's context before the first symbol begins."""
    binary = flat.cast(pa.large_binary())
    own = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), binary)
    scalar = lambda x: pa.scalar(x, pa.large_binary())
    tail = pc.if_else(pa.array(np.diff(offsets) > 0), scalar(b" \n"), scalar(b"\n"))
    whole = pc.binary_join_element_wise(scalar(BEFORE), pc.binary_join(own, scalar(b" ")), tail, scalar(b""))
    ends = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def pairs(stream: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First place, packed (context, symbol) pairs and whether each is of a text (not of a beginning), by chunks.

    The symbol is the lowest byte of a pair, the latest one before it the next byte.
    """
    padded = np.concatenate((np.zeros(7, np.uint8), stream))
    mask = np.uint64((1 << 8 * (ORDER + 1)) - 1)
    for a in range(0, len(stream), CHUNK):
        b = min(len(stream), a + CHUNK)
        window = np.ndarray((b - a,), ">u8", padded.data, a, (1,))
        real = np.ones(b - a, bool)
        first = starts[np.searchsorted(starts, a - ORDER) : np.searchsorted(starts, b)]
        at = (first[:, None] + np.arange(ORDER)).ravel() - a
        real[at[(at >= 0) & (at < b - a)]] = False
        yield a, window.astype(np.uint64) & mask, real


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    key, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


class Sums:
    """Counts by key, added up in bounded memory."""

    def __init__(self):
        self.keys, self.counts, self.rows = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Takes rows in; whether more than MOST_ROWS different keys are held."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.rows += len(keys)
        if self.rows <= MOST_ROWS:
            return False
        key, n = added(self.keys, self.counts)
        self.keys, self.counts, self.rows = [key], [n], len(key)
        return 2 * self.rows > MOST_ROWS

    def batches(self, names: tuple[str, ...], *more: int) -> Iterator[pa.RecordBatch]:
        """What is held, as rows; then empty."""
        key, n = added(self.keys, self.counts)
        self.keys, self.counts, self.rows = [], [], 0
        for i in range(0, len(key), 50_000):
            part = key[i : i + 50_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(part), x, np.int8)) for x in more], pa.array(part), pa.array(n[i : i + 50_000])], names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): tokens by hash and (context, symbol) pairs, counted over training texts; 0 for those of other texts."""
    let_go()
    names, sums = ("kind", "key", "n"), {COLD: Sums(), PAIR: Sums()}
    for batch in batches:
        texts, train = as_strings(batch.column(0)), np.asarray(batch.column(1))
        for a, b in slices(texts, SLICE_BYTES):
            flat, offsets = split_words(pc.ascii_lower(texts.slice(a, b - a)))
            vocabulary, index = distinct(flat)
            taught = np.repeat(train[a:b], np.diff(offsets))
            n = np.append(np.bincount(index[taught], minlength=len(vocabulary)), train[a:b].sum())
            if sums[COLD].add(np.append(token_hashes(vocabulary), END_HASH).view(np.uint64), n.astype(np.int64)):
                yield from sums[COLD].batches(names, COLD)
            stream, starts = streams(flat, offsets)
            teaches = np.repeat(train[a:b], np.diff(starts))
            for first, keys, real in pairs(stream, starts):
                own = teaches[first : first + len(keys)]
                full = False
                for which, weight in ((real & own, 1), (real & ~own, 0)):
                    key, n = np.unique(keys[which], return_counts=True)
                    full = sums[PAIR].add(key, n * weight)
                if full:
                    yield from sums[PAIR].batches(names, PAIR)
            give_back()
    for kind, held_sums in sums.items():
        yield from held_sums.batches(names, kind)
    give_back()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, in which all rows of a key are, added up."""
    let_go()
    names, sums = ("kind", "key", "n"), {COLD: Sums(), PAIR: Sums()}
    for batch in batches:
        kind, key, n = (np.asarray(batch.column(i), dtype=np.int64) for i in range(3))
        for which, held_sums in sums.items():
            held_sums.add(key[kind == which].view(np.uint64), n[kind == which])
    for which, held_sums in sums.items():
        yield from held_sums.batches(names, which)
    give_back()


def counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens (key, n) and pairs (key, n); a partition of pairs holds whole contexts of DEAL symbols. rows: t, held_out."""
    spark = rows.sparkSession
    counted = rows.select("t", ~F.col("held_out")).mapInArrow(_counted, "kind byte, key long, n long")
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * DEAL) - 1))
    parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), counted.rdd.getNumPartitions()))
    dealt = counted.repartition(parts, F.xxhash64(F.when(F.col("kind") == PAIR, context).otherwise(F.col("key"))))
    summed = cut(dealt.mapInArrow(_summed, "kind byte, key long, n long"))
    return tuple(summed.filter(F.col("kind") == kind).select("key", "n") for kind in (COLD, PAIR))


def least_n(rows: DataFrame, most: int) -> int:
    """The least n such that at most `most` rows have that or more."""
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.ceil(F.pow(F.lit(10.0), F.floor(F.log10("n") * 20) / 20)))
    sizes = sorted(((r["s"], r["rows"]) for r in rows.groupBy(step.alias("s")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    got, least = 0, int(sizes[0][0] * 1.13) + 2 if sizes else 0
    for value, n in sizes:
        if got + n > most:
            break
        least, got = int(value), got + n
    return least


def most_frequent(rows: DataFrame, most: int) -> DataFrame:
    return rows.filter(F.col("n") >= least_n(rows, most))


class Level:
    """The pairs of one order, sorted, with their counts; and their contexts."""

    def __init__(self, k: int, key: np.ndarray, n: np.ndarray):
        self.k, self.key, self.n = k, key, n.astype(np.float64)
        context = key >> np.uint64(8)
        new = np.concatenate(([True], context[1:] != context[:-1]))[: len(key)]
        first = np.flatnonzero(new)
        self.of, self.context = np.cumsum(new) - 1, context[first]
        self.kinds = np.diff(np.append(first, len(key))).astype(np.float64)
        self.total = np.add.reduceat(self.n, first) if len(first) else np.zeros(0)

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << 8 * (self.k + 1)) - 1)

    def shorter(self) -> Level:
        """The next shorter order: in how many contexts of this one a pair was seen."""
        key, n = np.unique(self.key & np.uint64((1 << 8 * self.k) - 1), return_counts=True)
        return Level(self.k - 1, key, n)

    def left_out(self, parent: Level) -> tuple[np.ndarray, np.ndarray]:
        """Count and kinds of each context's symbols in the parent, where they are excluded."""
        n = parent.n[np.searchsorted(parent.key, self.key & parent.mask)]
        return np.bincount(self.of, n, len(self.context)), self.kinds


KINDS, TOTALS = 12, 41


def class_of(kinds: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Escape class of contexts: numbers up to 6 as they are, larger ones by powers of 2 (kinds) and of the root of 2 (totals)."""
    scaled = lambda x, each: np.where(x <= 6, x, 6 + np.floor(np.log2(np.maximum(x, 1) / 6.0) * each)).astype(np.int64)
    return np.minimum(scaled(kinds, 1), KINDS - 1) * TOTALS + np.minimum(scaled(total, 2), TOTALS - 1)


def escape_table(level: Level) -> np.ndarray:
    """escapes and hits by class, if each occurrence were the one left out."""
    once = np.bincount(level.of, level.n == 1, len(level.context))
    out, more = np.zeros((2, KINDS * TOTALS)), level.total > 1
    gone = more & (once > 0)
    np.add.at(out[0], class_of(level.kinds[gone] - 1, level.total[gone] - 1), once[gone])
    np.add.at(out[1], class_of(level.kinds[more], level.total[more] - 1), (level.total - once)[more])
    return out


def escape(table: np.ndarray, kinds: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probability of an escape; 1 where no symbol is left."""
    none, at = kinds <= 0, class_of(np.maximum(kinds, 1), np.maximum(total, 1))
    estimate = (table[0][at] + kinds / np.maximum(kinds + total, 1)) / (table[0][at] + table[1][at] + 1)
    return np.where(none, 1.0, np.clip(estimate, 1e-9, 1 - 1e-9))


def local_levels(key: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels ORDER to DEAL of a part's pairs."""
    seen = n > 0
    out = [Level(ORDER, key[seen], n[seen])]
    while out[-1].k > DEAL:
        out.append(out[-1].shorter())
    return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def log10_codes(levels: list[Level], escapes: dict[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """log10 probability of the symbol of each packed pair. levels: from the longest contexts to the empty one."""
    out, came = np.zeros(len(keys)), np.full(len(keys), -1)
    live, longer = np.arange(len(keys)), None
    for level in levels:
        key = keys[live] & level.mask
        context, known = find(level.context, key >> np.uint64(8))
        child = came[live]
        kinds, total = np.zeros(len(live)), np.zeros(len(live))
        if len(level.key):
            kinds, total = level.kinds[context], level.total[context]
            if longer is not None and len(longer.key):
                gone, gone_kinds = longer.left_out(level)
                total = total - np.where(child >= 0, gone[child], 0.0)
                kinds = kinds - np.where(child >= 0, gone_kinds[child], 0.0)
        up = escape(escapes[level.k], kinds, total)
        pair, hit = find(level.key, key)
        with np.errstate(divide="ignore"):
            seen = np.log10(1 - up) + np.log10((level.n[pair] if len(level.n) else 1.0) / np.maximum(total, 1e-300))
        out[live] += np.where(hit, seen, np.where(known, np.log10(up), 0.0))
        came[live] = np.where(known, context, -1)
        live, longer = live[~hit], level
    root = levels[-1].kinds
    out[live] -= np.log10(ALPHABET - (root[0] if len(root) else 0))
    return out


def _part(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = [(np.asarray(b.column(0), dtype=np.int64).view(np.uint64), np.asarray(b.column(1), dtype=np.int64)) for b in batches]
    return added([k for k, _ in table], [n for _, n in table])


def code_pairs(found: DataFrame) -> DataFrame:
    """key, n and bits (log10) of each pair. found: as counts() gives them."""
    spark = found.sparkSession
    # Contexts under DEAL symbols are as many as there are different runs of that many bytes.
    cutoff = lambda symbols: F.col("key").bitwiseAND(F.lit((1 << 8 * symbols) - 1)).alias("key")
    dealt = found.filter("n > 0").select(cutoff(DEAL + 1)).distinct()
    table = dealt.select(cutoff(DEAL)).groupBy("key").agg(F.count("*").alias("n")).toArrow()
    low = [Level(DEAL - 1, *added([np.asarray(table["key"], dtype=np.int64).view(np.uint64)], [np.asarray(table["n"], dtype=np.int64)]))]
    while low[-1].k:
        low.append(low[-1].shorter())

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for level in local_levels(*_part(batches)):
            escapes, hits = escape_table(level)
            at = np.flatnonzero(escapes + hits)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level.k)), pa.array(at), pa.array(escapes[at]), pa.array(hits[at])], ["k", "class", "escapes", "hits"])

    sums = found.mapInArrow(classes, "k long, class long, escapes double, hits double").groupBy("k", "class").agg(F.sum("escapes").alias("escapes"), F.sum("hits").alias("hits"))
    escapes = {k: np.zeros((2, KINDS * TOTALS)) for k in range(ORDER + 1)}
    for r in sums.collect():  # at most (ORDER + 1) x KINDS x TOTALS rows
        escapes[r["k"]][:, r["class"]] = r["escapes"], r["hits"]
    escapes |= {level.k: escape_table(level) for level in low}
    model = spark.sparkContext.broadcast((low, escapes))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _part(batches)
        low, escapes = model.value
        bits = log10_codes([*local_levels(key, n), *low], escapes, key)
        for i in range(0, len(key), 50_000):
            j = i + 50_000
            yield pa.RecordBatch.from_arrays([pa.array(key[i:j].view(np.int64)), pa.array(n[i:j]), pa.array(bits[i:j])], ["key", "n", "bits"])
        del key, n, bits
        give_back()

    return found.mapInArrow(coded, "key long, n long, bits double")


def _lookup(table: pa.Table, value: str, kind: type) -> Lookup:
    return Lookup(np.asarray(table["key"], dtype=np.int64), np.asarray(table[value], dtype=kind))


def text_scores(flat: pa.Array, offsets: np.ndarray, codes: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the known codes by text; and text, pair and number of the others."""
    stream, starts = streams(flat, offsets)
    out, cold = np.zeros(len(offsets) - 1), []
    for first, keys, real in pairs(stream, starts):
        keys = keys.view(np.int64)
        bits, known = codes.find(keys)
        a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, first + len(keys))
        bits[~real] = 0.0
        out[a:b] += np.add.reduceat(bits, np.maximum(starts[a:b] - first, 0))
        at = np.flatnonzero(real & ~known)
        cold.append((np.searchsorted(starts, at + first, "right") - 1, keys[at]))
    who, what = (np.concatenate([np.zeros(0, np.int64), *[c[i] for c in cold]]) for i in (0, 1))
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (what[1:] != what[:-1])))[: len(who)])
    return out, who[new], what[new], np.diff(np.append(new, len(who)))


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", hot_tokens: int | None = None, hot_pairs: int | None = None
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; train: which rows teach."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), (~train).alias("held_out"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("t"))
    tokens, found = counts(rows)
    codes = code_pairs(found)
    sums = tokens.agg(F.sum("n").alias("N"), F.count_if(F.col("n") > 0).alias("V")).first()
    total, different = sums["N"] or 0, sums["V"] or 0
    hot = most_frequent(tokens, HOT_TOKENS if hot_tokens is None else hot_tokens).toArrow()
    # Codes are made again for the join: that takes less than to write them.
    hot_codes = codes.filter(F.col("n") >= least_n(found, HOT_PAIRS if hot_pairs is None else hot_pairs)).toArrow()
    model, name = spark.sparkContext.broadcast((hot, hot_codes)), uuid.uuid4().hex
    schema = f"row_key long, kind byte, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, key long, n int, m int, part double, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes = held(name, lambda: (_lookup(model.value[0], "n", np.int64), _lookup(model.value[1], "bits", np.float64)))
        for batch in batches:
            ids, out, keys, texts = (batch.column(i) for i in range(4))
            texts = as_strings(texts)
            for a, b in slices(texts, SLICE_BYTES):
                flat, offsets = split_words(pc.ascii_lower(texts.slice(a, b - a)))
                vocabulary, index = distinct(flat)
                hashed, size = token_hashes(vocabulary), np.diff(offsets)
                count, known = words.find(hashed)
                spelled, *rest = text_scores(flat, offsets, codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(a, b - a), pa.array(np.full(b - a, TEXT, np.int8)), ids.slice(a, b - a), out.slice(a, b - a),
                        pa.array(np.zeros(b - a, np.int64)), pa.array((size + 1).astype(np.int32)),
                        pa.array(per_text((count > 0)[index].astype(np.int64), offsets).astype(np.int32)),
                        pa.array(per_text(np.log10(1.0 + count)[index], offsets)), pa.array(spelled),
                    ],
                    names,
                )
                # One row for a token or pair of a text whose count or code is not here, with its number there.
                cold = np.flatnonzero(~known[index])
                owner = np.repeat(np.arange(b - a), size)[cold]
                pair, n = np.unique(owner * (len(vocabulary) + 1) + index[cold], return_counts=True)
                who = np.concatenate((pair // (len(vocabulary) + 1), np.arange(b - a), rest[0])) + a
                what = np.concatenate((hashed[pair % (len(vocabulary) + 1)], np.full(b - a, END_HASH), rest[1]))
                n = np.concatenate((n, np.ones(b - a, np.int64), rest[2])).astype(np.int32)
                kind = np.repeat(np.array([COLD, PAIR], np.int8), (len(pair) + b - a, len(rest[0])))
                for i in range(0, len(who), 100_000):
                    j = min(len(who), i + 100_000)
                    none = lambda t: pa.nulls(j - i, t)  # noqa: B023, E731
                    columns = [keys.take(pa.array(who[i:j])), pa.array(kind[i:j]), none(ids.type), none(pa.bool_()), pa.array(what[i:j]), pa.array(n[i:j])]
                    yield pa.RecordBatch.from_arrays([*columns, none(pa.int32()), none(pa.float64()), none(pa.float64())], names)

    parts = rows.select("doc_id", "held_out", "row_key", "t").mapInArrow(scored, schema)
    table = tokens.select(F.lit(COLD).cast("byte").alias("kind"), "key", F.col("n").alias("c"), F.lit(0.0).alias("bits"))
    table = table.unionByName(codes.select(F.lit(PAIR).cast("byte").alias("kind"), "key", F.lit(0).cast("long").alias("c"), "bits"))
    # A key of a text is one row whatever its kind: a skewed side is a common token or pair, and those are broadcast.
    joined = parts.join(table.hint("shuffle_hash"), ["kind", "key"], "left")
    is_text, is_token, count = F.col("kind") == TEXT, F.col("kind") == COLD, F.coalesce(F.col("c"), F.lit(0))
    summed = joined.groupBy("row_key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.count_if(is_text).alias("copies"),
        F.sum(F.when(is_text, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(is_text, F.col("m")).when(is_token & (count > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(is_text, F.col("part")).when(is_token, F.col("n") * F.log10(count + 1.0)).otherwise(0.0)).alias("part"),
        F.sum(F.when(is_text, F.col("score")).when(is_token, 0.0).otherwise(F.col("n") * F.col("bits"))).alias("score"),
    )
    # Equal rows were added up: each gets its share again.
    share = lambda c: F.col(c) / F.col("copies")
    n_tokens = share("n_tokens").cast("long")
    return summed.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), share("n_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (share("part") - n_tokens * F.log10(F.lit(float(total + different + 1)))).alias("base_score"),
        share("score").alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
