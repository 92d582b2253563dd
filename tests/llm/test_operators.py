"""Each operator against a brute-force version."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import decontaminate, language, line_dedup, near_dedup, nbest, ppm, quality, sharding, substring_dedup, token_counts
from lattica.llm.components import components
from lattica.llm.text import as_strings, crc_mod, slices, split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Words and slices


@given(st.lists(st.text(alphabet="ab é\t\n\r\x0b\x0c\x1f  ", max_size=30), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_are_split_as_defined(texts):
    flat, offsets = split_words(as_strings(pa.array(texts, pa.string())))
    got = [flat.slice(a, b - a).to_pylist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]


def test_slices_cover_all_rows():
    texts = as_strings(pa.array(["x" * n for n in (5, 0, 40, 3, 3, 3, 100)]))
    got = list(slices(texts, 10))
    assert [a for a, _ in got] == [0] + [b for _, b in got[:-1]] and got[-1][1] == 7


# 1. N-best segmentation


@pytest.fixture(scope="module")
def coder():
    return nbest.NBestCoder(n=4)


def every_segmentation(pieces, text):
    if not text:
        yield 0.0, ()
        return
    for k in range(1, len(text) + 1):
        head = text[:k]
        if head in pieces.score:
            own = (pieces.score[head], next(i for i in range(len(pieces.as_bytes)) if pieces.as_bytes[i] == head.replace(nbest.SPACE, " ").encode() and i not in pieces.byte_id.values()))
        elif k == 1:
            own = (pieces.unknown, None)
        else:
            continue
        for s, rest in every_segmentation(pieces, text[k:]):
            yield own[0] + s, (own[1], *rest)


@pytest.mark.parametrize("text", ["then", "reason", "▁of▁the", "a\nb", "日x", "ing,"])
def test_search_equals_enumeration(coder, text):
    want = sorted((s for s, _ in every_segmentation(coder.pieces, text)), reverse=True)[:4]
    assert [s for s, _ in coder.pieces.search(text, 4)] == pytest.approx(want)
    first = coder.pieces.first(text)
    assert first[0] == want[0] and first[1] == coder.pieces.search(text, 1)[0][1]
    assert first[2] == (want[0] - want[1] if len(want) > 1 else float("inf"))
    assert [s for s, _ in coder.rank(text)] == pytest.approx(want)


@given(st.text(alphabet=st.sampled_from("the of rain. ,\n\té日🙂"), max_size=40))
@example("aaaaaa")
@settings(max_examples=80, deadline=None)
def test_batches_equal_single_texts_and_decode(coder, text):
    got = coder.encode_batch(as_strings(pa.array([text, "plain text", text])))
    ids, ranked = got.best(), coder.encode(text)
    assert tuple(ids[0].as_py()) == ranked[0][1] and ids[2].as_py() == ids[0].as_py()
    assert got.scores[0] == pytest.approx([s for s, _ in ranked])
    assert got.round_trip.all() and coder.decode(ids[0].as_py()) == text
    lists = [x.tolist() for x in got.segmentations(0)]
    assert [coder.decode(x) for x in lists] == [text] * len(ranked) and len(set(map(tuple, lists))) == len(lists) == len(got.scores[0])
    assert [total_score(coder, x) for x in lists] == pytest.approx(got.scores[0])


def total_score(coder, ids):
    """Pieces have their score; bytes are those of a character that no piece has."""
    known = {i: s for s, i in coder.pieces.known.values()}
    letters = b"".join(coder.pieces.as_bytes[i] for i in ids if i not in known).decode("utf-8", "surrogatepass")
    return sum(known.get(i, 0.0) for i in ids) + len(letters) * coder.pieces.unknown


@pytest.mark.parametrize("text", ["then", "▁reason", "aaaaaaa", "日x日"])
def test_kept_and_looked_up_steps_give_the_same(coder, monkeypatch, text):
    want = coder.pieces.search(text, 6), coder.pieces.first(text)
    monkeypatch.setattr(nbest, "KEPT", 0)
    assert (coder.pieces.search(text, 6), coder.pieces.first(text)) == want


@given(st.lists(st.text(alphabet=st.sampled_from("▁the ofrain.,\né日🙂aS1"), min_size=1, max_size=80), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_cells_side_by_side_equal_single_ones(coder, cells):
    assert coder.pieces.firsts(cells) == [nbest.pack(*coder.pieces.first(x)) for x in cells]


def test_an_unbroken_text_takes_linear_time(coder):
    rng = random.Random(1)
    for text in ("a" * 300_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", k=300_000))):
        began = time.monotonic()
        got = coder.encode_batch(as_strings(pa.array([text])))
        assert time.monotonic() - began < 20 and got.round_trip.all() and len(got.scores[0]) == 4
        assert all(coder.decode(x) == text for x in got.segmentations(0))


def test_segmentations_as_rows(spark, corpus, coder):
    texts = ["then the reason", None, "", "naïve日"]
    got = sorted(map(tuple, nbest.segmentations(corpus(texts), n=4).collect()))
    want = [(i, k, pytest.approx(s), list(ids)) for i, t in enumerate(texts) for k, (s, ids) in enumerate(coder.encode(t or ""), 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and got[0][3] == want[0][3]
    crc = {r["doc_id"]: r["nbest_crc32"] for r in nbest.digest(corpus(texts), n=4).collect()}
    assert [zlib.crc32(np.array(g[3], "<i4").tobytes()) for g in got] == [c for i in range(4) for c in crc[i]]


def test_library_decodes_the_ids(coder):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path(nbest.MODEL))
    for text in ("hello  world", " x", "naïve über 日本\t語", "a  b   c "):
        assert library.decode(list(coder.encode(text)[0][1])) == text


# 2. PPM


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def symbols_of(text):
    return [*b"".join(w.translate(LOWER).encode() + b" " for w in WORD.findall(text or "")), 0x0A]


class ByteModel:
    """Contexts as tuples in nested dictionaries."""

    def __init__(self, texts, order=ppm.ORDER):
        self.order, self.tables = order, [defaultdict(Counter) for _ in range(order + 1)]
        for text in texts:
            stream = [*ppm.BEFORE, *symbols_of(text)]
            for i in range(order, len(stream)):
                self.tables[order][tuple(stream[i - order : i])][stream[i]] += 1
        for k in range(order, 0, -1):
            for context, seen in self.tables[k].items():
                for symbol in seen:
                    self.tables[k - 1][context[1:]][symbol] += 1
        self.escapes = defaultdict(lambda: [0, 0])
        for k, table in enumerate(self.tables):
            for seen in table.values():
                total = sum(seen.values())
                for n in seen.values():
                    if total > 1 and n == 1:
                        self.escapes[k, self.kind(len(seen) - 1, 1, 11), self.kind(total - 1, 2, 40)][0] += 1
                    elif total > 1:
                        self.escapes[k, self.kind(len(seen), 1, 11), self.kind(total - 1, 2, 40)][1] += n

    @staticmethod
    def kind(x, each, most):
        return min(x if x <= 6 else 6 + int(np.floor(np.log2(x / 6) * each)), most)

    def log10(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.tables[k].get(tuple(context[len(context) - k :]))
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            excluded |= set(seen)
            if left:
                total, kinds = sum(left.values()), len(left)
                gone, stayed = self.escapes[k, self.kind(kinds, 1, 11), self.kind(total, 2, 40)]
                escape = (gone + kinds / (kinds + total)) / (gone + stayed + 1)
                if symbol in left:
                    return out + np.log10((1 - escape) * left[symbol] / total)
                out += np.log10(escape)
        return out - np.log10(256 - len(excluded))

    def text(self, text):
        stream = [*ppm.BEFORE, *symbols_of(text)]
        return sum(self.log10(stream[i - self.order : i], stream[i]) for i in range(self.order, len(stream)))


def brute_scores(rows, held_out):
    tokens = lambda t: [*(w.translate(LOWER) for w in WORD.findall(t or "")), None]
    counts = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    model, total, different = ByteModel([t for i, t in rows if not held_out(i)]), sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        base = sum(np.log10((counts[w] + 1) / (total + different + 1)) for w in tokens(t))
        out.append((i, held_out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, base, model.text(t)))
    return sorted(out)


def ppm_rows(docs, **options):
    got = ppm.score(docs, crc_mod("doc_id", 7) != 2, **options)
    return sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.collect())


@pytest.mark.parametrize(("hot", "rows", "chunk"), [(0, 500, 100), (20, 10**6, 10**6), (100_000, 10**6, 997)])
def test_ppm_equals_brute_force(spark, corpus, prose, monkeypatch, hot, rows, chunk):
    monkeypatch.setattr(ppm, "MOST_ROWS", rows)
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    texts = [*prose[:14], "a b c d a b c d a b c e a b c d", None, "", "Ein Ü\x00x", prose[2], "z" * 200, "qx" * 2000, "\U0001f642" * 50]
    got = ppm_rows(corpus(texts), hot_tokens=hot, hot_pairs=hot)
    want = brute_scores(list(enumerate(texts)), lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]


def test_every_added_byte_costs(spark):
    rng = random.Random(8)
    junk = "".join(rng.choice("!?#0123456789XYZ") for _ in range(100_000))
    texts = ["alpha beta gamma " * 30] * 60 + [f"alpha {junk[:n]} beta" if n else "alpha beta" for n in (0, 1, 2, 40, 200, 4_000, 100_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, F.col("doc_id") < 60).collect()}
    last = [got[i] for i in range(60, 67)]
    assert last == sorted(last, reverse=True) and last[-1] < 10 * last[-2] < 100 * last[-3]


def test_nothing_to_learn_from(spark, corpus):
    got = by_id(ppm.score(corpus(["a", "abcdefghij", None, "a b"]), F.lit(False)))
    assert [got[i]["score"] for i in range(4)] == pytest.approx([-np.log10(256) * n for n in (3, 12, 1, 5)])
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got.values()} == {(0, 0, 0.0)}


def test_a_null_is_no_text_and_no_id(spark):
    docs = spark.createDataFrame([(5, None), (None, "5"), (5, ""), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in ppm.score(docs, F.lit(True)).collect())
    assert got == [("5", 1), ("5", 1), ("None", 1), ("None", 2)]
    assert sorted(r["n_words"] for r in substring_dedup.remove_repeats(docs).collect()) == [0, 0, 0, 1]
    assert sorted((str(r["doc_id"]), r["class_size"]) for r in near_dedup.near_duplicates(docs).collect()) == [("5", 1), ("5", 1), ("None", 1), ("None", 1)]


def test_byte_contexts_are_probabilities():
    texts = ["tari tarimo", "sel ku kuan tari", "ku"]
    model, counts = ByteModel(texts), Counter()
    for t in texts:
        stream = [*ppm.BEFORE, *symbols_of(t)]
        counts.update(sum(c << 8 * j for j, c in enumerate(reversed(stream[i - ppm.ORDER : i + 1]))) for i in range(ppm.ORDER, len(stream)))
    levels = ppm.local_levels(np.array(sorted(counts), np.uint64), np.array([counts[k] for k in sorted(counts)]))
    while levels[-1].k:
        levels.append(levels[-1].shorter())
    escapes = {x.k: ppm.escape_table(x) for x in levels}
    for context in (list(ppm.BEFORE), [*b"l tari"], [*b"zztari"], [*b"zzzzzz"], [*b"zzz ku"]):
        packed = sum(c << 8 * (i + 1) for i, c in enumerate(reversed(context)))
        got = ppm.log10_codes(levels, escapes, np.array([packed | s for s in range(256)], dtype=np.uint64))
        assert got == pytest.approx([model.log10(context, s) for s in range(256)])
        assert (10.0**got).sum() == pytest.approx(1)


# 3. Quality rules


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_rules(spark, corpus, prose):
    texts = [*prose, "a b c a b c a b", "x # y\nx # y\n\n \nx # y", None, "", "a " * 70, "p q r\n" * 30, "é|ü & " * 20]
    got = by_id(quality.base_rules(corpus(texts)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [tuple(got[i][c] for c in names) for i in range(len(texts))] == [base_counts(t) for t in texts]


def test_target_like_documents_are_kept(spark, corpus):
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}!!" for i in range(60)]
    texts = [" ".join(rng.choice(good if i % 2 else bad) for _ in range(80)) for i in range(200)]
    target = spark.createDataFrame([(i,) for i in range(1, 120, 2)], "doc_id long")
    got = by_id(quality.quality_rules(corpus(texts), quality.bounded_target(target)))
    assert not any(got[i]["kept"] for i in range(0, 200, 2))
    assert sum(got[i]["kept"] for i in range(1, 200, 2)) >= 0.9 * sum(not got[i]["base_failed"] for i in range(1, 200, 2))
    assert sum(not got[i]["base_failed"] for i in range(200)) > 150


def test_repeated_rows_and_no_target(spark, corpus, prose):
    docs = corpus([p for p in prose if len(p.split()) > 60]).unionByName(corpus(["short"]))
    twice = docs.unionByName(docs)
    got = quality.quality_rules(twice, spark.createDataFrame([], "target_id long"))
    assert got.count() == 2 * docs.count() and {r["score"] for r in got.collect()} == {0.0}
    assert all(r["kept"] == (not r["base_failed"]) for r in got.collect())


def spark_hash(*values):
    """Spark's 64-bit hash of strings and longs: each value's seed is the hash of the one before."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=h)
    return h - (1 << 64 if h >> 63 else 0)


def brute_quality(rows, target):
    """Scores, threshold and verdicts, document by document."""
    grams = lambda t: [spark_hash(w) % quality.BUCKETS for w in WORD.findall(t or "")] + [spark_hash(a, b) % quality.BUCKETS for a, b in zip(WORD.findall(t or "")[:-1], WORD.findall(t or "")[1:], strict=True)]
    teaches = {d for d in target if spark_hash("half", d) % 2 == 0}
    raw, near = Counter(), Counter()
    for d, t in rows:
        raw.update(grams(t))
        if d in teaches:
            near.update(grams(t))
    total, trusted, s = sum(raw.values()), sum(near.values()), quality.SMOOTHING
    ratio = {b: math.log((near[b] + s) / (trusted + s * quality.BUCKETS)) - math.log((n + s) / (total + s * quality.BUCKETS)) if trusted else 0.0 for b, n in raw.items()}
    score = [round(sum(ratio[b] for b in g) / len(g), 9) if (g := grams(t)) else 0.0 for _, t in rows]
    failed = [base_counts(t)[-1] for _, t in rows]
    held = sorted(math.floor(x * quality.BINS_PER_UNIT) for (d, _), x, f in zip(rows, score, failed, strict=True) if d in set(target) - teaches and not f)
    # The first bin whose documents bring those at or below it over the share that may be missed.
    least = next((b / quality.BINS_PER_UNIT for b in sorted(set(held)) if sum(x <= b for x in held) > quality.MISSED * len(held)), float("-inf"))
    return score, [not f and x >= least for x, f in zip(score, failed, strict=True)], least


@pytest.mark.parametrize("trusted", [40, 15, 0])
def test_scores_threshold_and_verdicts_equal_brute_force(spark, corpus, trusted):
    rng = random.Random(21)
    kinds = [[f"g{i}" for i in range(80)], [f"b{i}" for i in range(80)], [f"é{i}" for i in range(200)]]
    texts = [" ".join(rng.choice(kinds[rng.choice((0, i % 3))]) for _ in range(rng.choice((0, 1, 49, 50, 90)))) for i in range(150)] + [None, "", "one", "the same line " * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[8]), (7, texts[7])]
    target = list(range(0, 3 * trusted, 3))
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    ids = quality.bounded_target(spark.createDataFrame([(d,) for d in target], "doc_id long"))
    got = sorted((r["doc_id"], r["n_words"], r["score"], r["kept"]) for r in quality.quality_rules(docs, ids).collect())
    score, kept, least = brute_quality(rows, target)
    want = sorted((d, len(WORD.findall(t or "")), x, k) for (d, t), x, k in zip(rows, score, kept, strict=True))
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-9)
    assert not trusted or (0 < sum(kept) < len(kept) and math.isfinite(least))


def test_all_trusted_documents_count(spark, corpus, monkeypatch):
    ids = spark.range(20_500).select(F.col("id").alias("doc_id"))
    assert quality.trusted_ids(ids.unionByName(ids)).count() == 20_500
    rng = random.Random(5)
    texts = [" ".join(f"{'gb'[i % 2]}{rng.randrange(40)}" for _ in range(60)) for i in range(60)]
    target = quality.trusted_ids(spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long"))
    sent = sorted(map(tuple, quality.quality_rules(corpus(texts), target).collect()))
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, quality.quality_rules(corpus(texts), target).collect())) == sent


# 4. Decontamination


def edit_distance_inside(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


@given(st.text(alphabet="abc ", min_size=1, max_size=70), st.text(alphabet="abc ", max_size=60))
@settings(max_examples=100, deadline=None)
def test_myers_equals_dynamic_programming(item, text):
    assert decontaminate.least_distance(decontaminate.myers_masks(item), len(item), text) == edit_distance_inside(item, text)


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_no_match_within_the_budget_is_missed(data):
    words = st.lists(st.sampled_from(["tari", "mo", "selku", "an", "rimo"]), min_size=4, max_size=12).map(" ".join)
    items = data.draw(st.lists(words, min_size=1, max_size=3))
    text = list(" ".join([data.draw(words), items[0], data.draw(words)]))
    for _ in range(data.draw(st.integers(0, 6))):
        i = data.draw(st.integers(0, len(text) - 1))
        text[i : i + 1] = data.draw(st.sampled_from([[], ["z"], ["z", "q"]]))
        if not text:
            text = ["x"]
    text = decontaminate.normal("".join(text))
    matcher = decontaminate.Matcher(list(enumerate(items)), 0.15)
    want = {i: d for i, item in enumerate(items) if (d := edit_distance_inside(decontaminate.normal(item), text)) <= int(0.15 * len(decontaminate.normal(item)))}
    got = {i: d for i, d, _ in matcher.find(text)}
    assert got.keys() == want.keys() and all(want[i] <= d <= int(0.15 * len(decontaminate.normal(items[i]))) for i, d in got.items())


def test_blocks_give_the_same_matches(spark, corpus, prose):
    benchmark = spark.createDataFrame([(i, p) for i, p in enumerate(prose[:8])] + [(90, None), (91, "  "), (92, prose[0])], "item_id long, text string")
    docs = corpus([f"x {prose[2]} y", prose[0].upper(), None, "", prose[20], prose[20]])
    one = sorted(map(tuple, decontaminate.decontaminate(docs, benchmark).collect()))
    many = sorted(map(tuple, decontaminate.decontaminate(docs, benchmark, block_chars=300).collect()))
    assert one == many and [r[1] for r in one] == [True, True, False, False, False, False]
    assert one[1][2] == [0, 92]


# 5. Sharding


def scalar_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=20), st.integers(1, 100))
@settings(max_examples=80, deadline=None)
def test_jump_equals_the_scalar_form(keys, shards):
    got = sharding.jump(np.array(keys, np.uint64), shards)
    assert got.tolist() == [scalar_jump(k, shards) for k in keys]
    grown = sharding.jump(np.array(keys, np.uint64), shards + 1)
    assert all(b in (a, shards) for a, b in zip(got, grown, strict=True))


def test_shards(spark, corpus, prose):
    docs = corpus([*prose, None, "", "é"])
    got = sharding.shard(docs, 7).collect()
    assert len(got) == len(prose) + 3
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 7)
        text = [*prose, None, "", "é"][r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rows_of_one_id_get_a_slot_each(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_ROWS", 3)
    rows = [(7, "same")] * 40 + [(7, f"text {i}") for i in range(40)] + [(None, None)] * 5 + [(i, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, slots = sharding.shard(docs, 4).collect(), defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


# 6. Substring dedup


def brute_windows(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup_equals_brute_force(spark, corpus, prose, window):
    texts = [*prose, "a b c d " * 30, "z " * 80, None, "", "one two", " ".join(prose[7].split()[5:60])]
    got = by_id(substring_dedup.remove_repeats(corpus(texts), window=window, anchor=5))
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) for i in range(len(texts))] == brute_windows(texts, window)


def test_bloom_has_every_key(spark):
    keys = [random.Random(2).getrandbits(63) - (1 << 62) for _ in range(500)]
    got = substring_dedup.bloom(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert got.has(np.array(keys, np.int64).view(np.uint64)).all()
    assert got.has(np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.05


# 7. Line dedup


def brute_lines(texts, least, min_chars=1):
    key = lambda x: x.strip(SPACES).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in counts.items() if n >= least and len(k) >= min_chars}
    return [(len(x := (t or "").split("\n")), sum(key(y) in gone for y in x), "\n".join(y for y in x if key(y) not in gone)) for t in texts]


@pytest.mark.parametrize(("batches", "most"), [(1, 10**6), (5, 10**6), (5, 0)])
def test_line_dedup_equals_brute_force(spark, corpus, monkeypatch, batches, most):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", most)
    rng = random.Random(3)
    lines = ["Common Line", "  common line\t", "rare", "", " ", "É", "é", "x\r", "zeta"] + [f"l{i}" for i in range(20)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(40)] + [None, "", "common line", "\n"]
    got = by_id(line_dedup.line_dedup(corpus(texts), "got", min_docs=6, batches=batches))
    assert [tuple(got[i]["got"]) for i in range(len(texts))] == brute_lines(texts, 6)


def test_levels_and_first_lines(spark, corpus):
    parts = [corpus(["a\nb", "c"]), corpus(["b\nd"]), corpus(["a\ne", "e"]), corpus(["f"])]
    assert [x.count() for x in line_dedup.first_lines(parts)] == [3, 1, 1, 1]
    runs, levels = line_dedup.LineRuns(spark, 2, fanout=2), []
    for part in parts:
        runs.add(line_dedup.batch_keys(part, "text", 1))
        levels.append([len(level) for level in runs.levels])
    assert levels == [[1], [0, 1], [1, 1], [0, 0, 1]]
    assert runs.finish().distinct().count() == 3  # a, b, e


def test_batches_are_dealt_in_one_pass(spark, corpus):
    texts = [f"line {i % 7}\nown {i}" for i in range(50)]
    counts, rows = line_dedup.dealt_keys(corpus(texts), 6, "text", 1)
    assert rows == sum(c.count() for c in counts) and sum(c.agg(F.sum("n")).first()[0] or 0 for c in counts) == 100
    runs = line_dedup.LineRuns(spark, 5)
    for c in counts:
        runs.add(c)
    assert len(runs.levels) == 3 and runs.finish().count() == 7


def test_repeated_rows_are_documents(spark, corpus):
    docs = corpus(["again\nonce"]).unionByName(corpus(["again\ntwice"])).unionByName(corpus(["again\ntwice"]))
    got = line_dedup.line_dedup(docs, "got", min_docs=3).select("got.*").collect()
    assert sorted(map(tuple, got)) == [(2, 1, "once"), (2, 1, "twice"), (2, 1, "twice")]


# 8. Language ID


def greedy_phrases(sample, text):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def running_text(text):
    return f" {' '.join(re.sub(r'[\W\d_]', ' ', (text or '').lower()).split())} "


@given(st.lists(st.text(alphabet="abc x", max_size=40), min_size=1, max_size=6), st.text(alphabet="abc  ", max_size=50), st.sampled_from([1, 2, 64]))
@settings(max_examples=80, deadline=None)
def test_phrases_equal_substring_search(texts, sample, columns):
    automaton = language.SuffixAutomaton(sample, columns)
    texts = sorted(texts, key=len, reverse=True)
    points, offsets = language.code_points(as_strings(pa.array(texts)))
    assert automaton.phrases(points, offsets[:-1], np.diff(offsets)).tolist() == [greedy_phrases(sample, t) for t in texts]


def test_entropies_equal_brute_force(monkeypatch):
    monkeypatch.setattr(language, "SEGMENT", 16)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abdeéß") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    samples = {x: running_text(text(60)) for x in ("aa", "bb", "cc")}
    texts = [text(rng.randrange(1, 30)) for _ in range(40)] + ["A1b2!", "", "12", samples["bb"], "É" * 50]
    parser = language.CrossParser(samples)
    entropy, letters = parser.entropies(as_strings(pa.array(texts)))
    for i, t in enumerate(map(running_text, texts)):
        n = sum(c != " " for c in t)
        parts = [t[j : j + 16] for j in range(0, len(t), 16)]
        want = [sum(greedy_phrases(samples[x], p) for p in parts) * np.log2(2 + len(samples[x])) / max(n, 1) for x in sorted(samples)]
        assert letters[i] == n and entropy[:, i] == pytest.approx(want)
        lang, score = ("und", 0.0) if not n else (sorted(samples)[int(np.argmin(want))], sorted(want)[1] / sum(sorted(want)[:2]))
        got = parser.predict(as_strings(pa.array([texts[i]])))
        assert (got[0][0], got[1][0]) == (lang, pytest.approx(score))


def test_languages_are_told_apart(spark, corpus):
    rng = random.Random(5)
    kinds = {"aa": ["the", "tion", "ing", "er"], "bb": ["sch", "keit", "und", "zu"], "cc": ["eau", "oi", "que", "ent"]}
    langs = [rng.choice(sorted(kinds)) for _ in range(90)]
    texts = [" ".join("".join(rng.choice(kinds[x]) for _ in range(rng.randrange(1, 4))) for _ in range(40)) for x in langs]
    docs = corpus([*texts, None, "", "12 !! 34"], [*langs, "aa", "bb", None])
    samples = language.fit(docs.filter("doc_id < 40"))
    got = by_id(language.language_id(docs, samples))
    assert sum(got[i]["lang_pred"] == x for i, x in enumerate(langs)) >= 88
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (90, 91, 92)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.language_id(docs, {}).collect()} == {"und"}


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_a_language_is_learned_whatever_its_ids_are(spark, ids):
    rng = random.Random(8)
    of = {"null": lambda i: None, "one": lambda i: 5, "own": lambda i: i}[ids]
    rows = [(i, f"the house {rng.random()}", "en") for i in range(300)] + [(of(i), f"das Haus und {rng.choice('abcdefgh')} {rng.random()}", "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.fit(docs)
    assert set(samples) == {"de", "en"} and all(x.count(word) == language.SAMPLE_DOCS for x, word in ((samples["en"], "house"), (samples["de"], "haus")))


def test_equal_rows_teach(spark):
    same = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("ein Satz und noch einer").alias("text"), F.lit("de").alias("lang"))
    other = spark.createDataFrame([(1, "the house", "en")], "doc_id int, text string, lang string")
    samples = language.fit(same.unionByName(other))
    assert samples["de"].count("satz") == language.SAMPLE_DOCS and samples["en"].split() == ["the", "house"]


def test_long_labelled_texts_teach(spark, corpus):
    book, unbroken = "sch und keit zu " * 12_000, "\n" + "." * 160_000 + "щ" * 160_000
    docs = corpus([book, unbroken, *["the tion ing er"] * 4, *[None, "12 !!"] * 1000], ["bb", "dd", *["aa"] * 4, *["bb"] * 2000])
    samples = language.fit(docs)
    assert {k: len(v) > 0 for k, v in samples.items()} == {"aa": True, "bb": True, "dd": True}
    assert len(samples["dd"]) == language.SAMPLE_CHARS
    small = language.fit(docs, sample_chars=12)
    assert small == {"aa": " th th th th"[:12], "bb": " sch und kei", "dd": " " + "щ" * 11}
    got = by_id(language.language_id(docs.filter("doc_id in (0, 2)"), samples))
    assert (got[0]["lang_pred"], got[2]["lang_pred"]) == ("bb", "aa")
    assert language.shared_out(["abcdef", "x", "klmnop"], 9) == "abcdexklm"


# 9. Token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.MODEL))


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aΣσ İı' \t\n\x0b\x85 ́̈e!?<|>"), st.characters(exclude_categories=["Cs"])), max_size=40) | st.just("x <|endoftext|>y it's <|startoftext|>"), min_size=1, max_size=5))
@settings(max_examples=120, deadline=None)
def test_counts_equal_the_library(library, texts):
    counter = token_counts.WordCounter(token_counts.MODEL)
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(as_strings(pa.array(texts))).tolist() == want


def test_token_count_rows(spark, corpus, library):
    texts = ["Hello world", None, "", "many words " * 1500]
    got = by_id(token_counts.token_counts(corpus(texts), 2048))
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


# 10. Near-duplicates


def brute_classes(docs, texts, similar=0.8):
    idf = near_dedup.fit_idf(docs.select("text"))
    sets = [(node, keys, near_dedup.weights(keys, counts, idf)) for node, keys, counts in near_dedup.features(as_strings(pa.array(texts, pa.string())))]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i][0] is not None and sets[j][0] is not None and near_dedup.similarity(sets[i][1:], sets[j][1:]) >= similar:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_near_duplicates_equal_brute_force(spark, corpus, prose):
    rng = random.Random(9)
    base, group = prose[8].split() * 2, []
    for _ in range(40):  # a group of edited copies that no small bucket holds
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["p", "q", "r"])
        group.append(" ".join(words))
    texts = [*prose, *group, None, "", " ", "short text", "Short, text!", "--- ..."]
    docs = corpus(texts)
    got = by_id(near_dedup.near_duplicates(docs))
    want = brute_classes(docs, texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert [got[i]["class_size"] for i in range(len(texts))] == [Counter(want)[c] for c in want]


def test_pairs_that_share_a_template_are_linked(spark, corpus):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, texts = fresh(200), []
    for _ in range(250):  # pairs of similarity 0.88 in buckets of many texts of similarity 0.74
        own = fresh(34)
        other = list(own)
        for i in (4, 14, 24):
            other[i] = fresh(1)[0]
        texts += [" ".join(template + own), " ".join(template + other)]
    docs = corpus(texts)
    got = by_id(near_dedup.near_duplicates(docs))
    want = brute_classes(docs, texts)
    assert want == [i - i % 2 for i in range(len(texts))]
    assert [got[i]["class_id"] for i in range(len(texts))] == want


def test_prefixes_meet_in_similar_sets():
    rng = np.random.default_rng(4)
    frequency = rng.integers(2, 50, 1 << near_dedup.RARE_BITS).astype(np.int32)
    for _ in range(300):
        keys = np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64) << np.uint64(1))
        a, b = rng.random(len(keys)) < 0.93, rng.random(len(keys)) < 0.93
        weight = 1 + rng.random(len(keys))
        x, y = (keys[a], weight[a]), (keys[b], weight[b] * rng.choice([1.0, 0.9], b.sum()))
        (kx, rx, sx), (ky, ry, sy) = (near_dedup.prefix(*z, frequency, 0.8) for z in (x, y))
        _, i, j = np.intersect1d(kx, ky, return_indices=True)
        wx, wy = x[1].sum(), y[1].sum()
        met = (np.minimum(rx[i], ry[j]) >= 0.8 / 1.8 * (wx + wy) - 1e-6) & (sx[i] if wx <= wy else sy[j])
        assert met.any() or near_dedup.similarity(x, y) < 0.8


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(3)
    agree, true = [], []
    for _ in range(60):
        keys = np.sort(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        a, b = rng.random(200) < 0.85, rng.random(200) < 0.85
        wa, wb = 1 + rng.random(200), 1 + rng.random(200)
        x, y = (keys[a], wa[a]), (keys[b], wb[b])
        agree.append((near_dedup.samples(*x) == near_dedup.samples(*y)).mean())
        true.append(near_dedup.similarity(x, y))
    assert np.mean(agree) == pytest.approx(np.mean(true), abs=0.03)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (12, 11), (5, 5), (20, 19), (19, 18), (18, 17), (17, 16), (None, 4)] + [(100, i) for i in range(101, 130)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (10, 11, 12)} == {10}
    assert {got[i] for i in range(16, 21)} == {16} and {got[i] for i in range(100, 130)} == {100} and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Every operator on odd rows and on nothing


def operators(spark, benchmark):
    target = spark.createDataFrame([(4,), (7,)], "target_id long")
    return {
        "nbest": lambda d: nbest.digest(d),
        "ppm": lambda d: ppm.score(d, crc_mod("doc_id", 7) != 2),
        "quality": lambda d: quality.quality_rules(d, target),
        "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark),
        "shard": lambda d: sharding.shard(d, 4),
        "substring": lambda d: substring_dedup.remove_repeats(d),
        "lines": lambda d: line_dedup.line_dedup(d, "line_result", min_docs=2),
        "language": lambda d: language.language_id(d, language.fit(d)),
        "tokens": lambda d: token_counts.token_counts(d, 5),
        "near": lambda d: near_dedup.near_duplicates(d),
    }


@pytest.mark.parametrize("name", ["nbest", "ppm", "quality", "decontaminate", "shard", "substring", "lines", "language", "tokens", "near"])
def test_odd_rows_stay_one_to_one(spark, odd, name):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma alpha beta gamma"), (None, "x"), (2, None)], "item_id long, text string")
    operator = operators(spark, benchmark)[name]
    got = operator(odd)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert operator(odd.filter("false")).count() == 0
    if name == "near":
        assert by_id(got.filter("doc_id = 4"))[4]["class_size"] == 5  # one, one, ONE and two repeated rows
    if name == "lines":
        assert set(got.columns) == {*odd.columns, "line_result"}
    if name == "substring":
        assert by_id(got.filter("doc_id = 6"))[6]["kept"] == ""
        assert hashlib.sha256(b"").hexdigest() == got.filter("doc_id = 6").select(F.sha2(F.col("kept"), 256).alias("s")).first()["s"]
