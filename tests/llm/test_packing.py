"""Packing against the library's ids and the rules of sequences; the linear program against enumeration."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lattica.llm import packing
from lattica.llm.text import as_strings
from lattica.llm.token_ids import Generations, WordEncoder


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder()


# Ids


@given(st.lists(st.text(alphabet=st.sampled_from("aAzZ'sStTrRvV09éÉßΣσİıö日🙂.,;:!?#$%&*()\"<|>-_ \t\n\x01\x85\xa0́​"), max_size=30), min_size=1, max_size=6))
@example(["it's. don'T, <|endoftext|>. <|ENDOFTEXT|>, a<|startoftext|>b! x\x01y \x01 (\x01)", "", " ", "é. é, 5. ½! ⅷ) ΑΣ.", "a.'s b,'LL."])
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(library, encoder, texts):
    ids, starts = encoder.encode(as_strings(pa.array(texts, pa.string())))
    got = [ids[a:b].tolist() for a, b in itertools.pairwise(starts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_that_end_with_a_mark_in_lower_case(library, encoder):
    texts = ["İ:", "Aİ. aİ,b İ İ!"]
    ids, starts = encoder.encode(as_strings(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(starts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_and_small_memos_give_the_same_ids(library):
    small = WordEncoder()
    small.words.entries, small.pieces.entries = 7, 5
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé.,") for _ in range(rng.randrange(1, 7))) for _ in range(300)) for _ in range(6)] + ["ab" * 20_000, "x. " * 3000]
    ids, starts = small.encode(as_strings(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(starts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(small.words.young) <= 300 * 6 + 10


def test_what_is_asked_for_stays():
    asked = []
    memo = Generations(lambda items: asked.extend(items) or [x.upper() for x in items], 3)
    for items in (["a", "b"], ["c", "a"], ["d", "a"], ["e", "f", "a"], ["a"]):
        assert memo(items) == [x.upper() for x in items]
    assert asked.count("a") == 1


# The linear program


def most_patterns(histogram, size):
    """The most full patterns that whole numbers allow, by search."""
    lengths = sorted(histogram)
    patterns = []

    def grow(i, left, now):
        if not left:
            patterns.append(now)
        elif i < len(lengths):
            for n in range(min(left // lengths[i], histogram[lengths[i]]) + 1):
                grow(i + 1, left - n * lengths[i], {**now, lengths[i]: n} if n else now)

    grow(0, size, {})

    def best(k, left):
        if k == len(patterns):
            return 0
        out, n = 0, 0
        while all(left[x] >= n * c for x, c in patterns[k].items()):
            out = max(out, n + best(k + 1, {x: v - n * patterns[k].get(x, 0) for x, v in left.items()}))
            n += 1
        return out

    return best(0, dict(histogram))


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_the_program_finds_what_enumeration_finds(histogram):
    lengths, counts = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    program = packing.FullPatterns(lengths, counts, 12)
    used = program.solve(gap=0.0)
    best = most_patterns(histogram, 12)
    total = sum(x for _, x in used)
    assert total == pytest.approx(program.value, abs=1e-6) and total >= best - 1e-6 and total <= lengths @ counts / 12 + 1e-6
    for i, n in enumerate(counts):
        assert sum(p.get(i, 0) * x for p, x in used) <= n + 1e-6
    got = packing.full_patterns(histogram, 12) if 12 not in histogram else packing.full_patterns({k: v for k, v in histogram.items() if k < 12}, 12)
    assert all(sum(k * n for k, n in p.items()) == 12 for p, _ in got)
    spent = Counter()
    for p, n in got:
        for k, c in p.items():
            spent[k] += c * n
    assert all(spent[k] <= histogram[k] for k in spent)


def test_a_large_histogram_reaches_the_bound_of_the_program():
    rng = random.Random(1)
    histogram = Counter(min(255, int(rng.lognormvariate(4, 0.8))) or 1 for _ in range(200_000))
    lengths, counts = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    program = packing.FullPatterns(lengths, counts, 256)
    program.solve()
    # Dual values that no full pattern undercuts bound every packing from above.
    cost = np.maximum(program.y, 0.0)
    least = packing.Knapsack(lengths, np.minimum(counts, 256 // lengths), cost, 256).best[256]
    assert least > 0.9 and program.value >= 0.997 * (counts @ cost) / min(1.0, least)
    assert sum(n for _, n in packing.full_patterns(histogram, 256)) >= 0.995 * program.value


# Layout


@given(st.dictionaries(st.integers(1, 16), st.integers(0, 9), max_size=8), st.booleans())
@settings(max_examples=80, deadline=None)
def test_every_id_has_one_place_and_nothing_is_padded(histogram, with_patterns):
    patterns = packing.full_patterns(histogram, 16) if with_patterns else []
    layout = packing.Layout.of(histogram, patterns, 16)
    length = np.array([k for k, n in histogram.items() for _ in range(n)], np.int64)
    rank = np.array([r for n in histogram.values() for r in range(n)], np.int64)
    row, start, n, sequence, offset = layout.place(length, rank)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in zip(row.tolist(), start.tolist(), n.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        pieces[x[0]].append((x[1], x[2]))
        sequences[x[3]].append((x[4], x[2]))
    for r, k in enumerate(length.tolist()):
        at = 0
        for s, c in sorted(pieces[r]):
            assert s == at and c > 0
            at += c
        assert at == k
    for own in sequences.values():
        at = 0
        for o, c in sorted(own):
            assert o == at
            at += c
        assert at == 16 or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(len(x) for x in pieces.values()) == len(row)


# Whole tables


def check(rows, got, library, size):
    """The multiset of documents is covered by pieces with the right checksums, and sequences follow the rules."""
    want = Counter()
    for d, t in rows:
        want[d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    spans = defaultdict(Counter)
    for (d, ids), n in want.items():
        for a in range(len(ids)):
            spans[d, len(ids)][a] += n
    sequences = defaultdict(list)
    by_id = defaultdict(list)
    for (d, ids), _ in want.items():
        by_id[d, len(ids)].append(np.array(ids, "<u4"))
    for r in got:
        key = (r["doc_id"], r["doc_tokens"])
        stop = r["start"] + r["length"]
        assert r["length"] > 0 and r["ids_crc32"] in {zlib.crc32(ids[r["start"] : stop].tobytes()) for ids in by_id[key]}
        for a in range(r["start"], stop):
            spans[key][a] -= 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert not any(any(c.values()) for c in spans.values())
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at == size or (at < size and at & (at - 1) == 0)


@pytest.mark.parametrize(("size", "bins", "broadcast"), [(2048, 50_000, 10**6), (64, 50_000, 10**6), (64, 3, 0), (7, 50_000, 10**6)])
def test_packing_keeps_every_id_once(spark, monkeypatch, library, prose, size, bins, broadcast):
    monkeypatch.setattr(packing, "BIN_ROWS", bins)
    monkeypatch.setattr(packing, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(packing, "SLICE_BYTES", 2000)
    texts = [*prose, None, "", " \n", "one", "a" * 5000, "word. " * 700]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, texts[5])] + [(500 + i, texts[7]) for i in range(30)]
    docs = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "doc_id long, text string, rank int, length int, digest string").repartition(5)
    got = packing.pack(docs, size)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(rows, got.collect(), library, size)


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
