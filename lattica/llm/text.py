"""Words, byte-balanced batches and memos that the corpus operators share.

A word is a longest run of characters other than space and U+0009 to U+000D. Texts of a batch are
split by Arrow's own kernels and each distinct word of a batch is looked at once, so that the cost
of Python work follows the number of distinct words.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE, SPACES = r"[ \t-\r]", " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 8 << 20
#: Entries that a worker keeps in a memo before it starts anew.
MEMO_ENTRIES = 400_000


def crc_mod(key: Column | str, m: int) -> Column:
    """crc32 of the key as text, modulo m; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row's id and text, in which a null is told apart from every value and place."""
    key, text = F.col(id_col), F.col(text_col)
    return F.xxhash64(key.isNull(), key.cast("string"), text.isNull(), text)


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def lower_ascii(token: Column) -> Column:
    """A-Z in lower case and nothing else changed; the slow way only for tokens that may need it."""
    return F.when(F.lower(token) == token, token).otherwise(F.translate(token, UPPER, LOWER))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def as_strings(texts: pa.Array) -> pa.Array:
    """Nulls as empty texts; 64-bit offsets, so that a batch of any length fits."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.cast(texts, pa.large_string())
    return pc.fill_null(texts, "") if texts.null_count else texts


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is a range of its own."""
    size = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(size) > start:
        yield start, len(size)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's words begin (one entry more than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.values, np.asarray(lists.offsets, dtype=np.int64)
    flat, offsets = flat.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
    return flat, offsets


def distinct(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words and the index of each word among them."""
    if not len(flat):
        return pa.array([], flat.type), np.zeros(0, np.int64)
    coded = pc.dictionary_encode(flat)
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the words' values by text."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


class Memo:
    """Values of words, kept by a worker across batches; starts anew when it is full."""

    def __init__(self, compute: Callable[[list[str]], list], entries: int = MEMO_ENTRIES):
        self.compute, self.entries, self.known = compute, entries, {}

    def __call__(self, items: list[str]) -> list:
        got = list(map(self.known.get, items))
        if missing := [i for i, x in enumerate(got) if x is None]:
            if len(self.known) + len(missing) > self.entries:
                self.known = {}
            for i, x in zip(missing, new := self.compute([items[i] for i in missing]), strict=True):
                got[i] = x
            if len(new) <= self.entries:
                self.known.update(zip([items[i] for i in missing], new, strict=True))
        return got


class Lookup:
    """Values of 64-bit keys in an open hash table; it is asked in blocks that stay in a processor's cache."""

    EMPTY, BLOCK = np.int64(np.iinfo(np.int64).min), 1 << 15

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.size = size = 1 << max(4, (2 * len(keys)).bit_length())
        table, own = np.full(size, self.EMPTY), np.zeros(size, values.dtype)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            slot = at[left]
            free = table[slot] == self.EMPTY
            table[slot[free]] = keys[left[free]]  # of several, one stays
            won = table[slot] == keys[left]
            own[slot[won]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (size - 1)
        # Key and value side by side: one access to memory gives both.
        self.table, self.kind = np.stack((table, own.view(np.int64)), axis=1), values.dtype

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - self.size.bit_length())).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 for one that is not there, and whether it is."""
        out, known = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
        for a in range(0, len(keys), self.BLOCK):
            key, value, hit = keys[a : a + self.BLOCK], out[a : a + self.BLOCK], known[a : a + self.BLOCK]
            at = self._slot(key)
            got = self.table.take(at, axis=0)
            np.equal(got[:, 0], key, out=hit)
            value[:] = got[:, 1]
            live = np.flatnonzero(~hit)
            value[live], at, there = 0, at[live], got[live, 0]
            while len(live):
                more = there != self.EMPTY
                live, at = live[more], (at[more] + 1) & (self.size - 1)
                got = self.table.take(at, axis=0)
                there = got[:, 0]
                found = there == key[live]
                value[live[found]], hit[live[found]] = got[found, 1], True
                live, at, there = live[~found], at[~found], there[~found]
        return out.view(self.kind), known


#: The model that this worker holds, by what it is made from. Workers serve one operator after another.
_HELD: dict = {}
#: Seconds without use after which a worker lets its model go: it waits beside the workers of later stages.
IDLE_S = 2.0
_CHANGE, _USED = threading.RLock(), {"at": 0.0, "watched": False}


def held(key, make: Callable):
    """What make() gives, kept in this worker for later batches until another model is asked for or none has come for a while."""
    with _CHANGE:
        if key not in _HELD:
            let_go()
            _HELD[key] = make()
        _USED["at"] = time.monotonic()
        if not _USED["watched"]:
            _USED["watched"] = True
            threading.Thread(target=_watch, daemon=True).start()
        return _HELD[key]


def _watch() -> None:
    """Lets the model go once it is idle, and ends then."""
    while (left := _USED["at"] + IDLE_S - time.monotonic()) > 0 or not _idle():
        time.sleep(max(left, 0.01))


def _idle() -> bool:
    """Lets the model go, unless it is in use or has been meanwhile."""
    with _CHANGE:
        if any(sys.getrefcount(model) > 3 for model in _HELD.values()):  # more than the table, this loop and the call: a batch is at work
            _USED["at"] = time.monotonic()
        if _USED["at"] + IDLE_S > time.monotonic():
            return False
        _USED["watched"] = False
        let_go()
        return True


def let_go() -> None:
    """Drops the model that an earlier operator has left in this worker, and gives its memory back."""
    with _CHANGE:
        _HELD.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns memory that this worker has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
