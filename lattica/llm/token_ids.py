"""Ids of whole texts by a public tokenizer whose tokens hold no white space.

Texts are cut at ASCII white space, and punctuation at a word's end is cut off where a letter or digit stands before it:
the tokenizer's own pattern ends a token at both places, so that the ids of a text are those of its pieces, one after
another (tested against the library on whole texts). ASCII pieces are asked for in lower case, as the normaliser has
them. Each distinct piece is encoded once, as long as a worker's memo holds it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from lattica.llm.text import distinct, per_text, split_words

MODEL = "word_bpe_49k.json"
#: Punctuation that is cut off; no special token ends with it.
TAIL = ".,;:!?#$%&*()\""
#: Entries of a generation of a worker's memos.
WORDS, PIECES = 250_000, 350_000
#: Pieces that are encoded as one text, with a control character between them that is a token by itself.
JOINED, BETWEEN = 256, "\x01"


class Generations:
    """Values of items in two generations: what is asked for moves to the younger one, and a full one replaces the older."""

    def __init__(self, compute: Callable[[list[str]], list], entries: int):
        self.compute, self.entries, self.young, self.old = compute, entries, {}, {}

    def __call__(self, items: list[str]) -> list:
        got = list(map(self.young.get, items))
        if missing := [i for i, x in enumerate(got) if x is None]:
            names = [items[i] for i in missing]
            values = list(map(self.old.get, names))
            if new := [k for k, x in enumerate(values) if x is None]:
                for k, x in zip(new, self.compute([names[k] for k in new]), strict=True):
                    values[k] = x
            if len(self.young) + len(names) > self.entries:
                self.old, self.young = self.young, {}
            self.young.update(zip(names, values, strict=True))
            for i, x in zip(missing, values, strict=True):
                got[i] = x
        return got


class WordEncoder:
    def __init__(self, model: str = MODEL):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model if os.path.isabs(model) else public_tokenizers.path(model))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces, self.words = Generations(self._encode, PIECES), Generations(self._cut, WORDS)
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids

    def _encode(self, items: list[str]) -> list[bytes]:
        plain = [x for x in items if BETWEEN not in x] if len(self.between) == 1 else []
        texts = [f" {BETWEEN} ".join(plain[a : a + JOINED]) for a in range(0, len(plain), JOINED)]
        found = []
        for text, a in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), range(0, len(plain), JOINED), strict=True):
            ids = np.array(text.ids, "<u4")
            at = np.flatnonzero(ids == self.between[0])
            raw, n = ids.tobytes(), min(JOINED, len(plain) - a)
            begins, ends = [0, *(4 * (at + 1)).tolist()], [*(4 * at).tolist(), len(raw)]
            if len(begins) != n:
                raise ValueError("the character between pieces is no token by itself")
            found += [raw[i:j] for i, j in zip(begins, ends, strict=True)]
        known = dict(zip(plain, found, strict=True))
        others = [x for x in items if x not in known]
        known |= {x: np.array(y.ids, "<u4").tobytes() for x, y in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True)}
        return [known[x] for x in items]

    def _cut(self, words: list[str]) -> list[bytes]:
        stems, tails = [], []
        for w in words:
            stem = w.rstrip(TAIL)
            # In lower case a letter may end with a mark, which is of one token with the punctuation.
            if not stem or stem == w or not (stem[-1].lower()[-1].isalnum() and ord(stem[-1]) < 0x250):
                stem = w
            tails.append(w[len(stem) :])
            # Special tokens begin with "<" and are told by their case.
            stems.append(stem.lower() if stem.isascii() and "<" not in stem else stem)
        asked = dict.fromkeys(stems)
        asked |= dict.fromkeys(x for x in tails if x)
        known = dict(zip(asked, self.pieces(list(asked)), strict=True))
        known[""] = b""
        return [known[s] + known[t] for s, t in zip(stems, tails, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (one entry more than texts)."""
        flat, offsets = split_words(texts)
        vocabulary, index = distinct(flat)
        own = pa.array(self.words(vocabulary.to_pylist()), pa.large_binary())
        sizes = np.asarray(pc.binary_length(own), dtype=np.int64) // 4
        taken = own.take(pa.array(index))
        raw = taken.buffers()[2] if len(taken) else None
        starts = np.concatenate(([0], np.cumsum(per_text(sizes[index], offsets))))
        return np.frombuffer(raw, "<u4")[: starts[-1]] if raw is not None and starts[-1] else np.zeros(0, "<u4"), starts
