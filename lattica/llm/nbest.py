"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a public model and their scores span a lattice over a text. The forward Viterbi pass
gives the best score of every prefix; these are exact heuristics for an A-star search that runs
backward from the end, so that complete segmentations leave the agenda best first.

The lattice is cut where no piece of the model can reach across: between two characters that no piece
holds side by side, and so at almost every space. What lies between two cuts is a cell. A text's best
segmentation is the best of each cell, and its N best differ from that in the cells with the
smallest losses, so the N lists are merged best first. Cells are memoised, and each distinct word of a
batch is looked at once. Characters that no piece covers cost `UNKNOWN_COST` more than the worst piece
and are encoded as the bytes of their UTF-8 form.

Text handling is that of the model's own normaliser (identity, one space put before the text, spaces
written as U+2581). Decoding joins pieces and bytes and takes the first space away again.

Defined results: null and empty texts have no pieces, score 0 and decode to the empty text; a text
that holds U+2581 itself decodes to spaces there (round_trip is false); of equal best segmentations of a cell the one
whose last pieces have the smaller ids comes first; a text with fewer than N segmentations has fewer scores.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from bisect import insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import Lookup, Memo, as_strings, distinct, give_back, held, slices

MODEL = "piece_bpe_32k.model"
NBEST = 3
UNKNOWN_COST = 10.0
NEVER = float("-inf")
#: Characters of a cell whose lattice is kept while it is searched.
KEPT = 4096
#: Characters of a cell that is worked on beside others, and of all cells that are.
BATCH_CELL, BATCH_CHARS = 64, 400_000
#: Bits of a code point in a step's key.
POINT_BITS = 21
SPACE = "▁"
SLICE_BYTES = 1 << 20

Ranked = list[tuple[float, tuple[int, ...]]]


class Pieces:
    """Pieces of a model: scores, ids, bytes, and which characters stand side by side in some piece."""

    def __init__(self, model: str):
        import os

        from sentencepiece import SentencePieceProcessor

        path = model if os.path.isabs(model) else public_tokenizers.path(model)
        library = SentencePieceProcessor(model_file=path)
        self.score, self.known, self.root, self.pairs = {}, {}, {}, set()
        self.as_bytes, self.byte_id = [], {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.as_bytes.append(bytes([value]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self.as_bytes.append(b"")
            else:
                self.as_bytes.append(piece.replace(SPACE, " ").encode())
                self.score[piece] = library.get_score(i)
                self.known[piece] = (self.score[piece], i)
                self.pairs.update(zip(piece, piece[1:], strict=False))
        # From a character to what follows it in pieces, and the piece that ends with it.
        for piece, own in self.known.items():
            node = self.root
            for c in piece[:-1]:
                node = node.setdefault(c, [{}, None])[0]
            node.setdefault(piece[-1], [{}, None])[1] = own
        self.longest = max(map(len, self.score), default=1)
        beside = np.fromiter(((ord(a) << POINT_BITS) | ord(b) for a, b in self.pairs), np.int64, len(self.pairs))
        self.beside = Lookup(beside, np.ones(len(beside), np.int64))
        # The same as numbered nodes, for many cells at once.
        numbers, steps = {"": 0}, {}
        for piece in self.known:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in numbers:
                    numbers[piece[:k]] = len(numbers)
                    steps[(numbers[piece[: k - 1]] << POINT_BITS) | ord(piece[k - 1])] = numbers[piece[:k]]
        self.steps = Lookup(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)))
        self.piece_of, self.score_of = np.full(len(numbers), -1, np.int64), np.zeros(len(numbers))
        for piece, (score, i) in self.known.items():
            self.piece_of[numbers[piece]], self.score_of[numbers[piece]] = i, score
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_COST

    def cells(self, text: str) -> list[str]:
        """The text in parts that no piece reaches across."""
        if self.pairs.issuperset(zip(text, text[1:], strict=False)):
            return [text]
        cuts = [i for i, pair in enumerate(zip(text, text[1:], strict=False), 1) if pair not in self.pairs]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def cells_of(self, items: list[str]) -> tuple[list[str], np.ndarray]:
        """The cells of all texts, one after another, and how many each text has. Texts are not empty."""
        whole = "".join(items)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, items), np.int64, len(items)))
        apart = np.zeros(len(points) + 1, bool)
        apart[1:-1] = ~self.beside.find((points[:-1] << POINT_BITS) | points[1:])[1]
        apart[ends] = True
        cuts = np.flatnonzero(apart)
        number = np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)
        cuts = cuts.tolist()
        return [whole[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], number

    def forward(self, text: str) -> tuple[list[float] | array, Callable[[int], list]]:
        """The Viterbi score of every prefix, and the steps (piece, begin, score) of the lattice into each place.

        Steps are kept for texts of at most `KEPT` characters; for longer ones they are looked up again.
        """
        size, root, unknown, longest = len(text), self.root, self.unknown, self.longest
        kept = size <= KEPT
        ends: list[list] = [[] for _ in range(size + 1)] if kept else []
        best = [0.0] + [NEVER] * size if kept else array("d", [0.0]) + array("d", [NEVER]) * size
        for a in range(size):
            node, base, alone = root, best[a], False
            for b, c in enumerate(text[a : a + longest], a + 1):
                hit = node.get(c)
                if hit is None:
                    break
                node, own = hit
                if own is not None:
                    score, piece = own
                    if kept:
                        ends[b].append((piece, a, score))
                    alone = alone or b == a + 1
                    if base + score > best[b]:
                        best[b] = base + score
            if not alone:
                if kept:
                    ends[a + 1].append((-ord(text[a]) - 1, a, unknown))
                best[a + 1] = max(best[a + 1], base + unknown)

        def into(end: int) -> list[tuple[int, int, float]]:
            known = self.known
            out = [(own[1], a, own[0]) for a in range(max(0, end - longest), end) if (own := known.get(text[a:end]))]
            return out if text[end - 1] in known else [*out, (-ord(text[end - 1]) - 1, end - 1, unknown)]

        return best, ends.__getitem__ if kept else into

    def first(self, text: str) -> tuple[float, tuple[int, ...], float]:
        """The best segmentation's score and ids, and what the second best loses against it.

        The second best leaves the best path at one place at least, and before the last such place it is
        itself the best: the first step of the backward search sees its exact score.
        """
        best, into = self.forward(text)
        at, trail, loss = len(text), [], float("inf")
        while at:
            choice = None
            for piece, a, own in into(at):
                entry = (best[at] - best[a] - own, piece, a)
                if choice is None or entry < choice:
                    choice, entry = entry, choice
                if entry is not None and entry[0] < loss:
                    loss = entry[0]
            trail.append(choice[1])
            at = choice[2]
        return best[-1], self._ids(trail), loss

    def firsts(self, items: list[str]) -> list[bytes]:
        """first() of each cell, packed. Cells of at most `BATCH_CELL` characters are worked on side by side."""
        out: list[bytes] = [b""] * len(items)
        batch: list[int] = []
        chars = 0
        for i, x in enumerate(items):
            if not 0 < len(x) <= BATCH_CELL:
                out[i] = pack(*self.first(x))
                continue
            batch.append(i)
            chars += len(x)
            if chars > BATCH_CHARS or i == len(items) - 1:
                self._side_by_side(items, batch, out)
                batch, chars = [], 0
        if batch:
            self._side_by_side(items, batch, out)
        return out

    def _lattice(self, points: np.ndarray, last: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """begin, end, piece and score of every step. last: where each character's cell ends; node: its number in the lattice."""
        at, state, alone = np.arange(len(points)), np.zeros(len(points), np.int64), np.zeros(len(points), bool)
        steps = []
        for size in range(1, self.longest + 1):
            inside = at + size <= last[at]
            at, state = at[inside], state[inside]
            state, there = self.steps.find((state << POINT_BITS) | points[at + size - 1])
            at, state = at[there], state[there]
            if not len(at):
                break
            whole = self.piece_of[state] >= 0
            if size == 1:
                alone[at[whole]] = True
            steps.append((node[at[whole]], node[at[whole]] + size, self.piece_of[state[whole]], self.score_of[state[whole]]))
        odd = np.flatnonzero(~alone)
        steps.append((node[odd], node[odd] + 1, -points[odd] - 1, np.full(len(odd), self.unknown)))
        return tuple(np.concatenate(x) for x in zip(*steps, strict=True))

    def _side_by_side(self, items: list[str], batch: list[int], out: list[bytes]) -> None:
        """Fills in the packed best segmentations of a batch of short cells."""
        cells = [items[i] for i in batch]
        points = np.frombuffer("".join(cells).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size, number = np.fromiter(map(len, cells), np.int64, len(cells)), np.arange(len(cells))
        ends = np.cumsum(size)
        # A cell has a node before each character and one at its end.
        origin = ends - size + number
        begin, end, piece, score = self._lattice(points, np.repeat(ends, size), np.arange(len(points)) + np.repeat(number, size))
        place = np.arange(len(points) + len(cells)) - np.repeat(origin, size + 1)
        order = np.lexsort((end, place[end]))
        begin, end, piece, score = begin[order], end[order], piece[order], score[order]
        best = np.full(len(place), NEVER)
        best[origin] = 0.0
        bounds = np.searchsorted(place[end], np.arange(1, int(size.max()) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # every prefix of one length after another
            first = np.flatnonzero(np.concatenate(([True], end[a + 1 : b] != end[a : b - 1])))
            best[end[a:b][first]] = np.maximum.reduceat(best[begin[a:b]] + score[a:b], first)
        lost = best[end] - best[begin] - score
        order = np.lexsort((begin, piece, lost, end))
        begin, end, piece, lost = begin[order], end[order], piece[order], np.append(lost[order], np.inf)
        choice = np.searchsorted(end, np.arange(len(place)))
        rival = np.append(end, -1)
        at, loss, count, odd, walk = origin + size, np.full(len(cells), np.inf), np.zeros(len(cells), np.int64), np.zeros(len(cells), bool), []
        live = number
        while len(live):
            own = choice[at[live]]
            loss[live] = np.minimum(loss[live], np.where(rival[own + 1] == at[live], lost[own + 1], np.inf))
            walk.append((live, count[live], piece[own]))
            odd[live] |= piece[own] < 0
            count[live] += 1
            at[live] = begin[own]
            live = live[at[live] != origin[live]]
        start = np.cumsum(count + 4) - count - 4
        packed = np.zeros(int((count + 4).sum()), "<i4")
        for who, step, what in walk:
            packed[start[who] + 3 + count[who] - step] = what
        packed[start[:, None] + np.arange(4)] = np.stack((best[origin + size], loss), axis=1).view("<i4")
        data, edges = packed.tobytes(), np.append(start, len(packed)) * 4
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            # A character without a piece is several bytes.
            out[batch[k]] = pack(*self.first(cells[k])) if odd[k] else data[a:b]

    def search(self, text: str, n: int) -> Ranked:
        """The n best segmentations with their scores, best first: A-star backward over the lattice.

        A partial segmentation's estimate is exact, so each one on the agenda stands for a whole
        segmentation of just that score. Hence the agenda never needs more than n entries. An entry points back to
        the one it goes on from, so that a step costs the same however long the text is.
        """
        best, into = self.forward(text)
        agenda, found, steps = [(-best[-1], 0, 0, len(text), 0.0, None)], [], 0
        while agenda:
            total, _, _, at, score, trail = agenda.pop(0)
            if not at:
                found.append((-total, self._ids(unwound(trail))))
                n -= 1
                continue
            steps -= 1  # of equal ones, what goes on from the latest entry comes first
            for i, (piece, a, own) in enumerate(sorted(into(at))):
                own += score
                entry = (-best[a] - own, steps, i, a, own, (piece, trail))
                if len(agenda) < n or entry[:3] < agenda[-1][:3]:
                    insort(agenda, entry)
                    if len(agenda) > n:
                        agenda.pop()
        return found

    def _ids(self, trail: Sequence[int]) -> tuple[int, ...]:
        """Ids of pieces that are given from the last to the first."""
        out: list[int] = []
        for piece in reversed(trail):
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_id[x] for x in chr(-piece - 1).encode("utf-8", "surrogatepass")]
        return tuple(out)


def unwound(trail: tuple | None) -> list[int]:
    """The pieces of a chain of (piece, chain), from the last to the first."""
    out = []
    while trail:
        piece, trail = trail
        out.append(piece)
    return out[::-1]


def merge(lists: list[Ranked], n: int) -> Ranked:
    """The n best ways to take one entry of each list, in order, best first."""
    open_lists = [i for i, ranked in enumerate(lists) if len(ranked) > 1]
    # Only the n - 1 lists with the smallest losses can have another entry than their first.
    few = sorted(heapq.nsmallest(n - 1, open_lists, key=lambda i: lists[i][0][0] - lists[i][1][0]))
    total, out = sum(ranked[0][0] for ranked in lists), []
    for lost, taken in changes({i: lists[i] for i in few}, n):
        other = dict(taken)
        out.append((total + lost, tuple(chain.from_iterable(ranked[other.get(i, 0)][1] for i, ranked in enumerate(lists)))))
    return out


def pack(score: float, ids: tuple[int, ...], loss: float) -> bytes:
    """A best segmentation as bytes: its score, what the second best loses, and 32-bit ids. Memos hold these: they are small."""
    return struct.pack(f"<dd{len(ids)}i", score, loss, *ids)


class NBestCoder:
    """Encodes texts with a model's pieces."""

    def __init__(self, model: str = MODEL, n: int = NBEST):
        self.pieces, self.n = Pieces(model), n
        self.table = pa.array(self.pieces.as_bytes, pa.large_binary())
        self.firsts = Memo(self.pieces.firsts, 250_000)
        self.units = Memo(self._units_first, 200_000)
        self.ranked = Memo(lambda items: [self.rank(x) for x in items], 10_000)

    def _units_first(self, items: list[str]) -> list[bytes]:
        """The packed best segmentation of each unit: scores of its cells add up, and the least loss is its own."""
        cells, number = self.pieces.cells_of(items)
        packed = self.firsts(cells)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        every = np.frombuffer(b"".join(packed), dtype="<i4")
        start = np.cumsum(size) - size
        first = np.cumsum(number) - number
        head = np.ascontiguousarray(every[start[:, None] + np.arange(4)]).view("<f8")
        best, loss = np.add.reduceat(head[:, 0], first), np.minimum.reduceat(head[:, 1], first)
        # The heads of a unit's first cell become the unit's, those of its other cells go.
        lead = np.zeros(len(cells), bool)
        lead[first] = True
        kept = np.ones(len(every), bool)
        kept[start[~lead][:, None] + np.arange(4)] = False
        every = every.copy()
        every[start[first][:, None] + np.arange(4)] = np.stack((best, loss), axis=1).view("<i4")
        data, edges = every[kept].tobytes(), np.concatenate(([0], np.cumsum(np.add.reduceat(size - 4 * ~lead, first)))) * 4
        return [data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def rank(self, text: str) -> Ranked:
        """The n best segmentations of normal text."""
        return merge([self.pieces.search(x, self.n) for x in self.pieces.cells(text)], self.n)

    def encode(self, text: str) -> Ranked:
        """The n best segmentations of a whole text."""
        if not text:
            return [(0.0, ())]
        return self.rank(SPACE + text.replace(" ", SPACE))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces.as_bytes[i] for i in ids)[1:].decode("utf-8", "replace")

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of the texts (a run of spaces with what follows, the first space put before), and where each text's begin."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring_regex(texts, "^ | $|^$|▁"))
        if not pc.any(odd).as_py():
            lists = pc.split_pattern(texts, " ")
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            space, nothing = (pa.scalar(x, pa.large_string()) for x in (SPACE, ""))
            return pc.binary_join_element_wise(space, flat, nothing), offsets - offsets[0]
        own = [re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        return pa.array(list(chain.from_iterable(own)), pa.large_string()), offsets

    def encode_batch(self, texts: pa.Array) -> Encoded:
        """The n best segmentations of each text."""
        units, offsets = self._units(texts)
        vocabulary, index = distinct(units)
        names = vocabulary.to_pylist()
        packed = self.units(names)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        every = np.frombuffer(b"".join(packed), dtype="<i4")
        start = np.cumsum(size) - size
        head = np.ascontiguousarray(every[start[:, None] + np.arange(4)]).view("<f8")
        best, loss = head[:, 0], head[:, 1]
        begin, length = start + 4, size - 4
        each = length[index]
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = every[np.repeat(begin[index] - ends[:-1], each) + np.arange(ends[-1])]
        scores, choices = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = index[a:b]
            # Only the n - 1 units with the smallest losses can be another choice in the n best.
            few = np.sort(np.argpartition(loss[own], self.n - 2)[: self.n - 1]) if len(own) >= self.n > 1 else np.arange(len(own))
            total = best[own].sum()
            ranked = {int(a + i): r for i, r in zip(few, self.ranked([names[own[i]] for i in few]), strict=True)}
            top = changes(ranked, self.n)
            scores.append([float(total + s) for s, _ in top])
            choices.append([[(at, ranked[at][k][1]) for at, k in taken] for _, taken in top])
        give_back()
        bounds = pa.array(ends[offsets], pa.int32())
        decoded = pc.binary_join(pa.ListArray.from_arrays(bounds, self.table.take(pa.array(ids))), pa.scalar(b"", pa.large_binary()))
        space, nothing = (pa.scalar(x, pa.large_binary()) for x in (b" ", b""))
        expected = pc.binary_join_element_wise(space, texts.cast(pa.large_binary()), nothing)
        same = pc.or_(pc.equal(decoded, expected), pc.equal(pc.binary_length(texts), 0))
        return Encoded(ids, ends, offsets, scores, choices, np.asarray(same))


@dataclass
class Encoded:
    """The n best segmentations of some texts: the ids of the best ones, and what the others have instead of them."""

    ids: np.ndarray
    #: Where the ids of each unit begin, and at which unit each text begins.
    ends: np.ndarray
    offsets: np.ndarray
    scores: list[list[float]]
    #: For each segmentation of a text: the units in which it differs from the best one, in order, with their ids.
    choices: list[list[list[tuple[int, tuple[int, ...]]]]]
    round_trip: np.ndarray

    def best(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.ends[self.offsets], pa.int32()), pa.array(self.ids, pa.int32()))

    def segmentations(self, text: int) -> Iterator[np.ndarray]:
        """The ids of a text's segmentations, best first."""
        last = self.ends[self.offsets[text + 1]]
        for choice in self.choices[text]:
            parts, at = [], self.ends[self.offsets[text]]
            for unit, ids in choice:
                parts += [self.ids[at : self.ends[unit]], np.array(ids, "<i4")]
                at = self.ends[unit + 1]
            yield np.concatenate([*parts, self.ids[at:last]]).astype("<i4")


def changes(ranked: dict[int, Ranked], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n best ways to take one entry of each unit: what it loses, and which units have another entry than their first."""
    out: list = [(0.0, ())]
    for unit, own in ranked.items():
        if len(own) > 1:
            both = [(lost + s - own[0][0], taken + ((unit, k),) * (k > 0)) for lost, taken in out for k, (s, _) in enumerate(own)]
            out = sorted(both, key=lambda x: -x[0])[:n]
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n: int = NBEST) -> DataFrame:
    """doc_id, n_pieces, ids of the best segmentation, scores of the n best, and round_trip, of every whole text.

    Rows leave a slice at a time, so that a task holds the ids of a few megabytes of text only.
    """
    names = ["doc_id", "n_pieces", "ids", "scores", "round_trip"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(("pieces", model, n), lambda: NBestCoder(model, n))
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, SLICE_BYTES):
                got = coder.encode_batch(as_strings(texts.slice(a, b - a)))
                ids = got.best()
                size = pc.list_value_length(ids).cast(pa.int64())
                columns = [batch.column(0).slice(a, b - a), size, ids, pa.array(got.scores, pa.list_(pa.float64())), pa.array(got.round_trip)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(encoded, f"doc_id {kind}, n_pieces long, ids array<int>, scores array<double>, round_trip boolean")


def decode(ids: Column, model: str = MODEL) -> Column:
    """Text of each array of ids; null for null."""

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        coder = held(("pieces", model, NBEST), lambda: NBestCoder(model, NBEST))
        return pa.array([None if x is None else coder.decode(x) for x in lists.to_pylist()], pa.string())

    return decoded(ids)


def segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n: int = NBEST) -> DataFrame:
    """doc_id, rank (from 1), score and ids: a row for each of the n best segmentations of every whole text."""
    names = ["doc_id", "rank", "score", "ids"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(("pieces", model, n), lambda: NBestCoder(model, n))
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                got = coder.encode_batch(as_strings(batch.column(1).slice(a, b - a)))
                for i, scores in enumerate(got.scores):
                    ids = batch.column(0).take(pa.array([a + i] * len(scores)))
                    lists = pa.array([x.tolist() for x in got.segmentations(i)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(1, len(scores) + 1), pa.int32()), pa.array(scores, pa.float64()), lists], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(listed, f"doc_id {dict(rows.dtypes)['doc_id']}, rank int, score double, ids array<int>")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n: int = NBEST) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the best ids as 32-bit little-endian numbers), scores, nbest_crc32 (of the ids of each of
    the n best segmentations) and round_trip of every whole text."""
    kind = pa.struct([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("scores", pa.list_(pa.float64())), ("nbest_crc32", pa.list_(pa.int64())), ("round_trip", pa.bool_())])

    @F.arrow_udf("struct<n_pieces: bigint, ids_crc32: bigint, scores: array<double>, nbest_crc32: array<bigint>, round_trip: boolean>")
    def digested(texts: pa.Array) -> pa.Array:
        coder = held(("pieces", model, n), lambda: NBestCoder(model, n))
        out: list[dict] = []
        for a, b in slices(texts, SLICE_BYTES):
            got = coder.encode_batch(as_strings(texts.slice(a, b - a)))
            size = np.diff(got.ends[got.offsets]).tolist()
            for i, (k, scores, same) in enumerate(zip(size, got.scores, got.round_trip.tolist(), strict=True)):
                crc = [zlib.crc32(x) for x in got.segmentations(i)]
                out.append({"n_pieces": k, "ids_crc32": crc[0], "scores": scores, "nbest_crc32": crc, "round_trip": same})
        return pa.array(out, kind)

    got = docs.select(F.col(id_col).alias("doc_id"), digested(F.col(text_col)).alias("got"))
    return got.select("doc_id", "got.*")
