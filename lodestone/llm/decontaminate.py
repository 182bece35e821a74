"""Benchmark decontamination by latent semantic retrieval and sequence checks.

Texts are cut into blocks of ``STRIDE`` words; a passage is two neighbouring
blocks. Passages are weighted by TF-IDF: words are hashed to ``SLOTS``; a word's
frequency is its occurrences in all distinct texts (a block rarely holds a word
twice; a row weighs one over the copies of its text, so copies of one document weigh as one), and words
in over ``stop_share`` of all blocks weigh nothing, except in items of which they are half or more: their words weigh
``least_weight`` at least. A randomised SVD, computed by Spark over
passages and benchmark items, gives a latent space for each block of items; every
passage of every document is projected and compared with every item there. The
SVD is an index and is fitted on a bounded sample of whole documents, about
``fit_passages`` passages, chosen by text hash; items are added as rows that weigh
``item_weight`` times the sample, so that a space of ``rank`` dimensions spans them. Everything else
covers all rows.

An item of over ``2 * PASSAGE`` words is cut into passages as texts are, for the cosine of a copy of the whole
falls with the root of its length; any of them proposes the item, which is then verified as a whole.

Beside it, pairs of neighbouring words that an item and a text share are counted exactly. A copy of an
item of m words with e words changed, left out or put in keeps m - 1 - 2e of them, so every copy with up to
(1 - ``min_paraphrase``) m such edits (and fewer than half of its words) is a candidate, whatever the words weigh.

The cosine of a short item is low among rarer neighbours, so a passage that holds ``min_held`` of the item's squared
weight is a candidate too, whatever else stands in it.

Candidates (cosine of at least ``min_cosine``, enough weight or enough pairs) are verified on the words around the
passage: the longest common subsequence must hold ``min_lcs`` of the item's words,
or, for a paraphrase, ``min_paraphrase`` of them and, as the answer check,
``min_answer`` of the item's last sentence in order.

A document is read once for ``parts_at_once`` parts of ``rank`` items each, and the driver holds the items of that
many parts at a time.

Defined cases: null and empty texts match nothing; an item of under ``min_words`` words is found only where all of its
words stand in a row, and one of under ``min_exact_words``, which can't be told from common phrases, isn't looked for;
items with equal texts are found one by one; repeated rows are checked one by one, rows without an id too; extra columns
are ignored. No items give an empty result. One row for each document and item: of several places the best, by the
share of the item, then of the answer, then the cosine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mix

STRIDE = 24
PASSAGE = 2 * STRIDE
SLOTS = 1 << 16
#: ASCII upper case to lower case; ASCII punctuation and word breaks to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 33 or c < 127 and not chr(c).isalnum() else c for c in range(256)
)


@dataclass(frozen=True)
class Limits:
    rank: int = 224
    item_weight: float = 10.0
    stop_share: float = 0.05
    least_weight: float = 1.0
    fit_passages: int = 200_000
    min_cosine: float = 0.4
    min_held: float = 0.5
    min_lcs: float = 0.75
    min_paraphrase: float = 0.55
    min_answer: float = 0.9
    min_words: int = 8
    min_exact_words: int = 5
    parts_at_once: int = 8


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time.
_PIECE = 1 << 18
_POWERS, _UNPOWERS = (np.cumprod(np.append(np.uint64(1), np.full(_PIECE - 1, x, np.uint64))) for x in (_BASE, _UNBASE))


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word [start, end) of folded bytes: its polynomial in an odd base, from running sums."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        size = int(ends[last - 1] - base)
        powers, back = (_POWERS[:size], _UNPOWERS) if size <= _PIECE else (np.cumprod(np.append(np.uint64(1), np.full(size - 1, _BASE, np.uint64))), _UNPOWERS)
        total = np.append(np.uint64(0), np.cumsum(data[base : base + size].astype(np.uint64) * powers))
        low, high = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (total[high] - total[low]) * back[low]
        first = last
    return mix(out ^ (ends - starts).astype(np.uint64))


def _find_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of folded bytes."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = data != 32
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def slots_of(own: list[bytes]) -> np.ndarray:
    """Slot of each word."""
    data = np.frombuffer(b" ".join(own), np.uint8)
    return (_hash_words(data, *_find_words(data)) >> np.uint64(48)).astype(np.int64)


@dataclass
class _Blocks:
    """Words of some texts, cut into blocks; arrays by block unless said otherwise."""

    data: bytes  # folded texts, parted by spaces
    begin: np.ndarray  # by word, as end and slots
    end: np.ndarray
    slots: np.ndarray
    starts: np.ndarray  # first word
    owner: np.ndarray
    ends: list[tuple[int, int]]  # words of each text

    @property
    def block_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.slots))))

    def words(self, low: int, high: int) -> list[bytes]:
        return self.data[self.begin[low] : self.end[high - 1]].split() if low < high else []

    def passages(self, by_block: np.ndarray) -> np.ndarray:
        """Sums of neighbouring blocks of a text; its last block alone."""
        out = by_block.copy()
        if len(out) > 1:
            same = self.owner[1:] == self.owner[:-1]
            out[:-1][same] += by_block[1:][same]
        return out


def _blocks(texts: list[str | None]) -> _Blocks:
    folded = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    data = b" ".join(folded)
    raw = np.frombuffer(data, np.uint8)
    begin, end = _find_words(raw)
    edges = np.cumsum([0, *(len(f) + 1 for f in folded)])
    bounds = np.searchsorted(begin, edges)
    counts = np.diff(bounds)
    blocks = -(-counts // STRIDE)
    owner = np.repeat(np.arange(len(texts)), blocks)
    place = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    slots = (_hash_words(raw, begin, end) >> np.uint64(48)).astype(np.int64)
    return _Blocks(data, begin, end, slots, bounds[owner] + place * STRIDE, owner, list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)))


def _chunks(batches: Iterator[pa.RecordBatch], chars: int = 400_000):
    """Lists of the columns, of which the second is the text, of bounded size; one text is never split."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            rows.append([x.as_py() for x in row])
            size += len(rows[-1][1] or "")
            if size >= chars:
                yield list(zip(*rows))
                rows, size = [], 0
    if rows:
        yield list(zip(*rows))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each slot in distinct texts, from (copies, text); at slot -1 the number of blocks."""
    held, total = np.zeros(SLOTS), 0.0
    for copies, texts in _chunks(batches):
        b = _blocks(texts)
        if len(b.starts):
            weight = 1 / np.array(copies, np.float64)
            lengths = [high - low for low, high in b.ends]
            held += np.bincount(b.slots, np.repeat(weight, lengths), minlength=SLOTS)
            total += weight[b.owner].sum()
    used = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(held[used], total))], names=["slot", "n"]
    )


def _project(b: _Blocks, column: np.ndarray, idf: np.ndarray, basis: np.ndarray):
    """Passages in the space of ``basis`` (rows: item columns), from words that have a column."""
    col = np.where(idf[b.slots] > 0, column[b.slots], -1)
    at = np.flatnonzero(col >= 0)
    block = b.block_of[at]
    count = np.bincount(block, minlength=len(b.starts))
    # Blocks with most such words first: the j-th words of those that have one are then a prefix, added in one go.
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = np.arange(len(at)) - (np.cumsum(count) - count)[block]
    words = np.zeros((STRIDE, len(order)), np.int64)
    words[place, rank[block]] = col[at]
    weighted = basis * idf[np.flatnonzero(column >= 0), None]
    sums = np.zeros((len(order), basis.shape[1]), np.float32)
    ahead = np.searchsorted(-count[order], -np.arange(1, STRIDE + 1), "right")
    for j, m in enumerate(ahead):
        if m:
            sums[:m] += weighted[words[j, :m]]
    by_block = np.empty_like(sums)
    by_block[order] = sums
    return b.passages(by_block), at, col


def _multiplier(columns: list[np.ndarray], idf: list[np.ndarray], omegas: list[np.ndarray]):
    """Rows of A^T A omega for each part, summed over the passages seen."""

    def add(out: np.ndarray, b: _Blocks, column: np.ndarray, idf: np.ndarray, omega: np.ndarray) -> None:
        y, at, col = _project(b, column, idf, omega)
        if not len(at):
            return
        # A word counts in the passage that starts at its block and in the one that ends there.
        y[1:] += np.where((b.owner[1:] == b.owner[:-1])[:, None], y[:-1], 0)
        order = at[np.argsort(col[at], kind="stable")]
        first = np.flatnonzero(np.diff(col[order], prepend=-1))
        block = b.block_of
        for k in range(0, omega.shape[1], 32):
            rows = y[block[order], k : k + 32] * idf[b.slots[order], None]
            out[col[order][first], k : k + 32] += np.add.reduceat(rows, first, axis=0)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(omega.shape, np.float64) for omega in omegas]
        for _, texts in _chunks(batches):
            b = _blocks(texts)
            for each in zip(sums, columns, idf, omegas, strict=True):
                add(each[0], b, *each[1:])
        for part, out in enumerate(sums):
            used = np.flatnonzero(out.any(axis=1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out[used].ravel()), out.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), part, np.int32)), pa.array(used), flat.cast(pa.list_(pa.float64()))], names=["part", "col", "row"]
            )

    return multiply


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence; ``a`` as bits of one integer."""
    place: dict = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if (m := place.get(w)) is not None:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]

    @staticmethod
    def of(item_id: int, text: str | None) -> Item:
        sentences = [w for s in re.split(r"(?<=[.!?])\s+", text or "") if (w := words(s))]
        return Item(item_id, words(text), sentences[-1] if sentences else [])


def judge(item: Item, near: list[bytes], limits: Limits) -> tuple[float, float, bool]:
    """(share of the item in common, share of its answer, leaked) for the words around a passage."""
    held = set(near)
    if sum(w in held for w in item.words) < limits.min_paraphrase * len(item.words):  # the subsequence can't be longer
        return 0.0, 0.0, False
    share = lcs(item.words, near) / len(item.words)
    if share < limits.min_paraphrase:
        return share, 0.0, False
    answer = lcs(item.answer, near) / len(item.answer)
    return share, answer, share >= limits.min_lcs or answer >= limits.min_answer


def _pairs(held: np.ndarray) -> np.ndarray:
    """One number for each two neighbouring slots."""
    return held[:-1] * SLOTS + held[1:]


class _Shared:
    """Places in texts that share so many word pairs with an item that a copy may lie there."""

    def __init__(self, items: list[Item], limits: Limits) -> None:
        sizes = np.array([len(i.words) for i in items])
        self.edits = ((1 - limits.min_paraphrase) * sizes + 1e-9).astype(np.int64)
        self.least = np.maximum(1, sizes - 1 - 2 * self.edits)
        self.span = (sizes + self.edits + STRIDE - 2) // STRIDE + 1  # blocks that a copy can touch
        own = [np.unique(_pairs(slots_of(i.words))) for i in items]
        item = np.repeat(np.arange(len(items)), [len(o) for o in own])
        pair = np.concatenate(own)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.first, self.times = np.unique(pair[order], return_index=True, return_counts=True)
        self.item = item[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._short(self.pairs)] = True

    @staticmethod
    def _short(pairs: np.ndarray) -> np.ndarray:
        return (pairs * 0x9E3779B1 >> 12) & ((1 << 20) - 1)

    def places(self, b: _Blocks) -> Iterator[tuple[int, int]]:
        """(block, item): from this block on, at least ``least`` pairs within ``span`` blocks of the text."""
        pairs = _pairs(b.slots)
        at = np.flatnonzero(self.maybe[self._short(pairs)])
        found = np.minimum(np.searchsorted(self.pairs, pairs[at]), len(self.pairs) - 1)
        same = self.pairs[found] == pairs[at]
        at, found = at[same], found[same]
        block = np.searchsorted(b.starts, at, "right") - 1
        inside = b.owner[block] == b.owner[np.searchsorted(b.starts, at + 1, "right") - 1]
        block, found = block[inside], found[inside]
        if not len(block):
            return iter(())
        times, n = self.times[found], len(b.starts)
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = self.item[np.repeat(self.first[found], times) + offset]
        key, count = np.unique(item * n + np.repeat(block, times), return_counts=True)
        item, block = key // n, key % n
        total = np.append(0, np.cumsum(count))
        last = np.minimum(block + self.span[item], np.searchsorted(b.owner, b.owner[block], "right"))
        held = total[np.searchsorted(key, item * n + last)] - total[:-1]
        enough = held >= self.least[item]
        return zip(block[enough].tolist(), item[enough].tolist(), strict=True)


@dataclass(frozen=True)
class _Piece:
    """An item, or a passage of a long one: a row of the latent search."""

    item: Item
    words: list[bytes]

    @staticmethod
    def of(item: Item) -> list[_Piece]:
        n = len(item.words)
        if n <= 2 * PASSAGE:
            return [_Piece(item, item.words)]
        return [_Piece(item, item.words[s : s + PASSAGE]) for s in range(0, n - STRIDE, STRIDE)]


def _parts(items: list[Item], rank: int) -> list[list[_Piece]]:
    """Pieces of whole items in parts of ``rank`` at most; an item of more pieces has a part to itself."""
    parts: list[list[_Piece]] = [[]]
    for item in items:
        own = _Piece.of(item)
        if len(parts[-1]) + len(own) > rank and parts[-1]:
            parts.append([])
        parts[-1] += own
    return parts


@dataclass
class _Space:
    """A part of the items with its latent space."""

    pieces: list[_Piece]
    column: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    norms: np.ndarray

    def __post_init__(self) -> None:
        self.items = list({id(p.item): p.item for p in self.pieces}.values())
        place = {id(item): k for k, item in enumerate(self.items)}
        self.item_of = np.array([place[id(p.item)] for p in self.pieces])
        self.first = np.searchsorted(self.item_of, np.arange(len(self.items) + 1))

    def search(self, b: _Blocks, shared: _Shared, limits: Limits) -> Iterator[tuple[int, Item, tuple[float, float, float]]]:
        """(text, item, (share of the item, of its answer, cosine)) of the leaks in some texts."""
        y, _, _ = _project(b, self.column, self.idf, self.basis)
        weight = b.passages(np.add.reduceat(self.idf[b.slots] ** 2, b.starts))
        common = y @ self.latent.T
        cosine = common / np.sqrt(np.maximum(weight, 1e-9))[:, None]
        found: dict[tuple[int, int], tuple[float, float, float]] = {}

        def check(p: int, k: int, before: int, after: int) -> None:
            key = (int(b.owner[p]), k)
            low, high = b.ends[key[0]]
            old = found.get(key)
            if old is not None and old[:2] == (1.0, 1.0):
                return
            near = b.words(max(low, int(b.starts[p]) - before), min(high, int(b.starts[p]) + after))
            share, answer, leaked = judge(self.items[k], near, limits)
            if leaked:
                new = (share, answer, float(cosine[p, self.first[k] : self.first[k + 1]].max()))
                found[key] = max(old or new, new)

        least = np.where(self.norms > 0, limits.min_held * self.norms, np.inf).astype(np.float32)
        passage, piece = np.nonzero((cosine >= limits.min_cosine) | (common >= least))
        for p, k in np.unique(np.stack([passage, self.item_of[piece]], 1), axis=0):
            reach = len(self.items[k].words) + len(self.items[k].words) // 4
            check(int(p), int(k), reach, 2 * STRIDE + reach)
        for p, k in shared.places(b):
            size = len(self.items[k].words)
            check(p, k, size, STRIDE + size + int(shared.edits[k]))
        return ((t, self.items[k], v) for (t, k), v in found.items())


def _verbatim(b: _Blocks, short: dict[tuple[bytes, ...], list[Item]]) -> set[tuple[int, int]]:
    """(text, item) where all words of a short item stand in a row."""
    out = set()
    for n in {len(w) for w in short}:
        for text, (low, high) in enumerate(b.ends):
            own = b.words(low, high)
            for i in range(len(own) - n + 1):
                if found := short.get(tuple(own[i : i + n])):
                    out.update((text, item.item_id) for item in found)
    return out


def _searcher(spaces: list[_Space], short: list[Item], limits: Limits):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64()), ("_text", pa.int64())]
    )
    whole: dict[tuple[bytes, ...], list[Item]] = {}
    for item in short:
        whole.setdefault(tuple(item.words), []).append(item)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = [_Shared(space.items, limits) for space in spaces]
        for ids, texts, keys in _chunks(batches):
            b = _blocks(texts)
            if not len(b.starts):
                continue
            rows = [(t, item.item_id, c, s, a) for space, pairs in zip(spaces, shared, strict=True) for t, item, (s, a, c) in space.search(b, pairs, limits)]
            rows += [(t, item, None, 1.0, 1.0) for t, item in _verbatim(b, whole)]
            rows = [(ids[t], *r, keys[t]) for t, *r in sorted(rows, key=lambda r: r[:2])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return search


def _weights(items: list[Item], held: np.ndarray, blocks: float, limits: Limits) -> np.ndarray:
    """Weight of each slot."""
    full = np.log((1 + blocks) / (1 + held))
    idf = np.where(held > limits.stop_share * blocks, 0, full)
    for item in items:
        own = slots_of(item.words)
        bare = own[held[own] > limits.stop_share * blocks]
        if 2 * len(bare) >= len(own):
            idf[bare] = np.maximum(full[bare], limits.least_weight)
    return idf.astype(np.float32)


def _item_matrix(items: list[_Piece], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each slot (-1: none), the pieces' TF-IDF rows of length 1 over these columns, their lengths before."""
    held = [slots_of(i.words) for i in items]
    used = np.unique(np.concatenate(held))
    column = np.full(SLOTS, -1, np.int64)
    column[used] = np.arange(len(used))
    rows = np.zeros((len(items), len(used)), np.float32)
    for i, own in enumerate(held):
        np.add.at(rows[i], column[own], idf[own])
    norms = np.linalg.norm(rows, axis=1)
    return column, rows / np.maximum(norms, 1e-9)[:, None], norms


def latent_bases(sample: DataFrame, matrices: list[tuple[np.ndarray, np.ndarray]], idf: list[np.ndarray], limits: Limits, power: int = 1) -> list[np.ndarray]:
    """Leading right singular vectors of sampled passages and weighted items, by randomised subspace iteration.

    ``matrices`` has (column of each slot, rows of the pieces) of each part; all parts share each pass over the sample. What
    reaches the driver is a matrix of a part's distinct words by ``rank``."""
    bases = []
    for _, rows in matrices:
        rank = min(max(limits.rank, len(rows)), rows.shape[1])
        bases.append(np.random.default_rng(5).standard_normal((rows.shape[1], rank)).astype(np.float32))
    for _ in range(power + 1):
        out = [np.zeros(q.shape) for q in bases]
        sums = (
            sample.mapInArrow(_multiplier([c for c, _ in matrices], idf, bases), "part int, col bigint, row array<double>")
            .groupBy("part", "col")
            .agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
        )
        for part, col, row in sums.toLocalIterator():
            out[part][col] = row
        for k, (_, rows) in enumerate(matrices):
            own = rows.T @ (rows @ bases[k])
            out[k] += limits.item_weight * max(1e-9, np.linalg.norm(out[k]) / max(1e-9, np.linalg.norm(own))) * own
            bases[k] = np.linalg.qr(out[k])[0].astype(np.float32)
    return bases


RESULT = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double"


def _counts(texts: DataFrame) -> tuple[np.ndarray, float]:
    """Occurrences of each slot in distinct texts, and the number of blocks."""
    held, blocks = np.zeros(SLOTS), 0.0
    keyed = texts.select(F.xxhash64("text").alias("key"), "text")
    # Written first, so that its size is known and a small one is broadcast: the texts aren't shuffled.
    copies = cut(keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    counted = keyed.join(copies, "key", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), "text")
    for slot, n in counted.mapInArrow(_count, "slot bigint, n double").groupBy("slot").agg(F.sum("n")).toLocalIterator():
        if slot < 0:
            blocks = n
        else:
            held[slot] = n
    return held, blocks


def _groups(items: Iterator[Item], limits: Limits) -> Iterator[tuple[list[list[_Piece]], list[Item]]]:
    """(parts, short items) for one pass over the documents each."""
    some, short, size = [], [], 0
    for item in items:
        if len(item.words) < limits.min_words:
            short.append(item)
        else:
            some.append(item)
        size += len(_Piece.of(item))
        if size >= limits.rank * limits.parts_at_once:
            yield _parts(some, limits.rank), short
            some, short, size = [], [], 0
    if some or short:
        yield _parts(some, limits.rank), short


def _leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits, id_col: str) -> DataFrame:
    """``find_leaks`` with ``_text``, the hash of the text."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_text"))
    schema = RESULT + ", _text bigint"
    read = (Item.of(r.item_id, r.text) for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator())
    groups = _groups((i for i in read if len(i.words) >= limits.min_exact_words), limits)
    group = next(groups, None)
    if group is None:
        return docs.sparkSession.createDataFrame([], schema)
    held, blocks = _counts(texts.select("text"))
    share = min(1.0, limits.fit_passages / max(blocks, 1))
    sample = texts.select("doc_id", "text").where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    result = None
    while group is not None:
        parts, short = group
        parts = [p for p in parts if p]
        idf = [_weights(list({id(p.item): p.item for p in pieces}.values()), held, blocks, limits) for pieces in parts]
        matrices = [_item_matrix(pieces, w) for pieces, w in zip(parts, idf, strict=True)]
        bases = latent_bases(sample, [m[:2] for m in matrices], idf, limits) if parts else []
        spaces = [_Space(p, m[0], w, q, m[1] @ q, m[2]) for p, m, w, q in zip(parts, matrices, idf, bases, strict=True)]
        found = texts.mapInArrow(_searcher(spaces, short, limits), schema)
        group = next(groups, None)
        if result is not None or group is not None:
            found = cut(found, "leaks")  # the driver keeps one group's spaces, not all
        result = found if result is None else result.unionByName(found)
    return result


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share): each document with each benchmark item that it holds.

    Items are taken in parts of ``rank`` pieces or one longer item, each with a latent space of its own. cosine is null for
    short items, which are looked up word by word."""
    return _leaks(docs, benchmark, limits, id_col).drop("_text")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no benchmark item. Whether one does depends on its text alone, so an id may be null or repeated."""
    leaked = cut(_leaks(docs, benchmark, limits, id_col).select("_text").distinct(), "leaked-texts")
    return docs.join(leaked, F.xxhash64(docs["text"]) == leaked["_text"], "left_anti")
