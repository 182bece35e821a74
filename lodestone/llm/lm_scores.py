"""Texts scored by a smoothed n-gram model that is run as a weighted backoff automaton.

Training texts give n-gram counts up to ``order``. An n-gram (h, w) has probability
(c(hw) + m P(w | h')) / (c(h) + m), where h' is h without its first word and m the prior
weight of its order; below single words stands the base model with 0.1 added to every
count. Given h this sums to 1 over all known words and one unknown.

Every context seen in training is a state of the automaton, with an arc for each n-gram
that goes on from it (weight: its log10 probability; it leads to the longest suffix that is
a state) and one failure arc to the state of h' (weight: log10 of m / (c(h) + m)). A text is
read once from left to right: follow the word's arc, or fail until some state has one. From
the empty context an unknown word leads back there.

Texts become pieces of at most ``PIECE`` tokens; a later piece first reads the ``order`` - 1
tokens before it without counting them, after which its state is the one the whole text
would have, for a state is a suffix of that length. Pieces are gathered in blocks, which are
written once with words as 64-bit hashes (xxh3). A block asks for its distinct n-grams,
telling how often its training texts hold each: sorted hashes, in slices by their upper
bits. A slice's task sums up what all blocks tell and answers each block, key by key, with
what the others hold. So the counts of all texts cross the cluster once, no task holds more
than a slice or a block, and nothing of the model passes the driver but its two sums. A block
then builds the part of the automaton that its texts can reach and runs all its pieces
through it in step, one token of each at a time.

Defined cases: null and empty texts have the end token only; a null id counts as the empty
text; repeated rows are texts of their own, each with a row of the result; texts of any
length are scored whole; without training texts all counts are zero; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, free_shuffles, mix

#: Own tokens of a piece, tokens of a block, and about how many n-grams of all blocks a slice gets.
PIECE, BLOCK, SLICE = 1024, 500_000, 1_000_000
#: What the base model adds to every count.
ADDED = 0.1
#: Prior weights of pairs and triples of words. Of those tried on held-out texts, a smaller one for triples scores texts with
#: copies in training better, but more fresh texts worse than single words do.
PRIOR = (1000.0, 30.0)
#: Hashes that stand for the beginning and the end of a text.
START, END = (xxhash.xxh3_64_intdigest(x) for x in (b"\0start", b"\0end"))
_A = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str, chars: int = 1 << 20) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, parted by space and U+0009-U+000D, and of its end."""
    data = text.encode("utf-8", "surrogatepass").lower()
    found, at = [], 0
    while at < len(data):
        end = min(at + chars, len(data))
        while end < len(data) and data[end : end + 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[at:end].split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate([*found, np.array([END], np.uint64)])


def planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first, compressed: of the upper ones, mostly zero, hardly anything is left."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def pack(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def _blocks(order: int, doc_type: pa.DataType):
    fields = [("row", pa.list_(pa.int64())), ("doc_id", pa.list_(doc_type)), ("held", pa.list_(pa.bool_())), ("lead", pa.list_(pa.int32())), ("own", pa.list_(pa.int32()))]
    schema = pa.schema([("block", pa.int64()), *fields, ("words", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, parts, size = [], [], 0

        def emit() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            columns = [[list(c)] for c in zip(*pieces)]
            name = xxhash.xxh3_64_intdigest(f"{pieces[0][0]}:{first}") >> 1
            return pa.RecordBatch.from_pylist([{"block": name, **{n: c[0] for (n, _), c in zip(fields, columns)}, "words": pack(words), "tokens": planes(tokens.astype(np.int32))}], schema)

        for batch in batches:
            for row, doc_id, held, text in zip(*batch.columns, strict=True):
                row, doc_id, held = row.as_py(), doc_id.as_py(), held.as_py()
                tokens = np.concatenate([np.array([START], np.uint64), word_hashes(text.as_py() or "")])
                for k, at in enumerate(range(1, len(tokens), PIECE)):
                    if not pieces:
                        first = k
                    lead, end = max(0, at - order + 1), min(at + PIECE, len(tokens))
                    pieces.append((row, doc_id, held, at - lead, end - at))
                    parts.append(tokens[lead:end])
                    size += end - lead
                    if size >= BLOCK:
                        yield emit()
                        pieces, parts, size = [], [], 0
        if pieces:
            yield emit()

    return run


class Grams:
    """The distinct n-grams of a block by order, from 1; ``at[k]`` has the place of the one that ends at each token, or -1."""

    def __init__(self, order: int, block: dict) -> None:
        self.order, self.words = order, unpack(block["words"])
        self.tokens = from_planes(block["tokens"], np.int32)
        self.lead, self.own = np.array(block["lead"], np.int64), np.array(block["own"], np.int64)
        self.size = self.lead + self.own
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.begin.astype(np.int32), self.size)
        self.counts_here = place >= np.repeat(self.lead.astype(np.int32), self.size)
        train = np.repeat(~np.array(block["held"], bool), self.size)
        self.at, self.keys, self.counts, self.before, self.suffix = [None, self.tokens], [None, self.words], [None], [None, None], [None, None]
        self.last = [None, np.arange(len(self.words))]
        # The beginning of a text is only ever read before its first piece; as a context it is as frequent as texts.
        starts = self.words[self.tokens] == START
        self.counts.append(np.bincount(self.tokens[train & (self.counts_here | starts)], minlength=len(self.words)))
        for k in range(2, order + 1):
            previous = np.concatenate([np.array([-1], np.int32), self.at[k - 1][:-1]])
            known = (previous >= 0) & (place >= k - 1)
            codes, found = pd.factorize(previous[known].astype(np.int64) * len(self.words) + self.tokens[known])
            at = np.full(len(self.tokens), -1, np.int32)
            at[known] = codes
            before, last = np.divmod(found, len(self.words))
            suffix = np.empty(len(found), np.int64)
            suffix[codes] = self.at[k - 1][known]
            self.at.append(at)
            self.keys.append(mix(self.keys[k - 1][before] * _A + mix(self.words[last] + np.uint64(k))))
            told = known & self.counts_here & train
            self.counts.append(np.bincount(at[told], minlength=len(found)))
            self.before.append(before)
            self.suffix.append(suffix)
            self.last.append(last)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def _ask(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _rows(batch):
                grams, out = Grams(k, block), []
                by_key = np.argsort(grams.keys[k])
                keys, counts = grams.keys[k][by_key], grams.counts[k][by_key].astype(np.uint32)
                upper = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                edges = np.flatnonzero(np.diff(upper, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:]):
                    out.append((k << 32 | int(upper[a]), block["block"], pack(keys[a:b]), planes(counts[a:b])))
                del grams, by_key, keys, counts
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["slice", "block", "keys", "counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One slice of one order: what other blocks hold of each block's keys; words and their sum in the first row."""
    keys = [unpack(x.as_py()) for x in table["keys"]]
    counts = [from_planes(x.as_py(), np.uint32) for x in table["counts"]]
    whole, told = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    place = np.cumsum(np.diff(ranked, prepend=ranked[:1]) != 0)
    total = np.bincount(place, told[order]).astype(np.int64)
    others = np.empty(len(whole), np.int64)
    others[order] = total[place]
    others = (others - told).astype(np.uint32)
    n, tokens = [0] * len(keys), [0] * len(keys)
    if table["slice"][0].as_py() >> 32 == 1:
        real = total * (ranked[np.flatnonzero(np.diff(place, prepend=-1))] != np.uint64(START))
        n[0], tokens[0] = int(np.count_nonzero(real)), int(real.sum())
    ends = np.cumsum([len(k) for k in keys])
    return pa.table({"block": table["block"], "slice": table["slice"], "others": pa.array([planes(x) for x in np.split(others, ends[:-1])], pa.binary()), "n_words": pa.array(n, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})


class Automaton:
    """States and arcs that a block's texts can reach. State 0 is the empty context, then come those of one word, of two, ..."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, words: int, prior: tuple[float, ...]) -> None:
        self.n_words = len(grams.words)
        below = tokens + ADDED * (words + 1)
        chance = [None, (counts[1] + ADDED) / below]
        sizes = [1, *(len(c) for c in counts[1 : grams.order])]
        offset = np.concatenate([[0], np.cumsum(sizes)])
        self.fail, self.fail_weight = np.zeros(offset[-1], np.int64), np.zeros(offset[-1])
        arcs, weights, leads = [], [], []
        for k in range(1, grams.order + 1):
            if k > 1:
                c, m = counts[k - 1][grams.before[k]], prior[k - 2]
                chance.append((counts[k] + m * chance[k - 1][grams.suffix[k]]) / (c + m))
            if k < grams.order:
                own = slice(offset[k], offset[k + 1])
                self.fail[own] = offset[k - 1] + grams.suffix[k] if k > 1 else 0
                self.fail_weight[own] = np.log10(prior[k - 1] / (counts[k] + prior[k - 1]))
            seen = np.flatnonzero(counts[k])
            state = offset[k - 1] + grams.before[k][seen] if k > 1 else np.zeros(len(seen), np.int64)
            last = grams.last[k][seen]
            arcs.append(state * self.n_words + last)
            weights.append(np.log10(chance[k][seen]))
            leads.append(offset[k] + seen if k < grams.order else (offset[k - 1] + grams.suffix[k][seen] if k > 1 else np.zeros(len(seen), np.int64)))
        arc = np.concatenate(arcs)
        order = np.argsort(arc)
        self.arcs, self.weights, self.leads = arc[order], np.concatenate(weights)[order], np.concatenate(leads)[order]
        self.base, self.unknown = np.log10(chance[1]), math.log10(ADDED / below)

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, weights) of one word for each state: failure arcs until a state has the word's arc."""
        total, reached = np.zeros(len(states)), np.zeros(len(states), np.int64)
        left, state, word = np.arange(len(states)), states, words
        while len(left):
            wanted = state * self.n_words + word
            at = np.minimum(np.searchsorted(self.arcs, wanted), max(len(self.arcs) - 1, 0))
            hit = self.arcs[at] == wanted if len(self.arcs) else np.zeros(len(left), bool)
            total[left[hit]] += self.weights[at[hit]]
            reached[left[hit]] = self.leads[at[hit]]
            lost = ~hit & (state == 0)
            total[left[lost]] += self.unknown
            go = ~hit & (state > 0)
            left, state, word = left[go], state[go], word[go]
            total[left] += self.fail_weight[state]
            state = self.fail[state]
        return reached, total

    def run(self, grams: Grams) -> np.ndarray:
        """Log10 probability of every piece's own tokens: all pieces in step, each carrying its state."""
        by_size = np.argsort(-grams.size, kind="stable")
        begin, lead, size = grams.begin[by_size], grams.lead[by_size], grams.size[by_size]
        states, score = np.zeros(len(size), np.int64), np.zeros(len(size))
        for t in range(size[0]):
            k = np.searchsorted(-size, -t)
            states[:k], weight = self.step(states[:k], grams.tokens[begin[:k] + t])
            score[:k] += np.where(t >= lead[:k], weight, 0.0)
        out = np.empty(len(size))
        out[by_size] = score
        return out


def _score(order: int, tokens: int, words: int, prior: tuple[float, ...], out: pa.Schema):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        grams, counts = Grams(order, block), [None]
        told = sorted(zip(answers["slice"].to_pylist(), answers["others"].to_pylist()))
        for k in range(1, order + 1):
            others = np.concatenate([from_planes(x, np.uint32) for s, x in told if s >> 32 == k] or [np.empty(0, np.uint32)])
            total = grams.counts[k].copy()
            total[np.argsort(grams.keys[k])] += others
            counts.append(total)
        machine = Automaton(grams, counts, tokens, words, prior)
        piece = np.repeat(np.arange(len(grams.size)), grams.size)[grams.counts_here]
        own = grams.tokens[grams.counts_here]
        add = lambda x: np.bincount(piece, x, len(grams.size))
        values = [block["row"], block["doc_id"], block["held"], grams.own, add(counts[1][own] > 0).astype(np.int64), add(machine.base[own]), machine.run(grams)]
        return pa.table([pa.array(v, f.type) for v, f in zip(values, out)], schema=out)

    return run


def score(docs: DataFrame, held_out, order: int = 3, prior: tuple[float, ...] = PRIOR, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; rows where the condition
    ``held_out`` holds don't train the model."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    doc_type = pa.string() if kind.typeName() == "string" else pa.int64()
    id_sql = "string" if kind.typeName() == "string" else "bigint"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast(id_sql).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string"))
    schema = f"block bigint, row array<bigint>, doc_id array<{id_sql}>, held array<boolean>, lead array<int>, own array<int>, words binary, tokens binary"
    blocks = cut(rows.mapInArrow(_blocks(order, doc_type), schema), "lm-blocks")
    n = blocks.select(F.sum(F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, n / SLICE))))
    answers = None
    for k in range(1, order + 1):  # order by order, so that one order's n-grams are on disk at a time
        asked = blocks.select("block", "held", "lead", "own", "words", "tokens").mapInArrow(_ask(k, bits), "slice bigint, block bigint, keys binary, counts binary")
        told = cut(asked.groupBy("slice").applyInArrow(_answer, "block bigint, slice bigint, others binary, n_words bigint, n_tokens bigint"), "lm-answers")
        answers = answers.unionByName(told) if answers else told
        del asked, told
        free_shuffles(spark, last=True)
    sums = answers.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    words, tokens = (sums[0] or 0), (sums[1] or 0)
    out = pa.schema([("row", pa.int64()), ("doc_id", doc_type), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    pieces = blocks.groupBy("block").cogroup(answers.select("block", "slice", "others").groupBy("block")).applyInArrow(
        _score(order, tokens, words, prior, out), f"row bigint, doc_id {id_sql}, held boolean, n_tokens bigint, n_known bigint, base double, score double"
    )
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return whole.select(
        F.col("doc_id").cast(kind).alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )


def digest(docs: DataFrame) -> DataFrame:
    """Scores, learning from documents whose crc32 of the id as text isn't divisible by ten."""
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score(docs, code % 10 == 0)
