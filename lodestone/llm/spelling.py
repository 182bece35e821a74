"""Spelling variants: words one edit apart, the commoner form of each, and the root its forms lead to.

Near words (one inserted, deleted or replaced code point) are found with a positional
q-gram index. For pairs whose longer word has m code points, the place of the edit lies in
one half of it, so the two words share the other half: each word is dealt to the shards of
its two halves, as a longer word (m: its length) and as a shorter one (m: one more). The
shards halve again where more than ``limit`` words meet, down to one code point, at which
all words of a shard are near; so no shard grows with the vocabulary, and each pair meets
in one shard, that of the interval with the pair's first difference.

A shard has postings of the padded bigrams that touch its interval, by place. A word's
postings are merged by a heap: words of its own length at the same place, words one shorter
at the same place or one before. An interval of f code points touches f + 1 bigrams, of
which one edit spoils two; words met under f - 1 bigrams at least are verified.

Counts of near words and the best of them leave a shard by word, never as pairs. A word's
form has at least twice its count, so forms lead upwards in at most log2(largest count)
steps; roots are found by doubling pointers, words that many point to going through
``join_groups``.

Defined cases: null and empty texts have no words; a null id is the empty text; repeated
rows count again; words of any length are compared whole; of near words with equal counts
the first in code-point order is the form; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop_cut, join_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Code points of a text looked at together, words held by a counting task.
PIECE, HELD = 1 << 20, 200_000


def runs_of(text: str) -> Counter[str]:
    """Lower-cased (A-Z) runs of letters with their numbers; a long text is cut between runs."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and RUN.match(text, end - 1) and RUN.match(text, end):
            end += 1
        found.update(RUN.findall(text[at:end].translate(_LOWER)))
        at = end
    return found


def slipped(doc_id: str, run: str, every: int, crc: int | None = None) -> str:
    """The run as the document spells it: one in ``every`` loses a code point, by crc32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()) if crc is None else crc)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points and ``min_count`` occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py() or ""
                crc = zlib.crc32(f"{doc_id}:".encode())
                for word, n in runs_of(text.as_py() or "").items():
                    if zlib.crc32(word.encode(), crc) % every == 0:
                        word = slipped(doc_id, word, every, crc)
                    if len(word) >= min_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield emit()
                    held.clear()
        yield emit()

    counted = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, lo, hi) with ``key``, their shard: words that agree before lo and from hi on, counted in the longer one."""
    before, after = F.expr("substring(word, 1, lo)"), F.expr("substring(word, char_length(word) - (m - hi) + 1, m - hi)")
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", before, after))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.expr("(lo + hi) div 2").cast("int")
    halves = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    return rows.select("word", "n", "m", F.inline(F.filter(halves, lambda x: x.hi > x.lo)).alias("lo", "hi"))


def shards(words: DataFrame, limit: int = 256) -> DataFrame:
    """(word, n, m, lo, hi, key): every word in the shards it may meet a near word in; over ``limit`` rows share a key only
    where the interval can't be halved, and then at most as many as there are letters."""
    longest = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("m")
    whole = words.select("word", "n", longest).withColumn("lo", F.lit(0)).withColumn("hi", F.col("m"))
    rows, found = cut(_dealt(_halved(whole)), "shards"), []
    while True:
        large = rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > limit)
        large = cut(large.withColumn("large", F.lit(True)), "large")
        if large.isEmpty():
            break
        told = cut(join_groups(rows, large, ["key"], F.xxhash64("word")), "told")
        found.append(told.where("large IS NULL").drop("large"))
        rows = cut(_dealt(_halved(told.where("large"))), "shards")
    for more in found:
        rows = rows.unionByName(more)
    return rows


def near(long: str, other: str, lo: int, hi: int) -> bool:
    """Whether one edit makes ``long`` of ``other``, of its length or one shorter, with the first difference in [lo, hi)."""
    if long[:lo] != other[:lo]:
        return False
    at, end = lo, min(hi, len(other))
    while at < end and long[at] == other[at]:
        at += 1
    return at < hi and long[at + 1 :] == (other[at:] if len(other) < len(long) else other[at + 1 :])


def match(words: list[tuple[str, int]], m: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``words`` (those of m - 1 code points first) that are near within [lo, hi)."""
    bound = hi - lo - 1
    postings: dict[tuple[int, str], list[int]] = {}
    for i, (word, _) in enumerate(words):
        padded = f"\0{word}\0"
        if len(word) < m:
            for p in range(lo, hi):
                gram = padded[p : p + 2]
                postings.setdefault((p, gram), []).append(i)
                postings.setdefault((p + 1, gram), []).append(i)
            continue
        grams = [(p, padded[p : p + 2]) for p in range(lo, hi + 1)]
        if bound > 0:
            lists = [postings[g] for g in grams if g in postings]
            met = (j for j, same in groupby(heapq.merge(*lists)) if bound == 1 or len(list(same)) >= bound) if len(lists) >= bound else ()
        else:
            met = range(i)
        for j in met:
            if near(word, words[j][0], lo, hi):
                yield i, j
        for g in grams:
            postings.setdefault(g, []).append(i)


def _near_in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: each word's near words in the shard, counted, with the best of them."""

    def settle(shard: list[tuple], out: list[tuple]) -> None:
        m, lo, hi = shard[0][3:]
        words = sorted(((w, n) for _, w, n, *_ in shard), key=lambda x: len(x[0]))
        counts, best = [0] * len(words), [(0, "")] * len(words)
        for i, j in match(words, m, lo, hi):
            for a, b in ((i, j), (j, i)):
                counts[a] += 1
                word, n = words[b]
                if n > best[a][0] or n == best[a][0] and word < best[a][1]:
                    best[a] = n, word
        out.extend((words[i][0], counts[i], *best[i]) for i in range(len(words)) if counts[i])

    held: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                if len(held) > 1:
                    settle(held, out)
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["word", "n_near", "best_n", "best"])
    out = []
    if len(held) > 1:
        settle(held, out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, limit: int = 256) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words; ``best`` is the one with the largest n."""
    dealt = shards(words, limit).select("key", "word", "n", "m", "lo", "hi").repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_near_in_shards, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), "b.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, to): where the links (word, to) of a forest lead in the end, by doubling pointers."""
    now = cut(links.select("word", "to"), "links")
    while True:
        onward = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        groups = cut(now.groupBy("to").agg(F.count("*").alias("n_rows")).join(onward, "to"), "onward")
        if groups.isEmpty():
            return now
        after = cut(join_groups(now, groups, ["to"], F.xxhash64("word")).select("word", F.coalesce("next", "to").alias("to")), "links")
        drop_cut(now)
        now = after


def variants(words: DataFrame, ratio: int = 2, limit: int = 256) -> DataFrame:
    """Every word of (word, n) with form, root, n, n_near and form_n; the form is the near word of largest n, if that is at
    least ``ratio`` times the word's."""
    words = cut(words.select("word", "n"), "words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near_words(words, limit), "word", "left")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    found = cut(found, "forms")
    ends = roots(found.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(count_words(docs))
