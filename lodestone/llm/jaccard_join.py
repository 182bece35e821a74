"""Exact Jaccard join of documents on word shingles, by universe partition and the pigeonhole principle.

Tokens are 64-bit hashes of shingles. Sets of a and b tokens with Jaccard of at
least t differ in at most d = (a + b)(1 - t)/(1 + t) tokens. Sets are grouped by
size band; within a band, hashes are partitioned into m segments, so sets that
differ in d tokens agree

* wholly on one segment of any d + 1, or
* up to one token on one segment of any (d + 1)/2.

Each band's allocation says how many segments are indexed by one-deletion
neighbourhoods (the segment, and it less each of its tokens; counts 2 towards
d + 1) and how many as they are (counts 1), at least estimated cost: rows written
against false candidates expected, both by segment size alone. A set indexes the first
segments that its own size needs and that aren't nearly empty, in its band and in
the next one where it may have a larger partner.

Documents with the same set form a class, joined as one. In each bucket (documents
with an equal signature) the classes are first compared with two leaders only, so
that a bucket costs as many pairs as it has rows. Components are formed from the
links found; then, in buckets where several components meet, pairs of classes from
different components are compared too. Before texts are fetched, a parity sketch
(1,024 bits, and some bits a token for larger sets; its Hamming distance never
exceeds the number of differing tokens) drops pairs that can't link. Every pair left is verified on its whole sets.
Thus no link between components is lost, and pairs inside a component aren't listed.
Where links are to be counted, the classes of a component are compared block by block on
their whole sets, and a class gets the sum of the documents it links with.

Documents of one set are joined to their class by ``join_groups``, and the rows of a
large open bucket are dealt out over several tasks, so no task gets a hot group whole.

Defined cases: null, empty and blank texts have an empty set, linked with nothing;
fewer words than a shingle make one token of all; rows with one id and one text are one
document, and rows with one id and several texts give a row for each different set; a
null id is a document of its own that is linked with nothing unless its text is another's
(give ids first if they matter); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop_cut, free_shuffles, join_groups, mix
from lodestone.llm.components import components

BAND_RATIO = 1.4
#: Sets of n tokens are told apart by the sketch while n is below about twice its bits.
SKETCH_BITS = 1024
#: Rows of an open bucket that one task takes.
BUCKET_ROWS = 1000
#: For link counts: classes of a block, and shingles that are compared at a time.
BLOCK_CLASSES, COLUMNS = 512, 4096
SKETCH = tuple(f"s{i}" for i in range(SKETCH_BITS // 64))
_A = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z lower-cased, words parted by space and U+0009-U+000D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _A + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(out)


@dataclass(frozen=True)
class Band:
    """Sizes low..high; of ``segments``, the first ``deletions`` are indexed with one-deletion neighbourhoods."""

    low: int
    high: int
    segments: int
    deletions: int

    def chosen(self, sizes: np.ndarray, d: int) -> np.ndarray:
        """Segments that a set with segments of these sizes indexes, for at most d differences.

        Segments of under two tokens tell little and are passed over; the set goes on until the others count d + 1.
        Where a segment may differ by one token, its counterpart must not be passed over, so it counts from three
        tokens on. A set that runs out of segments indexes all. Of two sets, take the one that stops first: some
        segment it counts differs in no more than allowed, and the other one, which goes at least as far, has it too."""
        place = np.arange(self.segments)
        counts = np.where(place < self.deletions, 2 * (sizes >= 3), 1 * (sizes >= 2))
        total = np.cumsum(counts)
        if total[-1] <= d:
            return np.ones(self.segments, bool)
        return (place <= np.searchsorted(total, d + 1)) & (sizes >= 2)


@dataclass(frozen=True)
class Plan:
    """Jaccard of at least percent / 100 on shingles of ``size`` words.

    ``collision_weight``: cost of a certain false candidate in rows written, for the allocation. ``spare``: share of
    segments beyond those needed, for sets that pass some over."""

    percent: int
    size: int
    collision_weight: float = 800.0
    spare: float = 0.25

    def partner(self, n: int) -> int:
        """The largest set that may link with one of n tokens."""
        return 100 * n // self.percent

    def differences(self, n: int, other: int) -> int:
        return (n + other) * (100 - self.percent) // (100 + self.percent)

    def most(self, n: int) -> int:
        return self.differences(n, self.partner(n))

    def band(self, k: int) -> Band:
        low = math.ceil(BAND_RATIO**k)
        high = max(low, math.ceil(BAND_RATIO ** (k + 1)) - 1)
        need, n = self.differences(high, high) + 1, (low + high) / 2
        best = (math.inf, need, 0)
        for deletions in range(need // 2 + 1):
            segments = need - deletions
            if deletions > segments:
                break
            s = n / segments
            rows = segments + deletions * s
            false = self.collision_weight * (
                (segments - deletions) * math.exp(-1.4 * s) + deletions * (1 + 2 * s) * math.exp(-1.4 * (s - 1))
            )
            best = min(best, (rows + false, segments, deletions))
        plain = best[1] - best[2]
        return Band(low, high, best[1] + math.ceil(self.spare * plain) * (plain > 0), best[2])

    def bands(self, n: int, cache: dict[int, Band]) -> Iterator[tuple[int, Band]]:
        """The band of size n, and the next one if a partner may lie there."""
        k = int(math.log(n) / math.log(BAND_RATIO))
        while math.ceil(BAND_RATIO**k) > n:
            k -= 1
        while math.ceil(BAND_RATIO ** (k + 1)) <= n:
            k += 1
        for j in (k, k + 1):
            if j not in cache:
                cache[j] = self.band(j)
            if j == k or self.partner(n) >= cache[j].low:
                yield j, cache[j]

    def signatures(self, tokens: np.ndarray, cache: dict[int, Band]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of whole segments, and of segments less one token."""
        whole, less = [], []
        n = len(tokens)
        if n and (d := self.most(n)):
            mixed = mix(tokens ^ _A)
            for k, band in self.bands(n, cache):
                m = band.segments
                part = (tokens % np.uint64(m)).astype(np.int64)
                sums = np.zeros(m, np.uint64)
                np.add.at(sums, part, mixed)
                salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(k * 1_000_003 + 1))
                used = band.chosen(np.bincount(part, minlength=m), d)
                whole.append(mix(sums[used] ^ salt[used]))
                if band.deletions:
                    here = (part < band.deletions) & used[part]
                    p = part[here]
                    less.append(mix((sums[p] - mixed[here]) ^ salt[p]))
        join = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.uint64)
        return join(whole), join(less)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bits: bit i is the number of tokens that hash there, modulo 2."""
    odd = np.bincount(((tokens >> np.uint64(40)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(tokens: np.ndarray) -> bytes | None:
    """Parity bits for a set too large for ``sketch``: two to four bits a token, a power of two in all."""
    if len(tokens) <= SKETCH_BITS:
        return None
    bits = 1 << (2 * len(tokens) - 1).bit_length()
    odd = np.bincount(((tokens >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches; the longer one is folded to the other's length."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


HEAD = ("doc_id", "n", "k1", "k2", *SKETCH)
INDEX = ", ".join(f"{c} bigint" for c in HEAD) + ", wide binary, whole array<bigint>, less array<bigint>"


def _indexer(plan: Plan):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, Band] = {}
        schema = pa.schema(
            [(c, pa.int64()) for c in HEAD]
            + [("wide", pa.binary())]
            + [(c, pa.list_(pa.int64())) for c in ("whole", "less")]
        )
        for batch in batches:
            rows, wide, lists = [], [], ([], [])
            for text in batch.column(1):
                tokens = shingle_set(text.as_py(), plan.size)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                rows.append((len(tokens), *np.frombuffer(digest, np.int64), *sketch(tokens)))
                wide.append(wide_sketch(tokens))
                for out, found in zip(lists, plan.signatures(tokens, cache), strict=True):
                    out.append(found.view(np.int64))
            cols = np.array(rows, np.int64).reshape(len(rows), len(HEAD) - 1).T
            nested = [
                pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
                )
                for x in lists
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols), pa.array(wide, pa.binary()), *nested], schema=schema)

    return index


def _verifier(percent: int, size: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        for batch in batches:
            out = []
            for u, v, tu, tv in zip(*(batch.column(i) for i in range(4)), strict=True):
                sets = []
                for key, text in ((u.as_py(), tu), (v.as_py(), tv)):
                    if key not in last:
                        if len(last) >= 256:
                            last.clear()
                        last[key] = shingle_set(text.as_py(), size)
                    sets.append(last[key])
                both = len(np.intersect1d(*sets, assume_unique=True))
                out.append(100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select(["u", "v"]).filter(pa.array(out, pa.bool_()))

    return verify


def _sift(pairs: DataFrame, wides: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) but those whose wide sketches rule a link out. Both sketches are needed; they are far shorter than texts."""

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                a is None or b is None or sketch_distance(a, b) * (100 + percent) <= (m + n) * (100 - percent)
                for m, a, n, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda key, p: wides.select(F.col("doc_id").alias(key), F.col("n").alias(p + "n"), F.col("wide").alias(p + "w"))
    both = pairs.join(side("u", "a"), "u", "left").join(side("v", "b"), "v", "left")
    return both.select("u", "v", "an", "aw", "bn", "bw").mapInArrow(far, "u bigint, v bigint").distinct()


def _may_link(percent: int, a: str, b: str):
    """Size and sketch leave a link possible. a, b: prefixes of columns n and SKETCH."""
    differ = sum((F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in SKETCH), F.lit(0))
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    near = (100 * F.least(na, nb)) >= (percent * F.greatest(na, nb))
    return near & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def _links(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (u, v) that link, by their whole sets."""
    joined = (
        pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u")
        .join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")
        .select("u", "v", "tu", "tv")
    )
    return joined.mapInArrow(_verifier(percent, size), "u bigint, v bigint")


def _block_counter(percent: int):
    """Rows (component, lo, hi, block, class_id, docs, tokens) sorted by their first three: for each class, the documents of the
    classes that it links with in the other block (or its own, where both are one)."""

    def count(rows: list[dict]) -> pa.RecordBatch | None:
        lo, hi = rows[0]["lo"], rows[0]["hi"]
        a = [r for r in rows if r["block"] == lo]
        b = [r for r in rows if r["block"] == hi]
        if not a or not b:
            return None
        both = a if lo == hi else a + b
        sets = [np.frombuffer(r["tokens"], np.uint64) for r in both]
        sizes = np.array([len(t) for t in sets])
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = seen > 1
        keep = shared[column]
        row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        first_b = 0 if lo == hi else len(a)
        met = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(shared.sum()), COLUMNS):
            part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
            held = np.zeros((len(sets), COLUMNS), np.float32)
            held[row[part], column[part] - at] = 1
            met += held[: len(a)] @ held[first_b:].T
        link = 100 * met >= percent * (sizes[: len(a), None] + sizes[None, first_b:] - met)
        if lo == hi:
            np.fill_diagonal(link, False)
        docs = np.array([r["docs"] for r in both], np.int64)
        found = link @ docs[first_b:]
        if lo != hi:
            found = np.concatenate([found, link.T @ docs[: len(a)]])
        return pa.RecordBatch.from_arrays([pa.array([r["class_id"] for r in both], pa.int64()), pa.array(found, pa.int64())], names=["class_id", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and any(held[0][c] != r[c] for c in ("component", "lo", "hi")):
                    if found := count(held):
                        yield found
                    held = []
                held.append(r)
        if held and (found := count(held)):
            yield found

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], names=["class_id", "tokens"])

    return run


def _count_links(nodes: DataFrame, classes: DataFrame, bodies: DataFrame, percent: int, size: int) -> DataFrame:
    """(class_id, links): for each class with links to other sets, how many documents those have.

    Components are cut into blocks of about ``BLOCK_CLASSES`` by hash; each pair of blocks is a group of its own, compared on
    whole sets in one product of matrices, and leaves sums by class, never pairs."""
    docs = classes.groupBy("class_id").agg(F.count("*").alias("docs"))
    members = nodes.select(F.col("node").alias("class_id"), "component").join(docs, "class_id")
    blocks = members.groupBy("component").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    blocks = cut(blocks.withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK_CLASSES).cast("bigint")), "component-blocks")
    placed = join_groups(members, blocks, ["component"], F.xxhash64("class_id")).where("blocks IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    sets = bodies.join(placed.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(size), "class_id bigint, tokens binary")
    sets = cut(sets.join(placed, "class_id"), "component-sets")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("component", "block", "class_id", "docs", "tokens", other)
    dealt = dealt.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class_id", "docs", "tokens")
    key = ["component", "lo", "hi"]
    counted = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_block_counter(percent), "class_id bigint, links bigint")
    counted = cut(counted.groupBy("class_id").agg(F.sum("links").alias("links")), "link-counts")
    drop_cut(sets)
    return counted


def similarity_classes(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document, and n_links on request.

    class_id: the least document with the same set; component_id: the least one reachable by links; n_links: the number of
    other documents that it links with, equal sets among them."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "text")
    plan = Plan(percent, size)
    index = cut(texts.mapInArrow(_indexer(plan), INDEX), "shingle-index")
    heads = cut(index.drop("wide", "whole", "less").distinct(), "heads")
    wides = cut(index.where("wide IS NOT NULL").select("doc_id", "n", "wide").distinct(), "wide-sketches")
    rows = index.select("doc_id", F.explode("whole").alias("sig"), F.lit(True).alias("full")).unionByName(
        index.select("doc_id", F.explode("less").alias("sig"), F.lit(False).alias("full"))
    )
    # Only signatures of several rows, one of which has them whole, go on; the rest are most of all rows.
    # A count is narrower than two ids; a repeated document passes here and is told apart below.
    shared = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("full").alias("any")).where("rows > 1 AND any")
    hits = cut(rows.join(shared.select("sig"), "sig", "left_semi"), "shared-signatures")
    drop_cut(index)
    free_shuffles(docs.sparkSession)
    # Only sets of several documents need their least document; empty ones have no class.
    key = ["k1", "k2", "n"]
    same = heads.where("n > 0").groupBy(*key).agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("class_id")).where("n_rows > 1")
    joined = join_groups(heads.select("doc_id", *key), cut(same, "same-sets"), key, F.xxhash64("doc_id"))
    class_of = cut(joined.select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")
    copies = class_of.where("class_id != doc_id").select("doc_id", "class_id")
    of_class = (
        hits.join(copies, "doc_id", "left")
        .groupBy("sig", F.coalesce("class_id", "doc_id").alias("doc_id"))
        .agg(F.bool_or("full").alias("full"))
    )
    led = F.when(F.col("full"), F.col("doc_id"))
    leaders = (
        of_class.groupBy("sig")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(led).alias("first"), F.max(led).alias("last"))
        .where("lo != hi AND first IS NOT NULL")
        .select("sig", "first", "last")
    )
    members = cut(of_class.join(leaders, "sig").select("sig", "doc_id", "full", "first", "last"), "buckets")
    drop_cut(hits)
    free_shuffles(docs.sparkSession)

    def head(prefix: str, key: str) -> DataFrame:
        return heads.select(F.col("doc_id").alias(key), *(F.col(c).alias(prefix + c) for c in ("n", *SKETCH)))

    stars = (
        members.select("doc_id", F.explode(F.array("first", "last")).alias("leader"))
        .where("doc_id != leader")
        .select(F.least("doc_id", "leader").alias("u"), F.greatest("doc_id", "leader").alias("v"))
        .distinct()
    )
    stars = stars.join(head("a", "u"), "u").join(head("b", "v"), "v").where(_may_link(percent, "a", "b")).select("u", "v")
    stars = cut(_sift(stars, wides, percent), "star-pairs")
    bodies = cut(texts.join(members.select("doc_id").union(members.select("last")).distinct(), "doc_id", "left_semi"), "bodies")
    free_shuffles(docs.sparkSession)
    found = cut(_links(stars, bodies, percent, size), "star-links")
    drop_cut(stars)
    free_shuffles(docs.sparkSession)

    # Where components still meet in a bucket, compare their classes across.
    joined = components(found)
    labelled = members.select("sig", "doc_id", "full").join(
        joined.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).withColumn("component", F.coalesce("component", "doc_id"))
    mixed = labelled.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).where("lo != hi")
    labelled = cut(labelled.join(mixed.select("sig", "rows"), "sig").join(heads, "doc_id"), "open-buckets")
    # A large bucket is dealt out: each of its parts on one side meets the whole bucket on the other, in a task of its own.
    parts = F.ceil(F.col("rows") / BUCKET_ROWS)
    side = lambda p, deal: labelled.select("sig", deal.alias("deal"), *(F.col(c).alias(p + c) for c in labelled.columns if c != "sig"))
    own, every = F.pmod(F.xxhash64("doc_id"), parts), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    rest = side("a", own).join(side("b", every), ["sig", "deal"]).where(
        (F.col("acomponent") < F.col("bcomponent")) & (F.col("afull") | F.col("bfull")) & _may_link(percent, "a", "b")
    )
    rest = cut(rest.select(F.col("adoc_id").alias("u"), F.col("bdoc_id").alias("v")).distinct(), "rest-pairs")
    rest = cut(_sift(rest, wides, percent), "sifted-pairs")
    more = cut(_links(rest, bodies, percent, size), "rest-links")
    for used in (labelled, rest, members):
        drop_cut(used)
    final = components(found.unionByName(more)) if more.limit(1).count() else joined
    told = class_of.join(final, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    if not links:
        drop_cut(bodies)
        return told
    free_shuffles(docs.sparkSession)
    across = _count_links(cut(final, "nodes"), class_of, bodies, percent, size)
    drop_cut(bodies)
    # Classes of several documents or with links to others; all others have no link. A hot class is joined by broadcast.
    sizes = class_of.where("n > 0").groupBy("class_id").agg(F.count("*").alias("n_rows")).join(across, "class_id", "left")
    sizes = cut(sizes.withColumn("_links", F.col("n_rows") - 1 + F.coalesce("links", F.lit(0))).where("_links > 0").select("class_id", "n_rows", "_links"), "class-links")
    counted = join_groups(told, sizes, ["class_id"], F.xxhash64("doc_id"))
    return counted.withColumn("n_links", F.coalesce("_links", F.lit(0))).drop("_links")


def keep_one_per_group(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id") -> DataFrame:
    """One document of each component, the one of the least id; others go.

    Of rows with one id and one text, one stays. Rows with one id and several texts are one document: it is linked where
    any of them is, and goes or stays whole. A null id stays."""
    known = docs.where(F.col(id_col).isNotNull())
    gone = similarity_classes(known, percent, size, id_col).where("doc_id != component_id").select("doc_id").distinct()
    left = docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")
    # Ids alone are shuffled to find repeated ones; texts are only where there are any.
    again = cut(known.select(F.col(id_col).alias("id")).groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return left
    repeated = left.join(again, left[id_col] == again["id"], "left_semi").dropDuplicates([id_col, "text"])
    return left.join(again, left[id_col] == again["id"], "left_anti").unionByName(repeated)
