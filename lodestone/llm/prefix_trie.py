"""Trie of conversation prefixes, with totals of every subtree by leaf-peeling message passing.

A conversation is the sequence of its turns; a node of depth d is a distinct sequence of
first d turns, its members are the conversations that start with it. A node goes by its
smallest member and its depth.

Prefixes are told apart by fingerprints: the exclusive or, over the first d turns, of a
128-bit hash of each turn's place and its SHA-256. Rows are dealt by range of
(conversation, turn), so one conversation may span many partitions; what its earlier
partitions add up to is carried on for the two conversations at most that cross a border.
Equal fingerprints are held against the last turn's SHA-256, which by induction compares
the whole sequences; a difference raises.

Along a path the number of members never grows, and where it stays the same the two nodes
have the same members. So a chain (smallest member, number of members) is one vertex of
the peeling, whatever its length. Each vertex holds the number of its children that
haven't reported. Vertices at zero are complete: they send their subtree's totals to their
parent, whose counter falls by the messages received, until only the root is left, which
completes last. The number of rounds is that of branchings on a path, not of turns.
Messages to one parent are summed before they are shuffled; a vertex that completes is
written once. Nodes get their totals from their chain by ``join_groups``.

Only hashes and lengths are shuffled, never texts.

Defined cases: turns are ordered by turn (null first), turns of one number by the SHA-256
of role and text; null role or text is empty; repeated rows are turns of their own; rows
without a conversation id are left out; an empty table gives no nodes; extra columns are
ignored. SHA-256 of a list of ids is sequential, so the ids that end at one node are joined
in blocks of 2 ** ``SPAN_BITS`` consecutive ids and the blocks are streamed through one task in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, join_groups

#: Of the ids that end at a node, those equal but for so many low bits share a block.
SPAN_BITS = 8
#: What a row of turns has: conversation, part and place in the layout, hash of role and text, code points of the text.
TURN = ("conv_id", "part", "place", "sha", "chars")
KEY = ("depth", "f1", "f2")


def _print(role: str, text: str) -> Column:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)


def lay_out(conversations: DataFrame) -> DataFrame:
    """Turns as (conv_id, part, place, sha, chars), written once: places rise with turns, and a part is one task's rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        _print("role", "text").alias("sha"),
        F.char_length(text).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("sha"), F.col("row")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "sha", "chars"), "turns")


def _crossing(turns: DataFrame) -> DataFrame:
    """Conversations at the borders of parts: two for each part at most, so they may be broadcast."""
    ends = turns.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    ids = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id"))
    return ids.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")


def _carried(rows: DataFrame, crossing: DataFrame, totals: dict[str, tuple]) -> DataFrame:
    """(conv_id, part, one column for each total): what earlier parts of a crossing conversation add up to."""
    part = rows.join(F.broadcast(crossing), "conv_id", "left_semi").groupBy("conv_id", "part").agg(*(f(c).alias(n) for n, (f, c) in totals.items()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return part.select("conv_id", "part", *(F.coalesce(f(n).over(before), F.lit(0)).alias(n) for n, (f, _) in totals.items()))


def numbered(rows: DataFrame, crossing: DataFrame, name: str) -> DataFrame:
    """``rows`` with their number in the conversation, from 1."""
    before = _carried(rows, crossing, {"_n": (lambda c: F.sum(c), F.lit(1))})
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("place"))
    found = rows.withColumn("_own", own).join(F.broadcast(before), ["conv_id", "part"], "left")
    return found.withColumn(name, (F.col("_own") + F.coalesce("_n", F.lit(0))).cast("bigint")).drop("_own", "_n")


def share_heads(turns: DataFrame, of: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt to begin like another: (turns, members).

    Conversation c gets the first h turns of conversation c - c % ``of`` (all if fewer, none if there is none), then its own
    turns after its first h; h is the unsigned crc32 of decimal c modulo ``heads``. At most ``of`` conversations ask for the
    head of one, and a head has less than ``heads`` turns."""
    n_heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(of))
    placed = cut(numbered(turns, _crossing(turns), "at").withColumn("h", n_heads), "places")
    members = cut(placed.groupBy("conv_id").agg(F.min("part").alias("part")), "members")
    own = placed.where("at > h").select(*TURN)
    lead = placed.where((F.col("conv_id") == base) & (F.col("at") < heads)).select(F.col("conv_id").alias("base"), "at", "sha", "chars")
    asked = members.withColumn("h", n_heads).where("h > 0").withColumn("base", base)
    copied = asked.join(lead, "base").where("at <= h").select("conv_id", "part", (F.col("at") - heads).alias("place"), "sha", "chars")
    return cut(own.unionByName(copied), "rebuilt"), members.select("conv_id")


def _lanes() -> tuple[Column, Column]:
    return F.xxhash64("sha", "depth"), F.xxhash64("depth", F.lit(7), "sha")


def _nodes(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, prefixes): prefixes has every conversation's prefixes, the root's among them."""
    crossing = cut(_crossing(turns), "crossing")
    deep = cut(numbered(turns, crossing, "depth").withColumns(dict(zip(("l1", "l2"), _lanes()))), "depths")
    sums = {"f1": (F.bit_xor, F.col("l1")), "f2": (F.bit_xor, F.col("l2")), "chars_to": (F.sum, F.col("chars"))}
    before = _carried(deep, crossing, {f"_{n}": x for n, x in sums.items()})
    upto = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    found = deep.withColumns({n: f(c).over(upto) for n, (f, c) in sums.items()}).join(F.broadcast(before), ["conv_id", "part"], "left")
    carried = lambda n: F.coalesce(f"_{n}", F.lit(0))
    full = found.select(
        "conv_id", "depth", F.col("f1").bitwiseXOR(carried("f1")).alias("f1"), F.col("f2").bitwiseXOR(carried("f2")).alias("f2"),
        (F.col("chars_to") + carried("chars_to")).alias("chars_to"), "sha", "chars", "l1", "l2",
    )
    zero = F.lit(0).cast("bigint")
    root = members.select("conv_id", *(zero.alias(c) for c in ("depth", "f1", "f2", "chars_to")), F.lit("").alias("sha"), *(zero.alias(c) for c in ("chars", "l1", "l2")))
    prefixes = cut(full.unionByName(root), "prefixes")
    grouped = prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("sha").alias("sha"), F.max("sha").alias("_sha"),
        *(F.max(c).alias(c) for c in ("chars", "chars_to", "l1", "l2")),
    )
    one = F.when(F.col("sha") == F.col("_sha"), F.col("sha")).otherwise(F.raise_error(F.lit("two prefixes have one fingerprint")))
    return cut(grouped.withColumn("sha", one).drop("_sha"), "nodes"), prefixes


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by node and place to one digest a node; only the running hash is kept."""
    now, state = None, None
    for batch in batches:
        out = []
        *key, ids = (c.to_pylist() for c in batch.columns)
        for *k, _, text in zip(*key, ids, strict=True):
            if k != now:
                if state:
                    out.append((*now, state.hexdigest()))
                now, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*KEY, "ends_sha256"])


def _ends(prefixes: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256): digest of the ids whose last turn the node's is, ascending, joined by commas."""
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("k"))
    block = F.shiftright("conv_id", SPAN_BITS).alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    blocks = last.select("k.*", "conv_id", block).groupBy(*KEY, "block").agg(ids)
    schema = "depth bigint, f1 bigint, f2 bigint, ends_sha256 string"
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(_digest, schema)


def _vertices(nodes: DataFrame) -> DataFrame:
    """Chains: (conv_id, n_convs, top, length, chars_before, chars_to, parent, left); ``left`` counts children yet to report."""
    at = F.struct(*KEY)
    above = F.struct((F.col("depth") - 1).alias("depth"), F.col("f1").bitwiseXOR(F.col("l1")).alias("f1"), F.col("f2").bitwiseXOR(F.col("l2")).alias("f2"))
    chains = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"),
        F.count("*").alias("n_rows"),
        F.min_by(above, "depth").alias("above"),
        F.min_by(F.col("chars_to") - F.col("chars"), "depth").alias("chars_before"),
        F.max_by("chars_to", "depth").alias("chars_to"),
        F.max_by(at, "depth").alias("bottom"),
    )
    chains = cut(chains, "chains")
    # The node above a chain's top is the last one of its own chain, or the two would be one chain.
    children = chains.where("top > 0").groupBy(F.col("above").alias("bottom")).agg(F.count("*").alias("left"))
    counted = cut(chains.join(children, "bottom", "left").withColumn("left", F.coalesce("left", F.lit(0))), "counted")
    parents = counted.where("left > 0").select(F.col("bottom").alias("above"), F.col("left").alias("n_rows"), F.struct("conv_id", "n_convs").alias("parent"))
    found = join_groups(counted.withColumnRenamed("n_rows", "length"), parents, ["above"], F.xxhash64("conv_id", "n_convs"))
    return found.select(F.struct("conv_id", "n_convs").alias("id"), "parent", "top", "length", "chars_before", "chars_to", F.col("left").alias("n_children"), "left")


def peel(vertices: DataFrame) -> DataFrame:
    """(id, parent, ..., n_leaves, saved): subtree totals of every vertex, leaves first.

    Each round writes what is still waiting; complete vertices are read from the round that completed them."""
    weight = F.greatest(F.col("id.n_convs") - 1, F.lit(0)) * (F.col("chars_to") - F.col("chars_before"))
    waiting = cut(vertices.withColumn("n_leaves", (F.col("left") == 0).cast("bigint")).withColumn("saved", weight), "waiting")
    done = []
    while True:
        ready = waiting.where("left = 0")
        done.append(ready)
        rest = waiting.where("left > 0")
        if rest.isEmpty():
            break
        sent = ready.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_n"), F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        grown = {"left": F.col("left") - F.coalesce("_n", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("_saved", F.lit(0))}
        waiting = cut(rest.join(sent, "id", "left").withColumns(grown).drop("_n", "_leaves", "_saved"), "waiting")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.drop("left")


def trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Nodes of the trie of laid-out ``turns`` (``lay_out``): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and the last turn's sha and chars.

    ``members``: all ids, where conversations without turns count too. saved_tokens sums (n_convs - 1) * chars over the subtree."""
    nodes, prefixes = _nodes(turns, turns.select("conv_id").distinct() if members is None else members)
    vertices = _vertices(nodes)
    columns = ("top", "length", "n_children", "chars_before", "n_leaves", "saved", F.col("parent.conv_id").alias("above"))
    chains = cut(peel(vertices).select("id.*", F.col("length").alias("n_rows"), F.struct(*columns).alias("chain")), "peeled")
    found = join_groups(nodes, chains, ["conv_id", "n_convs"], F.xxhash64("f1", "f2")).join(_ends(prefixes), list(KEY), "left")
    # A chain's total is its top's; a node further down leaves out what the nodes above it in the chain add.
    higher = (F.col("n_convs") - 1) * (F.col("chars_to") - F.col("chars") - F.col("chain.chars_before"))
    is_bottom = F.col("depth") == F.col("chain.top") + F.col("chain.length") - 1
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("chain.top"), F.col("chain.above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(is_bottom, F.col("chain.n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("chain.n_leaves").alias("n_leaves"),
        (F.col("chain.saved") - higher).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "sha",
        "chars",
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are, with role and text of each node's last turn (null for the root)."""
    turns = lay_out(conversations)
    texts = conversations.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    texts = texts.groupBy(_print("role", "text").alias("sha")).agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("n_rows"))
    return join_groups(trie(turns), texts, ["sha"], F.xxhash64("conv_id", "depth")).drop("sha")


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt by ``share_heads``."""
    return trie(*share_heads(lay_out(conversations))).drop("sha", "chars")


#: Prefixes as whole strings, subtrees by joining every node with the prefixes of its smallest member.
ORACLE_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS at FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u // 2, (u % 2) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, t.at AS o, r, x FROM c JOIN t ON t.conv_id = c.base AND t.at <= c.h
      UNION ALL SELECT t.conv_id, t.at + 10, r, x FROM t JOIN c USING (conv_id) WHERE t.at > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS depth, r, x FROM b),
p AS (SELECT conv_id, depth, length(x) AS chars, sha256(string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY ALL),
u AS (SELECT n.depth, n.k, above.conv_id AS parent_conv_id FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN n AS above ON above.depth = p.depth AND above.k = p.k),
f AS (SELECT p.depth, p.k, count(*) AS n_children FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 GROUP BY ALL),
g AS (SELECT p.depth, p.k, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (WHERE f.k IS NULL) AS n_leaves
      FROM n LEFT JOIN f ON f.depth = n.depth AND f.k = n.k JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL),
e AS (SELECT depth, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(depth) AS depth, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY ALL)
SELECT n.conv_id, n.depth, parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, g.n_leaves, g.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n LEFT JOIN u ON u.depth = n.depth AND u.k = n.k LEFT JOIN f ON f.depth = n.depth AND f.k = n.k LEFT JOIN g ON g.depth = n.depth AND g.k = n.k LEFT JOIN e ON e.depth = n.depth AND e.k = n.k
"""
