"""Removal of repeated runs of lines, by winnowing over line hashes.

A run is a sequence of lines with words (blank lines in between do not count) of
at least ``min_words`` words in all. A run that occurred earlier, in the order of
(doc_id, text hash, line), is deleted; the first occurrence stays whole.

* Windows: from every line, the fewest following lines that reach ``min_words``
  words, and backwards likewise. Every repeated run holds whole windows, and its
  forward and backward windows together cover it.
* Winnowing: each window selects its least line hash (the rightmost on ties). A
  selected line is a fingerprint, once for all windows that select it; it carries
  the hashes of the lines that these windows hold, its context. Equal windows
  select equal hashes, so a repeated run is sure to share a fingerprint.
* Positions: fingerprints are grouped by hash, and each position of a repeated one
  is joined to the first position. From there the match is extended line by line
  both ways over the two contexts. Windows inside the matched run are repeats, and
  the stretch that they cover is deleted.
* A window that the first position doesn't match may still have an earlier equal
  elsewhere, with the same common line in it. These windows, and no others, are
  grouped by their content and joined to its first position.

No pair of positions is formed: each group yields its first position alone, and
joins have that unique row on one side. Groups that hold a large share of all rows
are joined by broadcast (``join_groups``), so a line in a third of all documents
lands in no single task. Contents are compared by 96 bits of hash for each line.

Defined cases: null and empty texts stay as they are; identical rows count as one
document and all get its result; rows that share a doc_id but not the text are
different documents; within one document an overlapping repeat (a period) deletes
only windows that start after the first one's end; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import cut, join_groups

KEY = ("_doc", "_key")


def _documents(docs: DataFrame, id_col: str) -> DataFrame:
    """(_doc, _key, _lines): each distinct document's lines with words: number, two hashes, words."""
    line = lambda t, i: F.struct(
        i.alias("line"), F.xxhash64(t).alias("h"), F.hash(t).alias("h2"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint").alias("n")
    )
    lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x["n"] > 0)
    keyed = docs.where(F.col("text").isNotNull()).select(F.col(id_col).alias("_doc"), F.xxhash64("text").alias("_key"), lines.alias("_lines"))
    # Copies of a row meet before the shuffle, not after it.
    return keyed.groupBy(*KEY).agg(F.first("_lines").alias("_lines"))


def fingerprints(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id") -> DataFrame:
    """(_doc, _key, kind, h, m, a, windows, held, lines): every selected line, once for all windows of a kind that select it.

    Lines are counted from 0 among those with words: ``m`` is the selected one, ``a`` the first of the context, ``held``
    and ``lines`` the context's hashes and line numbers, ``windows`` the first and last line of each window."""
    known = _documents(docs, id_col)
    doc = Window.partitionBy(*KEY)
    at = known.select(*KEY, F.posexplode("_lines").alias("i", "l")).select(*KEY, "i", "l.h", "l.n")
    at = at.withColumn("end", F.sum("n").over(doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("n"))
    ahead = doc.orderBy("begin").rangeBetween(0, min_words - 1)
    back = doc.orderBy("end").rangeBetween(-(min_words - 1), 0)

    def window(kind, over, reaches):
        return F.struct(
            F.lit(kind).alias("kind"),
            F.min("i").over(over).alias("f"),
            F.max("i").over(over).alias("l"),
            F.min(F.struct("h", (-F.col("i")).alias("neg"))).over(over).alias("mark"),
            reaches.alias("whole"),
        )

    forward = window(0, ahead, F.max("end").over(ahead) - F.col("begin") >= min_words)
    backward = window(1, back, F.col("end") - F.min("begin").over(back) >= min_words)
    both = at.select(*KEY, forward.alias("f"), backward.alias("b")).select(
        *KEY, F.explode(F.filter(F.array("f", "b"), lambda w: w.whole & ((w.kind == 0) | (w.f != w.l)))).alias("w")
    )
    marks = both.groupBy(*KEY, "w.kind", (-F.col("w.mark.neg")).alias("m")).agg(
        F.min("w.mark.h").alias("h"), F.min("w.f").alias("a"), F.max("w.l").alias("z"), F.collect_list(F.struct("w.f", "w.l")).alias("windows")
    )
    context = F.expr("slice(_lines, a + 1, z - a + 1)")
    joined = marks.join(known.select(F.col("_doc").alias("_d"), F.col("_key").alias("_k"), "_lines"), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    return joined.select(
        *KEY, "kind", "h", "m", "a", "windows", F.transform(context, lambda x: F.struct(x["h"], x["h2"])).alias("held"), F.transform(context, lambda x: x["line"]).alias("lines")
    )


def _equal(a: str, b: str, n: str) -> str:
    """How many elements of two arrays agree from their start on, of ``n`` that both have."""
    unlike = f"array_position(zip_with(slice({a}, 1, {n}), slice({b}, 1, {n}), (x, y) -> x != y), true)"
    return f"CASE WHEN {unlike} = 0 THEN {n} ELSE cast({unlike} - 1 AS int) END"


def _extend(pairs: DataFrame) -> DataFrame:
    """``low`` and ``high``: the maximal run around a position that agrees with the run around the first one."""
    cut_at = lambda held, m, a: (f"slice({held}, {m} - {a} + 1, size({held}))", f"reverse(slice({held}, 1, {m} - {a} + 1))")
    (on, to), (first_on, first_to) = cut_at("held", "m", "a"), cut_at("first_held", "first_m", "first_a")
    ready = pairs.selectExpr("*", f"{on} AS _on", f"{to} AS _to", f"{first_on} AS _first_on", f"{first_to} AS _first_to")
    high = "m + " + f"({_equal('_on', '_first_on', 'least(size(_on), size(_first_on))')}) - 1"
    low = "m - " + f"({_equal('_to', '_first_to', 'least(size(_to), size(_first_to))')}) + 1"
    return ready.selectExpr("*", f"{low} AS low", f"{high} AS high").drop("_on", "_to", "_first_on", "_first_to")


def repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id") -> DataFrame:
    """(_doc, _key, first, last, from_doc): stretches to delete and the document that had their content first."""
    marks = cut(fingerprints(docs, min_words, id_col), "fingerprints")
    shared = marks.groupBy("kind", "h").agg(F.count("*").alias("n_rows"), F.min(F.struct(*KEY, "m")).alias("o")).where("n_rows > 1")
    place = marks.select(*KEY, "kind", "h", "m", F.col("a").alias("first_a"), F.col("held").alias("first_held"))
    here = (place.kind == F.col("s.kind")) & (place.h == F.col("s.h")) & place._doc.eqNullSafe(F.col("s.o._doc"))
    here = here & (place._key == F.col("s.o._key")) & (place.m == F.col("s.o.m"))
    firsts = place.join(shared.alias("s"), here).select(
        "s.kind", "s.h", "n_rows", F.col("_doc").alias("first_doc"), F.col("_key").alias("first_key"), place.m.alias("first_m"), "first_a", "first_held"
    )
    pairs = join_groups(marks, cut(firsts, "first-positions"), ["kind", "h"], F.xxhash64(*KEY, "m")).where("first_m IS NOT NULL")
    same = F.struct(*KEY) == F.struct("first_doc", "first_key")
    inside = "w.f >= low AND w.l <= high"
    settled = (
        _extend(pairs)
        .withColumn("same", same)
        .withColumn("again", F.expr(f"filter(windows, w -> {inside} AND (NOT same OR w.f > w.l - m + first_m))"))
        .select(
            *KEY,
            "kind",
            F.col("first_doc").alias("from_doc"),
            F.expr("get(lines, array_min(transform(again, w -> w.f)) - a)").alias("first"),
            F.expr("get(lines, array_max(transform(again, w -> w.l)) - a)").alias("last"),
            F.expr(
                f"""transform(filter(windows, w -> NOT ({inside})), w -> struct(
                    xxhash64(slice(held, w.f - a + 1, w.l - w.f + 1)) AS c, hash(slice(held, w.f - a + 1, w.l - w.f + 1)) AS c2,
                    lines[w.f - a] AS first, lines[w.l - a] AS last))"""
            ).alias("open"),
        )
    )
    settled = cut(settled.where("first IS NOT NULL OR size(open) > 0"), "extended")
    left = settled.select(*KEY, "kind", F.explode("open").alias("w")).select(*KEY, "kind", "w.*")
    place = F.struct(*KEY, "first", "last")
    origins = cut(left.groupBy("kind", "c", "c2").agg(F.count("*").alias("n_rows"), F.min(place).alias("origin")).where("n_rows > 1"), "origins")
    other = join_groups(left, origins, ["kind", "c", "c2"], F.xxhash64(*KEY, "first")).where("origin IS NOT NULL")
    within = F.struct(*KEY) == F.struct("origin._doc", "origin._key")
    later = F.when(within, F.col("first") > F.col("origin.last")).otherwise(place > F.col("origin"))
    columns = (*KEY, "first", "last", "from_doc")
    return settled.where("first IS NOT NULL").select(*columns).unionByName(other.where(later).withColumn("from_doc", F.col("origin._doc")).select(*columns))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the remaining ``text``, and columns n_lines, n_deleted, source_id (the least document repeated, or null).

    Columns of those three names in ``docs`` are replaced."""
    added = ("n_lines", "n_deleted", "source_id")
    own = [c for c in docs.columns if c not in added]
    gone = (
        repeats(docs, min_words, id_col)
        .select(*KEY, "from_doc", F.explode(F.sequence("first", "last")).alias("line"))
        .groupBy(*KEY)
        .agg(F.collect_set("line").alias("_gone"), F.min("from_doc").alias("_from"))
    )
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.col(id_col).alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_k0")
    )
    joined = keyed.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_k0") == F.col("_key")), "left")
    # The deleted numbers may include blank lines between deleted ones; those go with them.
    kept = F.expr(
        r"""CASE WHEN _gone IS NULL THEN _text ELSE transform(array(split(_text, '\n')), ls ->
            array_join(transform(array_except(sequence(0, size(ls) - 1), _gone), i -> ls[i]), '\n'))[0] END"""
    )
    return joined.select(
        *((kept if c == "text" else F.col("_row")[c]).alias(c) for c in own),
        F.coalesce(F.size(F.split("_text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_deleted"),
        F.col("_from").alias("source_id"),
    )


#: DuckDB SQL for dedup_lines(documents) as op9 returns it; windows are compared by their lines themselves.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
     x AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM d),
     l AS (SELECT doc_id, line, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM x),
     e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS stop FROM l WHERE n > 0),
     b AS (SELECT *, stop - n AS start FROM e),
     w AS (SELECT doc_id, line AS f, max(line) OVER a AS g, 0 AS kind, list(t) OVER a AS c, max(stop) OVER a - start >= 50 AS whole
           FROM b WINDOW a AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
           UNION ALL
           SELECT doc_id, min(line) OVER z AS f, line AS g, 1 AS kind, list(t) OVER z AS c, stop - min(start) OVER z >= 50 AS whole
           FROM b WINDOW z AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
     v AS (SELECT *, min(doc_id) OVER (PARTITION BY kind, c) AS d0 FROM w WHERE whole),
     u AS (SELECT *, min(CASE WHEN doc_id = d0 THEN f END) OVER (PARTITION BY kind, c) AS f0,
                     min(CASE WHEN doc_id = d0 THEN g END) OVER (PARTITION BY kind, c) AS g0 FROM v),
     h AS (SELECT * FROM u WHERE doc_id > d0 OR (doc_id = d0 AND f > g0)),
     k AS (SELECT doc_id, min(d0) AS source_id FROM h GROUP BY doc_id),
     gone AS (SELECT DISTINCT doc_id, unnest(range(f, g + 1)) AS line FROM h),
     kept AS (SELECT x.doc_id, string_agg(x.t, chr(10) ORDER BY x.line) AS text FROM x
              WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.line = x.line) GROUP BY x.doc_id),
     n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_deleted, k.source_id
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
