"""Documents: quality flags, witness check, sections, paragraph deduplication, dispositions, chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators.dialog import containing
from lodestone.operators.similar import similar_pairs  # noqa: F401  one of this module's operators

# ---- flags ----------------------------------------------------------------------------------------------------


def near_empty(pages: DataFrame, least: int = 200, body: str = "body") -> DataFrame:
    """Pages whose trimmed body is shorter than ``least`` characters."""
    return pages.where(F.length(T.strip(F.coalesce(F.col(body), F.lit("")))) < least)


def orphans(pages: DataFrame, navigation: DataFrame, key: str = "url") -> DataFrame:
    """Pages that no navigation row links to."""
    return pages.join(navigation.select(key).distinct(), key, "left_anti")


# ---- witness check --------------------------------------------------------------------------------------------

#: Classes of witness tokens and how each is written in normal form.
WITNESS = (
    (r"\d[\d,]*(?:\.\d+)?", lambda t: F.replace(t, F.lit(","), F.lit(""))),
    (r"(?i)\b(?:nm3/hr|barg|bar|lpm|kw|hp)\b", F.lower),
    (r"(?i)\bISO\s*\d+:\d+", lambda t: F.upper(F.regexp_replace(t, r"\s+", ""))),
    (r"(?i)\bAPI[-\s]?\d+", lambda t: F.upper(F.regexp_replace(t, r"[\s-]", ""))),
    (r"(?i)\b(?:EN|NFPA)\b", F.upper),
)
#: Patterns that converted pages must not hold.
BANNED = {
    "breadcrumb_list": r"(?mi)^\s*(?:\d+\.\s*)?home\s*>",
    "bare_image_node": r"(?mi)^\s*Image\s*$",
    "read_more_stub": r"(?mi)^\s*read\s*more\s*$",
    "teaser_card_link": r"(?i)read\s*more",
    "consecutive_image_placeholders": r"(?:<!-- image -->\s*){2,}",
    "orphan_single_char_line": r"(?m)^[ \t]*[A-Za-z0-9][ \t]*$",
}


def witness_tokens(text: Column, series: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> Column:
    """All witness tokens of a text in normal form, with repeats.

    ``series``: letters of numbered models (AB-12, AB 12/14), ``names``: models named by a word; both are the client's."""
    classes = list(WITNESS)
    if series:
        classes.append((rf"(?i)\b(?:{'|'.join(series)})[-\s]?\d+[\w/]*", lambda t: F.upper(F.regexp_replace(t, r"[\s-]", ""))))
    if names:
        classes.append((rf"(?i)\b(?:{'|'.join(names)})\b", F.upper))
    source = F.coalesce(text, F.lit(""))
    return F.flatten(F.array(*(F.transform(F.regexp_extract_all(source, F.lit(p), F.lit(0)), form) for p, form in classes)))


def missing_tokens(pairs: DataFrame, key: str, witness: str, converted: str, series: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """(key, token, missing): witness tokens that the conversion holds less often, by how many."""

    def count(c: str, n: str) -> DataFrame:
        found = pairs.select(key, F.explode(witness_tokens(F.col(c), series, names)).alias("token"))
        return found.groupBy(key, "token").agg(F.count("*").alias(n))

    both = count(witness, "n1").join(count(converted, "n2"), [key, "token"], "left")
    missing = F.col("n1") - F.coalesce("n2", F.lit(0))
    return both.select(key, "token", missing.alias("missing")).where("missing > 0")


def junk(md: Column) -> Column:
    """Names of banned patterns that a page holds."""
    return F.filter(F.array(*(F.when(md.rlike(p), F.lit(n)) for n, p in BANNED.items())), lambda x: x.isNotNull())


# ---- sections -------------------------------------------------------------------------------------------------

FRONT = ("url", "kind", "sha256", "fetched_at", "title")
PAGE = r"^<!-- page (\d+) -->$"


def render(body: Column, **meta: Column) -> Column:
    """A Markdown file: front matter of JSON scalars, then the body."""
    scalar = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    lines = [F.concat(F.lit(f"{k}: "), scalar(meta[k]) if k in meta else F.lit("null")) for k in FRONT]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


def front_matter(md: Column) -> Column:
    """struct of the five front-matter fields and the body."""
    head = F.regexp_extract(md, r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), F.nullif(F.regexp_extract(head, rf"(?m)^{k}: (.*)$", 1), F.lit("")), F.lit("}")), "$.v")
    return F.struct(*(field(k).alias(k) for k in FRONT), F.regexp_replace(md, r"(?s)\A---\n.*?\n---\n\n?", "").alias("body"))


def sections(docs: DataFrame, id_col: str = "doc_id", body: str = "body") -> DataFrame:
    """(doc, section_id, heading_path, page_start, page_end, locator, text): parts between headings of level 1 to 3.

    An empty preamble is left out, a headed empty section stays. Window functions carry pages and headings along lines:
    a heading of level k stands until one of level k or less comes."""
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\n")).alias("i", "line"))
    level = F.when(F.startswith("line", F.lit("#")), F.length(F.regexp_extract("line", r"^(#{1,3})\s+\S", 1))).otherwise(0)
    run = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"level": level, "page": F.when(F.startswith("line", F.lit("<!-- page ")), F.regexp_extract("line", PAGE, 1).try_cast("int"))})
    at = marked.withColumns({"page_now": F.last("page", True).over(run), "n": F.sum((F.col("level") > 0).cast("int")).over(run)})
    title = T.strip(F.regexp_replace("line", r"^#{1,3}\s+|\s+#*\s*$", ""))
    for k in (1, 2, 3):
        at = at.withColumn(f"h{k}", F.last(F.when((F.col("level") > 0) & (F.col("level") <= k), F.struct(F.when(F.col("level") == k, title).alias("t"))), True).over(run))
    path = F.filter(F.array(*(F.col(f"h{k}.t") for k in (1, 2, 3))), lambda h: h.isNotNull())
    content = F.when((F.col("level") == 0) & F.col("page").isNull(), F.struct("i", "line"))
    grouped = at.groupBy("doc", "n").agg(
        F.max_by(path, "i").alias("heading_path"),
        F.min("page_now").alias("page_start"),
        F.max("page_now").alias("page_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(content)), lambda x: x["line"]), "\n").alias("text"),
    )
    sound = grouped.withColumn("text", T.strip(F.col("text"))).where((F.col("n") > 0) | (F.col("text") != ""))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("n")) - 1
    return sound.select(
        "doc",
        F.concat(F.col("doc").cast("string"), F.lit("::s"), F.lpad(number.cast("string"), 3, "0")).alias("section_id"),
        "heading_path", "page_start", "page_end",
        T.section_locator(F.col("heading_path"), F.col("page_start"), F.col("page_end")).alias("locator"),
        "text", number.alias("position"),
    )


# ---- paragraphs and dispositions ------------------------------------------------------------------------------


def paragraph_owners(paragraphs: DataFrame, least: int = 15) -> DataFrame:
    """(paragraph, owner, docs): prose of ``least`` words or more in two documents at least; PDFs own first, then the least doc.

    ``paragraphs``: (doc, kind, text). Documents are counted, not listed, so a paragraph in every document stays one row."""
    form = paragraphs.select("doc", "kind", T.paragraph_form(F.col("text")).alias("paragraph")).where(T.word_count(F.col("paragraph")) >= least)
    each = form.groupBy("paragraph", "doc").agg(F.min(F.when(F.col("kind") == "pdf", 0).otherwise(1)).alias("rank"))
    owner = F.min(F.struct("rank", "doc"))["doc"]
    return each.groupBy("paragraph").agg(owner.alias("owner"), F.count("*").alias("docs")).where("docs >= 2")


def disposition(words: Column, links: Column, least: int = 40, hub: int = 8) -> Column:
    """reference_only for link hubs, excluded for stubs, else chunk."""
    return F.when((words < least) & (links >= hub), "reference_only").when(words < least, "excluded").otherwise("chunk")


LINK = r"\[([^\]]*)\]\(([^)]*)\)"


def prose_words(body: Column) -> Column:
    """Words with a letter or digit outside links and table lines."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda l: ~l.rlike(r"^\s*\|.*\|\s*$"))
    return F.regexp_count(F.regexp_replace(F.array_join(lines, "\n"), LINK, " "), F.lit(r"(?U)[^\s]*[\p{L}\p{N}][^\s]*"))


def link_ratio(body: Column) -> Column:
    shown = F.array_join(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)), "")
    total = F.length(F.regexp_replace(body, r"(?U)\s+", ""))
    return F.round(F.length(shown) / F.greatest(total, F.lit(1)), 3)


def dispositions(docs: DataFrame, overrides: DataFrame | None = None, body: str = "body") -> DataFrame:
    """Disposition of each document by its prose and links; a row in ``overrides`` (doc_id, disposition) wins."""
    text = F.coalesce(F.col(body), F.lit(""))
    seeded = docs.select("doc_id", prose_words(text).alias("words"), F.regexp_count(text, F.lit(LINK)).alias("links"), link_ratio(text).alias("link_ratio"))
    seeded = seeded.withColumn("disposition", disposition(F.col("words"), F.col("links")))
    if overrides is None:
        return seeded
    chosen = overrides.select("doc_id", F.col("disposition").alias("_chosen"))
    return seeded.join(chosen, "doc_id", "left").withColumn("disposition", F.coalesce("_chosen", "disposition")).drop("_chosen")


# ---- chunks ---------------------------------------------------------------------------------------------------

Counter = Callable[[str], int]


def split_blocks(text: str) -> list[tuple[str, bool]]:
    """(block, is_table): paragraphs parted by blank lines; runs of table lines apart."""
    found: list[tuple[list[str], bool]] = []
    fresh = True
    for line in re.sub(r"(?s)<!--.*?-->", "", text).split("\n"):
        if not line.strip():
            fresh = True
            continue
        is_table = bool(re.match(r"^\s*\|.*\|\s*$", line))
        if fresh or found[-1][1] != is_table:
            found.append(([], is_table))
        found[-1][0].append(line.rstrip())
        fresh = False
    return [("\n".join(lines).strip(), is_table) for lines, is_table in found]


def split_table(block: str, count: Counter, budget: int, limit: int) -> list[str]:
    """Groups of rows within the budget, the header (and its rule) repeated in each."""
    lines = block.split("\n")
    head = 2 if len(lines) > 1 and re.match(r"^\s*\|?[\s:|-]+\|[\s:|-]*$", lines[1]) else 1
    header, groups, rows = lines[:head], [], []
    for row in lines[head:]:
        if count("\n".join([*header, row])) >= limit:
            raise ValueError("a table row exceeds the embedding limit")
        if rows and count("\n".join([*header, *rows, row])) > budget:
            groups.append(rows)
            rows = []
        rows.append(row)
    return ["\n".join([*header, *g]) for g in [*groups, rows] if g or not groups]


def overlap(window: str, count: Counter, tokens: int) -> str:
    """The shortest word suffix of a window with at least ``tokens`` tokens, joined by single spaces; all of it if it has fewer."""
    parts = window.split() if tokens > 0 else []
    low, high = 0, len(parts) - 1
    while low < high:  # counts grow with the suffix
        middle = (low + high + 1) // 2
        low, high = (middle, high) if count(" ".join(parts[middle:])) >= tokens else (low, middle - 1)
    return " ".join(parts[low:])


def split_words(block: str, count: Counter, budget: int) -> list[str]:
    """A paragraph as runs of whole words within the budget, in order; only spaces between the runs are lost."""
    words, found = list(re.finditer(r"\S+", block)), []
    while words:
        low, high = 1, min(len(words), budget)
        while low < high:  # counts grow with the run
            middle = (low + high + 1) // 2
            low, high = (middle, high) if count(block[words[0].start() : words[middle - 1].end()]) <= budget else (low, middle - 1)
        found.append(block[words[0].start() : words[low - 1].end()])
        words = words[low:]
    return found


def pack(text: str, count: Counter, budget: int = 600, shared: int = 60, limit: int = 8192, keep: Callable[[str], bool] = lambda p: True, headings: Sequence[str] = ()) -> list[str]:
    """Chunk contents of one section: blocks packed up to the budget; each chunk begins with the previous window's tail.

    A paragraph that no chunk under the limit can hold is split between words; shorter ones stay whole, over the budget too."""
    units: list[str] = []
    prose: set[str] = set()
    for block, is_table in split_blocks(text):
        if is_table:
            units += [block] if count(block) <= budget else split_table(block, count, budget, limit)
        elif keep(block):
            units.append(block)
            prose.add(block)
    windows: list[list[str]] = []
    for unit in units:
        if windows and count("\n\n".join([*windows[-1], unit])) <= budget:
            windows[-1].append(unit)
        else:
            windows.append([unit])
    found, tail = [], ""
    for window in windows:
        own = "\n\n".join(window)
        under = lambda w: f"{tail}\n\n{w}".strip() if tail else w  # noqa: B023, E731
        long = len(window) == 1 and own in prose and count("\n".join([*headings, under(own)])) >= limit
        for piece in split_words(own, count, budget) if long else [own]:
            found.append(under(piece))
            tail = overlap(piece, count, shared)
    return found


def count_words(text: str) -> int:
    return len(text.split())


CHUNKS = "doc string, chunk_id string, locator string, heading_path array<string>, content string, token_count int"


def chunks(parts: DataFrame, owners: DataFrame | None = None, count: Counter = count_words, budget: int = 600, shared: int = 60, limit: int = 8192) -> DataFrame:
    """Chunks of sections (doc, position, heading_path, locator, text), numbered through each document.

    ``owners`` (paragraph, owner): a paragraph that another document owns is dropped. The fold over a section's blocks
    isn't associative, so it runs in Python section by section; only sections' own lost paragraphs travel along."""
    rows = parts.select(F.col("doc").cast("string").alias("doc"), "position", "heading_path", "locator", "text")
    if owners is None:
        rows = rows.withColumn("lost", F.array().cast("array<string>"))
    else:
        forms = F.array_distinct(F.transform(F.split("text", r"\n\s*\n"), T.paragraph_form))
        held = rows.select("doc", "position", F.explode(forms).alias("paragraph")).join(owners.select("paragraph", F.col("owner").cast("string")), "paragraph")
        lost = held.where("owner != doc").groupBy("doc", "position").agg(F.collect_set("paragraph").alias("lost"))
        rows = rows.join(lost, ["doc", "position"], "left")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                lost = set(r.lost) if r.lost is not None else set()
                keep = lambda p: re.sub(r"\s+", " ", p).strip().lower() not in lost  # noqa: B023, E731
                for i, content in enumerate(pack(r.text or "", count, budget, shared, limit, keep, r.heading_path)):
                    n = count("\n".join([*r.heading_path, content]))
                    if n >= limit:
                        raise ValueError(f"a chunk of {r.doc} has {n} tokens")
                    out.append((r.doc, r.position, i, r.locator, list(r.heading_path), content, n))
            yield pd.DataFrame(out, columns=["doc", "position", "i", "locator", "heading_path", "content", "token_count"])

    schema = "doc string, position int, i int, locator string, heading_path array<string>, content string, token_count int"
    cut = rows.mapInPandas(fold, schema)
    number = F.row_number().over(Window.partitionBy("doc").orderBy("position", "i")) - 1
    chunk_id = F.concat(F.lit("ch."), F.regexp_replace("doc", r"^doc\.", ""), F.lit("."), F.lpad(number.cast("string"), 4, "0"))
    return cut.select("doc", chunk_id.alias("chunk_id"), "locator", "heading_path", "content", "token_count")


def family_refs(families: DataFrame, capabilities: DataFrame, products: DataFrame) -> DataFrame:
    """(doc, heading, family_id): sections that a family, a capability row or a product names as its source; all three unioned."""
    columns = ("family_id", "source_doc_id", "source_locator")
    every = families.select(*columns).unionByName(capabilities.select(*columns)).unionByName(products.select(*columns))
    sound = every.where(" AND ".join(f"coalesce({c}, '') != ''" for c in columns))
    return sound.select(F.col("source_doc_id").alias("doc"), T.heading_form(T.locator_heading(F.col("source_locator"))).alias("heading"), "family_id").distinct()


def tag(found: DataFrame, families: DataFrame, cover: DataFrame) -> DataFrame:
    """Chunks with ``family_ids``: families whose name they hold, or that cite their section; and their commonest division.

    ``cover``: (doc, heading, family_id), see ``family_refs``. Names are met by their first characters (``containing``), not
    compared with every chunk. Ties of divisions go to the first by name."""
    low = found.select("chunk_id", F.lower("content").alias("_low"))
    held = containing(low, "chunk_id", "_low", families.select("name").distinct(), "name")
    named = held.join(families.select("name", "family_id"), "name").select("chunk_id", "family_id")
    at = T.heading_form(F.when(F.size("heading_path") > 0, F.array_join("heading_path", " › ")).otherwise("(preamble)"))
    cited = found.withColumn("_h", at).join(cover.select(F.col("doc").cast("string").alias("doc"), T.heading_form(F.col("heading")).alias("_h"), "family_id"), ["doc", "_h"]).select("chunk_id", "family_id")
    tags = named.unionByName(cited).distinct()
    divisions = tags.join(families.select("family_id", "division"), "family_id").where("division IS NOT NULL").groupBy("chunk_id", "division").count()
    common = divisions.groupBy("chunk_id").agg(F.min(F.struct((-F.col("count")).alias("n"), "division"))["division"].alias("division"))
    lists = tags.groupBy("chunk_id").agg(F.sort_array(F.collect_set("family_id")).alias("family_ids"))
    empty = F.array().cast("array<string>")
    return found.join(lists, "chunk_id", "left").join(common, "chunk_id", "left").withColumn("family_ids", F.coalesce("family_ids", empty))


def release_sections(documents: DataFrame, converted: DataFrame) -> DataFrame:
    """Documents of a release (doc_id, kind, sha256) with the body of their converted file, by its hash; a missing file fails when read."""
    found = documents.join(converted.select("sha256", "body"), "sha256", "left")
    body = F.when(F.col("body").isNull(), F.raise_error(F.concat(F.lit("no converted file: "), "sha256")).cast("string")).otherwise(F.col("body"))
    return found.withColumn("body", body)


def valid_overrides(overrides: DataFrame) -> DataFrame:
    """Hand-kept dispositions; an unknown word fails when read."""
    known = F.col("disposition").isin("chunk", "reference_only", "excluded")
    wrong = F.raise_error(F.concat(F.lit("not a disposition: "), "disposition")).cast("string")
    return overrides.withColumn("disposition", F.when(known, F.col("disposition")).otherwise(wrong))


def chunk_corpus(documents: DataFrame, families: DataFrame, cover: DataFrame, overrides: DataFrame | None = None, count: Counter = count_words, limit: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(chunks, dispositions) of documents (doc_id, kind, body, division): dispositions, sections, corpus-wide paragraph owners
    among what is chunked, chunks, family tags. A chunk without a division of its families has its document's."""
    seeded = dispositions(documents, None if overrides is None else valid_overrides(overrides))
    taken = documents.join(seeded.where("disposition = 'chunk'").select("doc_id"), "doc_id", "left_semi")
    parts = sections(taken)
    blocks = parts.select("doc", F.explode(F.split("text", r"\n\s*\n")).alias("text")).where(~F.col("text").rlike(r"^\s*\|"))
    owners = paragraph_owners(blocks.join(taken.select(F.col("doc_id").alias("doc"), "kind"), "doc"))
    made = tag(chunks(parts, owners, count, limit=limit), families, cover)
    own = taken.select(F.col("doc_id").cast("string").alias("doc"), F.col("division").alias("_own"))
    return made.join(own, "doc", "left").withColumn("division", F.coalesce("division", "_own")).drop("_own"), seeded


def verify(sources: DataFrame, manifest: DataFrame, converted: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(url, kind, ok, missing, junk, note) of every source (url, kind): PDFs against a witness text, pages against banned patterns.

    ``manifest``: (url, sha256); ``converted``: (sha256, body); ``witnesses``: (sha256, witness). A source that isn't in the
    manifest or has no converted file isn't ok."""
    at = sources.select("url", "kind").join(manifest.select("url", F.col("sha256")), "url", "left").join(converted.select("sha256", "body"), "sha256", "left").join(witnesses.select("sha256", "witness"), "sha256", "left")
    note = F.when(F.col("sha256").isNull(), "not in manifest").when(F.col("body").isNull(), "no converted file").when((F.col("kind") == "pdf") & F.col("witness").isNull(), "no witness")
    held = at.withColumn("note", note)
    pdf = held.where("kind = 'pdf' AND note IS NULL")
    lost = missing_tokens(pdf, "url", "witness", "body").groupBy("url").agg(
        F.sort_array(F.collect_list(F.when(F.col("missing") > 1, F.concat("token", F.lit("x"), F.col("missing").cast("string"))).otherwise(F.col("token")))).alias("missing")
    )
    none = F.array().cast("array<string>")
    judged = held.join(lost, "url", "left").withColumns({"missing": F.coalesce("missing", none), "junk": F.when((F.col("kind") != "pdf") & F.col("note").isNull(), junk(F.col("body"))).otherwise(none)})
    return judged.select("url", "kind", (F.col("note").isNull() & (F.size("missing") == 0) & (F.size("junk") == 0)).alias("ok"), "missing", "junk", "note")


def ingest_totals(pages: DataFrame) -> DataFrame:
    """One row of totals of converted pages (headings, tables, markdown)."""
    return pages.agg(F.count("*").alias("pages"), F.sum("headings").alias("headings"), F.sum("tables").alias("tables"), F.sum(F.length("markdown")).alias("characters"))


def page_density(pages: DataFrame, sparse: int = 50) -> DataFrame:
    """(doc_id, pages, characters, sparse, density) of pages (doc_id, page, text): sparse ones have under ``sparse`` characters."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(n).alias("characters"), F.count_if(n < sparse).alias("sparse")).withColumn("density", F.col("characters") / F.col("pages"))


def json_scalar(value) -> str:
    return json.dumps(value, ensure_ascii=False)
