"""HTML pages to Markdown: a small helper reads each page once, expressions and groupings do the rest.

``cells`` gives a row for each cell of a table, line of a list and other block of a page, with its texts, links, breaks and
images in order; elements are numbered as they open. Inline text, lists, tables and the page are put together from these
rows by expressions and groupings that all keep to the page's partition. ``nodes`` lists single nodes with the path of
elements around them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = ("script", "style", "template", "noscript", "head")
#: Tags whose start closes an open paragraph, and tags closed by a sibling of their kind.
BREAKS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that make a block of their own, and the kind of a text's row.
UNITS, TEXT = (*HEADINGS, "p", "table", "ul", "ol", "img", "a"), "#text"
_ELEMENT = "struct<at:int,tag:string,marks:array<string>,href:string,link:string>"


PAGES = 50


class _Nodes(HTMLParser):
    """Rows (at, kind, text, path) of one page; the first has neither kind nor path."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.open, self.count, self.rows = url, [], 1, [(0, "", "", [])]

    def _add(self, kind: str, text: str) -> None:
        if kind == "a":
            self.open[-1]["link"] = self._link(self.open[-1])
        self.rows.append((self.count, kind, text, list(self.open)))
        self.count += 1

    def _link(self, a: dict) -> str:
        return a["href"] and urljoin(self.url, a["href"])

    def handle_starttag(self, tag, attrs):
        closes = SIBLINGS.get(tag, set())
        while self.open and (self.open[-1]["tag"] in closes or self.open[-1]["tag"] == "p" and tag in BREAKS_P):
            self.open.pop()
        own = {k: v or "" for k, v in attrs}
        marks = [f".{c}" for c in own.get("class", "").split()] + [f"#{own.get('id')}"] * ("id" in own)
        self.open.append({"at": self.count, "tag": tag, "marks": marks, "href": own.get("href", "") if tag == "a" else None})
        self._add(tag, own.get("alt", "").strip() if tag == "img" else "")
        if tag in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        self._add(TEXT, data)


def _read(pages: DataFrame, rows: Callable[[int, str, str, str], list[tuple]], size: Callable[[tuple], int], batch: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows of pages (page, id, url, html), ``page`` numbering them; batches go out at about 5,000 by ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_size = [], 0
        for found in batches:
            for start in range(0, found.num_rows, PAGES):  # a batch may have 10,000 pages; few of them are Python objects at once
                for page in zip(*(c.to_pylist() for c in found.slice(start, PAGES).columns), strict=True):
                    made = rows(*page)
                    held += made
                    held_size += sum(map(size, made))
                    if held_size > 5_000:
                        yield batch(held)
                        held, held_size = [], 0
        if held:
            yield batch(held)

    return pages.mapInArrow(run, schema)


def _numbered(pages: DataFrame, id_col: str) -> DataFrame:
    return pages.select(F.monotonically_increasing_id().alias("page"), F.col(id_col).cast("string").alias("id"), "url", "html")


def nodes(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page, at, kind, text, path, id, url): the nodes of pages (id, url, html), ``page`` numbering the rows; the first node
    of a page has its id and url. A null page has this node only."""

    def rows(page, key, url, html):
        parser = _Nodes(url or "")
        parser.feed(html or "")
        parser.close()
        return [(page, *row, key if row[0] == 0 else None, url if row[0] == 0 else None) for row in parser.rows]

    schema = f"page bigint, at int, kind string, text string, path array<{_ELEMENT}>, id string, url string"
    return _read(_numbered(pages, id_col), rows, lambda row: 1, _batch, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as Arrow columns; paths go in as flat columns of their elements."""
    page, at, kind, text, path, key, url = zip(*rows)
    flat = [e for p in path for e in p]
    column = lambda name, t: pa.array([e.get(name) for e in flat], t)
    parts = [column("at", pa.int32()), column("tag", pa.string()), column("marks", pa.list_(pa.string())), column("href", pa.string()), column("link", pa.string())]
    elements = pa.StructArray.from_arrays(parts, names=["at", "tag", "marks", "href", "link"])
    offsets = pa.array(list(accumulate(map(len, path), initial=0)), pa.int32())
    paths = pa.ListArray.from_arrays(offsets, elements)
    own = [pa.array(page, pa.int64()), pa.array(at, pa.int32()), pa.array(kind, pa.string()), pa.array(text, pa.string()), paths, pa.array(key, pa.string()), pa.array(url, pa.string())]
    return pa.RecordBatch.from_arrays(own, names=["page", "at", "kind", "text", "path", "id", "url"])


SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


def selects(selector: str) -> Callable[[dict], bool]:
    """Test of an open element for ``tag``, ``.class``, ``#id`` and their compounds; anything else is an error."""
    m = SELECTOR.fullmatch(selector.strip())
    if not m or not m[0]:
        raise ValueError(f"selector not supported: {selector}")
    tag, marks = m[1] and m[1].lower(), set(re.findall(r"[.#][\w-]+", m[2]))
    return lambda e: tag in (None, e["tag"]) and marks.issubset(e["marks"])


class _Cells(_Nodes):
    """Cells of one page: ``cells`` has the body and parts of each (unit, tag, line, cell), ``titles`` the texts of its first title.

    An open element knows what holds below it: whether it is junk, its title and body, its block (the first of UNITS below
    the body) and the places (line, cell, link) in it; under nested rows of a table a node has a place in each."""

    def __init__(self, url: str, junk: list[Callable[[dict], bool]]) -> None:
        super().__init__(url)
        self.junk, self.cells, self.title, self.titles, self.body = junk, {}, None, [], None
        self.top = {"gone": False, "title": None, "body": None, "block": None, "places": []}

    def _add(self, kind: str, text: str) -> None:
        if kind == TEXT:
            e = self.open[-1] if self.open else self.top
            if e["title"] is not None and self.title in (None, e["title"]):
                self.title = e["title"]
                self.titles.append(text)
        else:
            e = self.open[-1]
            self._opened(e, self.open[-2] if len(self.open) > 1 else self.top)
        counts = not e["gone"] and (e["block"] is not None or kind == TEXT)
        if self.body is None and (counts or kind == TEXT and e["title"] is not None):
            self.body = e["body"]
        if counts:
            block = e["block"]
            unit = (block["at"], block["tag"]) if block else (self.count, TEXT)
            for line, cell, link in e["places"] if block else ((None, None, None),):
                self._part(self.cells.setdefault((*unit, line, cell), (e["body"], []))[1], kind, text, link)
        self.count += 1

    def _part(self, parts: list[tuple], kind: str, text: str, link: dict | None) -> None:
        """Texts of a link are one part; elements other than links, breaks and images have none."""
        if link:
            if not parts or parts[-1][0] != link["at"]:
                parts.append((link["at"], "a", [], link["href"], self._link(link)))
            if kind == TEXT:
                parts[-1][2].append(text)
        elif kind in (TEXT, "br", "img"):
            parts.append((self.count, kind, [" " if kind == "br" else text], None, None))

    def _opened(self, e: dict, up: dict) -> None:
        at, tag = e["at"], e["tag"]
        e["gone"] = up["gone"] or tag in HIDDEN or any(test(e) for test in self.junk)
        e["title"] = at if up["title"] is None and tag == "title" else up["title"]
        block, places = up["block"], up["places"]
        e["body"] = up["body"]
        if up["body"] is None and tag == "body":
            e["body"], block, places = at, None, []
        elif block is None and tag in UNITS:
            block, places = e, [(None, None, None)]
        elif block is not None:
            if block["tag"] in ("ul", "ol") and block is up and tag == "li":
                places = [(at, None, None)]
            elif block["tag"] == "table" and tag == "tr":
                places = [p for p in places if p[0] is not None] + [(at, None, None)]
            elif block["tag"] == "table" and tag in ("td", "th"):
                places = [(line, at, None) if line is not None and cell is None else (line, cell, link) for line, cell, link in places]
            elif tag == "a":
                places = [(line, cell, link or e) for line, cell, link in places]
        e["block"], e["places"] = block, places


_PART = "struct<kind:string,texts:array<string>,href:string,link:string>"
_HEAD = "struct<id:string,url:string,titles:array<string>>"


def cells(pages: DataFrame, id_col: str, strip: tuple[str, ...]) -> DataFrame:
    """(page, unit, tag, line, cell, parts, head): cells of pages (id, url, html) in their first body, or in all of a page without one.

    Blocks that are neither list nor table have one row without line and cell. Each page also has a row with its head only.
    Pages are dealt out before they are read, as files may have few row groups."""
    tests = [selects(s) for s in strip]

    def rows(page, key, url, html):
        parser = _Cells(url or "", tests)
        parser.feed(html or "")
        parser.close()
        held = [(page, *at, parts, None) for at, (body, parts) in parser.cells.items() if parser.body in (None, body)]
        return [(page, None, None, None, None, [], {"id": key, "url": url, "titles": parser.titles}), *held]

    schema = f"page bigint, unit int, tag string, line int, cell int, parts array<{_PART}>, head {_HEAD}"
    return _read(_numbered(pages, id_col).repartition("page"), rows, lambda row: 1 + len(row[5]), _cell_batch, schema).repartition("page")


def _cell_batch(rows: list[tuple]) -> pa.RecordBatch:
    page, unit, tag, line, cell, parts, head = zip(*rows)
    flat = [p for own in parts for p in own]
    lists = lambda xs, values: pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, xs), initial=0)), pa.int32()), values)
    texts = [p[2] for p in flat]
    kinds, hrefs, links = (pa.array([p[i] for p in flat], pa.string()) for i in (1, 3, 4))
    part = pa.StructArray.from_arrays([kinds, lists(texts, pa.array([t for own in texts for t in own], pa.string())), hrefs, links], names=["kind", "texts", "href", "link"])
    heads = pa.array(head, pa.struct([("id", pa.string()), ("url", pa.string()), ("titles", pa.list_(pa.string()))]))
    own = [pa.array(page, pa.int64()), pa.array(unit, pa.int32()), pa.array(tag, pa.string()), pa.array(line, pa.int32()), pa.array(cell, pa.int32()), lists(parts, part), heads]
    return pa.RecordBatch.from_arrays(own, names=["page", "unit", "tag", "line", "cell", "parts", "head"])


def _inline(found: DataFrame, alts: list[str], links: list[str]) -> DataFrame:
    """(page, unit, tag, line, cell, head, text, plain): inline text with links to PDF files as Markdown, and of link blocks text alone."""
    own = ["page", "unit", "tag", "line", "cell", "head"]
    read_alone = F.col("tag") == "a"  # the only blocks that are judged by their text alone
    words = lambda x: F.when((x.kind == "a") | read_alone & (x.kind == TEXT), F.array_join(F.filter(F.transform(x.texts, T.strip), lambda t: t != ""), " ")).otherwise("")
    linked = lambda x: F.when(F.lower(x.words).isin(*links), F.lit("")).when(F.contains(F.lower(x.href), F.lit(".pdf")), F.concat(F.lit("["), x.words, F.lit("]("), x.link, F.lit(")"))).otherwise(x.words)
    bare = lambda x: F.when((x.kind == "img") & F.lower(x.texts[0]).isin(*alts), F.lit("")).otherwise(x.texts[0])
    read = found.select(*own, F.transform("parts", lambda x: F.struct(x.kind.alias("kind"), x.texts.alias("texts"), x.href.alias("href"), x.link.alias("link"), words(x).alias("words"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: F.when(x.kind == "a", linked(x)).otherwise(bare(x))), "")
    plain = F.array_join(F.filter(F.transform("parts", lambda x: x.words), lambda t: t != ""), " ")
    lines = F.when(F.contains("text", F.lit("\n")), F.regexp_replace("text", r"[ \t]*\n[ \t]*", " ")).otherwise(F.col("text"))
    runs = F.when(F.contains("text", F.lit("  ")) | F.contains("text", F.lit("\t")), F.regexp_replace("text", r"[ \t]{2,}", " ")).otherwise(F.col("text"))
    folded = read.select(*own, joined.alias("text"), F.when(read_alone, plain).alias("plain")).withColumn("text", lines).withColumn("text", runs)
    return folded.withColumn("text", T.strip(F.col("text")))


def _blocks(found: DataFrame, links: list[str], junk: list[str]) -> DataFrame:
    """(page, unit, tag, text, head): the Markdown of each block."""
    row = F.array_sort(F.collect_list(F.struct("cell", "text")))
    by_line = found.groupBy("page", "unit", "tag", "line").agg(row.alias("cells"), *(F.first(c).alias(c) for c in ("text", "plain", "head")))
    lines = F.array_sort(F.collect_list(F.struct("line", "cells", "text")))
    units = by_line.groupBy("page", "unit", "tag").agg(lines.alias("all"), *(F.first(c).alias(c) for c in ("text", "plain", "head")))
    rows = F.filter(F.transform(F.filter("all", lambda x: x.line.isNotNull()), lambda x: F.transform(F.filter(x.cells, lambda c: c.cell.isNotNull()), lambda c: c.text)), lambda r: F.size(r) > 0)
    items = F.transform(F.filter("all", lambda x: x.line.isNotNull()), lambda x: x.text)
    units = units.withColumns({"rows": rows, "items": items}).withColumn("width", F.array_max(F.transform("rows", F.size)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), F.col("width") - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    whole = F.array_join(F.concat(F.array(line(F.get("rows", 0)), rule), F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), line)), "\n")
    listed = F.transform("items", lambda t, i: F.when(t != "", F.concat(F.when(F.col("tag") == "ol", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.lit("- ")), t)))
    text = (
        F.when(F.col("tag").isin(*HEADINGS), F.when((F.col("text") != "") & ~F.lower("text").isin(*junk), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "), "text")))
        .when(F.col("tag") == "table", F.when(F.size("rows") > 0, whole))
        .when(F.col("tag").isin("ul", "ol"), F.array_join(F.filter(listed, lambda x: x.isNotNull()), "\n"))
        .when((F.col("tag") == "a") & F.lower("plain").isin(*links), None)
        .otherwise(F.col("text"))
    )
    return units.select("page", "unit", "tag", text.alias("text"), "head")


def to_markdown(pages: DataFrame, id_col: str = "page_id", strip: tuple[str, ...] = ("nav", "footer"), drop_alt: tuple[str, ...] = ("image",), drop_link: tuple[str, ...] = ("read more",)) -> DataFrame:
    """(id, url, title, markdown, headings, tables) of pages (id, url, html). A null page is an empty one.

    Junk goes: elements under ``strip`` selectors, images and links of these texts, blocks that consist of such a text."""
    alts, links = ([x.strip().lower() for x in xs] for xs in (drop_alt, drop_link))
    junk = [*alts, *links, ""]
    blocks = _blocks(_inline(cells(pages, id_col, strip), [*alts, ""], [*links, ""]), links or [""], junk)
    bare = F.lower(T.strip(F.col("text")))
    kept = F.when(~bare.isin(*junk), F.struct("unit", "text"))
    whole = blocks.groupBy("page").agg(
        F.first("head", ignorenulls=True).alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x.text), "\n\n").alias("markdown"),
        F.count_if(F.col("tag").isin(*HEADINGS) & F.col("text").isNotNull()).cast("int").alias("headings"),
        F.count_if(F.col("tag") == "table").cast("int").alias("tables"),
    )
    title = F.nullif(F.array_join(F.transform("head.titles", T.strip), ""), F.lit(""))
    return whole.select(F.col("head.id").cast(pages.schema[id_col].dataType).alias(id_col), "head.url", title.alias("title"), "markdown", "headings", "tables")


def navigation_links(pages: DataFrame) -> DataFrame:
    """Distinct (url): absolute addresses of .html and .php links under the first header, else nav, of pages (url, html)."""
    found = nodes(pages.select(F.lit(0).alias("page_id"), "url", "html")).repartition("page")
    first = lambda tag: F.min(F.when(F.col("kind") == tag, F.col("at"))).over(Window.partitionBy("page"))
    links = found.withColumn("place", F.coalesce(first("header"), first("nav"))).where((F.col("kind") == "a") & F.exists("path", lambda x: x.at == F.col("place")))
    own = links.select(F.get("path", F.size("path") - 1).alias("a")).where(F.col("a.href").rlike(r"\.(?:html|php)(?:[?#]|$)"))
    return own.select(F.regexp_replace("a.link", "#.*$", "").alias("url")).distinct()


def apply_diff(text: str, diff: str) -> str:
    """A unified diff applied to a text; a context line that differs or hunks out of order are errors."""
    lines, out, at, hunk = text.split("\n"), [], 0, False
    for line in diff.splitlines():
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", line)
        if m:
            start = int(m[1]) - (m[2] != "0")
            if start < at:
                raise ValueError("hunks overlap")
            out += lines[at:start]
            at, hunk = start, True
        elif hunk and line[:1] in (" ", "-", ""):
            if at >= len(lines) or lines[at] != line[1:]:
                raise ValueError(f"line {at + 1} differs from the patch")
            out += [lines[at]] if line[:1] != "-" else []
            at += 1
        elif hunk and line[:1] == "+":
            out.append(line[1:])
        elif hunk and line[:1] != "\\":
            raise ValueError(f"not a unified diff line: {line}")
    return "\n".join(out + lines[at:])


def patch(docs: DataFrame, patches: DataFrame, key: str = "sha256", body: str = "markdown") -> DataFrame:
    """``docs`` with the diff of their key in ``patches`` (key, diff) applied, where there is one."""
    joined = docs.join(patches.select(key, "diff"), key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[body] = [apply_diff(t, d) if isinstance(d, str) else t for t, d in zip(batch[body], batch["diff"], strict=True)]
            yield batch.drop(columns="diff")

    return joined.mapInPandas(run, docs.select(key, *(c for c in docs.columns if c != key)).schema)


def try_patch(docs: DataFrame, patches: DataFrame, key: str = "sha256", body: str = "markdown") -> DataFrame:
    """``docs`` with ``patched`` and ``patch_error``: a diff that doesn't apply leaves the text and tells why."""

    def apply(texts: pd.Series, diffs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, diff in zip(texts, diffs):
            try:
                rows.append((apply_diff(text, diff), True, None) if isinstance(diff, str) else (text, False, None))
            except ValueError as e:
                rows.append((text, False, str(e)))
        return pd.DataFrame(rows, columns=["text", "patched", "error"])

    one = patches.groupBy(key).agg(F.first("diff").alias("_diff"))
    tried = docs.join(one, key, "left").withColumn("_p", F.pandas_udf(apply, "text string, patched boolean, error string")(F.col(body), F.col("_diff")))
    return tried.select(*(c for c in docs.columns if c != body), F.col("_p.text").alias(body), F.col("_p.patched").alias("patched"), F.col("_p.error").alias("patch_error"))
