"""Ingestion of a list of sources: fetch, skip what is known, convert, tidy, patch, store, and flag what a human should see.

Sources are rows, and each step takes all of them: bytes that are already stored, or that an earlier source of the list
brought, are skipped by a keyed join on their digest. Fetching, rendering and reading of scanned pages are functions; what
they give is settled, so a lost executor doesn't fetch again. A source that can't be fetched, or whose patch doesn't apply,
is an error row and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import documents, html
from lodestone.operators.turns import settled
from lodestone.sources import readers, sinks

SPARSE = 50


def fetch(sources: DataFrame, get: Callable[[str], tuple[bytes, str]]) -> DataFrame:
    """(position, url, kind, ok, content, sha256, error) of sources (position, url): ``get`` gives bytes and a content type.

    A content type that names PDF outweighs the address. Whatever ``get`` raises is the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for position, url in zip(batch["position"], batch["url"]):
                try:
                    content, kind = get(url)
                    rows.append((position, url, content, kind or "", None))
                except Exception as e:  # noqa: BLE001  any failure is that row's
                    rows.append((position, url, None, "", str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["position", "url", "content", "type", "error"])

    got = sources.select(F.col("position").cast("int"), "url").mapInPandas(run, "position int, url string, content binary, type string, error string")
    kind = F.when(F.contains(F.lower("type"), F.lit("pdf")), "pdf").otherwise(T.url_kind(F.col("url")))
    digest = F.when(F.col("content").isNotNull(), F.sha2("content", 256))
    return got.select("position", "url", kind.alias("kind"), F.col("error").isNull().alias("ok"), "content", digest.alias("sha256"), "error")


def render_pdfs(files: DataFrame, render: Callable[[bytes], list[str]], read_scan: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """(sha256, body, page_count, pages_ocred, low_density, tables) of files (sha256, content): pages whose text is sparse are read
    as scans, if there is a reader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sha, content in zip(batch["sha256"], batch["content"]):
                texts = render(bytes(content))
                scans = [read_scan(bytes(content), i) if read_scan and len(t.strip()) < SPARSE else None for i, t in enumerate(texts, 1)]
                yield pd.DataFrame({"doc_id": sha, "page": range(1, len(texts) + 1), "text": texts, "ocr": scans})

    pages = settled(files.select("sha256", "content").mapInPandas(run, "doc_id string, page int, text string, ocr string"))
    sparse = F.length(F.trim(F.coalesce("text", F.lit("")))) < SPARSE
    told = pages.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("page_count"), F.sort_array(F.collect_list(F.when(F.col("ocr").isNotNull(), F.col("page")))).alias("pages_ocred"), F.sort_array(F.collect_list(F.when(sparse, F.col("page")))).alias("low_density")
    )
    bodies = readers.pdf_pages(pages, SPARSE).withColumn("tables", F.regexp_count("body", F.lit(r"(?m)^\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*\|?[ \t]*$")))
    return bodies.join(told, "doc_id").withColumnRenamed("doc_id", "sha256")


@dataclass
class Ingest:
    """What a run leaves: new documents, sources skipped as known, errors, an entry for every fetched source, and what to review."""

    written: DataFrame
    skipped: DataFrame
    errors: DataFrame
    manifest: DataFrame
    candidates: DataFrame


def run(sources: DataFrame, get: Callable[[str], tuple[bytes, str]], stored: DataFrame, start_url: str | None = None, fetched_at: str = "", **more) -> Ingest:
    """Fetch sources (position, url) and ``take_in`` what comes."""
    return take_in(settled(fetch(sources, get)), stored, start_url, fetched_at, **more)


def take_in(got: DataFrame, stored: DataFrame, start_url: str | None = None, fetched_at: str = "",
            strip: tuple[str, ...] = ("nav", "footer"), drop_alt: tuple[str, ...] = ("image",), drop_link: tuple[str, ...] = ("read more",),
            patches: DataFrame | None = None, render: Callable[[bytes], list[str]] | None = None, read_scan: Callable[[bytes, int], str] | None = None) -> Ingest:
    """Ingest fetched sources (``fetch``) whose bytes aren't in ``stored`` (sha256).

    Pages are converted to Markdown, PDFs rendered page by page (an error without a renderer); bodies are tidied, then patched
    by digest (sha256, diff). ``candidates`` (flag, url, other) has new pages that are near empty or near duplicates, and pages
    that the start page's navigation doesn't link to; nothing is left out for it."""
    ok = got.where("ok")
    order = F.row_number().over(Window.partitionBy("sha256").orderBy("position"))
    # A digest has as many rows as the list has sources with these bytes; contents themselves aren't sorted.
    first = ok.select("sha256", "position", order.alias("_n")).join(stored.select("sha256").distinct().withColumn("_known", F.lit(True)), "sha256", "left")
    new = ok.join(first.where("_n = 1 AND _known IS NULL").select("sha256", "position"), ["sha256", "position"], "left_semi")
    skipped = ok.join(first.where("_n > 1 OR _known").select("sha256", "position"), ["sha256", "position"], "left_semi")

    pages = new.where("kind != 'pdf'").select("sha256", "url", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    none = F.array().cast("array<int>")
    made = html.to_markdown(pages, "sha256", strip, drop_alt, drop_link).select(
        "sha256", F.col("markdown").alias("body"), "title", "headings", "tables", F.lit(None).cast("int").alias("page_count"), none.alias("pages_ocred"), none.alias("low_density"), F.lit("html").alias("_of")
    )
    files, lost = new.where("kind = 'pdf'").select("sha256", "content"), None
    if render:
        pdf = render_pdfs(files, render, read_scan).withColumns({"title": F.lit(None).cast("string"), "headings": F.lit(0), "_of": F.lit("pdf")})
        made = made.unionByName(pdf.withColumn("tables", F.col("tables").cast("int")))
    else:
        lost = new.where("kind = 'pdf'").select("url", F.lit("no renderer for PDF files").alias("error"))
    made = settled(made)
    tidy = made.withColumn("body", T.tidy_markdown(T.clean_unicode(F.col("body"))))
    diffs = patches if patches is not None else tidy.sparkSession.createDataFrame([], "sha256 string, diff string")
    patched = html.try_patch(tidy, diffs, body="body").join(new.select("sha256", "url", "kind", "content"), "sha256")
    patched = settled(patched.withColumn("doc_id", T.doc_id(F.col("url"))))
    file = documents.render(F.col("body"), url=F.col("url"), kind=F.col("kind"), sha256=F.col("sha256"), fetched_at=F.lit(fetched_at), title=F.col("title"))
    written = patched.where("patch_error IS NULL").withColumn("document", file).drop("patch_error", "_of")
    errors = got.where("NOT ok").select("url", "error")
    broken = patched.where("patch_error IS NOT NULL")
    errors = errors.unionByName(broken.select("url", F.concat(F.lit("patch "), F.left("sha256", F.lit(12)), F.lit(" failed: "), "patch_error").alias("error")))
    errors = errors.unionByName(lost) if lost is not None else errors
    ending = lambda folder, e: F.concat(F.lit(f"{folder}/"), "sha256", F.lit("."), e)
    manifest = ok.select("position", "url", T.doc_id(F.col("url")).alias("doc_id"), "sha256", "kind", ending("md", F.lit("md")).alias("md_path"), ending("raw", F.col("kind")).alias("raw_path"))

    bodies = made.where("_of = 'html'").join(new.select("sha256", "url"), "sha256").select("url", "body")
    other = F.lit(None).cast("string").alias("other")
    flags = documents.near_empty(bodies).select(F.lit("near_empty").alias("flag"), "url", other)
    pairs = documents.similar_pairs(bodies, id_col="url", body="body").select(F.lit("near_duplicate").alias("flag"), F.col("a").alias("url"), F.col("b").alias("other"))
    flags = flags.unionByName(pairs)
    if start_url:
        at = T.canonical_url(F.col("url"))
        start = ok.where((F.col("kind") == "html") & (at == T.canonical_url(F.lit(start_url)))).select("url", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
        linked = settled(html.navigation_links(start).select(T.canonical_url(F.col("url")).alias("url")))
        if not linked.isEmpty():
            listed = got.where(T.url_kind(F.col("url")) == "html").where(at != T.canonical_url(F.lit(start_url)))
            away = listed.withColumn("at", at).join(linked.select(F.col("url").alias("at")), "at", "left_anti")
            flags = flags.unionByName(away.select(F.lit("nav_orphaned").alias("flag"), "url", other))
    return Ingest(written, skipped.select("url", "kind", "sha256"), errors, manifest, flags)


def store(made: Ingest, root: str) -> int:
    """Write new documents, the bytes of every fetched source and the manifest under ``root``; the number of new documents."""
    n = sinks.append_new(made.written.select("sha256", "doc_id", "url", "kind", "document"), f"{root}/documents")
    sinks.append_new(made.written.select("sha256", "kind", "content"), f"{root}/raw")
    sinks.write_manifest(made.manifest, f"{root}/manifest")
    return n


def lines(made: Ingest, client: str, candidate: str) -> DataFrame:
    """(n, line): the run's report; counts first, then errors and what to review, by address."""
    one = lambda df, c: df.agg(c.alias("v"))
    part = lambda n, url, line: [F.struct(F.lit(n).alias("part"), url.alias("url")).alias("n"), line.alias("line")]
    n = F.count("*").cast("string")
    counts = one(made.written, n).withColumn("k", F.lit("written")).unionByName(one(made.skipped, n).withColumn("k", F.lit("skipped"))).unionByName(one(made.errors, n).withColumn("k", F.lit("unreachable")))
    totals = made.written.agg(F.coalesce(F.sum("headings"), F.lit(0)).alias("h"), F.coalesce(F.sum("tables"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.size("pages_ocred")), F.lit(0)).alias("o"))
    head = made.written.sparkSession.range(1).select(*part(0, F.lit(""), F.lit(f"ingest of {client} into {candidate}")))
    every = head.unionByName(counts.select(*part(1, F.col("k"), F.concat_ws(": ", "k", "v"))))
    shown = F.format_string("headings %d, tables %d, pages read as scans %d", "h", "t", "o")
    every = every.unionByName(totals.select(*part(2, F.lit(""), shown)))
    sparse = made.written.where(F.size("low_density") > 0)
    every = every.unionByName(sparse.select(*part(3, F.col("url"), F.concat(F.lit("sparse pages: "), "url", F.lit(" "), F.array_join(F.transform("low_density", lambda p: p.cast("string")), ", ")))))
    every = every.unionByName(made.errors.select(*part(4, F.col("url"), F.concat(F.lit("unreachable: "), "url", F.lit(": "), "error"))))
    return every.unionByName(made.candidates.select(*part(5, F.concat_ws(" ", "flag", "url"), F.concat_ws(" ", F.concat("flag", F.lit(":")), "url", F.col("other")))))
