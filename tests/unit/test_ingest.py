"""A whole ingestion with made-up fetching and rendering, twice."""

import sys

import pytest
from pyspark import cloudpickle

from lodestone.operators import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])
LONG = " ".join(f"word{i}" for i in range(60))
WEB = {
    "https://x.org/": (f"<html><title>Home</title><body><header><a href='/a.html#top'>A</a><a href='b.php'>B</a></header><h1>Start</h1><p>{LONG}</p></body></html>".encode(), "text/html"),
    "https://x.org/a.html": (f"<body><h2>Pumps</h2><p>{LONG} more</p><table><tr><td>1</td></tr></table></body>".encode(), "text/html; charset=utf-8"),
    "https://x.org/b.php": (f"<body><p>{LONG} else</p></body>".encode(), None),
    "https://x.org/c.html": (b"<body><p>tiny \xff</p></body>", "text/html"),
    "https://x.org/copy.html": (b"<body><p>tiny \xff</p></body>", "text/html"),
    "https://x.org/d.pdf": (b"%PDF first|a long enough page of text that needs no scan at all, really", "application/pdf"),
    "https://x.org/sheet": (b"%PDF x|", "Application/PDF"),
}


def get(url):
    if url not in WEB:
        raise OSError("404 not found")
    return WEB[url]


def render(content):
    return content.decode().split("|")


@pytest.fixture(scope="module")
def sources(spark):
    urls = [*WEB, "https://x.org/gone.html"]
    return spark.createDataFrame(list(enumerate(urls)), "position int, url string")


def test_ingest_twice(spark, sources, tmp_path):
    import hashlib

    a = hashlib.sha256(WEB["https://x.org/a.html"][0]).hexdigest()
    b = hashlib.sha256(WEB["https://x.org/b.php"][0]).hexdigest()
    patches = spark.createDataFrame([(a, "@@ -1,1 +1,1 @@\n-## Pumps\n+## Great pumps"), (b, "@@ -1,1 +1,1 @@\n-nothing\n+x")], "sha256 string, diff string")
    stored = spark.createDataFrame([], "sha256 string")
    made = ingest.run(sources, get, stored, "https://x.org/", "2024-01-01", patches=patches, render=render, read_scan=lambda content, page: f"scan of page {page}")
    written = {r.url: r for r in made.written.collect()}
    assert sorted(written) == ["https://x.org/", "https://x.org/a.html", "https://x.org/c.html", "https://x.org/d.pdf", "https://x.org/sheet"]
    page = written["https://x.org/a.html"]
    assert page.body.startswith("## Great pumps\n\nword0") and page.patched and (page.headings, page.tables, page.doc_id) == (1, 1, "doc.a")
    assert page.document.startswith(f'---\nurl: "https://x.org/a.html"\nkind: "html"\nsha256: "{a}"\nfetched_at: "2024-01-01"\ntitle: null\n---\n\n## Great')
    assert written["https://x.org/"].title == "Home" and "�" in written["https://x.org/c.html"].body
    pdf = written["https://x.org/d.pdf"]
    assert pdf.body == "<!-- page 1 -->\n\nscan of page 1\n\n<!-- page 2 -->\n\na long enough page of text that needs no scan at all, really"
    assert (pdf.pages_ocred, pdf.low_density, pdf.page_count, pdf.kind) == ([1], [1], 2, "pdf") and written["https://x.org/sheet"].kind == "pdf"
    assert [r.url for r in made.skipped.collect()] == ["https://x.org/copy.html"]
    errors = {r.url: r.error for r in made.errors.collect()}
    assert errors == {"https://x.org/gone.html": "404 not found", "https://x.org/b.php": f"patch {b[:12]} failed: line 1 differs from the patch"}
    assert made.manifest.count() == 7
    flags = {(r.flag, r.url, r.other) for r in made.candidates.collect()}
    assert ("near_empty", "https://x.org/c.html", None) in flags and ("near_duplicate", "https://x.org/a.html", "https://x.org/b.php") in flags
    assert {u for f, u, _ in flags if f == "nav_orphaned"} == {"https://x.org/c.html", "https://x.org/copy.html", "https://x.org/gone.html", "https://x.org/sheet"}
    lines = [r.line for r in ingest.lines(made, "x", "rc.x.0001").orderBy("n").collect()]
    assert lines[:2] == ["ingest of x into rc.x.0001", "skipped: 1"] and "headings 2, tables 1, pages read as scans 3" in lines
    assert "unreachable: https://x.org/gone.html: 404 not found" in lines and "near_empty: https://x.org/c.html" in lines

    root = str(tmp_path / "data")
    assert ingest.store(made, root) == 5
    known = spark.read.parquet(f"{root}/documents")
    again = ingest.run(sources, get, known, None, "2024-01-02", render=render)
    assert [r.url for r in again.written.collect()] == ["https://x.org/b.php"] and again.skipped.count() == 6
    assert ingest.store(again, root) == 1 and spark.read.parquet(f"{root}/documents").count() == 6


def test_ingest_without_renderer_and_without_sources(spark, sources):
    stored = spark.createDataFrame([], "sha256 string")
    made = ingest.run(sources.where("url LIKE '%d.pdf'"), get, stored)
    assert made.written.count() == 0 and [r.error for r in made.errors.collect()] == ["no renderer for PDF files"]
    none = ingest.run(sources.limit(0), get, stored, "https://x.org/", render=render)
    assert [none.written.count(), none.errors.count(), none.candidates.count(), none.manifest.count()] == [0, 0, 0, 0]
