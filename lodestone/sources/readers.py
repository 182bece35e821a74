"""Readers with fixed schemas: source lists, Markdown folders, raw bytes, manifests, YAML dimensions, review sheets.

Small hand-kept files (source lists, families, questions) are read on the driver; all else are Spark scans.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.documents import front_matter, sections


def simple_yaml(text: str) -> dict:
    """Mappings of scalars, lists of scalars and lists of mappings, by indentation; no library for YAML is at hand.

    Scalars may be JSON; anything else is text. Other YAML is an error."""

    def scalar(t: str):
        t = t.strip()
        if t in ("", "null", "~"):
            return None
        if t[0] == t[-1] == "'" and len(t) > 1:
            return t[1:-1].replace("''", "'")
        try:
            return json.loads(t)
        except ValueError:
            return t

    lines = [(len(l) - len(l.lstrip()), l.strip()) for l in text.splitlines() if l.strip() and not l.lstrip().startswith("#")]

    def block(at: int, indent: int):
        is_list = lines[at][1].startswith("- ") or lines[at][1] == "-"
        out: list | dict = [] if is_list else {}
        while at < len(lines) and lines[at][0] == indent and (lines[at][1][:1] == "-") == is_list:
            line = lines[at][1]
            if is_list:
                rest = line[1:].strip()
                key = rest.partition(":")
                if key[1] and (key[2][:1] in ("", " ")) and not rest.startswith(('"', "'", "[", "{")):
                    lines[at] = (indent + 2, rest)
                    value, at = block(at, indent + 2)
                else:
                    value, at = scalar(rest), at + 1
                out.append(value)
                continue
            name, colon, rest = line.partition(":")
            if not colon:
                raise ValueError(f"not a mapping: {line}")
            if rest.strip():
                out[name.strip().strip("\"'")], at = scalar(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][0] == indent and lines[at + 1][1].startswith("-")):
                out[name.strip().strip("\"'")], at = block(at + 1, lines[at + 1][0])
            else:
                out[name.strip().strip("\"'")], at = None, at + 1
        return out, at

    if not lines:
        return {}
    found, end = block(0, lines[0][0])
    if end != len(lines):
        raise ValueError(f"unexpected indentation: {lines[end][1]}")
    return found


def source_list(spark: SparkSession, content: str) -> DataFrame:
    """(url, kind, position): pages and PDFs of a source list in order, without excluded ones."""
    data = simple_yaml(content)
    gone = set(data.get("exclude") or [])
    rows = [(u, k, i) for i, (u, k) in enumerate([(u, "html") for u in data.get("pages") or []] + [(u, "pdf") for u in data.get("pdfs") or []]) if u not in gone]
    return spark.createDataFrame(rows, "url string, kind string, position int")


def dimension(spark: SparkSession, content: str, key: str, schema: str) -> DataFrame:
    """Rows of a hand-kept list (families, regions, dispositions, questions) under a fixed schema; missing fields are null."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in simple_yaml(content).get(key) or []], schema)


def city_states(regions: DataFrame) -> DataFrame:
    """(city, state, region) of regions (state, region, cities), cities trimmed and in capitals."""
    return regions.select(F.explode("cities").alias("c"), "state", "region").select(F.upper(F.trim("c")).alias("city"), "state", "region")


def raw_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, kind, content) of a content-addressed cache, whose files are named by their hash."""
    files = spark.read.format("binaryFile").load(folder)
    kind = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return files.select("path", F.sha2("content", 256).alias("sha256"), kind.alias("kind"), "content")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, url, kind, sha256, fetched_at, title, body, doc_id, page_count) of converted files."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), front_matter(F.col("value")).alias("m"))
    flat = files.select("path", "m.*")
    pages = F.array_max(F.transform(F.regexp_extract_all("body", F.lit(r"(?m)^<!-- page (\d+) -->$"), F.lit(1)), lambda p: p.try_cast("int")))
    return flat.withColumns({"doc_id": T.doc_id(F.col("url")), "page_count": F.coalesce(pages, F.when(F.col("kind") == "html", 1))})


def corpus_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of all converted files."""
    return sections(markdown(spark, folder))


MANIFEST = "url string, kind string, sha256 string, title string, fetched_at string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def review_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a review sheet with its decision; rows without any key are left out."""
    rows = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), multiLine=True, escape='"', quote='"')
    return rows.where(F.coalesce(*columns).isNotNull())


def pdf_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, body) of rendered pages (doc_id, page, text, ocr): page markers; sparse pages take their OCR text."""
    shown = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < least, F.coalesce("ocr", "text")).otherwise(F.col("text"))
    marked = F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n\n"), F.coalesce(shown, F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("page", marked.alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("body"))


def cached(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stored classification, or None if there is none yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).json(path) if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath) else None


def only_client(names: list[str]) -> str:
    """The one client that there is; none or several are an error."""
    if len(names) != 1:
        raise ValueError(f"name one client of: {', '.join(sorted(names)) or 'none'}")
    return names[0]


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(agent, body) of a folder's prompts: ``<agent>.md``, else ``<agent>.txt``."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{md,txt}").select(F.col("value").alias("body"), F.input_file_name().alias("path"))
    name = files.withColumns({"agent": F.regexp_extract("path", r"([^/]+)\.(?:md|txt)$", 1), "rank": F.col("path").endswith(".txt")})
    return name.groupBy("agent").agg(F.min_by("body", "rank").alias("body"))


def questions(spark: SparkSession, content: str, schema: str) -> DataFrame:
    """Golden questions of a YAML file in the suite's schema: arguments of tools as JSON, what isn't given as null."""
    rows = []
    for q in simple_yaml(content).get("questions") or []:
        fact = q.get("fact")
        rows.append(json.dumps({**q, **({"fact": {**fact, "args": json.dumps(fact.get("args") or {})}} if fact else {})}))
    texts = spark.createDataFrame([(r,) for r in rows], "j string")
    return texts.select(F.from_json("j", schema).alias("q")).select("q.*")


def witnesses(files: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    """(sha256, witness) of raw PDF files (sha256, content): their text by another reader than the converter's, behind a function.

    A file that it can't read has no witness."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append(read(bytes(content)))
                except (OSError, ValueError):
                    texts.append(None)
            yield pd.DataFrame({"sha256": batch["sha256"], "witness": pd.Series(texts, dtype=object)})

    return files.select("sha256", "content").mapInPandas(run, "sha256 string, witness string")
