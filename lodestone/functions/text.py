"""Text functions as column expressions: clean-up, normal forms, tokens, locators, detectors."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "<!-- image -->"
#: What ``(?U)\\s`` matches: the characters of the White_Space property.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def nfc(text: Column) -> Column:
    """Canonical composition, in Arrow batches; Spark has no built-in for it. Compatibility forms such as ³ stay."""

    def compose(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(compose, "string")(text)


def clean_unicode(text: Column) -> Column:
    """NFC; no-break spaces as spaces; zero-width characters removed."""
    return F.translate(F.replace(nfc(text), F.lit(" "), F.lit(" ")), "​‌‍﻿", "")


def tidy_markdown(md: Column) -> Column:
    """Runs of image placeholders as one; lines of a single character dropped, table pipes kept."""
    once = F.regexp_replace(md, rf"(?U)(?:{IMAGE}\s*){{2,}}", f"{IMAGE}\n\n")
    kept = F.filter(F.split(once, "\n"), lambda l: (F.length(strip(l)) != 1) | l.rlike(r"(?U)^\s*\|"))
    return F.array_join(kept, "\n")


def strip(text: Column) -> Column:
    """Text without white space at its ends; a trim looks at the ends alone, where a pattern tries each space of the text."""
    return F.trim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def paragraph_form(text: Column) -> Column:
    return F.lower(squeeze(text))


def heading_form(text: Column) -> Column:
    return F.upper(squeeze(text))


def locator_heading(locator: Column) -> Column:
    """The heading after the last section mark, else the whole locator."""
    return strip(F.substring_index(locator, "§", -1))


def alias_form(name: Column) -> Column:
    """Lower case without white space and hyphens."""
    return F.lower(F.regexp_replace(name, r"(?U)[\s\-]+", ""))


def word_set(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def name_tokens(name: Column) -> Column:
    """word_set without single letters; a plural s goes from words of four letters or more."""
    kept = F.filter(word_set(name), lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))
    folded = F.transform(kept, lambda t: F.when((F.length(t) >= 4) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    return F.array_distinct(folded)


def model_series(name: Column) -> Column:
    """Leading letters of a model name."""
    return F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), "^[a-z]+", 0)


def model_numbers(name: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint")))


def display_name(model: Column, family: Column, variant: Column, description: Column) -> Column:
    """The model, else the family with the variant or the description's first 60 characters; empty texts count as missing."""
    some = lambda c: F.nullif(c, F.lit(""))
    first_line = F.when(some(description).isNotNull(), F.substring(F.split(strip(description), "\n")[0], 1, 60))
    tail = some(F.coalesce(some(variant), first_line))
    base = F.coalesce(some(family), F.lit("product"))
    return F.coalesce(some(model), F.when(tail.isNotNull(), F.concat(base, F.lit(" — "), tail)), base)


def url_stem(url: Column) -> Column:
    """Last path segment without its extension, percent-decoded."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    last = F.regexp_extract(path, r"([^/]*)/?$", 1)
    return F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""), r"\+", "%2B")), last)


def title_from_url(url: Column) -> Column:
    """The decoded last part of an address's path without a known extension, trimmed; ``Document`` if nothing is left."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    for ending in ("pdf", "html", "php", "htm"):
        name = F.regexp_replace(name, rf"(?i)\.{ending}$", "")
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit("Document"))


def doc_id(url: Column) -> Column:
    """``doc.`` and the slug of the address's stem; ``index`` without one."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(url_stem(url)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("doc."), F.when(slug == "", "index").otherwise(slug))


def url_kind(url: Column) -> Column:
    return F.when(F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".pdf"), "pdf").otherwise("html")


def canonical_url(url: Column) -> Column:
    """Without the fragment; spaces of the path percent-encoded."""
    return F.replace(F.regexp_replace(url, "#.*$", ""), F.lit(" "), F.lit("%20"))


def slug(text: Column, joint: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def parse_locator(locator: Column) -> Column:
    """struct(page_start, page_end, heading) of ``pA-B §heading``.

    A page counts at the start alone and a single one has no end; the heading is what follows the last section mark, else
    all that is left."""
    whole = strip(locator)
    page = r"(?i)^p(\d+)(?:\s*[-–]\s*(\d+))?"
    first = F.regexp_extract(whole, page, 1).try_cast("int")
    last = F.regexp_extract(whole, page, 2).try_cast("int")
    heading = F.nullif(locator_heading(F.regexp_replace(whole, page, "")), F.lit(""))
    return F.struct(first.alias("page_start"), last.alias("page_end"), heading.alias("heading"))


def parse_source(source: Column) -> Column:
    """struct(doc, locator) of the first ``;``-parted token of a family's source: ``doc.x §heading``, or a document alone."""
    first = strip(F.split_part(source, F.lit(";"), F.lit(1)))
    marked = F.contains(first, F.lit(" §"))
    at = F.locate(" §", first)
    doc = F.when(marked, strip(F.left(first, at - 1))).otherwise(F.regexp_extract(first, r"(?U)^(\S+)", 1))
    rest = F.when(marked, F.concat(F.lit("§"), strip(F.substring(first, at + 2, F.length(first))))).otherwise(F.regexp_extract(first, r"(?sU)^\S+\s+(.*)$", 1))
    return F.struct(F.nullif(doc, F.lit("")).alias("doc"), F.nullif(rest, F.lit("")).alias("locator"))


def location(kind: Column, page_start: Column, page_end: Column, heading: Column) -> Column:
    """``p. 4–5 — Heading`` for a paged PDF, else the heading."""
    several = F.when(page_end.isNotNull() & (page_end != page_start), F.concat(F.lit("–"), page_end.cast("string"))).otherwise("")
    pages = F.when((kind == "pdf") & (page_start > 0), F.concat(F.lit("p. "), page_start.cast("string"), several))
    return F.when(pages.isNotNull(), F.concat_ws(" — ", pages, heading)).otherwise(heading)


def section_locator(path: Column, page_start: Column, page_end: Column) -> Column:
    """``pA-B §a › b``; without headings ``(preamble)``."""
    heading = F.when(F.coalesce(F.size(path), F.lit(0)) > 0, F.concat(F.lit("§"), F.array_join(path, " › "))).otherwise("(preamble)")
    pages = F.when(page_start.isNotNull(), F.concat(F.lit("p"), page_start.cast("string"), F.when(page_end > page_start, F.concat(F.lit("-"), page_end.cast("string"))).otherwise("")))
    return F.concat_ws(" ", pages, heading)


def link(url: Column, kind: Column, page: Column) -> Column:
    """The address, with a page anchor for PDFs whose page is known."""
    return F.when((kind == "pdf") & page.isNotNull(), F.concat(url, F.lit("#page="), page.cast("string"))).otherwise(url)


def normal_digits(text: Column) -> Column:
    """Devanagari digits folded, digit-group commas and zero fractions removed."""
    plain = F.translate(F.coalesce(text, F.lit("")), "०१२३४५६७८९", "0123456789")
    return F.regexp_replace(F.regexp_replace(plain, r"(?<=\d),(?=\d)", ""), r"(\d)\.0+(?!\d)", "$1")


def says(text: Column, needle: Column) -> Column:
    """Containment without regard to case, as printed or with normal digits."""
    low, want = F.lower(text), F.lower(needle)
    return F.contains(low, want) | F.contains(normal_digits(low), normal_digits(want))


#: What may stay in Latin script in a reply of another script, in order of removal.
LATIN_ALLOWED = (
    r"(?i)\[\s*(?:tr)?\d+(?:\s*,\s*(?:tr)?\d+)*\s*\]",
    r"(?s)\*\*.+?\*\*",
    r"\{[^{}]*\}",
    r"[A-Z]{2,}(?:[-\s]?\d[\w:./-]*)?",
    r"(?i)(?:nm³?\s*/?\s*hr|nm3\s*/?\s*hr|m³\s*/\s*hr|m3\s*/\s*hr|kg\s*/\s*hr|kg\s*/\s*cm²?g|scmd|scmh|barg|bar|psi|kw|hp|lpm|cfm|tpd|lumen|tons?)",
)


def latin_leaks(text: Column) -> Column:
    """Distinct Latin words left after allowed ones are removed."""
    left = F.coalesce(text, F.lit(""))
    for pattern in LATIN_ALLOWED:
        left = F.regexp_replace(left, pattern, " ")
    return F.array_distinct(F.regexp_extract_all(left, F.lit("[A-Za-z]{2,}"), F.lit(0)))


def citation_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"tr\d+"), F.lit(0)))


def truncate(text: Column, limit: int = 600) -> Column:
    """The first ``limit`` characters and an ellipsis, if there are more; null as empty."""
    some = F.coalesce(text, F.lit(""))
    return F.when(F.length(some) > limit, F.concat(F.substring(some, 1, limit), F.lit("…"))).otherwise(some)


#: Fixed value: words of five letters or more, API codes, numbers.
CONTENT = r"[a-z]{5,}|api[\s\-]?\d+|\d[\d,\.]*"


def content_tokens(text: Column) -> Column:
    """Distinct words of five letters or more, API codes and numbers of a text, their commas removed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CONTENT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit(""))))


def answer_tokens(text: Column) -> Column:
    """``content_tokens`` of an answer, from which commas go first."""
    return content_tokens(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")))


def word_count(text: Column) -> Column:
    """Words by white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))
