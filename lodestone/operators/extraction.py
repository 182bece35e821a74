"""Extraction of staged facts from sections: classify, propose families and stop for a human, or extract, gate, build, mark.

Each pass puts all sections to the model at once and settles the replies. A field counts only with a phrase that the section
holds verbatim; what has none is dropped and logged with its path. Families come from the frozen list alone: anything else
leaves the row without one, marked as needing it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import units as U
from lodestone.operators import evidence, release, turns

_EV = "struct<value:string,evidence:string>"
#: Of each section type, the list of a reply, its single fields and its lists.
TYPES = {
    "capability_spec": ("rows", ("family", "comp_type", "lubricated", "cooling", "capacity", "discharge_pressure"), ("drivers", "standards", "gases")),
    "product_list": ("products", ("family", "model_name", "variant", "description"), ("attributes",)),
    "company_fact": ("facts", ("kind", "value", "detail"), ()),
    "office_contact": ("offices", ("name", "city", "address", "phone", "email"), ("serves_divisions",)),
}
#: Keys of the staged tables that extraction writes.
KEYS = {"capability_row": ["cap_id"], "capability_gas": ["cap_id", "gas"], "product": ["product_id"], "company_fact": ["fact_id"], "office": ["office_id"]}
FAMILY = "id string, division string, category string, name string, summary string, source string"


def _item(kind: str) -> str:
    _, single, lists = TYPES[kind]
    return "struct<" + ",".join([*(f"`{f}`:{_EV}" for f in single), *(f"`{f}`:array<{_EV}>" for f in lists)]) + ">"


def classify(sections: DataFrame, call: Callable[[str], str], prompt: str = "") -> DataFrame:
    """(section_id, type, confidence) of sections (section_id, doc, heading_path, locator, text); without a sound reply: other, 0."""
    replies = _asked(sections, call, F.lit("section_classification"), F.lit(prompt), "type string, confidence double")
    return replies.select("section_id", evidence.section_type(F.col("reply.type")).alias("type"), F.coalesce("reply.confidence", F.lit(0.0)).alias("confidence"))


def _asked(sections: DataFrame, call: Callable[[str], str], schema: Column, system: Column, parse: str) -> DataFrame:
    heading = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " › ")).otherwise("(preamble)")
    user = F.concat(F.lit("DOC: "), "doc", F.lit("\nHEADING: "), heading, F.lit("\nLOCATOR: "), F.coalesce("locator", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    none = F.lit(None).cast("array<struct<role:string,text:string>>")
    return turns.ask(sections.withColumn("history", none), call, schema, system, user, parse, "section_id")


def propose_families(sections: DataFrame, call: Callable[[str], str], prompt: str = "", limit: int = 60_000) -> DataFrame:
    """(id, division, category, name, summary, source): families that the model finds in each document's digest, one row for each id."""
    numbered = sections if "position" in sections.columns else sections.withColumn("position", F.monotonically_increasing_id())
    digests = evidence.digest_of_sections(numbered, limit)
    none = F.lit(None).cast("array<struct<role:string,text:string>>")
    replies = turns.ask(digests.withColumn("history", none), call, "family_discovery", F.lit(prompt), F.col("digest"), f"families array<struct<{FAMILY.replace(' string', ':string')}>>", "doc")
    found = replies.select("doc", F.inline("reply.families")).where("id IS NOT NULL")
    return found.groupBy("id").agg(F.min_by(F.struct("division", "category", "name", "summary", "source"), "doc").alias("f")).select("id", "f.*")


@dataclass
class Extracted:
    """Staged tables, what the gate dropped (section_id, path, value, evidence), and sections without a sound reply."""

    tables: dict[str, DataFrame]
    drops: DataFrame
    skipped: DataFrame


def _gated(sections: DataFrame, kind: str, call: Callable[[str], str], prompt: str, families: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, drops, skipped) of the sections of one type; an item's fields are values with evidence, or null."""
    name, single, lists = TYPES[kind]
    catalogue = families.agg(F.concat(F.lit("Assign one of these families or none:\n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "family_id", "name"))), "\n")).alias("_c"))
    own = sections.where(F.col("type") == kind).crossJoin(F.broadcast(catalogue))  # one row: the frozen list, a dimension
    system = F.concat_ws("\n\n", F.lit(prompt), F.col("_c")) if "family" in single else F.lit(prompt)
    replies = _asked(own, call, F.lit(f"extract_{kind}"), system, f"`{name}` array<{_item(kind)}>")
    at = replies.join(own.drop("_c", "history"), "section_id")
    text = F.concat_ws("\n", F.array_join("heading_path", "\n"), "text")
    rows = at.where("NOT skipped").withColumn("_text", text).select("section_id", "doc", "locator", "confidence", "_text", F.posexplode(f"reply.{name}").alias("i", "x")).where("x IS NOT NULL")
    sound = lambda e: e.isNotNull() & e.value.isNotNull() & evidence.verbatim(e.evidence, F.col("_text"))
    path = lambda f: F.concat(F.lit(f"{name}["), F.col("i").cast("string"), F.lit(f"].{f}"))
    lost = lambda e: e.isNotNull() & e.value.isNotNull() & ~evidence.verbatim(e.evidence, F.col("_text"))
    told = lambda p, e: F.struct(p.alias("path"), e.value.alias("value"), e.evidence.alias("evidence"))
    gone = [F.when(lost(F.col(f"x.{f}")), F.array(told(path(f), F.col(f"x.{f}")))).otherwise(F.array().cast("array<struct<path:string,value:string,evidence:string>>")) for f in single]

    def of_list(f: str) -> Column:
        marked = F.transform(F.coalesce(f"x.{f}", F.array().cast(f"array<{_EV}>")), lambda e, k: F.when(lost(e), told(F.concat(path(f), F.lit("["), k.cast("string"), F.lit("]")), e)))
        return F.filter(marked, lambda e: e.isNotNull())

    gone += map(of_list, lists)
    drops = rows.select("section_id", F.inline(F.concat(*gone)))
    kept = {f: F.when(sound(F.col(f"x.{f}")), F.col(f"x.{f}")) for f in single}
    kept |= {f: F.filter(F.coalesce(f"x.{f}", F.array().cast(f"array<{_EV}>")), sound) for f in lists}
    quotes = F.map_concat(
        F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f).alias("key"), kept[f].evidence.alias("value")) for f in single)), lambda e: e.value.isNotNull())),
        F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(f).alias("key"), F.array_join(F.transform(kept[f], lambda e: e.evidence), " | ").alias("value")) for f in lists)) if lists else F.array().cast("array<struct<key:string,value:string>>"), lambda e: e.value != "")),
    )
    items = rows.select("section_id", "doc", "locator", "confidence", "i", *(c.alias(f) for f, c in kept.items()), F.to_json(quotes).alias("quotes"))
    return items, drops, replies.where("skipped").select("section_id")


def _row(prefix: str, key: str, *columns: Column) -> list[Column]:
    source = (F.col("doc").alias("source_doc_id"), F.col("locator").alias("source_locator"), F.col("section_id"), F.col("confidence"), F.col("quotes").alias("evidence"), F.lit("pending").alias("review_status"))
    return [evidence.row_id(prefix).alias(key), *columns, *source]


def _family(items: DataFrame, families: DataFrame) -> DataFrame:
    known = families.select(F.col("family_id").alias("_known")).distinct()
    joined = items.join(known, F.col("family.value") == F.col("_known"), "left")
    return joined.withColumns({"family_id": F.col("_known"), "needs_family": F.col("_known").isNull()}).drop("_known")


def extract(sections: DataFrame, families: DataFrame, call: Callable[[str], str], prompts: dict[str, str] | None = None) -> Extracted:
    """Facts of classified sections (section_id, doc, heading_path, locator, text, type, confidence) under the frozen ``families``
    (family_id, name). Capacity rows of a family with different published limits share a conflict group, none is preferred."""
    prompts = prompts or {}
    items, drops, skipped = {}, [], []
    for kind in TYPES:
        made, gone, missed = _gated(sections, kind, call, prompts.get(f"extract_{kind}", ""), families)
        items[kind] = made
        drops.append(gone)
        skipped.append(missed)
    value = lambda f: F.col(f"{f}.value").alias(f)
    values = lambda f, name=None: F.transform(F.col(f), lambda e: e.value).alias(name or f)
    flag = release.flag(F.col("lubricated.value")).alias("lubricated")

    caps = _family(items["capability_spec"], families).withColumns({"_c": U.parse_capacity(F.col("capacity.value")), "_p": U.parse_pressure(F.col("discharge_pressure.value"))})
    limits = [F.col("_c.min").alias("capacity_min"), F.col("_c.max").alias("capacity_max"), F.col("_c.unit").alias("capacity_unit"), F.col("_p.min").alias("discharge_p_min"), F.col("_p.max").alias("discharge_p_max"), F.col("_p.unit").alias("pressure_unit")]
    rows = caps.select(*_row("cap", "cap_id", F.col("family_id"), F.col("needs_family"), value("comp_type"), flag, value("cooling"), *limits, values("drivers", "driver"), values("standards")))
    tagged = release.conflict_groups(rows, "family_id", "capacity_max")
    rows = tagged.withColumn("conflict_group", F.when(F.col("capacity_max").isNotNull(), F.col("conflict_group")))
    gas = F.col("g.value")
    gases = caps.select(evidence.row_id("cap").alias("cap_id"), "section_id", "confidence", F.explode("gases").alias("g"))
    gases = gases.groupBy("cap_id", gas.alias("gas"), "section_id", "confidence").agg(F.to_json(F.struct(F.min("g.evidence").alias("gas"))).alias("evidence")).withColumn("review_status", F.lit("pending"))

    made = _family(items["product_list"], families)
    printed = F.to_json(F.struct(values("attributes", "printed"))).alias("attributes")
    products = made.select(*_row("prd", "product_id", F.col("family_id"), F.col("needs_family"), value("model_name"), value("variant"), value("description"), printed))
    known = F.when(F.col("kind.value").isin(*evidence.FACT_KINDS), F.col("kind.value")).alias("kind")
    facts = items["company_fact"].select(*_row("cf", "fact_id", known, value("value"), F.to_json(F.struct(value("detail"))).alias("detail")))
    plain = [value(f) for f in ("name", "city", "address", "phone", "email")]
    offices = items["office_contact"].select(*_row("off", "office_id", *plain, F.lit(None).cast("string").alias("region"), values("serves_divisions")))
    every, missed = drops[0], skipped[0]
    for d, s in zip(drops[1:], skipped[1:]):
        every, missed = every.unionByName(d), missed.unionByName(s)
    return Extracted({"capability_row": rows, "capability_gas": gases, "product": products, "company_fact": facts, "office": offices}, every, missed)


@dataclass
class Pass:
    """What a run reached: the classification, and either proposed families (no frozen list yet) or what was extracted."""

    classified: DataFrame
    proposals: DataFrame | None
    extracted: Extracted | None


def run(sections: DataFrame, call: Callable[[str], str], families: DataFrame | None, prompts: dict[str, str] | None = None, classified: DataFrame | None = None) -> Pass:
    """Classify sections (a stored classification is used as it is), then propose families if none are frozen, else extract."""
    prompts = prompts or {}
    told = classified if classified is not None else classify(sections, call, prompts.get("classifier", ""))
    kept = sections.join(told.where("type != 'other'"), "section_id")
    if families is None:
        return Pass(told, propose_families(kept, call, prompts.get("family_discovery", "")), None)
    return Pass(told, None, extract(kept, families, call, prompts))


def stage(staged: dict[str, DataFrame], made: Extracted) -> dict[str, DataFrame]:
    """Staged tables with pending rows replaced by what was extracted; rows that were reviewed stay, and win."""
    return {t: release.replace_pending(staged[t], rows, KEYS[t]) if t in staged else rows for t, rows in made.tables.items()}


def lines(made: Extracted, families: DataFrame) -> DataFrame:
    """(n, line): the report; rows by table, rows without a family, conflicts, dropped fields (the first eight by section and path)."""
    part = lambda n, by, line: [F.struct(F.lit(n).alias("part"), by.alias("by")).alias("n"), line.alias("line")]
    text = lambda c: c.cast("string")
    every = families.agg(F.count("*").alias("c")).select(*part(0, F.lit(""), F.concat_ws(": ", F.lit("families"), text(F.col("c")))))
    for table, rows in made.tables.items():
        every = every.unionByName(rows.agg(F.count("*").alias("c")).select(*part(1, F.lit(table), F.concat_ws(": ", F.lit(table), text(F.col("c"))))))
    lacking = made.tables["capability_row"].select("needs_family").unionByName(made.tables["product"].select("needs_family"))
    every = every.unionByName(lacking.agg(F.count_if("needs_family").alias("c")).select(*part(2, F.lit("a"), F.concat_ws(": ", F.lit("rows that need a family"), text(F.col("c"))))))
    every = every.unionByName(made.tables["capability_row"].agg(F.count_distinct("conflict_group").alias("c")).select(*part(2, F.lit("b"), F.concat_ws(": ", F.lit("conflict groups"), text(F.col("c"))))))
    every = every.unionByName(made.drops.agg(F.count("*").alias("c")).select(*part(3, F.lit(""), F.concat_ws(": ", F.lit("fields dropped"), text(F.col("c"))))))
    shown = made.drops.orderBy("section_id", "path").limit(8)
    every = every.unionByName(shown.select(*part(4, F.concat_ws(" ", "section_id", "path"), F.concat_ws(" ", "section_id", "path", F.col("value")))))
    return every.unionByName(made.skipped.select(*part(5, F.col("section_id"), F.concat(F.lit("skipped: "), "section_id"))))
