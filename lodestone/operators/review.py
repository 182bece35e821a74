"""Review of a candidate's staged rows: sheets out, decisions in. All sheets are checked before any is applied."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import release
from lodestone.sources import sinks

#: Each sheet's natural id and the columns that an edit may change.
SHEETS = {
    "document": (("doc_id",), ("kind", "title", "url", "division", "sha256", "page_count", "needs_family")),
    "product_family": (("family_id",), ("division", "category", "name", "summary", "applications", "standards", "needs_family")),
    "product": (("product_id",), ("family_id", "model_name", "variant", "description", "needs_family")),
    "capability_row": (
        ("cap_id",),
        ("family_id", "comp_type", "lubricated", "cooling", "capacity_min", "capacity_max", "capacity_unit", "discharge_p_min", "discharge_p_max", "pressure_unit", "driver", "standards", "needs_family"),
    ),
    "capability_gas": (("cap_id", "gas"), ()),
    "company_fact": (("fact_id",), ("kind", "value", "needs_family")),
    "office": (("office_id",), ("name", "city", "region", "address", "phone", "email", "serves_divisions", "needs_family")),
}
STATUS = {"approve": "approved", "edit": "edited", "reject": "rejected"}
OF_FAMILY = ("product", "capability_row")


def sheets(staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A review sheet of every staged table: ids, each value beside its evidence, provenance and an empty decision. Gas rows show
    their capability row's provenance."""
    out = {}
    for table, rows in staged.items():
        ids, writable = SHEETS[table]
        if table == "capability_gas" and "capability_row" in staged:
            rows = sinks.with_parent_source(rows.drop("source_doc_id", "source_locator"), staged["capability_row"])
        values = [*ids, *(c for c in writable if c in rows.columns and c not in ids)]
        if "evidence" not in rows.columns:
            rows = rows.withColumn("evidence", F.lit(None).cast("string"))
        out[table] = sinks.review_rows(rows, values)
    return out


def _word() -> Column:
    return F.coalesce(F.lower(F.trim(F.col("decision").cast("string"))), F.lit(""))


def _filled(table: str, sheet: DataFrame) -> DataFrame:
    """Rows of a sheet that name an id, with the decision's word. Rows without any id are blank rows of the sheet."""
    ids = SHEETS[table][0]
    return sheet.where(F.coalesce(*(F.col(c).cast("string") for c in ids)).isNotNull()).withColumn("_word", _word())


def errors(staged: dict[str, DataFrame], given: dict[str, DataFrame], families: DataFrame) -> DataFrame:
    """(table, row, error) of decisions that can't be taken: unknown words, rows that aren't staged, several decisions for one
    row, edits to a family that isn't frozen, numbers that aren't numbers."""
    found = []
    for table, sheet in given.items():
        ids, writable = SHEETS[table]
        name = F.concat_ws("/", *(F.col(c).cast("string") for c in ids))
        rows = _filled(table, sheet).where("_word != ''")
        tell = lambda df, error: found.append(df.select(F.lit(table).alias("table"), name.alias("row"), error.alias("error")))  # noqa: E731,B023
        known = F.col("_word").isin(*STATUS)
        tell(rows.where(~known), F.concat(F.lit("unknown decision "), "_word"))
        made = rows.where(known)
        tell(made.join(staged[table].select(*ids).distinct(), list(ids), "left_anti"), F.lit("no such row"))
        tell(made.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1"), F.lit("several decisions"))
        edits = made.where("_word = 'edit'")
        if table in OF_FAMILY and "family_id" in sheet.columns:
            named = edits.where(F.nullif(F.col("family_id"), F.lit("")).isNotNull())
            tell(named.join(families.select("family_id").distinct(), "family_id", "left_anti"), F.concat(F.lit("unknown family "), "family_id"))
        for c in writable:
            if c in sheet.columns and c in (*release.NUMBER_COLUMNS, *release.COUNT_COLUMNS):
                cell = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
                kind = "double" if c in release.NUMBER_COLUMNS else "int"
                tell(edits.where(cell.isNotNull() & cell.try_cast(kind).isNull()), F.concat(F.lit(f"{c} isn't a number: "), cell))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def _decided(table: str, rows: DataFrame, sheet: DataFrame, reviewer: str, at: Column) -> DataFrame:
    """Staged rows with their decisions. An edit gives the row every writable cell of the sheet, empty ones too."""
    ids, writable = SHEETS[table]
    cells = [c for c in writable if c in sheet.columns and c in rows.columns]
    made = _filled(table, sheet).where("_word != ''")
    new = made.select(*ids, "_word", *(release.typed(c, F.when(F.col("_word") == "edit", F.col(c).cast("string"))).cast(rows.schema[c].dataType).alias(f"_new_{c}") for c in cells))
    joined = rows.join(new, list(ids), "left")
    status = F.element_at(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair)), F.col("_word"))
    decided = F.col("_word").isNotNull()
    edited = F.coalesce(F.col("_word") == "edit", F.lit(False))
    own = {c: F.when(edited, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in cells}
    stamps = {c: F.when(decided, v).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c, v in (("reviewer", F.lit(reviewer)), ("reviewed_at", at), ("updated_at", at))}
    found = joined.withColumns({**own, "review_status": F.coalesce(status, "review_status"), **stamps})
    return found.select(*rows.columns, *(c for c in stamps if c not in rows.columns))


@dataclass
class Imported:
    """Staged tables after the review, decisions counted by table, and the candidate's ledger."""

    tables: dict[str, DataFrame]
    counts: DataFrame
    ledger: DataFrame


def take_in(staged: dict[str, DataFrame], given: dict[str, DataFrame], families: DataFrame, ledger: DataFrame, candidate: str, reviewer: str = "review", at: Column | None = None) -> Imported:
    """The staged tables with the decisions of ``given`` sheets, gases of rejected rows rejected, the candidate ``imported``.

    Raises with up to twenty errors if any decision can't be taken; then nothing is decided."""
    wrong = errors(staged, given, families).orderBy("table", "row", "error").limit(20).collect()
    if wrong:
        raise ValueError("review not taken in: " + "; ".join(f"{e.table} {e.row}: {e.error}" for e in wrong))
    at = F.current_timestamp() if at is None else at
    tables = {t: _decided(t, rows, given[t], reviewer, at) if t in given else rows for t, rows in staged.items()}
    if "capability_gas" in tables and "capability_row" in tables:
        gone = tables["capability_row"].where("review_status = 'rejected'").select("cap_id").distinct().withColumn("_gone", F.lit(True))
        gases = tables["capability_gas"].join(gone, "cap_id", "left")
        stamps = {"review_status": F.lit("rejected"), "reviewer": F.lit(reviewer), "reviewed_at": at, "updated_at": at}
        held = {c: F.when(F.col("_gone"), v).otherwise(F.col(c)) for c, v in stamps.items() if c in gases.columns}
        tables["capability_gas"] = gases.withColumns(held).select(*tables["capability_gas"].columns)
    words = [_filled(t, s).select(F.lit(t).alias("table"), F.when(F.col("_word") == "", "blank").otherwise(F.col("_word")).alias("word")) for t, s in given.items()]
    every = words[0]
    for w in words[1:]:
        every = every.unionByName(w)
    counts = every.groupBy("table").pivot("word", ["approve", "edit", "reject", "blank"]).count().na.fill(0)
    return Imported(tables, counts, release.set_status(ledger, candidate, "imported"))
