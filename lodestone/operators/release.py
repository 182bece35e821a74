"""Release management over tables keyed by release: checks, diff, promotion, activation, review, upserts.

Parquet has no transactions: every mutation here is a new state computed from the old one, for the caller to write
beside it and switch over to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as T

SURVIVING = ("approved", "edited")
#: Status names of a candidate, in order; those that may be promoted.
STATUSES = ("open", "exported", "imported", "promoted", "abandoned")
PROMOTABLE = ("exported", "imported")


def active(table: DataFrame, releases: DataFrame) -> DataFrame:
    """Rows of the active release without its id; none if nothing is active. The one-row side is broadcast by size."""
    now = releases.where("is_active").select("release_id")
    return table.join(now, "release_id", "left_semi").drop("release_id")


def activate(releases: DataFrame, release_id: str) -> DataFrame:
    """The release table with one active release; an unknown id fails when read."""
    known = releases.agg(F.coalesce(F.bool_or(F.col("release_id") == release_id), F.lit(False)).alias("_known"))  # one row
    on = F.when(F.col("_known"), F.col("release_id") == release_id).otherwise(F.raise_error(F.lit(f"unknown release: {release_id}")).cast("boolean"))
    return releases.crossJoin(F.broadcast(known)).withColumn("is_active", on).drop("_known")


def active_release(releases: DataFrame) -> DataFrame:
    """One row (release_id): the active release; none or several fail when read."""
    found = releases.where("is_active").agg(F.count("*").alias("n"), F.max("release_id").alias("r"))
    return found.select(F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("active releases: "), F.col("n").cast("string"))).cast("string")).alias("release_id"))


def next_number(ids: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row (next): 1 + the largest number that the pattern's first group finds."""
    return ids.agg((F.coalesce(F.max(F.regexp_extract(column, pattern, 1).try_cast("bigint")), F.lit(0)) + 1).alias("next"))


def create_candidate(ledger: DataFrame, client: str) -> DataFrame:
    """The ledger with a new open candidate ``rc.<client>.NNNN``."""
    number = next_number(ledger.where(F.col("client") == client), "id", r"\.(\d+)$")
    new = number.select(
        F.concat(F.lit(f"rc.{client}."), F.lpad(F.col("next").cast("string"), 4, "0")).alias("id"), F.lit(client).alias("client"), F.current_timestamp().alias("created_at"), F.lit("open").alias("status")
    )
    return ledger.unionByName(new)


def set_status(ledger: DataFrame, candidate: str, status: str) -> DataFrame:
    """The ledger with a candidate's new status; an unknown status is an error, an unknown candidate fails when read."""
    if status not in STATUSES:
        raise ValueError(f"not a status: {status}")
    known = ledger.agg(F.coalesce(F.bool_or(F.col("id") == candidate), F.lit(False)).alias("_known"))  # one row
    new = F.when(~F.col("_known"), F.raise_error(F.lit(f"no such candidate: {candidate}")).cast("string")).when(F.col("id") == candidate, status).otherwise(F.col("status"))
    return ledger.crossJoin(F.broadcast(known)).withColumn("status", new).drop("_known")


def ledger_order(ledger: DataFrame) -> DataFrame:
    """Candidates, the newest first."""
    return ledger.orderBy(F.desc("created_at"), F.desc("id"))


def surviving(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("review_status").isin(*SURVIVING))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace those of ``table`` with their keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_pending(staged: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Pending rows give way to ``fresh`` ones; reviewed rows stay and win over fresh rows of their key."""
    reviewed = staged.where("review_status != 'pending'")
    return reviewed.unionByName(fresh.join(reviewed.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def review_errors(staged: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error): decisions that aren't known words, or name no staged row. A blank decision is none."""
    word = F.coalesce(F.lower(F.trim("decision")), F.lit(""))
    made = decisions.withColumn("_word", word).where("_word != ''")
    odd = made.where(~F.col("_word").isin("approve", "edit", "reject")).select(*keys, F.lit("unknown decision").alias("error"))
    lost = made.join(staged.select(*keys), keys, "left_anti").select(*keys, F.lit("unknown row").alias("error"))
    return odd.unionByName(lost)


def apply_review(staged: DataFrame, decisions: DataFrame, keys: list[str], editable: list[str]) -> DataFrame:
    """Staged rows with their decision's status; edits give the value of their own column of that name.

    Callers check ``review_errors`` first and write nothing if there are any."""
    word = F.coalesce(F.lower(F.trim("decision")), F.lit(""))
    made = decisions.select(*keys, word.alias("_word"), *(F.col(c).alias(f"_new_{c}") for c in editable)).where("_word != ''")
    joined = staged.join(made, keys, "left")
    status = F.when(F.col("_word") == "approve", "approved").when(F.col("_word") == "edit", "edited").when(F.col("_word") == "reject", "rejected")
    own = [F.when(F.col("_word") == "edit", F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c) if c in editable else F.col(c) for c in staged.columns if c != "review_status"]
    return joined.select(*own, F.coalesce(status, "review_status").alias("review_status"))


def reject_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of rejected parents are rejected too."""
    gone = parents.where("review_status = 'rejected'").select(key).distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("_gone"), "rejected").otherwise(F.col("review_status"))
    return children.join(gone, key, "left").withColumn("review_status", status).drop("_gone")


def violation(rows: DataFrame, severity: str, table: str, key: Column, message: Column | str) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(severity).alias("severity"), F.lit(table).alias("table"), key.cast("string").alias("key"), text.alias("message"))


def duplicates(rows: DataFrame, table: str, key: str) -> DataFrame:
    return violation(rows.groupBy(key).count().where("count > 1"), "hard", table, F.col(key), "duplicate id")


def missing_values(rows: DataFrame, table: str, key: str, required: list[str]) -> DataFrame:
    """One violation for each required column that is null."""
    names = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)), lambda x: x.isNotNull())
    return violation(rows.select(key, F.explode(names).alias("_c")), "hard", table, F.col(key), F.concat(F.lit("required column is null: "), F.col("_c")))


def missing_parents(rows: DataFrame, table: str, key: str, column: str, parents: DataFrame, parent_key: str, severity: str = "hard") -> DataFrame:
    """Rows whose non-null foreign key no parent has."""
    lost = rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti")
    return violation(lost, severity, table, F.col(key), F.concat(F.lit(f"{column} not found: "), F.col(column).cast("string")))


def numbers_without_unit(rows: DataFrame) -> DataFrame:
    """Capability rows with a capacity or discharge figure but no unit for it."""
    capacity = (F.col("capacity_min").isNotNull() | F.col("capacity_max").isNotNull()) & F.col("capacity_unit").isNull()
    pressure = (F.col("discharge_p_min").isNotNull() | F.col("discharge_p_max").isNotNull()) & F.col("pressure_unit").isNull()
    which = F.filter(F.array(F.when(capacity, F.lit("capacity")), F.when(pressure, F.lit("discharge"))), lambda x: x.isNotNull())
    return violation(rows.select("cap_id", F.explode(which).alias("_w")), "hard", "capability_row", F.col("cap_id"), F.concat(F.col("_w"), F.lit(" number without unit")))


def conflicts(rows: DataFrame, group: str = "conflict_group") -> DataFrame:
    many = rows.where(F.col(group).isNotNull()).groupBy(group).count().where("count >= 2")
    return violation(many, "warning", "conflict", F.col(group), F.concat(F.col("count").cast("string"), F.lit(" rows disagree")))


def unused(parents: DataFrame, table: str, key: str, children: list[DataFrame]) -> DataFrame:
    used = reduce(DataFrame.unionByName, [c.select(key) for c in children]).distinct()
    return violation(parents.join(used, key, "left_anti"), "warning", table, F.col(key), "not referenced")


#: Tables of a release with their natural ids, and those whose rows name a source document.
NATURAL_ID = {"document": "doc_id", "product": "product_id", "capability_row": "cap_id", "company_fact": "fact_id", "office": "office_id"}
SOURCED = ("product", "capability_row", "company_fact", "office")
#: Foreign keys (child, column, parent, parent's column) within a release.
FOREIGN_KEYS = (
    ("product_family", "source_doc_id", "document", "doc_id"), ("product", "family_id", "product_family", "family_id"), ("product", "source_doc_id", "document", "doc_id"),
    ("capability_row", "family_id", "product_family", "family_id"), ("capability_row", "source_doc_id", "document", "doc_id"), ("capability_gas", "cap_id", "capability_row", "cap_id"),
    ("company_fact", "source_doc_id", "document", "doc_id"), ("office", "source_doc_id", "document", "doc_id"), ("region_state", "office_id", "office", "office_id"),
)
#: Tables of a release, children before parents.
DELETE_ORDER = ("capability_gas", "region_state", "chunk", "product", "capability_row", "company_fact", "office", "product_family", "document", "release")


def required_columns(schema: StructType) -> list[str]:
    """Columns of a target table that may not be null, but for the release id."""
    return [f.name for f in schema if not f.nullable and f.name != "release_id"]


def provenance(rows: DataFrame, table: str, documents: DataFrame) -> DataFrame:
    """Rows without a source document and locator, and rows whose source isn't a surviving document."""
    key = NATURAL_ID[table]
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bare = empty("source_doc_id") | empty("source_locator")
    lost = rows.where(~bare).join(documents.select(F.col("doc_id").alias("source_doc_id")).distinct(), "source_doc_id", "left_anti")
    return violation(rows.where(bare), "hard", table, F.col(key), "missing source_doc_id/source_locator").unionByName(
        violation(lost, "hard", table, F.col(key), F.concat(F.lit("source is not a surviving document: "), F.col("source_doc_id").cast("string")))
    )


def unresolved_cities(offices: DataFrame, cities: DataFrame) -> DataFrame:
    """Offices whose city no state of ``cities`` (city, state, region) has."""
    city = F.upper(F.trim(F.coalesce("city", F.lit(""))))
    lost = offices.withColumn("_city", city).join(cities.select(F.col("city").alias("_city")).distinct(), "_city", "left_anti")
    return violation(lost, "hard", "office", F.col("office_id"), F.concat(F.lit("city does not resolve: "), F.coalesce("city", F.lit(""))))


def check(staged: dict[str, DataFrame], families: DataFrame, cities: DataFrame, required: dict[str, list[str]] | None = None) -> DataFrame:
    """(severity, table, key, message) of everything that stands against promoting a candidate, and of warnings.

    ``staged``: tables by name with ``review_status``; only survivors count. ``families``: the frozen list (family_id, source);
    ``cities``: (city, state, region); ``required``: columns of each table that may not be null (``required_columns``)."""
    kept = {name: surviving(rows) for name, rows in staged.items()}
    found = []
    for table, key in NATURAL_ID.items():
        if table not in kept:
            continue
        rows = kept[table]
        found.append(duplicates(rows, table, key))
        if names := [c for c in (required or {}).get(table, []) if c in rows.columns]:
            found.append(missing_values(rows, table, key, names))
        if "needs_family" in rows.columns:
            found.append(violation(rows.where("needs_family"), "hard", table, F.col(key), "needs a family"))
        if table in SOURCED and "document" in kept:
            found.append(provenance(rows, table, kept["document"]))
    named = [t for t in ("product", "capability_row") if t in kept]
    for table in named:
        found.append(missing_parents(kept[table].where("family_id != ''"), table, NATURAL_ID[table], "family_id", families, "family_id"))
    if named:
        used = [kept[t].where("family_id IS NOT NULL").select("family_id") for t in named]
        found.append(unused(families, "product_family", "family_id", used))
        if "source" in families.columns and "document" in kept:
            needed = families.join(reduce(DataFrame.unionByName, used).distinct(), "family_id", "left_semi").withColumn("_doc", T.parse_source(F.col("source"))["doc"])
            found.append(missing_parents(needed, "product_family", "family_id", "_doc", kept["document"], "doc_id").withColumn("message", F.regexp_replace("message", "^_doc", "source document")))
    if "capability_row" in kept:
        found += [numbers_without_unit(kept["capability_row"])] + ([conflicts(kept["capability_row"])] if "conflict_group" in kept["capability_row"].columns else [])
        if "capability_gas" in kept:
            found.append(missing_parents(kept["capability_gas"], "capability_gas", "cap_id", "cap_id", kept["capability_row"], "cap_id"))
    if "office" in kept:
        found.append(unresolved_cities(kept["office"], cities))
    return all_violations(*found)


def broken_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of the foreign keys among the tables of one release that are there."""
    held = [(c, col, p, k) for c, col, p, k in FOREIGN_KEYS if c in tables and p in tables and col in tables[c].columns]
    keys = {**NATURAL_ID, "product_family": "family_id", "capability_gas": "cap_id", "region_state": "state"}
    found = [missing_parents(tables[c], c, keys[c], col, tables[p], k) for c, col, p, k in held]
    return all_violations(*found)


def all_violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def diff(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, change): new, changed, superseded or same, by a full outer join; nulls are equal to nulls."""
    old = before.select(key, F.struct(*values).alias("_old"))
    new = after.select(key, F.struct(*values).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "superseded").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return old.join(new, key, "full_outer").select(key, change.alias("change"), "_old", "_new")


def promote(staged: dict[str, DataFrame], release_id: str, families: DataFrame, regions: DataFrame) -> dict[str, DataFrame]:
    """Tables of a new release: survivors; gases of surviving capability rows; families and regions that something needs."""
    kept = {name: surviving(rows) for name, rows in staged.items()}
    if "capability_gas" in kept:
        kept["capability_gas"] = kept["capability_gas"].join(kept["capability_row"].select("cap_id"), "cap_id", "left_semi")
    needed = reduce(DataFrame.unionByName, [kept[t].select("family_id") for t in ("product", "capability_row") if t in kept]).distinct()
    kept["product_family"] = families.join(needed, "family_id", "left_semi")
    if "office" in kept:
        kept["region_state"] = regions.join(kept["office"].select("office_id"), "office_id", "left_semi")
    return {name: rows.withColumn("release_id", F.lit(release_id)) for name, rows in kept.items()}


def run_promotion(
    ledger: DataFrame, candidate: str, staged: dict[str, DataFrame], families: DataFrame, regions: DataFrame, releases: DataFrame, year: int, month: int
) -> tuple[str, dict[str, DataFrame], DataFrame]:
    """(release id, its tables, the ledger after) of a candidate, or an error and nothing at all.

    In order: the ledger knows the candidate and its status allows it; the next id of the month; families that are used are in
    the frozen list; survivors, gases and regions that belong to them; every foreign key is met; the candidate is promoted."""
    stands = promotable(ledger, candidate).first()
    if stands.error:
        raise ValueError(f"cannot promote {candidate}: {stands.error}")
    name = release_id(releases, year, month).first().release_id
    listed = families
    if "source" in families.columns:
        place = T.parse_source(F.col("source"))
        listed = families.withColumns({"source_doc_id": place["doc"], "source_locator": place["locator"]}).drop("source")
    for table in ("product", "capability_row"):
        if table in staged and not missing_parents(surviving(staged[table]).where("family_id != ''"), table, NATURAL_ID[table], "family_id", families, "family_id").isEmpty():
            raise ValueError(f"cannot promote {candidate}: {table} has a family that isn't listed")
    tables = promote(staged, name, listed, regions)
    broken = broken_keys(tables).limit(5).collect()
    if broken:
        raise ValueError(f"cannot promote {candidate}: " + "; ".join(f"{b.table} {b.key}: {b.message}" for b in broken))
    docs = surviving(staged["document"]).agg(F.sort_array(F.collect_set("doc_id")).alias("documents")) if "document" in staged else None
    row = ledger.sparkSession.range(1).select(F.lit(name).alias("release_id"), F.current_timestamp().alias("built_at"), F.lit(False).alias("is_active"), F.lit(candidate).alias("candidate"))
    tables["release"] = row if docs is None else row.crossJoin(docs)
    return name, tables, set_status(ledger, candidate, "promoted")


def delete_release(tables: dict[str, DataFrame], release_id: str) -> dict[str, DataFrame]:
    """The tables without a release, children first."""
    order = [t for t in DELETE_ORDER if t in tables] + [t for t in tables if t not in DELETE_ORDER]
    return {t: tables[t].where(F.col("release_id") != release_id) for t in order}


def insert(table: DataFrame, rows: DataFrame, release_id: str | None = None) -> DataFrame:
    """``table`` with ``rows`` in its own types: missing columns are null, JSON columns take structs as text, unknown ones are an error."""
    extra = set(rows.columns) - set(table.columns)
    if extra:
        raise ValueError(f"unknown columns: {sorted(extra)}")
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}

    def cell(f):
        if f.name == "release_id" and release_id is not None:
            return F.lit(release_id).alias(f.name)
        if f.name not in kinds:
            return F.lit(None).cast(f.dataType).alias(f.name)
        packed = F.to_json(f.name) if f.dataType.typeName() == "string" and kinds[f.name] in ("struct", "map", "array") else F.col(f.name)
        return packed.cast(f.dataType).alias(f.name)

    return table.unionByName(rows.select(*(cell(f) for f in table.schema)))


def seed(tables: dict[str, DataFrame], rows: dict[str, DataFrame], release_id: str, make_active: bool = True) -> dict[str, DataFrame]:
    """Tables with a demonstration release in place of any earlier one of that id; broken foreign keys are an error."""
    left = delete_release(tables, release_id)
    new = {t: insert(tables[t], rows[t], release_id) for t in rows}
    own = {t: n.where(F.col("release_id") == release_id) for t, n in ((t, insert(tables[t].limit(0), rows[t], release_id)) for t in rows)}
    if not broken_keys(own).isEmpty():
        raise ValueError(f"the seed of {release_id} has broken keys")
    out = {t: insert(left[t], rows[t], release_id) if t in new else left[t] for t in left}
    return {**out, "release": activate(out["release"], release_id)} if make_active and "release" in out else out


#: Kinds of review columns; words for yes and no.
ARRAY_COLUMNS = ("driver", "standards", "serves_divisions", "applications")
NUMBER_COLUMNS = ("capacity_min", "capacity_max", "discharge_p_min", "discharge_p_max")
COUNT_COLUMNS = ("page_count",)
FLAG_COLUMNS = ("lubricated", "needs_family")
YES, NO = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def flag(cell: Column) -> Column:
    word = F.lower(T.strip(cell))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def listed(cell: Column) -> Column:
    """Parts between commas, trimmed, without empty ones; no cell gives none."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), ","), T.strip)
    return F.filter(parts, lambda p: p != "")


def typed(name: str, cell: Column) -> Column:
    """A review cell in its column's type; an empty cell is null (an empty list for lists), a number that isn't one an error."""
    some = F.nullif(cell, F.lit(""))
    if name in ARRAY_COLUMNS:
        return listed(cell)
    if name in FLAG_COLUMNS:
        return flag(cell)
    if name in NUMBER_COLUMNS:
        return T.strip(some).cast("double")
    return T.strip(some).cast("int") if name in COUNT_COLUMNS else some


def typed_cells(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """A review sheet with its cells in their columns' types."""
    return sheet.withColumns({c: typed(c, F.col(c)) for c in columns})


def load_prompts(versions: DataFrame, prompts: DataFrame, client: str, persona: str = "", with_persona: tuple[str, ...] = ()) -> DataFrame:
    """``versions`` (prompt_id, client_id, agent, version, is_active, body) with each prompt (agent, body) as the next, inactive one."""
    last = versions.where(F.col("client_id") == client).groupBy("agent").agg(F.max("version").alias("_last"))
    number = (F.coalesce("_last", F.lit(0)) + 1).cast("int")
    body = F.when(F.col("agent").isin(*with_persona) & (F.lit(persona) != ""), F.concat(F.lit(persona + "\n\n"), F.col("body"))).otherwise(F.col("body"))
    new = prompts.select("agent", "body").join(last, "agent", "left").select(
        F.concat_ws(".", F.lit(f"pv.{client}"), "agent", number.cast("string")).alias("prompt_id"), F.lit(client).alias("client_id"), "agent", number.alias("version"), F.lit(False).alias("is_active"), body.alias("body")
    )
    return versions.unionByName(new)


def activate_prompt(versions: DataFrame, prompt_id: str) -> DataFrame:
    """The versions with ``prompt_id`` as its agent's only active one; an unknown id fails when read."""
    chosen = versions.where(F.col("prompt_id") == prompt_id).agg(F.max("client_id").alias("_c"), F.max("agent").alias("_a"))  # one row
    wrong = F.raise_error(F.lit(f"unknown prompt: {prompt_id}")).cast("boolean")
    ours = (F.col("client_id") == F.col("_c")) & (F.col("agent") == F.col("_a"))
    on = F.when(F.col("_a").isNull(), wrong).when(ours, F.col("prompt_id") == prompt_id).otherwise(F.col("is_active"))
    return versions.crossJoin(F.broadcast(chosen)).withColumn("is_active", on).drop("_c", "_a")


def active_prompts(versions: DataFrame, files: DataFrame, client: str) -> DataFrame:
    """(agent, body, prompt_id) of every agent in ``files`` (agent, body): its active version, else its file without an id."""
    live = versions.where(F.col("is_active") & (F.col("client_id") == client)).select("agent", F.col("body").alias("_body"), "prompt_id")
    return files.select("agent", "body").join(live, "agent", "left").select("agent", F.coalesce("_body", "body").alias("body"), "prompt_id")


def conflict_groups(rows: DataFrame, family: str, value: str) -> DataFrame:
    """Rows tagged ``cg.<family>.capacity`` where a family has two distinct values at least.

    Distinct values are counted by aggregation and joined back, so no family is gathered in one place."""
    many = rows.where(F.col(value).isNotNull()).groupBy(family).agg(F.count_distinct(value).alias("_n")).where("_n >= 2")
    tagged = rows.join(many, family, "left")
    name = F.when(F.col("_n").isNotNull(), F.concat(F.lit("cg."), F.col(family).cast("string"), F.lit(".capacity")))
    return tagged.withColumn("conflict_group", name).drop("_n")


def activate_if(releases: DataFrame, release_id: str, report: DataFrame) -> DataFrame:
    """The release activated if no layer of the golden report failed; else the ledger as it was."""
    sound = report.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("_sound"))
    chosen = activate(releases, release_id).withColumnRenamed("is_active", "_new").crossJoin(F.broadcast(sound))  # one row
    old = releases.select("release_id", F.col("is_active").alias("_old"))
    return chosen.join(old, "release_id").withColumn("is_active", F.when(F.col("_sound"), F.col("_new")).otherwise(F.col("_old"))).drop("_new", "_old", "_sound")


def release_id(ledger: DataFrame, year: int, month: int) -> DataFrame:
    """One row (release_id): the next ``rYYYY.MM.N`` of a month."""
    prefix = f"r{year:04d}.{month:02d}."
    number = next_number(ledger.where(F.col("release_id").startswith(prefix)), "release_id", r"\.(\d+)$")
    return number.select(F.concat(F.lit(prefix), F.col("next").cast("string")).alias("release_id"))


def promotable(ledger: DataFrame, candidate: str) -> DataFrame:
    """(id, status, error): what stands against promoting a candidate; null if nothing does."""
    row = ledger.where(F.col("id") == candidate).agg(F.count("*").alias("n"), F.max("status").alias("status"))
    error = F.when(F.col("n") == 0, "no such candidate").when(~F.col("status").isin(*PROMOTABLE), F.concat(F.lit("not to be promoted: "), F.col("status")))
    return row.select(F.lit(candidate).alias("id"), "status", error.alias("error"))


def current(table: DataFrame, keys: list[str], at: str = "updated_at") -> DataFrame:
    """The latest row of each key of an append-only table."""
    others = [c for c in table.columns if c not in keys]
    latest = table.groupBy(*keys).agg(F.max_by(F.struct(*others), at).alias("_r"))
    return latest.select(*keys, "_r.*").select(*table.columns)
