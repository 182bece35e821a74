"""Product resolution in tiers, listings, offices and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T


def models(products: DataFrame, query: str) -> DataFrame:
    """Products whose model is the query, then siblings: same series and a shared number, in model or variant."""
    q = F.lit(query)
    series, wanted = T.model_series(q), T.model_numbers(q)

    def sibling(field: str):
        numbers = T.model_numbers(F.col(field))
        shared = F.size(F.array_intersect(numbers, wanted))
        ok = (T.model_series(F.col(field)) == series) & (series != "") & (shared > 0)
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(1).alias("tier"), (-shared).alias("shared"), F.size(numbers).alias("numbers")))

    exact = F.when(T.alias_form(F.col("model_name")) == T.alias_form(q), F.struct(F.lit(0).alias("tier"), F.lit(0).alias("shared"), F.lit(0).alias("numbers")))
    ranked = products.withColumn("fit", F.coalesce(exact, sibling("model_name"), sibling("variant"))).where("fit IS NOT NULL")
    return ranked.select(*products.columns, F.when(F.col("fit.tier") == 0, "model").otherwise("model_variant").alias("matched_by"), "fit")


def covered(families: DataFrame, products: DataFrame, query: str) -> DataFrame:
    """(family_id, name, covered): query tokens in the name of a family or in models and variants of its products."""
    own = families.select("family_id", T.name_tokens(F.col("name")).alias("t"))
    made = products.select("family_id", F.array_union(T.name_tokens(F.col("model_name")), T.name_tokens(F.col("variant"))).alias("t"))
    wanted = T.name_tokens(F.lit(query))
    hits = own.unionByName(made).select("family_id", F.explode(F.array_intersect("t", wanted)).alias("t"))
    bags = hits.groupBy("family_id").agg(F.sort_array(F.collect_set("t")).alias("covered"))
    return bags.join(families.select("family_id", "name"), "family_id")


def frontier(bags: DataFrame) -> DataFrame:
    """Families whose covered tokens aren't a strict subset of another family's.

    Families with the same tokens stand or fall together, so only distinct token sets are compared. They are subsets
    of one query's tokens, hence few whatever the number of families."""
    sets = bags.select("covered").distinct()
    other = sets.withColumnRenamed("covered", "wider")
    beaten = sets.join(F.broadcast(other), (F.size(F.array_except("covered", "wider")) == 0) & (F.size("wider") > F.size("covered")), "left_semi")
    return bags.join(beaten, "covered", "left_anti")


def resolve(families: DataFrame, products: DataFrame, query: str, most: int = 4) -> DataFrame:
    """(tier, matched_by, family_id, product_id, position) of the first tier that has rows.

    Tiers: models; a family's id or name; the only family on the frontier, or an ambiguous few (2 to ``most``)."""
    ranked = models(products, query)
    kind = ranked.agg(F.min("matched_by").alias("matched_by"))  # one row: 'model' sorts before 'model_variant'
    # A place by counting better rows would join all to all; the few rows of one query's models are ordered as a whole.
    place = F.struct("fit.tier", "fit.shared", "fit.numbers", "product_id", "family_id")
    listed_models = ranked.agg(F.array_sort(F.collect_list(place)).alias("rows")).crossJoin(F.broadcast(kind)).select("matched_by", F.posexplode("rows").alias("i", "r"))
    found = listed_models.select(F.lit(1).alias("tier"), "matched_by", "r.family_id", "r.product_id", (F.col("i") + 1).alias("position"))
    key = T.alias_form(F.lit(query))
    named = families.where((T.alias_form(F.col("family_id")) == key) | (T.alias_form(F.col("name")) == key)).select("family_id")
    best = frontier(covered(families, products, query)).select("family_id")
    n = best.agg(F.count("*").alias("n"))
    few = best.crossJoin(F.broadcast(n)).where(F.col("n") <= most)

    def listed(fams: DataFrame, tier: int, label):
        rows = fams.select("family_id", label.alias("matched_by")).join(products.select("family_id", "product_id"), "family_id", "left")
        shown = F.when(F.col("product_id").isNull() & (F.col("matched_by") != "ambiguous"), "family_envelope").otherwise(F.col("matched_by"))
        position = F.row_number().over(Window.partitionBy("family_id").orderBy("product_id"))
        return rows.select(F.lit(tier).alias("tier"), shown.alias("matched_by"), "family_id", F.when(shown != "ambiguous", F.col("product_id")).alias("product_id"), F.when(shown != "ambiguous", position).otherwise(1).alias("position")).distinct()

    every = found.unionByName(listed(named, 2, F.lit("family"))).unionByName(listed(few, 3, F.when(F.col("n") == 1, "family_contains").otherwise("ambiguous")))
    first = every.agg(F.min("tier").alias("first"))
    return every.crossJoin(F.broadcast(first)).where("tier = first").drop("first")


def grouped(families: DataFrame, products: DataFrame, division: str | None = None, category: str | None = None) -> DataFrame:
    """Families with the sorted list of their products, empty where there are none."""
    kept = families
    if division is not None:
        kept = kept.where(F.col("division") == division)
    if category is not None:
        kept = kept.where(F.col("category").ilike(category))
    lists = products.groupBy("family_id").agg(F.sort_array(F.collect_list("product_id")).alias("products"))
    empty = F.array().cast(lists.schema["products"].dataType)
    return kept.join(lists, "family_id", "left").withColumn("products", F.coalesce("products", empty))


def envelopes(capabilities: DataFrame, gases: DataFrame) -> DataFrame:
    """Capability rows of families, each with its sorted gases (empty where there are none)."""
    lists = gases.groupBy("cap_id").agg(F.sort_array(F.collect_set("gas")).alias("gases"))
    return capabilities.join(lists, "cap_id", "left").withColumn("gases", F.coalesce("gases", F.array().cast("array<string>")))


def office(offices: DataFrame, states: DataFrame, city: str | None = None, state: str | None = None, region: str | None = None, head: str = "head", head_city: str = "noida") -> DataFrame:
    """The office for a city, else a state, else a region, else the head office (then ``fallback``).

    Arguments are patterns without regard to case, as in ILIKE."""
    plain = offices.select("*", F.lit(None).cast("int").alias("_way"))
    ways = []
    if city is not None:
        ways.append(plain.where(F.col("city").ilike(city)).withColumn("_way", F.lit(1)))
    if state is not None:
        of_state = states.where(F.col("state").ilike(state)).select("office_id").distinct()
        ways.append(plain.join(of_state, "office_id", "left_semi").withColumn("_way", F.lit(2)))
    if region is not None:
        ways.append(plain.where(F.col("region").ilike(region)).withColumn("_way", F.lit(3)))
    ways.append(plain.withColumn("_way", F.when(F.lower("name").contains(head) | F.col("city").ilike(head_city), 4).otherwise(5)))
    every = ways[0]
    for w in ways[1:]:
        every = every.unionByName(w)
    return every.orderBy("_way", "office_id").limit(1).withColumn("fallback", F.col("_way") >= 4).drop("_way")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, null left out."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct()


def catalogue(families: DataFrame) -> DataFrame:
    """One row (text): the frozen families as lines ``id: name``, by id. Families are a dimension of a few hundred rows."""
    line = F.concat_ws(": ", "family_id", "name")
    return families.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


def facts(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).orderBy("fact_id")
