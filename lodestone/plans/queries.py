"""Queries over the driver's tables, each with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.functions import units as U
from lodestone.operators import capability, dialog, documents, evals, evidence, grounding, html, products, release, search
from lodestone.plans import tables
from lodestone.plans.tables import assess_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ALIASES = {"h2": "hydrogen"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _matched(spark, sf, **more) -> DataFrame:
    return capability.match(tables.capabilities(spark, sf), tables.families(spark, sf), tables.gases(spark, sf), "Hydrogen", 3000, "Nm3/hr", 350, ALIASES, **more)


_LUB = "(lubricated IS NULL OR lubricated = false)"


@query(
    assess_sql(_LUB)
    + """SELECT cap_id, family_id, 'Family ' || family_id AS family_name, same_unit, near_edge, round(h1, 9) AS headroom_capacity, round(h2, 9) AS headroom_pressure,
CASE WHEN NOT same_unit THEN round_even(val, 0) END AS converted_capacity, lubricated IS NULL AS lubricated_unspecified FROM a WHERE status = 'match'"""
)
def t01_capability_match(spark: SparkSession, sf: str) -> DataFrame:
    m = _matched(spark, sf, lubricated=False).where("status = 'match'")
    return m.select("cap_id", "family_id", "family_name", "same_unit", "near_edge", F.round("headroom_capacity", 9).alias("headroom_capacity"), F.round("headroom_pressure", 9).alias("headroom_pressure"), "converted_capacity", "lubricated_unspecified")


@query(
    assess_sql(_LUB)
    + "SELECT cap_id, CASE WHEN unit IS NULL OR val IS NULL THEN 'capacity unit not comparable' END AS reason FROM a WHERE status = 'candidate'"
)
def t01_non_comparable(spark, sf):
    return _matched(spark, sf, lubricated=False).where("status = 'candidate'").select("cap_id", "reason")


@query(
    assess_sql("true")
    + ", strict AS (SELECT count(*) AS n FROM a WHERE status = 'match' AND lubricated IS NOT DISTINCT FROM false AND std = 99) SELECT cap_id, status, true AS relaxed FROM a, strict WHERE n = 0 AND status <> 'failed'"
)
def t01_relaxed(spark, sf):
    return _matched(spark, sf, lubricated=False, standard="STD-99", relax=True).select("cap_id", "status", "relaxed")


@query(assess_sql("true") + "SELECT status, count(*) AS n, sum(CASE WHEN near_edge THEN 1 ELSE 0 END) AS near FROM a GROUP BY status")
def p15_outcomes(spark, sf):
    rows = capability.candidates(tables.capabilities(spark, sf), tables.families(spark, sf), tables.gases(spark, sf), "H2", ALIASES)
    assessed = capability.assess(rows, 3000, "nm3/h", 350)
    return assessed.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("near_edge").cast("bigint")).alias("near"))


@query(
    assess_sql("true")
    + "SELECT cap_id, row_number() OVER (ORDER BY NOT same_unit, near_edge, -round((h1 + h2) / 2, 9), cap_id) AS place FROM a WHERE status = 'match' QUALIFY place <= 10"
)
def o01_best_fits(spark, sf):
    """A top-10 report."""
    rows = capability.candidates(tables.capabilities(spark, sf), tables.families(spark, sf), tables.gases(spark, sf), "H2", ALIASES)
    best = capability.assess(rows, 3000, "nm3/h", 350).where("status = 'match'")
    keys = [~F.col("same_unit"), F.col("near_edge"), (-F.round(capability.mean_headroom(), 9)).asc(), F.col("cap_id")]
    return best.orderBy(*keys).limit(10).select("cap_id", F.row_number().over(Window.orderBy(*keys)).alias("place"))


def _releases(spark, sf) -> DataFrame:
    years = table(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("release_id")).distinct()
    last = years.agg(F.max("release_id").alias("last"))
    return years.crossJoin(F.broadcast(last)).select("release_id", (F.col("release_id") == F.col("last")).alias("is_active"))


def _by_year(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("release_id", F.year("o_orderdate").cast("string"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def p01_active_view(spark, sf):
    return release.active(_by_year(spark, sf), _releases(spark, sf)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT CAST(y AS VARCHAR) AS release_id, y = (SELECT min(year(o_orderdate)) + 1 FROM orders) AS is_active FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)")
def c06_activate(spark, sf):
    first = table(spark, sf, "orders").agg((F.min(F.year("o_orderdate")) + 1).cast("string").alias("y")).first().y
    return release.activate(_releases(spark, sf), first)


@query(
    """WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT max(y) AS y FROM o), a AS (SELECT o.* FROM o, m WHERE o.y = m.y - 1), b AS (SELECT o.* FROM o, m WHERE o.y = m.y)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'superseded'
WHEN a.n = b.n AND a.total = b.total THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey"""
)
def c07_release_diff(spark, sf):
    sums = _by_year(spark, sf).groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    last = table(spark, sf, "orders").agg(F.max(F.year("o_orderdate")).alias("last"))
    of = lambda back: sums.join(F.broadcast(last), F.col("y") == F.col("last") - back).select("o_custkey", "total", "n")
    return release.diff(of(1), of(0), "o_custkey", ["total", "n"]).select("o_custkey", "change")


@query(
    """SELECT 'hard' AS severity, 'documents' AS "table", CAST(d.doc_id AS VARCHAR) AS key, 'doc_id not found: ' || d.doc_id AS message FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'hard', 'lineitem', CAST(l_linenumber AS VARCHAR), 'l_orderkey not found: ' || l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def c08_fk_closure(spark, sf):
    a = release.missing_parents(table(spark, sf, "documents"), "documents", "doc_id", "doc_id", table(spark, sf, "labels"), "doc_id")
    return a.unionByName(release.missing_parents(table(spark, sf, "lineitem"), "lineitem", "l_linenumber", "l_orderkey", table(spark, sf, "orders"), "o_orderkey"))


@query(
    """WITH cap AS (SELECT p_partkey AS cap_id, p_brand, CASE split_part(p_type, ' ', 1) WHEN 'SMALL' THEN NULL ELSE 'u' END AS unit FROM part)
SELECT 'hard' AS severity, 'capability_row' AS "table", CAST(cap_id AS VARCHAR) AS key, 'capacity number without unit' AS message FROM cap WHERE unit IS NULL
UNION ALL SELECT 'hard', 'capability_row', CAST(cap_id AS VARCHAR), 'required column is null: capacity_unit' FROM cap WHERE unit IS NULL
UNION ALL SELECT 'warning', 'conflict', p_brand, count(*) || ' rows disagree' FROM cap GROUP BY p_brand HAVING count(*) >= 2
UNION ALL SELECT 'hard', 'part', p_brand, 'duplicate id' FROM cap GROUP BY p_brand HAVING count(*) > 1"""
)
def c04_integrity_check(spark, sf):
    caps = tables.capabilities(spark, sf).withColumn("conflict_group", F.col("family_id"))
    return release.all_violations(
        release.numbers_without_unit(caps), release.missing_values(caps, "capability_row", "cap_id", ["capacity_unit", "capacity_max"]),
        release.conflicts(caps), release.duplicates(caps, "part", "family_id"),
    )


@query(
    """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 0 THEN 'edited' WHEN l.quality = 1 THEN 'approved' ELSE 'pending' END AS review_status,
CASE WHEN l.toxic = 0 AND l.quality = 0 THEN 'other' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def c03_review_apply(spark, sf):
    staged = table(spark, sf, "documents").select("doc_id", "lang", F.lit("pending").alias("review_status"))
    word = F.when(F.col("toxic") == 1, " Reject").when(F.col("quality") == 0, "EDIT").otherwise("approve ")
    decided = table(spark, sf, "labels").select("doc_id", word.alias("decision"), F.lit("other").alias("lang"))
    return release.apply_review(staged, decided, ["doc_id"], ["lang"])


@query(
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'approved' ELSE 'pending' END AS review_status, CASE WHEN l.doc_id IS NOT NULL THEN 'old' ELSE 'fresh' END AS origin
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def k05_pending_replace(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    reviewed = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit("approved").alias("review_status"), F.lit("old").alias("origin"))
    pending = docs.join(reviewed, "doc_id", "left_anti").select("doc_id", F.lit("pending").alias("review_status"), F.lit("old").alias("origin"))
    fresh = docs.select("doc_id", F.lit("pending").alias("review_status"), F.lit("fresh").alias("origin"))
    return release.replace_pending(reviewed.unionByName(pending), fresh, ["doc_id"])


@query(
    """WITH n AS (SELECT l_partkey, count(DISTINCT l_tax) AS k FROM lineitem GROUP BY l_partkey)
SELECT l_orderkey, l_linenumber, CASE WHEN k >= 2 THEN 'cg.' || l.l_partkey || '.capacity' END AS conflict_group FROM lineitem l JOIN n ON n.l_partkey = l.l_partkey"""
)
def a12_conflict_groups(spark, sf):
    return release.conflict_groups(table(spark, sf, "lineitem"), "l_partkey", "l_tax").select("l_orderkey", "l_linenumber", "conflict_group")


@query("SELECT max(CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)) + 1 AS next FROM customer")
def a02_next_sequence(spark, sf):
    return release.next_number(table(spark, sf, "customer"), "c_name", r"(\d+)$")


@query(
    """SELECT count(*) AS calls, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS skipped, sum(event_id % 1000)::BIGINT AS tokens_in, sum(event_id % 200)::BIGINT AS tokens_out, sum(event_id % 100)::BIGINT AS tokens_cached,
sum(event_id % 1000)::BIGINT + sum(event_id % 200)::BIGINT AS tokens_total, sum(event_id % 100) / sum(event_id % 1000) AS cache_rate, ((sum(event_id % 1000) - sum(event_id % 100)) * 3.0 + sum(event_id % 100) * 0.5 + sum(event_id % 200) * 15.0) / 1e3 AS cost FROM events"""
)
def a13_usage_totals(spark, sf):
    e = F.col("event_id")
    calls = table(spark, sf, "events").select((F.col("event_type") == "error").alias("skipped"), (e % 1000).alias("tokens_in"), (e % 200).alias("tokens_out"), (e % 100).alias("tokens_cached"))
    return evidence.usage(calls, 3.0, 15.0, 0.5)


@query("SELECT p_partkey AS product_id, 'model' AS matched_by FROM part WHERE lower(regexp_replace(p_name, '[\\s\\-]+', '', 'g')) = lower(regexp_replace((SELECT p_name FROM part WHERE p_partkey = 7), '[\\s\\-]+', '', 'g'))")
def t03_product_models(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("family_id"), F.col("p_name").alias("model_name"), F.lit(None).cast("string").alias("variant"))
    name = parts.where("product_id = 7").first().model_name
    return products.models(parts, name).where("matched_by = 'model'").select("product_id", "matched_by")


_BAGS = """WITH t AS (SELECT p_brand AS family_id, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS t FROM part),
b AS (SELECT family_id, list_sort(list(DISTINCT t)) AS covered FROM t WHERE t IN ('economy', 'brushed', 'steel', 'tin') GROUP BY family_id)
"""
_QUERY = "economy brushed steel tin"


def _bags(spark, sf) -> DataFrame:
    fams = tables.families(spark, sf)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("family_id"), F.col("p_type").alias("model_name"), F.lit(None).cast("string").alias("variant"))
    return products.covered(fams, parts, _QUERY)


@query(_BAGS + "SELECT family_id, array_to_string(covered, ',') AS covered FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE len(y.covered) > len(x.covered) AND list_has_all(y.covered, x.covered))")
def a16_pareto_frontier(spark, sf):
    return products.frontier(_bags(spark, sf)).select("family_id", F.array_join("covered", ",").alias("covered"))


@query(_BAGS + "SELECT family_id, array_to_string(covered, ',') AS covered FROM b")
def f08_covered_tokens(spark, sf):
    return _bags(spark, sf).select("family_id", F.array_join("covered", ",").alias("covered"))


@query(
    """SELECT n.n_nationkey, n.n_name, coalesce(string_agg(CAST(s.s_suppkey AS VARCHAR), ',' ORDER BY s.s_suppkey), '') AS products FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY ALL"""
)
def t05_list_grouped(spark, sf):
    fams = table(spark, sf, "nation").select(F.col("n_nationkey").alias("family_id"), "n_name")
    made = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("family_id"), F.col("s_suppkey").alias("product_id"))
    return products.grouped(fams, made).select(F.col("family_id").alias("n_nationkey"), "n_name", F.array_join(F.transform("products", lambda x: x.cast("string")), ",").alias("products"))


@query(
    """WITH o AS (SELECT s_suppkey AS office_id, s_name AS name, n_name AS city, r_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT office_id, name, false AS fallback FROM (SELECT *, CASE WHEN city ILIKE 'nowhere' THEN 1 WHEN region ILIKE (SELECT min(r_name) FROM region) THEN 3 ELSE 5 END AS way FROM o) ORDER BY way, office_id LIMIT 1"""
)
def t06_office_priority(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    offices = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("office_id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("region"))
    states = offices.select(F.col("city").alias("state"), "office_id")
    first = r.agg(F.min("r_name").alias("r")).first().r
    return products.office(offices, states, city="nowhere", state="no state", region=first.lower()).select("office_id", "name", "fallback")


@query("SELECT event_id AS fact_id, event_type AS kind, value FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def t07_facts_by_kind(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("fact_id"), F.col("event_type").alias("kind"), "value")
    return products.facts(e, e.agg(F.min("kind").alias("k")).first().k)


# ---- search ---------------------------------------------------------------------------------------------------

_WORDS = "thing the"


def _chunks(spark, sf) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return vectors.join(texts, "chunk_id")


def _asked(spark, sf) -> list[float]:
    return list(table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first().embedding)


_ARMS = """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id AS chunk_id, embedding, text FROM embeddings JOIN documents ON doc_id = vec_id),
d AS (SELECT chunk_id, 1 - list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS distance FROM c, q),
a AS (SELECT chunk_id, distance, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM d QUALIFY rank <= 20),
t AS (SELECT chunk_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains(['a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with'], x)) AS w FROM c),
s AS (SELECT chunk_id, len(list_filter(w, lambda x: x = 'thing')) / (1 + ln(len(w))) AS score FROM t WHERE list_contains(w, 'thing')),
b AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20)
"""


@query(_ARMS + "SELECT chunk_id, round(distance, 9) AS distance, rank FROM a")
def w01_vector_topk(spark, sf):
    return search.vector_arm(_chunks(spark, sf), _asked(spark, sf)).select("chunk_id", F.round("distance", 9).alias("distance"), "rank")


@query(_ARMS + "SELECT chunk_id, round(score, 9) AS score, rank FROM b")
def w02_text_topk(spark, sf):
    return search.text_arm(_chunks(spark, sf), _WORDS).select("chunk_id", F.round("score", 9).alias("score"), "rank")


@query(_ARMS + "SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT chunk_id, rank FROM a UNION ALL SELECT chunk_id, rank FROM b) GROUP BY chunk_id ORDER BY sum(1.0 / (60 + rank)) DESC, chunk_id LIMIT 5")
def t02_hybrid_rrf(spark, sf):
    rows = _chunks(spark, sf)
    return search.fuse(search.vector_arm(rows, _asked(spark, sf)), search.text_arm(rows, _WORDS)).select("chunk_id", F.round("score", 9).alias("score"))


# ---- documents ------------------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0)
SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS shared FROM t a JOIN t b ON a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) * 10 >= greatest(len(a.w), len(b.w)) * 9
WHERE len(list_intersect(a.w, b.w)) * 10 >= (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 9"""
)
def j14_near_duplicates(spark, sf):
    return documents.similar_pairs(table(spark, sf, "documents")).select("a", "b", F.col("shared").cast("bigint").alias("shared"))


_LINES = """WITH l AS (SELECT doc_id, source, trim(lower(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))) AS p FROM documents),
o AS (SELECT p, min(CASE WHEN source = 'src0' THEN 0 ELSE 1 END * 1000000000 + doc_id) % 1000000000 AS owner, count(DISTINCT doc_id) AS docs FROM l WHERE len(regexp_extract_all(p, '\\S+')) >= 15 GROUP BY p HAVING count(DISTINCT doc_id) >= 2)
"""


@query(_LINES + "SELECT md5(p) AS paragraph, owner, docs FROM o")
def d21_paragraph_dedup(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("source") == "src0", "pdf").otherwise("html").alias("kind"), F.explode(F.split("text", "\n")).alias("text"))
    return documents.paragraph_owners(lines).select(F.md5(F.col("paragraph").cast("binary")).alias("paragraph"), "owner", "docs")


@query("SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 200")
def d05_near_empty(spark, sf):
    return documents.near_empty(table(spark, sf, "documents"), body="text").select("doc_id")


@query()
def d01_html_to_markdown(spark, sf):
    return html.to_markdown(table(spark, sf, "pages"))


@query()
def d13_sections(spark, sf):
    pages = html.to_markdown(table(spark, sf, "pages"))
    return documents.sections(pages.select("page_id", F.col("markdown").alias("body")), id_col="page_id")


def _sections(spark, sf) -> DataFrame:
    """Documents as one section each, with a paragraph for each line."""
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("position"), F.array().cast("array<string>").alias("heading_path"), F.lit("(preamble)").alias("locator"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query()
def d23_chunks(spark, sf):
    return documents.chunks(_sections(spark, sf))


@query("SELECT page_id, length(html) > 0 AS has_text FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def d07_orphans(spark, sf):
    pages = table(spark, sf, "pages")
    return documents.orphans(pages, pages.where("page_id % 3 = 0")).select("page_id", (F.length("html") > 0).alias("has_text"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))[1] AS first_token, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n FROM documents")
def f11_tokens(spark, sf):
    words = F.array_sort(T.word_set(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.get(words, F.lit(0)).alias("first_token"), F.size(words).cast("bigint").alias("n"))


_BAG = """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?')) AS t FROM documents), n1 AS (SELECT doc_id, replace(t, ',', '') AS token, count(*) AS n FROM w GROUP BY ALL),
x AS (SELECT doc_id, unnest(regexp_extract_all(left(text, 1000), '\\d[\\d,]*(?:\\.\\d+)?')) AS t FROM documents), n2 AS (SELECT doc_id, replace(t, ',', '') AS token, count(*) AS n FROM x GROUP BY ALL)
"""


@query(_BAG + "SELECT n1.doc_id, n1.token, n1.n - coalesce(n2.n, 0) AS missing FROM n1 LEFT JOIN n2 ON n2.doc_id = n1.doc_id AND n2.token = n1.token WHERE n1.n > coalesce(n2.n, 0)")
def a14_bag_difference(spark, sf):
    """Numbers of a text that its first 1000 characters, taken as a cut conversion, lack."""
    pairs = table(spark, sf, "documents").select("doc_id", "text", F.left("text", F.lit(1000)).alias("cut"))
    return documents.missing_tokens(pairs, "doc_id", "text", "cut").where(F.col("token").rlike(r"^\d"))




@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 24.0 WHEN 1 THEN p_size / 24.0 WHEN 2 THEN p_size * 1.0 END AS converted FROM part")
def f42_convert(spark, sf):
    k = F.col("p_partkey") % 4
    source = F.when(k == 0, "NM³ / HR").when(k == 1, "scmd").when(k == 2, "CFM").otherwise("psi")
    target = F.when(k == 0, "SCMD").when(k == 1, "nm3/h").when(k == 2, "cfm").otherwise("lpm")
    return table(spark, sf, "part").select("p_partkey", U.convert(F.col("p_size"), U.capacity_unit(source), U.capacity_unit(target)).alias("converted"))


# ---- grounding and dialog -------------------------------------------------------------------------------------

_ANSWERS = """WITH u AS (SELECT l_orderkey, list(DISTINCT l_quantity) AS q FROM lineitem GROUP BY l_orderkey), a AS (SELECT o_orderkey, o_orderkey % 50 + 1 AS n, coalesce(list_contains(q, o_orderkey % 50 + 1), false) AS sourced FROM orders LEFT JOIN u ON l_orderkey = o_orderkey)
"""


def _answers(spark, sf) -> tuple[DataFrame, DataFrame]:
    n = (F.col("o_orderkey") % 50 + 1).cast("string")
    answers = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("It delivers "), n, F.lit(" Nm3/hr [1] to 7 sites.")).alias("text"), (F.col("o_orderkey") % 4).alias("n_cited"), F.lit("en").alias("language"))
    results = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("string").alias("result"))
    return answers, grounding.universe(results, "o_orderkey", "result")


@query(_ANSWERS + "SELECT o_orderkey, sourced, CASE WHEN o_orderkey % 4 = 0 OR NOT sourced THEN 'none' ELSE 'full' END AS status FROM a")
def r01_numeric_guard(spark, sf):
    answers, allowed = _answers(spark, sf)
    return grounding.gate(grounding.guard(answers, allowed, "o_orderkey")).select("o_orderkey", "sourced", "status")


@query("SELECT l_orderkey AS o_orderkey, count(DISTINCT l_quantity) AS n, min(l_quantity) AS least FROM lineitem GROUP BY l_orderkey")
def a18_universe(spark, sf):
    _, allowed = _answers(spark, sf)
    return allowed.select("o_orderkey", F.size("allowed").cast("bigint").alias("n"), F.array_min("allowed").alias("least"))


@query(_ANSWERS + "SELECT o_orderkey, CASE WHEN sourced THEN 'It delivers ' || n || ' Nm3/hr   to 7 sites.' ELSE 'It delivers …   to 7 sites.' END AS redacted FROM a")
def f51_redact(spark, sf):
    answers, allowed = _answers(spark, sf)
    return grounding.redact(answers, allowed, "o_orderkey").select("o_orderkey", "redacted")


@query("SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS history FROM conversations WHERE text <> '' AND role IN ('user', 'assistant') GROUP BY conv_id")
def r18_session_rebuild(spark, sf):
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit(0).alias("seq_in_turn"), "role", F.lit("text").alias("kind"), "text")
    shown = F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), F.length(h["text"]).cast("string")))
    return dialog.history(m).select(F.col("session_id").alias("conv_id"), F.array_join(shown, ",").alias("history"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type = 'signup' AS restated, CASE WHEN event_id % 3 = 0 THEN value END AS capacity, CASE WHEN event_id % 5 = 0 THEN event_type END AS gas FROM events),
g AS (SELECT *, sum(restated::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM e)
SELECT event_id, last_value(capacity IGNORE NULLS) OVER w AS capacity, last_value(gas IGNORE NULLS) OVER w AS gas FROM g WINDOW w AS (PARTITION BY user_id, era ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def j22_carry_forward(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("full"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("capacity"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("gas"))
    return dialog.carry_forward(e, ("capacity", "gas")).select("event_id", "capacity", "gas")


@query(
    """SELECT t.event_id, (SELECT arg_max(c.value, c.event_id) FROM events c WHERE c.user_id = t.user_id AND c.event_type = 'purchase' AND c.event_id < t.event_id) AS prior_value FROM events t WHERE t.event_type = 'view'"""
)
def j22_last_call(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "event_type", "value")
    turns = e.where("event_type = 'view'").select("event_id", "session_id", "seq")
    calls = e.where("event_type = 'purchase'").select("session_id", "seq", "value")
    return dialog.last_before(turns, calls).select("event_id", "prior_value")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq_in_turn FROM conversations")
def w03_counters(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn")
    return dialog.numbered(m, "conv_id", "turn").select("conv_id", "turn", F.col("seq_in_turn").cast("bigint").alias("seq_in_turn"))


@query(
    """SELECT event_id, CASE WHEN (event_id % 10) / 10.0 < 0.6 THEN 'clarify' WHEN event_id % 7 = 0 THEN 'deflect' WHEN event_type = 'view' THEN 'product_advisor' WHEN event_type = 'purchase' THEN 'commercial_routing' ELSE 'deflect' END AS route FROM events"""
)
def r07_route(spark, sf):
    intent = F.when(F.col("event_type") == "view", "product_question").when(F.col("event_type") == "purchase", "commercial").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", dialog.route(intent, F.col("event_id") % 10 / 10, F.col("event_id") % 7 != 0).alias("route"))


@query(
    """WITH r AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'retrieval' ELSE 'e2e' END AS layer, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 1 THEN 'flaky' WHEN toxic = 1 THEN 'na' ELSE 'fail' END AS status FROM labels)
SELECT layer, count(*) FILTER (status = 'pass') AS "pass", count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'flaky') AS flaky, count(*) FILTER (status = 'na') AS na, count(*) FILTER (status = 'fail') = 0 AS ok FROM r GROUP BY layer"""
)
def e04_eval_report(spark, sf):
    layer = F.element_at(F.array(F.lit("fact"), F.lit("retrieval"), F.lit("e2e")), (F.col("doc_id") % 3 + 1).cast("int"))
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").when(F.col("quality") == 1, "flaky").when(F.col("toxic") == 1, "na").otherwise("fail")
    return evals.report(table(spark, sf, "labels").select(layer.alias("layer"), status.alias("status")))


@query(
    """WITH c AS (SELECT l_orderkey AS answer_id, l_linenumber AS position, CASE WHEN l_linenumber % 2 = 0 THEN 'part' ELSE 'supplier' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS ref_id FROM lineitem),
p AS (SELECT 'part' AS kind, p_partkey AS ref_id, p_brand AS doc_id FROM part UNION ALL SELECT 'supplier', s_suppkey, CAST(s_nationkey AS VARCHAR) FROM supplier),
j AS (SELECT answer_id, doc_id, min(position) AS first FROM c JOIN p ON p.kind = c.kind AND p.ref_id = c.ref_id GROUP BY ALL)
SELECT answer_id, doc_id, row_number() OVER (PARTITION BY answer_id ORDER BY first, doc_id) AS position FROM j"""
)
def q_source_resolution(spark, sf):
    line = table(spark, sf, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    cited = line.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("position"), F.when(even, "part").otherwise("supplier").alias("kind"), F.when(even, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("ref_id"))
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    places = part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("doc_id"), F.lit("p2 §A").alias("locator")).unionByName(
        supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("ref_id"), F.col("s_nationkey").cast("string").alias("doc_id"), F.lit("§B").alias("locator"))
    )
    docs = places.select("doc_id").distinct().select("doc_id", F.lit("pdf").alias("kind"), F.lit("").alias("title"), F.concat(F.lit("http://x/"), "doc_id", F.lit(".pdf")).alias("url"))
    return grounding.sources(cited, places, docs).select("answer_id", "doc_id", F.col("position").cast("bigint").alias("position"))


@query("SELECT count(*) AS chunks FROM embeddings HAVING count(*) = count(DISTINCT vec_id)")
def a01_parity(spark, sf):
    """Embedded rows, if there is one for each id."""
    return table(spark, sf, "embeddings").agg(F.count("*").alias("chunks"), F.count_distinct("vec_id").alias("ids")).where("chunks = ids").select("chunks")


@query("SELECT page_id, CASE WHEN lower(regexp_replace(url, '[?#].*$', '')) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS kind, regexp_replace(url, '#.*$', '') AS canonical FROM pages")
def f13_url_forms(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_kind(F.col("url")).alias("kind"), T.canonical_url(F.col("url")).alias("canonical"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return t01_capability_match(spark, sf)
