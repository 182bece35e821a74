"""More queries over the driver's tables, each with DuckDB SQL that says the same: texts, dialog, grounding, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import units as U
from lodestone.operators import dialog, documents, evals, evidence, grounding, products, release, search
from lodestone.plans import tables
from lodestone.plans.queries import _ARMS, _WORDS, _asked, query
from lodestone.plans.tables import table
from lodestone.sources import readers, sinks

md5 = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
text_ = lambda c: F.col(c).cast("string")

# ---- text -----------------------------------------------------------------------------------------------------

_SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5(coalesce({_SQUEEZED}, '')) AS squeezed, md5(coalesce(lower({_SQUEEZED}), '')) AS paragraph FROM documents")
def f04_text_forms(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", md5(T.squeeze(t)).alias("squeezed"), md5(T.paragraph_form(t)).alias("paragraph"))


@query("SELECT doc_id, md5(coalesce(replace(replace(nfc_normalize(text), chr(160), ' '), chr(8203), ''), '')) AS clean FROM documents")
def f01_clean_unicode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md5(T.clean_unicode(F.col("text"))).alias("clean"))


@query("SELECT doc_id, md5(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) <> 1 OR trim(l) = '|'), chr(10)), '')) AS tidy FROM documents")
def f02_tidy_markdown(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md5(T.tidy_markdown(F.col("text"))).alias("tidy"))


_STEM = "regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '([^/]*)$', 1)"


@query(
    f"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace({_STEM}, '(?i)\\.pdf$', ''), '(?i)\\.html?$', ''), '(?i)\\.php$', '')), ''), 'Document') AS title FROM pages"
)
def f14_title_from_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.title_from_url(F.col("url")).alias("title"))


@query("SELECT page_id, 'doc.' || trim(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '([^/]*)/?$', 1), '(.)\\.[^.]*$', '\\1')), '[^a-z0-9]+', '_', 'g'), '_') AS id FROM pages WHERE url LIKE '%/_%'")
def f12_document_ids(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").like("%/_%")).select("page_id", T.doc_id(F.col("url")).alias("id"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 4 THEN NULL END AS page_start, CASE p_partkey % 5 WHEN 0 THEN p_size + 2 END AS page_end,
CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN NULL WHEN 2 THEN p_name WHEN 3 THEN p_brand || ' › ' || p_type ELSE p_brand END AS heading FROM part"""
)
def f17_parse_locator(spark, sf):
    k, n = F.col("p_partkey") % 5, text_("p_size")
    locator = (
        F.when(k == 0, F.concat(F.lit("P"), n, F.lit(" – "), (F.col("p_size") + 2).cast("string"), F.lit(" § "), F.col("p_brand"))).when(k == 1, F.concat(F.lit("p"), n))
        .when(k == 2, F.concat(F.lit(" "), F.col("p_name"))).when(k == 3, F.concat(F.lit("§"), F.col("p_brand"), F.lit(" › "), F.col("p_type"))).otherwise(F.concat(F.lit("sheet p"), n, F.lit(" §a §"), F.col("p_brand")))
    )
    return table(spark, sf, "part").select("p_partkey", T.parse_locator(locator).alias("l")).select("p_partkey", "l.*")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_brand END AS doc, CASE p_partkey % 4 WHEN 0 THEN '§' || p_type WHEN 1 THEN NULL WHEN 2 THEN 'page ' || p_size END AS locator FROM part"""
)
def f20_parse_source(spark, sf):
    k, brand = F.col("p_partkey") % 4, F.col("p_brand")
    source = F.when(k == 0, F.concat(brand, F.lit(" § "), F.col("p_type"), F.lit(" ; other §x"))).when(k == 1, F.concat(F.lit(" "), brand, F.lit(" "))).when(k == 2, F.concat(brand, F.lit("  page "), text_("p_size")))
    return table(spark, sf, "part").select("p_partkey", T.parse_source(source).alias("s")).select("p_partkey", "s.*")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'u#page=' || p_size ELSE 'u' END AS link, CASE WHEN p_size % 2 = 0 THEN 'p. ' || p_size || CASE WHEN p_size % 4 = 0 THEN '–' || (p_size + 1) ELSE '' END || ' — ' || p_brand ELSE p_brand END AS location,
CASE WHEN p_size % 4 = 0 THEN 'p' || p_size || '-' || (p_size + 1) || ' §' || p_brand || ' › x' ELSE 'p' || p_size || ' (preamble)' END AS locator FROM part"""
)
def f18_links_and_locations(spark, sf):
    n = F.col("p_size").cast("int")
    kind, end = F.when(n % 2 == 0, "pdf").otherwise("web"), F.when(n % 4 == 0, n + 1).otherwise(n)
    path = F.when(n % 4 == 0, F.array(F.col("p_brand"), F.lit("x")))
    return table(spark, sf, "part").select("p_partkey", T.link(F.lit("u"), kind, n).alias("link"), T.location(kind, n, end, F.col("p_brand")).alias("location"), T.section_locator(path, n, end).alias("locator"))


@query("SELECT o_orderkey, replace(printf('%.1f', round(o_totalprice)), '.0', '') AS digits, o_orderkey % 3 = 0 AS said FROM orders")
def f21_digits_and_f22_says(spark, sf):
    whole = F.round("o_totalprice").cast("bigint")
    printed = F.concat(F.format_number(whole, 0), F.lit(".0"))
    needle = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("PRICE "), whole.cast("string"))).otherwise(F.lit("nothing"))
    return table(spark, sf, "orders").select("o_orderkey", T.normal_digits(printed).alias("digits"), T.says(F.concat(F.lit("price "), printed), needle).alias("said"))


@query("SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{5,}|api[\\s\\-]?\\d+|\\d[\\d,\\.]*'), lambda t: replace(t, ',', '')))) AS n FROM documents")
def f30_content_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.content_tokens(F.col("text"))).cast("bigint").alias("n"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE coalesce(text, '') END) AS cut, trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def f28_truncate_and_f15_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md5(T.truncate(F.col("text"), 80)).alias("cut"), T.slug(F.col("source")).alias("slug"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' — ' || left(p_type, 60) ELSE 'product' END AS shown FROM part")
def f10_display_name(spark, sf):
    k, empty = F.col("p_partkey") % 3, F.lit("")
    return table(spark, sf, "part").select("p_partkey", T.display_name(F.when(k == 0, F.col("p_name")).otherwise(empty), F.when(k == 1, F.col("p_brand")), empty, F.when(k == 1, F.concat(F.col("p_type"), F.lit("\nmore")))).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, 'tr' || l_linenumber || ',tr' || l_suppkey AS ids FROM lineitem WHERE l_linenumber <> l_suppkey")
def f29_citation_ids(spark, sf):
    raw = F.concat(F.lit("[tr"), text_("l_linenumber"), F.lit("] and tr"), text_("l_suppkey"), F.lit(", tr"), text_("l_linenumber"))
    return table(spark, sf, "lineitem").where("l_linenumber != l_suppkey").select("l_orderkey", "l_linenumber", F.array_join(T.citation_ids(raw), ",").alias("ids"))


_BODY = "array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT regexp_matches(l, '^\\s*\\|.*\\|\\s*$')), chr(10))"
_LINKS = "'\\[([^\\]]*)\\]\\(([^)]*)\\)'"


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, CAST(len(list_filter(regexp_extract_all(regexp_replace({_BODY}, {_LINKS}, ' ', 'g'), '\\S+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, {_LINKS})) AS BIGINT) AS links FROM d)
SELECT *, CASE WHEN words < 40 AND links >= 8 THEN 'reference_only' WHEN words < 40 THEN 'excluded' ELSE 'chunk' END AS disposition FROM w"""
)
def d20_disposition(spark, sf):
    found = documents.dispositions(table(spark, sf, "documents"), body="text")
    return found.select("doc_id", F.col("words").cast("bigint").alias("words"), F.col("links").cast("bigint").alias("links"), "disposition")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size * 10.0 WHEN 2 THEN p_size * 1.0 END AS low, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 100.0 WHEN 2 THEN p_size * 1.0 END AS high,
CASE p_partkey % 4 WHEN 0 THEN 'Nm3/hr' WHEN 1 THEN 'SCMD' WHEN 2 THEN 'Nm3/hr' END AS unit FROM part"""
)
def f43_range_parse(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    phrase = (
        F.when(k == 0, F.concat(F.lit("Up to "), F.format_number(n * 1000, 0), F.lit(" Nm3/hr"))).when(k == 1, F.concat((n * 10).cast("string"), F.lit("–"), (n * 100).cast("string"), F.lit(" SCMD")))
        .when(k == 2, F.concat(n.cast("string"), F.lit(" nm3/h"))).otherwise("no figure")
    )
    return table(spark, sf, "part").select("p_partkey", U.parse_capacity(phrase).alias("r")).select("p_partkey", F.col("r.min").alias("low"), F.col("r.max").alias("high"), F.col("r.unit").alias("unit"))


# ---- detectors and dialog -------------------------------------------------------------------------------------

_SAYINGS = (
    "need oilless, to API 618", "supply EN route", "EN 10204 lubricated", "capacity is 3000", "Non-lube per is 3000", "3,000 Nm3/hr at 350 bar", "500 scmd", "20 psi and 7 cfm",
    "who founded it and do you export", "ISO certified plant", "which sectors, email?", "send the brochure", "a data sheet or manual", "I want to be a distributor", "price please",
    "We don't have that", "not listed in", "no results, try again", "there aren't any matches", "Which gas?\n\nSources: none", "Source: [ ]", "Sources: doc.a", "the branch in the north", "head office?",
)


def _sayings(spark, sf) -> DataFrame:
    """Conversation turns, each with a phrase of the kind that the detectors look for behind its text."""
    said = F.element_at(F.array(*map(F.lit, _SAYINGS)), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(_SAYINGS))) + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", said).alias("text"))


_TURNS = "WITH s AS (SELECT conv_id, turn, concat_ws(' ', text, (ARRAY[" + ", ".join("'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for s in _SAYINGS) + f"])[(conv_id * 7 + turn) % {len(_SAYINGS)} + 1]) AS t FROM conversations)\n"


def _any(words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in words.split(",")) + ")"


@query(
    _TURNS
    + r"""SELECT conv_id, turn, regexp_matches(t, '(?i)oil[\s-]?free|oil[\s-]?less|non[\s-]?lube|lube|lubric') AS lubrication,
regexp_matches(t, '(?i)\b(?:api|iso|asme|atex|ped|nfpa|eiga|din|ansi|iec)\b') OR regexp_matches(t, '\b(?:EN|IS|BS|BIS)[\s-]?\d') AS standard,
regexp_matches(t, '(?i)\d[\d,\.]*\s*(?:n\s*m\s*3\s*/?\s*hr?|nm³|scmd|scmh|kg\s*/\s*hr|m3\s*/\s*hr|m³/\s*hr|lpm|cfm|tpd)') AND regexp_matches(t, '(?i)\d[\d,\.]*\s*(?:barg|bar|psi)') AS duty FROM s"""
)
def f26_mentions(spark, sf):
    t = F.col("text")
    return _sayings(spark, sf).select("conv_id", "turn", dialog.mentions_lubrication(t).alias("lubrication"), dialog.mentions_standard(t).alias("standard"), dialog.states_full_duty(t).alias("duty"))


_KINDS = {
    "certification": "certif,iso,accredit", "founder": "founder,founded,who found,started by,who is behind", "founded": "founded,establish,since,how old,which year,when was",
    "facility": "facilit,manufactur,plant,factory", "coverage": "coverage,countr,export,middle east,abroad,overseas,presence", "client": "client,customer", "industry_served": "industr,sector", "contact": "contact,email,phone",
}


@query(
    _TURNS
    + "SELECT conv_id, turn, concat_ws(',', "
    + ", ".join(f"CASE WHEN {_any(w)} THEN '{k}' END" for k, w in _KINDS.items())
    + f") AS kinds, {_any('catalog,download,datasheet,data sheet,brochure,leaflet,pdf,document,spec sheet,spec-sheet,manual')} AS document, CASE WHEN {_any('dealer,distributor,reseller,channel partner')} THEN 'dealer' ELSE 'commercial' END AS lead FROM s"
)
def f25_keywords(spark, sf):
    t = F.col("text")
    return _sayings(spark, sf).select("conv_id", "turn", F.array_join(dialog.question_kinds(t), ",").alias("kinds"), dialog.wants_document(t).alias("document"), dialog.lead_type(t).alias("lead"))


@query(
    _TURNS
    + r"""SELECT conv_id, turn, regexp_matches(t, '(?i)don''?t have|do not have|not in (our|the) published|can''?t confirm|cannot confirm|couldn''?t find|could not find|no (published )?(information|details|record|data)|not (available|listed|published) in') AS absent,
regexp_matches(t, '(?i)not getting any results|no results|no (matching )?(documents?|records?|data|information)|problem with the (search )?tool|couldn''?t find|could not find|don''?t have (any|that|it)|no such|aren''?t any (documents?|results?|matches)|try (again|rephrasing|a different)') AS denied,
md5(rtrim(regexp_replace(t, '(?i)\n*[ \t]*sources?[ \t]*:[ \t]*(\[[ \t]*\]|none)$', ''), ' ' || chr(10) || chr(9) || chr(13))) AS shown FROM s"""
)
def f24_absence(spark, sf):
    t = F.col("text")
    return _sayings(spark, sf).select("conv_id", "turn", dialog.claims_absence(t).alias("absent"), dialog.denies_match(t).alias("denied"), md5(dialog.without_empty_sources(t)).alias("shown"))


@query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'diving' WHEN 'click' THEN 'unknown' ELSE 'unknown' END AS division, CASE event_type WHEN 'purchase' THEN 'out_of_scope' WHEN 'view' THEN 'documents' ELSE 'faq' END AS intent,
CASE WHEN event_id % 2 = 0 THEN 'hi' ELSE 'en' END AS language, event_type <> 'purchase' AND event_id % 5 <> 0 AS in_scope, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE least(1.0, (event_id % 20) / 10.0) END AS confidence FROM events"""
)
def r08_triage(spark, sf):
    e, k = F.col("event_type"), F.col("event_id")
    raw = table(spark, sf, "events").select(
        "event_id", F.when(e == "view", "diving").when(e == "click", "space").alias("division"), F.when(e == "purchase", "out_of_scope").when(e == "view", "documents").otherwise("chat").alias("intent"),
        F.when(k % 2 == 0, "hi").otherwise("klingon").alias("language"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("in_scope"), F.lit(None).cast("boolean").alias("pii_present"),
        F.when(k % 3 == 0, "high").otherwise((k % 20 / 10).cast("string")).alias("confidence"),
    )
    return dialog.triage(raw).select("event_id", "division", "intent", "language", "in_scope", "confidence")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'gas' WHEN l_linenumber IN (2, 3) THEN 'capacity' WHEN l_linenumber = 4 THEN 'discharge_p' END AS duty,
CASE WHEN l_linenumber = 1 THEN 'model' WHEN l_linenumber = 2 THEN 'serial_or_year' WHEN l_linenumber = 3 THEN 'site_city' WHEN l_linenumber < 6 THEN 'need' WHEN l_linenumber = 6 THEN 'contact_pref' ELSE 'contact_detail' END AS service FROM lineitem"""
)
def r09_first_missing(spark, sf):
    from_line = lambda n, name: F.when(F.col("l_linenumber") > n, F.lit("x")).alias(name)
    named = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *(from_line(n, c) for n, c in ((1, "gas"), (2, "capacity"), (3, "capacity_unit"), (4, "discharge_p"))),
        *(from_line(n, c) for n, c in ((1, "model"), (2, "serial_or_year"), (3, "site_city"), (5, "need"), (6, "contact_pref"), (7, "contact_detail"))),
    )
    return named.select("l_orderkey", "l_linenumber", dialog.first_missing_duty().alias("duty"), dialog.first_missing().alias("service"))


@query(
    """WITH n AS (SELECT s_suppkey AS id, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT id, CASE id % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'state' WHEN 2 THEN 'region' ELSE 'head_office' END AS way,
CASE id % 4 WHEN 0 THEN (SELECT min(m.n_name) FROM nation m WHERE contains(lower(n.n_name), lower(m.n_name))) WHEN 1 THEN (SELECT min(r_name) FROM region r WHERE contains('europe', lower(r_name))) WHEN 2 THEN 'North' END AS place FROM n"""
)
def j16_office_place(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey") % 4
    asked = F.when(k == 0, F.concat(F.lit("Which office covers "), F.col("n_name"), F.lit("?"))).when(k == 1, "branch in Europe").when(k == 2, "the northern office").otherwise("Where is the head office?")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("id"), asked.alias("text"))
    return dialog.office_place(rows, n.select(F.col("n_name").alias("city")), table(spark, sf, "region").select(F.col("r_name").alias("state")))


@query(
    """SELECT d.doc_id, string_agg(b.name, ',' ORDER BY b.name) AS names FROM documents d JOIN (SELECT DISTINCT lower(left(text, 6)) AS name FROM benchmark UNION SELECT DISTINCT left(lang, 2) || ' ' FROM documents) b ON contains(lower(d.text), b.name) GROUP BY d.doc_id"""
)
def j15_names_in_texts(spark, sf):
    docs = table(spark, sf, "documents")
    names = table(spark, sf, "benchmark").select(F.lower(F.left("text", F.lit(6))).alias("name")).union(docs.select(F.concat(F.left("lang", F.lit(2)), F.lit(" "))))
    found = dialog.containing(docs.select("doc_id", F.lower("text").alias("low")), "doc_id", "low", names.distinct(), "name")
    return found.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query(
    """SELECT l_orderkey, l_linenumber, o_custkey AS session_id, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 2 = 0"""
)
def j08_session_calls(spark, sf):
    calls = table(spark, sf, "lineitem").select("l_linenumber", "l_partkey", F.col("l_orderkey").alias("inv_id"), F.when(F.col("l_linenumber") % 2 == 0, "match_capability").otherwise("get_office").alias("tool"))
    o = table(spark, sf, "orders")
    invocations, turns = o.select(F.col("o_orderkey").alias("inv_id"), F.col("o_orderkey").alias("turn_id")), o.select(F.col("o_orderkey").alias("turn_id"), F.col("o_custkey").alias("session_id"), F.lit(1).alias("seq"))
    return dialog.session_calls(calls, invocations, turns, "match_capability").select(F.col("inv_id").alias("l_orderkey"), "l_linenumber", "session_id", "l_partkey")


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'h2' END AS gas, CASE WHEN event_id % 2 = 0 THEN value ELSE 7.0 END AS capacity,
CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN NULL WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'cfm' ELSE 'scmd' END AS capacity_unit FROM (SELECT event_id, value FROM events)"""
)
def r10_follow_up(spark, sf):
    k = F.col("event_id")
    turns = table(spark, sf, "events").select(
        "event_id", F.when(k % 3 == 0, "make it 500 cfm").otherwise("and more?").alias("text"),
        F.when(k % 4 == 2, "h2").alias("gas"), F.when(k % 2 == 0, F.col("value")).alias("capacity"), F.when(k % 4 == 0, "cfm").alias("capacity_unit"), F.lit(None).cast("double").alias("discharge_p"),
        F.lit(None).cast("boolean").alias("lubricated"), F.lit(None).cast("string").alias("standard"),
        F.when(k % 4 != 0, "h2").alias("prior_gas"), F.lit(7.0).alias("prior_capacity"), F.lit("scmd").alias("prior_capacity_unit"), F.lit(1.0).alias("prior_discharge_p"), F.lit(True).alias("prior_lubricated"), F.lit("x").alias("prior_standard"),
    )
    return dialog.follow_up(turns).select("event_id", "gas", "capacity", "capacity_unit")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS said, string_agg(md5(text), ',' ORDER BY turn) FILTER (role = 'user') AS texts FROM conversations GROUP BY conv_id")
def h19_user_texts(spark, sf):
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit(0).alias("seq_in_turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    own = dialog.user_texts(m)
    return own.select(F.col("session_id").alias("conv_id"), F.size("texts").cast("bigint").alias("said"), F.nullif(F.array_join(F.transform("texts", md5), ","), F.lit("")).alias("texts"))


# ---- grounding and evaluation ---------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT l_orderkey, 2 * (row_number() OVER w - 1) AS i, 'product' AS kind, CAST(l_partkey AS VARCHAR) AS ref_id FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))
UNION ALL SELECT l_orderkey, 2 * (row_number() OVER w - 1) + 1, 'family', p_brand FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)))
SELECT l_orderkey AS answer_id, kind, ref_id, min(i) AS i FROM c GROUP BY ALL"""
)
def r02_derived_citations(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", F.struct(text_("l_partkey").alias("product_id"), F.col("p_brand").alias("family_id")).alias("p"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))), lambda x: x["p"])
    calls = rows.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.to_json(F.struct(listed.alias("products"))).alias("result"))
    found = grounding.derive_citations(calls.select("answer_id", F.lit(1).alias("position"), F.lit("list_products").alias("tool"), "result", F.lit("x").alias("answer")))
    return found.select("answer_id", "kind", "ref_id", F.col("i").cast("bigint").alias("i"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS used, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS number FROM customer")
def r04_value_used(spark, sf):
    k = F.col("c_custkey")
    answer = F.concat(F.when(k % 2 == 0, "Founded by the Makers").otherwise("since"), F.when((k % 2 == 0) | (k % 3 == 0), " 25000").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", grounding.value_used(answer, F.lit("makers of x")).alias("used"), grounding.value_used(answer, F.lit("25,000")).alias("number"))


@query(
    """WITH f AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey) AS found FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'na' WHEN list_contains(coalesce(found, []), o_custkey % 50 + 1) THEN 'pass' ELSE 'fail' END AS status FROM orders LEFT JOIN f ON id = o_orderkey"""
)
def e01_fact_layer(spark, sf):
    found = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(text_("l_partkey")).alias("found"))
    expected = F.when(F.col("o_orderkey") % 5 != 0, F.array((F.col("o_custkey") % 50 + 1).cast("string")))
    return table(spark, sf, "orders").join(found, F.col("o_orderkey") == F.col("id"), "left").select(F.col("o_orderkey").alias("id"), evals.fact_layer(expected, F.col("found")).alias("status"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'na' WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' ELSE 'pass' END AS retrieval, CASE o_orderkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'flaky' ELSE 'fail' END AS e2e FROM orders"""
)
def e02_e03_layers(spark, sf):
    k = F.col("o_orderkey")
    none, word = F.lit(None).cast("string"), lambda c: F.array(F.lit(c))
    chunks = F.array(F.struct(F.lit("c1").alias("chunk_id"), F.lit("p4 §Pumps").alias("locator"), F.lit("d1").alias("doc_id")))
    retrieval = evals.retrieval_layer(chunks, F.when(k % 4 == 1, word("c1")).when(k % 4 == 2, word("c9")), F.when(k % 4 == 3, "Pumps"), none)
    errors = lambda said: evals.e2e_errors(F.lit("answer"), F.lit("answer"), said, word("25000"), word("guess"))
    first, second = F.when(k % 3 == 0, "25,000 bar").otherwise("a guess"), F.when(k % 3 == 1, "२५००० bar").otherwise("25000, a guess")
    return table(spark, sf, "orders").select(k.alias("id"), retrieval.alias("retrieval"), evals.e2e_layer(errors(first), errors(second)).alias("e2e"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(['f' || l_suppkey, 'p' || l_partkey])), ',') AS ids FROM lineitem")
def a21_result_ids(spark, sf):
    body = F.struct(F.struct(F.concat(F.lit("p"), text_("l_partkey")).alias("product_id"), F.lit(3).alias("doc_id")).alias("x"), F.array(F.struct(F.concat(F.lit("f"), text_("l_suppkey")).alias("family_id"))).alias("y"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(evals.result_ids(F.to_json(body)), ",").alias("ids"))


# ---- products and search --------------------------------------------------------------------------------------


def _parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("family_id"), F.col("p_name").alias("model_name"), F.lit(None).cast("string").alias("variant"))


_RESOLVED = ("tier", "matched_by", "family_id", "product_id", "position")


@query("SELECT 1 AS tier, 'model' AS matched_by, p_brand AS family_id, p_partkey AS product_id, row_number() OVER (ORDER BY p_partkey) AS position FROM part WHERE lower(replace(p_name, ' ', '')) = (SELECT lower(replace(p_name, ' ', '')) FROM part WHERE p_partkey = 7)")
def t03_resolve_model(spark, sf):
    parts = _parts(spark, sf)
    return products.resolve(tables.families(spark, sf), parts, parts.where("product_id = 7").first().model_name).select(*_RESOLVED)


@query("SELECT 2 AS tier, 'family' AS matched_by, p_brand AS family_id, p_partkey AS product_id, row_number() OVER (ORDER BY p_partkey) AS position FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def t03_resolve_family(spark, sf):
    fams = tables.families(spark, sf)
    return products.resolve(fams, _parts(spark, sf), " family " + fams.agg(F.min("family_id")).first()[0].upper()).select(*_RESOLVED)


@query("SELECT 3 AS tier, 'family_contains' AS matched_by, p_brand AS family_id, p_partkey AS product_id, row_number() OVER (ORDER BY p_partkey) AS position FROM part WHERE p_brand = (SELECT max(p_brand) FROM part)")
def t03_resolve_words(spark, sf):
    fams = tables.families(spark, sf)
    nameless = _parts(spark, sf).withColumn("model_name", F.lit(None).cast("string"))
    last = fams.agg(F.max("family_id")).first()[0]
    return products.resolve(fams, nameless, f"the {last.replace('#', ' ')} kit").select(*_RESOLVED)


@query("SELECT p_partkey AS cap_id, CASE WHEN p_partkey % 5 = 0 THEN 'air' WHEN p_partkey % 2 = 0 THEN 'Hydrogen' ELSE ' h2' END AS gases FROM part")
def t04_envelopes(spark, sf):
    return products.envelopes(tables.capabilities(spark, sf), tables.gases(spark, sf)).select("cap_id", F.array_join("gases", ",").alias("gases"))


@query(
    _ARMS
    + """, f AS (SELECT chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT chunk_id, rank FROM a UNION ALL SELECT chunk_id, rank FROM b) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 5)
SELECT chunk_id, round(score, 6) AS score, lang AS title, source AS url FROM f JOIN documents ON doc_id = chunk_id WHERE doc_id % 2 = 0"""
)
def j06_hybrid_documents(spark, sf):
    docs = table(spark, sf, "documents")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    rows = vectors.join(docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content")), "chunk_id")
    titled = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("title"), F.col("source").alias("url"))
    return search.hybrid(rows, titled, _WORDS, _asked(spark, sf)).select("chunk_id", "score", "title", "url")


@query("SELECT DISTINCT n_name FROM nation WHERE n_name IS NOT NULL")
def a03_distinct_values(spark, sf):
    return products.distinct_values(table(spark, sf, "nation"), "n_name")


# ---- releases -------------------------------------------------------------------------------------------------


def _staged(spark, sf) -> dict[str, DataFrame]:
    """Nations as documents, parts as products and capability rows with gases, suppliers as offices; every seventh is pending."""
    part, nation, supplier = table(spark, sf, "part"), table(spark, sf, "nation"), table(spark, sf, "supplier")
    status = lambda key: F.when(F.col(key) % 7 == 0, "pending").when(F.col(key) % 2 == 0, "approved").otherwise("edited").alias("review_status")
    source = lambda key: F.concat(F.lit("doc"), (F.col(key) % 25).cast("string")).alias("source_doc_id")
    caps = tables.capabilities(spark, sf).withColumnRenamed("cap_id", "k")
    return {
        "document": nation.select(F.concat(F.lit("doc"), text_("n_nationkey")).alias("doc_id"), F.lit("approved").alias("review_status")),
        "product": part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("family_id"), (F.col("p_partkey") % 11 == 0).alias("needs_family"), source("p_partkey"), F.when(F.col("p_partkey") % 13 != 0, "§A").alias("source_locator"), status("p_partkey")),
        "capability_row": caps.select(F.col("k").alias("cap_id"), "family_id", "capacity_min", "capacity_max", "capacity_unit", "discharge_p_min", "discharge_p_max", "pressure_unit", source("k"), F.lit("§B").alias("source_locator"), status("k")),
        "capability_gas": tables.gases(spark, sf).select("cap_id", "gas", F.lit("approved").alias("review_status")),
        "office": supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("office_id"), F.col("n_name").alias("city"), source("s_suppkey"), F.lit("§C").alias("source_locator"), status("s_suppkey")),
    }


_CHECKED = """WITH p AS (SELECT * FROM part WHERE p_partkey % 7 <> 0), c AS (SELECT *, split_part(p_type, ' ', 1) = 'SMALL' AS bare FROM p), o AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 <> 0)
"""


@query(
    _CHECKED
    + """SELECT 'hard' AS severity, 'product' AS "table", CAST(p_partkey AS VARCHAR) AS key, 'needs a family' AS message FROM p WHERE p_partkey % 11 = 0
UNION ALL SELECT 'hard', 'product', CAST(p_partkey AS VARCHAR), 'missing source_doc_id/source_locator' FROM p WHERE p_partkey % 13 = 0
UNION ALL SELECT 'hard', 'product', CAST(p_partkey AS VARCHAR), 'family_id not found: ' || p_brand FROM p WHERE p_brand = (SELECT min(p_brand) FROM part)
UNION ALL SELECT 'hard', 'capability_row', CAST(p_partkey AS VARCHAR), 'family_id not found: ' || p_brand FROM p WHERE p_brand = (SELECT min(p_brand) FROM part)
UNION ALL SELECT 'hard', 'capability_row', CAST(p_partkey AS VARCHAR), 'capacity number without unit' FROM c WHERE bare
UNION ALL SELECT 'hard', 'capability_gas', CAST(p_partkey AS VARCHAR), 'cap_id not found: ' || p_partkey FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT 'hard', 'office', CAST(s_suppkey AS VARCHAR), 'city does not resolve: ' || n_name FROM o WHERE n_name = (SELECT min(n_name) FROM nation)"""
)
def c04_release_check(spark, sf):
    fams = tables.families(spark, sf)
    listed = fams.where(F.col("family_id") != fams.agg(F.min("family_id")).first()[0])
    nation = table(spark, sf, "nation")
    cities = nation.where(F.col("n_name") != nation.agg(F.min("n_name")).first()[0]).select(F.upper("n_name").alias("city"), F.lit("s").alias("state"), F.lit("r").alias("region"))
    return release.check(_staged(spark, sf), listed, cities)


@query(
    """SELECT 'product' AS "table", count(*) AS n FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'capability_row', count(*) FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'capability_gas', count(*) FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'document', count(*) FROM nation UNION ALL SELECT 'office', count(*) FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'product_family', count(DISTINCT p_brand) FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'region_state', count(*) FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT 'release', 1"""
)
def c05_promote(spark, sf):
    ledger = spark.createDataFrame([("rc.x.0001", "imported"), ("rc.x.0002", "open")], "id string, status string")
    releases = spark.createDataFrame([("r2024.05.1",)], "release_id string")
    regions = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("state"), F.col("s_suppkey").alias("office_id"))
    fams = tables.families(spark, sf).withColumn("source", F.lit("doc1 §A; doc2"))
    _, made, _ = release.run_promotion(ledger, "rc.x.0001", _staged(spark, sf), fams, regions, releases, 2024, 5)
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, rows in made.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT CAST(y AS VARCHAR) AS release_id, y = (SELECT CASE WHEN count(*) FILTER (quality = 0) > 0 THEN (SELECT max(year(o_orderdate)) FROM orders) ELSE 0 END FROM labels) AS is_active FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)")
def c10_gated_activation(spark, sf):
    from lodestone.plans.queries import _releases

    results = table(spark, sf, "labels").select(F.lit("fact").alias("layer"), F.when(F.col("quality") == 0, "fail").otherwise("pass").alias("status"))
    rows = _releases(spark, sf)
    return release.activate_if(rows, rows.agg(F.min("release_id")).first()[0], evals.report(results))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS release_id FROM orders WHERE year(o_orderdate) <> 1995")
def k10_delete_release(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("release_id"))
    return release.delete_release({"chunk": rows}, "1995")["chunk"]


@query("SELECT n_nationkey AS id, n_name AS name, NULL AS note, 'r0' AS release_id FROM nation UNION ALL SELECT r_regionkey, r_name, '{\"k\":' || r_regionkey || '}', 'r1' FROM region")
def k09_insert(spark, sf):
    stored = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note"), F.lit("r0").alias("release_id"))
    rows = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.struct(F.col("r_regionkey").alias("k")).alias("note"))
    return release.insert(stored, rows, "r1")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS lubricated, CASE event_id % 3 WHEN 0 THEN event_type || '|x' ELSE '' END AS standards, CASE WHEN event_id % 2 = 0 THEN event_id + 0.5 END AS capacity_max, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS INT) END AS page_count, nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, '') AS name FROM events"""
)
def f52_coerce(spark, sf):
    k, e = F.col("event_id"), F.col("event_type")
    sheet = table(spark, sf, "events").select(
        "event_id", F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "0").when(k % 4 == 2, "maybe").alias("lubricated"), F.when(k % 3 == 0, F.concat(e, F.lit(", ,x "))).alias("standards"),
        F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise("").alias("capacity_max"), F.when(k % 2 == 0, k.cast("string")).alias("page_count"), F.when(k % 5 == 0, "").otherwise(e).alias("name"),
    )
    return release.typed_cells(sheet, ["lubricated", "standards", "capacity_max", "page_count", "name"]).withColumn("standards", F.array_join("standards", "|"))


@query("SELECT n_regionkey || '.' || n_name AS prompt_id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM nation")
def k22_load_prompts(spark, sf):
    n = table(spark, sf, "nation")
    old = n.where("n_nationkey % 2 = 0").select(F.lit("old").alias("prompt_id"), F.lit("x").alias("client_id"), F.concat_ws(".", text_("n_regionkey"), "n_name").alias("agent"), F.lit(1).alias("version"), F.lit(True).alias("is_active"), F.lit("b").alias("body"))
    new = release.load_prompts(old, n.select(F.concat_ws(".", text_("n_regionkey"), "n_name").alias("agent"), F.lit("body").alias("body")), "x")
    return new.where("NOT is_active").select(F.regexp_extract("prompt_id", r"^pv\.x\.(.*)\.\d+$", 1).alias("prompt_id"), "version")


@query("SELECT n_name AS agent, CASE WHEN n_nationkey % 2 = 0 THEN 'live' ELSE 'file' END AS body, n_nationkey % 2 = 0 AS stored FROM nation")
def r19_active_prompts(spark, sf):
    n = table(spark, sf, "nation")
    versions = n.select(F.concat(F.lit("pv."), "n_name").alias("prompt_id"), F.lit("x").alias("client_id"), F.col("n_name").alias("agent"), F.lit(1).alias("version"), (F.col("n_nationkey") % 2 == 0).alias("is_active"), F.lit("live").alias("body"))
    return release.active_prompts(versions, n.select(F.col("n_name").alias("agent"), F.lit("file").alias("body")), "x").select("agent", "body", F.col("prompt_id").isNotNull().alias("stored"))


@query(
    """SELECT 'prd.' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.' || p_partkey AS product_id, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS family_id, p_partkey % 3 = 0 AS needs_family, 'pending' AS review_status FROM part"""
)
def d17_product_rows(spark, sf):
    items = table(spark, sf, "part").select(
        F.col("p_brand").alias("section_id"), F.col("p_partkey").alias("i"), F.when(F.col("p_partkey") % 3 == 0, "other").otherwise(F.col("p_brand")).alias("family_id"),
        F.col("p_name").alias("model_name"), F.lit(None).cast("string").alias("variant"), F.lit(None).cast("string").alias("description"), F.array(F.col("p_type")).alias("attributes"),
    )
    return evidence.product_rows(items, tables.families(spark, sf)).select("product_id", "family_id", "needs_family", "review_status")


@query("SELECT 'cf.e.' || event_id AS fact_id, CASE WHEN event_type = 'view' THEN 'client' END AS kind FROM events")
def p18_fact_kinds(spark, sf):
    e = table(spark, sf, "events").select(F.lit("E").alias("section_id"), F.col("event_id").alias("i"), F.when(F.col("event_type") == "view", "client").otherwise("award").alias("kind"), text_("value").alias("value"))
    return evidence.fact_rows(e).select("fact_id", "kind")


@query(
    """SELECT DISTINCT doc, heading, family_id FROM (SELECT 'n' || p_partkey % 25 AS doc, upper(p_type) AS heading, p_brand AS family_id FROM part UNION ALL SELECT 's' || p_size, upper(p_type), p_brand FROM part)"""
)
def u01_family_refs(spark, sf):
    part = table(spark, sf, "part")
    of = lambda doc, locator: part.select(F.col("p_brand").alias("family_id"), doc.alias("source_doc_id"), locator.alias("source_locator"))
    first = of(F.concat(F.lit("n"), (F.col("p_partkey") % 25).cast("string")), F.concat(F.lit("p3 §x §"), "p_type"))
    return documents.family_refs(first, of(F.lit(""), F.lit("§a")), of(F.concat(F.lit("s"), text_("p_size")), F.col("p_type")))


@query("SELECT conv_id AS doc_id, count(*) AS pages, CAST(sum(length(trim(coalesce(text, '')))) AS BIGINT) AS characters, count(*) FILTER (length(trim(coalesce(text, ''))) < 50) AS sparse FROM conversations GROUP BY conv_id")
def h10_page_density(spark, sf):
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return documents.page_density(pages).select("doc_id", "pages", "characters", "sparse")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0")
def k04_upsert(spark, sf):
    o = table(spark, sf, "orders")
    return release.upsert(o.select("o_orderkey", text_("o_custkey").alias("v")), o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("v")), ["o_orderkey"])


@query("SELECT min(doc_id) AS doc_id, md5(text) AS sha FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY text")
def k01_new_only(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", md5(F.col("text")).alias("sha"))
    fresh = docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    return sinks.new_only(fresh, docs.where("doc_id % 3 = 0"), "sha").select("doc_id", "sha")


@query("SELECT upper(n_name) AS city, r_name AS state, 'R' || r_regionkey AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def s13_city_states(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    regions = n.groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit(" "), F.lower("n_name"))).alias("cities")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return readers.city_states(regions.select(F.col("r_name").alias("state"), F.concat(F.lit("R"), text_("r_regionkey")).alias("region"), "cities"))


@query("SELECT doc_id, source AS title, lang AS kind, md5(coalesce(text, '')) AS body FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def d12_front_matter(spark, sf):
    docs = table(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    made = docs.select("doc_id", documents.render(F.coalesce("text", F.lit("")), title=F.col("source"), kind=F.col("lang")).alias("md"))
    return made.select("doc_id", documents.front_matter(F.col("md")).alias("f")).select("doc_id", "f.title", "f.kind", md5(F.col("f.body")).alias("body"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE CAST(event_id % 9000 AS VARCHAR) END AS shown FROM events")
def f48_format_number(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("value").isNotNull(), U.format_number((F.col("event_id") % 9000).cast("double").cast("string"))).alias("shown"))


@query("SELECT event_id, event_id % 2 = 0 AND event_type = 'view' AND event_id % 3 <> 0 AS off, CASE event_id % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'hinglish' ELSE 'en' END AS reply FROM events")
def h17_r17_language(spark, sf):
    k = F.col("event_id")
    language = F.when(k % 3 == 0, "hi").when(k % 3 == 1, "HINGLISH").otherwise("fr")
    schema = F.when(F.col("event_type") == "view", "answer").otherwise("triage")
    return table(spark, sf, "events").select("event_id", dialog.thinks(k % 2 == 0, schema, language).alias("off"), dialog.reply_language(language).alias("reply"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'contact_detail' END AS ask, c_custkey % 2 = 0 AS file FROM customer")
def f27_contact_question(spark, sf):
    k = F.col("c_custkey")
    url = F.when(k % 2 == 0, "https://x/A.PDF/?v=1").otherwise("https://x/a.html?f=.pdf")
    return table(spark, sf, "customer").select("c_custkey", dialog.contact_question(F.when(k % 3 == 0, "by Email").when(k % 3 == 1, "WhatsApp")).alias("ask"), dialog.downloadable(url).alias("file"))


# ---- orders of things -----------------------------------------------------------------------------------------


@query("SELECT count(*) AS pages, CAST(sum(page_id % 7) AS BIGINT) AS headings, CAST(sum(page_id % 3) AS BIGINT) AS tables, CAST(sum(length(coalesce(html, ''))) AS BIGINT) AS characters FROM pages")
def a17_ingest_totals(spark, sf):
    return documents.ingest_totals(table(spark, sf, "pages").select((F.col("page_id") % 7).alias("headings"), (F.col("page_id") % 3).alias("tables"), F.coalesce("html", F.lit("")).alias("markdown")))
