"""Conversation state: routing, slots, carry-forward, the append-only log and its reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T

#: Triage vocabulary, intents with their agents, and the order in which slots are asked for.
DIVISIONS = ("industrial", "fire_rescue", "diving", "unknown")
LANGUAGES = ("en", "hi", "hinglish")
ROUTES = {
    "application_enquiry": "application_discovery", "product_question": "product_advisor", "documents": "documents_compliance",
    "after_sales": "after_sales_intake", "commercial": "commercial_routing", "faq": "faq_company",
}
OUT_OF_SCOPE = "out_of_scope"
DUTY_SLOTS = ("gas", "capacity", "capacity_unit", "discharge_p")
SERVICE_SLOTS = ("model", "serial_or_year", "site_city", "need", "contact_pref", "contact_detail")
CLARIFY_BELOW = 0.6


def triage(rows: DataFrame) -> DataFrame:
    """``rows`` with sound triage fields: unknown words become the defaults, confidence lies in [0, 1], out of scope wins."""
    intent = F.when(F.col("intent").isin(*ROUTES, OUT_OF_SCOPE), F.col("intent")).otherwise("faq")
    outside = intent == OUT_OF_SCOPE
    confidence = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    return rows.withColumns(
        {
            "division": F.when(F.col("division").isin(*DIVISIONS), F.col("division")).otherwise("unknown"),
            "language": F.when(F.col("language").isin(*LANGUAGES), F.col("language")).otherwise("en"),
            "in_scope": F.coalesce("in_scope", ~outside) & ~outside,
            "pii_present": F.coalesce("pii_present", F.lit(False)),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)),
            "intent": intent,
        }
    )


def route(intent: Column, confidence: Column, in_scope: Column, least: float = CLARIFY_BELOW) -> Column:
    """clarify below the confidence threshold, deflect out of scope, else the intent's agent (deflect if unknown)."""
    agents = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))
    outside = ~in_scope | (intent == OUT_OF_SCOPE)
    return F.when(F.coalesce(confidence, F.lit(0.0)) < least, "clarify").when(outside, "deflect").otherwise(F.coalesce(F.element_at(agents, intent), F.lit("deflect")))


def first_missing_duty() -> Column:
    """What to ask of a duty next: gas, then capacity (with its unit), then discharge_p; null if nothing lacks."""
    lacks = lambda c: F.col(c).isNull()
    return F.when(lacks("gas"), "gas").when(lacks("capacity") | lacks("capacity_unit"), "capacity").when(lacks("discharge_p"), "discharge_p")


def first_missing(slots: tuple[str, ...] = SERVICE_SLOTS) -> Column:
    """Name of the first slot column that is null; null if none is."""
    return F.coalesce(*(F.when(F.col(s).isNull(), F.lit(s)) for s in slots))


#: What states a lubrication or a standard. Acronyms count in any case, short codes in capitals before a digit.
LUBRICATION = r"(?iu)oil[\s-]?free|oil[\s-]?less|non[\s-]?lube|lube|lubric|ऑयल[\s-]?फ्री|ऑइल[\s-]?फ्री|लुब्रिकेटेड|नॉन[\s-]?लुब्रिकेटेड|तेल[\s-]?मुक्त"
ACRONYMS = r"(?i)\b(?:api|iso|asme|atex|ped|nfpa|eiga|din|ansi|iec)\b"
SHORT_CODES = r"\b(?:EN|IS|BS|BIS)[\s-]?\d"
#: A flow with its unit, and a pressure.
FLOW = r"(?i)\d[\d,\.]*\s*(?:n\s*m\s*3\s*/?\s*hr?|nm³|scmd|scmh|kg\s*/\s*hr|m3\s*/\s*hr|m³/\s*hr|lpm|cfm|tpd)"
PRESSURE = r"(?i)\d[\d,\.]*\s*(?:barg|bar|psi)"


def mentions_lubrication(text: Column) -> Column:
    return F.coalesce(text.rlike(LUBRICATION), F.lit(False))


def mentions_standard(text: Column) -> Column:
    return F.coalesce(text.rlike(ACRONYMS) | text.rlike(SHORT_CODES), F.lit(False))


def guard_filters(turns: DataFrame, text: str = "text") -> DataFrame:
    """Inferred ``lubricated`` and ``standard`` become null where the user's text doesn't state them."""
    return turns.withColumns(
        {
            "lubricated": F.when(mentions_lubrication(F.col(text)), F.col("lubricated")),
            "standard": F.when(mentions_standard(F.col(text)), F.col("standard")),
        }
    )


def carry_forward(turns: DataFrame, slots: tuple[str, ...], session: str = "session_id", seq: str = "seq", full: str = "full") -> DataFrame:
    """``turns`` with each missing slot filled from the session's most recent turn that gave it.

    A full restatement (column ``full``) inherits nothing, and later turns don't look behind it."""
    order = Window.partitionBy(session).orderBy(seq)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    era = F.sum(F.coalesce(F.col(full), F.lit(False)).cast("int")).over(upto)
    within = Window.partitionBy(session, "_era").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("_era", era).withColumns({s: F.last(s, True).over(within) for s in slots}).drop("_era")


def last_before(turns: DataFrame, calls: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """Each turn with the latest earlier call of its session (as-of): one sort over both, no pairs."""
    values = [c for c in calls.columns if c not in (session, seq)]
    both = turns.withColumns({"_call": F.lit(None).cast(calls.select(F.struct(*values).alias("x")).schema["x"].dataType), "_turn": F.lit(True)})
    given = calls.select(session, seq, F.struct(*values).alias("_call"), F.lit(False).alias("_turn"))
    every = both.unionByName(given, allowMissingColumns=True)
    before = Window.partitionBy(session).orderBy(seq).rangeBetween(Window.unboundedPreceding, -1)
    found = every.withColumn("_prior", F.last("_call", True).over(before)).where("_turn")
    return found.select(*turns.columns, *(F.col(f"_prior.{v}").alias(f"prior_{v}") for v in values))


def rebuild(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages of sessions in conversation order: session_id, seq, seq_in_turn, role, text."""
    return messages.join(turns.select("turn_id", "session_id", "seq"), "turn_id").orderBy("session_id", "seq", "seq_in_turn")


def history(messages: DataFrame) -> DataFrame:
    """(session_id, history): texts of users and assistants in order, oldest first."""
    shown = messages.where(F.col("role").isin("user", "assistant") & (F.col("kind") == "text") & (F.coalesce("text", F.lit("")) != ""))
    listed = F.array_sort(F.collect_list(F.struct("seq", "seq_in_turn", "role", "text")))
    return shown.groupBy("session_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("history"))


def numbered(messages: DataFrame, turn: str = "turn_id", order: str = "position") -> DataFrame:
    """Messages with their place within the turn, from 0."""
    return messages.withColumn("seq_in_turn", F.row_number().over(Window.partitionBy(turn).orderBy(order)) - 1)


#: Words that tell kinds of questions, tried in order.
QUESTION_KINDS = (
    ("certification", ("certif", "iso", "accredit")),
    ("founder", ("founder", "founded", "who found", "started by", "who is behind")),
    ("founded", ("founded", "establish", "since", "how old", "which year", "when was")),
    ("facility", ("facilit", "manufactur", "plant", "factory")),
    ("coverage", ("coverage", "countr", "export", "middle east", "abroad", "overseas", "presence")),
    ("client", ("client", "customer")),
    ("industry_served", ("industr", "sector")),
    ("contact", ("contact", "email", "phone")),
)
#: Words of requests for a document, extensions of files to hand out, words of dealers, of offices, and regions.
DOCUMENT_WORDS = ("catalog", "catalogue", "download", "datasheet", "data sheet", "brochure", "leaflet", "pdf", "document", "spec sheet", "spec-sheet", "manual")
DOWNLOADABLE = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip")
DEALER_WORDS = ("dealer", "distributor", "reseller", "channel partner", "distributorship")
OFFICE_WORDS = ("office", "branch", "cover", "covers", "region", "regional", "located", "location", "handle", "handles", "look after", "looks after", "head office", "headquarter", "head-quarter", "india")
REGION_WORDS = {"north": "North", "south": "South", "east": "East", "west": "West"}
#: Claims of absence, denials of a match, an empty list of sources at the end, and questions on products or standards.
ABSENCE = r"(?i)don'?t have|do not have|not in (our|the) published|can'?t confirm|cannot confirm|couldn'?t find|could not find|no (published )?(information|details|record|data)|not (available|listed|published) in"
DENIAL = (
    r"(?i)not getting any results|no results|no (matching )?(documents?|records?|data|information)|problem with the (search )?tool|search (tool |)(isn'?t|is not|failed|failing|not working)|"
    r"couldn'?t find|could not find|don'?t have (any|that|it)|no such|aren'?t any (documents?|results?|matches)|try (again|rephrasing|a different)"
)
EMPTY_SOURCES = r"(?i)(?:\r?\n)*[ \t]*sources?[ \t]*:[ \t]*(?:\[[ \t]*\]|\([ \t]*none[ \t]*\)|none|n/?a|—|-|\.)?[ \t]*$"
PRODUCT_QUESTION = (
    r"(?i)\bapi[\s\-]?\d|\basme\b|\bped\b|\batex\b|\biso\s?1363|\bis[\s\-]?\d|\ben[\s\-]?\d|\bbs[\s\-]?\d|"
    r"compliant|compliance|certified to|conform|rated to|machine|compressor|product|equipment|model"
)


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def question_kinds(text: Column) -> Column:
    """All kinds that a question's words tell, in order; the first is the main one."""
    return F.filter(F.array(*(F.when(_has_any(text, words), F.lit(k)) for k, words in QUESTION_KINDS)), lambda x: x.isNotNull())


def claims_absence(text: Column) -> Column:
    return F.coalesce(text.rlike(ABSENCE), F.lit(False))


def denies_match(text: Column) -> Column:
    return F.coalesce(text.rlike(DENIAL), F.lit(False))


def without_empty_sources(text: Column) -> Column:
    """A text without a last line that announces sources and names none; white space at its end goes."""
    return F.regexp_replace(F.regexp_replace(text, EMPTY_SOURCES, ""), r"(?U)\s+$", "")


def asks_product(text: Column) -> Column:
    return F.coalesce(text.rlike(PRODUCT_QUESTION), F.lit(False))


def wants_document(text: Column) -> Column:
    return _has_any(text, DOCUMENT_WORDS)


def downloadable(url: Column) -> Column:
    """Whether an address without its query names a file to hand out."""
    path = F.regexp_replace(F.split_part(F.lower(url), F.lit("?"), F.lit(1)), "/+$", "")
    found = F.lit(False)
    for ending in DOWNLOADABLE:
        found = found | path.endswith(ending)
    return F.coalesce(found, F.lit(False))


def lead_type(text: Column) -> Column:
    return F.when(_has_any(text, DEALER_WORDS), "dealer").otherwise("commercial")


def contact_question(preference: Column) -> Column:
    """Which contact detail to ask for: email, phone, or contact_detail without a known preference."""
    return F.when(_has_any(preference, ("email",)), "email").when(_has_any(preference, ("whatsapp", "call", "phone")), "phone").otherwise("contact_detail")


def office_place(questions: DataFrame, offices: DataFrame, states: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, way, place) of questions that ask for an office: a city named in them, else a state, else a region, else head office.

    Places are matched as parts of the lower-cased question (``containing``); of several the first by name."""
    asked = questions.where(_has_any(F.col(text), OFFICE_WORDS)).select(id_col, F.lower(text).alias("_q"))
    region = F.coalesce(*(F.when(F.contains(F.col("_q"), F.lit(w)), F.lit(r)) for w, r in REGION_WORDS.items()))
    plain = [(1, "city", offices.select("city")), (2, "state", states.select("state"))]
    found = [containing(asked, id_col, "_q", names.distinct(), c).select(id_col, F.lit(n).alias("_n"), F.lit(c).alias("way"), F.col(c).alias("place")) for n, c, names in plain]
    found.append(asked.where(region.isNotNull()).select(id_col, F.lit(3).alias("_n"), F.lit("region").alias("way"), region.alias("place")))
    found.append(asked.where(F.contains("_q", F.lit("head"))).select(id_col, F.lit(4).alias("_n"), F.lit("head_office").alias("way"), F.lit(None).cast("string").alias("place")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy(id_col).agg(F.min(F.struct("_n", "place", "way")).alias("b")).select(id_col, "b.way", "b.place")


#: Up to so many first stretches of names are held against each text; beyond, texts' stretches are joined with them.
HEADS = 2_000


def containing(rows: DataFrame, id_col: str, text: str, names: DataFrame, name: str, size: int = 4) -> DataFrame:
    """(id, name): names of ``size`` characters or more that a lower-cased text holds as a part, and shorter ones.

    Longer names meet texts by equality of their first ``size`` characters with a stretch of the text, so no text is
    compared with every name; the few possible shorter ones are joined as Spark sees fit."""
    low = names.where(F.col(name).isNotNull() & (F.col(name) != "")).select(name, F.lower(name).alias("_sought"))
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))  # overlapping, in one pass
    heads = low.where(F.length("_sought") >= size).withColumn("_gram", F.substring("_sought", 1, size))
    few = heads.select("_gram").distinct().limit(HEADS + 1)
    if few.count() <= HEADS:  # a text keeps those of its stretches that are heads, and goes along with them
        one = few.agg(F.collect_list("_gram").alias("_heads"))
        met = rows.select(id_col, text).crossJoin(F.broadcast(one)).select(id_col, text, F.explode(F.array_intersect(grams, "_heads")).alias("_gram"))
        long = met.join(heads, "_gram").where(F.contains(text, F.col("_sought")))
    else:  # all stretches meet the names, then the names their texts
        met = rows.select(id_col, F.explode(grams).alias("_gram")).join(heads, "_gram")
        long = met.join(rows.select(id_col, text), id_col).where(F.contains(text, F.col("_sought")))
    short = rows.join(low.where(F.length("_sought") < size), F.contains(F.col(text), F.col("_sought")))
    return long.select(id_col, name).unionByName(short.select(id_col, name)).distinct()


def session_calls(calls: DataFrame, invocations: DataFrame, turns: DataFrame, tool: str) -> DataFrame:
    """A tool's calls with their session and turn number: calls joined to invocations joined to turns."""
    return calls.where(F.col("tool") == tool).join(invocations.select("inv_id", "turn_id"), "inv_id").join(turns.select("turn_id", "session_id", "seq"), "turn_id")


def follow_up(turns: DataFrame, text: str = "text") -> DataFrame:
    """Slots of each turn over those of the last earlier call (``prior_`` columns, see ``last_before``).

    A full restatement inherits nothing; else missing slots are inherited. A capacity given anew without a flow and
    unit in the message leaves the unit open, so that it is asked for."""
    own = (*DUTY_SLOTS, "lubricated", "standard")
    whole = F.lit(True)
    for c in DUTY_SLOTS:
        whole = whole & F.col(c).isNotNull()
    merged = {c: F.when(whole, F.col(c)).otherwise(F.coalesce(c, f"prior_{c}")) for c in own}
    unclear = F.col("capacity").isNotNull() & ~F.coalesce(F.col(text).rlike(FLOW), F.lit(False))
    merged["capacity_unit"] = F.when(~unclear, merged["capacity_unit"])
    return turns.withColumns(merged)


def thinks(knob: Column, schema: Column, language: Column) -> Column:
    """Whether thinking is switched off for a call: the knob is set, the schema is an answer's, the language isn't Hindi."""
    return knob & (schema == "answer") & (F.coalesce(language, F.lit("en")) != "hi")


def reply_language(language: Column) -> Column:
    """The language to reply in; unknown ones give English."""
    low = F.lower(language)
    return F.when(low.isin(*LANGUAGES), low).otherwise("en")


def needs_translation(query: Column, language: Column) -> Column:
    """Whether a search query goes through the translation seam: the corpus is English."""
    return F.lower(language).isin("hi", "hinglish") & (T.strip(query) != "")


def duty_slots(text: Column) -> Column:
    """struct of the duty that a message states: capacity with its unit, and discharge pressure in barg."""
    flow = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(nm\s*3\s*/?\s*h(?:r|our)?|nm³/hr|scmd)"
    pressure = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*bar"
    number = lambda p: F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double")
    unit = F.nullif(F.regexp_extract(text, flow, 2), F.lit(""))
    return F.struct(number(flow).alias("capacity"), unit.alias("capacity_unit"), number(pressure).alias("discharge_p"))


def states_full_duty(text: Column) -> Column:
    """Whether a message states a flow with its unit and a pressure."""
    return F.coalesce(text.rlike(FLOW) & text.rlike(PRESSURE), F.lit(False))


def unit_of_new_capacity(turns: DataFrame, text: str = "text") -> DataFrame:
    """A capacity without a flow and unit in the same message loses an inferred unit, so that it is asked for."""
    stated = F.coalesce(F.col(text).rlike(FLOW), F.lit(False))
    return turns.withColumn("capacity_unit", F.when(F.col("capacity").isNull() | stated, F.col("capacity_unit")))


def user_texts(messages: DataFrame) -> DataFrame:
    """(session_id, texts): everything a user said, oldest first."""
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("seq", "seq_in_turn", "text"))))
    return messages.groupBy("session_id").agg(F.transform(said, lambda m: m["text"]).alias("texts"))


def answer_text(messages: DataFrame) -> DataFrame:
    """(turn_id, answer): the assistant's texts of a turn and the titles of its cards, in order."""
    shown = F.when(F.col("kind") == "document_card", F.get_json_object("payload", "$.title")).otherwise(F.col("text"))
    own = messages.where("role = 'assistant'").select("turn_id", "seq_in_turn", shown.alias("t")).where("t IS NOT NULL AND t != ''")
    listed = F.array_sort(F.collect_list(F.struct("seq_in_turn", "t")))
    return own.groupBy("turn_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("answer"))


def cards(hits: DataFrame, most: int = 3) -> DataFrame:
    """Download cards of search hits (turn_id, rank, doc_id, title, url): documents once, at most ``most`` a turn; the title falls back to the address."""
    named = F.coalesce(F.nullif("title", F.lit("")), T.title_from_url(F.col("url")))
    first = hits.groupBy("turn_id", "doc_id").agg(F.min("rank").alias("rank"), F.min_by(named, "rank").alias("title"), F.min_by("url", "rank").alias("url"))
    place = F.row_number().over(Window.partitionBy("turn_id").orderBy("rank", "doc_id"))
    return first.withColumn("_p", place).where(F.col("_p") <= most).drop("_p")
