"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans are the strict regex matches of each kind that pass its check; they are
always kept. Candidates are all mentions of a looser pattern. Labelers vote 1, -1
or 0 on each: the strict pattern, a checksum or shape, a gazetteer (known domains
and endings, country codes, issuers, address blocks) and words before the mention.
Expectation-maximisation over the counts of vote patterns, per kind, estimates how
often each labeler votes either way for true and false mentions, without labels. A
logistic regression is then trained on span features with the resulting posterior
as soft label, and candidates with a probability of at least ``threshold`` are
added to the base spans unless they overlap one of their kind.

Only DataFrame functions run over the data. The driver gets the counts of vote
patterns (at most 3^4 for each of four kinds) and the regression's coefficients.
The regression is fitted on at most about ``fit_rows`` candidates, chosen by hash.

Defined cases: null and empty texts have no spans; identical rows get identical
results; spans count code points, end exclusive; texts are searched whole; patterns
are possessive, so that long runs cost no backtracking; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
ROW = ("doc_id", "_key")


@dataclass(frozen=True)
class Kind:
    """``hint``: cheap test of a text; ``strict`` and ``loose``: patterns; ``near``: words before a mention that speak for it."""

    name: str
    hint: str
    strict: str
    loose: str
    loose_hint: str
    near: str


SPECS = (
    Kind(
        "email",
        "contains(_text, '@')",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
        r"_text rlike '(?i)[\\[(]at[\\])]'",
        r"(?i)(?:e-?mail|mail|contact|write|schreib|correo|courriel)[^A-Za-z]*$",
    ),
    Kind(
        "ip",
        r"_text rlike '[0-9]\\.[0-9]'",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"(?i)(?<![0-9])[0-9]{1,3}+(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}+){3}(?![0-9])",
        r"_text rlike '(?i)[0-9] ?[\\[(](?:\\.|dot)[\\])]'",
        r"(?i)(?:\bip|address|addr|host|server|from|login)[^A-Za-z]*$",
    ),
    Kind(
        "card",
        r"_text rlike '[0-9](?:[ -]?[0-9]){12}'",
        r"(?<![0-9])[0-9](?:[ -]?+[0-9])++",
        r"(?<![0-9])[0-9]{4}+(?:[./_][0-9]{4}+){3}(?![0-9])",
        r"_text rlike '[0-9]{4}[./_][0-9]{4}[./_]'",
        r"(?i)(?:card|visa|mastercard|credit|debit|pay|karte|tarjeta|carte)[^A-Za-z]*$",
    ),
    Kind(
        "phone",
        "contains(_text, '+')",
        r"\+[0-9][ ().0-9-]+[0-9]",
        r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"_text rlike '[0-9]{3}[).]?[ .-]?[ .-][0-9]{3}[ .-][0-9]{4}'",
        r"(?i)(?:phone|tel|telephone|mobile|cell|call|fax|telefon|tel[eé]fono)[^A-Za-z]*$",
    ),
)
ORDER = {k: i for i, k in enumerate(KINDS)}

#: Common endings of mail domains, card issuer prefixes, telephone country codes.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "int")
ISSUERS = ("3", "4", "5", "6")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits passes the Luhn check; false for other lengths."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    total = F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _parts_ok(hit: Column) -> Column:
    """Whether all dotted numbers are at most 255; leading zeros don't count."""
    parts = F.transform(F.split(hit, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def _valid(kind: Column, hit: Column) -> Column:
    """Whether a strict match counts as base span."""
    return (
        F.when(kind == "ip", _parts_ok(hit))
        .when(kind == "card", luhn(_digits(hit)))
        .when(kind == "phone", F.length(_digits(hit)).between(9, 15))
        .otherwise(True)
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, kind, strict, start, stop, hit, before): all strict and loose matches, leftmost and non-overlapping by pattern."""
    text = docs.select("doc_id", F.xxhash64("text").alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))

    def found(spec: Kind, strict: bool) -> Column:
        # The texts between matches and the matches themselves alternate, so their lengths give positions.
        pattern = spec.strict if strict else spec.loose
        hits = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        gaps = F.split("_text", pattern, -1)
        rows = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(
            F.lit(spec.name).alias("kind"), F.lit(strict).alias("strict"), F.char_length(g).alias("gap"), h.alias("hit"), F.right(g, F.lit(24)).alias("before")))
        numbered = F.transform(rows, lambda r, i: F.struct(*(r[c].alias(c) for c in ("kind", "strict", "gap", "hit", "before")), i.alias("k")))
        hint = F.expr(spec.hint if strict else spec.loose_hint)
        return F.when(hint, numbered).otherwise(F.array().cast("array<struct<kind:string,strict:boolean,gap:int,hit:string,before:string,k:int>>"))

    every = F.flatten(F.array(*(found(s, strict) for s in SPECS for strict in (True, False))))
    rows = text.select(*ROW, F.explode(every).alias("m")).select(*ROW, "m.*").dropDuplicates([*ROW, "kind", "strict", "k"])
    run = Window.partitionBy(*ROW, "kind", "strict").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.char_length("hit")).over(run)
    return rows.withColumn("stop", stop).select(*ROW, "kind", "strict", (F.col("stop") - F.char_length("hit")).alias("start"), "stop", "hit", "before")


VOTES = ("v_pattern", "v_shape", "v_gazetteer", "v_context")
FEATURES = ("f_length", "f_digits", "f_marks", "f_strict", "f_shape", "f_known", "f_near", "f_email", "f_ip", "f_card")


def _label(found: DataFrame) -> DataFrame:
    """Votes and features of each mention."""
    kind, hit, digits = F.col("kind"), F.col("hit"), _digits(F.col("hit"))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    near = F.lit(False)
    for s in SPECS:
        near = near | ((kind == s.name) & F.col("before").rlike(s.near))
    unlike = F.col("before").rlike(r"(?i)(?:version|section|isbn|order|invoice|ref|no)[^A-Za-z]*$")
    shape = (
        F.when(kind == "email", F.char_length(hit) <= 120)
        .when(kind == "ip", _parts_ok(hit))
        .when(kind == "card", luhn(digits))
        .otherwise(F.length(digits).between(9, 15))
    )
    ending = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
    known = (
        F.when(kind == "email", ending.isin(*ENDINGS))
        .when(kind == "ip", ~F.regexp_extract(hit, "^([0-9]+)", 1).isin("0", "255"))
        .when(kind == "card", F.substring(digits, 1, 1).isin(*ISSUERS))
        .otherwise(F.substring(digits, 1, 1).isin(*COUNTRIES) | F.substring(digits, 1, 2).isin(*COUNTRIES))
    )
    base = F.col("strict") & _valid(kind, hit)
    return found.select(
        "*",
        base.alias("base"),
        sign(base).alias("v_pattern"),
        sign(shape).alias("v_shape"),
        sign(known).alias("v_gazetteer"),
        F.when(near, 1).when(unlike, -1).otherwise(0).alias("v_context"),
        (F.char_length(hit) / 32.0).alias("f_length"),
        (F.length(digits) / F.char_length(hit)).cast("double").alias("f_digits"),
        (F.regexp_count(hit, F.lit("[^A-Za-z0-9]")) / F.char_length(hit)).cast("double").alias("f_marks"),
        F.col("strict").cast("double").alias("f_strict"),
        shape.cast("double").alias("f_shape"),
        known.cast("double").alias("f_known"),
        near.cast("double").alias("f_near"),
        *((kind == k).cast("double").alias(f"f_{k}") for k in KINDS[:3]),
    )


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Posterior of a true mention for each vote pattern, by EM under votes independent given the truth.

    Starts from the share of positive votes; one pseudo-count each way keeps rates off 0 and 1."""
    post = {v: min(0.95, max(0.05, (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)))) for v in counts}
    total = sum(counts.values())
    for _ in range(rounds):
        true = sum(n * post[v] for v, n in counts.items())
        prior = (true + 1) / (total + 2)
        rates = []
        for i in range(len(VOTES)):
            by = {}
            for x in (-1, 0, 1):
                yes = sum(n * post[v] for v, n in counts.items() if v[i] == x)
                no = sum(n * (1 - post[v]) for v, n in counts.items() if v[i] == x)
                # The pseudo-counts hold the labelers' meaning: a positive vote is rather true.
                by[x] = ((yes + 1 + (x > 0)) / (true + 4), (no + 1 + (x < 0)) / (total - true + 4))
            rates.append(by)
        for v in counts:
            yes, no = prior, 1 - prior
            for i, x in enumerate(v):
                yes, no = yes * rates[i][x][0], no * rates[i][x][1]
            post[v] = yes / (yes + no)
    return post


def find_spans(docs: DataFrame, threshold: float = 0.5, fit_rows: int = 50_000) -> DataFrame:
    """(doc_id, _key, kind, start, stop, hit, base, probability) of base spans and those the classifier adds."""
    # Written, not cached: votes, fit and scoring read the mentions, and the texts are searched once, lost executors or not.
    labelled = cut(_label(mentions(docs)), "pii-mentions")
    counts: dict[str, dict[tuple[int, ...], int]] = {k: {} for k in KINDS}
    for r in labelled.groupBy("kind", *VOTES).count().collect():
        counts[r.kind][tuple(r[v] for v in VOTES)] = r["count"]
    posterior = [(k, *v, p) for k in KINDS for v, p in estimate(counts[k]).items()] if any(counts.values()) else []
    total = sum(sum(c.values()) for c in counts.values())
    schema = "kind string, " + ", ".join(f"{v} int" for v in VOTES) + ", posterior double"
    table = F.broadcast(docs.sparkSession.createDataFrame(posterior, schema))
    weighed = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled.join(table, ["kind", *VOTES]))
    if total:
        share = min(1.0, fit_rows / total)
        picked = weighed.where(F.pmod(F.xxhash64(*ROW, "kind", "start", "strict"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        soft = picked.select("features", F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))).alias("s")).select("features", "s.*")
        model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30).fit(soft)
        scored = model.transform(weighed).withColumn("probability", vector_to_array("probability")[1])
    else:
        scored = weighed.withColumn("probability", F.lit(0.0))
    # Drop added spans that overlap a base span or an earlier added one of the kind.
    sound = scored.where(F.col("base") | (F.col("probability") >= threshold))
    by = Window.partitionBy(*ROW, "kind")
    ahead = by.orderBy("start", F.col("base").desc(), "stop")
    earlier = F.max("stop").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(ahead.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(earlier, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("stop")) >= F.col("stop"))
    return sound.withColumn("_free", free).where(F.col("base") | F.col("_free")).select(
        *ROW, "kind", "start", "stop", "hit", "base", "probability"
    )


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    rank = F.create_map(*(F.lit(x) for k in KINDS for x in (k, ORDER[k])))
    spans = find_spans(docs).select(*ROW, "kind", "base", F.struct(rank[F.col("kind")].alias("o"), "start", "stop", F.concat_ws(":", "kind", "start", "stop").alias("s")).alias("x"))
    text = lambda xs: F.concat_ws(",", F.transform(F.array_sort(xs), lambda x: x["s"]))
    by_row = spans.groupBy(*ROW).agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS),
        text(F.collect_list(F.when(F.col("base"), F.col("x")))).alias("_base"),
        text(F.collect_list("x")).alias("spans"),
    )
    keys = docs.select("doc_id", F.xxhash64("text").alias("_k0"))
    joined = keys.join(by_row, keys.doc_id.eqNullSafe(by_row.doc_id) & (F.col("_k0") == F.col("_key")), "left")
    return joined.select(
        keys.doc_id,
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
