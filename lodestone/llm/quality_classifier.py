"""Quality classifier by co-training of a text view and a metadata view.

The text view has hashed word frequencies and character statistics of the whole text;
the metadata view has language, source and size. Both are logistic regressions (Spark
ML) fitted on a bounded sample of labelled documents (``fit_rows``, by hash). In each
of ``rounds`` rounds, both views score all unlabelled documents, equal contents once.
What a view is confident of joins the other view's training rows; where that is more
than ``pool_rows`` rows of a kind, as many enter the fit by hash, others in each round.
Each final view is calibrated (Platt) on labelled documents held out by hash, and the
calibrated log-odds are added, less the prior's. Then all documents are scored.

Defined cases: null and empty texts count as empty; null metadata is a value of its
own; repeated rows get equal scores; several labels of a document are averaged and
0.5 counts as good; without labels of both kinds scores are the share of good ones
(0.5 without any); labels of unknown documents are ignored; unlabelled documents without an id are scored as all others; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop_cut, words_of

VIEWS = ("text", "meta")


def content_key(docs: DataFrame) -> Column:
    """A hash of what the views see of a document."""
    return F.xxhash64(*(docs[c] for c in ("text", "lang", "source")))


def counted(docs: DataFrame, words: int = 4096) -> DataFrame:
    """What both views are made of, the one pass over the texts: (doc_id, key, statistics, metadata, word counts)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", content_key(docs).alias("key"), text.alias("_t"), words_of(F.lower(F.col("text"))).alias("_w"), *(F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(f"_{c}") for c in ("lang", "source")))
    per = lambda pattern: F.regexp_count("_t", F.lit(pattern)) / F.greatest(F.length("_t"), F.lit(1))
    n = F.greatest(F.size("_w"), F.lit(1))
    stats = base.select(
        "*",
        per("[A-Z]").alias("_upper"),
        (F.regexp_count("_t", F.lit("[#*$%&|<>]")) / n).alias("_symbols"),
        (F.regexp_count("_t", F.lit("!")) / n).alias("_shouts"),
        per("[0-9]").alias("_digits"),
        (F.length("_t") / n / 10).alias("_mean"),
        (F.size(F.array_distinct("_w")) / n).alias("_distinct"),
        F.floor(F.log2(F.length("_t") + 1)).cast("string").alias("_size"),
        F.floor(F.log2(F.regexp_count("_t", F.lit("\n")) + 1)).cast("string").alias("_lines"),
    )
    return HashingTF(inputCol="_w", outputCol="_tf", numFeatures=words).transform(stats).drop("_t", "_w")


def views(counts: DataFrame) -> DataFrame:
    """(doc_id, key, text_view, meta_view) of every row of ``counted``."""
    shares = Normalizer(inputCol="_tf", outputCol="_share").transform(counts)
    both = VectorAssembler(inputCols=["_upper", "_symbols", "_shouts", "_digits", "_mean", "_distinct", "_share"], outputCol="text_view").transform(shares)
    meta = FeatureHasher(inputCols=["_lang", "_source", "_size", "_lines"], outputCol="meta_view", numFeatures=256).transform(both)
    return meta.select("doc_id", "key", "text_view", "meta_view")


def _hash_below(share: float, salt: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000) + 1


def _fit(rows: DataFrame, column: str, reg: float = 0.01):
    return LogisticRegression(featuresCol=column, labelCol="label", regParam=reg, maxIter=25).fit(rows)


def _odds(model, rows: DataFrame, view: str) -> DataFrame:
    """``rows`` with the view's log-odds."""
    raw = model.transform(rows).withColumn(f"{view}_odds", vector_to_array("rawPrediction")[1])
    return raw.drop("rawPrediction", "probability", "prediction")


def _calibrate(model, held: DataFrame, view: str) -> tuple[float, float]:
    """(slope, offset) of Platt scaling on held-out rows."""
    scored = VectorAssembler(inputCols=[f"{view}_odds"], outputCol="_o").transform(_odds(model, held, f"{view}"))
    fitted = _fit(scored, "_o", 0.001)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def _teach(models: dict, counts: DataFrame, label: DataFrame, cutoff: float, pool_rows: int, salt: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The written views of the picked unlabelled contents, and for each view the rows it pseudo-labels among them.

    All documents are scored; keys and odds alone are shuffled and written. Then the picked contents are joined by key."""
    scored = views(counts)
    for v in VIEWS:
        scored = _odds(models[v], scored, v)
    free = scored.select("doc_id", "key", *(f"{v}_odds" for v in VIEWS)).join(label, "doc_id", "left_anti")
    odds = cut(free.groupBy("key").agg(*(F.min(f"{v}_odds").alias(f"{v}_odds") for v in VIEWS)), "co-training-odds")
    kind = {v: F.when(F.col(f"{v}_odds") >= cutoff, 1.0).when(F.col(f"{v}_odds") <= -cutoff, 0.0) for v in VIEWS}
    n = odds.agg(*(F.count_if(kind[v] == y).alias(f"{v}{y}") for v in VIEWS for y in (0.0, 1.0))).first()
    below = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1_000_000))

    def taken(v: str) -> Column:
        bounds = {y: int(min(1.0, pool_rows / max(1, n[f"{v}{y}"])) * 1_000_000) + 1 for y in (0.0, 1.0)}
        return F.when(below < F.when(kind[v] == 1.0, bounds[1.0]).otherwise(bounds[0.0]), kind[v])

    picked = odds.select("key", *(taken(v).alias(v) for v in VIEWS)).where(" OR ".join(f"{v} IS NOT NULL" for v in VIEWS))
    # About 4 * pool_rows keys at most, so they fit a broadcast.
    chosen = counts.join(F.broadcast(picked), "key", "left_semi").dropDuplicates(["key"])
    vectors = views(chosen).join(F.broadcast(picked), "key")
    rows = cut(vectors, "co-training-rows")
    drop_cut(odds)
    return rows, {v: rows.where(F.col(v).isNotNull()).select("doc_id", "key", "text_view", "meta_view", F.col(v).alias("label")) for v in VIEWS}


def classify(docs: DataFrame, labels: DataFrame, rounds: int = 2, fit_rows: int = 10_000, pool_rows: int = 5_000, confident: float = 0.95, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of every document."""
    docs = docs.select("doc_id", "text", "lang", "source")
    label = labels.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    n_labels = label.count()
    some = F.broadcast(label.where(_hash_below(min(1.0, fit_rows / max(1, n_labels)), 1)))
    # Word counts are small integers under few slots and take a fraction of the texts; all later passes read them instead.
    counts = cut(counted(docs), "co-training-counts")
    known = cut(views(counts.join(some, "doc_id", "left_semi")).join(some, "doc_id"), "co-training")
    held, own = known.where(_hash_below(0.25, 3)), known.where(~_hash_below(0.25, 3))
    kinds = {(r.h, r.label): r.n for r in known.groupBy(_hash_below(0.25, 3).alias("h"), "label").agg(F.count("*").alias("n")).collect()}
    prior = (sum(n for (_, y), n in kinds.items() if y) / sum(kinds.values())) if kinds else 0.5
    names = ("text_score", "meta_score", "score")
    if len(kinds) < 4:
        return docs.select("doc_id", *(F.lit(prior).alias(c) for c in names), F.lit(prior >= threshold).alias("kept"))
    cutoff = math.log(confident / (1 - confident))
    models = {v: _fit(own, f"{v}_view") for v in VIEWS}
    for i in range(rounds):
        rows, sure = _teach(models, counts, label, cutoff, pool_rows, 10 + i)
        models = {v: _fit(own.unionByName(sure[other]), f"{v}_view") for v, other in (VIEWS, VIEWS[::-1])}
        drop_cut(rows)
    scales = {v: _calibrate(models[v], held, v) for v in VIEWS}
    drop_cut(known)
    scored = views(counts)
    for v in VIEWS:
        scored = _odds(models[v], scored, v).withColumn(f"{v}_odds", F.col(f"{v}_odds") * scales[v][0] + scales[v][1])
    base = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    total = F.col("text_odds") + F.col("meta_odds") - base
    return scored.select(
        "doc_id", chance(F.col("text_odds")).alias("text_score"), chance(F.col("meta_odds")).alias("meta_score"), chance(total).alias("score"), (chance(total) >= threshold).alias("kept")
    )
