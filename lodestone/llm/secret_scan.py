"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are key-like strings of whole texts. Their features are length, how
often the character class changes and how unusual letter pairs are, the share of
letters covered by dictionary words, what the path says (tests, examples, docs) and
words beside the candidate. The forest (Spark ML) is trained on labelled findings,
a table (candidate, before, after, path, label) of bounded size: at most about
``fit_rows`` of it by hash. The dictionary is the commonest words of the whole
corpus, ``DICTIONARY`` at most, letters only, of four letters or more; ties are
taken or left together.

Defined cases: null and empty texts have no candidates; a null path says nothing;
repeated rows are scanned one by one; offsets count code points, end exclusive;
extra columns are ignored; no labelled rows of both kinds is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop_cut

DICTIONARY = 20_000
#: Shapes of keys. ``text`` is any long run of key characters.
KINDS = {
    "aws": r"\bAKIA[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "hex": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])",
    "text": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}",
}
CANDIDATE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()))
HINT = r"[A-Za-z0-9+/=_-]{20}|-----BEGIN"
_SPEAKS = re.compile(r"(?i)(?:api|key|secret|token|passw|pwd|auth|credential|bearer)")
_DENIES = re.compile(r"(?i)(?:sha|md5|commit|checksum|digest|etag|uuid|revision|example|sample)")
_TESTS = re.compile(r"(?i)(?:test|spec|mock|fixture|example|sample|docs?/)")
FEATURES = ("length", "changes", "digits", "upper", "distinct", "odd_pairs", "covered", "path_test", "speaks", "denies", "assigned", "quoted")
#: Fixed value: common letter pairs of European languages.
_PAIRS = set("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur la el un ie qu ue ai us ns il ss et tr no os do ad da lo ta ti".split())


def features(candidate: str, before: str, after: str, path: str | None, dictionary: frozenset[str]) -> tuple[float, ...]:
    n = max(1, len(candidate))
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in candidate]
    low = candidate.lower()
    pairs = [low[i : i + 2] for i in range(len(low) - 1) if low[i : i + 2].isalpha()]
    letters, covered, i = sum(c.isalpha() for c in low), 0, 0
    while i < len(low):
        for size in range(min(12, len(low) - i), 3, -1):
            if low[i : i + size] in dictionary:
                covered += size
                i += size
                break
        else:
            i += 1
    near = before[-24:]
    return (
        float(len(candidate)),
        sum(a != b for a, b in zip(kind, kind[1:])) / n,
        kind.count("d") / n,
        kind.count("u") / n,
        len(set(candidate)) / n,
        sum(p not in _PAIRS for p in pairs) / max(1, len(pairs)),
        covered / max(1, letters),
        float(bool(_TESTS.search(path or ""))),
        float(bool(_SPEAKS.search(near))),
        float(bool(_DENIES.search(near))),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", before))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before) and bool(after)),
    )


_FEATURE_SCHEMA = ", ".join(f"{f} double" for f in FEATURES)
FINDINGS = "doc_id bigint, start bigint, stop bigint, kind string, candidate string, " + _FEATURE_SCHEMA


def dictionary_of(docs: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """The commonest words of letters only: all words of as many frequency classes, from the top, as make ``size`` words at most.

    A class is one count up to 64 and a sixteenth of an octave above, so the driver gets about a thousand classes and
    ``size`` words, whatever the corpus. Ties are taken or left together."""
    split = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where(F.length("w") >= 4)
    level = F.when(F.col("count") <= 64, F.col("count")).otherwise((16 * F.log2("count")).cast("bigint"))
    counts = cut(split.groupBy("w").count().select("w", level.alias("level")), "word-levels")
    least, total = None, 0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > size:
            break
        least = row.level
    found = frozenset(r.w for r in counts.where(F.col("level") >= least).select("w").collect()) if least is not None else frozenset()
    drop_cut(counts)
    return found


def find(docs: DataFrame, dictionary: frozenset[str], path_col: str = "source") -> DataFrame:
    """All candidates of the documents with their features."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FINDINGS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * len(FEATURES)]
        for batch in batches:
            rows = []
            for key, text, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for m in CANDIDATE.finditer(text):
                    beside = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 8]
                    rows.append((key, m.start(), m.end(), m.lastgroup, m[0], *features(m[0], *beside, path, shared.value)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    hinted = docs.select(F.col("doc_id").cast("bigint"), "text", F.col(path_col).cast("string")).where(F.col("text").rlike(HINT))
    return hinted.mapInArrow(run, FINDINGS)


def featurize(findings: DataFrame, dictionary: frozenset[str]) -> DataFrame:
    """Features and label of labelled findings (candidate, before, after, path, label)."""
    shared = findings.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(float(y), *features(c or "", b or "", a or "", p, shared.value)) for c, b, a, p, y in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows)], names=["label", *FEATURES])

    return findings.select("candidate", "before", "after", "path", "label").mapInArrow(run, "label double, " + _FEATURE_SCHEMA)


def example_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled findings made by rule: half keys in assignments or headers, half digests, long words, paths and fillers."""
    ids = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 512).alias("h"), (F.col("id") % 10).alias("k"))
    b64 = F.translate(F.base64(F.unhex("h")), "+/=", "AbC")
    word = F.regexp_replace(F.translate("h", "0123456789abcdef", "aeiourstlnthdcmg"), "(..)", "$1e")
    k = F.col("k")
    candidate = (
        F.when(k.isin(0, 1, 5), F.substring("h", 1, 40)).when(k.isin(2, 3), F.substring(b64, 1, 36))
        .when(k == 4, F.concat(F.lit("AKIA"), F.upper(F.substring("h", 1, 16)))).when(k == 6, F.substring(word, 1, 26))
        .when(k == 7, F.concat_ws("/", F.substring(word, 1, 9), F.substring(word, 10, 8), F.substring(word, 20, 8)))
        .when(k == 8, F.repeat(F.substring("h", 1, 1), 32)).otherwise(F.concat_ws("-", F.substring(word, 1, 8), F.substring(word, 9, 8), F.substring(word, 18, 9)))
    )
    before = (
        F.when(k == 0, "the token = \"").when(k == 1, "api_key: '").when(k == 2, "secret = \"").when(k == 3, "Authorization: Bearer ")
        .when(k == 4, "aws key ").when(k == 5, "commit sha ").when(k == 8, "filler ").otherwise("of the ")
    )
    quote = F.when(k.isin(0, 2), "\"").when(k == 1, "'").otherwise(" ")
    path = F.when(k >= 5, F.when(F.col("id") % 3 == 0, "tests/data").otherwise("web")).otherwise(F.when(F.col("id") % 20 == 0, "tests/data").otherwise("web"))
    return ids.select(candidate.alias("candidate"), before.alias("before"), quote.alias("after"), path.alias("path"), (k < 5).cast("int").alias("label"))


def train(findings: DataFrame, dictionary: frozenset[str], fit_rows: int = 20_000):
    """A forest over the features of labelled findings."""
    share = min(1.0, fit_rows / max(1, findings.count()))
    picked = findings.where(F.pmod(F.xxhash64("candidate", "before"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featurize(picked, dictionary)).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            raise ValueError("labelled findings of both kinds are needed")
        return RandomForestClassifier(numTrees=40, maxDepth=6, seed=3, featureSubsetStrategy="sqrt").fit(rows)
    finally:
        rows.unpersist()


def scan(docs: DataFrame, findings: DataFrame, path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, stop, kind, candidate, probability, is_secret) of every candidate."""
    dictionary = dictionary_of(docs)
    model = train(findings, dictionary)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(find(docs, dictionary, path_col))
    scored = model.transform(ready).withColumn("p", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "stop", "kind", "candidate", F.col("p").alias("probability"), (F.col("p") >= threshold).alias("is_secret"))
