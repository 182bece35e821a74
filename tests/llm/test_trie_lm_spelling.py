"""Conversation prefix trie, language-model scores and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm_scores, prefix_trie, spelling


def brute_trie(conversations, of=100, heads=6):
    """Nodes of rebuilt conversations; ``conversations``: id to ordered (role, text)."""
    rebuilt = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % heads if heads else 0
        rebuilt[c] = tuple(conversations.get(c - c % of, ())[:h]) + tuple(own[h:])
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    found = {}
    for seq, ids in nodes.items():
        under = [s for s in nodes if s[: len(seq)] == seq]
        kids = [s for s in under if len(s) == len(seq) + 1]
        ends = sorted(c for c in ids if len(rebuilt[c]) == len(seq))
        found[min(ids), len(seq)] = (
            min(nodes[seq[:-1]]) if seq else None,
            len(ids),
            len(kids),
            sum(not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in under) for s in under),
            sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in under if s),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return found


SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, part string"


def as_rows(conversations):
    rows = [(c, t, r, x, "d", "p") for c, turns in conversations.items() for t, (r, x) in enumerate(turns)]
    random.Random(5).shuffle(rows)
    return rows


def trie_rows(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def some_conversations(seed, n=120):
    rnd = random.Random(seed)
    texts = ["", "a", "bb", "ccc", "é" * 5]
    out = {}
    for _ in range(n):
        c = rnd.choice([rnd.randrange(40), rnd.randrange(90, 330), rnd.randrange(10**6, 10**6 + 300)])
        out[c] = [(rnd.choice(["user", ""]), rnd.choice(texts)) for _ in range(rnd.choice([1, 2, 2, 3, 7, 9]))]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(spark, seed):
    held = some_conversations(seed)
    df = spark.createDataFrame(as_rows(held), SCHEMA).repartition(3)
    assert trie_rows(prefix_trie.digest(df)) == brute_trie(held)


def test_trie_of_long_and_equal_conversations(spark):
    """One conversation has most rows and crosses parts; many copies end at one node; a chain of 3,000 nodes is one vertex."""
    held = {c: [("user", "hi"), ("assistant", "yes")] for c in range(600, 1200)}
    held[7] = [("user", str(i % 11)) for i in range(3000)]
    held[8] = held[7][:1500] + [("user", "other")]
    df = spark.createDataFrame(as_rows(held), SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns = prefix_trie.lay_out(df.repartition(4))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert turns.where("conv_id = 7").select("part").distinct().count() > 1
    got = trie_rows(prefix_trie.trie(turns))
    want = {}
    for d in range(3001):
        n = 1 if d > 1500 else 2 if d else 602
        saved = sum(len(str(i % 11)) for i in range(max(d - 1, 0), 1500)) + (599 * 5 if d == 0 else 0)
        want[7, d] = (None if d == 0 else 7, n, 2 if d in (0, 1500) else int(d < 3000), 3 if d == 0 else 2 if d <= 1500 else 1, saved if d <= 1500 else 0)
    assert {k: v[:5] for k, v in got.items() if k[0] == 7} == want
    assert got[8, 1501][:5] == (7, 1, 0, 1, 0)
    ids = ",".join(map(str, range(600, 1200)))
    assert got[600, 2] == (600, 600, 0, 1, 599 * 3, hashlib.sha256(ids.encode()).hexdigest())


def test_trie_nulls_ties_and_empty(spark):
    rows = [(1, None, None, "b", "", ""), (1, 0, "user", None, "", ""), (1, None, None, "b", "", ""), (None, 0, "user", "x", "", ""), (5, 3, "user", "x", "", ""), (5, 3, "user", "x", "", "")]
    got = trie_rows(prefix_trie.trie(prefix_trie.lay_out(spark.createDataFrame(rows, SCHEMA))))
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (5, 1), (5, 2)}
    assert got[1, 0][:5] == (None, 2, 2, 2, 2 * 0)
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert texts[1, 0] == (None, None) and texts[1, 2] == ("", "b") and texts[1, 3] == ("user", "") and texts[5, 2] == ("user", "x")
    assert prefix_trie.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_rounds_follow_branchings(spark):
    """Peeling completes children before parents, and every vertex once."""
    held = {c: [("u", "x")] * c for c in range(1, 6)}
    vertices = prefix_trie._vertices(prefix_trie._nodes(prefix_trie.lay_out(spark.createDataFrame(as_rows(held), SCHEMA)), spark.createDataFrame([(c,) for c in held], "conv_id bigint"))[0])
    done = prefix_trie.peel(vertices)
    assert done.count() == 5 and done.agg(F.max("n_leaves")).first()[0] == 1


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    found = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and is_near(v, w)]
        form = min(near, key=lambda v: (-words[v], v), default=None)
        found[w] = (form if form and words[form] >= 2 * n else None, n, len(near))
    out = {}
    for w, (form, n, k) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (form, root, n, k, words[form] if form else None)
    return out


def variant_rows(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_variants_of_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = variant_rows(spelling.digest(docs.withColumn("word", F.lit("x")).withColumn("key", F.lit(1))))
    words = brute_words((r.doc_id, r.text) for r in docs.collect())
    assert got == brute_variants(words) and len(got) > 100


@pytest.mark.parametrize("limit", [2, 256])
def test_variants_match_brute_force(spark, limit):
    """Few letters, so runs, ties and many near words occur; shards are halved down to one code point at the small limit."""
    rnd = random.Random(limit)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.choice([1, 2, 4, 5, 5, 6, 7, 12]))): rnd.choice([1, 2, 3, 5, 9, 20, 20, 90]) for _ in range(250)}
    words["x" * 3000], words["x" * 3001], words["x" * 1500 + "y" + "x" * 1500] = 3, 7, 1
    df = spark.createDataFrame([(w, n, "extra") for w, n in words.items()], "word string, n bigint, lo string")
    assert variant_rows(spelling.variants(df, limit=limit)) == brute_variants(words)


def test_shards_stay_small_and_no_pair_is_met_twice(spark):
    """A third of all words share one half; no shard keeps more than the limit where it can be halved."""
    words = [(f"stammwort{i:05d}".translate({ord("0") + d: c for d, c in enumerate("klmnopqrst")}), 3) for i in range(2000)]
    df = spark.createDataFrame(words, "word string, n bigint")
    sizes = spelling.shards(df, limit=64).groupBy("key").agg(F.count("*").alias("n"), F.max(F.expr("hi - lo")).alias("f"))
    assert sizes.where("f > 1 AND n > 64").isEmpty()
    assert variant_rows(spelling.variants(df, limit=64)) == brute_variants(dict(words))


def test_words_nulls_long_texts_and_empty(spark):
    rows = [(1, None), (2, ""), (None, "Spelling spelling"), (4, "SPELLING 12 " * 3), (4, "spellin\u00c9 \u00d7\u00df"), (5, "spellin\u00e9, " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = variant_rows(spelling.digest(docs))
    assert got == brute_variants(brute_words(rows))
    assert spelling.digest(docs.limit(0)).count() == 0
    many = "abcdefg " * 300_000
    assert spelling.runs_of(many) == {"abcdefg": 300_000}


class BruteModel:
    """Counts in dictionaries, probabilities by recursion."""

    def __init__(self, texts, order, prior):
        self.order, self.prior, self.counts = order, prior, Counter()
        for text in texts:
            seq = ["<s>", *self.words(text)]
            self.counts["<s>",] += 1
            for i in range(1, len(seq)):
                for k in range(1, min(order, i + 1) + 1):
                    self.counts[tuple(seq[i - k + 1 : i + 1])] += 1
        single = {w: c for w, c in self.counts.items() if len(w) == 1 and w != ("<s>",)}
        self.n, self.v = sum(single.values()), len(single)

    @staticmethod
    def words(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in re.split("[\x20\x09-\x0d]+", text) if w] + ["</s>"]

    def chance(self, word, context):
        if not context:
            return ((self.counts[word,] if word != "<s>" else 0) + 0.1) / (self.n + 0.1 * (self.v + 1))
        m = self.prior[len(context) - 1]
        return (self.counts[*context, word] + m * self.chance(word, context[1:])) / (self.counts[context] + m)

    def score(self, text):
        seq = ["<s>", *self.words(text)]
        known = sum(self.counts[w,] > 0 for w in seq[1:])
        base = sum(math.log10(self.chance(w, ())) for w in seq[1:])
        full = sum(math.log10(self.chance(seq[i], tuple(seq[max(0, i - self.order + 1) : i]))) for i in range(1, len(seq)))
        return len(seq) - 1, known, base, full


def score_rows(df):
    return sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


def brute_scores(docs, order, prior):
    out = [zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]
    model = BruteModel([t for (_, t), o in zip(docs, out) if not o], order, prior)
    rows = []
    for (d, text), o in zip(docs, out):
        n, known, base, full = model.score(text)
        rows.append((d, o, n, known, model.n, round(base, 6), round(full, 6)))
    return sorted(rows)


@pytest.mark.parametrize("order, prior, block", [(1, (), 10**6), (2, (7.0,), 10**6), (3, (100.0, 20.0), 10**6), (4, (9.0, 5.0, 2.0), 500)])
def test_scores_match_brute_force(spark, monkeypatch, order, prior, block):
    """Repeated and long texts, many blocks and slices, words that only held-out texts have."""
    monkeypatch.setattr(lm_scores, "BLOCK", block)
    monkeypatch.setattr(lm_scores, "SLICE", block)
    rnd = random.Random(order)
    words = [f"w{i}" for i in range(30)] + ["Ä", "A\u00a0b", "\x1c"]
    texts = ["", None, " \t", "only", "Only ONLY only", *(" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 60]))) for _ in range(60))]
    texts += [texts[9]] * 4 + [" ".join(rnd.choice(words) for _ in range(3000))]
    docs = list(enumerate(texts)) + [(20, "unseen words here only")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id bigint, text string, score double").repartition(3)
    code = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    assert score_rows(lm_scores.score(df, code, order, prior)) == brute_scores(docs, order, prior)


def test_scores_of_documents_match_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = score_rows(lm_scores.digest(spark.read.parquet(f"{sf}/documents.parquet")))
    assert got == brute_scores(docs, 3, lm_scores.PRIOR)


def test_model_sums_to_one(spark):
    """Over all known words and one unknown, after any context."""
    model = BruteModel(["a b c a b", "b c b", "c"], 3, (2.0, 0.5))
    seen = [w[0] for w in model.counts if len(w) == 1 and w != ("<s>",)]
    for context in [(), ("a",), ("a", "b"), ("<s>", "b"), ("c", "c"), ("zzz",)]:
        assert abs(sum(model.chance(w, context) for w in [*seen, "unknown"]) - 1) < 1e-12


def test_scores_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm_scores.digest(empty).count() == 0
    alone = spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")
    (row,) = lm_scores.digest(alone).collect()
    assert (row.doc_id, row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (None, True, 3, 0, 0, 0.0, 0.0)


def test_scores_gain_on_held_out_texts(spark, sf):
    """On texts that the model hasn't seen, contexts tell more than single words."""
    docs = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    held = lm_scores.digest(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] - held[1] > 0.2 * held[2]
