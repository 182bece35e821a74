"""Secrets, personal data, licenses, archives, the classifier and the pipeline."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import license_scan, pii, quality_classifier, registry, secret_scan, warc
from pyspark.sql import functions as F

from lodestone.llm.common import cut, join_groups, shared_dir, table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, start string, stop string, label string, features string"


def frame(spark, texts, ids=None, source="web"):
    rows = [(i, t, None, source, 1, "x", "x", "x", "x", "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


# ---- secrets ----


def test_secret_forest_on_held_out_findings(spark):
    found = secret_scan.example_findings(spark, 1200).withColumnRenamed("path", "path")
    from pyspark.ml.feature import VectorAssembler

    model = secret_scan.train(found.where("hash(candidate) % 4 != 0"), frozenset())
    held = secret_scan.featurize(found.where("hash(candidate) % 4 = 0"), frozenset())
    scored = model.transform(VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="features").transform(held))
    right = scored.where("prediction = label").count() / scored.count()
    assert right >= 0.95
    with pytest.raises(ValueError, match="both kinds"):
        secret_scan.train(found.where("label = 1"), frozenset())


def test_secret_scan(spark):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [f'é token = "{key}" end', "a very internationalizationalized longword here", None, "", f"commit {key}", "x " * 20_000, f'é token = "{key}" end']
    got = {(r.doc_id, r.candidate): r for r in secret_scan.scan(frame(spark, texts), secret_scan.example_findings(spark, 1200)).collect()}
    assert got[0, key].is_secret and (got[0, key].start, got[0, key].stop) == (11, 51) and got[6, key].probability == got[0, key].probability
    assert not got[1, "internationalizationalized"].is_secret and not got[4, key].is_secret
    words = "alpha " * 70 + "gamma " * 66 + "delta " * 3 + "omega " * 3 + "beta"
    of = lambda n: secret_scan.dictionary_of(frame(spark, [words]), n)
    assert of(9) == {"alpha", "gamma", "delta", "omega", "beta"} and of(3) == {"alpha", "gamma"} and of(0) == set()
    assert secret_scan.scan(frame(spark, []), secret_scan.example_findings(spark, 400)).count() == 0


# ---- personal data ----

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: max(map(int, m[0].split("."))) < 256, "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if ok():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_digest(spark):
    rng = random.Random(3)
    bits = ["a", "b@", "c.d", ".", "1", "23", "4", "+", "-", " ", "(555)", "é", "@", "4111111111111111", "255.", "_"]
    texts = [None, "", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8 01.002.0255.1 256.1.1.1", "+1 (555) 123-4567; 4111-1111-1111-1111", "x" * 30_000 + "@y.z", "1" * 30_000, "🎉 me@x.org"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["me@x.org"] * 2
    got = {r.doc_id: r for r in pii.digest(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t)
        counts = tuple(sum(s.startswith(k) for s in want) for k in BASE)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == counts, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(","))


def test_pii_adds_spans_and_survives_repeats(spark):
    texts = ["mail bob [at] mail [dot] com", "call 555-123-4567 now"] + [f"mail u{i}@x.com or call +1 (555) 123-4{i:03d}" for i in range(60)]
    got = {r.doc_id: r for r in pii.digest(frame(spark, texts)).collect()}
    assert got[0].spans == "email:5:28" and got[0].n_email == 0
    twice = pii.digest(frame(spark, ["me@x.org"] * 2, ids=[1, 1])).collect()
    assert [r.spans for r in twice] == ["email:0:8"] * 2
    assert pii.digest(frame(spark, [])).count() == 0 and pii.digest(frame(spark, ["none"])).first().spans == ""


def test_em_finds_reliable_labelers():
    post = pii.estimate({(1, 1, 1, 1): 40, (1, 1, 1, 0): 30, (-1, -1, -1, -1): 30, (-1, 1, -1, 0): 5})
    assert post[1, 1, 1, 1] > 0.9 > 0.1 > post[-1, -1, -1, -1]


# ---- licenses ----


def test_license_scan(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "the", "of"]) for _ in range(n))
    texts, want = [], set()
    for name, text in license_scan.TEMPLATES.items():
        for k in (0, 3, 50):
            want.add((len(texts), name))
            texts.append(f"{noise(k)} {text.upper() if k == 3 else text} {noise(40)}")
    texts += [None, "", "few words", noise(20_000), "Licensed under the Terms of my License, Version 9"]
    got = license_scan.scan(frame(spark, texts)).collect()
    assert {(r.doc_id, r.license_id) for r in got} >= want
    assert not {r.doc_id for r in got} - {d for d, _ in want} and all(r.containment >= 0.8 for r in got)
    assert license_scan.scan(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="under 5 words"):
        license_scan.Index({"x": "too short"})


def test_license_families_and_altered_copies(spark):
    rng = random.Random(8)
    texts, want = [], []
    for name, text in {**license_scan.TEMPLATES}.items():
        if len(text.split()) < 60:
            continue
        for share in (0.0, 0.02):
            own = ["changed" if rng.random() < share else w for w in text.split()]
            texts.append("Copyright 2020 by the team 1. " + " ".join(own) + " and then other words follow")
            want.append(name)
    got = license_scan.scan(frame(spark, texts)).collect()
    assert sorted((r.doc_id, r.license_id) for r in got) == list(enumerate(want))
    both = license_scan.TEMPLATES["BSD-3-Clause-text"] + " x y z " * 99 + license_scan.TEMPLATES["BSD-2-Clause-text"]
    assert {r.license_id for r in license_scan.scan(frame(spark, [both])).collect()} == {"BSD-2-Clause-text", "BSD-3-Clause-text"}


def test_license_retrieval_against_every_window():
    rng, index, missed, total = random.Random(9), license_scan.Index(license_scan.TEMPLATES), 0, 0
    for t, text in enumerate(license_scan.TEMPLATES.values()):
        for share in (0.0, 0.01, 0.03):
            noise = " ".join(rng.choice(["alpha", "beta", "license", "the", "of"]) for _ in range(rng.randint(0, 300)))
            own = " ".join("changed" if rng.random() < share else w for w in text.split())
            found = license_scan.shingles(f"{noise} {own} {noise}")
            retrieved = {k for k, start in index.retrieve(found) if index.verify(found, k, start)[0] >= 0.8}
            for k, name in enumerate(index.names):
                size = len(index.sets[k])
                every = max(len(np.intersect1d(found[p : p + size], index.sets[k])) for p in range(len(found))) / size
                total += every >= 0.8
                missed += every >= 0.8 and k not in retrieved
    assert total > 80 and missed == 0


# ---- archives ----


@pytest.mark.parametrize("split", [97, 4096, 8 << 20])
def test_warc_round_trip(spark, split):
    fake = "\x1f\x8b\x08 WARC/1.1 " * 5
    html = [None, "", "<p>é🎉</p>", "<p>é🎉</p>", fake, "b" * 200_000, "<p>é🎉</p>", "".join(chr(33 + i % 90) for i in range(5000))]
    rows = [(i * 3 - 2, f"http://x/{i}?q=é \r\n" if i else None, h, "x", "x") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, path string, size string").repartition(3)
    got = {r.page_id: r for r in warc.digest(pages, split).collect()}
    first = {}
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        f = first.setdefault(p, i)
        want = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert len(got) == len(rows)


def test_warc_reads_in_several_tasks(spark):
    html = [hashlib.sha512(str(i).encode()).hexdigest() * 40 for i in range(300)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id bigint, url string, html string").repartition(6)
    manifest = warc.write_archives(pages, file_bytes=10_000)
    read = warc.read_archives(manifest, 4096).where("warc_type != 'warcinfo'")
    assert manifest.count() > 1 and read.select(F.spark_partition_id().alias("p"), "record_id").distinct().select("p").distinct().count() > 1
    assert sorted(bytes(r.payload).decode() for r in read.collect()) == sorted(html)


def test_warc_pages_without_an_id(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (None, "v", "b"), (7, None, "b"), (9, "w", "c"), (9, "w", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.digest(pages).collect())
    assert got == [(0, "response", 0, 1)] * 2 + [(0, "revisit", 7, 1), (7, "response", 0, 1)] + [(9, "response", 0, 1)] * 2


def test_join_groups_spreads_hot_groups(spark):
    rows = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)], "k bigint, v bigint")
    groups = cut(rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.min("v").alias("first")).where("n_rows > 1"), "groups")
    got = join_groups(rows, groups, ["k"], F.xxhash64("v"), share=10)
    assert {(r.k, r.v, r.first) for r in got.collect()} == {(i % 3, i, i % 3) if i < 900 else (i, i, None) for i in range(1000)}
    assert join_groups(rows, groups.limit(0), ["k"], F.xxhash64("v")).count() == 1000


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session)


def test_warc_small_payloads_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id bigint, url string, html string")
    read = warc.read_archives(warc.write_archives(pages, min_bytes=3)).where("warc_type != 'warcinfo'")
    assert {r.warc_type for r in read.collect()} == {"response"}
    assert warc.digest(pages.limit(0)).count() == 0


# ---- classifier ----


def test_quality_classifier_on_held_out_labels(spark, sf):
    more = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, more, "documents"), table(spark, more, "labels")
    scored = quality_classifier.classify(docs, labels.where("doc_id % 4 != 0"))
    assert scored.count() == docs.count()
    rows = scored.join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) >= 0.95


def test_quality_classifier_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, ["good words", None, "", "x " * 20_000])
    assert {(r.doc_id, r.score, r.kept) for r in quality_classifier.classify(docs, labels).collect()} == {(i, 1.0, True) for i in range(4)}
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_co_training_teaches_the_other_view(spark):
    rng, rows, truth = random.Random(4), [], {}
    for i in range(1500):
        good = truth[i] = rng.random() < 0.5
        own = [f"{'g' if good else 'b'}{rng.randrange(150)}" if rng.random() < 0.3 else f"n{rng.randrange(400)}" for _ in range(25)]
        rows.append((i, " ".join(own), "en", f"s{2 * rng.randrange(3) + (good if rng.random() < 0.97 else not good)}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(truth[i]), 0) for i in range(0, 1500, 25)], "doc_id bigint, quality int, toxic int")
    right, loss = {}, {}
    for rounds in (0, 2):
        scored = [r for r in quality_classifier.classify(docs, labels, rounds=rounds, confident=0.8).collect() if r.doc_id % 25]
        for c in ("text_score", "meta_score", "score"):
            right[rounds, c] = sum((r[c] >= 0.5) == truth[r.doc_id] for r in scored) / len(scored)
            loss[rounds, c] = -sum(math.log(max(1e-12, r[c] if truth[r.doc_id] else 1 - r[c])) for r in scored) / len(scored)
    assert right[2, "text_score"] > right[0, "text_score"] + 0.03
    assert right[2, "score"] >= max(right[2, "text_score"], right[2, "meta_score"]) - 0.01 and right[2, "score"] >= 0.9, (right, loss)


# ---- pipeline and registry ----


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        assert 0 < docs.count() <= before
        before = docs.count()
        assert docs.columns == columns or name == "bpe"
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_on_odd_rows(spark, sf):
    odd = frame(spark, [None, "", "x " * 30_000, "same words here " * 3, "same words here " * 3]).select(*table(spark, sf, "documents").columns)
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, sf).count() <= 5


def test_registry_names():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
