import pytest
from pyspark.sql import functions as F

from lodestone.operators import capability, dialog, documents, evals, evidence, grounding, html, products, release, search

CAPS = "cap_id string, family_id string, capacity_min double, capacity_max double, capacity_unit string, discharge_p_min double, discharge_p_max double, pressure_unit string, lubricated boolean, standards array<string>"


@pytest.fixture(scope="module")
def seed(spark):
    rows = [
        ("cap.001", "f1", None, 20000.0, "Nm3/hr", None, 50.0, "barg", False, ["API-618"]),
        ("cap.002", "f1", None, 20000.0, "Nm3/hr", None, 1000.0, "barg", None, ["API-618"]),
        ("cap.003", "f2", 10000.0, 100000.0, "SCMD", None, 120.0, "barg", None, None),
        ("cap.h2_700", "f1", None, 700.0, "Nm3/hr", None, 850.0, "barg", None, None),
        ("cap.h2_kghr", "f1", 35.0, 65.0, "Kg/hr", 250.0, 850.0, "barg", None, None),
        ("cap.h2_fuel", "f1", None, None, None, 350.0, 350.0, "barg", None, None),
    ]
    gases = [("cap.001", "oxygen"), ("cap.002", "hydrogen"), ("cap.003", "natural gas"), ("cap.h2_700", "Hydrogen "), ("cap.h2_kghr", "hydrogen"), ("cap.h2_fuel", "hydrogen"), ("cap.002", "H2")]
    families = spark.createDataFrame([("f1", "Process"), ("f2", "Booster")], "family_id string, name string")
    return spark.createDataFrame(rows, CAPS), families, spark.createDataFrame(gases, "cap_id string, gas string")


def matched(seed, *args, **kw):
    return {r.cap_id: r for r in capability.match(*seed, *args, **kw).collect()}


def test_capability_match(seed):
    got = matched(seed, "h2", 3000, "Nm3/hr", 350, {"H2": "hydrogen"}, lubricated=False)
    assert {k: r.status for k, r in got.items()} == {"cap.002": "match", "cap.h2_kghr": "candidate", "cap.h2_fuel": "candidate"}
    best = got["cap.002"]
    assert (round(best.headroom_capacity, 9), round(best.headroom_pressure, 9), best.near_edge, best.same_unit, best.converted_capacity) == (0.85, 0.65, False, True, None)
    assert got["cap.h2_kghr"].reason == "capacity unit not comparable" and got["cap.h2_fuel"].reason == "capacity not published"
    assert not matched(seed, "hydrogen", 3000, "Nm3/hr", 1200)


def test_conversion_and_relaxation(seed):
    got = matched(seed, "natural gas", 1000, "Nm3/hr", 100)
    assert got["cap.003"].converted_capacity == 24000.0
    relaxed = matched(seed, "hydrogen", 3000, "nm3/h", 350, standard="ISO-1", relax=True)
    assert relaxed["cap.002"].relaxed
    assert not matched(seed, "hydrogen", 3000, "nm3/h", 350, standard="API-618", relax=True)["cap.002"].relaxed
    with pytest.raises(Exception, match="unknown capacity unit"):
        matched(seed, "hydrogen", 1, "furlong", 1)


def test_product_tiers(spark):
    fams = spark.createDataFrame([("fam.smart", "Smart KDX"), ("fam.kdx", "KDX Series"), ("fam.gas", "Gas Boosters")], "family_id string, name string")
    prods = spark.createDataFrame([("p1", "fam.kdx", "KDX-16", None), ("p2", "fam.kdx", "KDX-13/16", "Electric"), ("p3", "fam.smart", None, "KDX-16 smart")], "product_id string, family_id string, model_name string, variant string")
    tiers = lambda q: [(r.matched_by, r.family_id, r.product_id) for r in products.resolve(fams, prods, q).orderBy("position").collect()]
    assert tiers("kdx 16") == [("model", "fam.kdx", "p1"), ("model", "fam.smart", "p3"), ("model", "fam.kdx", "p2")]
    assert tiers("KDX-13")[0] == ("model_variant", "fam.kdx", "p2")
    assert tiers("gas boosters") == [("family_envelope", "fam.gas", None)]
    assert {t[0] for t in tiers("smart unit")} == {"family_contains"}
    assert tiers("nothing here") == []


def test_listing_and_offices(spark):
    fams = spark.createDataFrame([("a", "D1", "Air"), ("b", "D2", "Gas")], "family_id string, division string, category string")
    prods = spark.createDataFrame([("p2", "a"), ("p1", "a")], "product_id string, family_id string")
    assert {r.family_id: r.products for r in products.grouped(fams, prods).collect()} == {"a": ["p1", "p2"], "b": []}
    assert [r.family_id for r in products.grouped(fams, prods, category="gas").collect()] == ["b"]
    offices = spark.createDataFrame([("o1", "Head office", "Delhi", "North"), ("o2", "Branch", "Pune", "West")], "office_id string, name string, city string, region string")
    states = spark.createDataFrame([("Maharashtra", "o2")], "state string, office_id string")
    pick = lambda **k: products.office(offices, states, **k).first()
    assert pick(city="pune").office_id == "o2" and pick(state="maharashtra").office_id == "o2"
    assert pick(region="north").office_id == "o1" and not pick(region="north").fallback
    assert pick(city="Oslo").office_id == "o1" and pick(city="Oslo").fallback


def test_hybrid_search(spark):
    chunks = spark.createDataFrame([("c1", "d1", [1.0, 0.0, 0.0], "oxygen pump"), ("c2", "d1", [0.0, 1.0, 0.0], "hydrogen booster"), ("c3", "d2", [0.0, 0.0, 1.0], "hydrogen line")], "chunk_id string, doc_id string, embedding array<float>, content string")
    docs = spark.createDataFrame([("d1", "T1", "u1"), ("d2", "T2", "u2")], "doc_id string, title string, url string")
    got = {r.chunk_id: r.score for r in search.hybrid(chunks, docs, "the hydrogen", [0.0, 1.0, 0.0]).collect()}
    assert got["c2"] == round(1 / 61 + 1 / 61, 6) and set(got) == {"c1", "c2", "c3"}
    tagged = chunks.withColumn("family_ids", F.array(F.col("doc_id")))
    assert [r.chunk_id for r in search.filtered(tagged, family_ids=["d2"]).collect()] == ["c3"]
    fams = spark.createDataFrame([("d1", "X")], "family_id string, division string")
    assert {r.chunk_id for r in search.filtered(tagged, fams, division="X").collect()} == {"c1", "c2"}
    assert search.text_arm(chunks, "the").count() == 0


HTML = """<html><head><title>Pumps &amp; more</title></head><body><nav><a href=x>Home</a></nav><!-- c --><h1>Pumps</h1>
<p>Rated&nbsp;at <b>5&nbsp;bar</b>.<br>See <a href="/d/sheet.PDF">sheet</a> or <a href="/p">page</a>.<p>Second <a href="#">Read More</a>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table><ul><li>one<li>two</ul><img alt="Image"><img alt="Pump view"><div class="ad x">buy</div>
<h2>Read more</h2><script>var t="</p>";</script></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "https://x.org/a/", HTML), (2, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html.to_markdown(pages, strip=("nav", ".ad.x")).collect()}
    assert got[1].title == "Pumps & more" and (got[1].headings, got[1].tables) == (1, 1)
    assert got[1].markdown.split("\n\n") == [
        "# Pumps", "Rated at 5 bar. See [sheet](https://x.org/d/sheet.PDF) or page.", "Second", "| A | B |\n| --- | --- |\n| 1 |  |", "- one\n- two", "Pump view",
    ]
    assert got[2].markdown == ""
    with pytest.raises(ValueError, match="not supported"):
        html.selects("nav > a")


def test_patch():
    diff = "--- a\n+++ b\n@@ -1,3 +1,3 @@\n one\n-two\n+2\n three\n"
    assert html.apply_diff("one\ntwo\nthree\nfour", diff) == "one\n2\nthree\nfour"
    with pytest.raises(ValueError, match="differs"):
        html.apply_diff("one\nTWO\nthree", diff)


MD = "intro\n\n# A\n<!-- page 1 -->\ntext\n## B\n<!-- page 2 -->\nmore\n#### deep\nbody\n# C"


def test_sections(spark):
    docs = spark.createDataFrame([("d", MD), ("e", "# Only"), ("f", None)], "doc_id string, body string")
    got = [(r.section_id, r.heading_path, r.locator, r.text) for r in documents.sections(docs).orderBy("section_id").collect()]
    assert got == [
        ("d::s000", [], "(preamble)", "intro"), ("d::s001", ["A"], "p1 §A", "text"), ("d::s002", ["A", "B"], "p1-2 §A › B", "more\n#### deep\nbody"),
        ("d::s003", ["C"], "p2 §C", ""), ("e::s000", ["Only"], "§Only", ""),
    ]


def test_front_matter(spark):
    made = spark.createDataFrame([("b\n", 'T "x"')], "b string, t string").select(documents.render(F.col("b"), title=F.col("t"), kind=F.lit("pdf")).alias("md"))
    r = made.select(documents.front_matter(F.col("md")).alias("f")).first().f
    assert (r.title, r.kind, r.url, r.body) == ('T "x"', "pdf", None, "b\n")


def test_chunks(spark):
    para = " ".join(f"w{i}" for i in range(20))
    parts = spark.createDataFrame([("doc.p", 0, ["H"], "§H", f"{para}\n\nown"), ("doc.h", 0, ["H"], "§H", para)], "doc string, position int, heading_path array<string>, locator string, text string")
    owners = documents.paragraph_owners(spark.createDataFrame([("doc.p", "pdf", para), ("doc.h", "html", para), ("doc.h", "html", para)], "doc string, kind string, text string"))
    assert [(r.owner, r.docs) for r in owners.collect()] == [("doc.p", 2)]
    got = documents.chunks(parts, owners).collect()
    assert [(r.chunk_id, r.token_count) for r in got] == [("ch.p.0000", 22)]
    long = "\n\n".join(" ".join([f"p{i}"] * 300) for i in range(5))
    windows = documents.pack(long, documents.count_words)
    assert [documents.count_words(w) for w in windows] == [600, 660, 360] and windows[1].startswith("p1 ")
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" for i in range(50))
    pieces = documents.pack(table, documents.count_words, budget=100, shared=0)
    assert len(pieces) > 1 and all("| a | b |" in p for p in pieces)
    with pytest.raises(ValueError, match="row exceeds"):
        documents.split_table("| a |\n| --- |\n| " + "x " * 50 + "|", documents.count_words, 10, 20)


def test_dispositions(spark):
    links = " ".join(f"[l{i}](u{i})" for i in range(12))
    docs = spark.createDataFrame([("hub", links), ("page", "word " * 80), ("stub", "two words"), ("mine", "x")], "doc_id string, body string")
    over = spark.createDataFrame([("mine", "chunk")], "doc_id string, disposition string")
    assert {r.doc_id: r.disposition for r in documents.dispositions(docs, over).collect()} == {"hub": "reference_only", "page": "chunk", "stub": "excluded", "mine": "chunk"}


def test_tags(spark):
    found = spark.createDataFrame([("d", "c1", ["H"], "the Booster line"), ("d", "c2", ["X"], "none")], "doc string, chunk_id string, heading_path array<string>, content string")
    fams = spark.createDataFrame([("f1", "booster", "B"), ("f2", "Other", "A")], "family_id string, name string, division string")
    cover = spark.createDataFrame([("d", "h", "f2")], "doc string, heading string, family_id string")
    got = {r.chunk_id: (r.family_ids, r.division) for r in documents.tag(found, fams, cover).collect()}
    assert got == {"c1": (["f1", "f2"], "A"), "c2": ([], None)}


def test_witness(spark):
    rows = spark.createDataFrame([("u", "1,000 barg ISO 9001:2015 API-618 1000", "1000 bar ISO9001:2015")], "url string, w string, md string")
    got = {(r.token, r.missing) for r in documents.missing_tokens(rows, "url", "w", "md").collect()}
    assert got == {("1000", 1), ("barg", 1), ("API618", 1), ("618", 1)}
    models = spark.createDataFrame([("u", "KDX-12/14 and Vista", "kdx 12/14")], "url string, w string, md string")
    assert {r.token for r in documents.missing_tokens(models, "url", "w", "md", ("KDX",), ("vista",)).collect()} == {"VISTA"}
    junk = spark.createDataFrame([("1. Home > x\nImage\nRead more\na",)], "md string").select(documents.junk(F.col("md")).alias("j")).first().j
    assert junk == ["breadcrumb_list", "bare_image_node", "read_more_stub", "teaser_card_link", "orphan_single_char_line"]


def test_similar_pairs(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "J i h g f e d c b a"), (3, "a b c d e f g h i k"), (4, ""), (5, None), (6, "a b c d e f g h i j k")], "doc_id int, text string")
    assert {(r.a, r.b) for r in documents.similar_pairs(docs).collect()} == {(1, 2), (1, 6), (2, 6), (3, 6)}


def test_release(spark):
    ledger = spark.createDataFrame([("rc.x.0001", "x", None, "open")], "id string, client string, created_at timestamp, status string")
    assert {r.id for r in release.create_candidate(ledger, "x").collect()} == {"rc.x.0001", "rc.x.0002"}
    assert release.set_status(ledger, "rc.x.0001", "exported").first().status == "exported"
    with pytest.raises(ValueError):
        release.set_status(ledger, "rc.x.0001", "done")
    staged = spark.createDataFrame([("p1", 1, "pending"), ("p2", 2, "approved")], "id string, v int, review_status string")
    decisions = spark.createDataFrame([("p1", " Edit ", 9), ("p2", "", None), ("p9", "approve", None), ("p1", "maybe", None)], "id string, decision string, v int")
    assert {(r.id, r.error) for r in release.review_errors(staged, decisions, ["id"]).collect()} == {("p9", "unknown row"), ("p1", "unknown decision")}
    done = {r.id: (r.v, r.review_status) for r in release.apply_review(staged, decisions.limit(2), ["id"], ["v"]).collect()}
    assert done == {"p1": (9, "edited"), "p2": (2, "approved")}
    fresh = spark.createDataFrame([("p2", 7, "pending"), ("p3", 3, "pending")], "id string, v int, review_status string")
    assert {(r.id, r.v) for r in release.replace_pending(staged, fresh, ["id"]).collect()} == {("p2", 2), ("p3", 3)}
    child = spark.createDataFrame([("p1", "g", "pending")], "id string, gas string, review_status string")
    parents = spark.createDataFrame([("p1", "rejected")], "id string, review_status string")
    assert release.reject_children(child, parents, "id").first().review_status == "rejected"
    releases = spark.createDataFrame([("r1", True), ("r2", False)], "release_id string, is_active boolean")
    assert {r.release_id: r.is_active for r in release.activate(releases, "r2").collect()} == {"r1": False, "r2": True}
    with pytest.raises(Exception, match="unknown release"):
        release.activate(releases, "r9").collect()


def test_promote(spark):
    staged = {
        "capability_row": spark.createDataFrame([("c1", "f1", "approved"), ("c2", "f2", "rejected")], "cap_id string, family_id string, review_status string"),
        "capability_gas": spark.createDataFrame([("c1", "h2", "approved"), ("c2", "h2", "approved")], "cap_id string, gas string, review_status string"),
        "office": spark.createDataFrame([("o1", "edited")], "office_id string, review_status string"),
    }
    fams = spark.createDataFrame([("f1",), ("f2",)], "family_id string")
    regions = spark.createDataFrame([("S", "o1"), ("T", "o2")], "state string, office_id string")
    new = release.promote(staged, "r2024.01.1", fams, regions)
    assert {k: v.count() for k, v in new.items()} == {"capability_row": 1, "capability_gas": 1, "office": 1, "product_family": 1, "region_state": 1}


def test_evidence_gate(spark):
    rows = [("s", "name", "A", "the  Name", "of the Name here"), ("s", "cap", "B", "The name", "of the Name here"), ("s", "gases[0]", "x", "", "of"), ("s", "gases[1]", "y", "of", "of")]
    kept, dropped = evidence.gate(spark.createDataFrame(rows, "section_id string, path string, value string, evidence string, section_text string"))
    assert {(r.path, r.value) for r in kept.collect()} == {("name", "A"), ("cap", None), ("gases[1]", "y")}
    assert {r.path for r in dropped.collect()} == {"cap", "gases[0]"}


def test_capability_rows(spark):
    items = spark.createDataFrame([("d::s1", 0, "f1", "Up to 20,000 Nm3/hr", "up to 50 bar", ["h2", ""], "§A"), ("d::s1", 1, "zz", None, None, None, "§A")], "section_id string, i int, family_id string, capacity string, pressure string, gases array<string>, source_locator string")
    rows, gases = evidence.capability_rows(items, spark.createDataFrame([("f1",)], "family_id string"))
    got = {r.cap_id: r for r in rows.collect()}
    assert got["cap.d_s1.0"].capacity_max == 20000.0 and got["cap.d_s1.0"].discharge_p_max == 50.0 and got["cap.d_s1.1"].needs_family
    assert [r.gas for r in gases.collect()] == ["h2", ""]


def test_seams(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "fail")], "id int, prompt string")

    def call(p):
        if p == "fail":
            raise ValueError
        return p.upper()

    assert {(r.id, r.reply, r.skipped) for r in evidence.complete(prompts, call).collect()} == {(1, "A", False), (2, None, True)}
    chunks = spark.createDataFrame([("c", "x")], "chunk_id string, content string")
    assert evidence.embed(chunks, lambda ts: [[1.0, 2.0] for _ in ts], 2).first().embedding == [1.0, 2.0]
    with pytest.raises(Exception, match="wrong count or dimension"):
        evidence.embed(chunks, lambda ts: [[1.0]], 2).collect()


def test_grounding(spark):
    answers = spark.createDataFrame([("a", "25,000 Nm3/hr [1]", 1, "en"), ("b", "99 bar", 1, "hi"), ("c", "plain", 0, None)], "id string, text string, n_cited int, language string")
    allowed = grounding.universe(spark.createDataFrame([("a", '{"x":25000.0}')], "id string, t string"), "id", "t")
    got = {r.id: r for r in grounding.gate(grounding.guard(answers, allowed, "id")).collect()}
    assert got["a"].status == "full" and got["b"].reason == "unsourced_numbers:[99.0]" and got["c"].reason == "uncited"
    assert got["b"].reply == grounding.FALLBACK["hi"] and got["c"].reply == grounding.FALLBACK["en"] and got["a"].claims == 1


def test_used_documents(spark):
    answers = spark.createDataFrame([("a", "hydrogen booster package")], "answer_id string, text string")
    schema = "answer_id string, rank int, doc_id string, chunk_id string, content_md string, title string"
    rows = [("a", 1, "d2", "c3", "package only", None), ("a", 2, "d1", "c2", "booster", None), ("a", 3, "d1", "c1", "hydrogen booster", None)]
    pick = lambda rs: [(r.doc_id, r.chunk_id) for r in grounding.used_documents(answers, spark.createDataFrame(rs, schema)).orderBy("position").collect()]
    assert pick(rows) == [("d1", "c1")]
    assert pick([("a", 1, "d2", "c3", "package here", "Booster"), *rows[1:]]) == [("d2", "c3"), ("d1", "c1")]
    assert pick([("a", 1, "d2", "c3", "nothing", None), ("a", 2, "d1", "c2", "booster", None)]) == [("d1", "c2")]
    assert pick([("a", 1, "d2", "c3", "nothing", None), ("a", 2, "d1", "c2", None, None)]) == [("d2", "c3")]


def test_sources(spark):
    cited = spark.createDataFrame([("a", "fact", "x", 1), ("a", "fact", "y", 2), ("a", "chunk", "z", 3), ("a", "fact", "lost", 4)], "answer_id string, kind string, ref_id string, position int")
    places = spark.createDataFrame([("fact", "x", "d2", "§H"), ("fact", "y", "d1", None), ("chunk", "z", "d2", "p4-5 §H")], "kind string, ref_id string, doc_id string, locator string")
    docs = spark.createDataFrame([("d1", "html", "", "https://x.org/our-line.html"), ("d2", "pdf", "Sheet", "u.pdf")], "doc_id string, kind string, title string, url string")
    got = [(r.doc_id, r.title, r.link) for r in grounding.sources(cited, places, docs).orderBy("position").collect()]
    assert got == [("d2", "Sheet", "u.pdf#page=4"), ("d1", "our-line", "https://x.org/our-line.html")]


def test_dialog(spark):
    turns = spark.createDataFrame([("s", 1, "h2", 5.0, False), ("s", 2, None, None, False), ("s", 3, None, 7.0, True), ("s", 4, None, None, None)], "session_id string, seq int, gas string, capacity double, full boolean")
    got = [(r.gas, r.capacity) for r in dialog.carry_forward(turns, ("gas", "capacity")).orderBy("seq").collect()]
    assert got == [("h2", 5.0), ("h2", 5.0), (None, 7.0), (None, 7.0)]
    calls = spark.createDataFrame([("s", 1, "m1"), ("s", 3, "m3")], "session_id string, seq int, tool string")
    assert [r.prior_tool for r in dialog.last_before(turns, calls).orderBy("seq").collect()] == [None, "m1", "m1", "m3"]
    guarded = dialog.guard_filters(spark.createDataFrame([("oil-free please", False, "API"), ("to API 618", True, "API")], "text string, lubricated boolean, standard string"))
    assert [(r.lubricated, r.standard) for r in guarded.collect()] == [(False, None), (None, "API")]
    slots = spark.createDataFrame([("h2", "5", None, None), ("h2", "5", "cfm", None)], "gas string, capacity string, capacity_unit string, discharge_p string")
    assert [r.m for r in slots.select(dialog.first_missing_duty().alias("m")).collect()] == ["capacity", "discharge_p"]


def test_evals(spark):
    f = spark.createDataFrame([(["a"], ["a", "b"]), (["a", "c"], ["a"]), ([], None)], "e array<string>, g array<string>")
    assert [r.s for r in f.select(evals.fact_layer(F.col("e"), F.col("g")).alias("s")).collect()] == ["pass", "fail", "na"]
    e = spark.createDataFrame([("answer", "answer", "It is 25,000 bar", ["25000"], ["99"])], "o string, x string, t string, c array<string>, f array<string>")
    assert e.select(evals.e2e_errors(*map(F.col, "oxtcf")).alias("e")).first().e == []
    s = spark.createDataFrame([([], None), (["x"], []), (["x"], ["y"])], "a array<string>, b array<string>")
    assert [r.s for r in s.select(evals.e2e_layer(F.col("a"), F.col("b")).alias("s")).collect()] == ["pass", "flaky", "fail"]
