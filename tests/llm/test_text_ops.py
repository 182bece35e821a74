"""Rules, line dedup, similarity join, BPE and decontamination against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from lodestone.llm.common import byte_bpe_path
from lodestone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _words string, n string, kept string, line string, _doc string, _gone string, _text string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", None, 1, "x", "x", "x", "x", "x", "x", "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    rng = random.Random(4)
    words = ["a", "bb", "The", "é🎉", "#x#", "no!", "12,3"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    made += ["\n".join(rng.choice(made[:8]) for _ in range(6)) for _ in range(20)]
    return [None, "", " \t\n", "one", "x" * 50_000, "w " * 20_000, "a b c d " * 9, *made, made[0], made[0], None]


# ---- quality rules ----


def brute_quality(text):
    t = text or ""
    words = WORD.findall(t)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 8))
    lines = [l for l in t.split("\n") if WORD.search(l)]
    n, chars = len(words), sum(map(len, words))
    symbols, dup, upper, shouts = sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum("A" <= c <= "Z" for c in t), t.count("!")
    base = n < 20 or 100 * len(covered) > 30 * n
    other = 10 * symbols > n or 10 * upper > 4 * chars or 2 * shouts > n or 10 * dup > 4 * len(lines) or chars < 2 * n or chars > 25 * n
    return n, chars, symbols, dup, len(covered), base, not (base or other)


def test_quality_digest(spark):
    texts = odd_texts()
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.digest(frame(spark, texts)).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_quality_order_never_changes_the_verdict(spark):
    docs = frame(spark, odd_texts())
    kept = {r.doc_id for r in quality_rules.keep(docs).collect()}
    assert kept == {i for i, t in enumerate(odd_texts()) if brute_quality(t)[6]}
    for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
        where = quality_rules.with_words(docs).where(f"({quality_rules.cascade_sql(order)}) IS NULL")
        assert {r.doc_id for r in where.select("_row.doc_id").collect()} == kept
    left = quality_rules.keep(docs)
    assert left.dtypes == docs.dtypes and {r._words for r in left.collect()} == {"x"}
    assert quality_rules.judge(docs).drop("rejected_by", "kept").dtypes == [d for d in docs.dtypes if d[0] != "kept"]


def test_quality_order_is_rejections_per_cost():
    a, b, c = quality_rules.RULES[:3]
    assert quality_rules.cascade_order([(a, 1.0, 0.1), (b, 0.1, 0.1), (c, 1.0, 0.0)]) == [b, a, c]


def test_quality_empty(spark):
    assert quality_rules.digest(frame(spark, [])).count() == 0 and quality_rules.keep(frame(spark, [])).count() == 0


# ---- line dedup ----


def brute_lines(texts, least):
    """Lines to delete, by comparing every window with every earlier one."""
    windows = []
    for d, t in enumerate(texts):
        own = [(i, l, len(WORD.findall(l))) for i, l in enumerate((t or "").split("\n")) if WORD.search(l)]
        for a in range(len(own)):
            for step, kind in ((1, 0), (-1, 1)):
                b, n = a, own[a][2]
                while n < least and 0 <= b + step < len(own):
                    b += step
                    n += own[b][2]
                if n >= least:
                    low, high = min(a, b), max(a, b)
                    windows.append((kind, tuple(x[1] for x in own[low : high + 1]), d, own[low][0], own[high][0]))
    first = {}
    for kind, lines, d, low, high in sorted(windows, key=lambda w: w[2:]):
        first.setdefault((kind, lines), (d, low, high))
    gone = {}
    for kind, lines, d, low, high in windows:
        d0, _, high0 = first[kind, lines]
        if d > d0 or (d == d0 and low > high0):
            gone.setdefault(d, set()).update(range(low, high + 1))
    return gone


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))) + f" {i}" for i in range(40)]
    passage = "\n".join(pool[:6])
    texts = ["\n".join(rng.choice(["", *pool]) for _ in range(rng.randint(1, 12))) for _ in range(50)]
    texts += [f"x\n{passage}\ny", f"{passage}\nz", passage, "\n".join([pool[0]] * 30), None, "", "long " * 30_000, "long " * 30_000]
    gone = brute_lines(texts, 20)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts), 20).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(l for k, l in enumerate(t.split("\n")) if k not in gone.get(i, ()))
        assert (got[i].text, got[i].n_deleted) == (want, len(gone.get(i, ()))), i
    assert gone and got[len(texts) - 1].text == "" and got[50].text == f"x\n{passage}\ny"


def test_line_dedup_repeated_rows_and_ids(spark):
    line = "w " * 60
    got = line_dedup.dedup_lines(frame(spark, [line, line, line + "z", "q\n" + line], ids=[5, 5, 5, 6])).collect()
    assert sorted((r.doc_id, r.n_deleted) for r in got) == [(5, 0), (5, 0), (5, 0), (6, 1)]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


# ---- similarity join ----


def brute_classes(texts, percent, size):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_copies(rng, n=25):
    out = []
    for size in (3, 8, 12, 20, 40, 90, 200, 1500, 4000):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(size)]
        for _ in range(n if size < 1000 else 6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6]) * max(1, size // 120)):
                copy[rng.randrange(len(copy))] = "z" + str(rng.randint(0, 99))
            out.append(" ".join(copy[rng.randint(0, 2) :]))
    return out


@pytest.mark.parametrize("percent, size", [(90, 3), (80, 5)])
def test_similarity_classes(spark, percent, size):
    texts = [None, "", " ", "A b", "a B", *near_copies(random.Random(7)), "k " * 30_000]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(frame(spark, texts), percent, size).collect()}
    assert got == brute_classes(texts, percent, size)


def test_wide_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for n, more in ((1100, 0), (2000, 150), (2040, 100), (5000, 3300)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - 40], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert 0.5 * differ < jaccard_join.sketch_distance(jaccard_join.wide_sketch(a), jaccard_join.wide_sketch(b)) <= differ
    assert jaccard_join.wide_sketch(a[:1024]) is None


def test_allocation_covers_every_difference():
    """Any two sets within the bound share a signature, whole against whole or whole against one-deletion."""
    rng, plan, cache = np.random.default_rng(1), jaccard_join.Plan(80, 5), {}
    for _ in range(300):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        d = plan.most(len(a))
        drop = int(rng.integers(0, d + 1))
        b = a[rng.permutation(len(a))[: len(a) - drop]]
        extra = rng.integers(0, 1 << 63, max(0, plan.differences(len(a), len(a)) - drop) // 2).astype(np.uint64)
        b = np.unique(np.concatenate([b, extra]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        (wa, la), (wb, lb) = (tuple(set(x.tolist()) for x in plan.signatures(s, cache)) for s in (a, b))
        assert wa & wb or wa & lb or la & wb


def test_keep_one_and_empty(spark):
    docs = frame(spark, ["a b c d e f g"] * 3 + ["other words are in here now", None, ""])
    assert {r.doc_id for r in jaccard_join.keep_one_per_group(docs).collect()} == {0, 3, 4, 5}
    assert jaccard_join.similarity_classes(frame(spark, [])).count() == 0
    copies = frame(spark, ["a b c"] * 3, ids=[4, 4, 9])
    again = jaccard_join.similarity_classes(copies).collect()
    assert {(r.doc_id, r.component_id) for r in again} == {(4, 4), (9, 4)}
    assert [r.doc_id for r in jaccard_join.keep_one_per_group(copies).collect()] == [4]
    several = frame(spark, ["a b c", "other words", "a b c", "a b c"], ids=[4, 4, None, None])
    assert sorted((r.doc_id or 0, r.text) for r in jaccard_join.keep_one_per_group(several).collect()) == [(0, "a b c")] * 2 + [(4, "a b c"), (4, "other words")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


# ---- BPE ----


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, reference_tokenizer):
    rng = random.Random(6)
    bits = ["a", "b", "th", "ing", "é", "1", "!", "'s", "'S", "ß", "中", " ", "\n", "　", "\x1c", "<|endoftext|>", "🎉"]
    texts = [*odd_texts(), "a" * 5000, " " * 300 + "x", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 50))) for _ in range(400))]
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), byte_bpe_path()).collect()}
    for i, t in enumerate(texts):
        ids = reference_tokenizer.encode(t or "", add_special_tokens=False).ids
        back = reference_tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.digest(frame(spark, []), byte_bpe_path()).count() == 0


def test_bpe_of_one_long_word(reference_tokenizer):
    import tracemalloc

    with open(byte_bpe_path(), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    rng = random.Random(3)
    odd = "".join(rng.choice("abcdefgé") for _ in range(20_000))
    for word in ("ab" * 3000, odd, odd[:1023], odd[:1024]):
        (ids,) = encoder.encode([word])
        assert np.frombuffer(ids, np.int32).tolist() == reference_tokenizer.encode(word, add_special_tokens=False).ids
    tracemalloc.start()
    (ids,) = encoder.encode(["x" * 5_000_000])
    assert encoder.decode(np.frombuffer(ids, np.int32).tolist()) == "x" * 5_000_000
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()
    assert not any(len(w) >= bpe.LONG_WORD for w in [*encoder.known, *encoder.older])


def test_bpe_keeps_columns(spark):
    docs = frame(spark, ["one two"])
    out = bpe.encode(docs, byte_bpe_path())
    assert [r.decoded for r in bpe.decode(out, byte_bpe_path()).collect()] == ["one two"]
    assert out.columns == [*docs.columns, "ids"] and bpe.encode(out, byte_bpe_path()).columns == out.columns


# ---- decontamination ----


def test_word_slots_are_those_of_the_words():
    texts = ["One, two THREE", None, "", "two", "x" * 600_000 + " two", "é-two three", " .. "]
    b = decontaminate._blocks(texts)
    for i, t in enumerate(texts):
        low, high = b.ends[i]
        own = decontaminate.words(t)
        assert b.words(low, high) == own
        assert b.slots[low:high].tolist() == [int(decontaminate.slots_of([w])[0]) for w in own]
    assert len(b.starts) == 4 and b.owner.tolist() == [0, 3, 4, 5]


def test_decontamination(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(some(n)).capitalize() + ". " + " ".join(some(6)) + "." for n in (9, 15, 30, 45, 60) for _ in range(4)] + ["too short", None, ""]
    texts, want = [], set()
    for k, item in enumerate(items[:20]):
        w = item.split()
        edited = [rng.choice(vocabulary) if i % 7 == 3 else x for i, x in enumerate(w)]
        for form in (w, edited):
            want.add((len(texts), k))
            texts.append(" ".join(some(rng.randint(0, 90)) + form + some(rng.randint(0, 90))))
    clean = len(texts)
    texts += [" ".join(some(rng.randint(1, 400))) for _ in range(150)] + [None, "", "z " * 30_000]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = frame(spark, texts)
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert {r.doc_id for r in decontaminate.drop_leaked(docs, bench).collect()} == set(range(clean, len(texts)))
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_paraphrase_needs_the_answer():
    item = decontaminate.Item.of(1, "a b c d e f g h i j. The answer is forty two.")
    near = decontaminate.words("a b x c d y e f z the answer is forty two")
    assert decontaminate.judge(item, near, decontaminate.Limits())[2]
    wrong = decontaminate.words("a b x c d y e f z g the answer is fifty one")
    assert not decontaminate.judge(item, wrong, decontaminate.Limits())[2]
    assert decontaminate.lcs(list("abcde"), list("xaxcxe")) == 3


def made_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def brute_leaks(texts, items, limits):
    """Pairs of which some stretch of the text, of the item's length and up to 45 % more, passes the checks."""
    found = set()
    for k, item in enumerate(items):
        own = decontaminate.Item.of(k, item)
        for d, text in enumerate(texts):
            near, size = decontaminate.words(text), len(own.words)
            if len(set(near) & set(own.words)) * 2 < len(set(own.words)):
                continue
            starts = range(max(1, len(near) - size + 1))
            if any(decontaminate.judge(own, near[s : s + size + int(0.45 * size)], limits)[2] for s in starts):
                found.add((d, k))
    return found


def test_decontamination_with_a_third_of_the_rows_one_leaked_document(spark):
    rng = random.Random(9)
    vocabulary = made_words(rng, 3000)
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(some(n)) + "." for n in (8, 15, 15, 30, 60)]
    hot = " ".join(some(20) + items[1].split() + some(20))
    texts = [hot] * 150 + [" ".join(some(rng.randint(30, 200))) for _ in range(280)]
    for item in items:
        for edits in (0, 0, 1, 3):
            w = item.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(some(rng.randint(0, 90)) + w + some(rng.randint(0, 90))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = brute_leaks(texts, items, decontaminate.Limits())
    assert {(d, 1) for d in range(150)} <= want and len(want) >= 150 + 17
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    assert found == want


def test_decontamination_of_long_items(spark):
    rng = random.Random(10)
    vocabulary = made_words(rng, 6000)
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(n) for n in (97, 300, 400, 600, 2000)]
    texts, want = [], set()
    for k, item in enumerate(items):
        spread = [x for w in item for x in (w, rng.choice(vocabulary))]  # no two words of the item are neighbours
        for form in (item, spread):
            want.add((len(texts), k))
            texts.append(" ".join(some(rng.randint(0, 90)) + form + some(rng.randint(0, 90))))
    texts += [" ".join(items[4][:300])] + [" ".join(some(rng.randint(1, 900))) for _ in range(150)]
    bench = spark.createDataFrame([(k, " ".join(i) + ".") for k, i in enumerate(items)], "item_id bigint, text string")
    limits = decontaminate.Limits(rank=64)  # below the pieces of the longest item
    for given in (decontaminate.Limits(), limits):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), bench, given).collect()} == want


def test_decontamination_of_short_items_among_rare_words(spark):
    rng = random.Random(11)
    common, rare = made_words(rng, 400), iter(made_words(rng, 40_000))
    some = lambda n: [next(rare) for _ in range(n)]
    items = [rng.sample(common, n) for n in (8, 8, 9, 10, 12, 15)]
    texts = []
    for item in items:
        spread = [x for w in item for x in (w, next(rare))]  # no two words of the item are neighbours
        for form in (item, [*item[:3], next(rare), *item[4:]], spread):
            texts.append(" ".join(some(rng.randint(40, 90)) + form + some(rng.randint(40, 90))))
    planted = {(d, d // 3) for d in range(len(texts))}
    texts += [" ".join(rng.choice(common) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    bench = spark.createDataFrame([(k, " ".join(i) + ".") for k, i in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    assert found == planted
    exact = brute_leaks(texts, [" ".join(i) + "." for i in items], decontaminate.Limits())
    assert exact <= found and len(exact) >= 12


def test_decontamination_in_several_passes_with_short_and_equal_items(spark):
    rng = random.Random(12)
    vocabulary = made_words(rng, 2000)
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(n) for n in (4, 5, 6, 7, 5, 20, 30, 40, 25, 60, 33)]
    items.append(items[1])
    texts = [" ".join(some(rng.randint(0, 60)) + i + some(rng.randint(0, 60))) for i in items]
    texts += [" ".join(some(40) + [w for w in items[3] for w in (w, "xx")]), *(" ".join(some(50)) for _ in range(60)), None, ""]
    ids = [None if k == 5 else k for k in range(len(texts))]
    docs = frame(spark, texts, ids)
    bench = spark.createDataFrame([(k, " ".join(i).upper() + ".") for k, i in enumerate(items)], "item_id bigint, text string")
    want = {(None if k == 5 else k, k) for k in range(1, 12)} | {(1, 11), (11, 1)}
    for limits in (decontaminate.Limits(), decontaminate.Limits(rank=2, parts_at_once=2)):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, limits).collect()} == want
        left = decontaminate.drop_leaked(docs, bench, limits)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {0, *range(12, len(texts))}


def test_recall_by_strength_of_paraphrase(spark):
    """All pairs that an exhaustive check of every stretch accepts, for each share of changed words."""
    rng = random.Random(13)
    vocabulary = made_words(rng, 4000)
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(rng.randint(10, 70)) for _ in range(12)]
    texts, strength = [], []
    for share in (0.0, 0.1, 0.2, 0.3, 0.4):
        for item in items:
            copy = [w if rng.random() >= share or i >= len(item) - 3 else rng.choice([[], some(1), [*some(1), w]]) for i, w in enumerate(item)]
            copy = [x for w in copy for x in (w if isinstance(w, list) else [w])]
            texts.append(" ".join(some(rng.randint(0, 80)) + copy + some(rng.randint(0, 80))))
            strength.append(share)
    shown = [" ".join(i[:-3]) + ". " + " ".join(i[-3:]) + "." for i in items]
    bench = spark.createDataFrame(list(enumerate(shown)), "item_id bigint, text string")
    want = brute_leaks(texts, shown, decontaminate.Limits())
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    for share in sorted(set(strength)):
        own = {(d, k) for d, k in want if strength[d] == share}
        print(share, len(own), len(own & found))
        assert len(own) >= 6 and len(own & found) >= 0.9 * len(own)


@pytest.mark.parametrize("block", [512, 3])
def test_link_counts(spark, monkeypatch, block):
    """Copies, near copies in a chain, strangers, empty texts: every document's links against brute force, in one block and in many."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    texts = ["", None, "alone in the world here", "alone in the world here"]
    for k in range(30):
        words = list(base)
        for at in rng.choice(60, k % 7, replace=False):
            words[at] = f"x{rng.integers(20)}"
        texts += [" ".join(words)] * int(rng.integers(1, 4))
    texts += [" ".join(f"y{i + k}" for i in range(40)) for k in range(0, 12, 2)]
    sets = [set(jaccard_join.shingle_set(t, 3).tolist()) for t in texts]
    want = [sum(j != i and bool(a) and 100 * len(a & b) >= 70 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r.doc_id: r.n_links for r in jaccard_join.similarity_classes(frame(spark, texts), 70, 3, links=True).collect()}
    assert [got[i] for i in range(len(texts))] == want and max(want) > 10
    assert jaccard_join.similarity_classes(frame(spark, []), links=True).count() == 0
