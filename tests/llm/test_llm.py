"""The llm operators against plain Python, with the edge cases their docstrings name."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stallwright.llm import leakage, pairs, skeleton, vocabulary
from stallwright.llm.mixture import Mixture, budgets, sized_documents
from stallwright.storage import scratch

PRODUCTS = "product_id string, name string, tags string, term string, records string"


def products(spark, rows):
    return vocabulary.records(spark.createDataFrame([(*r, "clash", "clash") for r in rows], PRODUCTS), "product_id", ["name", "tags"])


def plain_terms(rows):
    import re

    texts = {}
    for key, *fields in rows:
        key = (key or "").strip().lower()
        if key:
            texts.setdefault(key, set()).update((k, f) for k, f in enumerate(fields) if f is not None)
    occurrences, held = Counter(), Counter()
    for own in texts.values():
        words = [w.lower() for _, t in own for w in re.findall("[A-Za-z0-9]+", t)]
        occurrences.update(words)
        held.update(set(words))
    return {w: (n, held[w]) for w, n in occurrences.items()}, len(texts)


ROWS = [("P1", "Red mug", "red"), ("p1 ", "Red mug", "red"), ("p2", "blue-tee x2", None), ("p3", None, None), ("p4", "", "red"), (None, "ghost", "ghost"), (" ", "ghost", ""), ("p5", "same", "same"), ("p6", "naïve Ünder", "a_b")]


def test_terms(spark):
    counts = vocabulary.TermCounts(spark).add(products(spark, ROWS))
    want, n = plain_terms(ROWS)
    assert {r.term: (r.occurrences, r.records) for r in counts.counts().collect()} == want and counts.size == n
    empty = vocabulary.TermCounts(spark).add(products(spark, []))
    assert empty.counts().count() == 0 and empty.size == 0


def test_terms_follow_changes(spark):
    later = [("p1", "Red cup", "red"), ("p2", "blue-tee x2", None), ("p7", "new red", "new"), ("p5", "same", "same")]
    old, new = products(spark, ROWS), products(spark, later)
    counts = vocabulary.TermCounts(spark, scratch(spark, "t")).add(old)
    counts.apply(vocabulary.changes(old, new))
    want, n = plain_terms(later)
    again = vocabulary.TermCounts(spark, counts.store.path)
    assert {r.term: (r.occurrences, r.records) for r in again.counts().collect()} == want and again.size == n
    assert vocabulary.changes(new, new).count() == 0


@pytest.mark.parametrize("hot", [10**6, 0])
def test_terms_of_hot_records(spark, monkeypatch, hot):
    monkeypatch.setattr(vocabulary, "HOT_TEXTS", hot)  # 0: every record of more than a thousandth of the texts takes the way of hot ones
    rows = ROWS + [("hot", f"word{k % 7} every", "red") for k in range(300)]
    counts = vocabulary.TermCounts(spark).add(products(spark, rows))
    want, n = plain_terms(rows)
    assert {r.term: (r.occurrences, r.records) for r in counts.counts().collect()} == want and counts.size == n


def test_bands(spark):
    rows = [(f"p{k}", "every " + ("some" if k < 3 else "x"), None) for k in range(30)]
    counts = vocabulary.TermCounts(spark).add(products(spark, rows))
    words = spark.createDataFrame([("Every ",), ("every",), ("some",), ("none",), (None,), (" ",)], "term string")
    assert {(r.term, r.records, r.band) for r in vocabulary.banded(counts, words).collect()} == {("every", 30, "common"), ("some", 3, None), ("none", 0, "rare")}


def plain_pairs(rows, least):
    baskets = {}
    for b, i in rows:
        b, i = (b or "").strip().lower(), (i or "").strip().lower()
        if b and i:
            baskets.setdefault(b, set()).add(i)
    singles = Counter(i for own in baskets.values() for i in own)
    both = Counter(p for own in baskets.values() for p in itertools.combinations(sorted(own), 2))
    return {p: (n, singles[p[0]], singles[p[1]], round(n * len(baskets) / (singles[p[0]] * singles[p[1]]), 9)) for p, n in both.items() if n >= least}


def shop(rng, big=()):
    rows = [(f"s{rng.randrange(60)}", f"i{rng.randrange(25)}") for _ in range(900)] + [(" S1", "I1"), (None, "i1"), ("s1", None), ("", "i2")] * 2
    return rows + [(name, f"i{k}") for name, n in big for k in range(n)]


def members(spark, rows):
    return pairs.memberships(spark.createDataFrame([(*r, "clash", 1) for r in rows], "basket string, item string, a string, n int"), "basket", "item")


def scored(counts):
    return {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b, round(r.lift, 9)) for r in counts.scores().collect()}


@pytest.mark.parametrize("hashed", [True, False])
@pytest.mark.parametrize("long", [1000, 12])
def test_pairs(spark, monkeypatch, hashed, long):
    monkeypatch.setattr(pairs, "LONG", long)  # 12: more long baskets than slots, so blocks are used too
    rows = shop(random.Random(2), [(f"big{k}", 20 + k) for k in range(6)])
    counts = pairs.PairCounts(spark, min_count=3, hashed=hashed).apply(members(spark, rows))
    assert scored(counts) == plain_pairs(rows, 3)
    assert not counts.collided


@pytest.mark.parametrize("long", [1000, 12])
def test_pairs_follow_changes(spark, monkeypatch, long):
    monkeypatch.setattr(pairs, "LONG", long)
    old = shop(random.Random(4), [("big0", 25), ("big1", 30), ("big2", 22)])
    new = [r for r in old if r[0] not in ("s3", "big1")] + [("s4", "fresh"), ("big0", "fresh"), ("more", "i1"), ("more", "i2")]
    then, now = members(spark, old), members(spark, new)
    changed = then.exceptAll(now).unionByName(now.exceptAll(then)).select("basket").distinct()
    counts = pairs.PairCounts(spark, min_count=3).apply(then)
    counts.apply(then.join(changed, "basket", "left_semi"), -1).apply(now.join(changed, "basket", "left_semi"))
    want = plain_pairs(new, 3)
    assert scored(counts) == want
    touched = spark.createDataFrame([("i1",)], "item string")
    assert {(r.item_a, r.item_b) for r in counts.counts(touched).collect()} == {p for p in want if "i1" in p}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_pair_scores_recompute_what_changed(spark, monkeypatch, few):
    monkeypatch.setattr(pairs, "FEW_ITEM_CHARS", few)
    old = shop(random.Random(7))
    new = [r for r in old if r[0] != "s3"] + [("s4", "fresh"), ("more", "i1"), ("more", "i2")]
    then, now = members(spark, old), members(spark, new)
    changed = then.exceptAll(now).unionByName(now.exceptAll(then)).select("basket").distinct()
    counts = pairs.PairCounts(spark, min_count=3).apply(then)
    scores = pairs.PairScores(counts)
    was, is_now = then.join(changed, "basket", "left_semi"), now.join(changed, "basket", "left_semi")
    counts.apply(was, -1).apply(is_now)
    got = scores.refresh(was.unionByName(is_now)).read().collect()
    assert {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b, round(r.lift, 9)) for r in got} == plain_pairs(new, 3) and len(got) == len(plain_pairs(new, 3))


def test_no_pairs(spark):
    assert pairs.PairCounts(spark).apply(members(spark, [])).scores().count() == 0
    assert pairs.PairCounts(spark).apply(members(spark, [("a", "x")] * 9)).scores().count() == 0


SAME = [
    ("Price 12", "Ｐｒｉｃｅ　１２"), ("café", "café"), ("office fluff", "oﬃce ﬂuﬀ"), ("ab", "a​b"), ("ab", "a­b﻿"), ("a b", "a b"), ("a b", "a b"),
    ("scope", "ѕсоре"), ("HELP", "НЕLР"), ("Zoom", "Ζооm"), ("ё", "ё"), ("naïve", "nаїve".replace("і", "i")), ("ṩ", "ṩ"),
]
SAME += [("Ѵѵ", "Vv"), ("Ӕӕ", "Ææ"), ("Әә", "Əə"), ("Өө", "Ɵɵ"), ("Σ", "Ʃ"), ("ɩ", "ι"), ("ӡ", "ʒ"), ("ѱ", "ψ"), ("ф", "φ"), ("a‑b", "a‐b"), ("𝐀𝟏", "A1"), ("µ", "μ")]
APART = [("cafe", "café"), ("a", "A"), ("x2", "x3"), ("x²", "x2"), ("one", "two"), ("a b", "ab"), ("l1", "ll"), ("É", "È"), ("и", "й")]


@pytest.mark.parametrize("a,b", SAME)
def test_look_the_same(a, b):
    assert skeleton.skeleton(a) == skeleton.skeleton(b)


@pytest.mark.parametrize("a,b", APART)
def test_look_different(a, b):
    assert skeleton.skeleton(a) != skeleton.skeleton(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_skeleton_is_stable(text):
    once = skeleton.skeleton(text)
    assert skeleton.skeleton(once) == once
    assert skeleton.skeleton(skeleton.consistent(text)) == once


DOCS = "doc_id bigint, text string, look string, exact string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


def test_lookalike_pairs(spark):
    long = "word " * 200_000
    rows = [(1, "scope a"), (2, "ѕсоре a"), (3, "scope a"), (4, "scope a"), (4, "scope a"), (5, None), (6, ""), (7, " "), (8, "​"), (9, "Scope a"), (None, "scope​ a"), (10, long), (11, long + "‍")]
    docs = documents(spark, rows)
    assert {tuple(r) for r in skeleton.lookalike_pairs(docs).collect()} == {(1, 2), (1, 3), (2, 3), (10, 11)}
    assert {tuple(r) for r in skeleton.look_classes(docs).collect()} == {(1, 1, 5, 3), (2, 1, 5, 3), (3, 1, 5, 3), (4, 1, 5, 3), (9, 9, 1, 1), (10, 10, 2, 2), (11, 10, 2, 2)}
    assert skeleton.lookalike_pairs(docs.limit(0)).count() == 0
    dashes = documents(spark, [(1, "it’s 5–6"), (2, "it's 5-6"), (3, "it\u055as 5-6")])
    assert skeleton.lookalike_pairs(dashes).count() == 0
    assert {tuple(r) for r in skeleton.lookalike_pairs(dashes, marks=True).collect()} == {(1, 2)}
    assert skeleton.lookalike_pairs(dashes, marks=True, shapes={"\u055a": "'"}).count() == 3


def test_every_shape_meets_its_prototype():
    for char, shape in (skeleton.SAME_SHAPE | skeleton.SAME_MARKS).items():
        assert skeleton.skeleton(f"x{char}y", skeleton.LETTERS_AND_MARKS) == skeleton.skeleton(f"x{shape}y", skeleton.LETTERS_AND_MARKS), char


def test_pairs_of_one_look_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(skeleton, "LONG", 7)
    docs = documents(spark, [(k, "so" + "\u200b" * k) for k in range(40)] + [(99, "so")])
    got = [tuple(r) for r in skeleton.lookalike_pairs(docs).collect()]
    assert sorted(got) == list(itertools.combinations(range(40), 2))


def test_consistent_texts_of_nothing(spark):
    docs = documents(spark, [(5, None)])
    assert {r.doc_id: r.text for r in skeleton.consistent_texts(docs).collect()}[5] is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=60), st.integers(1, 9))
def test_suffix_array(text, depth):
    text = np.array(text, np.int32)
    order = leakage.suffix_array(text, depth)
    assert sorted(order.tolist()) == [k for k, x in enumerate(text) if x >= 0]
    starts = [tuple(text[k : k + depth].tolist()) for k in order]
    assert starts == sorted(starts)


def plain_leaks(docs, items, least):
    out = {}
    for d, t in docs:
        for i, u in items:
            if d is None or t is None or u is None:
                continue
            a, b = list(leakage.words(t)), list(leakage.words(u))
            best = max(((k, -x, -y) for x in range(len(a)) for y in range(len(b)) if (k := next((n for n in range(min(len(a) - x, len(b) - y)) if a[x + n] != b[y + n]), min(len(a) - x, len(b) - y))) >= least), default=None)
            if best:
                out[d, i] = max(out.get((d, i), (0, 0, 0)), best)
    return {k: (n, -x, -y) for k, (n, x, y) in out.items()}


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_leaks(spark, monkeypatch, shard):
    monkeypatch.setattr(leakage, "SHARD_WORDS", shard)
    monkeypatch.setattr(leakage, "STEP", 64)
    rng = random.Random(shard)
    word = lambda: rng.choice("a b c d".split())
    items = [(k, " ".join(word() for _ in range(rng.randrange(2, 14)))) for k in range(12)] + [(90, None), (91, ""), (92, "Tiny Ｆｕｌｌ wіdth text, here!")]
    docs = [(k, " ".join(rng.choice([word(), word(), word(), "zzz"]) for _ in range(rng.randrange(0, 90)))) for k in range(25)]
    docs += [(100, None), (101, " "), (102, "so tiny - full WIDTH text; here"), (103, docs[3][1]), (3, docs[3][1])]
    got = leakage.leaks(documents(spark, docs).repartition(2), spark.createDataFrame(items, "item_id bigint, item_text string"), 5)
    assert {(r.doc_id, r.item_id): (r.words, r.doc_word, r.item_word) for r in got.collect()} == plain_leaks(docs, items, 5)
    short = {i for i, t in items if len(list(leakage.words(t or ""))) < 5}
    assert {r.item_id for r in leakage.short_items(spark.createDataFrame(items, "item_id bigint, item_text string"), 5).collect()} == short
    clean = leakage.without_leaks(documents(spark, docs), got)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in plain_leaks(docs, items, 5)}


def test_one_long_item_does_not_widen_the_others(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    items = [(k, f"short item {k} of a few words and no more than ten") for k in range(3000)] + [(9999, long)]
    test = leakage.TestSet(items, 10)
    assert test.codes.nbytes + test.suffixes.nbytes + test.owner.nbytes + test.start.nbytes < 3_000_000 and test.width == 20_000
    docs = documents(spark, [(1, " ".join(long.split()[4000:15_000])), (2, items[7][1]), (3, "nothing")])
    got = leakage.leaks(docs, spark.createDataFrame(items, "item_id bigint, item_text string"))
    assert {(r.doc_id, r.item_id, r.words, r.item_word) for r in got.collect()} == {(1, 9999, 11_000, 4000), (2, 7, 12, 0)}


def test_no_leaks(spark):
    nothing = spark.createDataFrame([], "item_id bigint, item_text string")
    some = spark.createDataFrame([(1, "too short")], "item_id bigint, item_text string")
    docs = documents(spark, [(1, "too short to hold anything at all")])
    assert leakage.leaks(docs, nothing).count() == leakage.leaks(docs, some).count() == leakage.leaks(docs.limit(0), some).count() == 0


def test_budgets():
    leaves = {("a", "x"): (0.3, 10.0), ("a", "y"): (0.2, 100.0), ("b", "x"): (0.5, 1000.0)}
    assert budgets(leaves, 100) == {("a", "x"): 10.0, ("a", "y"): 40.0, ("b", "x"): 50.0}  # the sibling takes it, not b
    small = {("a", "x"): (0.3, 10.0), ("a", "y"): (0.2, 20.0), ("b", "x"): (0.5, 1000.0)}
    assert budgets(small, 100) == {("a", "x"): 10.0, ("a", "y"): 20.0, ("b", "x"): 70.0}  # the family is full
    assert sum(budgets(leaves, 10**6).values()) == 1110 and budgets({}, 5) == {}


def sized(spark, seed=0, n=3000):
    rng = random.Random(seed)
    rows = [(k, rng.choice("uv"), rng.choice(["en", "fr"]), rng.choices(["big", "mid", "rare"], [70, 25, 5])[0], rng.randrange(1, 40)) for k in range(n)]
    return spark.createDataFrame([(d, src, lang, src, t) for d, _, lang, src, t in rows], "doc_id bigint, domain string, language string, source string, tokens bigint")


TARGETS = [("Big ", 0.5, 1), ("mid", 0.3, 2), ("rare", 0.2, 4), ("absent", 0.1, 2), ("zero", 0.0, 2), (None, 0.5, 1)]


def test_mixture_reaches_its_shares(spark, monkeypatch):
    from stallwright.llm import mixture

    monkeypatch.setattr(mixture, "SLICE", 50)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = Mixture(sized(spark), targets)
    chosen = mix.selection().collect()
    most = {"big": 1, "mid": 2, "rare": 4}
    assert all(1 <= r.copies <= most[r.source] for r in chosen) and len({r.doc_id for r in chosen}) == len(chosen)
    shares = {r.source: r for r in mix.shares().collect()}
    for s, w in (("big", 0.5), ("mid", 0.3), ("rare", 0.2)):
        assert abs(shares[s].share - w) < 0.005
    assert shares["absent"].tokens == 0
    by_leaf = Counter()
    for r in chosen:
        by_leaf[r.domain, r.language, r.source] += r.tokens * r.copies
    assert all(abs(by_leaf[leaf] - amount) <= 40 for leaf, amount in mix.budget.items())
    same = Mixture(sized(spark), targets).selection().collect()
    other = Mixture(sized(spark), targets, seed=2).selection().collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, chosen)) != sorted(map(tuple, other))


def test_mixture_with_shortage(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = Mixture(sized(spark), targets, total=10**7)  # more than there is: everything as often as it may be used
    most = {"big": 1, "mid": 2, "rare": 4}
    assert all(r.copies == most[r.source] for r in mix.selection().collect())
    assert Mixture(sized(spark).limit(0), targets).selection().count() == 0
    assert Mixture(sized(spark), targets.limit(0)).shares().count() == 0


def test_weights_of_each_level_and_siblings_before_ancestors(spark):
    rows = [(k, "big", "en", 100) for k in range(10)] + [(k, "big", "fr", 100) for k in range(10, 12)] + [(k, "rare", "en", 100) for k in range(20, 30)]
    sized = spark.createDataFrame([(d, s, lang, s, t) for d, s, lang, t in rows], "doc_id bigint, domain string, language string, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("rare", 0.5, 1)], "source string, target_share double, max_repeats int")
    even = {"language": spark.createDataFrame([("en", 1.0), ("fr", 1.0)], "language string, weight double")}
    mix = Mixture(sized, targets, weights=even, total=1000.0)
    assert mix.weight == {("big", "en", "big"): 0.25, ("big", "fr", "big"): 0.25, ("rare", "en", "rare"): 0.5}
    assert mix.budget == {("big", "en", "big"): 300.0, ("big", "fr", "big"): 200.0, ("rare", "en", "rare"): 500.0}  # the sibling takes what French lacks
    assert {r.source: (r.tokens, r.share) for r in mix.shares().collect()} == {"big": (500, 0.5), "rare": (500, 0.5)}
    assert {tuple(r) for r in mix.budget_table().collect()} >= {("big", "fr", "big", 0.25, 250.0, 200.0, 200.0)}
    more = Mixture(sized, targets, weights=even, total=2100.0)  # rare is full as a whole, so the other domain takes its part
    assert {r.source: r.tokens for r in more.shares().collect()} == {"big": 1100, "rare": 1000}
    own = {"language": spark.createDataFrame([("big", "en", 3.0), ("big", "fr", 1.0)], "domain string, language string, weight double"), "domain": spark.createDataFrame([("big", 0.8), ("rare", 0.2)], "domain string, weight double")}
    assert Mixture(sized, targets, weights=own, total=100.0).budget == {("big", "en", "big"): pytest.approx(60.0), ("big", "fr", "big"): pytest.approx(20.0), ("rare", "en", "rare"): pytest.approx(20.0)}


def test_sizes_in_tokens(spark):
    rows = [(1, "Hello world", "EN ", "Product Copy"), (1, "Hello world", "en", "product_copy"), (2, None, None, "newsletter"), (3, "x", None, "newsletter"), (4, "y", "fr", None), (None, "y", "fr", "newsletter"), (5, "a" * 300_000, "en", "odd")]
    got = {r.doc_id: (r.domain, r.language, r.source, r.tokens) for r in sized_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[1] == ("product_copy", "en", "product_copy", 2) and got[3][:3] == ("newsletter", "und", "newsletter")
    assert set(got) == {1, 3, 5} and got[5][0] == "odd" and got[5][3] > 1000
