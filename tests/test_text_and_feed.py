"""Text functions, feeds, list operators."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stallwright.functions import text as T
from stallwright.operators import recommend as R
from stallwright.operators import search as S
from stallwright.operators.index import SearchIndex
from stallwright.sources.feed import mark_duplicates, read_feed, validate

WORDS = st.text("abc", max_size=7)


def test_known_distances():
    assert [T.osa_distance(*p) for p in (("iphone", "ipohne"), ("ca", "abc"), ("", "ab"), ("same", "same"))] == [1, 3, 2, 0]
    assert round(T.jaro_winkler_similarity("martha", "marhta"), 4) == 0.9611
    assert T.gram_dice("aaaa", "aaa") == 2 / 3 and T.gram_dice("ab", "ab") == 1.0
    assert T.common_subsequence("chair", "cairo") == 4


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS)
def test_distance_laws(a, b):
    assert T.osa_distance(a, b) == T.osa_distance(b, a) >= abs(len(a) - len(b))
    assert (T.osa_distance(a, b) == 0) == (a == b)
    assert 0 <= T.jaro_winkler_similarity(a, b) <= 1
    assert abs(T.jaro_winkler_similarity(a, b) - T.jaro_winkler_similarity(b, a)) < 0.35


@settings(max_examples=60, deadline=None)
@given(WORDS)
def test_one_edit_always_shares_a_block(word):
    left_out = {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}
    for k in range(len(word)):
        for other in (word[:k] + "z" + word[k + 1 :], word[:k] + "z" + word[k:], word[:k] + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]):
            assert left_out & {other, *(other[:j] + other[j + 1 :] for j in range(len(other)))}


def test_tokens_and_hash(spark):
    row = spark.createDataFrame([("Crème-BRÛLÉE  x2, x2", None, "a")], "t string, n string, h string").select(T.tokens(F.col("t")).alias("t"), T.tokens(F.col("n")).alias("n"), T.canonical(F.col("t")).alias("c"), T.fnv1a(F.col("h")).alias("h")).first()
    assert row.t == ["creme", "brulee", "x2", "x2"] and row.n == [] and row.c == "brulee creme x2" and row.h == 0xE40C292C


def test_feed(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text('﻿Title,Item No,MRP,Qty,colour,E-mail\n"A ""big"" mug",ab-1,"1,299.50",3,red,a@b.co\n\n"two\nlines",AB-1,12.345,x,,nope\n,,,,,\n', encoding="utf-8")
    rows = validate(read_feed(spark, str(path)).withColumn("line", F.monotonically_increasing_id()))
    got = [(r.name, r.sku, r.price_minor, r.issues, r.duplicate) for r in mark_duplicates(rows, "line").orderBy("line").collect()]
    assert got[0] == ('A "big" mug', "AB-1", 129950, [], False)
    assert got[1] == ("two\nlines", "AB-1", None, ["price_invalid", "stock_invalid", "email_invalid"], True)
    assert got[2][3] == ["name_missing", "sku_missing", "price_missing"] and not got[2][4]
    assert "colour" in rows.columns


def test_greedy_diversity(spark):
    rows = [("r", k, s, b) for k, (s, b) in enumerate([("x", "1"), ("x", "1"), ("x", "2"), ("y", "1"), (None, "2"), ("y", "3")])]
    df = spark.createDataFrame(rows, "req string, rank int, seller string, brand string")
    got = R.diversify(df, "req", "rank", {"seller": 2, "brand": 2}, 5).orderBy("final").collect()
    assert [r["rank"] for r in got] == [0, 1, 4, 5, 2]


def test_ranking_quality_by_hand(spark):
    shown = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "request string, item string, rank int")
    truth = spark.createDataFrame([("q", "a", 1), ("q", "c", 3), ("q", "d", 1), ("w", "a", 1)], "request string, item string, grade int")
    got = {r.request: r for r in R.ranking_quality(shown, truth, 3).collect()}
    assert set(got) == {"q", "w"} and got["w"].ndcg == 0
    assert (got["q"].precision, got["q"].recall) == (round(2 / 3, 6), round(2 / 3, 6))
    assert got["q"].average_precision == round((1 + 2 / 3) / 3, 6)


def test_search_needs_every_word(spark):
    fields = list(S.FIELD_WEIGHTS)
    rows = [("p1", "red clay mug", 1.0), ("p2", "red tee", 2.0), ("p3", None, None)]
    df = spark.createDataFrame([(p, n, *[None] * (len(fields) - 1), pop, None) for p, n, pop in rows], "product_id string, " + ", ".join(f"{f} string" for f in fields) + ", popularity double, rating_average double")
    queries = spark.createDataFrame([("red mug",), ("re",), ("red clya",), ("red zebra",), ("",), ("!!",)], "query string")
    got = {(r.query, r.product_id, r.fuzzy) for r in SearchIndex(spark).upsert(df).search(queries).collect()}
    assert got == {("red mug", "p1", False), ("re", "p1", False), ("re", "p2", False), ("red clya", "p1", True)}


def queries(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "query string")


def test_price_limits(spark):
    cases = {
        "mug under 500": (None, 50_000), "tee over 1.5k": (150_000, None), "between rs 200 and 1,000 mug": (20_000, 100_000), "900 to 100": (10_000, 90_000),
        "less than 2 lakh": (None, 20_000_000), "mug 12": (None, None), "more than ₹99.50": (9_950, None), "": (None, None), None: (None, None),
    }
    from stallwright.operators.understand import price_limits

    least, most = price_limits(F.col("query"))
    got = {r.query: (r.least, r.most) for r in queries(spark, *cases).select("query", least.alias("least"), most.alias("most")).collect()}
    assert got == cases


def test_search_words(spark):
    from stallwright.operators.understand import search_words

    cases = {"The best Mugs under 500 for shoes": ["mugs", "shoe"], "the best": ["the", "best"], "coooool mug": ["cool", "mug"], "between 5 and 9 cups": ["cups"], "!!": []}
    assert {r.query: r.w for r in queries(spark, *cases).select("query", search_words(F.col("query")).alias("w")).collect()} == cases


def plain_entities(words, entries):
    taken, out = set(), set()
    for size in range(min(4, len(words)), 0, -1):
        for start in range(len(words) - size + 1):
            span = set(range(start, start + size))
            found = [e for e in entries if e[0] == " ".join(words[start : start + size])]
            if span & taken or not found:
                continue
            out |= {(e[0], start + 1, e[1], e[2]) for e in found}
            import math

            sure = [min(1, (0.6 / e[4] + 0.4 * min(1, math.log10(e[3] + 1) / 3)) * (1 if len(words) <= 2 else 0.85)) for e in found]
            if any(e[4] == 1 and round(c, 3) >= 0.6 for e, c in zip(found, sure)):
                taken |= span
    return out


def test_entities_longest_first(spark):
    from stallwright.operators.understand import extract_entities

    entries = [("red clay", "BRAND", "Red Clay", 900, 1), ("red", "ATTRIBUTE", "red", 900, 1), ("clay mug", "CATEGORY", "clay-mug", 900, 1), ("apple", "BRAND", "Apple", 900, 2), ("apple", "ATTRIBUTE", "apple", 900, 2), ("mug", "CATEGORY", "mug", 0, 1)]
    texts = ["red clay mug", "apple red", "clay mug red red", "big mug here", "red apple clay mug", "nothing"]
    lexicon = spark.createDataFrame(entries, "term string, kind string, value string, products bigint, ambiguity bigint")
    got = extract_entities(queries(spark, *texts), lexicon).collect()
    for t in texts:
        assert {(r.phrase, r.start, r.kind, r.value) for r in got if r.query == t} == plain_entities(t.split(), entries), t
