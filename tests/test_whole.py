"""Results that must be whole, on tables larger or more one-sided than the test tables."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stallwright.functions.text import gram_dice, jaro_winkler_similarity
from stallwright.operators import recommend as R
from stallwright.operators import search as S


def _catalog(spark, n):
    return spark.range(n).select(
        F.format_string("p%05d", "id").alias("product_id"), F.format_string("%s%05d item", F.chr(97 + F.col("id") % 26), "id").alias("name"), F.lit("brand").alias("brand_name"), F.lit("top/leaf").alias("category_path"), (F.col("id") / 100.0).alias("popularity")
    )


def test_suggestions_keep_light_terms(spark):
    logs = spark.createDataFrame([("query", 1), ("lost", 0)], "query string, result_count int")
    found = S.suggestions(_catalog(spark, 5000), logs)
    assert found.count() == 5003  # with the brand, the category and the query that found something
    assert found.filter("term = 'a00000 item' AND weight = 0").count() == 1


def test_autocomplete_finds_light_terms(spark, tmp_path):
    items = _catalog(spark, 5000).withColumn("indexed_at", F.timestamp_seconds(F.lit(0)))
    items.write.parquet(f"{tmp_path}/product_search_index.parquet")
    rows = [(q, q, 1) for q in ("a000", "z02", "absent")]
    blank = [F.lit(None).cast("string").alias(c) for c in ("took_ms", "session_hash", "corrected_query", "was_corrected", "ranking_version", "experiment_variant", "filter_signature", "created_at")]
    spark.createDataFrame(rows, "id string, normalized_query string, result_count int").select("*", *blank).write.parquet(f"{tmp_path}/search_query_logs.parquet")
    got = entry.queries()["autocomplete"](spark, str(tmp_path)).collect()
    lists = {p: [r["term"] for r in sorted(got, key=lambda r: r["rank"]) if r["prefix"] == p] for p in ("a00", "z02", "abs")}
    names = [(i, f"{chr(97 + i % 26)}{i:05d} item") for i in range(5000)]
    assert lists["a00"] == [n for i, n in reversed(names) if n.startswith("a00")][:8]
    assert lists["z02"] == [n for i, n in reversed(names) if n.startswith("z02")][:8]
    assert lists["abs"] == ["absent"]


def _rounded(x):
    """As Spark rounds: halves of the decimal text go up."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


@pytest.mark.parametrize("least", [0.6, 0.3])
def test_match_attributes_against_brute_force(spark, least):
    words = ["blue", "red", "navy-blue", "xl", "l", "cotton", "cotton-blend", "größe", "128gb", "a" * 300, "синий"]
    rng = random.Random(1)
    slips = ["lbue", "xed", "x", "bleu", "ottonc", "8gb12", "a" * 301, "инсий", "Red", "", None]
    wanted = slips + words + ["".join(rng.choice("abdelrux-1") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    values = words + ["".join(rng.choice("abdelrux-1") for _ in range(rng.randint(1, 9))) for _ in range(1100)]  # several blocks
    got = S.match_attributes(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(w,) for w in wanted], "wanted string"), least).collect()
    want = set()
    for w in {w.lower() for w in wanted if w}:
        scored = sorted((-_rounded(max(jaro_winkler_similarity(w, v), gram_dice(w, v))), v) for v in set(values))
        want |= {(w, v, -s) for s, v in scored[:5] if -s >= least}
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_match_attributes_without_common_letters_in_place(spark):
    values = spark.createDataFrame([("blue",), ("red",)], "value string")
    wanted = spark.createDataFrame([("lbue",), ("xed",)], "wanted string")
    assert {tuple(r) for r in S.match_attributes(values, wanted).collect()} == {("lbue", "blue", 0.916667), ("xed", "red", 0.777778)}


def test_upsell_sees_the_whole_category(spark):
    rng = random.Random(2)
    rows = [(f"p{i:04d}", "big" if i < 1000 else f"c{i % 7}", rng.choice([None, 0, 100, 110, 180, rng.randint(1, 5000)]), rng.choice([None, 0.0, 1.5, rng.random() * 100])) for i in range(1060)]
    rows += [("popular%03d" % i, "big", 9, 1000.0) for i in range(250)] + [("seed", "big", 100_000, 1.0), ("rare", "big", 150_000, 0.0)]
    got = R.upsell(spark.createDataFrame(rows, "product_id string, category_path string, price_paise long, popularity double")).collect()
    want = set()
    for p, c, price, _ in rows:
        if price:
            near = [(-(q[3] if q[3] is not None else -1), q[0]) for q in rows if q[1] == c and q[2] and 1.1 * price <= q[2] <= 1.8 * price and q[0] != p]
            want |= {(p, q, k) for k, (_, q) in enumerate(sorted(near)[:12], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ("seed", "rare", 1) in want  # cheap popular products hold the first 200 places of the category


def test_content_similarity_compares_the_whole_category(spark):
    rng = random.Random(3)
    tags, names = ["red", "blue", "wool", "silk", "xl", "xs"], ["warm", "coat", "thin", "scarf", "long"]
    rows = [(f"p{i:04d}", "big" if i < 600 else f"c{i % 5}", rng.choice(["a", "b", "c", None]), rng.choice([None, 0, rng.randint(1, 5000)]), float(i), " ".join(rng.sample(tags, rng.randint(0, 3))), " ".join(rng.sample(names, 2))) for i in range(630)]
    rows += [("twin1", "big", "rare", 70, 0.0, "jade", "lamp"), ("twin2", "big", "rare", 70, None, "jade", "lamp")]
    got = R.content_similarity(spark.createDataFrame(rows, "product_id string, category_path string, brand_name string, price_paise long, popularity double, attribute_text string, name string")).collect()

    def share(x, y):
        x, y = set(x.split()), set(y.split())
        return len(x & y) / len(x | y) if x | y else 0.0

    want = set()
    for a in rows:
        scored = []
        for b in rows:
            if a[1] == b[1] and a[0] != b[0]:
                price = min(a[3], b[3]) / max(a[3], b[3]) if a[3] and b[3] else 0.0
                signals = (1.0, float(a[2] is not None and a[2] == b[2]), share(a[5], b[5]), price, share(a[6], b[6]))
                scored.append((-_rounded((0.0 + signals[0] * 0.3 + signals[1] * 0.18 + signals[2] * 0.18 + signals[3] * 0.07 + signals[4] * 0.05) / sum(R.SIMILARITY_WEIGHTS.values())), b[0]))
        want |= {(a[0], b, -s, k) for k, (s, b) in enumerate(sorted(scored)[:24], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ("twin1", "twin2", 1.0, 1) in want  # the least popular of 602


@pytest.mark.parametrize("name", ["seller_share_cap", "diversity_cap"])
def test_caps_see_the_whole_category(spark, tmp_path, name):
    rows = [(f"a{i:03d}", "c", "s0", "b0", 1000.0 - i) for i in range(300)] + [(f"z{i:03d}", "c", f"s{1 + i // 3}", f"b{1 + i // 3}", 50.0 - i) for i in range(12)]
    items = spark.createDataFrame(rows, "product_id string, category_path string, seller_id string, brand_name string, popularity double").withColumn("indexed_at", F.timestamp_seconds(F.lit(0)))
    items.write.parquet(f"{tmp_path}/product_search_index.parquet")
    got = [r["product_id"] for r in sorted(entry.queries()[name](spark, str(tmp_path)).collect(), key=lambda r: r["final"])]
    assert got == ["a000", "a001", "z000", "z001", "z003", "z004", "z006", "z007"]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_basket_pairs_with_long_baskets(spark, monkeypatch, least):
    monkeypatch.setattr(R, "LONG_BASKET", 15)
    rng = random.Random(6)
    rows = {(f"b{rng.randrange(40)}", f"i{rng.randrange(30):02d}") for _ in range(300)} | {(f"long{n}", f"i{k:02d}") for n in range(4) for k in range(18 + 3 * n)}
    baskets = {}
    for b, i in rows:
        baskets.setdefault(b, set()).add(i)
    want = {}
    for own in baskets.values():
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = R.basket_pairs(spark.createDataFrame(sorted(rows), "basket string, item string"), least)
    assert {(r.a, r.b): r.pairs for r in got.collect()} == {k: n for k, n in want.items() if n >= least}
