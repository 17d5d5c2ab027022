"""Recommendations for many requests at once: candidates, scores, exclusions, diversity, exploration.

Every generator gives ``(request, product_id, source, strength, similarity, affinity)``, the
strongest ``pool`` of each request, ties by product_id. A request is a product, a subject or a
basket; the types of slots say which generator serves them and how its candidates are weighed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions import scoring as C
from stallwright.operators.scans import ordered_fold

DAY_US = 86_400_000_000
POOL = 120
# The weights of a score, and where slots differ from them.
WEIGHTS = {"relevance": 100.0, "interest": 45.0, "similarity": 40.0, "popularity": 18.0, "quality": 14.0, "freshness": 8.0, "affinity": 30.0, "context": 35.0, "duplicate": 25.0, "out_of_stock": 60.0, "stale": 12.0}
TYPE_WEIGHTS = {
    "SIMILAR_PRODUCTS": {"similarity": 70.0, "popularity": 14.0},
    "RELATED_PRODUCTS": {"similarity": 55.0, "context": 25.0},
    "FREQUENTLY_BOUGHT_TOGETHER": {"affinity": 70.0, "similarity": 8.0},
    "CUSTOMER_ALSO_BOUGHT": {"affinity": 65.0, "similarity": 10.0},
    "CUSTOMER_ALSO_VIEWED": {"relevance": 70.0, "affinity": 20.0},
    "TRENDING_PRODUCTS": {"popularity": 45.0, "freshness": 30.0, "interest": 12.0},
    "POPULAR_IN_CATEGORY": {"popularity": 50.0, "context": 40.0, "interest": 15.0},
    "RECENTLY_VIEWED": {"relevance": 60.0, "freshness": 25.0, "interest": 10.0},
    "CONTINUE_SHOPPING": {"interest": 60.0, "freshness": 20.0, "relevance": 50.0},
    "PERSONALIZED_FOR_YOU": {"interest": 70.0, "popularity": 15.0},
    "CART_RECOMMENDATIONS": {"affinity": 65.0, "context": 45.0, "similarity": 10.0},
    "CHECKOUT_RECOMMENDATIONS": {"affinity": 60.0, "popularity": 12.0, "context": 40.0, "freshness": 4.0},
    "POST_PURCHASE_RECOMMENDATIONS": {"affinity": 60.0, "similarity": 20.0, "context": 30.0},
    "CROSS_SELL": {"affinity": 70.0, "context": 40.0, "similarity": 5.0},
    "UPSELL": {"similarity": 55.0, "quality": 30.0, "popularity": 10.0},
    "NEW_USER_RECOMMENDATIONS": {"popularity": 45.0, "freshness": 25.0, "quality": 20.0, "interest": 0.0},
    "ANONYMOUS_RECOMMENDATIONS": {"context": 55.0, "popularity": 25.0, "interest": 20.0},
}
# The names slots go by, and how many of one brand, category and seller they show.
TYPE_NAMES = {
    "similar": "SIMILAR_PRODUCTS", "related": "RELATED_PRODUCTS", "frequently-bought": "FREQUENTLY_BOUGHT_TOGETHER", "frequently-bought-together": "FREQUENTLY_BOUGHT_TOGETHER", "also-bought": "CUSTOMER_ALSO_BOUGHT", "also-viewed": "CUSTOMER_ALSO_VIEWED",
    "trending": "TRENDING_PRODUCTS", "popular-in-category": "POPULAR_IN_CATEGORY", "recently-viewed": "RECENTLY_VIEWED", "continue-shopping": "CONTINUE_SHOPPING", "for-you": "PERSONALIZED_FOR_YOU", "cart": "CART_RECOMMENDATIONS", "checkout": "CHECKOUT_RECOMMENDATIONS",
    "post-purchase": "POST_PURCHASE_RECOMMENDATIONS", "cross-sell": "CROSS_SELL", "upsell": "UPSELL", "new-user": "NEW_USER_RECOMMENDATIONS", "anonymous": "ANONYMOUS_RECOMMENDATIONS",
}
BUDGETS = {
    "SIMILAR_PRODUCTS": (4, 8, 4), "RELATED_PRODUCTS": (3, 6, 3), "FREQUENTLY_BOUGHT_TOGETHER": (6, 6, 6), "CUSTOMER_ALSO_BOUGHT": (3, 5, 3), "CUSTOMER_ALSO_VIEWED": (3, 6, 3), "TRENDING_PRODUCTS": (2, 3, 2), "POPULAR_IN_CATEGORY": (2, 10, 2), "RECENTLY_VIEWED": (6, 6, 6), "CONTINUE_SHOPPING": (2, 3, 2),
    "PERSONALIZED_FOR_YOU": (2, 3, 2), "CART_RECOMMENDATIONS": (3, 4, 3), "CHECKOUT_RECOMMENDATIONS": (2, 3, 2), "POST_PURCHASE_RECOMMENDATIONS": (3, 4, 3), "CROSS_SELL": (3, 4, 3), "UPSELL": (4, 8, 4), "NEW_USER_RECOMMENDATIONS": (2, 2, 2), "ANONYMOUS_RECOMMENDATIONS": (2, 3, 2),
}
DEFAULT_BUDGET = (3, 4, 3)
# Reasons and policies of exclusion; what a slot doesn't name is as in DEFAULT_POLICY.
DEFAULT_POLICY = {"in_stock": True, "cart": True, "purchased": False, "shown": True, "self": True, "duplicates": True}
TYPE_POLICIES = {"POST_PURCHASE_RECOMMENDATIONS": {"purchased": True}, "RECENTLY_VIEWED": {"shown": False}, "CONTINUE_SHOPPING": {"shown": False, "purchased": True}, "NEW_USER_RECOMMENDATIONS": {"shown": False}}
LIFT_FLOOR, UPSELL_RANGE, UPSELL_SIMILARITY, UPSELL_RATING, INTEREST_KEYS, COLD_PER_CATEGORY = 1.05, (1.1, 1.8), 0.45, 3.5, 6, 3


def slot_type(name: str | None) -> str | None:
    """The type a slot's name or alias stands for, None for an unknown one."""
    plain = (name or "").strip()
    return plain.upper() if plain.upper() in TYPE_WEIGHTS else TYPE_NAMES.get(plain.lower())


def weights_for(kind: str) -> dict[str, float]:
    return WEIGHTS | TYPE_WEIGHTS.get(kind, {})


def policy_for(kind: str) -> dict[str, bool]:
    return DEFAULT_POLICY | TYPE_POLICIES.get(kind, {})


def balance_problems(weights: dict[str, float]) -> list[str]:
    """What is wrong with a set of weights: none may be negative, and what is known without the shopper must weigh less than what is known of them."""
    soft = weights["popularity"] + weights["quality"] + weights["freshness"]
    hard = weights["relevance"] + weights["interest"] + weights["similarity"] + weights["context"]
    return [f"{k} is below zero or no number" for k, v in weights.items() if not v >= 0] + ([] if soft < hard else ["popularity, quality and freshness outweigh the shopper"])


def _pool(rows: DataFrame, source: str, strength: Column, pool: int, similarity: Column | None = None, affinity: Column | None = None, order: Column | None = None) -> DataFrame:
    zero = F.lit(0.0)
    picked = rows.select("request", "product_id", F.lit(source).alias("source"), F.round(strength, 6).alias("strength"), F.round(zero if similarity is None else similarity, 6).alias("similarity"), F.round(zero if affinity is None else affinity, 6).alias("affinity"), (F.round(strength, 6) if order is None else order).alias("_order"))
    rank = F.row_number().over(W.partitionBy("request").orderBy(F.desc("_order"), "product_id"))
    return picked.withColumn("_rank", rank).filter(F.col("_rank") <= pool).drop("_order", "_rank")


def similar(seeds: DataFrame, similarity: DataFrame, catalog: DataFrame, pool: int = POOL) -> DataFrame:
    """By content; a ``request`` (a product) that the similarity table doesn't hold gets the popular products of its category, weakly."""
    known = _pool(seeds.join(similarity.select(F.col("product_id").alias("request"), F.col("similar_id").alias("product_id"), "score"), "request"), "SIMILARITY", F.col("score"), pool, F.col("score"))
    lone = seeds.join(similarity.select(F.col("product_id").alias("request")).distinct(), "request", "left_anti").join(catalog.select(F.col("product_id").alias("request"), "category_path"), "request")
    liked = F.coalesce("popularity", F.lit(-1.0))
    place = F.row_number().over(W.partitionBy("category_path").orderBy(F.desc("popularity"), "product_id"))
    first = catalog.filter("is_searchable AND category_path IS NOT NULL").select("product_id", "category_path", liked.alias("popularity")).withColumn("place", place).filter(F.col("place") <= pool + 1).drop("place")
    others = lone.join(first, "category_path").filter("product_id <> request")
    return known.unionByName(_pool(others, "SIMILARITY", F.lit(0.4), pool, F.lit(0.4), order=F.col("popularity")))


def co_bought(seeds: DataFrame, relations: DataFrame, pool: int = POOL, source: str = "CO_PURCHASE") -> DataFrame:
    """By ``relations(item, companion, lift, confidence)`` that are more frequent than chance."""
    rows = seeds.join(relations.filter(F.col("lift") > LIFT_FLOOR).select(F.col("item").alias("request"), F.col("companion").alias("product_id"), "lift", "confidence"), "request")
    return _pool(rows, source, F.least(F.lit(1.0), F.log1p("lift") / F.log(F.lit(21.0))), pool, affinity=F.least(F.lit(1.0), F.col("confidence")), order=F.col("lift"))


def complements(seeds: DataFrame, relations: DataFrame, catalog: DataFrame, pool: int = POOL) -> DataFrame:
    """Companions of another category, an unknown one being another than any known."""
    path = lambda key, name: catalog.select(F.col("product_id").alias(key), F.col("category_path").alias(name))
    far = relations.join(path("item", "p1"), "item").join(path("companion", "p2"), "companion").filter(~F.col("p1").eqNullSafe(F.col("p2")))
    return co_bought(seeds, far, pool)


def dearer(seeds: DataFrame, similarity: DataFrame, catalog: DataFrame, pool: int = POOL) -> DataFrame:
    """Similar products of the same category at 1.1 to 1.8 times the price, similar enough and not badly rated."""
    side = lambda key, n: catalog.select(F.col("product_id").alias(key), *(F.col(c).alias(f"{c}{n}") for c in ("category_path", "price_paise", "rating_average", "is_searchable")))
    pairs = similarity.filter(F.col("score") >= UPSELL_SIMILARITY).select(F.col("product_id").alias("request"), F.col("similar_id").alias("product_id"), "score")
    both = seeds.join(pairs, "request").join(side("request", 1), "request").join(side("product_id", 2), "product_id")
    ratio = F.col("price_paise2") / F.col("price_paise1")
    fine = (F.col("category_path1") == F.col("category_path2")) & (F.col("price_paise1") > 0) & ratio.between(*UPSELL_RANGE) & F.col("is_searchable2") & F.coalesce(F.nanvl("rating_average2", F.lit(None).cast("double")) >= UPSELL_RATING, F.lit(True))
    return _pool(both.filter(fine), "SIMILARITY", F.col("score"), pool, F.col("score"))


def with_basket(baskets: DataFrame, relations: DataFrame, pool: int = POOL) -> DataFrame:
    """For ``baskets(request, item)``: what goes with their items, by the sum of the lifts; what is in the basket stays out."""
    found = baskets.distinct().join(relations.filter(F.col("lift") > LIFT_FLOOR).select("item", F.col("companion").alias("product_id"), "lift"), "item").groupBy("request", "product_id").agg(F.sum(F.col("lift").cast("decimal(18,6)")).cast("double").alias("lift"))
    new = found.join(baskets.select("request", F.col("item").alias("product_id")), ["request", "product_id"], "left_anti")
    return _pool(new, "CART_AFFINITY", F.least(F.lit(1.0), F.log1p("lift") / F.log(F.lit(31.0))), pool, affinity=F.least(F.lit(1.0), F.col("lift") / 10), order=F.col("lift"))


def trending(scopes: DataFrame, trends: DataFrame, popularity: DataFrame, pool: int = POOL) -> DataFrame:
    """For ``scopes(request, scope, scope_key)``: products of ``popularity`` (by scope) whose trend is up."""
    up = popularity.join(trends.filter("trend > 0").select("product_id", "trend"), "product_id")
    place = F.row_number().over(W.partitionBy("scope", "scope_key").orderBy(F.desc("trend"), "product_id"))
    up = up.withColumn("place", place).filter(F.col("place") <= pool)
    return _pool(scopes.join(up, ["scope", "scope_key"]), "TRENDING", F.least(F.lit(1.0), C.trend_blend(F.col("trend"), F.col("score")) / 5), pool, order=F.col("trend"))


def popular(scopes: DataFrame, popularity: DataFrame, pool: int = POOL) -> DataFrame:
    """The most popular products of a scope, against the first of it."""
    best = popularity.groupBy("scope", "scope_key").agg(F.max("score").alias("best"))
    rows = scopes.join(popularity.filter(F.col("rank") <= pool), ["scope", "scope_key"]).join(best, ["scope", "scope_key"])
    return _pool(rows, "POPULARITY", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0), pool)


def seen_lately(viewed: DataFrame, pool: int = POOL) -> DataFrame:
    """For ``viewed(request, product_id, rank)``, the latest first."""
    whole = F.count("*").over(W.partitionBy("request"))
    return _pool(viewed.withColumn("n", whole), "RECENTLY_VIEWED", 1 - (F.col("rank") - 1) / F.col("n"), pool, order=-F.col("rank"))


def by_interest(profiles: DataFrame, catalog: DataFrame, pool: int = POOL) -> DataFrame:
    """Products of the strongest categories and brands of ``profiles(subject, dimension, key, weight)``, by how early their key comes there."""
    top = profiles.filter("dimension IN ('CATEGORY', 'BRAND') AND weight > 0").withColumn("place", F.row_number().over(W.partitionBy("subject", "dimension").orderBy(F.desc("weight"), "key"))).filter(F.col("place") <= INTEREST_KEYS)
    top = top.withColumn("worth", 1 - (F.col("place") - 1) / F.count("*").over(W.partitionBy("subject", "dimension")))
    items = catalog.filter("is_searchable").select("product_id", F.explode(F.array(F.struct(F.lit("CATEGORY").alias("dimension"), F.col("category_path").alias("key")), F.struct(F.lit("BRAND").alias("dimension"), F.col("brand_name").alias("key")))).alias("k"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"))
    # of one key no more than the pool's most popular can enter, so the rest of a large category never meets the subjects
    best = items.select("product_id", "k.dimension", "k.key", "popularity").filter("key IS NOT NULL").withColumn("place", F.row_number().over(W.partitionBy("dimension", "key").orderBy(F.desc("popularity"), "product_id"))).filter(F.col("place") <= pool).drop("place")
    met = best.join(top.select(F.col("subject").alias("request"), "dimension", "key", "worth"), ["dimension", "key"]).groupBy("request", "product_id").agg(F.max("worth").alias("worth"), F.max("popularity").alias("popularity"))
    return _pool(met, "INTEREST", F.least(F.lit(1.0), F.col("worth")), pool, order=F.col("popularity"))


def cold_start(requests: DataFrame, catalog: DataFrame, now: DataFrame, pool: int = 24) -> DataFrame:
    """For shoppers of whom nothing is known: the same list for every ``request``, at most three of a category, by quality and newness of the popular ones."""
    rows = catalog.filter("is_searchable").orderBy(F.desc("popularity"), "product_id").limit(2 * pool).crossJoin(now)  # now is one row
    scored = rows.select("product_id", "category_path", C.cold_start(F.unix_micros("now") - F.unix_micros("indexed_at"), F.col("rating_average"), F.col("rating_count"), F.lit(0.0)).alias("strength"))
    own = F.row_number().over(W.partitionBy(F.coalesce("category_path", F.lit(""))).orderBy(F.desc("strength"), "product_id"))
    spread = scored.withColumn("own", own).filter(F.col("own") <= COLD_PER_CATEGORY)
    few = spread.orderBy(F.desc("strength"), "product_id").limit(pool)
    zero = F.lit(0.0)
    return requests.select("request").distinct().crossJoin(F.broadcast(few.select("product_id", F.when(F.col("strength") > 0.6, "NEW_ARRIVAL").otherwise("POPULARITY").alias("source"), "strength", zero.alias("similarity"), zero.alias("affinity"))))  # pool rows


def hydrated(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates with what the catalog knows of them; products that it doesn't have or that can't be found are dropped. In stock is what is on sale."""
    known = catalog.filter("is_searchable").select("product_id", "name", "slug", "brand_name", "category_path", "seller_id", "price_paise", "rating_average", "rating_count", "indexed_at", F.coalesce(F.col("status") == "ACTIVE", F.lit(False)).alias("in_stock"))
    return candidates.join(known, "product_id")


_PARTS = ["relevance", "interest", "similarity", "popularity", "quality", "freshness", "affinity", "context"]
_PENALTIES = ["duplicate", "out_of_stock", "stale"]


def score(rows: DataFrame, now: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``rows`` with the eight parts, the three penalties, the ``score`` and its ``dominant`` part, to six places.

    ``rows`` are hydrated candidates with ``kind`` and, where they are known (else null),
    ``interest``, ``popularity``, ``context`` (0 to 1), ``repeated`` (shown under another
    seed already) and ``overexposed``. ``kinds`` defaults to all; the weights of each are checked.
    """
    table = {k: weights_for(k) for k in (kinds or TYPE_WEIGHTS)}
    for kind, weights in table.items():
        if problems := balance_problems(weights):
            raise ValueError(f"{kind}: {'; '.join(problems)}")

    def weight(part: str) -> Column:
        return F.create_map(*(x for k, w in table.items() for x in (F.lit(k), F.lit(w[part]))))[F.col("kind")]

    values = {
        "relevance": C.unit(F.col("strength")), "interest": C.unit(F.col("interest")), "similarity": C.unit(F.col("similarity")), "popularity": C.unit(F.col("popularity")),
        "quality": C.quality(F.col("rating_average"), F.col("rating_count")), "freshness": C.freshness(F.unix_micros("now") - F.unix_micros("indexed_at")), "affinity": C.unit(F.col("affinity")), "context": C.unit(F.col("context")),
        "duplicate": F.coalesce(F.col("repeated"), F.lit(False)).cast("double"), "out_of_stock": (~F.col("in_stock")).cast("double"), "stale": F.coalesce(F.col("overexposed"), F.lit(False)).cast("double"),
    }
    parts = rows.crossJoin(now).select("*", *(F.round(x * weight(n), 6).alias(f"part_{n}") for n, x in values.items()))  # now is one row
    plus = sum((F.col(f"part_{n}") for n in _PARTS), F.lit(0.0))
    minus = sum((F.col(f"part_{n}") for n in _PENALTIES), F.lit(0.0))
    largest = F.greatest(*(F.col(f"part_{n}") for n in _PARTS))
    dominant = F.coalesce(*(F.when(F.col(f"part_{n}") == largest, n) for n in _PARTS))
    return parts.drop("now").withColumn("score", F.round(plus - minus, 6)).withColumn("dominant", dominant)


def exclude(scored: DataFrame, cart: DataFrame, purchased: DataFrame, shown: DataFrame, rejected: DataFrame, restricted: list[str] = (), most_price: int | None = None) -> DataFrame:
    """``scored`` with the first ``reason`` to leave each candidate out, null for those that stay.

    The sides are ``(request, product_id)``. In order: restricted categories, what the shopper
    rejected, the seed itself, products without name or slug, out of stock, in the cart,
    bought, shown, too dear; of the same product listed several times (category, brand and
    name without sizes) all but the best.
    """
    def flag(side: DataFrame, name: str) -> DataFrame:
        return side.select("request", "product_id", F.lit(True).alias(name)).distinct()

    rows = scored
    for side, name in ((cart, "_cart"), (purchased, "_bought"), (shown, "_shown"), (rejected, "_rejected")):
        rows = rows.join(flag(side, name), ["request", "product_id"], "left")
    rule = lambda name: F.create_map(*(x for k in TYPE_WEIGHTS for x in (F.lit(k), F.lit(policy_for(k)[name]))))[F.col("kind")]
    reason = F.when(F.col("category_path").isin(list(restricted)), "RESTRICTED_CATEGORY").when(F.col("_rejected"), "NOT_INTERESTED").when(rule("self") & (F.col("product_id") == F.col("request")), "SELF_REFERENCE").when(F.coalesce("name", F.lit("")).isin("") | F.coalesce("slug", F.lit("")).isin(""), "NOT_PURCHASABLE")
    reason = reason.when(rule("in_stock") & ~F.col("in_stock"), "OUT_OF_STOCK").when(rule("cart") & F.col("_cart"), "ALREADY_IN_CART").when(rule("purchased") & F.col("_bought"), "ALREADY_PURCHASED").when(rule("shown") & F.col("_shown"), "ALREADY_SHOWN")
    if most_price is not None:
        reason = reason.when(F.col("price_paise") > most_price, "PRICE_OUT_OF_RANGE")
    name = F.btrim(F.regexp_replace(F.regexp_replace(F.lower("name"), r"\b(xs|s|m|l|xl|xxl|small|medium|large)\b", ""), r"\s+", " "))
    marked = rows.withColumn("reason", reason).withColumn("_same", F.concat_ws("|", F.coalesce("category_path", F.lit("")), F.coalesce("brand_name", F.lit("")), name)).drop("_cart", "_bought", "_shown", "_rejected")
    place = F.row_number().over(W.partitionBy("kind", "request", "_same", F.col("reason").isNull()).orderBy(*best_first()))
    return marked.withColumn("_place", place).withColumn("reason", F.coalesce("reason", F.when(rule("duplicates") & (F.col("_place") > 1), "DUPLICATE_VARIANT"))).drop("_same", "_place")


def best_first() -> list[Column]:
    """By score, then rating, then the lower price, then product_id."""
    return [F.desc("score"), F.desc(F.coalesce(F.nanvl("rating_average", F.lit(0.0)), F.lit(0.0))), F.asc("price_paise"), F.asc("product_id")]


def ranked(kept: DataFrame) -> DataFrame:
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("kind", "request").orderBy(*best_first())))


def seller_ceiling(limit: int, share: float = 0.4) -> int:
    """How many of a list one seller may have: a share between a tenth and six tenths of it, at least one."""
    return max(1, int(limit * min(0.6, max(0.1, share))))


def diversified(ranked: DataFrame, limit: int) -> DataFrame:
    """``ranked`` with ``final`` places: in order of rank no more of one brand, category and seller than the budget of the slot, then the rest, up to ``limit``."""

    def step(used: dict, row: tuple) -> tuple[dict, tuple]:
        kind, *keys = row
        held = [(k, v) for k, v in enumerate(keys) if v is not None]
        taken = all(used.get(key, 0) < BUDGETS.get(kind, DEFAULT_BUDGET)[key[0]] for key in held)
        if taken:
            for key in held:
                used[key] = used.get(key, 0) + 1
        return used, (taken,)

    rows = ranked.select("kind", "request", "rank", "product_id", "score", "brand_name", "category_path", "seller_id", F.col("kind").alias("_kind"))
    folded = ordered_fold(rows, ["kind", "request"], ["rank", "product_id", "score"], ["_kind", "brand_name", "category_path", "seller_id"], dict, step, "taken boolean")
    final = F.row_number().over(W.partitionBy("kind", "request").orderBy(F.desc("taken"), "rank"))
    return folded.withColumn("final", final).filter(F.col("final") <= limit).select("kind", "request", "product_id", "score", "final")


def explore(lists: DataFrame, probability: float, seed: int = 1) -> DataFrame:
    """``lists(kind, request, product_id, rank, ...)`` with some of the back half moved within it; the same for the same seed.

    Each item of the back half is drawn with the given probability (at most a half); those
    drawn change places among themselves, the others and the front half stay.
    """
    p = min(0.5, max(0.0, probability))
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "kind", "request", "product_id"), F.lit(1_000_000)) / 1_000_000
    request = W.partitionBy("kind", "request")
    rows = lists.withColumn("_n", F.count("*").over(request)).withColumn("_drawn", (F.col("rank") > F.greatest(F.lit(1), F.floor(F.col("_n") / 2))) & (draw("drawn") < p))
    own = W.partitionBy("kind", "request", "_drawn")
    # the k-th of the drawn in a shuffled order takes the k-th of their places
    rows = rows.withColumn("_k", F.row_number().over(own.orderBy(draw("order"), "product_id"))).withColumn("_places", F.array_sort(F.collect_list("rank").over(own)))
    return rows.withColumn("rank", F.when(F.col("_drawn"), F.element_at("_places", F.col("_k"))).otherwise(F.col("rank"))).drop("_n", "_drawn", "_k", "_places")


# What a slot is called and why a product is in it.
HEADINGS = {"SIMILAR_PRODUCTS": "Similar products", "CUSTOMER_ALSO_BOUGHT": "Customers also bought", "CUSTOMER_ALSO_VIEWED": "Customers also viewed", "CROSS_SELL": "Goes well with", "UPSELL": "A step up", "PERSONALIZED_FOR_YOU": "For you", "TRENDING_PRODUCTS": "Trending now", "POPULAR_IN_CATEGORY": "Popular here"}
REASONS = {"relevance": "fits what you look at", "interest": "matches your interests", "similarity": "like this product", "popularity": "popular with others", "quality": "well rated", "freshness": "new", "affinity": "often bought together", "context": "same category or brand"}


def explain(rows: DataFrame) -> DataFrame:
    """``rows`` with the slot's ``heading``, the ``why`` of the dominant part and up to four ``signals`` that count."""
    named = lambda table, c, other: F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.col(c)], F.lit(other))
    signals = F.slice(F.array_compact(F.array(*(F.when(F.col(f"part_{n}") > 0, F.lit(n)) for n in _PARTS))), 1, 4)
    return rows.withColumn("heading", named(HEADINGS, "kind", "Recommended")).withColumn("why", named(REASONS, "dominant", "recommended")).withColumn("signals", signals)
