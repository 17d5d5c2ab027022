"""Offline recommendation tables and the list operators over them.

Co-occurrence, popularity and trend scores, content similarity, decayed interest profiles,
price preferences, replenishment, caps and fallbacks, ranking quality. "Now" is the latest
time in the data; every top-k has the id as its last tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions.text import jaccard, tokens
from stallwright.operators.scans import ordered_fold, placed
from stallwright.storage import default_buckets, materialize

DAY_US = 86_400_000_000
# Weights of the popularity counters, of interest events, of similarity signals.
POPULARITY_WEIGHTS = {"views": 1, "carts": 6, "wishes": 5, "purchases": 25}
EVENT_WEIGHTS = {"PURCHASE": 10.0, "RETURN": -4.0, "ADD_TO_CART": 4.0, "WISHLIST_ADD": 3.5, "WISHLIST_REMOVE": -1.5, "REMOVE_FROM_CART": -1.5, "SEARCH_RESULT_CLICK": 1.6, "PRODUCT_CLICK": 1.4, "PRODUCT_VIEW": 1.0, "COMPARE": 1.2, "SHARE": 1.1, "NOT_INTERESTED": -6.0}
SIMILARITY_WEIGHTS = {"category": 0.3, "brand": 0.18, "attributes": 0.18, "price": 0.07, "text": 0.05}
HALF_LIFE_DAYS, DECAY_FLOOR = 14, 0.01
# A basket of more items is long.
LONG_BASKET = 500
# Products of a category that are held in one row to be compared.
POOL = 256


def basket_pairs(members: DataFrame, least: int) -> DataFrame:
    """``(a, b, pairs)``, a < b, of distinct ``(basket, item)``.

    Items in fewer than ``least`` baskets can't be in a wanted pair and are dropped first. A
    pair wanted n times is in a basket outside any n - 1, so of the baskets of more than
    LONG_BASKET items the n - 1 largest emit no pairs: their members are marked, and what two
    items share of them is added to the pairs that the other baskets gave. The pairs of a
    basket are made in two steps, so no row holds more than one basket.
    """
    frequent = members.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("item")
    kept = materialize(members.select("basket", "item").join(frequent, "item", "left_semi"), "kept")
    long = [r["basket"] for r in kept.groupBy("basket").agg(F.count("*").alias("n")).filter(F.col("n") > LONG_BASKET).orderBy(F.desc("n"), "basket").limit(max(0, least - 1)).collect()]
    short = kept.filter(~F.col("basket").isin(long)) if long else kept
    baskets = short.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") > 1)
    first = baskets.select("items", F.explode(F.sequence(F.lit(1), F.size("items") - 1)).alias("i"))
    both = first.select(F.element_at("items", F.col("i")).alias("a"), F.explode(F.slice("items", F.col("i") + 1, F.size("items"))).alias("b"))
    counts = both.groupBy("a", "b").agg(F.count("*").alias("pairs"))
    if not long:
        return counts.filter(F.col("pairs") >= least)
    bits = sum((F.when(F.col("basket") == b, F.lit(1 << k)).otherwise(0) for k, b in enumerate(long)), F.lit(0))
    marks = kept.filter(F.col("basket").isin(long)).groupBy("item").agg(F.sum(bits).cast("bigint").alias("bits"))
    some = counts.filter(F.col("pairs") >= least - len(long))
    marked = some.join(marks.withColumnsRenamed({"item": "a", "bits": "x"}), "a", "left").join(marks.withColumnsRenamed({"item": "b", "bits": "y"}), "b", "left")
    shared = F.bit_count(F.coalesce("x", F.lit(0)).bitwiseAND(F.coalesce("y", F.lit(0))))
    return marked.select("a", "b", (F.col("pairs") + shared).alias("pairs")).filter(F.col("pairs") >= least)


def co_occurrence(members: DataFrame, least: int = 2, min_lift: float = 1.05, min_support: float = 0.0, top: int | None = 24) -> DataFrame:
    """``(item, companion, pairs, support, confidence, lift, rank)`` in both directions, the ``top`` companions of each item or all of them."""
    members = materialize(members.select("basket", "item"), "members")  # read three times
    singles = members.groupBy("item").agg(F.count("*").alias("n"))
    total = members.agg(F.count_distinct("basket").alias("total"))
    ways = F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("companion")), F.struct(F.col("b").alias("item"), F.col("a").alias("companion")))
    both = basket_pairs(members, least).select("pairs", F.explode(ways).alias("w")).select("w.item", "w.companion", "pairs")
    rows = both.join(singles.withColumnRenamed("n", "n_item"), "item").join(singles.select(F.col("item").alias("companion"), F.col("n").alias("n_companion")), "companion").crossJoin(total)  # total is one row
    confidence = F.col("pairs") / F.col("n_item")
    lift = F.col("pairs") * F.col("total") / (F.col("n_item") * F.col("n_companion"))
    kept = rows.filter((lift >= min_lift) & (F.col("pairs") / F.col("total") >= min_support))
    scored = kept.select("item", "companion", "pairs", F.round(F.col("pairs") / F.col("total"), 6).alias("support"), F.round(confidence, 6).alias("confidence"), F.round(lift, 6).alias("lift"))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("lift"), F.desc("confidence"), F.desc("pairs"), "companion"))
    ranked = scored.withColumn("rank", rank)
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def basket_affinity(members: DataFrame, relations: DataFrame, top: int = 12) -> DataFrame:
    """``(basket, companion, affinity, rank)``: companions of a basket's items by the sum of their lifts, without what is in it."""
    found = members.join(relations.select("item", "companion", "lift"), "item").groupBy("basket", "companion").agg(F.sum(F.col("lift").cast("decimal(18,6)")).cast("double").alias("affinity"))
    new = found.join(members.select("basket", F.col("item").alias("companion")), ["basket", "companion"], "left_anti")
    rank = F.row_number().over(W.partitionBy("basket").orderBy(F.desc("affinity"), "companion"))
    return new.withColumn("rank", rank).filter(F.col("rank") <= top)


def upsell(catalog: DataFrame, low: float = 1.1, high: float = 1.8, top: int = 12) -> DataFrame:
    """``(product_id, upsell_id, rank)``: of its category the most popular products at ``low`` to ``high`` times a product's price.

    A category's products stand in order of price, so a price range is a run of them. Runs of 1, 2, 4, ...
    products at multiples of their length keep their ``top`` by popularity each; any run is made of at most two
    of each length, which hold its own ``top``. Work grows as n log n of a category, however large it is.
    """
    rows = catalog.filter("category_path IS NOT NULL AND price_paise > 0").select("product_id", "category_path", "price_paise", "popularity")
    place = F.row_number().over(W.partitionBy("category_path").orderBy(F.desc("popularity"), "product_id"))
    # the products below each end of a range are counted in one sweep; equal prices are after a lower end (0) and before an upper one (2)
    price = F.col("price_paise").cast("double")
    ends = F.array(*(F.struct(F.lit(side).alias("side"), key.alias("key")) for side, key in ((0, low * price), (1, price), (2, high * price))))
    marks = rows.withColumn("place", place).select("category_path", "product_id", "place", F.explode(ends).alias("e")).select("category_path", "product_id", "place", "e.side", "e.key")
    below = F.count(F.when(F.col("side") == 1, 1)).over(W.partitionBy("category_path").orderBy("key", "side", "product_id").rowsBetween(W.unboundedPreceding, 0))
    marks = materialize(marks.withColumn("below", below), "marks")  # read twice

    members = marks.filter("side = 1").withColumn("all", F.count("*").over(W.partitionBy("category_path"))).withColumn("level", F.explode(F.expr("sequence(0, length(bin(all)) - 1)")))
    runs = members.select("category_path", "level", F.expr("shiftright(below - 1, level)").alias("run"), F.col("product_id").alias("upsell_id"), "place")
    within = F.row_number().over(W.partitionBy("category_path", "level", "run").orderBy("place"))
    runs = runs.withColumn("within", within).filter(F.col("within") <= top).drop("within")

    bound = lambda side: F.max(F.when(F.col("side") == side, F.col("below")))
    ranges = marks.filter("side <> 1").groupBy("category_path", "product_id").agg(bound(0).alias("a"), bound(2).alias("b")).filter("a < b")
    levels = ranges.withColumn("level", F.explode(F.expr("sequence(0, length(bin(b - a)) - 1)"))).withColumn("l", F.expr("shiftright(a + shiftleft(1L, level) - 1, level)")).withColumn("r", F.expr("shiftright(b, level)")).filter("l < r")
    parts = levels.select("category_path", "product_id", "level", F.explode(F.expr("filter(array(if(l % 2 = 1, l, null), if(r % 2 = 1, r - 1, null)), x -> x IS NOT NULL)")).alias("run"))
    found = parts.join(runs, ["category_path", "level", "run"]).filter("product_id <> upsell_id")
    rank = F.row_number().over(W.partitionBy("product_id").orderBy("place"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("product_id", "upsell_id", "rank")


def cross_sell(relations: DataFrame, groups: DataFrame) -> DataFrame:
    """Relations whose two items are of different groups; ``groups(item, grp)``, an unknown group differs from any known."""
    left = relations.join(groups, "item", "left").withColumnRenamed("grp", "g1")
    right = left.join(groups.select(F.col("item").alias("companion"), F.col("grp").alias("g2")), "companion", "left")
    return right.filter(~F.col("g1").eqNullSafe(F.col("g2"))).select("item", "companion", "lift")


def product_counters(events: DataFrame, days: int | None = None) -> DataFrame:
    """``(product_id, views, carts, wishes, purchases)``, of all events or those of the last ``days``."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    rows = events.filter("product_id IS NOT NULL")
    if days is not None:
        rows = rows.crossJoin(events.agg(F.max("time_us").alias("now"))).filter(F.col("time_us") >= F.col("now") - days * DAY_US)  # now is one row
    return rows.groupBy("product_id").agg(count("PRODUCT_VIEW", "PRODUCT_CLICK").alias("views"), count("ADD_TO_CART").alias("carts"), count("WISHLIST_ADD").alias("wishes"), count("PURCHASE").alias("purchases"))


def activity(prefix: str = "") -> Column:
    return sum((F.col(prefix + c) * w for c, w in POPULARITY_WEIGHTS.items()), F.lit(0))


def popularity(events: DataFrame, catalog: DataFrame, days: int = 30) -> DataFrame:
    """``(scope, scope_key, product_id, score, conversion, rank)``: a product's place overall, in its category and in its brand, by the events of the last ``days``."""
    scored = product_counters(events, days).withColumn("score", F.round(F.log1p(activity()), 4)).withColumn("conversion", F.when(F.col("views") > 0, F.round(F.least(F.lit(1.0), F.col("purchases") / F.col("views")), 6)).otherwise(F.lit(0.0)))
    known = scored.join(catalog.select("product_id", "brand_name", "category_path"), "product_id", "left")
    scopes = F.array(F.struct(F.lit("GLOBAL").alias("scope"), F.lit("all").alias("scope_key")), F.struct(F.lit("CATEGORY").alias("scope"), F.col("category_path").alias("scope_key")), F.struct(F.lit("BRAND").alias("scope"), F.col("brand_name").alias("scope_key")))
    each = known.select("product_id", "score", "conversion", F.explode(scopes).alias("s")).select("s.scope", "s.scope_key", "product_id", "score", "conversion").filter("scope_key IS NOT NULL")
    return placed(each, ["scope", "scope_key"], [F.desc("score"), F.asc("product_id")])


def trending(events: DataFrame, recent_days: int = 2, base_days: int = 30, least: int = 20) -> DataFrame:
    """``(product_id, recent, base, trend)`` of the products whose daily activity of late exceeds that of the whole window."""
    now = events.agg(F.max("time_us").alias("now"))
    weight = F.when(F.col("kind").isin("PRODUCT_VIEW", "PRODUCT_CLICK"), 1).when(F.col("kind") == "ADD_TO_CART", 6).when(F.col("kind") == "WISHLIST_ADD", 5).when(F.col("kind") == "PURCHASE", 25).otherwise(0)
    rows = events.filter("product_id IS NOT NULL AND time_us IS NOT NULL").crossJoin(now).withColumn("age", F.col("now") - F.col("time_us"))  # now is one row
    sums = rows.filter(F.col("age") < base_days * DAY_US).groupBy("product_id").agg(F.sum(F.when(F.col("age") < recent_days * DAY_US, weight).otherwise(0)).alias("recent"), F.sum(weight).alias("base"))
    ratio = (F.col("recent") / recent_days) / (F.col("base") / base_days + 5)
    return sums.filter(F.col("recent") >= least).withColumn("ratio", ratio).filter("ratio > 1").select("product_id", "recent", "base", F.round(F.log("ratio"), 4).alias("trend"))


def decayed(weight: Column, age_us: Column) -> Column:
    """A signed weight halved every HALF_LIFE_DAYS; the future counts as now, less than DECAY_FLOOR of it as nothing."""
    factor = F.when(age_us <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age_us / (HALF_LIFE_DAYS * DAY_US)))
    return weight * F.when(factor < DECAY_FLOOR, 0.0).otherwise(factor)


def interest_profiles(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(subject, dimension, key, weight)``: decayed interest in categories, brands and products, the largest of each dimension being 1."""
    weights = F.create_map(*(x for k, w in EVENT_WEIGHTS.items() for x in (F.lit(k), F.lit(w))))
    now = events.agg(F.max("time_us").alias("now"))
    rows = events.filter(F.col("kind").isin(list(EVENT_WEIGHTS)) & F.col("subject").isNotNull() & F.col("product_id").isNotNull() & F.col("time_us").isNotNull()).crossJoin(now)  # now is one row
    per_product = rows.groupBy("subject", "product_id").agg(F.sum(decayed(weights[F.col("kind")], F.col("now") - F.col("time_us"))).alias("w"))
    joined = per_product.join(catalog.select("product_id", "brand_name", "category_path"), "product_id", "left")
    dims = F.array(F.struct(F.lit("PRODUCT").alias("dimension"), F.col("product_id").alias("key")), F.struct(F.lit("BRAND").alias("dimension"), F.col("brand_name").alias("key")), F.struct(F.lit("CATEGORY").alias("dimension"), F.col("category_path").alias("key")))
    sums = joined.select("subject", "w", F.explode(dims).alias("d")).select("subject", "d.dimension", "d.key", "w").filter("key IS NOT NULL").groupBy("subject", "dimension", "key").agg(F.greatest(F.sum("w"), F.lit(0.0)).alias("w")).filter("w > 1e-9")
    return sums.select("subject", "dimension", "key", F.round(F.col("w") / F.max("w").over(W.partitionBy("subject", "dimension")), 4).alias("weight"))


def profile_confidence(events: DataFrame) -> DataFrame:
    """``(subject, signals, confidence)``."""
    counts = events.filter(F.col("kind").isin(list(EVENT_WEIGHTS)) & F.col("subject").isNotNull() & F.col("product_id").isNotNull()).groupBy("subject").agg(F.count("*").alias("signals"))
    return counts.withColumn("confidence", F.round(F.least(F.lit(0.98), F.col("signals") / (F.col("signals") + 25)), 6))


def price_preference(events: DataFrame, catalog: DataFrame, low: float = 0.2, high: float = 0.9) -> DataFrame:
    """``(subject, low_price, high_price)``: weighted nearest-rank percentiles of the prices a subject bought or put in the cart.

    Each price counts as often as its rounded event weight; running sums take the place of repeated rows.
    """
    weights = F.create_map(*(x for k, w in EVENT_WEIGHTS.items() if w >= 1 for x in (F.lit(k), F.lit(int(w + 0.5)))))
    rows = events.filter("subject IS NOT NULL AND product_id IS NOT NULL").withColumn("times", weights[F.col("kind")]).filter("times IS NOT NULL").join(catalog.filter("price_paise IS NOT NULL").select("product_id", "price_paise"), "product_id")
    prices = rows.groupBy("subject", "price_paise").agg(F.sum("times").alias("times"))
    run = F.sum("times").over(W.partitionBy("subject").orderBy("price_paise").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("times").over(W.partitionBy("subject"))
    placed = prices.withColumn("run", run).withColumn("whole", whole)
    at = lambda p: F.min(F.when(F.col("run") > F.floor((F.col("whole") - 1) * p), F.col("price_paise")))
    return placed.groupBy("subject").agg(at(low).alias("low_price"), at(high).alias("high_price"))


def replenishment(purchases: DataFrame, horizon: int = 30) -> DataFrame:
    """``(customer, item, gaps, median_days, due_in, confidence)`` of ``purchases(customer, item, day)`` bought again and again.

    Several purchases on one day are one. ``due_in`` counts days from the latest day in the data.
    """
    days = purchases.filter("customer IS NOT NULL AND item IS NOT NULL AND day IS NOT NULL").distinct()
    now = days.agg(F.max("day").alias("now"))
    gap = F.date_diff("day", F.lag("day").over(W.partitionBy("customer", "item").orderBy("day")))
    sums = days.withColumn("gap", gap).groupBy("customer", "item").agg(F.count("gap").alias("gaps"), F.expr("percentile(gap, 0.5)").alias("median_days"), F.max("day").alias("last")).filter("gaps > 0")
    due = F.col("median_days") - F.date_diff("now", "last")
    return sums.crossJoin(now).withColumn("due_in", due).filter(F.col("due_in") <= horizon).select("customer", "item", "gaps", "median_days", "due_in", F.round(F.least(F.lit(0.95), F.col("gaps") / (F.col("gaps") + 2)), 6).alias("confidence"))  # now is one row


def content_similarity(catalog: DataFrame, top: int = 24, least: float = 0.08) -> DataFrame:
    """``(product_id, similar_id, score, rank)``: the products of its category that are most like each one.

    Every two products of a category are compared. A category is cut in pools of bounded size; a product
    meets each pool in a row of its own, which keeps the ``top`` of that pool, so the pairs of a large
    category are spread over tasks and are never rows.
    """
    own = ["product_id", "brand", "price", "attributes", "words"]
    rows = catalog.filter("category_path IS NOT NULL").select("product_id", "category_path", F.col("brand_name").alias("brand"), F.col("price_paise").alias("price"), tokens(F.col("attribute_text")).alias("attributes"), tokens(F.col("name")).alias("words"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("category_path").orderBy("product_id"))).withColumn("all", F.count("*").over(W.partitionBy("category_path")))
    pools = rows.groupBy("category_path", F.expr(f"(place - 1) div {POOL}").alias("part")).agg(F.collect_list(F.struct(*own)).alias("pool"))
    met = rows.select("category_path", *own, F.explode(F.expr(f"sequence(0L, (all - 1) div {POOL})")).alias("part"))
    met = met.repartition(default_buckets(catalog.sparkSession), "category_path", "part").join(pools, ["category_path", "part"])  # by number, as these are few bytes but many pairs

    def score(b):
        signals = {
            "category": F.lit(1.0),
            "brand": F.coalesce((F.col("brand") == b.brand).cast("double"), F.lit(0.0)),
            "attributes": F.coalesce(jaccard(F.col("attributes"), b.attributes), F.lit(0.0)),
            "price": F.coalesce(F.when((F.col("price") > 0) & (b.price > 0), F.least(F.col("price"), b.price) / F.greatest(F.col("price"), b.price)), F.lit(0.0)),
            "text": F.coalesce(jaccard(F.col("words"), b.words), F.lit(0.0)),
        }
        return F.round(sum((signals[k] * w for k, w in SIMILARITY_WEIGHTS.items()), F.lit(0.0)) / sum(SIMILARITY_WEIGHTS.values()), 6)

    others = F.filter("pool", lambda x: x.product_id != F.col("product_id"))
    scored = F.filter(F.transform(others, lambda x: F.struct((-score(x)).alias("less"), x.product_id.alias("id"))), lambda x: x.less <= -least)
    best = met.select("product_id", F.explode(F.slice(F.array_sort(scored), 1, top)).alias("x")).select("product_id", F.col("x.id").alias("similar_id"), (-F.col("x.less")).alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("product_id").orderBy(F.desc("score"), "similar_id"))).filter(F.col("rank") <= top)


def cap_share(ranked: DataFrame, request: str, rank: str, key: str, limit: int, cap: int) -> DataFrame:
    """The first ``limit`` of each request with at most ``cap`` of one ``key``; what is over the cap fills up the end. Null keys are exempt."""
    place = F.row_number().over(W.partitionBy(request, key).orderBy(rank))
    over = F.coalesce((place > cap) & F.col(key).isNotNull(), F.lit(False))
    final = F.row_number().over(W.partitionBy(request).orderBy("over", rank))
    return ranked.withColumn("over", over).withColumn("final", final).filter(F.col("final") <= limit).drop("over")


def diversify(ranked: DataFrame, request: str, rank: str, axes: dict[str, int], limit: int) -> DataFrame:
    """Greedy caps on several axes at once, in order of rank; what is over a cap fills up the end. Null keys are exempt.

    Each choice depends on those before it, so a request is folded in order of rank, holding no more than how often each key was taken.
    """
    caps = list(axes.values())

    def step(used: dict, row: tuple) -> tuple[dict, tuple]:
        keys = [(k, v) for k, v in enumerate(row) if v is not None]
        taken = all(used.get(key, 0) < caps[key[0]] for key in keys)
        if taken:
            for key in keys:
                used[key] = used.get(key, 0) + 1
        return used, (taken,)

    rest = [c for c in ranked.columns if c not in (request, rank)]
    copies = {a: f"_{a}" for a in axes}  # the keys are handed to the fold and kept
    rows = ranked.select("*", *(F.col(a).alias(c) for a, c in copies.items()))
    folded = ordered_fold(rows, [request], [rank, *rest], list(copies.values()), dict, step, "taken boolean")
    final = F.row_number().over(W.partitionBy(request).orderBy(F.desc("taken"), rank))
    return folded.withColumn("final", final).filter(F.col("final") <= limit).select(*ranked.columns, "final")


def fallback_ladder(rungs: list[DataFrame], limit: int) -> DataFrame:
    """``(seed, product_id, rung, rank)``: lists of ``(seed, product_id, place)``, earlier rungs first, each product once."""
    marked = [r.select("seed", "product_id", "place", F.lit(k).alias("rung")) for k, r in enumerate(rungs)]
    rows = marked[0]
    for r in marked[1:]:
        rows = rows.unionByName(r)
    first = rows.filter("seed <> product_id").groupBy("seed", "product_id").agg(F.min(F.struct("rung", "place")).alias("m"))
    rank = F.row_number().over(W.partitionBy("seed").orderBy("m.rung", "m.place", "product_id"))
    return first.select("seed", "product_id", F.col("m.rung").alias("rung"), rank.alias("rank")).filter(F.col("rank") <= limit)


def ranking_quality(recommended: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``(request, precision, recall, average_precision, ndcg)`` of ``recommended(request, item, rank)`` against ``relevant(request, item, grade)``.

    Requests without relevant items are left out; those without recommendations score zero.
    """
    truth = relevant.filter("grade > 0").groupBy("request", "item").agg(F.max("grade").alias("grade"))
    ideal_rank = F.row_number().over(W.partitionBy("request").orderBy(F.desc("grade"), "item"))
    ideals = truth.withColumn("r", ideal_rank).groupBy("request").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") <= k, F.col("grade") / F.log2(F.col("r") + 1))).alias("ideal"))
    shown = recommended.filter(F.col("rank") <= k).join(truth, ["request", "item"], "left")
    hits = F.count("grade").over(W.partitionBy("request").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    sums = shown.withColumn("hits", hits).groupBy("request").agg(F.count("*").alias("shown"), F.count("grade").alias("found"), F.sum(F.when(F.col("grade").isNotNull(), F.col("hits") / F.col("rank"))).alias("ap"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    rows = ideals.join(sums, "request", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select("request", zero(F.col("found") / F.least(F.lit(k), F.col("shown"))).alias("precision"), zero(F.col("found") / F.col("n")).alias("recall"), zero(F.col("ap") / F.least(F.col("n"), F.lit(k))).alias("average_precision"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def list_quality(recommended: DataFrame, groups: DataFrame, catalog_size: DataFrame) -> DataFrame:
    """``(coverage, diversity)``: the share of the catalog that is shown, and the mean share of pairs of a list from different groups."""
    shown = recommended.agg(F.count_distinct("item").alias("shown")).crossJoin(catalog_size)  # one row each
    grouped = recommended.join(groups, "item", "left").groupBy("request", F.coalesce("grp", F.lit("")).alias("grp")).agg(F.count("*").alias("n"))
    lists = grouped.groupBy("request").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).filter(F.col("all") > 1)
    diversity = lists.agg(F.round(F.avg(1 - F.col("same") / (F.col("all") * (F.col("all") - 1))), 6).alias("diversity"))
    return shown.select(F.round(F.col("shown") / F.col("size"), 6).alias("coverage")).crossJoin(diversity)  # one row each
