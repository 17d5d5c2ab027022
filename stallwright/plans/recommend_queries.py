"""Queries of the recommendation operators, taxonomy counts and feeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.operators import recommend as R
from stallwright.operators.hierarchy import Hierarchy
from stallwright.plans.log_queries import EVENTS, KEY, LOGS
from stallwright.plans.search_queries import CAT, TOK
from stallwright.sources.domain import behaviour, catalog, search_actions
from stallwright.sources.feed import mark_duplicates, read_feed, read_feed_exact, validate
from stallwright.sources.tables import table
from stallwright.storage import materialize, scratch


def _baskets(s, d, item="p_name"):
    """Distinct (order, product name) of the orders that are not pending."""
    paid = table(s, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(paid, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return lines.join(table(s, d, "part").select("p_partkey", item), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col(item).alias("item")).distinct()


def _viewed(s, d):
    return _viewed_of(behaviour(s, d))


def _viewed_of(events):
    """Distinct (subject, product) of views and clicks; the subject is the user, or the session where no user is known."""
    rows = events.filter("kind IN ('PRODUCT_VIEW', 'PRODUCT_CLICK') AND subject IS NOT NULL AND product_id IS NOT NULL")
    return rows.select(F.col("subject").alias("basket"), F.col("product_id").alias("item")).distinct()


def co_view(s, d, top=24):
    return R.co_occurrence(_viewed(s, d), 3, 1.2, top=top)


def cross_sell(s, d):
    """All companions of another category, by lift the first 24 of each item."""
    groups = catalog(s, d).select(F.col("product_id").alias("item"), F.col("category_path").alias("grp"))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("lift"), "companion"))
    return R.cross_sell(co_view(s, d, None), groups).withColumn("rank", rank).filter("rank <= 24")


def basket_affinity(s, d):
    members = materialize(_baskets(s, d), "members")
    return R.basket_affinity(members, R.co_occurrence(members, 2, 1.0, top=None))


def _purchases(s, d):
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("item"), "day")


def _by_category(s, d, *keys):
    """Places in the category by popularity; with ``keys`` the first eight places of each of their values.

    Caps on the keys treat products of the same values alike, so a list of eight holds none but these.
    """
    rank = F.row_number().over(W.partitionBy("category_path").orderBy(F.desc("popularity"), "product_id"))
    rows = catalog(s, d).filter("category_path IS NOT NULL").select("category_path", "product_id", "seller_id", "brand_name", "popularity").withColumn("rank", rank)
    if not keys:
        return rows
    place = F.row_number().over(W.partitionBy("category_path", *keys).orderBy("rank"))
    return rows.withColumn("place", place).filter("place <= 8").drop("place")


def seller_cap(s, d):
    return R.cap_share(_by_category(s, d, "seller_id"), "category_path", "rank", "seller_id", 8, 2).select("category_path", "product_id", "final")


def diversity(s, d):
    return R.diversify(_by_category(s, d, "seller_id", "brand_name"), "category_path", "rank", {"seller_id": 2, "brand_name": 3}, 8).select("category_path", "product_id", "final")


def fallback(s, d):
    """Similar products, then the most popular of the category, then of the whole catalog."""
    items = catalog(s, d)
    seeds = items.select(F.col("product_id").alias("seed"), "category_path")
    similar = co_view(s, d).select(F.col("item").alias("seed"), F.col("companion").alias("product_id"), F.col("rank").alias("place"))
    pools = _by_category(s, d).filter("rank <= 13").select("category_path", "product_id", F.col("rank").alias("place"))
    top = items.orderBy(F.desc("popularity"), "product_id").limit(13).select("product_id", "popularity")
    place = F.row_number().over(W.orderBy(F.desc("popularity"), "product_id"))
    top = top.select("product_id", place.alias("place"))  # 13 rows
    return R.fallback_ladder([similar, seeds.join(pools, "category_path").select("seed", "product_id", "place"), seeds.select("seed").crossJoin(F.broadcast(top))], 12)


def _recommended(s, d):
    """For each subject the products it viewed last, against those it put in the cart or bought."""
    events = behaviour(s, d).filter("subject IS NOT NULL AND product_id IS NOT NULL")
    seen = events.filter("kind = 'PRODUCT_VIEW' AND time_us IS NOT NULL").groupBy("subject", "product_id").agg(F.max("time_us").alias("last"))
    rank = F.row_number().over(W.partitionBy("subject").orderBy(F.desc("last"), "product_id"))
    shown = seen.withColumn("rank", rank).filter("rank <= 10").select(F.col("subject").alias("request"), F.col("product_id").alias("item"), "rank")
    grade = F.max(F.when(F.col("kind") == "PURCHASE", 3).when(F.col("kind") == "ADD_TO_CART", 1)).alias("grade")
    truth = events.filter("kind IN ('PURCHASE', 'ADD_TO_CART')").groupBy(F.col("subject").alias("request"), F.col("product_id").alias("item")).agg(grade)
    return shown, truth


def ranking_quality(s, d):
    return R.ranking_quality(*_recommended(s, d))


def list_quality(s, d):
    items = catalog(s, d)
    return R.list_quality(_recommended(s, d)[0], items.select(F.col("product_id").alias("item"), F.col("brand_name").alias("grp")), items.agg(F.count("*").alias("size")))


def taxonomy_counts(s, d):
    """Products in each category with all below it, counted from direct counts by ancestor."""
    places = table(s, d, "categories").select(norm_key("id").alias("category_id"), norm_key("slug").alias("slug")).filter("category_id IS NOT NULL AND slug IS NOT NULL").groupBy("category_id").agg(F.min("slug").alias("slug"))
    direct = catalog(s, d).select(norm_key("category_id").alias("category_id"), "price_paise").join(places, "category_id").groupBy("slug").agg(F.count("*").alias("n"), F.min("price_paise").alias("low"))
    tree = Hierarchy(table(s, d, "categories"))
    above = tree.descendants().select(F.col("ancestor").alias("at"), F.col("descendant").alias("slug"))
    own = tree.ranges.select(F.col("slug").alias("at"), "slug")
    return own.unionByName(above).join(direct, "slug").groupBy(F.col("at").alias("slug")).agg(F.sum("n").alias("products"), F.min("low").alias("low"))


def unindexed(s, d):
    """Products named by what follows a search that the index doesn't have (anti-join)."""
    seen = search_actions(s, d).filter("product_id IS NOT NULL").groupBy("product_id").agg(F.count("*").alias("events"))
    return seen.join(catalog(s, d).select("product_id"), "product_id", "left_anti")


def brand_counts(s, d):
    """All brands of the index, with those of their products that can be searched; brands without any stay."""
    brands = catalog(s, d).filter("brand_name IS NOT NULL").select("brand_name", F.col("is_searchable").cast("int").alias("open"), "rating_count")
    return brands.groupBy("brand_name").agg(F.count("*").alias("products"), F.sum(F.coalesce("open", F.lit(0))).alias("searchable"), F.sum("rating_count").alias("ratings"))


def ledger_replay(s, d):
    """Stock per part and supplier from signed movements: returns in, other lines out."""
    lines = table(s, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_returnflag").alias("f"))
    return lines.groupBy("l_partkey", "l_suppkey").agg(F.sum(F.when(F.col("f") == "R", F.col("q")).otherwise(-F.col("q"))).alias("balance"), F.count_if(F.col("f") == "R").alias("returns"), F.count("*").alias("movements"))


def _feed(s, d) -> str:
    """A dirty feed made of the catalog, written as quoted CSV under headers of other names; every fault comes from a remainder of the rating count."""
    n = F.coalesce("rating_count", F.lit(0))
    fault = lambda k, bad, good: F.when(n % k == 0, F.lit(bad)).otherwise(good)
    price = F.format_string("%d.%02d", F.floor(F.col("price_paise") / 100), F.col("price_paise") % 100)
    rows = catalog(s, d).select(
        fault(11, "", F.col("name")).alias(" Product Title "), fault(7, "a b", F.col("sku_text")).alias("Item No"), fault(5, "12.345", price).alias("MRP"), fault(9, "free", price).alias("Offer Price"), fault(13, "-3", n.cast("string")).alias("Qty"),
        fault(4, "ftp://x", F.concat(F.lit("https://img.example/"), "slug")).alias("Main Image"), fault(6, "nobody", F.lit("who@shop.example")).alias("E-Mail"), F.col("description_text").alias("Story"),
    )
    path = scratch(s, "feed")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


def feed_issues(s, d):
    """A dirty CSV feed read, its columns named, and validated."""
    return validate(read_feed(s, _feed(s, d))).groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n"), F.sum("price_minor").alias("price_minor"))


def feed_lines(s, d):
    """The same feed by the exact reader: rows, lines, and columns of each file, as one row."""
    rows = read_feed_exact(s, _feed(s, d))
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("issue").isNotNull()).alias("broken"), F.max(F.size("fields")).alias("columns"), F.count_if(F.col("fields")[1] == "a b").alias("marked"))


def feed_duplicates(s, d):
    rows = table(s, d, "product_search_index").select(F.upper(F.trim("sku_text")).alias("sku"), F.concat_ws(" ", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), norm_key("product_id")).alias("at")).distinct()
    return mark_duplicates(rows, "at").filter("duplicate").select("sku", "at")


QUERIES = {
    "co_purchase_lift": lambda s, d: R.co_occurrence(_baskets(s, d)),
    "co_view_pairs": co_view,
    "cross_sell": cross_sell,
    "upsell_range_join": lambda s, d: R.upsell(catalog(s, d)),
    "basket_affinity": basket_affinity,
    "popularity_scopes": lambda s, d: R.popularity(behaviour(s, d), catalog(s, d)),
    "trending": lambda s, d: R.trending(behaviour(s, d)),
    "interest_profile": lambda s, d: R.interest_profiles(behaviour(s, d), catalog(s, d)),
    "profile_confidence": lambda s, d: R.profile_confidence(behaviour(s, d)),
    "price_preference": lambda s, d: R.price_preference(behaviour(s, d), catalog(s, d)),
    "replenishment": lambda s, d: R.replenishment(_purchases(s, d), 36500),
    "content_similarity_topk": lambda s, d: R.content_similarity(catalog(s, d)),
    "seller_share_cap": seller_cap,
    "diversity_cap": diversity,
    "fallback_ladder": fallback,
    "ranking_quality": ranking_quality,
    "list_quality": list_quality,
    "taxonomy_counts": taxonomy_counts,
    "unindexed_anti": unindexed,
    "brand_counts": brand_counts,
    "ledger_replay": ledger_replay,
    "feed_issues": feed_issues,
    "feed_lines": feed_lines,
    "feed_duplicates": feed_duplicates,
}


def _pairs_sql(members: str, least: int, lift: float, top: int | None = 24) -> str:
    return f"""{members}, one AS (SELECT item, count(*) AS n FROM m GROUP BY 1), tot AS (SELECT count(DISTINCT basket) AS total FROM m),
 two AS (SELECT a.item, b.item AS companion, count(*) AS pairs FROM m a JOIN m b ON a.basket = b.basket AND a.item <> b.item GROUP BY ALL HAVING count(*) >= {least}),
 rel AS (SELECT item, companion, pairs, round(pairs::DOUBLE / total, 6) AS support, round(pairs::DOUBLE / n1, 6) AS confidence, round(pairs * total::DOUBLE / (n1 * n2), 6) AS lift,
  row_number() OVER (PARTITION BY item ORDER BY lift DESC, confidence DESC, pairs DESC, companion) AS rank FROM (SELECT two.*, x.n AS n1, y.n AS n2, total FROM two JOIN one x ON x.item = two.item JOIN one y ON y.item = companion, tot WHERE pairs * total::DOUBLE / (x.n * y.n) >= {lift}){'' if top is None else f' QUALIFY rank <= {top}'})"""


_ORDERS = "m AS (SELECT DISTINCT l_orderkey AS basket, p_name AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'P')"
_VIEWS = f"{EVENTS}, m AS (SELECT DISTINCT subject AS basket, product_id AS item FROM ev WHERE kind IN ('PRODUCT_VIEW', 'PRODUCT_CLICK') AND subject IS NOT NULL AND product_id IS NOT NULL)"
_COVIEW, _COVIEW_ALL = _pairs_sql(_VIEWS, 3, 1.2), _pairs_sql(_VIEWS, 3, 1.2, None)
_W = "CASE kind WHEN 'PRODUCT_VIEW' THEN 1 WHEN 'PRODUCT_CLICK' THEN 1 WHEN 'ADD_TO_CART' THEN 6 WHEN 'WISHLIST_ADD' THEN 5 WHEN 'PURCHASE' THEN 25 ELSE 0 END"
_EW = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in R.EVENT_WEIGHTS.items()) + " END"
_KINDS = ", ".join(f"'{k}'" for k in R.EVENT_WEIGHTS)
_BYCAT = f"{CAT}, bc AS (SELECT category_path, product_id, seller_id, brand_name, popularity, row_number() OVER (PARTITION BY category_path ORDER BY popularity DESC, product_id) AS rank FROM cat WHERE category_path IS NOT NULL)"
_SHOWN = f"""{EVENTS}, shown AS (SELECT subject AS request, product_id AS item, row_number() OVER (PARTITION BY subject ORDER BY max(time_us) DESC, product_id) AS rank FROM ev WHERE kind = 'PRODUCT_VIEW' AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL GROUP BY subject, product_id QUALIFY rank <= 10)"""
_SIM = "(0.3 + 0.18 * coalesce((a.brand_name = b.brand_name)::INT, 0) + 0.18 * coalesce(len(list_intersect(a.att, b.att))::DOUBLE / nullif(len(list_distinct(a.att || b.att)), 0), 0) + 0.07 * coalesce(CASE WHEN a.price_paise > 0 AND b.price_paise > 0 THEN least(a.price_paise, b.price_paise)::DOUBLE / greatest(a.price_paise, b.price_paise) END, 0) + 0.05 * coalesce(len(list_intersect(a.wrd, b.wrd))::DOUBLE / nullif(len(list_distinct(a.wrd || b.wrd)), 0), 0)) / 0.78"

ORACLE = {
    "co_purchase_lift": "WITH " + _pairs_sql(_ORDERS, 2, 1.05) + " SELECT * FROM rel",
    "co_view_pairs": f"WITH {_COVIEW} SELECT * FROM rel",
    "cross_sell": f"WITH {_COVIEW_ALL}, {CAT} SELECT item, companion, lift, row_number() OVER (PARTITION BY item ORDER BY lift DESC, companion) AS rank FROM rel LEFT JOIN cat x ON x.product_id = item LEFT JOIN cat y ON y.product_id = companion WHERE x.category_path IS DISTINCT FROM y.category_path QUALIFY row_number() OVER (PARTITION BY item ORDER BY lift DESC, companion) <= 24",
    "upsell_range_join": f"""WITH {CAT}, p AS (SELECT *, row_number() OVER (PARTITION BY category_path ORDER BY popularity DESC, product_id) AS place FROM cat WHERE category_path IS NOT NULL AND price_paise > 0)
 SELECT a.product_id, b.product_id AS upsell_id, row_number() OVER (PARTITION BY a.product_id ORDER BY b.place) AS rank FROM p a JOIN p b ON a.category_path = b.category_path AND b.price_paise >= 1.1::DOUBLE * a.price_paise AND b.price_paise <= 1.8::DOUBLE * a.price_paise AND a.product_id <> b.product_id QUALIFY rank <= 12""",
    "basket_affinity": "WITH " + _pairs_sql(_ORDERS, 2, 1.0, None) + """, f AS (SELECT basket, companion, sum(lift::DECIMAL(18, 6))::DOUBLE AS affinity FROM m JOIN rel USING (item) GROUP BY ALL)
 SELECT f.*, row_number() OVER (PARTITION BY f.basket ORDER BY affinity DESC, companion) AS rank FROM f ANTI JOIN m ON f.basket = m.basket AND companion = m.item QUALIFY rank <= 12""",
    "popularity_scopes": f"""WITH {EVENTS}, {CAT}, c AS (SELECT product_id, count(*) FILTER (kind IN ('PRODUCT_VIEW', 'PRODUCT_CLICK')) AS v, count(*) FILTER (kind = 'PURCHASE') AS p, round(ln(1 + sum({_W})), 4) AS score FROM ev WHERE product_id IS NOT NULL AND time_us >= (SELECT max(time_us) FROM ev) - 2592000000000 GROUP BY 1),
 j AS (SELECT c.product_id, score, CASE WHEN v > 0 THEN round(least(1, p::DOUBLE / v), 6) ELSE 0 END AS conversion, brand_name, category_path FROM c LEFT JOIN cat USING (product_id)),
 e AS (SELECT 'GLOBAL' AS scope, 'all' AS scope_key, product_id, score, conversion FROM j UNION ALL SELECT 'CATEGORY', category_path, product_id, score, conversion FROM j UNION ALL SELECT 'BRAND', brand_name, product_id, score, conversion FROM j)
 SELECT *, row_number() OVER (PARTITION BY scope, scope_key ORDER BY score DESC, product_id) AS rank FROM e WHERE scope_key IS NOT NULL""",
    "trending": f"""WITH {EVENTS}, r AS (SELECT product_id, (SELECT max(time_us) FROM ev) - time_us AS age, {_W} AS w FROM ev WHERE product_id IS NOT NULL AND time_us IS NOT NULL),
 c AS (SELECT product_id, sum(CASE WHEN age < 172800000000 THEN w ELSE 0 END)::BIGINT AS recent, sum(w)::BIGINT AS base FROM r WHERE age < 2592000000000 GROUP BY 1)
 SELECT product_id, recent, base, round(ln((recent / 2.0) / (base / 30.0 + 5)), 4) AS trend FROM c WHERE recent >= 20 AND (recent / 2.0) / (base / 30.0 + 5) > 1""",
    "interest_profile": f"""WITH {EVENTS}, {CAT}, r AS (SELECT subject, product_id, {_EW}::DOUBLE AS w, (SELECT max(time_us) FROM ev) - time_us AS age FROM ev WHERE kind IN ({_KINDS}) AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL),
 f AS (SELECT subject, product_id, sum(w * CASE WHEN pow(0.5, age / 1209600000000.0) < 0.01 THEN 0 ELSE pow(0.5, age / 1209600000000.0) END) AS w FROM r GROUP BY ALL),
 j AS (SELECT f.*, brand_name, category_path FROM f LEFT JOIN cat USING (product_id)),
 s AS (SELECT subject, dimension, key, greatest(sum(w), 0) AS w FROM (SELECT subject, 'PRODUCT' AS dimension, product_id AS key, w FROM j UNION ALL SELECT subject, 'BRAND', brand_name, w FROM j UNION ALL SELECT subject, 'CATEGORY', category_path, w FROM j) WHERE key IS NOT NULL GROUP BY ALL HAVING greatest(sum(w), 0) > 1e-9)
 SELECT subject, dimension, key, round(w / max(w) OVER (PARTITION BY subject, dimension), 4) AS weight FROM s""",
    "profile_confidence": f"WITH {EVENTS} SELECT subject, count(*) AS signals, round(least(0.98::DOUBLE, count(*)::DOUBLE / (count(*) + 25)), 6) AS confidence FROM ev WHERE kind IN ({_KINDS}) AND subject IS NOT NULL AND product_id IS NOT NULL GROUP BY 1",
    "price_preference": f"""WITH {EVENTS}, {CAT}, r AS (SELECT subject, price_paise, CASE kind {' '.join(f"WHEN '{k}' THEN {int(w + 0.5)}" for k, w in R.EVENT_WEIGHTS.items() if w >= 1)} END AS times FROM ev JOIN cat USING (product_id) WHERE subject IS NOT NULL AND price_paise IS NOT NULL),
 l AS (SELECT subject, list_sort(flatten(list([price_paise FOR i IN range(times)]))) AS prices FROM r WHERE times IS NOT NULL GROUP BY 1)
 SELECT subject, prices[floor((len(prices) - 1) * 0.2)::INT + 1] AS low_price, prices[floor((len(prices) - 1) * 0.9)::INT + 1] AS high_price FROM l""",
    "replenishment": """WITH p AS (SELECT DISTINCT o_custkey AS customer, l_partkey AS item, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 g AS (SELECT *, day - lag(day) OVER (PARTITION BY customer, item ORDER BY day) AS gap FROM p), s AS (SELECT customer, item, count(gap) AS gaps, quantile_cont(gap, 0.5)::DOUBLE AS median_days, max(day) AS last FROM g GROUP BY 1, 2)
 SELECT customer, item, gaps, median_days, median_days - ((SELECT max(day) FROM p) - last) AS due_in, round(least(0.95::DOUBLE, gaps::DOUBLE / (gaps + 2)), 6) AS confidence FROM s WHERE gaps > 0 AND median_days - ((SELECT max(day) FROM p) - last) <= 36500""",
    "content_similarity_topk": f"""WITH {CAT}, r AS (SELECT product_id, category_path, brand_name, price_paise, {TOK('attribute_text')} AS att, {TOK('name')} AS wrd, row_number() OVER (PARTITION BY category_path ORDER BY popularity DESC, product_id) AS place FROM cat WHERE category_path IS NOT NULL)
 SELECT a.product_id, b.product_id AS similar_id, round({_SIM}, 6) AS score, row_number() OVER (PARTITION BY a.product_id ORDER BY score DESC, b.product_id) AS rank FROM r a JOIN r b ON a.category_path = b.category_path AND a.product_id <> b.product_id QUALIFY rank <= 24""",
    "seller_share_cap": f"""WITH {_BYCAT}, o AS (SELECT *, coalesce(seller_id IS NOT NULL AND row_number() OVER (PARTITION BY category_path, seller_id ORDER BY rank) > 2, false) AS over_ FROM bc)
 SELECT category_path, product_id, row_number() OVER (PARTITION BY category_path ORDER BY over_, rank) AS final FROM o QUALIFY final <= 8""",
    "diversity_cap": f"""WITH RECURSIVE {_BYCAT}, r AS (SELECT *, row_number() OVER (PARTITION BY category_path ORDER BY rank) AS k FROM (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY category_path, seller_id, brand_name ORDER BY rank) <= 8)),
 w AS (SELECT category_path, 0::BIGINT AS k, NULL::VARCHAR AS product_id, []::VARCHAR[] AS sellers, []::VARCHAR[] AS brands, false AS kept FROM (SELECT DISTINCT category_path FROM r)
  UNION ALL SELECT r.category_path, r.k, r.product_id, CASE WHEN fits THEN sellers || [seller_id] ELSE sellers END, CASE WHEN fits THEN brands || [brand_name] ELSE brands END, fits FROM (
   SELECT r.*, w.sellers, w.brands, (seller_id IS NULL OR len(list_filter(w.sellers, lambda x: x = seller_id)) < 2) AND (brand_name IS NULL OR len(list_filter(w.brands, lambda x: x = brand_name)) < 3) AS fits FROM w JOIN r ON r.category_path = w.category_path AND r.k = w.k + 1) r)
 SELECT category_path, product_id, row_number() OVER (PARTITION BY category_path ORDER BY kept DESC, k)::INT AS final FROM w WHERE k > 0 QUALIFY final <= 8""",
    "fallback_ladder": f"""WITH {_COVIEW}, {_BYCAT}, t AS (SELECT product_id, row_number() OVER (ORDER BY popularity DESC, product_id) AS place FROM cat QUALIFY place <= 13),
 x AS (SELECT item AS seed, companion AS product_id, rank AS place, 0 AS rung FROM rel UNION ALL SELECT c.product_id, b.product_id, b.rank, 1 FROM cat c JOIN bc b ON c.category_path = b.category_path AND b.rank <= 13 UNION ALL SELECT c.product_id, t.product_id, t.place, 2 FROM cat c, t),
 f AS (SELECT seed, product_id, min(struct_pack(rung := rung, place := place)) AS k FROM x WHERE seed <> product_id GROUP BY 1, 2)
 SELECT seed, product_id, k.rung AS rung, row_number() OVER (PARTITION BY seed ORDER BY k.rung, k.place, product_id) AS rank FROM f QUALIFY rank <= 12""",
    "ranking_quality": f"""WITH {_SHOWN}, truth AS (SELECT subject AS request, product_id AS item, max(CASE kind WHEN 'PURCHASE' THEN 3 ELSE 1 END) AS grade FROM ev WHERE kind IN ('PURCHASE', 'ADD_TO_CART') AND subject IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2),
 i AS (SELECT request, count(*) AS n, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY grade DESC, item) AS r FROM truth) GROUP BY 1),
 h AS (SELECT shown.*, grade, count(grade) OVER (PARTITION BY request ORDER BY rank) AS hits FROM shown LEFT JOIN truth USING (request, item)),
 s AS (SELECT request, count(*) AS shown, count(grade) AS found, sum(CASE WHEN grade IS NOT NULL THEN hits::DOUBLE / rank END) AS ap, sum(grade / log2(rank + 1)) AS dcg FROM h GROUP BY 1)
 SELECT request, round(coalesce(found::DOUBLE / least(10, shown), 0), 6) AS precision, round(coalesce(found::DOUBLE / n, 0), 6) AS recall, round(coalesce(ap / least(n, 10), 0), 6) AS average_precision, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM i LEFT JOIN s USING (request)""",
    "list_quality": f"""WITH {_SHOWN}, {CAT}, g AS (SELECT request, coalesce(brand_name, '') AS grp, count(*) AS n FROM shown LEFT JOIN cat ON product_id = item GROUP BY 1, 2), l AS (SELECT request, sum(n) AS al, sum(n * (n - 1)) AS same FROM g GROUP BY 1 HAVING sum(n) > 1)
 SELECT round((SELECT count(DISTINCT item) FROM shown)::DOUBLE / (SELECT count(*) FROM cat), 6) AS coverage, round((SELECT avg(1 - same::DOUBLE / (al * (al - 1))) FROM l), 6) AS diversity""",
    "taxonomy_counts": f"""WITH RECURSIVE {CAT}, raw AS (SELECT {KEY('slug')} AS slug, min({KEY('parent')}) AS parent FROM categories GROUP BY 1 HAVING {KEY('slug')} IS NOT NULL), ids AS (SELECT {KEY('id')} AS cid, min({KEY('slug')}) AS slug FROM categories GROUP BY 1),
 n AS (SELECT a.slug, b.slug AS parent FROM raw a LEFT JOIN raw b ON a.parent = b.slug), t AS (SELECT slug FROM n WHERE parent IS NULL UNION ALL SELECT n.slug FROM n JOIN t ON n.parent = t.slug),
 up AS (SELECT slug AS at_, slug FROM t UNION ALL SELECT n.parent, up.slug FROM up JOIN n ON n.slug = up.at_ WHERE n.parent IS NOT NULL)
 SELECT at_ AS slug, count(*) AS products, min(price_paise) AS low FROM cat JOIN ids ON {KEY('category_id')} = cid JOIN up ON up.slug = ids.slug GROUP BY 1""",
    "unindexed_anti": f"WITH {LOGS}, {CAT} SELECT product_id, count(*) AS events FROM acts ANTI JOIN cat USING (product_id) WHERE product_id IS NOT NULL GROUP BY 1",
    "brand_counts": f"WITH {CAT} SELECT brand_name, count(*) AS products, sum(coalesce(is_searchable::INT, 0))::BIGINT AS searchable, sum(rating_count)::BIGINT AS ratings FROM cat WHERE brand_name IS NOT NULL GROUP BY 1",
    "ledger_replay": "SELECT l_partkey, l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END)::BIGINT AS balance, count(*) FILTER (l_returnflag = 'R') AS returns, count(*) AS movements FROM lineitem GROUP BY 1, 2",
    "feed_issues": f"""WITH {CAT}, r AS (SELECT *, coalesce(rating_count, 0) AS k, upper(trim(sku_text)) AS sku FROM cat) SELECT array_to_string(list_filter([CASE WHEN k % 11 = 0 OR trim(coalesce(name, '')) = '' THEN 'name_missing' END, CASE WHEN k % 7 <> 0 AND coalesce(sku, '') = '' THEN 'sku_missing' END,
 CASE WHEN k % 7 = 0 OR (coalesce(sku, '') <> '' AND NOT regexp_full_match(sku, '[A-Z0-9_-]{{3,64}}')) THEN 'sku_invalid' END, CASE WHEN k % 5 = 0 THEN 'price_invalid' END, CASE WHEN k % 9 = 0 THEN 'sale_price_invalid' END, CASE WHEN k % 13 = 0 THEN 'stock_invalid' END, CASE WHEN k % 4 = 0 THEN 'image_url_invalid' END, CASE WHEN k % 6 = 0 THEN 'email_invalid' END], lambda x: x IS NOT NULL), ',') AS issues,
 count(*) AS n, sum(CASE WHEN k % 5 <> 0 THEN price_paise END)::BIGINT AS price_minor FROM r GROUP BY 1""",
    "feed_lines": f"WITH {CAT} SELECT count(*) AS rows, 0::BIGINT AS broken, 8::INT AS columns, count(*) FILTER (coalesce(rating_count, 0) % 7 = 0) AS marked FROM cat",
    "feed_duplicates": f"""WITH r AS (SELECT DISTINCT upper(trim(sku_text)) AS sku, strftime(indexed_at, '%Y-%m-%d %H:%M:%S.%f') || ' ' || {KEY('product_id')} AS at_ FROM product_search_index) SELECT sku, at_ AS at FROM (SELECT *, min(at_) OVER (PARTITION BY sku) AS first FROM r) WHERE at_ > first AND sku IS NOT NULL""".replace("AS at FROM", "AS \"at\" FROM"),
}
