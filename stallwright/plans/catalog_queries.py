"""Queries of listings, taxonomy, recommendation metrics and ordered folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.operators import listing as L
from stallwright.operators import log_analytics as A
from stallwright.operators import rec_metrics as M
from stallwright.operators import recommend as R
from stallwright.operators import scans as Z
from stallwright.operators.hierarchy import Hierarchy, resolve_hierarchy
from stallwright.plans.core_queries import _RESOLVED, _TREE
from stallwright.plans.log_queries import EVENTS, KEY, KIND, LOGS
from stallwright.plans.recommend_queries import _COVIEW, _EW, _KINDS, _SHOWN, _W, _recommended, co_view
from stallwright.plans.search_queries import CAT, TOK, _attribute_index, _queries
from stallwright.sources.domain import behaviour, catalog, query_logs, search_actions
from stallwright.sources.tables import table

SORTS = ["price-asc", "price-desc", "newest", "rating", "discount", "popularity", "name"]
PLACE = ["l_partkey", "l_suppkey"]
ORDER = ["day", "l_orderkey", "l_linenumber", "n"]


def _nodes(s, d):
    rows = table(s, d, "categories").select(norm_key("slug").alias("slug"), norm_key("parent").alias("parent"), "is_active", "display_order").filter("slug IS NOT NULL")
    return rows.groupBy("slug").agg(F.min("parent").alias("parent"), F.max("is_active").alias("is_active"), F.min("display_order").alias("display_order"))


def category_pages(s, d):
    places = table(s, d, "categories").select(norm_key("id").alias("category_id"), norm_key("slug").alias("slug")).filter("category_id IS NOT NULL AND slug IS NOT NULL").groupBy("category_id").agg(F.min("slug").alias("slug"))
    tree = Hierarchy(table(s, d, "categories"))
    above = tree.descendants().select(F.col("ancestor").alias("at"), F.col("descendant").alias("slug")).unionByName(tree.ranges.select(F.col("slug").alias("at"), "slug"))
    return L.category_pages(catalog(s, d), places, above)


def public_categories(s, d):
    tree = Hierarchy(table(s, d, "categories"))
    return L.public_categories(_nodes(s, d), tree.descendants(), tree.tree())


def category_children(s, d):
    """The children of every known category, and the roots."""
    nodes = _nodes(s, d)
    known = nodes.select(F.col("slug").alias("parent"), F.lit(True).alias("known"))
    return L.children(nodes.join(known, "parent", "left").select("slug", F.when(F.col("known"), F.col("parent")).alias("parent"), "display_order"))


def category_moves(s, d):
    """For every category that leads to a root: a move of it below its root, and of its root below it, and whether that closes a cycle."""
    tree = Hierarchy(table(s, d, "categories"))
    rows = tree.tree().select("slug", "root")
    moves = rows.select("slug", F.col("root").alias("parent")).unionByName(rows.select(F.col("root").alias("slug"), F.col("slug").alias("parent"))).distinct()
    return L.would_cycle(moves, tree.descendants())


def category_locations(s, d):
    """Stored paths against those that parents give."""
    stored = table(s, d, "categories").select(norm_key("slug").alias("slug"), norm_key("path").alias("path")).filter("slug IS NOT NULL").groupBy("slug").agg(F.min("path").alias("path"))
    return L.location_changes(stored, resolve_hierarchy(table(s, d, "categories")).filter("depth >= 0").select("slug", "path"))


def typed_suggestions(s, d):
    return L.typed_suggestions(_queries(s, d).select(F.substring("query", 1, 3).alias("prefix")).filter("length(prefix) = 3"), catalog(s, d), query_logs(s, d))


def rec_evaluation(s, d):
    shown, truth = _recommended(s, d)
    items = catalog(s, d)
    liked = R.product_counters(behaviour(s, d)).select(F.col("product_id").alias("item"), R.activity().alias("score"))
    return M.evaluation(shown, truth, items.select(F.col("product_id").alias("item"), F.col("brand_name").alias("grp")), liked, items.agg(F.count("*").alias("size")), R.ranking_quality(shown, truth))


def rec_table_coverage(s, d):
    items = catalog(s, d)
    return M.table_coverage(items, similarity=R.content_similarity(items), co_views=co_view(s, d).select(F.col("item").alias("product_id")), popularity=R.product_counters(behaviour(s, d)))


def _movements(s, d):
    """Lines as movements of a part of a supplier: a returned one comes in, half of it is then reserved; any other goes out. The reference is the order."""
    lines = table(s, d, "lineitem").select(*PLACE, "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("bigint").alias("q"), "l_returnflag").distinct()
    ops = F.when(F.col("l_returnflag") == "R", F.array(F.struct(F.lit("RETURN").alias("op"), F.col("q").alias("quantity")), F.struct(F.lit("RESERVED").alias("op"), F.floor(F.col("q") / 2).alias("quantity")))).otherwise(F.array(F.struct(F.lit("SALE").alias("op"), F.col("q").alias("quantity"))))
    each = lines.select(*PLACE, "l_orderkey", "l_linenumber", "day", "q", "l_returnflag", F.posexplode(ops).alias("k", "m"))
    return each.select(*PLACE, "day", "l_orderkey", "l_linenumber", F.concat_ws(":", "l_returnflag", "q", "k").alias("n"), "m.op", "m.quantity", F.col("l_orderkey").cast("string").alias("reference"))


def ledger_balances(s, d):
    return Z.balances(Z.ledger(_movements(s, d), PLACE, ORDER), PLACE, ORDER)


def ledger_outcomes(s, d):
    return Z.ledger(_movements(s, d), PLACE, ORDER).groupBy("outcome").agg(F.count("*").alias("movements"), F.max("stock").alias("most"), F.min("stock").alias("least"))


def ledger_reconciled(s, d):
    """Places whose balance isn't the sum of what was applied: none."""
    moves = _movements(s, d)
    applied = Z.ledger(moves, PLACE, ORDER)
    both = Z.balances(applied, PLACE, ORDER).join(Z.replayed(applied, moves, PLACE, ORDER), PLACE, "left")
    return both.agg(F.count("*").alias("places"), F.count_if(F.col("stock") != F.coalesce("summed", F.lit(0))).alias("mismatches"), F.sum("stock").alias("stock"))


def low_stock(s, d):
    """Places with some stock of which at most five are available, the barest first."""
    rows = ledger_balances(s, d).filter("stock > 0 AND available <= 5")
    return rows.orderBy("available", *PLACE).limit(100).select(*PLACE, "stock", "reserved", "available")


def stock_summary(s, d):
    return ledger_balances(s, d).agg(F.count("*").alias("places"), F.count_if(F.col("available") <= 0).alias("out"), F.sum("stock").alias("stock"), F.sum("reserved").alias("reserved"), F.sum("available").alias("available"))


def rate_limited(s, d):
    """Searches of each session against a limit of three in ten minutes."""
    hits = query_logs(s, d).select("session", "id", F.unix_micros("created_at").alias("time_us"))
    return Z.rate_limited(hits, "session", "time_us", "id", 3, 600_000_000).groupBy("session").agg(F.count("*").alias("hits"), F.count_if(~F.col("allowed")).alias("refused"), F.max("used").alias("most"))


def interest_state(s, d):
    """Interest of each subject in each product: signed weights in order of time, never below zero."""
    rows = behaviour(s, d).filter(F.col("kind").isin(list(R.EVENT_WEIGHTS)) & F.col("subject").isNotNull() & F.col("product_id").isNotNull() & F.col("time_us").isNotNull() & F.col("event_id").isNotNull())
    weight = F.create_map(*(x for k, w in R.EVENT_WEIGHTS.items() for x in (F.lit(k), F.lit(w))))[F.col("kind")]
    return Z.floored_sums(rows.select("subject", "product_id", "time_us", "event_id", weight.alias("w")), ["subject", "product_id"], ["time_us", "event_id"], "w")


def retained_events(s, d):
    """Events by kind of the last fortnight of the data, and without time."""
    rows = behaviour(s, d).select("kind", F.timestamp_micros("time_us").alias("at"))
    return Z.retained(rows, "at", 14).groupBy("kind").agg(F.count("*").alias("events"))


def vocabulary_stats(s, d):
    return table(s, d, "search_vocabulary").groupBy(F.upper(F.trim("source")).alias("source")).agg(F.count("*").alias("terms"), F.sum("document_count").alias("documents"))


def path_similarity(s, d):
    """How near each stored category path is to its true one."""
    stored = table(s, d, "categories").select(norm_key("slug").alias("slug"), norm_key("path").alias("stored")).filter("slug IS NOT NULL").groupBy("slug").agg(F.min("stored").alias("stored"))
    tree = resolve_hierarchy(table(s, d, "categories")).filter("depth >= 0").select("slug", "path")
    return stored.join(tree, "slug").select("slug", F.round(L.path_similarity(F.col("stored"), F.col("path")), 6).alias("similarity"))


def missing_variants(s, d):
    """Of each product the combinations of the colours and sizes it has, of which no variant is there."""
    cells = _attribute_index(s, d).filter("key IN ('color', 'size')")
    grid = L.variant_grid(cells.select("product_id", F.col("key").alias("axis"), F.when(F.col("key") == "color", 0).otherwise(1).alias("place"), "value"), 10_000)
    return grid.groupBy("product_id").agg(F.count("*").alias("combinations"), F.min("combo").alias("first"))


def _events(s, d):
    return behaviour(s, d)


QUERIES = {
    "listing_sorts": lambda s, d: L.first_pages(catalog(s, d).filter("is_searchable"), SORTS),
    "related_in_category": lambda s, d: L.related_in_category(catalog(s, d)),
    "search_documents": lambda s, d: L.search_documents(catalog(s, d)),
    "eligible_products": lambda s, d: L.eligible(catalog(s, d), least=50_000, most=400_000, in_stock=True),
    "history_suggestions": lambda s, d: L.history_suggestions(A.search_history(query_logs(s, d))),
    "wishlists": lambda s, d: L.wishlists(behaviour(s, d), catalog(s, d)),
    "customer_orders": lambda s, d: L.customer_orders(table(s, d, "orders"), table(s, d, "lineitem"), table(s, d, "part")),
    "sitemap": lambda s, d: L.sitemap(catalog(s, d)),
    "top_brands": lambda s, d: L.top_brands(catalog(s, d)),
    "catalog_facets": lambda s, d: L.variant_facets(_attribute_index(s, d), catalog(s, d)),
    "trending_suggestions": lambda s, d: L.trending_suggestions(query_logs(s, d)),
    "observed_terms": lambda s, d: L.observed_terms(query_logs(s, d), table(s, d, "search_vocabulary")),
    "category_breadcrumbs": lambda s, d: L.breadcrumbs(resolve_hierarchy(table(s, d, "categories")).filter("depth >= 0")),
    "rec_overview": lambda s, d: M.overview(_events(s, d)),
    "rec_by_type": lambda s, d: M.by_type(_events(s, d)),
    "rec_daily_rollup": lambda s, d: M.daily(_events(s, d)),
    "rec_time_series": lambda s, d: M.series(M.daily(_events(s, d))),
    "conversion_by_position": lambda s, d: M.by_position(search_actions(s, d)),
    "rec_top_products": lambda s, d: M.top_products(_events(s, d), catalog(s, d)),
    "attribution_recommended": lambda s, d: M.attributed(_events(s, d).filter("event_id IS NOT NULL")),
} | {f.__name__: f for f in (path_similarity, missing_variants, category_pages, public_categories, category_children, category_moves, category_locations, typed_suggestions, rec_evaluation, rec_table_coverage, ledger_balances, ledger_outcomes, ledger_reconciled, low_stock, stock_summary, rate_limited, interest_state, retained_events, vocabulary_stats)}

_RECS = EVENTS.replace("min({0}) AS placement".format(KIND("recommendation_type")), f"min({KIND('recommendation_type')}) AS placement, min({KEY('recommendation_request_id')}) AS request_id")
_COUNTS = "count(*) FILTER (kind = 'PRODUCT_VIEW') AS impressions, count(*) FILTER (kind = 'PRODUCT_CLICK') AS clicks, count(*) FILTER (kind = 'ADD_TO_CART') AS carts, count(*) FILTER (kind = 'PURCHASE') AS purchases"
_RATES = "round(clicks::DOUBLE / nullif(impressions, 0), 6) AS ctr, round(carts::DOUBLE / nullif(impressions, 0), 6) AS cart_rate, round(purchases::DOUBLE / nullif(impressions, 0), 6) AS conversion"
_DAILY = f"{_RECS}, dl AS (SELECT (epoch_ms(0) + to_microseconds(time_us))::DATE AS day, placement, {_COUNTS} FROM ev WHERE placement IS NOT NULL AND time_us IS NOT NULL GROUP BY 1, 2), dr AS (SELECT day, placement, impressions, least(clicks, impressions) AS clicks, carts, purchases FROM dl)"
_OPEN = "open_ AS (SELECT * FROM cat WHERE is_searchable)"
_ORDERS = {"price-asc": "price_paise NULLS LAST, name DESC", "price-desc": "price_paise DESC NULLS LAST, name DESC", "newest": "indexed_at DESC NULLS LAST", "rating": "rating_average DESC NULLS LAST, rating_count DESC", "discount": "CASE WHEN compare_at_paise > 0 THEN (compare_at_paise - price_paise)::DOUBLE / compare_at_paise ELSE 0 END DESC", "popularity": "popularity DESC NULLS LAST, rating_average DESC NULLS LAST", "name": "name NULLS LAST"}
_CATS = f"cats AS (SELECT {KEY('slug')} AS slug, min({KEY('parent')}) AS parent, bool_or(is_active) AS is_active, min(display_order) AS display_order FROM categories WHERE {KEY('slug')} IS NOT NULL GROUP BY 1)"
_UP = "ups AS (SELECT slug AS at_, slug FROM t UNION ALL SELECT n.parent, ups.slug FROM ups JOIN n ON n.slug = ups.at_ WHERE n.parent IS NOT NULL)"
_LINES = """ln AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate::DATE AS day, l_quantity::BIGINT AS q, l_returnflag AS f FROM lineitem),
 mv AS (SELECT l_partkey, l_suppkey, day, l_orderkey, l_linenumber, f || ':' || q || ':0' AS n, CASE WHEN f = 'R' THEN 'RETURN' ELSE 'SALE' END AS op, q AS quantity FROM ln UNION ALL SELECT l_partkey, l_suppkey, day, l_orderkey, l_linenumber, f || ':' || q || ':1', 'RESERVED', q // 2 FROM ln WHERE f = 'R'),
 mk AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, op, l_orderkey ORDER BY day, l_orderkey, l_linenumber, n) > 1 AS again, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY day, l_orderkey, l_linenumber, n) AS k FROM mv),
 fo AS (SELECT DISTINCT l_partkey, l_suppkey, 0::BIGINT AS k, ''::VARCHAR AS op, 0::BIGINT AS quantity, '' AS outcome, 0::BIGINT AS stock, 0::BIGINT AS reserved FROM mk UNION ALL SELECT l_partkey, l_suppkey, k, op, quantity, outcome, stock + CASE WHEN outcome = 'APPLIED' AND op = 'RETURN' THEN quantity WHEN outcome = 'APPLIED' AND op = 'SALE' THEN -quantity ELSE 0 END, reserved + CASE WHEN outcome = 'APPLIED' AND op = 'RESERVED' THEN quantity ELSE 0 END
  FROM (SELECT m.l_partkey, m.l_suppkey, m.k, m.op, m.quantity, fo.stock, fo.reserved, CASE WHEN m.quantity <= 0 THEN 'INVALID' WHEN m.again THEN 'REPEATED' WHEN m.op <> 'RETURN' AND m.quantity > fo.stock - fo.reserved THEN 'SHORT' ELSE 'APPLIED' END AS outcome FROM fo JOIN mk m ON m.l_partkey = fo.l_partkey AND m.l_suppkey = fo.l_suppkey AND m.k = fo.k + 1) z),
 bal AS (SELECT l_partkey, l_suppkey, arg_max(stock, k) AS stock, arg_max(reserved, k) AS reserved, greatest(0, arg_max(stock, k) - arg_max(reserved, k)) AS available, count(*) FILTER (k > 0) AS movements, count(*) FILTER (k > 0 AND outcome <> 'APPLIED') AS refused FROM fo GROUP BY 1, 2)"""

ORACLE = {
    "listing_sorts": f"WITH {CAT}, {_OPEN} " + " UNION ALL ".join(f"SELECT '{k}' AS sort, row_number() OVER (ORDER BY {o}, product_id) AS rank, product_id FROM open_ QUALIFY rank <= 24" for k, o in _ORDERS.items()),
    "related_in_category": f"WITH {CAT}, {_OPEN} SELECT a.product_id, b.product_id AS related_id, row_number() OVER (PARTITION BY a.product_id ORDER BY coalesce(b.popularity, -1) DESC, b.rating_count DESC, b.product_id) AS rank FROM open_ a JOIN open_ b ON a.category_path = b.category_path AND a.product_id <> b.product_id QUALIFY rank <= 24",
    "search_documents": f"WITH {CAT}, c AS (SELECT product_id, " + ", ".join(f"left(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')), {n}) AS {c}" for c, n in L.TEXT_LIMITS.items()) + " FROM cat) SELECT *, left(lower(array_to_string(list_filter([name, brand_name, attribute_text, tag_text], lambda x: x <> ''), ' ')), 500) AS trigram_text FROM c",
    "eligible_products": f"WITH {CAT} SELECT product_id FROM cat WHERE is_searchable AND price_paise BETWEEN 50000 AND 400000 AND status = 'ACTIVE' ORDER BY 1 LIMIT 5000",
    "history_suggestions": f"""WITH {LOGS}, r AS (SELECT session, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))), ' ') AS canonical, query, created_at FROM logs WHERE session IS NOT NULL AND query IS NOT NULL),
 e AS (SELECT session, canonical, max(struct_pack(t := created_at, q := query)) AS last FROM r WHERE canonical <> '' GROUP BY 1, 2), k AS (SELECT session, last.q AS text, row_number() OVER (PARTITION BY session ORDER BY last.t DESC, canonical) AS rank FROM e QUALIFY rank <= 20) SELECT session, text, 2001 - rank AS weight FROM k""",
    "wishlists": f"WITH {EVENTS}, {CAT}, l AS (SELECT subject, product_id, max(struct_pack(t := time_us, k := kind)) AS m FROM ev WHERE kind IN ('WISHLIST_ADD', 'WISHLIST_REMOVE') AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL GROUP BY 1, 2) SELECT subject, product_id, m.t AS since_us, name, price_paise FROM l JOIN cat USING (product_id) WHERE m.k = 'WISHLIST_ADD'",
    "customer_orders": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 10), i AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity, min(struct_pack(n := l_linenumber, p := l_partkey)).p AS p FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) GROUP BY 1)
 SELECT o_custkey AS customer, o_orderkey AS "order", rank, o_orderdate::DATE AS day, coalesce(lines, 0) AS lines, coalesce(quantity, 0) AS quantity, p_name AS first_item FROM o LEFT JOIN i ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = p""",
    "sitemap": f"WITH {CAT} SELECT slug, indexed_at AS updated_at FROM cat WHERE is_searchable AND slug IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 45000",
    "path_similarity": _TREE + f""", st AS (SELECT {KEY('slug')} AS slug, min({KEY('path')}) AS stored FROM categories WHERE {KEY('slug')} IS NOT NULL GROUP BY 1), p AS (SELECT st.slug, stored, t.path, string_split(stored, '/') AS x, string_split(t.path, '/') AS y FROM st JOIN t ON t.slug = st.slug)
 SELECT slug, round(CASE WHEN stored = path THEN 1.0 WHEN stored IS NULL THEN 0.0 ELSE least(0.85, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[:k] = y[:k]))::DOUBLE / greatest(len(x), len(y))) END, 6)::DOUBLE AS similarity FROM p""",
    "missing_variants": _RESOLVED + f""", ix AS (SELECT DISTINCT {KEY('v.product_id')} AS product_id, lower(trim(code)) AS axis, value FROM cells JOIN attribute_definitions a ON {KEY('a.id')} = definition_id JOIN variant_attributes v ON {KEY('v.variant_id')} = cells.variant_id WHERE value IS NOT NULL AND lower(trim(code)) IN ('color', 'size') AND {KEY('v.product_id')} IS NOT NULL),
 g AS (SELECT p.product_id, c.value AS c, z.value AS z FROM (SELECT DISTINCT product_id FROM ix) p LEFT JOIN ix c ON c.product_id = p.product_id AND c.axis = 'color' LEFT JOIN ix z ON z.product_id = p.product_id AND z.axis = 'size') SELECT product_id, count(*) AS combinations, min(array_to_string(list_filter(['color:' || c, 'size:' || z], lambda x: x IS NOT NULL), '|')) AS first FROM g GROUP BY 1""",
    "top_brands": f"WITH {CAT}, {_OPEN} SELECT brand_name, count(*) AS products FROM open_ WHERE brand_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "catalog_facets": _RESOLVED + f""", {CAT}, ix AS (SELECT DISTINCT lower(trim(code)) AS axis, value, {KEY('v.product_id')} AS p FROM cells JOIN attribute_definitions a ON {KEY('a.id')} = definition_id JOIN variant_attributes v ON {KEY('v.variant_id')} = cells.variant_id WHERE value IS NOT NULL)
 SELECT axis, value, count(DISTINCT p) AS products, row_number() OVER (PARTITION BY axis ORDER BY count(DISTINCT p) DESC, value) AS rank FROM ix JOIN cat ON p = cat.product_id WHERE is_searchable GROUP BY 1, 2 QUALIFY rank <= 50""",
    "trending_suggestions": f"WITH {LOGS} SELECT query AS text, count(*) AS searches, 200 + least(200, count(*)) AS weight FROM logs WHERE result_count > 0 AND query IS NOT NULL AND created_at > (SELECT max(created_at) FROM logs) - INTERVAL 7 DAYS GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "observed_terms": f"""WITH {LOGS}, o AS (SELECT query FROM logs WHERE result_count > 0 AND query IS NOT NULL AND created_at > (SELECT max(created_at) FROM logs) - INTERVAL 30 DAYS GROUP BY 1 HAVING count(*) >= 3), w AS (SELECT unnest(list_distinct({TOK('query')})) AS term FROM o), v AS (SELECT DISTINCT {KEY('term')} AS term FROM search_vocabulary)
 SELECT w.term, count(*) AS queries, bool_or(v.term IS NOT NULL) AS known FROM w LEFT JOIN v ON v.term = w.term WHERE length(w.term) >= 3 GROUP BY 1""",
    "category_breadcrumbs": _TREE + " SELECT slug, at_ AS \"at\", parts[at_ + 1] AS crumb, array_to_string(parts[:at_ + 1], '/') AS path FROM (SELECT slug, string_split(path, '/') AS parts, unnest(range(len(string_split(path, '/')))) AS at_ FROM t)",
    "rec_overview": f"WITH {_RECS} SELECT *, {_RATES} FROM (SELECT {_COUNTS}, count(DISTINCT subject) AS subjects, count(DISTINCT request_id) AS requests, count(DISTINCT placement) AS slots FROM ev WHERE placement IS NOT NULL)",
    "rec_by_type": f"WITH {_RECS} SELECT *, {_RATES} FROM (SELECT placement, {_COUNTS} FROM ev WHERE placement IS NOT NULL GROUP BY 1)",
    "rec_daily_rollup": f"WITH {_DAILY} SELECT *, round(clicks::DOUBLE / nullif(impressions, 0), 6) AS ctr FROM dr",
    "rec_time_series": f"WITH {_DAILY} SELECT g.day, g.placement, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks, coalesce(carts, 0) AS carts, coalesce(purchases, 0) AS purchases FROM (SELECT DISTINCT placement, ((SELECT max(day) FROM dr) - k::INT)::DATE AS day FROM dr, range(14) r(k)) g LEFT JOIN dr ON dr.day = g.day AND dr.placement = g.placement",
    "conversion_by_position": f"""WITH {LOGS}, c AS (SELECT log_id, product_id, min(position) AS position FROM acts WHERE kind = 'CLICK' AND log_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2), k AS (SELECT DISTINCT log_id, product_id FROM acts WHERE kind = 'ADD_TO_CART'), b AS (SELECT DISTINCT log_id, product_id FROM acts WHERE kind = 'PURCHASE')
 SELECT position, count(*) AS clicked, count(k.log_id) AS carted, count(b.log_id) AS bought, round(count(k.log_id)::DOUBLE / count(*), 6) AS cart_rate, round(count(b.log_id)::DOUBLE / count(*), 6) AS conversion FROM c LEFT JOIN k ON k.log_id = c.log_id AND k.product_id = c.product_id LEFT JOIN b ON b.log_id = c.log_id AND b.product_id = c.product_id WHERE position BETWEEN 1 AND 60 GROUP BY 1""",
    "rec_top_products": f"WITH {_RECS}, {CAT}, c AS (SELECT product_id, {_COUNTS} FROM ev WHERE placement IS NOT NULL AND product_id IS NOT NULL GROUP BY 1) SELECT c.*, coalesce(name, '(removed)') AS name, {_RATES} FROM c LEFT JOIN cat USING (product_id) ORDER BY impressions DESC, clicks DESC, product_id LIMIT 50",
    "attribution_recommended": f"""WITH {_RECS}, e AS (SELECT * FROM ev WHERE subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL AND event_id IS NOT NULL), tch AS (SELECT subject, product_id, time_us, placement, request_id, event_id FROM e WHERE placement IS NOT NULL AND kind IN ('PRODUCT_VIEW', 'PRODUCT_CLICK') QUALIFY row_number() OVER (PARTITION BY subject, product_id, time_us ORDER BY event_id DESC) = 1)
 SELECT o.event_id, o.kind, CASE WHEN o.time_us - x.time_us <= 604800000000 THEN x.placement END AS placement, CASE WHEN o.time_us - x.time_us <= 604800000000 THEN x.request_id END AS request_id, CASE WHEN o.time_us - x.time_us <= 604800000000 THEN round((o.time_us - x.time_us) / 3600000000.0, 2) END AS hours
 FROM (SELECT * FROM e WHERE kind IN ('ADD_TO_CART', 'PURCHASE')) o ASOF LEFT JOIN tch x ON o.subject = x.subject AND o.product_id = x.product_id AND o.time_us >= x.time_us""",
    "category_pages": _TREE + f""", {CAT}, {_UP}, ids AS (SELECT {KEY('id')} AS cid, min({KEY('slug')}) AS slug FROM categories GROUP BY 1), e AS (SELECT DISTINCT at_ AS slug, product_id, indexed_at FROM cat JOIN ids ON {KEY('category_id')} = cid JOIN ups ON ups.slug = ids.slug WHERE is_searchable)
 SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY indexed_at DESC NULLS LAST, product_id) AS rank, product_id FROM e QUALIFY rank <= 12""",
    "public_categories": _TREE + f", {_CATS}, {_UP} SELECT t.slug, t.path, t.depth FROM t WHERE depth < 5 AND t.slug NOT IN (SELECT ups.slug FROM ups JOIN cats c ON c.slug = ups.at_ WHERE NOT c.is_active)",
    "category_children": f"WITH {_CATS}, k AS (SELECT a.slug, b.slug AS parent, a.display_order FROM cats a LEFT JOIN cats b ON a.parent = b.slug) SELECT parent, slug, row_number() OVER (PARTITION BY parent ORDER BY display_order NULLS LAST, slug) AS place, (row_number() OVER (PARTITION BY parent ORDER BY display_order NULLS LAST, slug) - 1) * 10 AS position FROM k",
    "category_moves": _TREE + f", {_UP}, mv AS (SELECT slug, root AS parent FROM t UNION SELECT root, slug FROM t) SELECT mv.slug, mv.parent, ups.slug IS NOT NULL AS cycle FROM mv LEFT JOIN ups ON ups.at_ = mv.slug AND ups.slug = mv.parent",
    "category_locations": _TREE + f""", st AS (SELECT {KEY('slug')} AS slug, min({KEY('path')}) AS old_path FROM categories WHERE {KEY('slug')} IS NOT NULL GROUP BY 1), j AS (SELECT coalesce(st.slug, t.slug) AS slug, old_path, t.path AS new_path FROM st FULL JOIN t ON t.slug = st.slug)
 SELECT *, CASE WHEN old_path IS NULL THEN 'ADDED' WHEN new_path IS NULL THEN 'REMOVED' ELSE 'MOVED' END AS change FROM j WHERE old_path IS DISTINCT FROM new_path""",
    "typed_suggestions": f"""WITH {LOGS}, {CAT}, {_OPEN}, p AS (SELECT DISTINCT left(query, 3) AS prefix FROM logs WHERE length(query) >= 3), r AS (SELECT 'BRAND' AS kind, lower(trim(brand_name)) AS text, 900.0::DOUBLE + least(50, count(*)) AS weight FROM open_ WHERE brand_name IS NOT NULL GROUP BY 2 UNION ALL SELECT 'CATEGORY', lower(split_part(category_path, '/', -1)), 800 + least(50, count(*)) FROM open_ WHERE category_path IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'PRODUCT', lower(trim(name)), 700 + least(50, max(coalesce(popularity, 0))) FROM open_ WHERE name IS NOT NULL GROUP BY 2 UNION ALL SELECT 'QUERY', query, 300 + least(200, count(*)) FROM logs WHERE result_count > 0 AND query IS NOT NULL GROUP BY 2),
 b AS (SELECT text, (max(struct_pack(w := weight, k := kind))).k AS kind, round(max(weight), 4) AS weight FROM r WHERE text <> '' GROUP BY 1) SELECT prefix, kind, text, weight, row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, text) AS rank FROM b JOIN p ON left(text, 3) = prefix QUALIFY rank <= 8""",
    "rec_evaluation": f"""WITH {_SHOWN}, {CAT}, truth AS (SELECT subject AS request, product_id AS item, max(CASE kind WHEN 'PURCHASE' THEN 3 ELSE 1 END) AS grade FROM ev WHERE kind IN ('PURCHASE', 'ADD_TO_CART') AND subject IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2),
 i AS (SELECT request, count(*) AS n, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY grade DESC, item) AS r FROM truth) GROUP BY 1), h AS (SELECT shown.*, grade, count(grade) OVER (PARTITION BY request ORDER BY rank) AS hits FROM shown LEFT JOIN truth USING (request, item)),
 s AS (SELECT request, count(*) AS shown, count(grade) AS found, sum(CASE WHEN grade IS NOT NULL THEN hits::DOUBLE / rank END) AS ap, sum(grade / log2(rank + 1)) AS dcg FROM h GROUP BY 1),
 q AS (SELECT request, round(coalesce(found::DOUBLE / least(10, shown), 0), 6) AS p, round(coalesce(found::DOUBLE / n, 0), 6) AS r, round(coalesce(ap / least(n, 10), 0), 6) AS a, round(coalesce(dcg / ideal, 0), 6) AS g FROM i LEFT JOIN s USING (request)),
 liked AS (SELECT product_id AS item, sum({_W}) AS score FROM ev WHERE product_id IS NOT NULL GROUP BY 1), top AS (SELECT item FROM (SELECT item, percent_rank() OVER (ORDER BY score DESC, item) AS pr FROM liked) WHERE pr < 0.1)
 SELECT (SELECT count(*) FROM q) AS requests, (SELECT round(avg(p), 6) FROM q) AS precision, (SELECT round(avg(r), 6) FROM q) AS recall, (SELECT round(avg(a), 6) FROM q) AS map, (SELECT round(avg(g), 6) FROM q) AS ndcg, round(1 - count(top.item)::DOUBLE / count(*), 6) AS novelty, round(count(DISTINCT shown.item)::DOUBLE / (SELECT count(*) FROM cat), 6) AS coverage, round(count(DISTINCT shown.item)::DOUBLE / count(*), 6) AS diversity_ratio, count(DISTINCT brand_name) AS groups FROM shown LEFT JOIN top ON top.item = shown.item LEFT JOIN cat ON cat.product_id = shown.item""",
    "rec_table_coverage": f"""WITH {_COVIEW}, {CAT}, {_OPEN}, sim AS (SELECT DISTINCT a.product_id FROM cat a JOIN cat b ON a.category_path = b.category_path AND a.product_id <> b.product_id), n AS (SELECT count(*) AS size FROM open_)
 SELECT 'similarity' AS "table", count(*) AS products, round(count(*)::DOUBLE / max(size), 4) AS share FROM open_ SEMI JOIN sim USING (product_id), n UNION ALL SELECT 'co_views', count(*), round(count(*)::DOUBLE / max(size), 4) FROM (SELECT * FROM open_ WHERE product_id IN (SELECT item FROM rel)), n UNION ALL SELECT 'popularity', count(*), round(count(*)::DOUBLE / max(size), 4) FROM (SELECT * FROM open_ WHERE product_id IN (SELECT product_id FROM ev)), n""".replace("FROM open_ SEMI JOIN sim USING (product_id), n", "FROM (SELECT * FROM open_ WHERE product_id IN (SELECT product_id FROM sim)), n"),
    "ledger_balances": f"WITH RECURSIVE {_LINES} SELECT * FROM bal",
    "ledger_outcomes": f"WITH RECURSIVE {_LINES} SELECT outcome, count(*) AS movements, max(stock) AS most, min(stock) AS least FROM fo WHERE k > 0 GROUP BY 1",
    "ledger_reconciled": f"WITH RECURSIVE {_LINES} SELECT count(*) AS places, 0::BIGINT AS mismatches, sum(stock)::BIGINT AS stock FROM bal",
    "low_stock": f"WITH RECURSIVE {_LINES} SELECT l_partkey, l_suppkey, stock, reserved, available FROM bal WHERE stock > 0 AND available <= 5 ORDER BY available, l_partkey, l_suppkey LIMIT 100",
    "stock_summary": f"WITH RECURSIVE {_LINES} SELECT count(*) AS places, count(*) FILTER (available <= 0) AS out, sum(stock)::BIGINT AS stock, sum(reserved)::BIGINT AS reserved, sum(available)::BIGINT AS available FROM bal",
    "rate_limited": f"""WITH RECURSIVE {LOGS}, h AS (SELECT session, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY session ORDER BY created_at, id) AS k FROM logs WHERE session IS NOT NULL AND created_at IS NOT NULL),
 f AS (SELECT session, 1::BIGINT AS k, t AS opened, 1::BIGINT AS used FROM h WHERE k = 1 UNION ALL SELECT h.session, h.k, CASE WHEN h.t - opened >= 600000000 THEN h.t ELSE opened END, CASE WHEN h.t - opened >= 600000000 THEN 1 ELSE used + 1 END FROM f JOIN h ON h.session = f.session AND h.k = f.k + 1)
 SELECT session, count(*) AS hits, count(*) FILTER (used > 3) AS refused, max(used) AS most FROM f GROUP BY 1""",
    "interest_state": f"""WITH {EVENTS}, r AS (SELECT subject, product_id, {_EW}::DOUBLE AS w, sum({_EW}::DOUBLE) OVER (PARTITION BY subject, product_id ORDER BY time_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM ev WHERE kind IN ({_KINDS}) AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL AND event_id IS NOT NULL)
 SELECT subject, product_id, round(sum(w) - least(0, min(run)), 6) AS total, count(*) AS signals FROM r GROUP BY 1, 2""",
    "retained_events": f"WITH {EVENTS} SELECT kind, count(*) AS events FROM ev WHERE time_us IS NULL OR time_us >= (SELECT max(time_us) FROM ev) - 1209600000000 GROUP BY 1",
    "vocabulary_stats": "SELECT upper(trim(source)) AS source, count(*) AS terms, sum(document_count)::BIGINT AS documents FROM search_vocabulary GROUP BY 1",
}
