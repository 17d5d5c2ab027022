"""Queries of recommendation candidates, scores, exclusions and lists, with their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from stallwright.operators import candidates as N
from stallwright.operators import log_analytics as A
from stallwright.operators import recommend as R
from stallwright.plans.log_queries import EVENTS
from stallwright.plans.recommend_queries import _EW, _KINDS, _SIM, _W, _pairs_sql, _viewed_of
from stallwright.plans.search_queries import CAT, TOK
from stallwright.sources.domain import behaviour, catalog
from stallwright.storage import materialize

BOUGHT = ["PURCHASE", "ADD_TO_CART"]


class Inputs:
    """The tables that generators read; with ``keep`` those that several of them need are written once."""

    def __init__(self, spark, folder: str, keep: bool = False):
        self.spark, self.folder, self.keep = spark, folder, keep

    def _kept(self, rows, name: str):
        return materialize(rows, name) if self.keep else rows

    @cached_property
    def items(self):
        columns = ["product_id", "name", "slug", "brand_name", "category_path", "seller_id", "price_paise", "rating_average", "rating_count", "indexed_at", "is_searchable", "status", "popularity", "attribute_text"]
        rows = catalog(self.spark, self.folder)
        return self._kept(rows.select(columns), "items") if self.keep else rows

    @cached_property
    def events(self):
        return self._kept(behaviour(self.spark, self.folder), "events")

    @cached_property
    def now(self):
        return self.items.agg(F.max("indexed_at").alias("now"))

    @cached_property
    def seeds(self):
        return self.items.filter("is_searchable").select(F.col("product_id").alias("request"))

    @cached_property
    def similarity(self):
        return materialize(R.content_similarity(self.items), "similarity")

    @cached_property
    def viewed(self):
        return self._kept(R.co_occurrence(_viewed_of(self.events), 3, 1.2, top=None), "viewed")

    @cached_property
    def bought(self):
        """What goes into the cart or is bought in one session, of which pairs more frequent than chance."""
        rows = self.events.filter(F.col("kind").isin(BOUGHT) & F.col("session_id").isNotNull() & F.col("product_id").isNotNull())
        return self._kept(R.co_occurrence(rows.select(F.col("session_id").alias("basket"), F.col("product_id").alias("item")).distinct(), 2, N.LIFT_FLOOR, top=None), "bought")

    @cached_property
    def popularity(self):
        return R.popularity(self.events, self.items)

    @cached_property
    def profiles(self):
        return self._kept(R.interest_profiles(self.events, self.items), "profiles")

    @cached_property
    def scopes(self):
        """Every category, and the whole catalog."""
        paths = self.items.filter("category_path IS NOT NULL").select(F.col("category_path").alias("request"), F.lit("CATEGORY").alias("scope"), F.col("category_path").alias("scope_key")).distinct()
        return paths.unionByName(self.spark.createDataFrame([("all", "GLOBAL", "all")], "request string, scope string, scope_key string"))

    def did(self, *kinds: str):
        """Distinct (request, product_id) of what subjects did."""
        rows = self.events.filter(F.col("kind").isin(*kinds) & F.col("subject").isNotNull() & F.col("product_id").isNotNull())
        return rows.select(F.col("subject").alias("request"), "product_id").distinct()


def _recent(t: Inputs):
    return N.seen_lately(A.recently_viewed(t.events).select(F.col("subject").alias("request"), "product_id", "rank"))


GENERATORS = {
    "SIMILAR_PRODUCTS": lambda t: N.similar(t.seeds, t.similarity, t.items),
    "CUSTOMER_ALSO_VIEWED": lambda t: N.co_bought(t.seeds, t.viewed, source="CO_VIEW"),
    "CUSTOMER_ALSO_BOUGHT": lambda t: N.co_bought(t.seeds, t.bought),
    "CROSS_SELL": lambda t: N.complements(t.seeds, t.bought, t.items),
    "UPSELL": lambda t: N.dearer(t.seeds, t.similarity, t.items),
    "CART_RECOMMENDATIONS": lambda t: N.with_basket(t.did("ADD_TO_CART").withColumnRenamed("product_id", "item"), t.bought, 24),
    "TRENDING_PRODUCTS": lambda t: N.trending(t.scopes, R.trending(t.events), t.popularity),
    "POPULAR_IN_CATEGORY": lambda t: N.popular(t.scopes, t.popularity),
    "RECENTLY_VIEWED": _recent,
    "PERSONALIZED_FOR_YOU": lambda t: N.by_interest(t.profiles, t.items, 24),
    "ANONYMOUS_RECOMMENDATIONS": lambda t: N.cold_start(t.spark.createDataFrame([("anonymous",)], "request string"), t.items, t.now),
}
SCORED = ["SIMILAR_PRODUCTS", "CUSTOMER_ALSO_VIEWED", "CUSTOMER_ALSO_BOUGHT", "CROSS_SELL", "UPSELL", "PERSONALIZED_FOR_YOU"]


def _scored(t: Inputs):
    """The candidates of product slots and of the personal one, scored with all that is known of them."""
    rows = None
    for kind in SCORED:
        own = GENERATORS[kind](t).withColumn("kind", F.lit(kind))
        rows = own if rows is None else rows.unionByName(own)
    rows = N.hydrated(rows, t.items)
    counted = R.product_counters(t.events).select("product_id", F.log1p(R.activity()).alias("pop"))
    best = counted.agg(F.max("pop").alias("best"))
    rows = rows.join(counted, "product_id", "left").crossJoin(best).withColumn("popularity", F.col("pop") / F.col("best"))  # best is one row
    seed = t.items.select(F.col("product_id").alias("request"), F.col("brand_name").alias("b0"), F.col("category_path").alias("c0"))
    same = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))
    rows = rows.join(seed, "request", "left").withColumn("context", 0.7 * same("category_path", "c0") + 0.3 * same("brand_name", "b0"))
    for dimension, column in (("CATEGORY", "category_path"), ("BRAND", "brand_name"), ("PRODUCT", "product_id")):
        own = t.profiles.filter(F.col("dimension") == dimension).select(F.col("subject").alias("request"), F.col("key").alias(column), F.col("weight").alias(f"w_{dimension}"))
        rows = rows.join(own, ["request", column], "left")
    weighed = sum((F.coalesce(f"w_{k}", F.lit(0.0)) * F.lit(w) for k, w in N.C.DIMENSION_WEIGHTS.items() if k in ("CATEGORY", "BRAND", "PRODUCT")), F.lit(0.0))
    tired = A.over_exposed(t.events).select(F.col("subject").alias("request"), "product_id", F.lit(True).alias("overexposed"))
    rows = rows.withColumn("interest", weighed / sum(N.C.DIMENSION_WEIGHTS.values())).join(tired, ["request", "product_id"], "left").withColumn("repeated", F.lit(False))
    return N.score(rows, t.now, SCORED)


def recommendation_scores(s, d):
    return _scored(Inputs(s, d, True)).select("kind", "request", "product_id", *(f"part_{n}" for n in (*N._PARTS, *N._PENALTIES)), "score", "dominant")


def _excluded(s, d):
    t = Inputs(s, d, True)
    return N.exclude(_scored(t), t.did("ADD_TO_CART"), t.did("PURCHASE"), t.did("PRODUCT_CLICK"), t.did("NOT_INTERESTED"))


def recommendation_exclusions(s, d):
    return _excluded(s, d).groupBy("kind", F.coalesce("reason", F.lit("KEPT")).alias("reason")).agg(F.count("*").alias("candidates"), F.count_distinct("request").alias("requests"))


def recommendation_lists(s, d):
    """The lists of eight that are shown: without what is excluded, at most three of one seller unless nothing else is left."""
    kept = N.ranked(_excluded(s, d).filter("reason IS NULL")).withColumn("list", F.concat_ws("|", "kind", "request"))
    return R.cap_share(kept, "list", "rank", "seller_id", 8, N.seller_ceiling(8)).select("kind", "request", "product_id", "score", "final")


def recommendation_diverse(s, d):
    """The same candidates under the budgets of their slots for brands, categories and sellers."""
    return N.diversified(N.ranked(_excluded(s, d).filter("reason IS NULL")), 12)


def _alone(generator):
    return lambda s, d: generator(Inputs(s, d))


QUERIES = {f"candidates_{k.lower()}": _alone(f) for k, f in GENERATORS.items()} | {f.__name__: f for f in (recommendation_scores, recommendation_exclusions, recommendation_lists, recommendation_diverse)}

_OPEN = "seeds AS (SELECT product_id AS request FROM cat WHERE is_searchable)"
_SIMREL = f"""simr AS (SELECT product_id, category_path, brand_name, price_paise, {TOK('attribute_text')} AS att, {TOK('name')} AS wrd FROM cat WHERE category_path IS NOT NULL),
 sim AS (SELECT a.product_id, b.product_id AS similar_id, round({_SIM}, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY a.product_id ORDER BY score DESC, b.product_id) AS rank FROM simr a JOIN simr b ON a.category_path = b.category_path AND a.product_id <> b.product_id WHERE round({_SIM}, 6) >= 0.08 QUALIFY rank <= 24)"""
_VIEWED = f"vm AS (SELECT DISTINCT subject AS basket, product_id AS item FROM ev WHERE kind IN ('PRODUCT_VIEW', 'PRODUCT_CLICK') AND subject IS NOT NULL AND product_id IS NOT NULL)"
_BASKETS = f"bm AS (SELECT DISTINCT session_id AS basket, product_id AS item FROM ev WHERE kind IN ('PURCHASE', 'ADD_TO_CART') AND session_id IS NOT NULL AND product_id IS NOT NULL)"


def _relation(name: str, members: str, prefix: str, least: int, lift: float) -> str:
    """The pairs of a member table under names of their own, so that several fit one query."""
    text = _pairs_sql(members, least, lift, None)
    for word in ("one", "tot", "two", "rel"):
        text = text.replace(f"{word} AS (", f"{prefix}{word} AS (").replace(f"FROM {word} ", f"FROM {prefix}{word} ").replace(f"JOIN {word} ", f"JOIN {prefix}{word} ").replace(f"{word}.", f"{prefix}{word}.")
    text = text.replace("FROM m ", f"FROM {prefix}m ").replace("FROM m)", f"FROM {prefix}m)").replace("JOIN m ", f"JOIN {prefix}m ").replace(f", tot WHERE", f", {prefix}tot WHERE")
    return text.replace(f"{prefix}rel AS (", f"{name} AS (")


_VIEWREL, _BUYREL = _relation("viewrel", _VIEWED, "v", 3, 1.2), _relation("buyrel", _BASKETS, "b", 2, 1.05)
_BASE = f"WITH RECURSIVE {EVENTS}, {CAT}, {_OPEN}"
_PICK = "row_number() OVER (PARTITION BY request ORDER BY {0} DESC, product_id) <= {1}".format
_POPS = f"""pc AS (SELECT product_id, round(ln(1 + sum({_W})), 4)::DOUBLE AS score FROM ev WHERE product_id IS NOT NULL AND time_us >= (SELECT max(time_us) FROM ev) - 2592000000000 GROUP BY 1),
 pj AS (SELECT pc.*, brand_name, category_path FROM pc LEFT JOIN cat USING (product_id)),
 pops AS (SELECT *, row_number() OVER (PARTITION BY scope, scope_key ORDER BY score DESC, product_id) AS rank FROM (SELECT 'GLOBAL' AS scope, 'all' AS scope_key, product_id, score FROM pj UNION ALL SELECT 'CATEGORY', category_path, product_id, score FROM pj UNION ALL SELECT 'BRAND', brand_name, product_id, score FROM pj) WHERE scope_key IS NOT NULL),
 scopes AS (SELECT DISTINCT category_path AS request, 'CATEGORY' AS scope, category_path AS scope_key FROM cat WHERE category_path IS NOT NULL UNION ALL SELECT 'all', 'GLOBAL', 'all')"""
_TREND = f"""tr AS (SELECT product_id, (SELECT max(time_us) FROM ev) - time_us AS age, {_W} AS w FROM ev WHERE product_id IS NOT NULL AND time_us IS NOT NULL),
 tc AS (SELECT product_id, sum(CASE WHEN age < 172800000000 THEN w ELSE 0 END)::BIGINT AS recent, sum(w)::BIGINT AS base FROM tr WHERE age < 2592000000000 GROUP BY 1),
 trends AS (SELECT product_id, round(ln((recent / 2.0) / (base / 30.0 + 5)), 4)::DOUBLE AS trend FROM tc WHERE recent >= 20 AND (recent / 2.0) / (base / 30.0 + 5) > 1)"""
_PROFILE = f"""ir AS (SELECT subject, product_id, {_EW}::DOUBLE AS w, (SELECT max(time_us) FROM ev) - time_us AS age FROM ev WHERE kind IN ({_KINDS}) AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL),
 jf AS (SELECT subject, product_id, sum(w * CASE WHEN pow(0.5, age / 1209600000000.0) < 0.01 THEN 0 ELSE pow(0.5, age / 1209600000000.0) END) AS w FROM ir GROUP BY ALL), jj AS (SELECT jf.*, brand_name, category_path FROM jf LEFT JOIN cat USING (product_id)),
 js AS (SELECT subject, dimension, key, greatest(sum(w), 0) AS w FROM (SELECT subject, 'PRODUCT' AS dimension, product_id AS key, w FROM jj UNION ALL SELECT subject, 'BRAND', brand_name, w FROM jj UNION ALL SELECT subject, 'CATEGORY', category_path, w FROM jj) WHERE key IS NOT NULL GROUP BY ALL HAVING greatest(sum(w), 0) > 1e-9),
 prof AS (SELECT subject, dimension, key, round(w / max(w) OVER (PARTITION BY subject, dimension), 4)::DOUBLE AS weight FROM js)"""
#: Of each generator the tables it needs and its candidates.
_GEN = {
    "SIMILAR_PRODUCTS": ([_SIMREL], f"""SELECT request, similar_id AS product_id, 'SIMILARITY' AS source, score AS strength, score AS similarity, 0.0::DOUBLE AS affinity FROM (SELECT request, similar_id, similar_id AS product_id, score FROM seeds JOIN sim ON product_id = request) QUALIFY {_PICK('score', 120)}
  UNION ALL SELECT request, product_id, 'SIMILARITY', 0.4, 0.4, 0.0 FROM (SELECT s.request, b.product_id, coalesce(b.popularity, -1) AS pop FROM (SELECT request FROM seeds ANTI JOIN sim ON sim.product_id = request) s JOIN cat a ON a.product_id = s.request JOIN cat b ON a.category_path = b.category_path AND b.is_searchable AND b.product_id <> a.product_id) QUALIFY {_PICK('pop', 120)}"""),
    "CUSTOMER_ALSO_VIEWED": ([_VIEWREL], f"SELECT request, product_id, 'CO_VIEW' AS source, round(least(1, ln(1 + lift) / ln(21)), 6)::DOUBLE AS strength, 0.0::DOUBLE AS similarity, least(1, confidence)::DOUBLE AS affinity FROM (SELECT request, companion AS product_id, lift, confidence FROM seeds JOIN viewrel ON item = request) WHERE lift > 1.05 QUALIFY {_PICK('lift', 120)}"),
    "CUSTOMER_ALSO_BOUGHT": ([_BUYREL], f"SELECT request, product_id, 'CO_PURCHASE' AS source, round(least(1, ln(1 + lift) / ln(21)), 6)::DOUBLE AS strength, 0.0::DOUBLE AS similarity, least(1, confidence)::DOUBLE AS affinity FROM (SELECT request, companion AS product_id, lift, confidence FROM seeds JOIN buyrel ON item = request) WHERE lift > 1.05 QUALIFY {_PICK('lift', 120)}"),
    "CROSS_SELL": ([_BUYREL], f"SELECT request, product_id, 'CO_PURCHASE' AS source, round(least(1, ln(1 + lift) / ln(21)), 6)::DOUBLE AS strength, 0.0::DOUBLE AS similarity, least(1, confidence)::DOUBLE AS affinity FROM (SELECT request, companion AS product_id, lift, confidence FROM seeds JOIN buyrel ON item = request JOIN cat x ON x.product_id = item JOIN cat y ON y.product_id = companion WHERE x.category_path IS DISTINCT FROM y.category_path) WHERE lift > 1.05 QUALIFY {_PICK('lift', 120)}"),
    "UPSELL": ([_SIMREL], f"SELECT request, product_id, 'SIMILARITY' AS source, score AS strength, score AS similarity, 0.0::DOUBLE AS affinity FROM (SELECT request, b.product_id, score FROM seeds JOIN sim ON sim.product_id = request JOIN cat a ON a.product_id = request JOIN cat b ON b.product_id = similar_id WHERE score >= 0.45 AND a.category_path = b.category_path AND a.price_paise > 0 AND b.price_paise::DOUBLE / a.price_paise BETWEEN 1.1::DOUBLE AND 1.8::DOUBLE AND b.is_searchable AND coalesce(CASE WHEN isnan(b.rating_average) THEN NULL ELSE b.rating_average END >= 3.5, true)) QUALIFY {_PICK('score', 120)}"),
    "CART_RECOMMENDATIONS": ([_BUYREL, "carts AS (SELECT DISTINCT subject AS request, product_id AS item FROM ev WHERE kind = 'ADD_TO_CART' AND subject IS NOT NULL AND product_id IS NOT NULL)"], f"""SELECT request, product_id, 'CART_AFFINITY' AS source, round(least(1, ln(1 + lift) / ln(31)), 6)::DOUBLE AS strength, 0.0::DOUBLE AS similarity, round(least(1, lift / 10), 6)::DOUBLE AS affinity FROM (SELECT f.request, f.product_id, lift FROM (SELECT request, companion AS product_id, sum(lift::DECIMAL(18, 6))::DOUBLE AS lift FROM carts JOIN buyrel USING (item) WHERE lift > 1.05 GROUP BY ALL) f ANTI JOIN carts c ON c.request = f.request AND c.item = f.product_id) QUALIFY {_PICK('lift', 24)}"""),
    "TRENDING_PRODUCTS": ([_POPS, _TREND], f"SELECT request, product_id, 'TRENDING' AS source, round(least(1, round(trend * 0.75 + score * 0.25, 4) / 5), 6)::DOUBLE AS strength, 0.0::DOUBLE AS similarity, 0.0::DOUBLE AS affinity FROM (SELECT request, product_id, score, trend FROM scopes JOIN pops USING (scope, scope_key) JOIN trends USING (product_id)) WHERE trend > 0 QUALIFY {_PICK('trend', 120)}"),
    "POPULAR_IN_CATEGORY": ([_POPS], f"SELECT request, product_id, 'POPULARITY' AS source, strength, 0.0::DOUBLE AS similarity, 0.0::DOUBLE AS affinity FROM (SELECT request, product_id, round(CASE WHEN max(score) OVER (PARTITION BY request) > 0 THEN score / max(score) OVER (PARTITION BY request) ELSE 0 END, 6)::DOUBLE AS strength, rank FROM scopes JOIN pops USING (scope, scope_key)) WHERE rank <= 120"),
    "RECENTLY_VIEWED": (["seen AS (SELECT subject AS request, product_id, row_number() OVER (PARTITION BY subject ORDER BY max(time_us) DESC, product_id) AS rank FROM ev WHERE kind = 'PRODUCT_VIEW' AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 12)"], "SELECT request, product_id, 'RECENTLY_VIEWED' AS source, round(1 - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY request), 6)::DOUBLE AS strength, 0.0::DOUBLE AS similarity, 0.0::DOUBLE AS affinity FROM seen"),
    "PERSONALIZED_FOR_YOU": ([_PROFILE, """tops AS (SELECT subject AS request, dimension, key, row_number() OVER (PARTITION BY subject, dimension ORDER BY weight DESC, key) AS place FROM prof WHERE dimension IN ('CATEGORY', 'BRAND') AND weight > 0 QUALIFY place <= 6),
 worths AS (SELECT request, dimension, key, 1 - (place - 1)::DOUBLE / count(*) OVER (PARTITION BY request, dimension) AS worth FROM tops),
 keyed AS (SELECT product_id, 'CATEGORY' AS dimension, category_path AS key, coalesce(popularity, 0) AS pop FROM cat WHERE is_searchable UNION ALL SELECT product_id, 'BRAND', brand_name, coalesce(popularity, 0) FROM cat WHERE is_searchable)"""],
     f"SELECT request, product_id, 'INTEREST' AS source, round(least(1, worth), 6)::DOUBLE AS strength, 0.0::DOUBLE AS similarity, 0.0::DOUBLE AS affinity FROM (SELECT request, product_id, max(worth) AS worth, max(pop) AS pop FROM worths JOIN keyed USING (dimension, key) GROUP BY 1, 2) QUALIFY {_PICK('pop', 24)}"),
    "ANONYMOUS_RECOMMENDATIONS": (["""cs AS (SELECT product_id, category_path, round(least(1, greatest(0, 0.5 * CASE WHEN NOT isnan(rating_average) AND rating_count >= 5 THEN rating_average / 5 * (rating_count::DOUBLE / (rating_count + 10)) ELSE 0 END + 0.3 * greatest(0, 1 - greatest(0, epoch_us((SELECT max(indexed_at) FROM cat)) - epoch_us(indexed_at)) / 1209600000000.0))), 4)::DOUBLE AS strength FROM (SELECT * FROM cat WHERE is_searchable ORDER BY popularity DESC NULLS LAST, product_id LIMIT 48)),
 cf AS (SELECT * FROM (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY coalesce(category_path, '') ORDER BY strength DESC, product_id) <= 3) ORDER BY strength DESC, product_id LIMIT 24)"""], "SELECT 'anonymous' AS request, product_id, CASE WHEN strength > 0.6 THEN 'NEW_ARRIVAL' ELSE 'POPULARITY' END AS source, strength, 0.0::DOUBLE AS similarity, 0.0::DOUBLE AS affinity FROM cf"),
}
_ONCE = list(dict.fromkeys(part for k in SCORED for part in _GEN[k][0]))
_WEIGHT = lambda part: "CASE kind " + " ".join(f"WHEN '{k}' THEN {N.weights_for(k)[part]}" for k in SCORED) + " END"
_PROF = lambda d: f"coalesce((SELECT weight FROM prof p WHERE p.subject = u.request AND p.dimension = '{d}' AND p.key = u.k_{d}), 0)"
_SCORES = f"""{_BASE}, {', '.join(_ONCE)}, gens AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, * FROM ({_GEN[k][1]})" for k in SCORED)}),
 lp AS (SELECT product_id, ln(1 + sum({_W})) AS pop FROM ev WHERE product_id IS NOT NULL GROUP BY 1), tired AS (SELECT subject AS request, product_id FROM ev WHERE kind = 'PRODUCT_VIEW' AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us >= (SELECT max(time_us) FROM ev) - 2592000000000 GROUP BY 1, 2 HAVING count(*) >= 12),
 u AS (SELECT g.*, c.name, c.slug, c.seller_id, c.brand_name, c.category_path, c.price_paise, CASE WHEN isnan(c.rating_average) THEN NULL ELSE c.rating_average END AS stars, c.rating_count, c.indexed_at, coalesce(c.status = 'ACTIVE', false) AS in_stock, coalesce(pop / (SELECT max(pop) FROM lp), 0) AS pop, 0.7 * coalesce((c.category_path = z.category_path)::INT, 0) + 0.3 * coalesce((c.brand_name = z.brand_name)::INT, 0) AS ctx, tired.request IS NOT NULL AS worn
  FROM gens g JOIN cat c ON c.product_id = g.product_id AND c.is_searchable LEFT JOIN cat z ON z.product_id = g.request LEFT JOIN lp ON lp.product_id = g.product_id LEFT JOIN tired ON tired.request = g.request AND tired.product_id = g.product_id),
 un AS (SELECT u.*, (coalesce(pa.weight, 0) * 1.0 + coalesce(pb.weight, 0) * 0.7 + coalesce(pd.weight, 0) * 0.3) / 3.3 AS inter FROM u LEFT JOIN prof pa ON pa.subject = u.request AND pa.dimension = 'CATEGORY' AND pa.key = u.category_path LEFT JOIN prof pb ON pb.subject = u.request AND pb.dimension = 'BRAND' AND pb.key = u.brand_name LEFT JOIN prof pd ON pd.subject = u.request AND pd.dimension = 'PRODUCT' AND pd.key = u.product_id),
 pt AS (SELECT *, round((least(1, greatest(0, strength)) * {_WEIGHT('relevance')})::DECIMAL(28, 12), 6)::DOUBLE AS part_relevance, round((least(1, greatest(0, inter)) * {_WEIGHT('interest')})::DECIMAL(28, 12), 6)::DOUBLE AS part_interest, round((least(1, greatest(0, similarity)) * {_WEIGHT('similarity')})::DECIMAL(28, 12), 6)::DOUBLE AS part_similarity, round((least(1, greatest(0, pop)) * {_WEIGHT('popularity')})::DECIMAL(28, 12), 6)::DOUBLE AS part_popularity,
  round((CASE WHEN stars IS NULL OR coalesce(rating_count, 0) = 0 THEN 0.35 ELSE stars / 5 * (rating_count::DOUBLE / (rating_count + 10)) END * {_WEIGHT('quality')})::DECIMAL(28, 12), 6)::DOUBLE AS part_quality, round((greatest(0, 1 - (epoch_us((SELECT max(indexed_at) FROM cat)) - epoch_us(indexed_at)) / 7776000000000.0) * {_WEIGHT('freshness')})::DECIMAL(28, 12), 6)::DOUBLE AS part_freshness,
  round((least(1, greatest(0, affinity)) * {_WEIGHT('affinity')})::DECIMAL(28, 12), 6)::DOUBLE AS part_affinity, round((ctx * {_WEIGHT('context')})::DECIMAL(28, 12), 6)::DOUBLE AS part_context, 0.0::DOUBLE AS part_duplicate, CASE WHEN in_stock THEN 0.0 ELSE 60.0 END::DOUBLE AS part_out_of_stock, CASE WHEN worn THEN 12.0 ELSE 0.0 END::DOUBLE AS part_stale FROM un),
 sc AS (SELECT *, round({' + '.join(f'part_{n}' for n in N._PARTS)} - {' - '.join(f'part_{n}' for n in N._PENALTIES)}, 6)::DOUBLE AS score, CASE greatest({', '.join(f'part_{n}' for n in N._PARTS)}) {' '.join(f"WHEN part_{n} THEN '{n}'" for n in N._PARTS)} END AS dominant FROM pt)"""
_SIDE = lambda kind: f"SELECT DISTINCT subject AS request, product_id FROM ev WHERE kind = '{kind}' AND subject IS NOT NULL AND product_id IS NOT NULL"
_REASONS = f"""{_SCORES}, carted AS ({_SIDE('ADD_TO_CART')}), shown AS ({_SIDE('PRODUCT_CLICK')}), rejected AS ({_SIDE('NOT_INTERESTED')}),
 rs AS (SELECT sc.*, CASE WHEN r.request IS NOT NULL THEN 'NOT_INTERESTED' WHEN sc.product_id = sc.request THEN 'SELF_REFERENCE' WHEN coalesce(name, '') = '' OR coalesce(slug, '') = '' THEN 'NOT_PURCHASABLE' WHEN NOT in_stock THEN 'OUT_OF_STOCK' WHEN c.request IS NOT NULL THEN 'ALREADY_IN_CART' WHEN h.request IS NOT NULL THEN 'ALREADY_SHOWN' END AS first_reason,
  coalesce(category_path, '') || '|' || coalesce(brand_name, '') || '|' || trim(regexp_replace(regexp_replace(lower(name), '\\b(xs|s|m|l|xl|xxl|small|medium|large)\\b', '', 'g'), '\\s+', ' ', 'g')) AS same
  FROM sc LEFT JOIN rejected r ON r.request = sc.request AND r.product_id = sc.product_id LEFT JOIN carted c ON c.request = sc.request AND c.product_id = sc.product_id LEFT JOIN shown h ON h.request = sc.request AND h.product_id = sc.product_id),
 ex AS (SELECT *, coalesce(first_reason, CASE WHEN row_number() OVER (PARTITION BY kind, request, same, first_reason IS NULL ORDER BY score DESC, coalesce(stars, 0) DESC, price_paise, product_id) > 1 THEN 'DUPLICATE_VARIANT' END) AS reason FROM rs)"""

ORACLE = {f"candidates_{k.lower()}": f"{_BASE}, {', '.join(parts)} {sql}" for k, (parts, sql) in _GEN.items()} | {
    "recommendation_scores": f"{_SCORES} SELECT kind, request, product_id, {', '.join(f'part_{n}' for n in (*N._PARTS, *N._PENALTIES))}, score, dominant FROM sc",
    "recommendation_exclusions": f"{_REASONS} SELECT kind, coalesce(reason, 'KEPT') AS reason, count(*) AS candidates, count(DISTINCT request) AS requests FROM ex GROUP BY 1, 2",
    "recommendation_diverse": f"""{_REASONS}, rk AS (SELECT *, row_number() OVER (PARTITION BY kind, request ORDER BY score DESC, coalesce(stars, 0) DESC, price_paise, product_id) AS k FROM ex WHERE reason IS NULL),
 bd AS (SELECT unnest([{', '.join(f"'{k}'" for k in SCORED)}]) AS kind, unnest([{', '.join(str(N.BUDGETS[k][0]) for k in SCORED)}]) AS mb, unnest([{', '.join(str(N.BUDGETS[k][1]) for k in SCORED)}]) AS mc, unnest([{', '.join(str(N.BUDGETS[k][2]) for k in SCORED)}]) AS ms),
 wk AS (SELECT kind, request, 0::BIGINT AS k, NULL::VARCHAR AS product_id, 0.0::DOUBLE AS score, []::VARCHAR[] AS bs, []::VARCHAR[] AS cs, []::VARCHAR[] AS ss, false AS taken FROM (SELECT DISTINCT kind, request FROM rk)
  UNION ALL SELECT kind, request, k, product_id, score, CASE WHEN fits THEN bs || [brand_name] ELSE bs END, CASE WHEN fits THEN cs || [category_path] ELSE cs END, CASE WHEN fits THEN ss || [seller_id] ELSE ss END, fits FROM (
   SELECT r.kind, r.request, r.k, r.product_id, r.score, r.brand_name, r.category_path, r.seller_id, bs, cs, ss, (r.brand_name IS NULL OR len(list_filter(bs, lambda x: x = r.brand_name)) < mb) AND (r.category_path IS NULL OR len(list_filter(cs, lambda x: x = r.category_path)) < mc) AND (r.seller_id IS NULL OR len(list_filter(ss, lambda x: x = r.seller_id)) < ms) AS fits
   FROM wk w JOIN rk r ON r.kind = w.kind AND r.request = w.request AND r.k = w.k + 1 JOIN bd ON bd.kind = r.kind) z)
 SELECT kind, request, product_id, score, row_number() OVER (PARTITION BY kind, request ORDER BY taken DESC, k) AS final FROM wk WHERE k > 0 QUALIFY final <= 12""",
    "recommendation_lists": f"""{_REASONS}, rk AS (SELECT *, row_number() OVER (PARTITION BY kind, request ORDER BY score DESC, coalesce(stars, 0) DESC, price_paise, product_id) AS rank FROM ex WHERE reason IS NULL),
 ov AS (SELECT *, coalesce(seller_id IS NOT NULL AND row_number() OVER (PARTITION BY kind, request, seller_id ORDER BY rank) > 3, false) AS over_ FROM rk) SELECT kind, request, product_id, score, row_number() OVER (PARTITION BY kind, request ORDER BY over_, rank) AS final FROM ov QUALIFY final <= 8""",
}
