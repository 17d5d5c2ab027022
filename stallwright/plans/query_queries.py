"""Queries of query understanding, scoring, autocompletion and catalog diffs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions import scoring as C
from stallwright.functions.keys import norm_key
from stallwright.operators import recommend as R
from stallwright.operators import search as S
from stallwright.operators import understand as U
from stallwright.operators.attributes import filled_cells, wide_attributes
from stallwright.operators.hierarchy import resolve_hierarchy
from stallwright.plans.core_queries import _RESOLVED, _TREE
from stallwright.plans.log_queries import EVENTS, KEY
from stallwright.plans.recommend_queries import _COVIEW_ALL, _W, co_view
from stallwright.plans.search_queries import _CODE, _ENTRIES, _MEANS, _NAMED, _SUGGEST, CAT, LOGS, PRICED, SAID, TOK, _queries
from stallwright.sources.domain import behaviour, catalog, query_logs
from stallwright.sources.tables import table


def query_price_limits(s, d):
    least, most = U.price_limits(F.col("query"))
    return _queries(s, d).select("query", least.alias("least"), most.alias("most")).filter("least IS NOT NULL OR most IS NOT NULL")


def query_words(s, d):
    return _queries(s, d).select("query", F.array_join(U.search_words(F.col("query")), " ").alias("words"))


def _lexicon(s, d):
    return U.lexicon(catalog(s, d), table(s, d, "attribute_options"))


def _entities(s, d):
    return U.extract_entities(_queries(s, d), _lexicon(s, d))


def autocomplete(s, d):
    """The eight heaviest suggestions for the first three letters of every query."""
    prefixes = _queries(s, d).select(F.substring("query", 1, 3).alias("prefix")).filter("length(prefix) = 3").distinct()
    found = S.suggestions(catalog(s, d), query_logs(s, d)).withColumn("prefix", F.substring("term", 1, 3)).join(prefixes, "prefix")
    rank = F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("weight"), "term"))
    return found.withColumn("rank", rank).filter("rank <= 8").select("prefix", "term", "kind", "weight", "rank")


def product_scores(s, d):
    items = catalog(s, d)
    now = items.agg(F.max("indexed_at").alias("now"))
    age = F.unix_micros("now") - F.unix_micros("indexed_at")
    rows = items.crossJoin(now)  # now is one row
    price, before, ratings = F.col("price_paise"), F.col("compare_at_paise"), F.col("rating_count")
    return rows.select("product_id", *(F.round(x, 6).alias(n) for n, x in (("freshness", C.freshness(age)), ("quality", C.quality(F.col("rating_average"), ratings)), ("review_volume", C.review_volume(ratings)), ("discount_depth", C.discount_depth(price, before)), ("affinity", C.price_affinity(price, F.lit(50_000.0), F.lit(500_000.0))))), C.price_band(price).alias("band"))


def recommendations(s, d):
    """For each product what is viewed with it, scored by relevance, popularity, quality, freshness and context."""
    items = catalog(s, d)
    top = R.product_counters(behaviour(s, d)).withColumn("pop", F.log1p(R.activity()))
    best, now = top.agg(F.max("pop").alias("best")), items.agg(F.max("indexed_at").alias("now"))
    side = items.select(F.col("product_id").alias("companion"), "brand_name", "category_path", "rating_average", "rating_count", "indexed_at").join(top.select(F.col("product_id").alias("companion"), "pop"), "companion", "left")
    seeds = items.select(F.col("product_id").alias("item"), F.col("brand_name").alias("b0"), F.col("category_path").alias("c0"))
    rows = co_view(s, d, None).join(side, "companion").join(seeds, "item").crossJoin(best).crossJoin(now)  # one row each
    context = 0.7 * F.coalesce((F.col("category_path") == F.col("c0")).cast("int"), F.lit(0)) + 0.3 * F.coalesce((F.col("brand_name") == F.col("b0")).cast("int"), F.lit(0))
    score = C.recommendation_score(relevance=F.log1p("lift") / F.log(F.lit(21.0)), popularity=F.col("pop") / F.col("best"), quality=C.quality(F.col("rating_average"), F.col("rating_count")), freshness=C.freshness(F.unix_micros("now") - F.unix_micros("indexed_at")), context=context)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "companion"))
    return rows.select("item", "companion", score.alias("score")).withColumn("rank", rank).filter("rank <= 12")


def stale_categories(s, d):
    """Categories whose stored path or depth differs from what their parents say."""
    stored = table(s, d, "categories").select(norm_key("slug").alias("slug"), norm_key("path").alias("stored_path"), F.col("depth").cast("bigint").alias("stored_depth")).filter("slug IS NOT NULL").distinct()
    tree = resolve_hierarchy(table(s, d, "categories")).filter("depth >= 0").select("slug", "path", "depth")
    return stored.join(tree, "slug").filter("NOT (stored_path <=> path AND stored_depth <=> depth)")


def duplicate_combinations(s, d):
    """Variants of one product that can't be told apart by colour and size."""
    axes = table(s, d, "attribute_definitions").filter("code IN ('color', 'size')").select(norm_key("id").alias("definition_id"))
    cells = filled_cells(wide_attributes(table(s, d, "variant_attributes"), table(s, d, "attribute_definitions"), table(s, d, "attribute_options"))).join(F.broadcast(axes), "definition_id", "left_semi")  # definitions are bounded
    combos = cells.groupBy("variant_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "definition_id", "value"))), "|").alias("combo"))
    owners = table(s, d, "variant_attributes").select(norm_key("variant_id").alias("variant_id"), norm_key("product_id").alias("product_id")).filter("variant_id IS NOT NULL AND product_id IS NOT NULL").distinct()
    return owners.join(combos, "variant_id").groupBy("product_id", "combo").agg(F.count("*").alias("variants"), F.min("variant_id").alias("first_variant")).filter("variants > 1")


def merged_sessions(s, d):
    """Interest of anonymous sessions, at 0.7, added to the user that the session turned out to be."""
    events = behaviour(s, d).filter("session_id IS NOT NULL AND product_id IS NOT NULL")
    weight = F.create_map(*(x for k, w in R.EVENT_WEIGHTS.items() for x in (F.lit(k), F.lit(w))))[F.col("kind")]
    owners = events.filter("user_id IS NOT NULL").groupBy("session_id").agg(F.min("user_id").alias("owner"))
    signals = events.withColumn("w", weight).filter("w IS NOT NULL").groupBy("session_id", "user_id", "product_id").agg(F.sum("w").alias("w"))
    own = signals.filter("user_id IS NOT NULL").select("user_id", "product_id", "w")
    lent = signals.filter("user_id IS NULL").join(owners, "session_id").select(F.col("owner").alias("user_id"), "product_id", (F.col("w") * 0.7).alias("w"))
    return own.unionByName(lent).groupBy("user_id", "product_id").agg(F.round(F.greatest(F.sum("w"), F.lit(0.0)), 4).alias("weight"))


QUERIES = {
    "query_price_limits": query_price_limits,
    "query_words": query_words,
    "synonym_expand": lambda s, d: U.expand_synonyms(_queries(s, d), U.synonym_table(s)),
    "lexicon": _lexicon,
    "query_entities": _entities,
    "query_intents": lambda s, d: U.intents(_queries(s, d), _entities(s, d)),
    "autocomplete": autocomplete,
    "product_scores": product_scores,
    "recommendations": recommendations,
    "stale_categories": stale_categories,
    "duplicate_combinations": duplicate_combinations,
    "merged_sessions": merged_sessions,
}

_EW = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in R.EVENT_WEIGHTS.items()) + " END"
_SPANS = "spans AS (SELECT query, array_to_string(words[s:s + z - 1], ' ') AS phrase FROM (SELECT query, words, unnest(range(1, len(words) + 1)) AS s FROM said) x, range(1, 5) r(z) WHERE s + z - 1 <= len(words))"
ORACLE = {
    "query_price_limits": f"WITH {LOGS}, {PRICED} SELECT * FROM priced WHERE least IS NOT NULL OR most IS NOT NULL",
    "query_words": f"WITH {LOGS}, {SAID} SELECT query, array_to_string(words, ' ') AS words FROM said",
    "synonym_expand": f"WITH {LOGS}, {SAID}, {_SPANS} SELECT DISTINCT query, phrase, m.means AS means FROM spans JOIN (SELECT unnest({_MEANS}) AS m) ON phrase = m.term",
    "query_entities": f"WITH RECURSIVE {LOGS}, {CAT}, {SAID}, {_ENTRIES}, phrased AS (SELECT * FROM said), {_NAMED} SELECT query, phrase, start, size, kind, value, confidence FROM named",
    "query_intents": f"""WITH RECURSIVE {LOGS}, {CAT}, {SAID}, {_ENTRIES}, phrased AS (SELECT * FROM said), {_NAMED}, k AS (SELECT query, count(*) FILTER (kind = 'BRAND') AS b, count(*) FILTER (kind = 'CATEGORY') AS c FROM named GROUP BY 1)
 SELECT query, CASE WHEN {_CODE} THEN 'NAVIGATIONAL' WHEN len(words) = 0 THEN 'BROAD' WHEN b > 0 AND c = 0 AND len(words) <= 2 THEN 'BRAND' WHEN c > 0 THEN 'CATEGORY' WHEN b > 0 THEN 'BRAND' WHEN len(words) >= 3 THEN 'PRODUCT' ELSE 'BROAD' END AS intent FROM said LEFT JOIN k USING (query)""",
    "lexicon": f"""WITH {CAT}, h AS (SELECT value, count(*) AS products FROM (SELECT unnest(list_distinct({TOK('attribute_text')})) AS value FROM cat) GROUP BY 1),
 e AS (SELECT 'BRAND' AS kind, brand_name AS value, count(*) AS products FROM cat GROUP BY 2 UNION ALL SELECT 'CATEGORY', split_part(category_path, '/', -1), count(*) FROM cat GROUP BY 2
  UNION ALL SELECT 'ATTRIBUTE', o.value, coalesce(products, 0) FROM (SELECT DISTINCT lower(trim(slug)) AS value FROM attribute_options) o LEFT JOIN h ON h.value = o.value),
 t AS (SELECT array_to_string({TOK("regexp_replace(value, '-[0-9]+$', '')")}, ' ') AS term, kind, value, max(products) AS products FROM e WHERE value IS NOT NULL GROUP BY ALL)
 SELECT *, count(*) OVER (PARTITION BY term) AS ambiguity FROM t WHERE term <> ''""",
    "autocomplete": f"""WITH p AS (SELECT DISTINCT left({KEY('normalized_query')}, 3) AS prefix FROM search_query_logs WHERE length({KEY('normalized_query')}) >= 3), sg AS ({_SUGGEST})
 SELECT prefix, term, kind, weight, row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, term) AS rank FROM p JOIN sg ON left(term, 3) = prefix QUALIFY rank <= 8""",
    "product_scores": f"""WITH {CAT}, a AS (SELECT *, (epoch_us((SELECT max(indexed_at) FROM cat)) - epoch_us(indexed_at)) / 7776000000000.0 AS age, CASE WHEN isnan(rating_average) THEN NULL ELSE rating_average END AS r FROM cat)
 SELECT product_id, round(greatest(0, 1 - age), 6) AS freshness, round(CASE WHEN r IS NULL OR coalesce(rating_count, 0) = 0 THEN 0.35 ELSE r / 5 * (rating_count::DOUBLE / (rating_count + 10)) END, 6) AS quality,
 round(least(10.0::DOUBLE, 3.33::DOUBLE * log10(coalesce(rating_count, 0) + 1)), 6) AS review_volume, round(CASE WHEN compare_at_paise > 0 AND price_paise < compare_at_paise THEN least(0.9::DOUBLE, (compare_at_paise - price_paise)::DOUBLE / compare_at_paise) ELSE 0 END, 6) AS discount_depth,
 round(CASE WHEN price_paise BETWEEN 50000 AND 500000 THEN 1 WHEN price_paise < 50000 THEN greatest(0, 1 - 0.6::DOUBLE * (50000 - price_paise)::DOUBLE / 50000) ELSE greatest(0, 1 - (price_paise - 500000)::DOUBLE / 500000) END, 6) AS affinity,
 (10 ** (length(price_paise::VARCHAR) - 1))::BIGINT || '-' || (10 ** length(price_paise::VARCHAR))::BIGINT AS band FROM a""",
    "recommendations": f"""WITH {_COVIEW_ALL}, {CAT}, pop AS (SELECT product_id, ln(1 + sum({_W})) AS pop FROM ev WHERE product_id IS NOT NULL GROUP BY 1), q AS (SELECT *, CASE WHEN isnan(rating_average) THEN NULL ELSE rating_average END AS r FROM cat),
 s AS (SELECT item, companion, round(100 * least(1, ln(1 + lift) / ln(21)) + 18 * coalesce(pop / (SELECT max(pop) FROM pop), 0) + 14 * CASE WHEN b.r IS NULL OR coalesce(b.rating_count, 0) = 0 THEN 0.35 ELSE b.r / 5 * (b.rating_count::DOUBLE / (b.rating_count + 10)) END
  + 8 * greatest(0, 1 - (epoch_us((SELECT max(indexed_at) FROM cat)) - epoch_us(b.indexed_at)) / 7776000000000.0) + 35 * (0.7 * coalesce((a.category_path = b.category_path)::INT, 0) + 0.3 * coalesce((a.brand_name = b.brand_name)::INT, 0)), 4) AS score
  FROM rel JOIN q a ON a.product_id = item JOIN q b ON b.product_id = companion LEFT JOIN pop ON pop.product_id = companion)
 SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, companion) AS rank FROM s QUALIFY rank <= 12""",
    "stale_categories": _TREE + f", st AS (SELECT DISTINCT {KEY('slug')} AS slug, {KEY('path')} AS stored_path, depth::BIGINT AS stored_depth FROM categories) SELECT st.*, t.path, t.depth FROM st JOIN t ON st.slug = t.slug WHERE stored_path IS DISTINCT FROM t.path OR stored_depth IS DISTINCT FROM t.depth",
    "duplicate_combinations": _RESOLVED + f""", combos AS (SELECT variant_id, array_to_string(list_sort(list(definition_id || ':' || value)), '|') AS combo FROM cells WHERE value IS NOT NULL AND definition_id IN (SELECT {KEY('id')} FROM attribute_definitions WHERE code IN ('color', 'size')) GROUP BY 1),
 owners AS (SELECT DISTINCT {KEY('variant_id')} AS variant_id, {KEY('product_id')} AS product_id FROM variant_attributes WHERE {KEY('variant_id')} IS NOT NULL AND {KEY('product_id')} IS NOT NULL)
 SELECT product_id, combo, count(*) AS variants, min(variant_id) AS first_variant FROM owners JOIN combos USING (variant_id) GROUP BY 1, 2 HAVING count(*) > 1""",
    "merged_sessions": f"""WITH {EVENTS}, e AS (SELECT *, {_EW}::DOUBLE AS w FROM ev WHERE session_id IS NOT NULL AND product_id IS NOT NULL), o AS (SELECT session_id, min(user_id) AS owner FROM e WHERE user_id IS NOT NULL GROUP BY 1)
 SELECT user_id, product_id, round(greatest(sum(w), 0), 4) AS weight FROM (SELECT user_id, product_id, w FROM e WHERE user_id IS NOT NULL AND w IS NOT NULL UNION ALL SELECT owner, product_id, w * 0.7 FROM e JOIN o USING (session_id) WHERE user_id IS NULL AND w IS NOT NULL) GROUP BY 1, 2""",
}
