"""Queries of search and event analytics, with their SQL."""

from __future__ import annotations

from stallwright.operators import log_analytics as A
from stallwright.sources.domain import behaviour, query_logs, search_actions

QUERIES = {
    "search_overview": lambda s, d: A.search_overview(query_logs(s, d), search_actions(s, d)),
    "query_stats": lambda s, d: A.query_stats(query_logs(s, d), search_actions(s, d)),
    "popular_queries": lambda s, d: A.popular_queries(A.query_stats(query_logs(s, d), search_actions(s, d))),
    "low_click_queries": lambda s, d: A.low_click_queries(A.query_stats(query_logs(s, d), search_actions(s, d))),
    "zero_result_queries": lambda s, d: A.zero_result_queries(query_logs(s, d)),
    "rising_queries": lambda s, d: A.rising_queries(query_logs(s, d)),
    "click_positions": lambda s, d: A.click_positions(search_actions(s, d)),
    "search_daily_rollup": lambda s, d: A.daily_rollup(query_logs(s, d), search_actions(s, d)),
    "funnel_by_source": lambda s, d: A.funnel(behaviour(s, d), "source"),
    "funnel_by_placement": lambda s, d: A.funnel(behaviour(s, d), "placement"),
    "attribution_asof": lambda s, d: A.attribute_last_touch(behaviour(s, d), "PRODUCT_CLICK", "PURCHASE"),
    "over_exposed": lambda s, d: A.over_exposed(behaviour(s, d)),
    "recently_viewed": lambda s, d: A.recently_viewed(behaviour(s, d)),
    "search_history": lambda s, d: A.search_history(query_logs(s, d)),
}

KEY = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '')".format
KIND = f"upper(translate({KEY('{0}')}, ' -', '__'))".format
LOGS = f"""logs AS (SELECT {KEY('id')} AS id, created_at, {KEY('normalized_query')} AS query, result_count, took_ms, {KEY('session_hash')} AS session, {KEY('corrected_query')} AS corrected, was_corrected, {KEY('ranking_version')} AS ranking_version, {KEY('experiment_variant')} AS experiment_variant, {KEY('filter_signature')} AS filters FROM search_query_logs
  WHERE {KEY('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {KEY('id')} ORDER BY created_at NULLS FIRST, query NULLS FIRST, result_count NULLS FIRST, took_ms NULLS FIRST, session NULLS FIRST, corrected NULLS FIRST, was_corrected NULLS FIRST, ranking_version NULLS FIRST, experiment_variant NULLS FIRST, filters NULLS FIRST) = 1),
 acts AS (SELECT {KEY('id')} AS id, created_at, {KEY('search_log_id')} AS log_id, {KEY('product_id')} AS product_id, position, {KIND('event_type')} AS kind, {KEY('session_hash')} AS session FROM search_events
  WHERE {KEY('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {KEY('id')} ORDER BY created_at NULLS FIRST, log_id NULLS FIRST, product_id NULLS FIRST, position NULLS FIRST, kind NULLS FIRST, session NULLS FIRST) = 1)"""
EVENTS = f"""ev AS (SELECT *, coalesce(user_id, session_id) AS subject FROM (
 SELECT {KEY('id')} AS event_id, min(epoch_us(created_at)) AS time_us, min({KEY('user_id')}) AS user_id, min({KEY('session_id')}) AS session_id, min({KEY('product_id')}) AS product_id,
  min({KEY('source')}) AS source, min({KIND('event_type')}) AS kind, min({KIND('recommendation_type')}) AS placement FROM analytics_events GROUP BY 1, CASE WHEN {KEY('id')} IS NULL THEN uuid() END))"""
STATS = f"""WITH {LOGS}, clicks AS (SELECT log_id, count(*) AS clicks FROM acts WHERE kind = 'CLICK' AND log_id IS NOT NULL GROUP BY 1),
 stats AS (SELECT query, count(*) AS searches, count(*) FILTER (result_count = 0) AS zero_results, round(avg(result_count), 4) AS avg_results, coalesce(sum(clicks), 0)::BIGINT AS clicks, round(count(clicks)::DOUBLE / count(*), 6) AS clicked_share
  FROM logs LEFT JOIN clicks ON id = log_id WHERE query IS NOT NULL GROUP BY 1)
"""
_FUNNEL = """WITH {0} SELECT {1}, count(*) AS events, count(*) FILTER (kind = 'PRODUCT_VIEW') AS views, count(*) FILTER (kind = 'PRODUCT_CLICK') AS clicks, count(*) FILTER (kind = 'ADD_TO_CART') AS carts, count(*) FILTER (kind = 'PURCHASE') AS purchases, count(DISTINCT subject) AS subjects,
 round(count(*) FILTER (kind = 'ADD_TO_CART')::DOUBLE / nullif(count(*) FILTER (kind = 'PRODUCT_VIEW'), 0), 6) AS cart_rate, round(count(*) FILTER (kind = 'PURCHASE')::DOUBLE / nullif(count(*) FILTER (kind = 'PRODUCT_VIEW'), 0), 6) AS purchase_rate
 FROM ev WHERE {1} IS NOT NULL GROUP BY 1"""

ORACLE = {
    "search_overview": f"""WITH {LOGS}, s AS (SELECT DISTINCT session FROM logs WHERE session IS NOT NULL), c AS (SELECT DISTINCT session FROM acts WHERE kind = 'CLICK')
 SELECT count(*) AS searches, count(DISTINCT query) AS queries, count(*) FILTER (result_count = 0) AS zero_results, count(*) FILTER (was_corrected) AS corrected, round(avg(took_ms), 3) AS avg_ms,
 round(quantile_cont(took_ms, 0.5), 3) AS p50_ms, round(quantile_cont(took_ms, 0.95), 3) AS p95_ms, round(quantile_cont(took_ms, 0.99), 3) AS p99_ms, (SELECT count(*) FROM s) AS sessions,
 round((SELECT count(*) FROM s SEMI JOIN c USING (session))::DOUBLE / (SELECT count(*) FROM s), 6) AS click_rate FROM logs""",
    "query_stats": STATS + "SELECT * FROM stats",
    "popular_queries": STATS + "SELECT * FROM stats ORDER BY searches DESC, query LIMIT 20",
    "low_click_queries": STATS + "SELECT * FROM stats WHERE searches >= 5 ORDER BY clicked_share, searches DESC, query LIMIT 50",
    "zero_result_queries": f"WITH {LOGS} SELECT query, count(*) AS searches, max(created_at) AS last_seen, max(corrected) AS corrected FROM logs WHERE result_count = 0 AND query IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "rising_queries": f"""WITH {LOGS}, a AS (SELECT query, epoch_us((SELECT max(created_at) FROM logs)) - epoch_us(created_at) AS age FROM logs WHERE query IS NOT NULL),
 c AS (SELECT query, count(*) FILTER (age < 604800000000) AS recent, count(*) FILTER (age >= 604800000000) AS earlier FROM a WHERE age < 1209600000000 GROUP BY 1)
 SELECT *, round(CASE WHEN earlier = 0 THEN recent::DOUBLE ELSE (recent - earlier)::DOUBLE / earlier END, 6) AS growth FROM c WHERE recent >= 3 ORDER BY growth DESC, recent DESC, query LIMIT 50""",
    "click_positions": f"WITH {LOGS} SELECT position, count(*) AS clicks, count(DISTINCT product_id) AS products FROM acts WHERE kind = 'CLICK' AND position IS NOT NULL GROUP BY 1",
    "search_daily_rollup": f"""WITH {LOGS}, c AS (SELECT DISTINCT log_id FROM acts WHERE kind = 'CLICK') SELECT created_at::DATE AS day, ranking_version, coalesce(experiment_variant, 'none') AS variant, count(*) AS searches, count(log_id) AS clicked,
 count(*) FILTER (result_count = 0) AS zero_results, round(count(log_id)::DOUBLE / count(*), 6) AS ctr FROM logs LEFT JOIN c ON id = log_id GROUP BY 1, 2, 3""",
    "funnel_by_source": _FUNNEL.format(EVENTS, "source"),
    "funnel_by_placement": _FUNNEL.format(EVENTS, "placement"),
    "attribution_asof": f"""WITH {EVENTS}, t AS (SELECT subject, product_id, time_us FROM ev WHERE kind = 'PRODUCT_CLICK' AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL)
 SELECT o.event_id, o.subject, o.product_id, o.time_us, CASE WHEN o.time_us - t.time_us <= 604800000000 THEN t.time_us END AS touch_us FROM (SELECT * FROM ev WHERE kind = 'PURCHASE' AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL) o
 ASOF LEFT JOIN t ON o.subject = t.subject AND o.product_id = t.product_id AND o.time_us >= t.time_us""",
    "over_exposed": f"WITH {EVENTS} SELECT subject, product_id, count(*) AS shown FROM ev WHERE kind = 'PRODUCT_VIEW' AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us >= (SELECT max(time_us) FROM ev) - 2592000000000 GROUP BY 1, 2 HAVING count(*) >= 12",
    "recently_viewed": f"""WITH {EVENTS}, s AS (SELECT subject, product_id, count(*) AS views, max(time_us) AS last_us FROM ev WHERE kind = 'PRODUCT_VIEW' AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY subject ORDER BY last_us DESC, product_id) AS rank FROM s QUALIFY rank <= 12""",
    "search_history": f"""WITH {LOGS}, r AS (SELECT session, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))), ' ') AS canonical, query, created_at FROM logs WHERE session IS NOT NULL AND query IS NOT NULL),
 e AS (SELECT session, canonical, count(*) AS times, max(struct_pack(t := created_at, q := query)) AS last FROM r WHERE canonical <> '' GROUP BY 1, 2)
 SELECT session, canonical, last.q AS query, times, last.t AS last_seen, row_number() OVER (PARTITION BY session ORDER BY last.t DESC, canonical) AS rank FROM e QUALIFY rank <= 20""",
}
