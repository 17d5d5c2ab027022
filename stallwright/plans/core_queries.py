"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.operators.attributes import attribute_failures, filled_cells, wide_attributes
from stallwright.operators.features import entity_features
from stallwright.operators.hierarchy import Hierarchy, resolve_hierarchy
from stallwright.operators.references import ReferenceState, distinct_rows, existence_deltas, failed_references, orphan_report, reference_deltas
from stallwright.operators.sessions import shopper_visits
from stallwright.sources.tables import table
from stallwright.storage import materialize

ENTITIES = {"user": "user_id", "product": "product_id"}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shopper_visits(table(spark, d, "analytics_events")).select("subject", "started_us", "ended_us")


def p3_visits(spark: SparkSession, d: str) -> DataFrame:
    return shopper_visits(table(spark, d, "analytics_events")).select("subject", "started_us", "ended_us", "duration_us", "events")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_features(table(spark, d, "analytics_events"), ENTITIES, "long", 3).select("entity", "entity_id", "event_type")


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    return entity_features(table(spark, d, "analytics_events"), ENTITIES, "long")


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    """The wide table; the SQL check takes the columns of four types, the query makes all."""
    wide = entity_features(table(spark, d, "analytics_events"), ENTITIES)
    held = [c for t in ("PRODUCT_VIEW", "PRODUCT_CLICK", "SEARCH", "ADD_TO_CART") for c in (f"n_{t}", f"last_us_{t}", f"total_{t}")]
    return wide.select("entity", "entity_id", "n_events", "last_us", *held)


def _failed(spark: SparkSession, d: str) -> DataFrame:
    fields = {"search_log_id": (table(spark, d, "search_query_logs"), "id", "created_at"), "product_id": (table(spark, d, "product_search_index"), "product_id", None)}
    return failed_references(table(spark, d, "search_events"), "id", "created_at", fields)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _failed(spark, d).select("event_id", "ref_field", "state")


#: Where the incremental query cuts the tables into a first load and later arrivals, and before when logs are deleted afterwards.
CUT, KEPT_FROM = "2025-11-15", "2025-11-06"


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    """``(ref_field, key, state, refs)`` of the keys that fail after a first load, later arrivals and the deletion of old logs, all as deltas of one state."""
    events = materialize(distinct_rows(table(spark, d, "search_events"), "id", F.col("search_log_id"), F.col("product_id"), F.col("created_at")), "events")
    logs, products = table(spark, d, "search_query_logs"), table(spark, d, "product_search_index")
    state = ReferenceState(spark)
    for batch, when in enumerate((f"< '{CUT}'", f">= '{CUT}'")):
        new = events.filter(f"created_at {when}")
        refs = [reference_deltas(new, f, 1, f, "created_at") for f in ("search_log_id", "product_id")]
        found = [existence_deltas(logs.filter(f"created_at {when}"), "id", 1, "search_log_id", "created_at"), existence_deltas(products.filter(f"indexed_at {when}"), "product_id", 1, "product_id")]
        state.apply(*refs, *found, source="arrivals", batch=batch)
    state.apply(existence_deltas(logs.filter(f"created_at < '{KEPT_FROM}'"), "id", -1, "search_log_id", "created_at"), source="deletions", batch=0)
    return state.failing().select(F.col("field").alias("ref_field"), "key", F.when(F.col("first_us").isNull(), "missing").otherwise("late").alias("state"), "refs")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_failed(spark, d), "day")


def _attributes(spark: SparkSession, d: str):
    return table(spark, d, "variant_attributes"), table(spark, d, "attribute_definitions"), table(spark, d, "attribute_options")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_cells(wide_attributes(*_attributes(spark, d)))


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = wide_attributes(*_attributes(spark, d))
    return wide.select("variant_id", "a_color", "a_size", F.col("a_weight").cast("double").alias("a_weight"), F.col("a_width").cast("double").alias("a_width"), "a_gift_wrap", "a_engraving", F.size("cells").alias("filled"), F.size("conflicts").alias("conflicting"))


def p6_failures(spark: SparkSession, d: str) -> DataFrame:
    return attribute_failures(*_attributes(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(table(spark, d, "categories")).select("slug", "path", "depth")


def p7_roots(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(table(spark, d, "categories")).select("slug", "root", "depth")


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return Hierarchy(table(spark, d, "categories")).descendants()


QUERIES = {f.__name__: f for f in (p3_found, p3_visits, p4_found, p4_cells, p4_features, p5_found, p5_changes, p5_report, p6_found, p6_wide, p6_failures, p7_found, p7_roots, p7_descendants)}

_KEY = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '')".format
_EVENTS = f"""ev AS (
  SELECT {_KEY('id')} AS id, min(epoch_us(created_at)) AS t, min({_KEY('user_id')}) AS u,
         min({_KEY('session_id')}) AS s, min({_KEY('product_id')}) AS p, min(upper(translate({_KEY('event_type')}, ' -', '__'))) AS e,
         min(CASE WHEN json_valid(context) THEN try_cast(json_extract_string(context, '$.cart_value') AS DOUBLE) END) AS v
  FROM analytics_events GROUP BY 1, CASE WHEN {_KEY('id')} IS NULL THEN uuid() END)"""
_VISITS = f"""WITH {_EVENTS},
 x AS (SELECT coalesce(u, s) AS subject, t FROM ev WHERE coalesce(u, s) IS NOT NULL AND t IS NOT NULL),
 y AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY subject ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM x),
 z AS (SELECT *, sum(opens) OVER (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING) AS visit FROM y)
SELECT subject, min(t) AS started_us, max(t) AS ended_us{{}} FROM z GROUP BY subject, visit"""
_CELLS = f"""WITH {_EVENTS},
 long AS (SELECT 'user' AS entity, u AS entity_id, e AS event_type, t, v FROM ev WHERE u IS NOT NULL AND e IS NOT NULL
          UNION ALL SELECT 'product', p, e, t, v FROM ev WHERE p IS NOT NULL AND e IS NOT NULL)
"""
_FAILED = f"""WITH ev AS (SELECT {_KEY('id')} AS id, min({_KEY('search_log_id')}) AS l, min({_KEY('product_id')}) AS p, min(created_at) AS t FROM search_events GROUP BY 1, CASE WHEN {_KEY('id')} IS NULL THEN uuid() END),
 logs AS (SELECT {_KEY('id')} AS k, min(created_at) AS seen FROM search_query_logs GROUP BY 1),
 prods AS (SELECT DISTINCT {_KEY('product_id')} AS k FROM product_search_index),
 failed AS (
 SELECT id AS event_id, 'search_log_id' AS ref_field, CASE WHEN k IS NULL THEN 'missing' ELSE 'late' END AS state, l AS key, t FROM ev LEFT JOIN logs ON l = k WHERE l IS NOT NULL AND (k IS NULL OR seen > t)
 UNION ALL SELECT id, 'product_id', 'missing', p, t FROM ev LEFT JOIN prods ON p = k WHERE p IS NOT NULL AND k IS NULL)
"""
_RESOLVED = rf"""WITH defs AS (SELECT {_KEY('id')} AS d, upper(trim(value_type)) AS kind, {_KEY('unit')} AS unit FROM attribute_definitions),
 names AS (SELECT d, loose, min(slug) AS slug FROM (
   SELECT {_KEY('definition_id')} AS d, {_KEY('slug')} AS slug, unnest([regexp_replace(lower(trim(slug)), '[\s_-]+', ' ', 'g'), regexp_replace(lower(trim(label)), '[\s_-]+', ' ', 'g')]) AS loose FROM attribute_options) GROUP BY 1, 2),
 ids AS (SELECT {_KEY('id')} AS o, {_KEY('definition_id')} AS d, {_KEY('slug')} AS slug FROM attribute_options),
 r AS (SELECT {_KEY('variant_id')} AS variant_id, defs.d, kind, value_text AS raw, trim(lower(value_text)) AS x, ids.slug AS s1, names.slug AS s2,
   CASE WHEN unit IS NOT NULL AND ends_with(trim(lower(value_text)), unit) THEN rtrim(left(trim(lower(value_text)), length(trim(lower(value_text))) - length(unit))) ELSE trim(lower(value_text)) END AS n
   FROM variant_attributes v JOIN defs ON {_KEY('v.definition_id')} = defs.d LEFT JOIN ids ON {_KEY('option_id')} = o AND ids.d = defs.d
   LEFT JOIN names ON names.d = defs.d AND loose = regexp_replace(lower(trim(value_text)), '[\s_-]+', ' ', 'g') WHERE {_KEY('variant_id')} IS NOT NULL),
 vals AS (SELECT variant_id, d AS definition_id, raw, CASE WHEN kind IN ('COLOR', 'ENUM') THEN coalesce(s1, s2)
   WHEN kind = 'NUMBER' AND regexp_full_match(n, '[0-9]+(\.[0-9]+)?') THEN regexp_replace(regexp_replace(regexp_replace(n, '^0+([0-9])', '\1'), '(\.[0-9]*?)0+$', '\1'), '\.$', '')
   WHEN kind = 'BOOLEAN' AND x IN ('yes', 'y', 'true', '1') THEN 'true' WHEN kind = 'BOOLEAN' AND x IN ('no', 'n', 'false', '0') THEN 'false'
   WHEN kind = 'TEXT' THEN nullif(regexp_replace(x, '\s+', ' ', 'g'), '') END AS value FROM r),
 cells AS (SELECT variant_id, definition_id, CASE WHEN min(value) = max(value) THEN min(value) END AS value, coalesce(min(value) < max(value), false) AS clash FROM vals GROUP BY 1, 2)
"""
_TREE = f"""WITH RECURSIVE raw AS (SELECT {_KEY('slug')} AS slug, min({_KEY('parent')}) AS parent FROM categories GROUP BY 1 HAVING {_KEY('slug')} IS NOT NULL),
 n AS (SELECT a.slug, b.slug AS parent FROM raw a LEFT JOIN raw b ON a.parent = b.slug),
 t AS (SELECT slug, slug AS root, slug AS path, 0::BIGINT AS depth FROM n WHERE parent IS NULL
       UNION ALL SELECT n.slug, t.root, t.path || '/' || n.slug, t.depth + 1 FROM n JOIN t ON n.parent = t.slug),
 rest AS (SELECT n.* FROM n LEFT JOIN t ON n.slug = t.slug WHERE t.slug IS NULL),
 walk AS (SELECT slug, parent AS here, 1 AS step, (SELECT count(*) FROM rest) AS most FROM rest UNION ALL SELECT walk.slug, rest.parent, step + 1, most FROM walk JOIN rest ON walk.here = rest.slug WHERE step <= 2 * most),
 caught AS (SELECT slug, min(here) AS path FROM walk WHERE step > most GROUP BY 1)
"""

ORACLE = {
    "p3_found": _VISITS.format(""),
    "p3_visits": _VISITS.format(", max(t) - min(t) AS duration_us, count(*) AS events"),
    "p4_found": _CELLS + "SELECT entity, entity_id, event_type FROM long GROUP BY ALL HAVING count(*) >= 3",
    "p4_cells": _CELLS + "SELECT entity, entity_id, event_type, count(*) AS n, max(t) AS last_us, coalesce(sum(v), 0) AS total FROM long GROUP BY ALL",
    "p4_features": _CELLS + "SELECT entity, entity_id, count(*) AS n_events, max(t) AS last_us" + "".join(f", count(*) FILTER (event_type = '{t}') AS n_{t}, max(t) FILTER (event_type = '{t}') AS last_us_{t}, coalesce(sum(v) FILTER (event_type = '{t}'), 0) AS total_{t}" for t in ("PRODUCT_VIEW", "PRODUCT_CLICK", "SEARCH", "ADD_TO_CART")) + " FROM long GROUP BY ALL",
    "p5_found": _FAILED + "SELECT event_id, ref_field, state FROM failed",
    "p5_changes": f"""WITH ev AS (SELECT {_KEY('id')} AS id, min(search_log_id) AS l, min(product_id) AS p, min(created_at) AS t FROM search_events GROUP BY 1, CASE WHEN {_KEY('id')} IS NULL THEN uuid() END),
 refs AS (SELECT 'search_log_id' AS ref_field, {_KEY('l')} AS key, t FROM ev UNION ALL SELECT 'product_id', {_KEY('p')}, t FROM ev),
 found AS (SELECT 'search_log_id' AS ref_field, {_KEY('id')} AS key, created_at AS seen FROM search_query_logs WHERE created_at >= '{KEPT_FROM}' UNION ALL SELECT 'product_id', {_KEY('product_id')}, make_timestamptz(0) FROM product_search_index WHERE indexed_at IS NOT NULL),
 f AS (SELECT ref_field, key, min(seen) AS seen FROM found GROUP BY 1, 2), r AS (SELECT ref_field, key, min(t) AS named, count(*) AS refs FROM refs WHERE key IS NOT NULL GROUP BY 1, 2)
 SELECT r.ref_field, r.key, CASE WHEN seen IS NULL THEN 'missing' ELSE 'late' END AS state, refs FROM r LEFT JOIN f ON r.ref_field = f.ref_field AND r.key = f.key WHERE seen IS NULL OR seen > named""",
    "p5_report": _FAILED + "SELECT ref_field, date_trunc('day', t) AS period, state, count(*) AS refs, count(DISTINCT key) AS keys FROM failed GROUP BY ALL",
    "p6_found": _RESOLVED + "SELECT variant_id, definition_id, value FROM cells WHERE value IS NOT NULL",
    "p6_wide": _RESOLVED + """SELECT variant_id, max(value) FILTER (code = 'color') AS a_color, max(value) FILTER (code = 'size') AS a_size, max(try_cast(value AS DOUBLE)) FILTER (code = 'weight') AS a_weight, max(try_cast(value AS DOUBLE)) FILTER (code = 'width') AS a_width,
 max(value) FILTER (code = 'gift_wrap')::BOOLEAN AS a_gift_wrap, max(value) FILTER (code = 'engraving') AS a_engraving, count(value)::INT AS filled, count(*) FILTER (clash)::INT AS conflicting FROM cells JOIN attribute_definitions a ON a.id = definition_id GROUP BY variant_id""",
    "p6_failures": _RESOLVED + f"""SELECT variant_id, definition_id, raw, 'unreadable' AS reason, count(*) AS n FROM vals WHERE value IS NULL GROUP BY ALL
 UNION ALL SELECT {_KEY('variant_id')}, {_KEY('definition_id')}, value_text, 'unknown', count(*) FROM variant_attributes WHERE {_KEY('variant_id')} IS NOT NULL AND {_KEY('definition_id')} IS NOT NULL AND {_KEY('definition_id')} NOT IN (SELECT d FROM defs) GROUP BY 1, 2, 3""",
    "p7_found": _TREE + "SELECT slug, path, depth FROM t UNION ALL SELECT slug, path, -1 FROM caught",
    "p7_roots": _TREE + "SELECT slug, root, depth FROM t UNION ALL SELECT slug, NULL, -1 FROM caught",
    "p7_descendants": _TREE + ", up AS (SELECT slug AS ancestor, slug AS descendant, 0::BIGINT AS distance FROM t UNION ALL SELECT t.slug, n.slug, up.distance + 1 FROM up JOIN n ON n.parent = up.descendant JOIN t ON t.slug = up.ancestor) SELECT ancestor, descendant, distance FROM up WHERE distance > 0",
}
