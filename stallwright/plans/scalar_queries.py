"""Queries of the scalar functions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwright.functions import scoring as C
from stallwright.functions import text as T
from stallwright.operators import experiments as X
from stallwright.plans.log_queries import KEY, LOGS
from stallwright.plans.search_queries import CAT, TOK
from stallwright.sources.domain import catalog, query_logs
from stallwright.sources.tables import table

SECRET = "a secret of the tests"
VARIANTS = [("control", 50.0), ("blue", 30.0), ("green", 20.0)]


def product_texts(s, d):
    """Slugs, plain texts, keys and skus made of every product's texts."""
    rows = catalog(s, d)
    keys = T.tokens(F.col("attribute_text"))
    return rows.select("product_id", T.slug(F.col("name")).alias("slug"), T.plain(F.col("description_text"), 40).alias("plain"), T.value_key(F.col("attribute_text")).alias("key"), T.value_label(F.col("attribute_text")).alias("label"), T.sku_fragment(keys).alias("fragment"), T.derived_sku(F.col("brand_name"), keys).alias("sku"), F.round(T.overlap(F.col("name"), F.col("trigram_text")), 6).alias("overlap"), T.safe_url(F.concat(F.lit("/p/"), "slug")).alias("safe"))


def query_texts(s, d):
    """What can be told from the raw text of every logged query."""
    raw = table(s, d, "search_query_logs").select("query").filter("query IS NOT NULL").distinct()
    words = T.tokens(F.col("query"))
    return raw.select("query", T.sanitized(F.col("query")).alias("clean"), T.searchable(F.col("query")).alias("searchable"), T.identifier(F.col("query")).alias("identifier"), F.size(F.filter(words, T.protected)).alias("protected"), F.array_join(F.transform(words, T.collapsed), " ").alias("collapsed"), T.by_program(F.col("query")).alias("program"))


def session_hashes(s, d):
    """The keyed hash and the experiment variants of every session."""
    rows = query_logs(s, d).filter("session IS NOT NULL").select("session").distinct()
    return rows.select("session", F.substring(T.hmac_sha256(F.col("session"), SECRET), 1, 32).alias("hash"), X.variant(F.col("session"), VARIANTS).alias("variant"), X.spread_variant(F.col("session"), VARIANTS).alias("spread"))


def product_ages(s, d):
    """Ages, decays and labels by the time a product was indexed."""
    rows = catalog(s, d)
    now = rows.agg(F.max("indexed_at").alias("now"))  # one row
    age = F.unix_micros("now") - F.unix_micros("indexed_at")
    method = F.when(F.col("rating_count") % 2 == 0, "LINEAR").otherwise("EXPONENTIAL")
    return rows.crossJoin(now).select("product_id", C.age_label(age).alias("age"), C.ago(age).alias("ago"), C.is_new(age, 7).alias("is_new"), F.round(C.exponential_decay(age), 6).alias("decayed"), F.round(C.decay(method, age, 7), 6).alias("by_method"), C.within(F.col("indexed_at"), F.col("now"), F.col("now") - F.expr("INTERVAL 3 DAYS")).alias("within"))


def product_amounts(s, d):
    """Whole-number shares, discounts, bands and stock labels of every product."""
    price, before = F.col("price_paise"), F.col("compare_at_paise")
    return catalog(s, d).select(
        "product_id", C.half_up(price, F.lit(7).cast("bigint")).alias("seventh"), C.basis_points(price, F.lit(1850).cast("bigint")).alias("share"), C.percent_off(before, price).alias("percent"), C.shown_discount(price, before).alias("shown"),
        C.band_middle(C.price_band(price)).alias("middle"), C.stock_label(F.col("rating_count")).alias("stock"), F.round(C.repeated(F.col("rating_count")), 6).alias("repeated"), C.size_place(F.element_at(T.tokens(F.col("attribute_text")), -1)).alias("size"), C.trend_blend(F.col("popularity"), F.col("rating_count")).alias("blend"),
    )


QUERIES = {f.__name__: f for f in (product_texts, query_texts, session_hashes, product_ages, product_amounts)}

_FOLD = "lower(strip_accents({0}))".format
_CLEAN = "trim(regexp_replace(regexp_replace({0}, '[\\x00-\\x1f\\x7f]', {1}, 'g'), '\\s+', ' ', 'g'))".format
_CUT = "regexp_replace(left(regexp_replace(regexp_replace(replace(" + _FOLD("name") + ", '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '')"
_FRAGMENT = f"left(array_to_string(list_filter(list_transform({TOK('attribute_text')}, lambda k: regexp_replace(upper(k), '[^A-Z0-9]+', '', 'g')), lambda k: k <> ''), '-'), 40)"
_HEAD = "coalesce(nullif(left(regexp_replace(upper(brand_name), '[^A-Z0-9]', '', 'g'), 20), ''), 'SKU')"
_FNV = "list_reduce([2166136261::BIGINT] || [unicode(c)::BIGINT FOR c IN string_split({0}, '')], lambda h, c: (xor(h, c) * 16777619) % 4294967296)".format
_KEY = SECRET.encode().ljust(64, b"\0")
_BYTES = lambda pad: "'" + "".join(f"\\x{k ^ pad:02X}" for k in _KEY) + "'::BLOB"
_DAY = 86_400_000_000
_N = lambda n, unit, tail="": f"{n}::VARCHAR || CASE WHEN {n} = 1 THEN ' {unit}{tail}' ELSE ' {unit}s{tail}' END"
ORACLE = {
    "product_texts": f"""WITH {CAT}, f AS (SELECT *, {_CUT} AS cut, {_FRAGMENT} AS frag, list_distinct({TOK('name')}) AS wanted, {TOK('trigram_text')} AS held FROM cat)
 SELECT product_id, coalesce(nullif(cut, ''), 'product') AS slug, left({_CLEAN("regexp_replace(regexp_replace(coalesce(description_text, ''), '<[^>]*>', ' ', 'g'), '(?i)&(?:#[0-9]+|#x[0-9a-f]+|[A-Za-z0-9_]+);', ' ', 'g')", "' '")}, 40) AS plain, lower(regexp_replace(trim(attribute_text), '\\s+', ' ', 'g')) AS key, left({_CLEAN('attribute_text', "''")}, 60) AS label,
 frag AS fragment, CASE WHEN frag = '' THEN {_HEAD} ELSE left({_HEAD} || '-' || frag, 64) END AS sku, CASE WHEN len(wanted) = 0 OR len(held) = 0 THEN 0.0 ELSE round(len(list_filter(wanted, lambda w: list_bool_or([starts_with(t, w) FOR t IN held])))::DOUBLE / len(wanted), 6) END::DOUBLE AS overlap, NOT contains('/p/' || slug, '://') AND NOT contains('/p/' || slug, chr(92)) AS safe FROM f""",
    "query_texts": f"""WITH q AS (SELECT DISTINCT query FROM search_query_logs WHERE query IS NOT NULL), w AS (SELECT *, left({_CLEAN('query', "' '")}, 80) AS clean, {TOK('query')} AS words FROM q)
 SELECT query, clean, length(clean) >= 2 AS searchable, regexp_matches(trim(query), '[0-9]') AND (regexp_full_match(trim(query), '[0-9]{{8,14}}') OR regexp_full_match(trim(query), '[A-Za-z0-9][A-Za-z0-9_-]{{4,63}}')) AS identifier, len(list_filter(words, lambda t: regexp_full_match(t, '[0-9]+') OR (regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]$')) OR length(t) <= 2))::INT AS protected,
 array_to_string(list_transform(words, lambda t: array_to_string([CASE WHEN i > 2 AND t[i] = t[i - 1] AND t[i] = t[i - 2] THEN '' ELSE t[i] END FOR i IN range(1, length(t) + 1)], '')), ' ') AS collapsed, query = '' OR regexp_matches(lower(query), '{"|".join(T.PROGRAMS)}') AS program FROM w""",
    "session_hashes": f"""WITH {LOGS}, h AS (SELECT session, {_FNV('session')} AS code FROM (SELECT DISTINCT session FROM logs WHERE session IS NOT NULL))
 SELECT session, left(sha256({_BYTES(0x5C)} || unhex(sha256({_BYTES(0x36)} || encode(session)))), 32) AS hash, CASE WHEN code % 100 < 50 THEN 'control' WHEN code % 100 < 80 THEN 'blue' ELSE 'green' END AS variant, CASE WHEN (code % 1000) / 1000.0 * 100 <= 50 THEN 'control' WHEN (code % 1000) / 1000.0 * 100 <= 80 THEN 'blue' ELSE 'green' END AS spread FROM h""",
    "product_ages": f"""WITH {CAT}, a AS (SELECT *, epoch_us((SELECT max(indexed_at) FROM cat)) - epoch_us(indexed_at) AS age FROM cat), m AS (SELECT *, age // 60000000 AS mi, age // 3600000000 AS ho, age // {_DAY} AS da FROM a)
 SELECT product_id, CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN {_N('mi', 'minute')} WHEN ho < 24 THEN {_N('ho', 'hour')} WHEN da < 30 THEN {_N('da', 'day')} ELSE {_N('(da // 30)', 'month')} END AS age, CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN {_N('mi', 'minute', ' ago')} WHEN ho < 24 THEN {_N('ho', 'hour', ' ago')} WHEN da = 1 THEN 'yesterday' WHEN da < 7 THEN {_N('da', 'day', ' ago')} WHEN da // 7 < 5 THEN {_N('(da // 7)', 'week', ' ago')} ELSE {_N('(da // 30)', 'month', ' ago')} END AS ago,
 age >= 0 AND age < 7 * {_DAY} AS is_new, round(CASE WHEN pow(0.5, age::DOUBLE / (14 * {_DAY})) < 0.01 THEN 0 ELSE pow(0.5, age::DOUBLE / (14 * {_DAY})) END, 6)::DOUBLE AS decayed,
 round(CASE WHEN rating_count % 2 = 0 THEN CASE WHEN greatest(0, 1 - age::DOUBLE / (14 * {_DAY})) < 0.01 THEN 0 ELSE greatest(0, 1 - age::DOUBLE / (14 * {_DAY})) END ELSE CASE WHEN pow(0.5, age::DOUBLE / (7 * {_DAY})) < 0.01 THEN 0 ELSE pow(0.5, age::DOUBLE / (7 * {_DAY})) END END, 6)::DOUBLE AS by_method, indexed_at <= (SELECT max(indexed_at) FROM cat) - INTERVAL 3 DAYS AS within FROM m""",
    "product_amounts": f"""WITH {CAT}, p AS (SELECT *, CASE WHEN compare_at_paise > 0 AND price_paise <= compare_at_paise THEN ((compare_at_paise - price_paise) * 200 + compare_at_paise) // (2 * compare_at_paise) END AS percent, (10 ** (length(price_paise::VARCHAR) - 1))::BIGINT AS low, upper(({TOK('attribute_text')})[-1]) AS sz FROM cat)
 SELECT product_id, (price_paise * 2 + 7) // 14 AS seventh, (price_paise * 1850 * 2 + 10000) // 20000 AS share, percent, CASE WHEN percent BETWEEN 1 AND 99 AND price_paise < compare_at_paise THEN percent END AS shown, floor(sqrt(low::DOUBLE * low * 10) + 0.5)::BIGINT AS middle, CASE WHEN rating_count <= 0 THEN 'none' WHEN rating_count <= 5 THEN 'few' WHEN rating_count <= 25 THEN 'some' ELSE 'many' END AS stock,
 round(CASE WHEN rating_count > 0 THEN pow(rating_count, 0.6) ELSE 0 END, 6)::DOUBLE AS repeated, coalesce(nullif(list_position([{', '.join(f"'{x}'" for x in C.SIZES)}], sz), 0), 999)::BIGINT AS size, round((popularity * 0.75 + rating_count * 0.25)::DECIMAL(28, 12), 4)::DOUBLE AS blend FROM p""",
}
