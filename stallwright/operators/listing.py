"""Catalog listings: pages in eight orders, facets of variants, related and popular products, suggestions by kind, taxonomy reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.functions.text import tokens

# The weights of suggestions by kind.
KIND_WEIGHTS = {"BRAND": 900.0, "CATEGORY": 800.0, "PRODUCT": 700.0, "QUERY": 300.0}
HISTORY_WEIGHT, TREND_WEIGHT = 2000, 200


def order_of(sort: str) -> list[Column]:
    """The columns that a listing is sorted by; an unknown sort is ``featured``. Nulls come last and product_id decides ties."""
    off = F.when(F.col("compare_at_paise") > 0, (F.col("compare_at_paise") - F.col("price_paise")) / F.col("compare_at_paise")).otherwise(0.0)
    orders = {
        "price-asc": [F.asc_nulls_last("price_paise"), F.desc("name")],
        "price-desc": [F.desc_nulls_last("price_paise"), F.desc("name")],
        "newest": [F.desc_nulls_last("indexed_at")],
        "rating": [F.desc_nulls_last("rating_average"), F.desc("rating_count")],
        "discount": [off.desc()],
        "popularity": [F.desc_nulls_last("popularity"), F.desc_nulls_last("rating_average")],
        "name": [F.asc_nulls_last("name")],
    }
    return [*orders.get(sort, orders["popularity"]), F.asc("product_id")]


def first_pages(catalog: DataFrame, sorts: list[str], size: int = 24) -> DataFrame:
    """``(sort, rank, product_id)``: the first page of each order."""
    out = None
    for sort in sorts:
        top = catalog.orderBy(*order_of(sort)).limit(size)
        page = top.withColumn("rank", F.row_number().over(W.orderBy(*order_of(sort)))).select(F.lit(sort).alias("sort"), "rank", "product_id")  # size rows
        out = page if out is None else out.unionByName(page)
    return out


def page_meta(page: int, size: int, total: int) -> dict[str, int | bool]:
    """What a page is of the whole; the first page is 1 and there is at least one."""
    pages = max(1, math.ceil(total / size))
    at = min(max(1, page), pages)
    return {"page": at, "size": size, "total": total, "pages": pages, "has_previous": at > 1, "has_next": at < pages}


def page_window(page: int, pages: int, around: int = 1) -> list[int | None]:
    """The page numbers to show: the first, the last and those around this one; None stands for a gap."""
    shown = sorted({1, pages, *range(max(1, page - around), min(pages, page + around) + 1)} - {0})
    out: list[int | None] = []
    for n in shown:
        if out and n - out[-1] == 2:
            out.append(n - 1)
        elif out and n - out[-1] > 2:
            out.append(None)
        out.append(n)
    return out


def category_pages(catalog: DataFrame, places: DataFrame, above: DataFrame, size: int = 12) -> DataFrame:
    """``(slug, rank, product_id)``: the newest products of each category with all below it.

    ``places(category_id, slug)``, ``above(at, slug)``: every category (``at``) over each and over itself.
    A product enters the categories above it only among the newest of its own, as no other can be on a page.
    """
    newest = [F.desc_nulls_last("indexed_at"), F.asc("product_id")]
    own = catalog.filter("is_searchable").select("product_id", norm_key("category_id").alias("category_id"), "indexed_at").join(places, "category_id")
    first = own.withColumn("place", F.row_number().over(W.partitionBy("slug").orderBy(*newest))).filter(F.col("place") <= size)
    each = first.join(above, "slug").select(F.col("at").alias("slug"), "product_id", "indexed_at").distinct()
    return each.withColumn("rank", F.row_number().over(W.partitionBy("slug").orderBy(*newest))).filter(F.col("rank") <= size).select("slug", "rank", "product_id")


def related_in_category(catalog: DataFrame, limit: int = 24) -> DataFrame:
    """``(product_id, related_id, rank)``: for each product the most popular others of its category, of which only the first can be on any list."""
    liked = [F.desc("popularity"), F.desc("rating_count"), F.asc("related_id")]
    open_ = catalog.filter("category_path IS NOT NULL AND is_searchable").select("product_id", "category_path", F.coalesce("popularity", F.lit(-1.0)).alias("popularity"), "rating_count")
    first = open_.withColumnRenamed("product_id", "related_id").withColumn("place", F.row_number().over(W.partitionBy("category_path").orderBy(*liked))).filter(F.col("place") <= limit + 1)
    pairs = open_.select("product_id", "category_path").join(first, "category_path").filter("product_id <> related_id")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("product_id").orderBy("place"))).filter(F.col("rank") <= limit).select("product_id", "related_id", "rank")


def top_brands(catalog: DataFrame, limit: int = 12) -> DataFrame:
    rows = catalog.filter("brand_name IS NOT NULL AND is_searchable").groupBy("brand_name").agg(F.count("*").alias("products"))
    return rows.orderBy(F.desc("products"), "brand_name").limit(limit)


def variant_facets(index: DataFrame, catalog: DataFrame, most: int = 50) -> DataFrame:
    """``(axis, value, products, rank)`` over ``index(key, value, product_id)``: the values of each attribute by the searchable products that have a variant with it."""
    open_ = catalog.filter("is_searchable").select("product_id")
    counts = index.join(open_, "product_id", "left_semi").groupBy(F.col("key").alias("axis"), "value").agg(F.count_distinct("product_id").alias("products"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("axis").orderBy(F.desc("products"), "value"))).filter(F.col("rank") <= most)


def typed_suggestions(prefixes: DataFrame, catalog: DataFrame, logs: DataFrame, limit: int = 8) -> DataFrame:
    """``(prefix, kind, text, weight, rank)``: brands, categories, products and successful queries that begin with each ``prefix``, the heaviest of each text."""
    count = lambda c: catalog.filter(f"is_searchable AND {c} IS NOT NULL").groupBy(F.lower(F.trim(c)).alias("text"))
    brands = count("brand_name").agg(F.count("*").alias("n")).select(F.lit("BRAND").alias("kind"), "text", (F.lit(KIND_WEIGHTS["BRAND"]) + F.least(F.lit(50), F.col("n"))).alias("weight"))
    last = catalog.filter("is_searchable AND category_path IS NOT NULL").groupBy(F.lower(F.element_at(F.split("category_path", "/"), -1)).alias("text")).agg(F.count("*").alias("n"))
    categories = last.select(F.lit("CATEGORY").alias("kind"), "text", (F.lit(KIND_WEIGHTS["CATEGORY"]) + F.least(F.lit(50), F.col("n"))).alias("weight"))
    products = count("name").agg(F.max(F.coalesce("popularity", F.lit(0.0))).alias("p")).select(F.lit("PRODUCT").alias("kind"), "text", (F.lit(KIND_WEIGHTS["PRODUCT"]) + F.least(F.lit(50.0), F.col("p"))).alias("weight"))
    queries = logs.filter("result_count > 0 AND query IS NOT NULL").groupBy(F.col("query").alias("text")).agg(F.count("*").alias("n")).select(F.lit("QUERY").alias("kind"), "text", (F.lit(KIND_WEIGHTS["QUERY"]) + F.least(F.lit(200), F.col("n"))).alias("weight"))
    rows = brands.unionByName(categories).unionByName(products).unionByName(queries).filter("text <> ''")
    best = rows.groupBy("text").agg(F.max(F.struct("weight", "kind")).alias("b")).select("text", "b.kind", F.round("b.weight", 4).alias("weight"))
    sizes = prefixes.select(F.length("prefix").alias("k")).distinct()
    cut = best.crossJoin(F.broadcast(sizes)).filter(F.length("text") >= F.col("k")).withColumn("prefix", F.substring(F.col("text"), F.lit(1), F.col("k")))  # as many rows as prefixes have lengths
    found = cut.join(prefixes.select("prefix").distinct(), "prefix")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("weight"), "text"))).filter(F.col("rank") <= limit).select("prefix", "kind", "text", "weight", "rank")


def trending_suggestions(logs: DataFrame, days: int = 7, limit: int = 20) -> DataFrame:
    """``(text, searches, weight)``: the successful queries of the last days."""
    now = logs.agg(F.max("created_at").alias("now"))  # one row
    rows = logs.filter("result_count > 0 AND query IS NOT NULL").crossJoin(now).filter(F.unix_micros("created_at") > F.unix_micros("now") - days * 86_400_000_000)
    return rows.groupBy(F.col("query").alias("text")).agg(F.count("*").alias("searches")).withColumn("weight", TREND_WEIGHT + F.least(F.lit(200), F.col("searches"))).orderBy(F.desc("searches"), "text").limit(limit)


def observed_terms(logs: DataFrame, vocabulary: DataFrame, days: int = 30, least: int = 3, letters: int = 3) -> DataFrame:
    """``(term, queries, known)``: the words of queries that succeeded often of late, and whether the vocabulary has them."""
    now = logs.agg(F.max("created_at").alias("now"))  # one row
    rows = logs.filter("result_count > 0 AND query IS NOT NULL").crossJoin(now).filter(F.unix_micros("created_at") > F.unix_micros("now") - days * 86_400_000_000)
    often = rows.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    words = often.select(F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).filter(F.length("term") >= letters).groupBy("term").agg(F.count("*").alias("queries"))
    held = vocabulary.select(norm_key("term").alias("term"), F.lit(True).alias("known")).filter("term IS NOT NULL").distinct()
    return words.join(held, "term", "left").select("term", "queries", F.coalesce("known", F.lit(False)).alias("known"))


def public_categories(nodes: DataFrame, pairs: DataFrame, tree: DataFrame, deepest: int = 5) -> DataFrame:
    """``(slug, path, depth)`` of the active categories above which all are active too, nearer to the root than ``deepest``.

    ``nodes(slug, is_active)``, ``pairs(ancestor, descendant)``, ``tree(slug, path, depth)``.
    """
    closed = nodes.filter("NOT is_active").select("slug")
    under = pairs.join(closed.withColumnRenamed("slug", "ancestor"), "ancestor", "left_semi").select(F.col("descendant").alias("slug"))
    return tree.filter(F.col("depth").between(0, deepest - 1)).join(closed.unionByName(under).distinct(), "slug", "left_anti").select("slug", "path", "depth")


def children(nodes: DataFrame) -> DataFrame:
    """``(parent, slug, place, position)`` of ``nodes(slug, parent, display_order)``: the children of each category in their order, with gaps of ten between positions."""
    rank = F.row_number().over(W.partitionBy("parent").orderBy(F.asc_nulls_last("display_order"), "slug"))
    return nodes.withColumn("place", rank.cast("bigint")).select("parent", "slug", "place", ((F.col("place") - 1) * 10).alias("position"))


def between(before: int | None, after: int | None) -> int:
    """A position between two; after the last or before the first if one is missing."""
    if before is None and after is None:
        return 0
    if after is None:
        return before + 10
    return (after - 10 if before is None else (before + after) // 2)


def breadcrumbs(tree: DataFrame) -> DataFrame:
    """``(slug, at, crumb, path)``: the chain from the root to each category of ``tree(slug, path)``."""
    parts = F.split("path", "/")
    each = tree.select("slug", F.posexplode(parts).alias("at", "crumb"), parts.alias("parts"))
    return each.select("slug", F.col("at").cast("bigint").alias("at"), "crumb", F.array_join(F.slice("parts", 1, F.col("at") + 1), "/").alias("path"))


def within_subtree(path: Column, top: Column) -> Column:
    """Whether a path is a category's own or of one below it."""
    return (path == top) | F.startswith(path, F.concat(top, F.lit("/")))


def moved(tree: DataFrame, slug: str, parent_path: str | None) -> DataFrame:
    """``(slug, path, new_path, new_depth)``: what a move of one category below another (or to the top) changes, for it and all below it; a move below itself is an error."""
    row = tree.filter(F.col("slug") == slug).select("path").first()
    if row is None:
        raise KeyError(slug)
    if parent_path is not None and (parent_path == row[0] or parent_path.startswith(row[0] + "/")):
        raise ValueError("a category can't be moved below itself")
    head = slug if parent_path is None else f"{parent_path}/{slug}"
    own = tree.filter(within_subtree(F.col("path"), F.lit(row[0])))
    new = F.concat(F.lit(head), F.substring("path", len(row[0]) + 1, 1 << 30))
    return own.select("slug", "path", new.alias("new_path"), (F.size(F.split(new, "/")) - 1).cast("bigint").alias("new_depth"))


def would_cycle(moves: DataFrame, pairs: DataFrame) -> DataFrame:
    """``moves(slug, parent)`` with ``cycle``: whether the parent is the category itself or below it, by ``pairs(ancestor, descendant)``."""
    below = pairs.select(F.col("ancestor").alias("slug"), F.col("descendant").alias("parent"), F.lit(True).alias("_below"))
    return moves.join(below, ["slug", "parent"], "left").select("slug", "parent", (F.coalesce("_below", F.lit(False)) | (F.col("slug") == F.col("parent"))).alias("cycle"))


def location_changes(stored: DataFrame, true: DataFrame) -> DataFrame:
    """``(slug, old_path, new_path, change)`` between two sets of ``(slug, path)``: ADDED, REMOVED or MOVED; what is the same is left out."""
    both = stored.select("slug", F.col("path").alias("old_path")).join(true.select("slug", F.col("path").alias("new_path")), "slug", "full_outer")
    change = F.when(F.col("old_path").isNull() & F.col("new_path").isNull(), None).when(F.col("old_path").isNull(), "ADDED").when(F.col("new_path").isNull(), "REMOVED").when(F.col("old_path") != F.col("new_path"), "MOVED")
    return both.withColumn("change", change).filter("change IS NOT NULL")


# The longest texts of a search document.
TEXT_LIMITS = {"name": 300, "brand_name": 120, "category_path": 300, "tag_text": 500, "attribute_text": 800, "sku_text": 500, "description_text": 4000}


def search_documents(catalog: DataFrame) -> DataFrame:
    """``(product_id, <texts>, trigram_text)``: the texts to be indexed, blanks as one and cut to their limits, and the one for fuzzy matching."""
    cut = lambda c, n: F.substring(F.btrim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")), 1, n)
    rows = catalog.select("product_id", *(cut(c, n).alias(c) for c, n in TEXT_LIMITS.items()))
    parts = F.filter(F.array("name", "brand_name", "attribute_text", "tag_text"), lambda x: x != "")
    return rows.withColumn("trigram_text", F.substring(F.lower(F.array_join(parts, " ")), 1, 500))


def eligible(catalog: DataFrame, category: str | None = None, brand: str | None = None, least: int | None = None, most: int | None = None, in_stock: bool = False, limit: int = 5000) -> DataFrame:
    """``(product_id)`` of the searchable products that fit, the first ``limit`` by id."""
    rows = catalog.filter("is_searchable")
    if category is not None:
        rows = rows.filter(within_subtree(F.col("category_path"), F.lit(category)))
    if brand is not None:
        rows = rows.filter(F.lower(F.trim("brand_name")) == brand.strip().lower())
    rows = rows if least is None else rows.filter(F.col("price_paise") >= least)
    rows = rows if most is None else rows.filter(F.col("price_paise") <= most)
    rows = rows.filter("status = 'ACTIVE'") if in_stock else rows
    return rows.select("product_id").orderBy("product_id").limit(limit)


def history_suggestions(history: DataFrame) -> DataFrame:
    """``(session, text, weight)``: a session's own searches, the latest the heaviest."""
    return history.select("session", F.col("query").alias("text"), (HISTORY_WEIGHT - F.col("rank") + 1).alias("weight"))


def wishlists(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(subject, product_id, since_us, name, price_paise)``: what is on each list now: added and not removed since; at one time a removal counts last."""
    acts = events.filter("kind IN ('WISHLIST_ADD', 'WISHLIST_REMOVE') AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL")
    last = acts.groupBy("subject", "product_id").agg(F.max(F.struct("time_us", "kind")).alias("l")).filter("l.kind = 'WISHLIST_ADD'")
    return last.select("subject", "product_id", F.col("l.time_us").alias("since_us")).join(catalog.select("product_id", "name", "price_paise"), "product_id")


def customer_orders(orders: DataFrame, lines: DataFrame, parts: DataFrame, size: int = 10) -> DataFrame:
    """``(customer, order, rank, day, lines, quantity, first_item)``: the newest orders of each customer with what is in them; orders without lines stay."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    newest = orders.select("o_custkey", "o_orderkey", "o_orderdate").withColumn("rank", rank).filter(F.col("rank") <= size)
    items = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct().groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity"), F.min(F.struct("l_linenumber", "l_partkey")).getField("l_partkey").alias("p_partkey"))
    rows = newest.join(items, "o_orderkey", "left").join(parts.select("p_partkey", F.col("p_name").alias("first_item")), "p_partkey", "left")
    return rows.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), "rank", F.to_date("o_orderdate").alias("day"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quantity", F.lit(0)).alias("quantity"), "first_item")


def path_similarity(a: Column, b: Column) -> Column:
    """1 for the same path, else the shared beginning against the longer path, at most 0.85; 0 if either is missing."""
    x, y = F.split(a, "/"), F.split(b, "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda k: F.slice(x, 1, k) == F.slice(y, 1, k)))
    return F.coalesce(F.when(a == b, 1.0).otherwise(F.least(F.lit(0.85), shared / F.greatest(F.size(x), F.size(y)))), F.lit(0.0))


def sitemap(catalog: DataFrame, limit: int = 45_000) -> DataFrame:
    """``(slug, updated_at)`` of what can be found, the latest first."""
    return catalog.filter("is_searchable AND slug IS NOT NULL").select("slug", F.col("indexed_at").alias("updated_at")).orderBy(F.desc("updated_at"), "slug").limit(limit)


def variant_grid(axes: DataFrame, most: int = 200) -> DataFrame:
    """``(product_id, combo, values)``: every combination of the values of a product's ``axes(product_id, axis, place, value)``, at most ``most`` of a product, else an error.

    Axes stand in their order; a value that is repeated counts once; a product without axes has none.
    """
    each = axes.groupBy("product_id", "axis").agg(F.min("place").alias("place"), F.array_sort(F.collect_set("value")).alias("values"))
    own = each.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("place", "axis", "values"))).alias("axes"))
    size = F.aggregate("axes", F.lit(1).cast("bigint"), lambda n, x: n * F.size(x["values"]))
    checked = own.withColumn("axes", F.when(size <= most, F.col("axes")).otherwise(F.raise_error(F.concat(F.lit("too many variants of "), "product_id"))))
    start = F.array(F.array().cast("array<string>"))
    grid = F.aggregate("axes", start, lambda done, x: F.flatten(F.transform(done, lambda d: F.transform(x["values"], lambda v: F.concat(d, F.array(v))))))
    rows = checked.select("product_id", F.transform("axes", lambda x: x["axis"]).alias("names"), F.explode(grid).alias("values"))
    combo = F.array_join(F.array_sort(F.zip_with("names", "values", lambda n, v: F.concat(n, F.lit(":"), v))), "|")
    return rows.select("product_id", combo.alias("combo"), "values")
