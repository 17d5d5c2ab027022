"""How recommendations do: impressions and what follows, by slot, day, position and product; quality of lists.

Events that name a slot (``placement``) are those of recommendations: a view is an impression.
Rates are to six places and null without impressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.operators.log_analytics import ratio
from stallwright.operators.scans import placed

DAY_US = 86_400_000_000
SHOWN, CLICKED, CARTED, BOUGHT = "PRODUCT_VIEW", "PRODUCT_CLICK", "ADD_TO_CART", "PURCHASE"


def _counts() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(n) for n, k in (("impressions", SHOWN), ("clicks", CLICKED), ("carts", CARTED), ("purchases", BOUGHT))]


def rates(counts: DataFrame) -> DataFrame:
    """Click, cart and conversion rates of counted rows."""
    return counts.select("*", *(ratio(F.col(c), F.col("impressions")).alias(n) for c, n in (("clicks", "ctr"), ("carts", "cart_rate"), ("purchases", "conversion"))))


def overview(events: DataFrame) -> DataFrame:
    """One row over all slots, with the subjects and requests reached."""
    own = events.filter("placement IS NOT NULL")
    return rates(own.agg(*_counts(), F.count_distinct("subject").alias("subjects"), F.count_distinct("request_id").alias("requests"), F.count_distinct("placement").alias("slots")))


def by_type(events: DataFrame) -> DataFrame:
    return rates(events.filter("placement IS NOT NULL").groupBy("placement").agg(*_counts()))


def daily(events: DataFrame) -> DataFrame:
    """``(day, placement, impressions, clicks, carts, purchases, ctr)`` per UTC day; clicks never exceed impressions."""
    rows = events.filter("placement IS NOT NULL AND time_us IS NOT NULL").groupBy(F.to_date(F.timestamp_micros("time_us")).alias("day"), "placement").agg(*_counts())
    capped = rows.withColumn("clicks", F.least("clicks", "impressions"))
    return capped.withColumn("ctr", ratio(F.col("clicks"), F.col("impressions")))


def series(rollup: DataFrame, days: int = 14) -> DataFrame:
    """The last ``days`` of a daily rollup with a row for every slot and day, zero where nothing happened."""
    now = rollup.agg(F.max("day").alias("now"))  # one row
    each = now.select(F.explode(F.sequence(F.date_sub("now", days - 1), F.col("now"))).alias("day"))
    grid = rollup.select("placement").distinct().crossJoin(F.broadcast(each))  # days rows
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(rollup, ["day", "placement"], "left").select("day", "placement", *(zero(c) for c in ("impressions", "clicks", "carts", "purchases")))


def by_position(actions: DataFrame, most: int = 60) -> DataFrame:
    """``(position, clicked, carted, bought, cart_rate, conversion)``: what follows a click of each position, a click of a search and product counting once."""
    each = lambda kind, name: actions.filter((F.col("kind") == kind) & F.col("log_id").isNotNull() & F.col("product_id").isNotNull()).groupBy("log_id", "product_id").agg(F.min("position").alias("position" if kind == "CLICK" else f"_{name}"), F.lit(1).alias(name))
    rows = each("CLICK", "clicked").filter(F.col("position").between(1, most)).join(each("ADD_TO_CART", "carted"), ["log_id", "product_id"], "left").join(each("PURCHASE", "bought"), ["log_id", "product_id"], "left")
    sums = rows.groupBy("position").agg(F.count("*").alias("clicked"), F.count("carted").alias("carted"), F.count("bought").alias("bought"))
    return sums.withColumn("cart_rate", ratio(F.col("carted"), F.col("clicked"))).withColumn("conversion", ratio(F.col("bought"), F.col("clicked")))


def top_products(events: DataFrame, catalog: DataFrame, limit: int = 50) -> DataFrame:
    """The products shown most in slots, with their name or ``(removed)``."""
    counts = events.filter("placement IS NOT NULL AND product_id IS NOT NULL").groupBy("product_id").agg(*_counts())
    named = counts.join(catalog.select("product_id", "name"), "product_id", "left").withColumn("name", F.coalesce("name", F.lit("(removed)")))
    return rates(named).orderBy(F.desc("impressions"), F.desc("clicks"), "product_id").limit(limit)


def attributed(events: DataFrame, within_us: int = 7 * DAY_US) -> DataFrame:
    """``(event_id, kind, placement, request_id, hours)``: each cart addition and purchase with the latest event of a slot of the same subject and product before it, null without one in time.

    One pass over (subject, product) in order of time; an event at the very time counts.
    """
    touch = F.col("placement").isNotNull() & F.col("kind").isin(SHOWN, CLICKED)
    rows = events.filter("subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL").filter(touch | F.col("kind").isin(CARTED, BOUGHT))
    order = W.partitionBy("subject", "product_id").orderBy("time_us", F.when(touch, 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(touch, F.struct("time_us", "placement", "request_id")), ignorenulls=True).over(order)
    out = rows.withColumn("t", last).filter(F.col("kind").isin(CARTED, BOUGHT))
    near = (F.col("time_us") - F.col("t.time_us")) <= within_us
    return out.select("event_id", "kind", F.when(near, F.col("t.placement")).alias("placement"), F.when(near, F.col("t.request_id")).alias("request_id"), F.when(near, F.round((F.col("time_us") - F.col("t.time_us")) / 3_600_000_000, 2)).alias("hours"))


def evaluation(recommended: DataFrame, relevant: DataFrame, groups: DataFrame, popularity: DataFrame, catalog_size: DataFrame, quality: DataFrame, k: int = 10) -> DataFrame:
    """One row: means over requests of precision, recall, average precision (MAP) and NDCG; coverage and its parts; novelty.

    ``quality`` is the table of ``recommend.ranking_quality``; ``popularity(item, score)`` tells
    the most popular tenth, outside of which a shown item is novel; ``diversity_ratio`` is the
    number of different items over that of all shown.
    """
    means = quality.agg(F.count("*").alias("requests"), *(F.round(F.avg(c), 6).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("average_precision", "map"), ("ndcg", "ndcg"))))
    order = placed(popularity.select("item", "score"), [], [F.desc("score"), F.asc("item")])
    top = order.crossJoin(order.agg(F.max("rank").alias("n"))).filter("rank - 1 < 0.1 * (n - 1)").select("item", F.lit(1).alias("top"))  # n is one row
    shown = recommended.filter(F.col("rank") <= k).join(top, "item", "left").agg(F.count("*").alias("shown"), F.count_distinct("item").alias("items"), F.round(1 - F.count("top") / F.count("*"), 6).alias("novelty"))
    kinds = recommended.filter(F.col("rank") <= k).join(groups, "item", "left").agg(F.count_distinct("grp").alias("groups"))
    rows = means.crossJoin(shown).crossJoin(kinds).crossJoin(catalog_size)  # one row each
    return rows.select("requests", "precision", "recall", "map", "ndcg", "novelty", F.round(F.col("items") / F.col("size"), 6).alias("coverage"), F.round(F.col("items") / F.col("shown"), 6).alias("diversity_ratio"), "groups")


def table_coverage(catalog: DataFrame, **tables: DataFrame) -> DataFrame:
    """``(table, products, share)``: of each offline table with a ``product_id``, how many searchable products it has rows for."""
    open_ = catalog.filter("is_searchable").select("product_id")
    size = open_.agg(F.count("*").alias("size"))  # one row
    out = None
    for name, rows in tables.items():
        own = open_.join(rows.select("product_id").distinct(), "product_id", "left_semi").agg(F.count("*").alias("products")).crossJoin(size)
        part = own.select(F.lit(name).alias("table"), "products", F.round(F.col("products") / F.col("size"), 4).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out
