"""Search and event analytics: overviews, rising and failing queries, funnels, rollups, attribution.

"Now" is always the latest time in the data. Divisions by nothing give null; empty tables
give no rows (the overview: one row of zeros and nulls).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def ratio(a: Column, b: Column, places: int = 6) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), places)


def search_overview(logs: DataFrame, actions: DataFrame) -> DataFrame:
    """Volume, distinct queries and sessions, zero-result and correction shares, latency percentiles, share of sessions with a click."""
    clicked = actions.filter("kind = 'CLICK' AND session IS NOT NULL").select("session").distinct().withColumn("clicked", F.lit(1))
    base = logs.agg(
        F.count("*").alias("searches"),
        F.count_distinct("query").alias("queries"),
        F.count_if(F.col("result_count") == 0).alias("zero_results"),
        F.count_if(F.col("was_corrected")).alias("corrected"),
        F.round(F.avg("took_ms"), 3).alias("avg_ms"),
        *(F.round(F.expr(f"percentile(took_ms, {p})"), 3).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)),
    )
    sessions = logs.filter("session IS NOT NULL").select("session").distinct().join(clicked, "session", "left").agg(F.count("*").alias("sessions"), F.count("clicked").alias("clicking"))
    return base.crossJoin(sessions).select(*base.columns, "sessions", ratio(F.col("clicking"), F.col("sessions")).alias("click_rate"))  # one row each


def query_stats(logs: DataFrame, actions: DataFrame) -> DataFrame:
    """Per query: searches, zero results, mean results, clicks and click-through."""
    clicks = actions.filter("kind = 'CLICK' AND log_id IS NOT NULL").groupBy(F.col("log_id").alias("id")).agg(F.count("*").alias("clicks"))
    joined = logs.filter("query IS NOT NULL").join(clicks, "id", "left")
    return joined.groupBy("query").agg(
        F.count("*").alias("searches"),
        F.count_if(F.col("result_count") == 0).alias("zero_results"),
        F.round(F.avg("result_count"), 4).alias("avg_results"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        ratio(F.count("clicks"), F.count("*")).alias("clicked_share"),
    )


def low_click_queries(stats: DataFrame, least: int = 5, limit: int = 50) -> DataFrame:
    return stats.filter(F.col("searches") >= least).orderBy("clicked_share", F.desc("searches"), "query").limit(limit)


def popular_queries(stats: DataFrame, limit: int = 20) -> DataFrame:
    return stats.orderBy(F.desc("searches"), "query").limit(limit)


def zero_result_queries(logs: DataFrame, limit: int = 50) -> DataFrame:
    found = logs.filter("result_count = 0 AND query IS NOT NULL").groupBy("query").agg(F.count("*").alias("searches"), F.max("created_at").alias("last_seen"), F.max("corrected").alias("corrected"))
    return found.orderBy(F.desc("searches"), "query").limit(limit)


def rising_queries(logs: DataFrame, days: int = 14, least: int = 3, limit: int = 50) -> DataFrame:
    """Growth of the second half of the window over the first."""
    now = logs.agg(F.max("created_at").alias("now"))
    age = F.unix_micros("now") - F.unix_micros("created_at")
    halves = logs.filter("query IS NOT NULL").crossJoin(now).withColumn("age", age).filter(F.col("age") < days * DAY_US)  # now is one row
    counts = halves.groupBy("query").agg(F.count_if(F.col("age") < days * DAY_US // 2).alias("recent"), F.count_if(F.col("age") >= days * DAY_US // 2).alias("earlier")).filter(F.col("recent") >= least)
    growth = F.round(F.when(F.col("earlier") == 0, F.col("recent").cast("double")).otherwise((F.col("recent") - F.col("earlier")) / F.col("earlier")), 6)
    return counts.withColumn("growth", growth).orderBy(F.desc("growth"), F.desc("recent"), "query").limit(limit)


def click_positions(actions: DataFrame) -> DataFrame:
    return actions.filter("kind = 'CLICK' AND position IS NOT NULL").groupBy("position").agg(F.count("*").alias("clicks"), F.count_distinct("product_id").alias("products"))


def daily_rollup(logs: DataFrame, actions: DataFrame) -> DataFrame:
    """UTC day x ranking version x variant: searches, clicks (at most one a search), zero results."""
    clicked = actions.filter("kind = 'CLICK' AND log_id IS NOT NULL").select(F.col("log_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    rows = logs.join(clicked, "id", "left").groupBy(F.to_date("created_at").alias("day"), "ranking_version", F.coalesce("experiment_variant", F.lit("none")).alias("variant"))
    out = rows.agg(F.count("*").alias("searches"), F.count("hit").alias("clicked"), F.count_if(F.col("result_count") == 0).alias("zero_results"))
    return out.withColumn("ctr", ratio(F.col("clicked"), F.col("searches")))


def funnel(events: DataFrame, by: str) -> DataFrame:
    """Views, clicks, cart additions and purchases with their rates, per value of ``by``."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    sums = events.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("events"), count("PRODUCT_VIEW").alias("views"), count("PRODUCT_CLICK").alias("clicks"), count("ADD_TO_CART").alias("carts"), count("PURCHASE").alias("purchases"), F.count_distinct("subject").alias("subjects"))
    return sums.withColumn("cart_rate", ratio(F.col("carts"), F.col("views"))).withColumn("purchase_rate", ratio(F.col("purchases"), F.col("views")))


def attribute_last_touch(events: DataFrame, touch: str, outcome: str, within_us: int = 7 * DAY_US) -> DataFrame:
    """Each outcome with the latest earlier touch of the same subject and product (an as-of join).

    One pass over (subject, product) in order of time instead of a range join: the last
    touch is carried forward by a window. A touch at the very time of the outcome counts.
    """
    rows = events.filter(F.col("kind").isin(touch, outcome) & F.col("subject").isNotNull() & F.col("product_id").isNotNull() & F.col("time_us").isNotNull())
    order = W.partitionBy("subject", "product_id").orderBy("time_us", F.when(F.col("kind") == touch, 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == touch, F.struct("time_us", "placement")), ignorenulls=True).over(order)
    out = rows.withColumn("touch", last).filter(F.col("kind") == outcome)
    near = (F.col("time_us") - F.col("touch.time_us")) <= within_us
    return out.select("event_id", "subject", "product_id", "time_us", F.when(near, F.col("touch.time_us")).alias("touch_us"))


def over_exposed(events: DataFrame, kind: str = "PRODUCT_VIEW", least: int = 12, days: int = 30) -> DataFrame:
    """Products one subject saw at least ``least`` times in the last ``days``."""
    now = events.agg(F.max("time_us").alias("now"))
    recent = events.filter((F.col("kind") == kind) & F.col("subject").isNotNull() & F.col("product_id").isNotNull()).crossJoin(now).filter(F.col("time_us") >= F.col("now") - days * DAY_US)  # now is one row
    return recent.groupBy("subject", "product_id").agg(F.count("*").alias("shown")).filter(F.col("shown") >= least)


def recently_viewed(events: DataFrame, limit: int = 12) -> DataFrame:
    """The products each subject viewed last, with their number of views."""
    seen = events.filter("kind = 'PRODUCT_VIEW' AND subject IS NOT NULL AND product_id IS NOT NULL AND time_us IS NOT NULL").groupBy("subject", "product_id").agg(F.count("*").alias("views"), F.max("time_us").alias("last_us"))
    rank = F.row_number().over(W.partitionBy("subject").orderBy(F.desc("last_us"), "product_id"))
    return seen.withColumn("rank", rank).filter(F.col("rank") <= limit)


def search_history(logs: DataFrame, keep: int = 20) -> DataFrame:
    """The newest queries of each session, one row per canonical form (sorted distinct words)."""
    words = F.array_sort(F.array_distinct(F.filter(F.split("query", r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    rows = logs.filter("session IS NOT NULL AND query IS NOT NULL").withColumn("canonical", F.array_join(words, " ")).filter("canonical <> ''")
    each = rows.groupBy("session", "canonical").agg(F.count("*").alias("times"), F.max(F.struct("created_at", "query")).alias("last"))
    rank = F.row_number().over(W.partitionBy("session").orderBy(F.desc("last.created_at"), "canonical"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= keep).select("session", "canonical", F.col("last.query").alias("query"), "times", F.col("last.created_at").alias("last_seen"), "rank")
