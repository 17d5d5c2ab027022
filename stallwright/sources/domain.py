"""The domain tables in one spelling, each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key, norm_type
from stallwright.operators.sessions import unique_events
from stallwright.sources.tables import table


def query_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logged searches, one row per id: the first by time, of which the smallest should copies differ. Rows without an id are left out."""
    rows = table(spark, d, "search_query_logs")
    return _once(rows.select(norm_key("id").alias("id"), "created_at", norm_key("normalized_query").alias("query"), "result_count", "took_ms", norm_key("session_hash").alias("session"), norm_key("corrected_query").alias("corrected"), "was_corrected", norm_key("ranking_version").alias("ranking_version"), norm_key("experiment_variant").alias("experiment_variant"), norm_key("filter_signature").alias("filters")))


def search_actions(spark: SparkSession, d: str) -> DataFrame:
    """What followed a search, one row per id, as in ``query_logs``."""
    rows = table(spark, d, "search_events")
    return _once(rows.select(norm_key("id").alias("id"), "created_at", norm_key("search_log_id").alias("log_id"), norm_key("product_id").alias("product_id"), "position", norm_type("event_type").alias("kind"), norm_key("session_hash").alias("session")))


def _once(rows: DataFrame) -> DataFrame:
    """The smallest whole row of each id, so that no row is made of several."""
    others = [c for c in rows.columns if c != "id"]
    return rows.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*others)).alias("row")).select("id", "row.*")


def behaviour(spark: SparkSession, d: str) -> DataFrame:
    """``(event_id, time_us, user_id, session_id, subject, product_id, kind, source, placement, request_id)``, one row per event."""
    rows = table(spark, d, "analytics_events")
    keys = [norm_key(c).alias(c) for c in ("user_id", "session_id", "product_id", "source")]
    return unique_events(rows, *keys, norm_type("event_type").alias("kind"), norm_type("recommendation_type").alias("placement"), norm_key("recommendation_request_id").alias("request_id")).withColumn("subject", F.coalesce("user_id", "session_id"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """The index row of each product that was indexed last; of rows indexed at the same time one, told by its place in the files.

    Each column is an aggregate of its own by the same order, so the columns of a product come
    from one row, and those a query doesn't use aren't read.
    """
    rows = table(spark, d, "product_search_index")
    place = F.struct("indexed_at", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    own = rows.select(norm_key("product_id").alias("product_id"), place.alias("_place"), *(c for c in rows.columns if c != "product_id")).filter("product_id IS NOT NULL")
    others = [c for c in rows.columns if c not in ("product_id", "indexed_at")]
    return own.groupBy("product_id").agg(F.max("indexed_at").alias("indexed_at"), *(F.max_by(c, "_place").alias(c) for c in others))
