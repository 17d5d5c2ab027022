"""The columns that the domain tables must have, and sinks that add to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key, norm_type

SCHEMAS = {
    "analytics_events": "id string, event_type string, user_id string, session_id string, product_id string, context string, variant_id string, category_id string, brand_id string, search_query string, recommendation_type string, recommendation_request_id string, source string, created_at timestamp",
    "product_search_index": "product_id string, slug string, name string, brand_name string, brand_id string, category_id string, category_path string, seller_id string, sku_text string, tag_text string, attribute_text string, description_text string, trigram_text string, price_paise bigint, compare_at_paise bigint, status string, is_searchable boolean, rating_average double, rating_count bigint, popularity double, indexed_at timestamp",
    "search_query_logs": "id string, query string, normalized_query string, result_count int, took_ms int, session_hash string, corrected_query string, was_corrected boolean, ranking_version string, experiment_variant string, filter_signature string, created_at timestamp",
    "search_events": "id string, search_log_id string, product_id string, position int, event_type string, session_hash string, ranking_version string, experiment_variant string, created_at timestamp",
}


def problems(rows: DataFrame, name: str) -> list[str]:
    """What a table lacks: columns missing or of another type; further columns are no problem."""
    want = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    have = {f.name: f.dataType for f in rows.schema}
    return [f"{f.name} is missing" if f.name not in have else f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in want if have.get(f.name) != f.dataType]


class Sink:
    """A table of parquet files that batches are added to, each once: a batch's folder is named by it."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add rows with the table's columns (missing ones as null); False if the batch is there already."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}/_SUCCESS")
        if fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return False
        kinds, held = self.spark.createDataFrame([], SCHEMAS[self.name]).schema, set(rows.columns)
        rows.select(*((F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds)).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMAS[self.name]}, batch string").parquet(self.path)


def recordable(events: DataFrame) -> DataFrame:
    """The events that may be added: those with a type and a time."""
    return events.filter(norm_type("event_type").isNotNull() & F.col("created_at").isNotNull())


def impressions(lists: DataFrame, requests: DataFrame) -> DataFrame:
    """``(id, event_type, product_id, recommendation_type, recommendation_request_id, position, created_at)`` of shown lists ``(list_id, kind, product_id, position, at)``.

    ``requests(list_id, request_id)`` names the request of a list, if it is known; positions begin with one.
    """
    known = requests.select(norm_key("list_id").alias("list_id"), "request_id").filter("list_id IS NOT NULL").groupBy("list_id").agg(F.min("request_id").alias("request_id"))
    rows = lists.withColumn("list_id", norm_key("list_id")).join(known, "list_id", "left").filter("position >= 1")
    key = F.sha2(F.concat_ws("|", "list_id", "product_id", F.col("position").cast("string")), 256)
    return rows.select(key.alias("id"), F.lit("PRODUCT_VIEW").alias("event_type"), "product_id", F.col("kind").alias("recommendation_type"), F.col("request_id").alias("recommendation_request_id"), "position", F.col("at").alias("created_at"))
