"""An outbox of changes to be worked off in batches, each at least once and with what it changed at most once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.operators.index import SearchIndex
from stallwright.storage import RowStore, Table, scratch


class Outbox:
    """Events kept in a RowStore until they are worked off.

    ``claim`` takes the oldest that are due and counts the attempt in the same commit, so of two
    workers that claim at once one gets ``StoreConflict`` and claims again: no event is handed
    out twice in one attempt. An event that failed too often stays, for a look at it.
    """

    SCHEMA = "event_id string, kind string, key string, created_at timestamp, attempts int, claim string, published boolean, error string"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.store = spark, RowStore(spark, path or scratch(spark, "outbox"), self.SCHEMA, ["event_id"], buckets)

    def emit(self, events: DataFrame) -> "Outbox":
        """Add ``events(event_id, kind, key, created_at)``; an id that is there already is left as it is, one without id gets one of its own content."""
        own = events.select(F.coalesce(norm_key("event_id"), F.sha2(F.concat_ws("|", "kind", "key", F.col("created_at").cast("string")), 256)).alias("event_id"), "kind", norm_key("key").alias("key"), "created_at")
        first = own.groupBy("event_id").agg(F.min(F.struct("created_at", "kind", "key")).alias("e")).select("event_id", "e.*")
        new = first.join(self.store.read().select("event_id"), "event_id", "left_anti")
        self.store.apply(new.select("event_id", "kind", "key", "created_at", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("claim"), F.lit(False).alias("published"), F.lit(None).cast("string").alias("error")))
        return self

    def claim(self, limit: int = 500, most_attempts: int = 5, kinds: list[str] | None = None) -> DataFrame:
        """The events of a new claim, the oldest first; those claimed before and not acknowledged are due again."""
        due = self.store.read().filter(~F.col("published") & (F.col("attempts") < most_attempts))
        due = due if kinds is None else due.filter(F.col("kind").isin(kinds))
        mark = uuid.uuid4().hex
        taken = Table(due.orderBy("created_at", "event_id").limit(limit).withColumn("attempts", F.col("attempts") + 1).withColumn("claim", F.lit(mark)), "claim").df
        self.store.apply(taken)
        return taken

    def acknowledge(self, claimed: DataFrame) -> "Outbox":
        self.store.apply(self._current(claimed).withColumn("published", F.lit(True)).withColumn("error", F.lit(None).cast("string")))
        return self

    def fail(self, claimed: DataFrame, error: str) -> "Outbox":
        self.store.apply(self._current(claimed).withColumn("error", F.lit(error[:500])))
        return self

    def _current(self, claimed: DataFrame) -> DataFrame:
        """The rows of a claim that is still theirs: what another worker has claimed since is not touched."""
        return self.store.read().join(claimed.select("event_id", "claim"), ["event_id", "claim"], "left_semi").select(self.store.columns)

    def depth(self, most_attempts: int = 5) -> dict[str, int]:
        """Events that wait, that were worked off, and that failed too often."""
        waiting, out = ~F.col("published"), F.col("attempts") >= most_attempts
        row = self.store.read().agg(F.count_if(waiting & ~out).alias("waiting"), F.count_if("published").alias("published"), F.count_if(waiting & out).alias("dead")).first()
        return row.asDict()

    def prune(self, before) -> "Outbox":
        """Forget the published events of before that time."""
        self.store.apply(deletes=self.store.read().filter(F.col("published") & (F.col("created_at") < F.lit(before))).select("event_id"))
        return self


def work_index_queue(outbox: Outbox, index: SearchIndex, catalog: DataFrame, limit: int = 500) -> int:
    """Bring the index up to date with one claim of changed products: each once, whatever its events; returns the events worked off.

    Products that the catalog no longer has are taken out. What fails is noted and due again.
    """
    claimed = outbox.claim(limit)
    n = claimed.count()
    if not n:
        return 0
    try:
        ids = claimed.select(F.col("key").alias("product_id")).filter("product_id IS NOT NULL").distinct()
        rows = catalog.join(ids, "product_id", "left_semi")
        index.upsert(rows).remove(ids.join(rows.select("product_id"), "product_id", "left_anti"))
    except Exception as e:
        outbox.fail(claimed, str(e))
        raise
    outbox.acknowledge(claimed)
    return n
