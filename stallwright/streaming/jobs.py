"""The engine's tables kept by Structured Streaming over files that keep arriving.

All state is Spark's own or lies in the shared folder; a restarted query goes on from its
checkpoint.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stallwright.functions.keys import norm_key, norm_type
from stallwright.operators.recommend import EVENT_WEIGHTS, HALF_LIFE_DAYS
from stallwright.operators.references import ReferenceState, existence_deltas, reference_deltas
from stallwright.operators.sessions import HALF_HOUR_US
from stallwright.storage import StoreConflict

DAY_US = 86_400_000_000


def event_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """New parquet files of ``folder``; the schema is fixed, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def unique_stream(events: DataFrame, late: str = "1 day", *more) -> DataFrame:
    """Each event id once within the watermark, with ``more`` columns; later copies of an id arrive too late to count."""
    rows = events.select(*more, norm_key("id").alias("event_id"), F.col("created_at").alias("time"), norm_type("event_type").alias("kind"), F.coalesce(norm_key("user_id"), norm_key("session_id")).alias("subject"), norm_key("product_id").alias("product_id"), norm_key("source").alias("source"))
    return rows.filter("event_id IS NOT NULL AND time IS NOT NULL").withWatermark("time", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_rollup(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events, views and purchases per UTC day and source; a day is final once the watermark has passed it."""
    return unique_stream(events, late).groupBy(F.window("time", "1 day"), "source").agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "PRODUCT_VIEW").alias("views"), F.count_if(F.col("kind") == "PURCHASE").alias("purchases")).select(F.to_date("window.start").alias("day"), "source", "events", "views", "purchases")


def visits(events: DataFrame, gap_us: int = HALF_HOUR_US, late: str = "1 day") -> DataFrame:
    """Visits by Spark's own session windows, emitted when the watermark has passed their end. As in the batch operator, only a gap of more than ``gap_us`` starts a new one."""
    return unique_stream(events, late).filter("subject IS NOT NULL").groupBy(F.session_window("time", f"{gap_us} microseconds"), "subject").agg(F.count("*").alias("events"), F.min("time").alias("started"), F.max("time").alias("ended")).select("subject", "started", "ended", "events")


def interest(events: DataFrame) -> DataFrame:
    """``(subject, dimension, key, weight, signals)`` after each batch: interest in products, brands and categories that halves every two weeks and never falls below zero.

    The floor makes the result depend on order, so a key's events are folded by time, in state
    of constant size.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, at, signals = state.get if state.exists else (0.0, 0, 0)
        # 16 bytes an event are held of a key's events in one batch, whose size the trigger bounds
        parts = [(f["us"].to_numpy("int64"), f["kind"].map(EVENT_WEIGHTS).to_numpy("float64")) for f in frames]
        at_us, adds = (np.concatenate(x) for x in zip(*parts))
        for k in np.argsort(at_us, kind="stable").tolist():
            us, add = int(at_us[k]), float(adds[k])
            if signals and us > at:
                weight *= 0.5 ** ((us - at) / (HALF_LIFE_DAYS * DAY_US))
            elif signals and us < at:  # a late event counts by its age
                add *= 0.5 ** ((at - us) / (HALF_LIFE_DAYS * DAY_US))
            weight, at, signals = max(0.0, weight + add), max(int(us), at), signals + 1
        state.update((float(weight), int(at), int(signals)))
        yield pd.DataFrame([(*key, weight, signals)], columns=["subject", "dimension", "key", "weight", "signals"])

    own = unique_stream(events, "1 day", norm_key("brand_id").alias("brand_id"), norm_key("category_id").alias("category_id"))
    axes = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).alias("key")) for d, c in (("PRODUCT", "product_id"), ("BRAND", "brand_id"), ("CATEGORY", "category_id"))))
    rows = own.filter(F.col("subject").isNotNull() & F.col("kind").isin(list(EVENT_WEIGHTS))).select("subject", F.explode(axes).alias("d"), "kind", F.unix_micros("time").alias("us")).select("subject", "d.dimension", "d.key", "kind", "us").filter("key IS NOT NULL")
    return rows.groupBy("subject", "dimension", "key").applyInPandasWithState(fold, "subject string, dimension string, key string, weight double, signals bigint", "weight double, at bigint, signals bigint", "update", GroupStateTimeout.NoTimeout)


class OrphanFollower:
    """Keeps a ReferenceState from streams of added rows by ``foreachBatch``.

    The state's manifest records with the counts which batch of which stream they hold (a
    stream is named by its checkpoint), so a batch that is replayed after a restart, by this
    follower or a new one over the same state, changes nothing. Streams that share a state
    take turns; a writer elsewhere makes a batch start again from the version it left.
    """

    TRIES = 20

    def __init__(self, state: ReferenceState):
        self.state, self.lock = state, threading.Lock()

    def _apply(self, name: str, batch: int, deltas: DataFrame) -> None:
        with self.lock:
            for attempt in range(self.TRIES):
                self.state.store.refresh()
                try:
                    self.state.apply(deltas, source=name, batch=batch)
                    return
                except StoreConflict:
                    if attempt == self.TRIES - 1:
                        raise

    def _follow(self, rows: DataFrame, checkpoint: str, deltas):
        return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, k: self._apply(checkpoint, k, deltas(df))).start()

    def follow_references(self, rows: DataFrame, field: str, checkpoint: str, time: str | None = None):
        return self._follow(rows, checkpoint, lambda df: reference_deltas(df, field, 1, field, time))

    def follow_records(self, rows: DataFrame, key: str, checkpoint: str, field: str, time: str | None = None):
        """Records with ``key``, to which the references in ``field`` point."""
        return self._follow(rows, checkpoint, lambda df: existence_deltas(df, key, 1, field, time))
