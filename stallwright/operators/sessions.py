"""Grouping activity into sessions separated by inactivity.

Rows are range-partitioned on (subject, time), sorted inside each partition (a secondary
sort) and read once: a linear scan that holds one open session and the current Arrow batch.
A subject with very many rows spans several partitions; only the first and last session of
a partition can continue in another one, so at most two rows a partition are stitched
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions.keys import micros, norm_key
from stallwright.storage import default_buckets, materialize

HALF_HOUR_US = 1_800_000_000
_SCAN = "subject string, started_us bigint, ended_us bigint, events bigint, edge boolean"


def _scan(gap_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("subject", pa.string()), ("started_us", pa.int64()), ("ended_us", pa.int64()), ("events", pa.int64()), ("edge", pa.bool_())])
        subject, start, end, count, first = None, 0, 0, 0, True

        def rows(subjects, starts, ends, counts, edges):
            return pa.RecordBatch.from_arrays([pa.array(subjects, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(counts, pa.int64()), pa.array(edges, pa.bool_())], schema=out)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(0).dictionary_encode()
            codes, words = np.asarray(names.indices), names.dictionary
            times = np.asarray(batch.column(1))
            breaks = np.empty(n, bool)
            breaks[0] = subject is None or words[int(codes[0])].as_py() != subject or int(times[0]) - end > gap_us
            breaks[1:] = (codes[1:] != codes[:-1]) | (times[1:] - times[:-1] > gap_us)
            heads = np.flatnonzero(breaks)
            if not heads.size:
                end, count = int(times[-1]), count + n
                continue
            if subject is not None:  # the open session ends before the first break
                if heads[0] > 0:
                    end, count = int(times[heads[0] - 1]), count + int(heads[0])
                yield rows([subject], [start], [end], [count], [first])
                first = False
            tails = np.append(heads[1:], n)
            if heads.size > 1:
                closed = words.take(pa.array(codes[heads[:-1]]))
                edges = np.zeros(heads.size - 1, bool)
                edges[0], first = first, False
                yield pa.RecordBatch.from_arrays([closed, pa.array(times[heads[:-1]]), pa.array(times[tails[:-1] - 1]), pa.array(tails[:-1] - heads[:-1]), pa.array(edges)], schema=out)
            last = int(heads[-1])
            subject, start, end, count = words[int(codes[last])].as_py(), int(times[last]), int(times[-1]), n - last
        if subject is not None:
            yield rows([subject], [start], [end], [count], [True])

    return run


def sessionize(events: DataFrame, gap_us: int = HALF_HOUR_US, partitions: int | None = None) -> DataFrame:
    """Sessions of ``events(subject string, time_us bigint, tie bigint)``.

    Returns ``(subject, started_us, ended_us, duration_us, events)``. A gap of more than
    ``gap_us`` starts a new session. Rows with a null subject or time are left out; equal
    times belong together; ``tie`` only spreads equal rows over partitions. Other columns are
    ignored. An empty input gives no sessions.
    """
    n = partitions or default_buckets(events.sparkSession)
    known = events.select("subject", "time_us", "tie").filter("subject IS NOT NULL AND time_us IS NOT NULL")
    ordered = known.repartitionByRange(n, "subject", "time_us", "tie").sortWithinPartitions("subject", "time_us").select("subject", "time_us")
    pieces = materialize(ordered.mapInArrow(_scan(gap_us), _SCAN), "sessions")
    by_start = W.partitionBy("subject").orderBy("started_us", "ended_us")
    opens = F.coalesce(F.col("started_us") - F.max("ended_us").over(by_start.rowsBetween(W.unboundedPreceding, -1)) > gap_us, F.lit(True))
    stitched = (
        pieces.filter("edge")
        .withColumn("opens", opens.cast("int"))
        .withColumn("part", F.sum("opens").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("subject", "part")
        .agg(F.min("started_us").alias("started_us"), F.max("ended_us").alias("ended_us"), F.sum("events").alias("events"))
    )
    columns = ["subject", "started_us", "ended_us", F.expr("ended_us - started_us").alias("duration_us"), "events"]
    return pieces.filter("NOT edge").select(columns).unionByName(stitched.select(columns))


def unique_events(events: DataFrame, *kept) -> DataFrame:
    """One row per event id: deliveries of one id are one event at its earliest time.

    ``kept`` are columns already brought to one spelling, of which the smallest non-null
    counts should copies differ. Rows without an id are each an event of their own.
    """
    rows = events.select(norm_key("id").alias("event_id"), micros("created_at").alias("time_us"), *kept)
    others = [c for c in rows.columns if c not in ("event_id", "time_us")]
    own = F.when(F.col("event_id").isNull(), F.monotonically_increasing_id()).alias("own")  # spreads rows without an id
    return rows.groupBy("event_id", own).agg(F.min("time_us").alias("time_us"), *(F.min(c).alias(c) for c in others)).drop("own")


def shopper_visits(events: DataFrame, gap_us: int = HALF_HOUR_US) -> DataFrame:
    """Visits of each shopper: the user, or the storefront session where no user is known."""
    subject = F.coalesce(norm_key("user_id"), norm_key("session_id")).alias("subject")
    return sessionize(unique_events(events, subject).withColumn("tie", F.xxhash64("event_id")), gap_us)
