"""References to records that do not exist, from signed counts kept per key and time.

The state has a row per reference field, key and time: how many referring rows name the key
then, how many records that have it date from then. Every change of either table is a
signed delta. Summed over the times, a key with positive references and zero existence is
an orphan; if existence is positive but begins after a reference, that reference came
before its record. Deltas are summed before and after the shuffle, so a key that a third of
all rows name at one time is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stallwright.functions.keys import micros, norm_key
from stallwright.storage import BucketStore, Table, scratch

#: Suspicious keys named by more rows than this share of all references are joined by broadcast; there can't be more than 1 / share.
HOT_SHARE = 0.001


def _deltas(rows: DataFrame, field: str, key: str | Column, time: str | None, refs: int, found: int) -> DataFrame:
    at = F.lit(None).cast("bigint") if time is None else micros(time)
    named = rows.select(F.lit(field).alias("field"), norm_key(key).alias("key"), at.alias("at")).filter("key IS NOT NULL")
    return named.select("field", "key", "at", F.lit(refs).cast("bigint").alias("refs"), F.lit(found).cast("bigint").alias("found"))


def reference_deltas(rows: DataFrame, key: str | Column, sign: int = 1, field: str = "", time: str | None = None) -> DataFrame:
    """``(field, key, at, refs, found)`` from referring rows that were added (+1) or removed (-1). Without time a reference is never early."""
    return _deltas(rows, field, key, time, sign, 0)


def existence_deltas(rows: DataFrame, key: str | Column, sign: int = 1, field: str = "", time: str | None = None) -> DataFrame:
    """``(field, key, at, refs, found)`` from referenced records that appeared (+1) or went (-1). A record without time has always been there."""
    return _deltas(rows, field, key, time, 0, sign)


class ReferenceState:
    """Persistent reference and existence counts, merged from change deltas."""

    def __init__(self, spark, path: str | None = None, buckets: int | None = None):
        self.store = BucketStore(spark, path or scratch(spark, "references"), {"field": "string", "key": "string", "at": "bigint"}, ["refs", "found"], buckets)

    def apply(self, *deltas: DataFrame, source: str | None = None, batch: int | None = None) -> "ReferenceState":
        merged = deltas[0]
        for d in deltas[1:]:
            merged = merged.unionByName(d)
        self.store.apply(merged, source, batch)
        return self

    def failing(self, watch: Observation | None = None) -> DataFrame:
        """``(field, key, refs, first_us)`` of the keys with a reference that fails now: ``first_us`` is null
        if the key does not exist, else the time from which it does, after its first reference.
        ``watch`` sees the number of all references as ``total``."""
        there = F.col("found") > 0
        keys = self.store.read().groupBy("field", "key").agg(
            F.sum("refs").alias("refs"),
            F.sum("found").alias("found"),
            F.max(there & F.col("at").isNull()).alias("always"),
            F.min(F.when(there, F.col("at"))).alias("first_us"),
            F.min(F.when(F.col("refs") > 0, F.col("at"))).alias("named_us"),
        )
        if watch is not None:
            keys = keys.observe(watch, F.coalesce(F.sum("refs"), F.lit(0)).alias("total"))
        bad = keys.filter("refs > 0 AND (found <= 0 OR (NOT always AND first_us > named_us))")
        return bad.select("field", "key", "refs", F.when(F.col("found") > 0, F.col("first_us")).alias("first_us"))

    def orphans(self) -> DataFrame:
        """``(field, key, refs)`` of the keys that are referred to and do not exist now."""
        return self.failing().filter("first_us IS NULL").select("field", "key", "refs")


def distinct_rows(rows: DataFrame, id_column: str, *columns: Column) -> DataFrame:
    """One row per id (repeated rows are one record), with the smallest of each column; rows without an id stay as they are."""
    picked = rows.select(norm_key(id_column).alias("row_id"), *columns)
    own = F.when(F.col("row_id").isNull(), F.monotonically_increasing_id()).alias("own")
    return picked.groupBy("row_id", own).agg(*(F.min(c).alias(c) for c in picked.columns if c != "row_id")).drop("own")


def failed_references(rows: DataFrame, id_column: str, time_column: str, fields: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """``(event_id, ref_field, state, key, time)`` of every reference that fails.

    ``fields`` gives for each reference field the referenced table, its key and, if the order
    in time matters, its time column. ``missing``: no row of the table has the key. ``late``:
    the earliest row that has it is later than the referring row. All fields share one pass
    over ``rows``, one state and one join; each referenced table is read once.

    Null and blank references are no references; a referenced row without key exists for
    none, one without time has always been there; references without time are never late;
    repeated rows count once per id; empty tables on either side give no rows, or every
    reference as missing.
    """
    once = Table(distinct_rows(rows, id_column, *(norm_key(f).alias(f"key_{k}") for k, f in enumerate(fields)), F.col(time_column).alias("time")), "referring").df
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"key_{k}").alias("key")) for k, f in enumerate(fields)))).alias("r")
    refs = once.select("row_id", "time", each).select("row_id", "time", "r.field", "r.key").filter("key IS NOT NULL")
    named = refs.select("field", "key", micros("time").alias("at"), F.lit(1).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("found"))
    state = ReferenceState(rows.sparkSession).apply(named, *(existence_deltas(table, key, 1, f, time) for f, (table, key, time) in fields.items()))
    watch = Observation()
    failing = Table(state.failing(watch), "failing").df
    most = max(1.0, watch.get["total"] * HOT_SHARE)
    hot, cold = failing.filter(F.col("refs") > most).drop("refs"), failing.filter(F.col("refs") <= most).drop("refs")
    joined = refs.join(F.broadcast(hot), ["field", "key"]).unionByName(refs.join(cold.hint("shuffle_merge"), ["field", "key"]))  # at most 1 / HOT_SHARE keys are hot
    bad = joined.filter(F.col("first_us").isNull() | (F.col("first_us") > micros("time")))
    return bad.select(F.col("row_id").alias("event_id"), F.col("field").alias("ref_field"), F.when(F.col("first_us").isNull(), "missing").otherwise("late").alias("state"), "key", "time")


def orphan_report(failed: DataFrame, period: str = "day") -> DataFrame:
    """``(ref_field, period, state, refs, keys)``: failed references per field, period and state; a null time is a period of its own."""
    return failed.groupBy("ref_field", F.date_trunc(period, "time").alias("period"), "state").agg(F.count("*").alias("refs"), F.countDistinct("key").alias("keys"))
