"""Ordered folds over keys of any size: ledgers, rate limits, interest with a floor.

Where each step depends on the one before, rows are hash-partitioned by key, sorted by time
inside each partition and read once in Arrow batches; what is held is the state of one key
and the current batch, so a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.storage import materialize

# The movements of a ledger, by what they change and in which direction.
STOCK_IN, STOCK_OUT = ["STOCK_IN", "RETURN", "ADJUST_UP"], ["STOCK_OUT", "SALE", "ADJUST_DOWN"]
RESERVE, RELEASE = "RESERVED", "RELEASED"


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]], result: str) -> DataFrame:
    """``rows``' keys and order columns with what ``step`` gives for each, in order.

    ``step(state, values of columns)`` gives the new state and the output of the row, whose
    columns are the DDL ``result``; ``start()`` is the state of a key before its first row.
    """
    kept = [*keys, *order, *columns]
    ordered = rows.select(*kept).repartition(*keys).sortWithinPartitions(*keys, *order)
    own = ordered.select(*keys, *order).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), result])
    names = [c.split()[0] for c in result.split(", ")]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = list(zip(*(batch.column(k).to_pylist() for k in range(n))))
            values = list(zip(*(batch.column(k).to_pylist() for k in range(n + len(order), len(kept)))))
            out = []
            for key, value in zip(ids, values):
                if key != at:
                    at, state = key, start()
                state, given = step(state, value)
                out.append(given)
            made = pa.table({c: list(x) for c, x in zip(names, zip(*out))})
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n + len(order))), *(made[c].combine_chunks() for c in names)], names=[*kept[: n + len(order)], *names])

    return ordered.mapInArrow(run, schema)


def placed(rows: DataFrame, group: list[str], order: list[Column], slices: int = 64) -> DataFrame:
    """``rows`` with their ``rank`` in the group, all of them. A group of any size is ranked by many tasks:
    range partitions in the order, numbered each by itself, then moved up by what stands before them."""
    ordered = rows.repartitionByRange(slices, *(F.col(c) for c in group), *order).sortWithinPartitions(*group, *order).withColumn("_part", F.spark_partition_id())
    kept = materialize(ordered, "ordered")
    within = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    before = kept.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(W.partitionBy(*group).orderBy("_part")) - F.col("_n")).drop("_n")
    return kept.withColumn("_within", within).join(before, [*group, "_part"]).withColumn("rank", (F.col("_within") + F.col("_before")).cast("int")).drop("_within", "_before", "_part")


def ledger(movements: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every movement of ``movements(*keys, *order, op, quantity, reference)`` with ``outcome, stock, reserved`` after it.

    A movement is APPLIED or not: REPEATED if its operation and reference were applied before
    (a null reference never is), INVALID without a known operation or a positive quantity,
    SHORT if more would leave or be reserved than is available, or be released than is
    reserved. What isn't applied changes nothing, so order matters; ``order`` must be unique
    within a key. The references seen of a key come from a window before, not from the fold.
    """
    again = W.partitionBy(*keys, "op", "reference").orderBy(*order)
    marked = movements.withColumn("again", F.col("reference").isNotNull() & (F.row_number().over(again) > 1))

    def step(state, row):
        (stock, reserved), (op, quantity, repeated) = state, row
        known = op in STOCK_IN or op in STOCK_OUT or op in (RESERVE, RELEASE)
        if not known or quantity is None or quantity <= 0:
            outcome = "INVALID"
        elif repeated:
            outcome = "REPEATED"
        elif (op in STOCK_OUT or op == RESERVE) and quantity > stock - reserved or op == RELEASE and quantity > reserved:
            outcome = "SHORT"
        else:
            outcome = "APPLIED"
            stock += quantity if op in STOCK_IN else -quantity if op in STOCK_OUT else 0
            reserved += quantity if op == RESERVE else -quantity if op == RELEASE else 0
        return (stock, reserved), (outcome, stock, reserved)

    return ordered_fold(marked, keys, order, ["op", "quantity", "again"], lambda: (0, 0), step, "outcome string, stock bigint, reserved bigint")


def balances(applied: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``(*keys, stock, reserved, available, movements, refused)``: what each key has after its last movement."""
    last = F.max_by(F.struct("stock", "reserved"), F.struct(*order))
    rows = applied.groupBy(*keys).agg(last.alias("l"), F.count("*").alias("movements"), F.count_if(F.col("outcome") != "APPLIED").alias("refused"))
    return rows.select(*keys, "l.stock", "l.reserved", F.greatest(F.lit(0), F.col("l.stock") - F.col("l.reserved")).alias("available"), "movements", "refused")


def replayed(applied: DataFrame, movements: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``(*keys, summed)``: the stock as the sum of what was applied, without reservations; to be held against the stored one."""
    joined = applied.filter("outcome = 'APPLIED'").select(*keys, *order).join(movements, [*keys, *order])
    sign = F.when(F.col("op").isin(STOCK_IN), F.col("quantity")).when(F.col("op").isin(STOCK_OUT), -F.col("quantity")).otherwise(0)
    return joined.groupBy(*keys).agg(F.sum(sign).cast("bigint").alias("summed"))


def broken_entries(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Entries of a stored ledger ``(before, change, after)`` that don't add up, go below zero, or don't start where the one before ended."""
    last = F.lag("after").over(W.partitionBy(*keys).orderBy(*order))
    return entries.withColumn("_last", last).filter((F.col("before") + F.col("change") != F.col("after")) | (F.col("after") < 0) | (F.col("_last").isNotNull() & (F.col("_last") != F.col("before")))).drop("_last")


def rate_limited(hits: DataFrame, key: str, time_us: str, tie: str, limit: int, window_us: int) -> DataFrame:
    """``(key, time, tie, allowed, used)`` of every hit: at most ``limit`` in a window that opens with the first hit after the last one closed."""

    def step(state, row):
        opened, used = state
        (at,) = row
        if opened is None or at - opened >= window_us:
            opened, used = at, 0
        used += 1
        return (opened, used), (used <= limit, used)

    rows = hits.filter(F.col(key).isNotNull() & F.col(time_us).isNotNull()).withColumn("_at", F.col(time_us))
    return ordered_fold(rows, [key], [time_us, tie], ["_at"], lambda: (None, 0), step, "allowed boolean, used bigint")


def floored_sums(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``(*keys, total, signals)`` of values added in order, never falling below zero on the way.

    In closed form: the sum less the lowest running sum below zero. Sums within slices of the
    order and their own lows come first, so a key of any size is folded by many tasks.
    """
    part = F.floor(F.col("_n") / 4096)
    numbered = placed(rows, keys, [F.asc(c) for c in order]).withColumn("_n", F.col("rank") - 1).withColumn("_part", part)
    run = F.sum(value).over(W.partitionBy(*keys, "_part").orderBy("_n"))
    parts = numbered.withColumn("_run", run).groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"), F.min("_run").alias("_low"), F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    sums = parts.withColumn("_low", before + F.col("_low")).groupBy(*keys).agg(F.sum("_sum").alias("_sum"), F.least(F.lit(0.0), F.min("_low")).alias("_low"), F.sum("_k").alias("signals"))
    return sums.select(*keys, F.round(F.col("_sum") - F.col("_low"), 6).alias("total"), "signals")


def retained(rows: DataFrame, time: str, days: float, batch_of: str | None = None) -> DataFrame:
    """``rows`` not older than ``days`` before the latest; those without time stay."""
    now = rows.agg(F.max(time).alias("_now"))  # one row
    return rows.crossJoin(now).filter(F.col(time).isNull() | (F.unix_micros(time) >= F.unix_micros("_now") - F.lit(int(days * 86_400_000_000)))).drop("_now")
