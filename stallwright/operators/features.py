"""One row per entity with a count, the latest time and a total for each event type.

1. Before the shuffle, each Arrow batch is combined in numpy: entities and types become
   indices, one ``bincount`` over ``entity * types + type`` counts, ``maximum.at`` keeps
   the latest time; entities with much of a batch are added up over the whole task. So a
   hot entity sends a few rows a task, whatever it holds.
2. The partial cells are hash-bucketed by entity and sorted; each run of entities becomes
   a dense block, filled by the same two scatters and emitted as Arrow columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key, norm_type
from stallwright.operators.sessions import unique_events

NEVER = np.iinfo(np.int64).min
#: A schema has a column per type, so the number of types has to be bounded; more are an error, never a cut.
MAX_TYPES = 5000
#: Cells of one dense block.
BLOCK_CELLS = 1 << 20
#: An entity with this part of a batch's rows is hot: its cells leave a task once, not once a batch.
HOT_PART = 0.02
_PARTIAL = pa.schema([("entity", pa.string()), ("entity_id", pa.string()), ("kind", pa.int32()), ("n", pa.int64()), ("last_us", pa.int64()), ("total", pa.float64())])


def _scatter(rows: int, types: int, entity, kind, n, last, total):
    """Dense counts, latest times and totals, each ``rows * types`` long."""
    at = entity * types + kind
    size = rows * types
    counts = np.bincount(at, minlength=size) if n is None else np.rint(np.bincount(at, weights=n, minlength=size)).astype(np.int64)
    latest = np.full(size, NEVER, np.int64)
    np.maximum.at(latest, at, last)
    return counts, latest, np.bincount(at, weights=total, minlength=size)


def _cells(names: pa.Array, keys: pa.Array, types: int, counts, latest, totals) -> pa.RecordBatch:
    """The filled cells of dense arrays as partial rows."""
    cells = np.flatnonzero(counts)
    row, times = pa.array(cells // types), latest[cells]
    return pa.RecordBatch.from_arrays([names.take(row), keys.take(row), pa.array((cells % types).astype(np.int32)), pa.array(counts[cells].astype(np.int64)), pa.array(times, mask=times == NEVER), pa.array(totals[cells])], schema=_PARTIAL)


def _combine(entities: list[str], types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: dict[tuple[str, str], tuple] = {}  # dense rows of entities that hold much of a batch, kept for the whole task

        def flush() -> Iterator[pa.RecordBatch]:
            for (entity, key), (counts, latest, totals) in hot.items():
                yield _cells(pa.array([entity]), pa.array([key]), types, counts, latest, totals)
            hot.clear()

        step = max(1, BLOCK_CELLS // max(1, types))
        for batch in batches:
            kind_all, last_all, total_all = batch.column("kind"), batch.column("time_us"), batch.column("value")
            for entity in entities:
                for lo in range(0, batch.num_rows, step):
                    ids = batch.column(entity).slice(lo, step)
                    keep = pc.is_valid(ids)
                    names = ids.filter(keep).dictionary_encode()
                    if not len(names):
                        continue
                    kind = np.asarray(kind_all.slice(lo, step).filter(keep)).astype(np.int64)
                    last = np.asarray(last_all.slice(lo, step).filter(keep).fill_null(NEVER))
                    total = np.asarray(total_all.slice(lo, step).filter(keep).fill_null(0.0))
                    code = np.asarray(names.indices).astype(np.int64)
                    words = names.dictionary
                    counts, latest, totals = (x.reshape(len(words), types) for x in _scatter(len(words), types, code, kind, None, last, total))
                    for k in np.flatnonzero(counts.sum(1) >= max(64, HOT_PART * len(code))).tolist():
                        held = hot.setdefault((entity, words[k].as_py()), (np.zeros(types, np.int64), np.full(types, NEVER, np.int64), np.zeros(types)))
                        held[0][:] += counts[k]
                        np.maximum(held[1], latest[k], out=held[1])
                        held[2][:] += totals[k]
                        counts[k] = 0
                    yield _cells(pa.array([entity]).take(pa.array(np.zeros(len(words), np.int64))), words, types, counts.ravel(), latest.ravel(), totals.ravel())
            if len(hot) * types > BLOCK_CELLS:
                yield from flush()
        yield from flush()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], types: int) -> Iterator[tuple]:
    """Dense blocks from partial cells sorted by entity; the last entity of a block is carried on.

    A block takes at most BLOCK_CELLS // types entities of one batch; what is carried is one
    dense row, so memory doesn't depend on the data.
    """
    most = max(1, BLOCK_CELLS // max(1, types))
    carry = None  # (entity, entity_id, counts, latest, totals)
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, ids = batch.column("entity"), batch.column("entity_id")
        e, i = entity.dictionary_encode(), ids.dictionary_encode()
        ec, ic = np.asarray(e.indices), np.asarray(i.indices)
        new = np.ones(batch.num_rows, bool)
        new[1:] = (ec[1:] != ec[:-1]) | (ic[1:] != ic[:-1])
        heads = np.flatnonzero(new)
        row = np.cumsum(new) - 1
        kind, n = np.asarray(batch.column("kind")).astype(np.int64), np.asarray(batch.column("n"))
        last, total = np.asarray(batch.column("last_us").fill_null(NEVER)), np.asarray(batch.column("total"))
        for lo in range(0, len(heads), most):
            own = heads[lo : lo + most]
            start, stop = int(own[0]), int(heads[lo + most]) if lo + most < len(heads) else batch.num_rows
            part = slice(start, stop)
            counts, latest, totals = (x.reshape(len(own), types) for x in _scatter(len(own), types, row[part] - lo, kind[part], n[part], last[part], total[part]))
            names, keys = entity.take(pa.array(own)), ids.take(pa.array(own))
            if carry is not None:
                if carry[0] == names[0].as_py() and carry[1] == keys[0].as_py():
                    counts[0] += carry[2]
                    latest[0] = np.maximum(latest[0], carry[3])
                    totals[0] += carry[4]
                else:
                    yield pa.array([carry[0]]), pa.array([carry[1]]), carry[2][None], carry[3][None], carry[4][None]
            end = len(own) - 1
            if end:
                yield names.slice(0, end), keys.slice(0, end), counts[:end], latest[:end], totals[:end]
            carry = (names[end].as_py(), keys[end].as_py(), counts[end].copy(), latest[end].copy(), totals[end].copy())
    if carry is not None:
        yield pa.array([carry[0]]), pa.array([carry[1]]), carry[2][None], carry[3][None], carry[4][None]


def _wide(types: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, keys, counts, latest, totals in _blocks(batches, len(types)):
            columns = [names, keys, pa.array(counts.sum(1)), pa.array(best := latest.max(1), mask=best == NEVER)]
            for t in range(len(types)):
                columns += [pa.array(np.ascontiguousarray(counts[:, t])), pa.array(seen := np.ascontiguousarray(latest[:, t]), mask=seen == NEVER), pa.array(np.ascontiguousarray(totals[:, t]))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _long(types: list[str], schema: pa.Schema, least: int):
    words = pa.array(types, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, keys, counts, latest, totals in _blocks(batches, len(types)):
            row, kind = np.nonzero(counts >= least)
            if not row.size:
                continue
            seen = latest[row, kind]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), keys.take(pa.array(row)), words.take(pa.array(kind)), pa.array(counts[row, kind]), pa.array(seen, mask=seen == NEVER), pa.array(totals[row, kind])], schema=schema)

    return run


def type_dictionary(events: DataFrame) -> list[str]:
    """The distinct event types, sorted; at most MAX_TYPES."""
    found = [r[0] for r in events.select(norm_type("event_type").alias("t")).filter("t IS NOT NULL").distinct().limit(MAX_TYPES + 1).collect()]
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types; a feature table can't have a column for each")
    return sorted(found)


def entity_features(events: DataFrame, entities: dict[str, str], layout: str = "wide", least: int = 1, value: str = "$.cart_value") -> DataFrame:
    """Features of each entity from events, an event id counting once.

    ``entities`` names the key column of each kind, as ``{"user": "user_id"}``; ``value`` is
    the JSON path in ``context`` whose numbers are totalled. ``wide`` gives one row per entity:
    ``entity, entity_id, n_events, last_us`` and ``n_<TYPE>, last_us_<TYPE>, total_<TYPE>`` for
    every type. ``long`` gives the cells of that table that count at least ``least`` events.

    Events without time count, and have no latest time; a missing key gives no row of that
    kind; a missing type leaves the event out; broken JSON or a value that is no number adds
    nothing; repeated rows count once; an empty table gives no rows.
    """
    types = type_dictionary(events)
    kinds = events.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "type string, kind int") if types else None
    number = F.expr(f"try_cast(get_json_object(context, '{value}') AS double)")
    rows = events.withColumn("_type", norm_type("event_type")).filter("_type IS NOT NULL")
    if kinds is not None:  # at most MAX_TYPES rows
        rows = rows.join(F.broadcast(kinds.withColumnRenamed("type", "_type").withColumnRenamed("kind", "_kind")), "_type")
    else:
        rows = rows.withColumn("_kind", F.lit(0))
    unique = unique_events(rows, F.col("_kind").alias("kind"), *(norm_key(c).alias(e) for e, c in entities.items()), number.alias("value"))
    partial = unique.select("kind", "time_us", F.col("value").cast("double").alias("value"), *entities).mapInArrow(_combine(list(entities), max(1, len(types))), "entity string, entity_id string, kind int, n bigint, last_us bigint, total double")
    bucketed = partial.repartition("entity", "entity_id").sortWithinPartitions("entity", "entity_id")
    if layout == "long":
        fields = [("entity", pa.string()), ("entity_id", pa.string()), ("event_type", pa.string()), ("n", pa.int64()), ("last_us", pa.int64()), ("total", pa.float64())]
        return bucketed.mapInArrow(_long(types, pa.schema(fields), least), "entity string, entity_id string, event_type string, n bigint, last_us bigint, total double")
    fields = [("entity", pa.string()), ("entity_id", pa.string()), ("n_events", pa.int64()), ("last_us", pa.int64())]
    for t in types:
        fields += [(f"n_{t}", pa.int64()), (f"last_us_{t}", pa.int64()), (f"total_{t}", pa.float64())]
    kind = {pa.string(): "string", pa.int64(): "bigint", pa.float64(): "double"}
    return bucketed.mapInArrow(_wide(types, pa.schema(fields)), ", ".join(f"`{n}` {kind[t]}" for n, t in fields))
