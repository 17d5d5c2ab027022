"""Edge cases of the general operators against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stallwright.operators.attributes import attribute_failures, filled_cells, wide_attributes
from stallwright.operators.features import entity_features
from stallwright.operators.hierarchy import Hierarchy, resolve_hierarchy
from stallwright.operators.references import ReferenceState, existence_deltas, failed_references, orphan_report, reference_deltas
from stallwright.operators.sessions import sessionize, shopper_visits
from stallwright.storage import BucketStore, StoreConflict, scratch

EVENT = "id string, event_type string, user_id string, session_id string, product_id string, context string, created_at timestamp, subject string, kind string"
GAP = 1_800_000_000


def at(us):
    return None if us is None else dt.datetime(2025, 11, 1) + dt.timedelta(microseconds=us)


def event(i, us, user=None, session=None, product=None, kind="PRODUCT_VIEW", context=None):
    return (i, kind, user, session, product, context, at(us), "clash", "clash")


def plain_sessions(rows, gap):
    out, by = [], {}
    for s, t in rows:
        by.setdefault(s, []).append(t)
    for s, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((s, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((s, start, last, n))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_sessions_with_a_hot_subject(spark, partitions):
    rng = random.Random(partitions)
    rows = [("hot" if rng.random() < 0.5 else f"s{rng.randrange(40)}", rng.randrange(0, 40_000)) for _ in range(4000)]
    rows += [("hot", 7)] * 50 + [("lone", 1)]
    df = spark.createDataFrame([(s, t, k) for k, (s, t) in enumerate(rows)], "subject string, time_us bigint, tie bigint")
    got = sorted((r.subject, r.started_us, r.ended_us, r.events) for r in sessionize(df, 100, partitions).collect())
    assert got == plain_sessions(rows, 100)


def test_sessions_across_small_batches(spark):
    rows = [("a", t * 60) for t in range(500)] + [("b", t * 200) for t in range(300)]
    df = spark.createDataFrame([(s, t, k) for k, (s, t) in enumerate(rows)], "subject string, time_us bigint, tie bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.subject, r.started_us, r.ended_us, r.events) for r in sessionize(df, 100, 2).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_sessions(rows, 100)


def test_visits_edges(spark):
    rows = [
        event("1", 0, " U1 "), event("1", 5 * GAP, "u1"),  # two deliveries: the earlier time
        event("2", GAP, "u1"), event("3", 2 * GAP + 1, "U1", "s"),  # exactly the gap, and more
        event("4", 0, None, "S"), event("5", 9, "  ", " s"), event("6", None, "u1"), event("7", 3, None, None),
        event(None, 1, None, "s"), event(" ", 2, None, "s"),
    ]
    got = {(r.subject, r.started_us % (10 * GAP), r.events) for r in shopper_visits(spark.createDataFrame(rows, EVENT)).select("subject", (F.col("started_us") - F.unix_micros(F.lit(at(0)))).alias("started_us"), "events").collect()}
    assert got == {("u1", 0, 2), ("u1", 2 * GAP + 1, 1), ("s", 0, 4)}
    assert shopper_visits(spark.createDataFrame([], EVENT)).count() == 0


def test_features_against_plain(spark):
    rng = random.Random(3)
    rows = [event(f"e{rng.randrange(1500)}", rng.choice([None, rng.randrange(10**9)]), rng.choice([None, "", "Hot", "hot ", f"u{rng.randrange(30)}"]), None, rng.choice([None, "P1", f"p{rng.randrange(9)}"]), f"kind {rng.randrange(4)}") for _ in range(1500)]
    fixed = {}
    rows = [fixed.setdefault(r[0], r)[:6] + r[6:] for r in rows]  # copies agree but in time
    times, first = {}, {}
    for r in rows:
        first[r[0]] = r
        if r[6] is not None:
            times[r[0]] = min(times.get(r[0], r[6]), r[6])
    want = {}
    for i, r in first.items():
        for entity, key in (("user", r[2]), ("product", r[4])):
            key = (key or "").strip().lower()
            if key:
                cell = want.setdefault((entity, key, r[1].replace(" ", "_").upper()), [0, None])
                cell[0] += 1
                if i in times and (cell[1] is None or times[i] > cell[1]):
                    cell[1] = times[i]
    df = spark.createDataFrame(rows, EVENT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        long = entity_features(df, {"user": "user_id", "product": "product_id"}, "long").collect()
        wide = entity_features(df, {"user": "user_id", "product": "product_id"}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    base = int(dt.datetime(2025, 11, 1, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    micro = lambda t: None if t is None else base + round((t - at(0)).total_seconds() * 1e6)
    assert {(r.entity, r.entity_id, r.event_type): (r.n, r.last_us) for r in long} == {k: (n, micro(t)) for k, (n, t) in want.items()}
    assert len(wide) == len({k[:2] for k in want})
    for r in wide:
        assert r.n_events == sum(n for k, (n, _) in want.items() if k[:2] == (r.entity, r.entity_id))
        for k in range(4):
            n, t = want.get((r.entity, r.entity_id, f"KIND_{k}"), (0, None))
            assert (r[f"n_KIND_{k}"], r[f"last_us_KIND_{k}"]) == (n, micro(t))


def test_features_edges(spark):
    empty = spark.createDataFrame([], EVENT)
    assert entity_features(empty, {"user": "user_id"}).count() == 0
    assert entity_features(empty, {"user": "user_id"}, "long").count() == 0
    rows = [event("1", 1, "u", kind=None), event("2", 1, "u", context='{"cart_value": "5"}'), event("3", None, "u", context='{"cart_value": 2.5'), event("4", 2, "u", context='{"cart_value": 2.5}')]
    (r,) = entity_features(spark.createDataFrame(rows, EVENT), {"user": "user_id"}).collect()
    assert (r.n_events, r.total_PRODUCT_VIEW) == (3, 7.5)


REF = "id string, ref string, created_at timestamp, key string, time timestamp, state string"


def test_references(spark):
    refs = [("e1", " K1", at(5)), ("e1", "k1", at(5)), ("e2", "gone", at(5)), ("e3", "", at(5)), ("e4", None, at(5)), ("e5", "late", at(5)), ("e6", "late", at(50)), (None, "gone", at(1)), ("e7", "gone", None), ("e8", "late", None)]
    rows = spark.createDataFrame([(*r, "clash", None, "clash") for r in refs], REF)
    records = spark.createDataFrame([("K1 ", at(9)), ("k1", at(1)), ("late", at(20)), (None, at(0))], "key string, at timestamp")
    got = failed_references(rows, "id", "created_at", {"ref": (records, "key", "at")})
    assert {(r.event_id, r.state) for r in got.collect()} == {("e2", "missing"), ("e5", "late"), (None, "missing"), ("e7", "missing")}
    report = {(r.state, r.refs, r["keys"]) for r in orphan_report(got).collect()}
    assert ("late", 1, 1) in report
    assert failed_references(rows.limit(0), "id", "created_at", {"ref": (records, "key", "at")}).count() == 0
    assert failed_references(rows, "id", "created_at", {"ref": (records.limit(0), "key", "at")}).count() == 7


def test_reference_state_follows_changes(spark):
    one = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    state = ReferenceState(spark).apply(reference_deltas(one("a", "b", "b"), "k"), existence_deltas(one("a"), "k"))
    orphans = lambda: {(r.key, r.refs) for r in state.orphans().collect()}
    assert orphans() == {("b", 2)}
    state.apply(existence_deltas(one("b"), "k"), existence_deltas(one("a"), "k", -1))
    assert orphans() == {("a", 1)}
    state.apply(reference_deltas(one("a"), "k", -1))
    assert orphans() == set()
    again = ReferenceState(spark, state.store.path)  # reopened from its manifest
    assert again.store.version == 3 and {r.key for r in again.store.read().collect()} == {"b"}


def test_references_in_two_fields_and_times(spark):
    rows = spark.createDataFrame([("e1", "a", "x", at(5)), ("e2", "b", " ", at(1)), ("e3", "b", "X ", at(9))], "id string, ref string, key string, created_at timestamp")
    first = spark.createDataFrame([("a", None), ("a", at(90)), ("b", at(4)), ("b", at(7))], "key string, at timestamp")  # of unknown time: it has always been there
    second = spark.createDataFrame([("other",)], "key string")
    got = failed_references(rows, "id", "created_at", {"ref": (first, "key", "at"), "key": (second, "key", None)}).collect()
    assert {(r.event_id, r.ref_field, r.state) for r in got} == {("e2", "ref", "late"), ("e1", "key", "missing"), ("e3", "key", "missing")}


def test_late_references_follow_changes(spark):
    ref = lambda *rows: reference_deltas(spark.createDataFrame(list(rows), "k string, t timestamp"), "k", 1, "f", "t")
    rec = lambda sign, *rows: existence_deltas(spark.createDataFrame(list(rows), "k string, t timestamp"), "k", sign, "f", "t")
    state = ReferenceState(spark).apply(ref(("a", at(5)), ("a", at(8)), ("b", at(5))))
    failing = lambda: {(r.key, r.refs, r.first_us is None) for r in state.failing().collect()}
    assert failing() == {("a", 2, True), ("b", 1, True)}
    state.apply(rec(1, ("a", at(7)), ("a", at(2)), ("b", at(5))))
    assert failing() == set()  # a record of the very time of the reference is in time
    state.apply(rec(-1, ("a", at(2))))
    assert failing() == {("a", 2, False)}


COUNTS = "k string, n bigint"


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), COUNTS)


def store(spark, path, **more):
    return BucketStore(spark, path, {"k": "string"}, ["n"], **more)


def held(s):
    return {r.k: r.n for r in s.read().collect()}


def test_store_goes_on_after_a_writer_died(spark, monkeypatch):
    path = scratch(spark, "test")
    first = store(spark, path).apply(counts(spark, ("a", 1), ("b", 2)))
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):  # dies between its folders and its manifest, and cleans up nothing
        m.setattr(BucketStore, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        first.apply(counts(spark, ("a", 5)))
    after = store(spark, path)
    assert held(after) == {"a": 1, "b": 2}
    after.apply(counts(spark, ("a", 10)))
    assert held(after) == held(store(spark, path)) == {"a": 11, "b": 2}
    assert after.vacuum() and not after.vacuum() and held(after) == {"a": 11, "b": 2}


def test_store_has_one_winner(spark):
    path = scratch(spark, "test")
    store(spark, path).apply(counts(spark, ("a", 1)))
    one, two = store(spark, path), store(spark, path)
    one.apply(counts(spark, ("a", 1)))
    with pytest.raises(StoreConflict):
        two.apply(counts(spark, ("a", 100)))
    assert held(two.refresh()) == {"a": 2} and not two.vacuum()  # the loser left nothing
    assert held(two.apply(counts(spark, ("a", 100)))) == {"a": 102}


def test_store_counts_a_batch_once_and_forgets_old_versions(spark):
    s = store(spark, scratch(spark, "test"))
    for batch in (0, 1, 1, 0, 2):
        s.apply(counts(spark, ("a", 1)), "stream", batch)
    again = store(spark, s.path).apply(counts(spark, ("a", 1)), "stream", 2).apply(counts(spark, ("a", 1)), "other", 0)
    assert held(again) == {"a": 4} and again.version == 4
    assert len([n for n in again._names() if n.startswith("v")]) == 2 == len(again._manifests())
    assert held(again.rebucket(7)) == {"a": 4} and again.buckets == 7 == store(spark, s.path).buckets
    with pytest.raises(ValueError):
        BucketStore(spark, s.path, {"k": "string"}, ["n", "m"])


def test_bucket_store_merges_like_a_counter(spark):
    from collections import Counter

    rng, want = random.Random(5), Counter()
    store = BucketStore(spark, scratch(spark, "test"), {"k": "string"}, ["n"], 3)
    for _ in range(3):
        batch = [(rng.choice([None, "a", "b", "c", "d"]), rng.randrange(-3, 4)) for _ in range(20)]
        for k, n in batch:
            want[k] += n
        store.apply(spark.createDataFrame(batch, "k string, n bigint"))
    store.apply(spark.createDataFrame([], "k string, n bigint"))
    assert {r.k: r.n for r in store.read().collect()} == {k: n for k, n in want.items() if n}


DEFS = "id string, code string, name string, value_type string, unit string"
OPTS = "id string, definition_id string, slug string, label string"
ROWS = "variant_id string, definition_id string, option_id string, value_text string, slug string, value string"


def attributes(spark, rows):
    defs = spark.createDataFrame([("c", "color", "Colour", "COLOR", None), ("w", "weight", "Weight", "NUMBER", "g"), ("b", "gift", "Gift", "BOOLEAN", None), ("t", "note", "Note", "TEXT", None)], DEFS)
    opts = spark.createDataFrame([("o1", "c", "oak-frame", "Oak Frame"), ("o2", "c", "black", "Black"), ("o3", "x", "other", "Other")], OPTS)
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS), defs, opts


def test_attributes(spark):
    rows = [
        ("V1", "c", "O1 ", "??"), ("v1 ", "C", None, " oak__frame"),  # by option, by loose name: they agree
        ("v2", "c", "o3", "BLACK"), ("v2", "w", None, "0043.50 G"),  # option of another definition
        ("v3", "w", None, "1,000"), ("v3", "w", None, "000"), ("v3", "b", None, "Y"), ("v3", "b", None, "0"),
        ("v4", "t", None, "  Two  Words "), ("v4", "t", None, None), ("v4", "nope", None, "x"), (None, "c", None, "black"), ("v5", "w", None, ".5"),
        ("v6", "w", None, "9" * 40),
    ] + [("v7", "c", None, "black")] * 50
    wide = wide_attributes(*attributes(spark, rows))
    assert {tuple(r) for r in filled_cells(wide).collect()} == {("v1", "c", "oak-frame"), ("v2", "c", "black"), ("v2", "w", "43.5"), ("v3", "w", "0"), ("v4", "t", "two words"), ("v6", "w", "9" * 40), ("v7", "c", "black")}
    by = {r.variant_id: r for r in wide.collect()}
    assert float(by["v2"].a_weight) == 43.5 and by["v3"].a_gift is None and by["v3"].conflicts == ["b"]
    assert by["v3"].failures == {"w": 1} and by["v5"].failures == {"w": 1}
    assert by["v6"].a_weight is None and by["v6"].failures == {"w": 1}
    assert {(r.variant_id, r.raw, r.reason) for r in attribute_failures(*attributes(spark, rows)).collect()} == {("v3", "1,000", "unreadable"), ("v4", None, "unreadable"), ("v5", ".5", "unreadable"), ("v4", "x", "unknown")}
    assert wide_attributes(*attributes(spark, rows[:1])).limit(0).count() == 0
    empty = attributes(spark, rows)
    assert wide_attributes(empty[0].limit(0), empty[1], empty[2]).count() == 0
    assert wide_attributes(empty[0], empty[1].limit(0), empty[2].limit(0)).count() == 0


def plain_tree(rows):
    parent = {}
    for s, p in rows:
        s, p = (s or "").strip().lower(), (p or "").strip().lower() or None
        if s:
            parent[s] = min(filter(None, (parent.get(s), p)), default=None)
    out = {}
    for s in parent:
        chain, seen = [s], {s}
        while (p := parent[chain[-1]]) in parent and p not in seen:
            chain.append(p)
            seen.add(p)
        if p in seen:
            ring = chain[chain.index(p) :]
            out[s] = (None, min(ring), -1)
        else:
            out[s] = (chain[-1], "/".join(reversed(chain)), len(chain) - 1)
    return out


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_hierarchy_against_plain(spark, monkeypatch, one_task):
    from stallwright.operators import hierarchy

    monkeypatch.setattr(hierarchy, "ONE_TASK", one_task)

    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    monkeypatch.setattr(hierarchy, "FAMILY", 20)
    rng = random.Random(11)
    rows = [(f"n{k}", f"n{rng.randrange(k)}" if k and rng.random() < 0.9 else None) for k in range(200)]
    rows += [(f"deep{k}", f"deep{k - 1}" if k else "n3") for k in range(70)] + [(f"wide{k}", "N5 ") for k in range(90)]
    rows += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("tail1", "r2"), ("tail2", "tail1"), ("self", "self"), ("lost", "unknown"), (" N7", rows[7][1]), (None, "n1"), ("", "n1"), ("blank", " ")]
    df = spark.createDataFrame([(s, p, 1) for s, p in rows], "slug string, parent string, depth int")
    want = plain_tree(rows)
    assert {r.slug: (r.root, r.path, r.depth) for r in resolve_hierarchy(df).collect()} == want
    pairs = {(r.ancestor, r.descendant, r.distance) for r in Hierarchy(df).descendants().collect()}
    names = {s: path.split("/") for s, (_, path, d) in want.items() if d >= 0}
    assert pairs == {(a, s, len(p) - 1 - k) for s, p in names.items() for k, a in enumerate(p[:-1])}


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_hierarchy_edges(spark, monkeypatch, one_task):
    from stallwright.operators import hierarchy

    monkeypatch.setattr(hierarchy, "ONE_TASK", one_task)
    schema = "slug string, parent string"
    assert resolve_hierarchy(spark.createDataFrame([], schema)).count() == 0
    only = resolve_hierarchy(spark.createDataFrame([("a", "b"), ("b", "a")], schema)).collect()
    assert {(r.slug, r.path, r.depth) for r in only} == {("a", "a", -1), ("b", "a", -1)}
