"""Streams over the smallest tables give what the batch operators give."""

from pyspark.sql import functions as F

from stallwright.operators.references import ReferenceState
from stallwright.sources.domain import behaviour
from stallwright.streaming import jobs


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def parts(spark, data, tmp_path, name, n=2):
    df = spark.read.parquet(f"{data}/{name}.parquet")
    df.orderBy("created_at").repartition(n).write.parquet(str(tmp_path / name))
    return jobs.event_stream(spark, str(tmp_path / name), df.schema, 1)


def test_daily_rollup(spark, data, tmp_path):
    got = run(jobs.daily_rollup(parts(spark, data, tmp_path, "analytics_events"), "400 days"), "rollup", "complete")
    want = behaviour(spark, data).filter("event_id IS NOT NULL AND time_us IS NOT NULL")
    assert got.agg(F.sum("events")).first()[0] == want.count()
    assert got.agg(F.sum("purchases")).first()[0] == want.filter("kind = 'PURCHASE'").count()


def test_interest_state(spark, data, tmp_path):
    got = run(jobs.interest(parts(spark, data, tmp_path, "analytics_events")), "interest", "update")
    assert got.filter("weight < 0").count() == 0 and {r.dimension for r in got.filter("signals > 0").select("dimension").distinct().collect()} == {"PRODUCT", "BRAND", "CATEGORY"}


def test_orphans_follow_streams(spark, data, tmp_path):
    state = ReferenceState(spark)
    follower = jobs.OrphanFollower(state)
    events, logs = parts(spark, data, tmp_path, "search_events"), parts(spark, data, tmp_path, "search_query_logs")
    both = [follower.follow_references(events, "search_log_id", str(tmp_path / "c1"), "created_at"), follower.follow_records(logs, "id", str(tmp_path / "c2"), "search_log_id", "created_at")]
    for query in both:  # two streams at once over one state
        query.awaitTermination()
        assert query.exception() is None
    rows, records = spark.read.parquet(f"{data}/search_events.parquet"), spark.read.parquet(f"{data}/search_query_logs.parquet")
    whole = ReferenceState(spark).apply(jobs.reference_deltas(rows, "search_log_id", 1, "search_log_id", "created_at"), jobs.existence_deltas(records, "id", 1, "search_log_id", "created_at"))
    want = {tuple(r) for r in whole.failing().collect()}
    assert {tuple(r) for r in state.failing().collect()} == want != set()
    again = jobs.OrphanFollower(ReferenceState(spark, state.store.path))  # restarted, and the batches come again
    for batch in (0, 1):
        again._apply(str(tmp_path / "c1"), batch, jobs.reference_deltas(rows, "search_log_id", 1, "search_log_id", "created_at"))
    assert {tuple(r) for r in again.state.failing().collect()} == want


def test_visits_as_in_batch(spark, tmp_path):
    half, base = 1_800_000_000, 1_760_000_000_000_000
    rows = [("a", base), ("b", base + half), ("c", base + 2 * half + 1), ("z", base + 10_000 * half)]  # gaps of half an hour and of a microsecond more, and what moves the watermark
    columns = "id string, event_type string, user_id string, session_id string, product_id string, source string, s bigint"
    df = spark.createDataFrame([(i, "SEARCH", "u" if i != "z" else "v", None, None, None, t) for i, t in rows], columns).select("id", "event_type", "user_id", "session_id", "product_id", "source", F.timestamp_micros("s").alias("created_at"))
    for part in (df.filter("id <> 'z'"), df.filter("id = 'z'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = run(jobs.visits(jobs.event_stream(spark, str(tmp_path / "events"), df.schema, 1)), "visits", "append")
    assert sorted((r.subject, r.events) for r in got.collect()) == [("u", 1), ("u", 2)]
