"""Shared-folder tables: cutting lineage and keeping bucketed state.

Everything is written below the folder the cluster names in ``spark.checkpoint.dir``.
Only a local master may fall back to a folder of this machine.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; unset on a cluster is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        existing = sc._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            folder = existing.get()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _FALLBACK.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="stallwright-"))
    return f"{folder.rstrip('/')}/stallwright-{sc.applicationId}"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may have ended before this process
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, path)
    return path


def sweep(spark: SparkSession, older_than_s: float) -> int:
    """Remove this application's scratch folders last written before that; for sessions that run many queries and are done with the old ones."""
    fs, root = _fs(spark, shared_dir(spark))
    oldest = time.time() - older_than_s
    gone = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() / 1000 < oldest] if fs.exists(root) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)


class Table:
    """A DataFrame written once to the shared folder; reading it back has no lineage.

    Aggregates given as ``seen`` are taken while it is written, and kept by name in ``self.seen``.
    """

    def __init__(self, df: DataFrame, name: str, **seen: Column):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        watch = Observation()
        watched = df.observe(watch, *(c.alias(n) for n, c in seen.items())) if seen else df
        watched.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.seen: dict = watch.get if seen else {}
        if set(self.seen) != set(seen):  # a plan without rows may have lost the watch
            self.seen = self.df.agg(*(c.alias(n) for n, c in seen.items())).first().asDict()

    def drop(self) -> None:
        delete(self.spark, self.path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and the
    files survive the loss of any executor."""
    return Table(df, name).df


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class StoreConflict(RuntimeError):
    """Another writer committed the version this one was about to commit; reopen the store and apply again."""


class _Versions:
    """A table in hash buckets whose changes are new versions of the buckets they touch.

    Changed buckets are written to a folder of a name never used before. A manifest then
    names the current folder of each bucket. It appears by a rename that fails if that
    version exists, so

    * a writer that dies leaves the former version in force, and what it left behind stops
      nobody (``vacuum`` removes it);
    * of two writers of one version only one wins, the other gets ``StoreConflict``;
    * a batch named by ``source`` and ``batch`` is recorded in the manifest that holds its
      effect, and applying it again changes nothing: a replayed stream counts once.

    The last ``keep`` versions stay readable; what only older ones used is removed. Buckets are
    ``pmod(hash(keys), buckets)``, which is also how Spark hash-partitions by the keys, so
    each task writes whole buckets. ``rebucket`` changes their number. Within a bucket rows
    are sorted by ``sorted_by``, so that filters on those columns skip most of a file.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int | None, keep: int, sorted_by: tuple[str, ...]):
        self.spark, self.path, self.schema, self.key_names, self.keep, self.sorted_by = spark, path.rstrip("/"), schema, keys, keep, sorted_by
        self._load(buckets)

    def refresh(self):
        """Go on from the version now in force, which may be another writer's."""
        self._load()
        return self

    def _load(self, buckets: int | None = None) -> None:
        names = self._manifests()
        held = json.loads(self._text(names[-1])) if names else {}
        if held and held["schema"] != self.schema:
            raise ValueError(f"{self.path} holds ({held['schema']}), not ({self.schema})")
        self.version: int = held.get("version", 0)
        self.buckets: int = held.get("buckets") or buckets or default_buckets(self.spark)
        self.places: dict[int, str] = {int(b): p for b, p in held.get("places", {}).items()}
        self.applied: dict[str, int] = held.get("applied", {})

    def _names(self, folder: str = "") -> list[str]:
        fs, where = _fs(self.spark, f"{self.path}/{folder}".rstrip("/"))
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names() if n.startswith("manifest-")]

    def _text(self, name: str) -> str:
        fs, where = _fs(self.spark, f"{self.path}/{name}")
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, kept: dict[int, str], counts: DataFrame, applied: dict[str, int], buckets: int) -> None:
        """Write ``counts`` and name its folders beside those kept, as the next version."""
        folder = f"v{self.version + 1:012d}-{uuid.uuid4().hex}"
        try:
            self._publish(kept | self._write(counts, buckets, folder), applied, buckets)
        except Exception:
            _delete_quietly(self.spark, f"{self.path}/{folder}")
            raise
        self._forget()

    def _publish(self, places: dict[int, str], applied: dict[str, int], buckets: int) -> None:
        jvm, version = self.spark._jvm, self.version + 1
        text = json.dumps({"version": version, "schema": self.schema, "buckets": buckets, "places": places, "applied": applied})
        fs, draft = _fs(self.spark, f"{self.path}/.draft-{uuid.uuid4().hex}")
        _, final = _fs(self.spark, f"{self.path}/manifest-{version:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without overwriting
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), plain)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise StoreConflict(f"version {version} of {self.path} is another writer's") from e
            raise
        self.version, self.places, self.applied, self.buckets = version, places, applied, buckets

    def _forget(self) -> None:
        """Remove the manifests before the last ``keep``, and the bucket folders that only they named."""
        names = self._manifests()
        old, kept = names[: -self.keep], names[-self.keep :]
        used = {p for n in kept for p in json.loads(self._text(n))["places"].values()}
        folders = {p.rpartition("/")[0] for p in used}
        for n in old:
            for place in set(json.loads(self._text(n))["places"].values()) - used:
                folder = place.rpartition("/")[0]
                _delete_quietly(self.spark, place if folder in folders else folder)
            _delete_quietly(self.spark, f"{self.path}/{n}")

    def vacuum(self) -> list[str]:
        """Remove every folder and draft that no manifest names: what writers that died left. No writer may be at work."""
        used = {p for n in self._manifests() for p in json.loads(self._text(n))["places"].values()}
        gone = []
        for name in self._names():
            if name.startswith(".draft-"):
                gone.append(name)
            elif name.startswith("v"):
                gone += [f"{name}/{b}" for b in self._names(name) if b.startswith("bucket=") and f"{self.path}/{name}/{b}" not in used]
                if not any(p.startswith(f"{self.path}/{name}/") for p in used):
                    gone.append(name)
        for name in gone:
            _delete_quietly(self.spark, f"{self.path}/{name}")
        return gone

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The current counters, of all buckets or of those named."""
        wanted = None if buckets is None else set(buckets)
        paths = [self.places[b] for b in sorted(self.places) if wanted is None or b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, counts: DataFrame, buckets: int, folder: str) -> dict[int, str]:
        """The folders of the buckets written; tasks already hold whole buckets if Spark's partitions are as many."""
        rows = counts.select(*counts.columns, self._bucket(buckets))
        if buckets != default_buckets(self.spark):
            rows = rows.repartition(buckets, "bucket")
        if self.sorted_by:
            rows = rows.sortWithinPartitions("bucket", *self.sorted_by)
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return {int(n.split("=")[1]): f"{self.path}/{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}

    def holds(self, source: str, batch: int) -> bool:
        """Whether that batch of a source is in the counts."""
        return self.applied.get(source, -1) >= batch

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.hash(*self.key_names), F.lit(buckets)).alias("bucket")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["bucket"] for r in rows.select(self._bucket(self.buckets)).distinct().collect()]  # at most one row a bucket

    def _replace(self, touched: list[int], rows: DataFrame, source: str | None, batch: int | None) -> None:
        kept = {b: p for b, p in self.places.items() if b not in set(touched)}  # a bucket left without rows has no folder now
        self._commit(kept, rows, self.applied | ({} if source is None else {source: batch}), self.buckets)

    def rebucket(self, buckets: int):
        """The same rows in another number of buckets."""
        self._commit({}, self.read(), self.applied, buckets)
        return self


class BucketStore(_Versions):
    """A persistent table of additive counters, split into hash buckets by its keys.

    ``apply(deltas)`` adds signed deltas: it reads only the buckets that hold a changed
    key, merges and drops rows whose counters are all zero. Nulls among the keys form a key
    of their own; null deltas count as zero; an empty delta leaves the store as it was.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], counters: list[str], buckets: int | None = None, keep: int = 2, sorted_by: tuple[str, ...] = ()):
        self.keys, self.counters = keys, counters
        super().__init__(spark, path, ", ".join([*(f"{k} {t}" for k, t in keys.items()), *(f"{c} bigint" for c in counters)]), list(keys), buckets, keep, sorted_by)

    def apply(self, deltas: DataFrame, source: str | None = None, batch: int | None = None) -> "BucketStore":
        """Add the deltas; with ``source`` and ``batch`` (growing numbers) once only."""
        if source is not None and self.holds(source, batch):
            return self
        keys, totals = list(self.keys), [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in self.counters]
        changes, touched, staged = deltas.select(*keys, *self.counters), [], None
        if self.places:
            staged = Table(changes.groupBy(*keys).agg(*totals), "deltas")
            touched = self._touched(staged.df)
            changes = staged.df.unionByName(self.read(touched))
        merged = changes.groupBy(*keys).agg(*totals).filter(" OR ".join(f"{c} <> 0" for c in self.counters))
        self._replace(touched, merged, source, batch)
        if staged is not None:
            staged.drop()
        return self


class RowStore(_Versions):
    """A persistent table of rows by key, of which a change replaces or removes some.

    ``apply(upserts, deletes)`` rewrites only the buckets that hold a changed key. Both
    have one row per key; a key in both stays; rows without key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int | None = None, keep: int = 2, sorted_by: tuple[str, ...] = ()):
        super().__init__(spark, path, schema, keys, buckets, keep, sorted_by)
        self.columns = spark.createDataFrame([], schema).columns

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, source: str | None = None, batch: int | None = None) -> "RowStore":
        if upserts is None and deletes is None or source is not None and self.holds(source, batch):
            return self
        keys, there = self.key_names, " AND ".join(f"{k} IS NOT NULL" for k in self.key_names)
        nothing = self.spark.createDataFrame([], self.schema)
        new = (nothing if upserts is None else upserts.select(*self.columns)).filter(there)
        staged, gone = Table(new, "upserts"), None
        changed = staged.df.select(*keys)
        if deletes is not None:
            gone = Table(deletes.select(*keys).filter(there), "deletes")
            changed = changed.unionByName(gone.df).distinct()
        touched = self._touched(changed) if self.places else []
        rows = staged.df if not touched else staged.df.unionByName(self.read(touched).join(changed, keys, "left_anti").select(*self.columns))
        self._replace(touched, rows.repartition(*keys) if self.buckets == default_buckets(self.spark) else rows, source, batch)
        staged.drop()
        if gone is not None:
            gone.drop()
        return self
