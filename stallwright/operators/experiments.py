"""Experiments and configurations: who sees which variant, which weights are in force."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwright.functions.text import fnv1a
from stallwright.storage import RowStore, scratch


def variant(subject: Column, variants: list[tuple[str, float]]) -> Column:
    """The variant of a subject: its hash modulo 100 against the running sum of weights; null for what lies beyond the last, and for no subject."""
    bucket, upto, out = fnv1a(subject) % 100, 0.0, F.lit(None).cast("string")
    cases = []
    for name, weight in variants:
        upto += weight
        cases.append((upto, name))
    for end, name in reversed(cases):
        out = F.when(bucket < end, F.lit(name)).otherwise(out)
    return F.when(subject.isNotNull(), out)


def spread_variant(subject: Column, variants: list[tuple[str, float]]) -> Column:
    """The variant of a subject over all weights, whatever they sum to: its hash modulo 1000 as a share of the sum; null without weights or subject."""
    whole = sum(max(0.0, w) for _, w in variants)
    if whole <= 0:
        return F.lit(None).cast("string")
    at, upto, out = (fnv1a(subject) % 1000) / 1000 * whole, whole, F.lit(variants[-1][0])
    for name, weight in reversed(variants):
        out = F.when(at <= upto, F.lit(name)).otherwise(out)
        upto -= max(0.0, weight)
    return F.when(subject.isNotNull(), out)


def parse_variants(text: str | None) -> list[tuple[str, float]]:
    """The usable entries of a JSON list of ``{variant, weight}``; anything else is left out."""
    try:
        held = json.loads(text or "")
    except ValueError:
        return []
    rows = held if isinstance(held, list) else []
    return [(r["variant"], float(r["weight"])) for r in rows if isinstance(r, dict) and isinstance(r.get("variant"), str) and r["variant"] and isinstance(r.get("weight"), (int, float)) and r["weight"] > 0]


def parse_weights(text: str | None, default: dict[str, float]) -> dict[str, float]:
    """The weights of a JSON object that names exactly those of ``default``, all numbers not below zero; else ``default``."""
    try:
        held = json.loads(text or "")
    except ValueError:
        return default
    good = isinstance(held, dict) and set(held) == set(default) and all(isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0 for v in held.values())
    return {k: float(held[k]) for k in default} if good else default


class ConfigStore:
    """Versions of configurations by kind, one of which is active; kept in a RowStore."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.store = RowStore(spark, path or scratch(spark, "configs"), "kind string, version string, weights string, active boolean", ["kind", "version"], 1)

    def _rows(self, kind: str) -> list:
        return self.store.read().filter(F.col("kind") == kind).orderBy("version").collect()  # versions of one kind

    def save(self, kind: str, version: str, weights: dict[str, float], problems, activate: bool = False) -> "ConfigStore":
        """Add or replace a version; ``problems(weights)`` lists what is wrong with it, which is an error."""
        if found := problems(weights):
            raise ValueError("; ".join(found))
        held = any(r["active"] and r["version"] == version for r in self._rows(kind))
        self.store.apply(self.spark.createDataFrame([(kind, version, json.dumps(weights), held)], self.store.schema))
        return self.activate(kind, version) if activate else self

    def activate(self, kind: str, version: str) -> "ConfigStore":
        """Make a version the only active one of its kind: also the way back to a former one."""
        rows = self._rows(kind)
        if version not in {r["version"] for r in rows}:
            raise KeyError(f"{kind} has no version {version}")
        self.store.apply(self.spark.createDataFrame([(kind, r["version"], r["weights"], r["version"] == version) for r in rows], self.store.schema))
        return self

    def active(self, kind: str, default: dict[str, float]) -> dict[str, float]:
        """The weights in force; ``default`` without an active version or with a broken one."""
        return next((parse_weights(r["weights"], default) for r in self._rows(kind) if r["active"]), default)

    def versions(self, kind: str | None = None) -> DataFrame:
        rows = self.store.read()
        return rows if kind is None else rows.filter(F.col("kind") == kind)
