"""Mixing sources to target weights by hierarchical budgeting.

1. The size of each leaf of the tree (domain, language, source, or any other levels) is summed.
2. Weights go down from the root: a family's share is split by the weights of its level's
   table, or, at a level without one, by what the sources below are to give.
3. Budgets go down in proportion to weight. What a child can't fill is shared out among its
   siblings; what a whole family can't fill goes back to the level above.
4. A leaf that is to give more than it has runs through all its records as often as is
   whole, then takes a prefix of a seeded order of the next epoch. The prefix is found
   from sums over slices of that order; only the slice that holds its end is sorted.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.storage import Table, materialize

#: Leaves are budgeted on the driver, so their number is bounded; more are an error, never a cut.
MAX_LEAVES = 100_000
#: Records in one slice of an epoch's order, about.
SLICE = 5_000
TOKENIZER = os.environ.get("STALLWRIGHT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the word pattern that this public vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(spark: SparkSession, path: str = TOKENIZER):
    """A pandas UDF giving the number of tokens of a text; a null text has none. Spark's file server hands the vocabulary to the executors."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(SparkFiles.get(name)).encode_ordinary
        for batch in texts:
            yield pd.Series([0 if t is None else len(encode(t)) for t in batch], dtype="int64")

    return count


def source_key(column: str):
    """Sources compare as keys, a blank or hyphen inside equals an underscore."""
    return F.translate(norm_key(column), " -", "__")


def sized_documents(documents: DataFrame, domains: DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, domain, language, source, tokens)``, one row per document that has tokens.

    ``domains(source, domain)`` tells the domain of a source; one that it doesn't name, as
    every source without such a table, is a domain of its own. An unknown language is
    ``und``; documents without id or source are left out; repeated rows are one record.
    """
    rows = documents.select(F.col("doc_id").cast("bigint"), source_key("source").alias("source"), F.coalesce(norm_key("lang"), F.lit("und")).alias("language"), token_counter(documents.sparkSession, tokenizer)("text").alias("tokens"))
    one = rows.filter("doc_id IS NOT NULL AND source IS NOT NULL AND tokens > 0").groupBy("doc_id").agg(F.min("source").alias("source"), F.min("language").alias("language"), F.max("tokens").alias("tokens"))
    if domains is None:
        return one.select("doc_id", F.col("source").alias("domain"), "language", "source", "tokens")
    named = domains.select(source_key("source").alias("source"), norm_key("domain").alias("domain")).filter("source IS NOT NULL").groupBy("source").agg(F.min("domain").alias("domain"))
    return one.join(named, "source", "left").select("doc_id", F.coalesce("domain", "source").alias("domain"), "language", "source", "tokens")


def tempered(sized: DataFrame, level: str, exponent: float = 0.5) -> DataFrame:
    """``(level, weight)``: a weight table in which the nodes of a level weigh a power of their tokens; below 1 it lifts the small ones."""
    return sized.groupBy(level).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("weight"))


def spread_weights(leaves: dict[tuple, float], tables: dict[int, tuple[tuple[int, ...], dict[tuple, float]]]) -> dict[tuple, float]:
    """The share of each leaf of the whole, from ``{path: default weight}``.

    ``tables`` has for a depth the places of the path that its keys consist of, and their
    weights; children that a table doesn't name, or names with nothing, get none. A depth
    without table, and a family of which the table names no child, goes by the default weights.
    """
    out: dict[tuple, float] = {}

    def split(own: dict[tuple, float], depth: int, share: float) -> None:
        if len(own) == 1 and depth == len(next(iter(own))):
            out[next(iter(own))] = share
            return
        children: dict[tuple, dict[tuple, float]] = {}
        for path, w in own.items():
            children.setdefault(path[: depth + 1], {})[path] = w
        weight = {c: sum(x.values()) for c, x in children.items()}
        if depth in tables:
            at, named = tables[depth]
            given = {c: max(0.0, named.get(tuple(c[k] for k in at), 0.0)) for c in children}
            weight = given if sum(given.values()) > 0 else weight
        whole = sum(weight.values())
        for c, x in children.items():
            split(x, depth + 1, share * weight[c] / whole if whole else 0.0)

    if leaves:
        split(leaves, 0, 1.0)
    return out


def budgets(leaves: dict[tuple, tuple[float, float]], total: float) -> dict[tuple, float]:
    """The budget of each leaf, from ``{path: (weight, capacity)}``.

    A node's weight and capacity are the sums of its leaves'. Within a family, budgets follow
    the weights; a child at its capacity is filled, and the rest goes to its siblings by weight,
    until all is placed or all are full. Only what is left then returns to the family above,
    which has reckoned with it, as a node's capacity is known there.
    """
    out: dict[tuple, float] = {}

    def spread(prefix: tuple, own: dict[tuple, tuple[float, float]], amount: float) -> None:
        depth = len(prefix)
        if len(own) == 1 and depth == len(next(iter(own))):
            path, (_, capacity) = next(iter(own.items()))
            out[path] = min(amount, capacity)
            return
        children: dict[tuple, dict] = {}
        for path, x in own.items():
            children.setdefault(path[: depth + 1], {})[path] = x
        weight = {c: sum(w for w, _ in x.values()) for c, x in children.items()}
        room = {c: sum(k for _, k in x.values()) for c, x in children.items()}
        given = dict.fromkeys(children, 0.0)
        left, open_ = min(amount, sum(room.values())), {c for c in children if room[c] > 0 and weight[c] > 0}
        while left > 1e-9 and open_:
            share = sum(weight[c] for c in open_)
            full = {c for c in open_ if given[c] + left * weight[c] / share >= room[c]}
            if not full:
                for c in open_:
                    given[c] += left * weight[c] / share
                break
            for c in full:
                left -= room[c] - given[c]
                given[c] = room[c]
            open_ -= full
        for c, x in children.items():
            spread(c, x, given[c])

    if leaves:
        spread((), leaves, total)
    return out


class Mixture:
    """A mixture of ``sized(doc_id, *levels, tokens)``, the last level being the source.

    ``targets(source, target_share, max_repeats)``: what a source is to give, spread over its
    leaves as its tokens are, and how often its records may be used. ``weights`` has for any
    level a table of that level's column, any of those above it, and ``weight``, which splits
    each family of that level in place of the targets. ``total`` is the size wanted in tokens;
    left out, it is the largest at which every source that has records can give its share,
    though leaves of it may be short and others take their part.

    Sources without target or records, with a share of zero, or with null in either column,
    give nothing. The seed fixes the order; ties are ordered by doc_id.
    """

    def __init__(self, sized: DataFrame, targets: DataFrame, levels: tuple[str, ...] = ("domain", "language", "source"), weights: dict[str, DataFrame] | None = None, total: float | None = None, seed: int = 1):
        self.levels, self.seed, self.spark = levels, seed, sized.sparkSession
        self.sized = materialize(sized.select("doc_id", *levels, "tokens"), "sized")
        found = self._few(self.sized.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
        want = self._few(targets.select(source_key("source").alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")))
        self.targets = {r["source"]: (r["share"], r["most"]) for r in want}
        self.stock = {tuple(r[c] for c in levels): (r["tokens"], r["docs"]) for r in found if r["source"] in self.targets}
        held: dict[str, int] = {}
        for path, (tokens, _) in self.stock.items():
            held[path[-1]] = held.get(path[-1], 0) + tokens
        tables = {}
        for level, table in (weights or {}).items():
            at = tuple(k for k, c in enumerate(levels[: levels.index(level) + 1]) if c in table.columns)
            tables[levels.index(level)] = (at, {tuple(r[levels[k]] for k in at): float(r["weight"]) for r in self._few(table.filter("weight IS NOT NULL"))})
        self.weight = spread_weights({p: self.targets[p[-1]][0] * t / held[p[-1]] for p, (t, _) in self.stock.items()}, tables)
        self.capacity = {p: float(t * self.targets[p[-1]][1]) for p, (t, _) in self.stock.items()}
        if total is None:
            due = {s: sum(w for p, w in self.weight.items() if p[-1] == s) for s in held}
            total = min((held[s] * self.targets[s][1] / w for s, w in due.items() if w > 0), default=0.0)
        self.total = total
        self.budget = budgets({p: (w, self.capacity[p]) for p, w in self.weight.items()}, total)

    @staticmethod
    def _few(rows: DataFrame) -> list:
        got = rows.limit(MAX_LEAVES + 1).collect()
        if len(got) > MAX_LEAVES:
            raise ValueError(f"more than {MAX_LEAVES} leaves")
        return got

    def budget_table(self) -> DataFrame:
        """``(*levels, weight, wanted, capacity, budget)`` of each leaf: the tokens its weight asks for, those it can give, and those it is to give."""
        rows = [(*p, w, w * self.total, self.capacity[p], self.budget[p]) for p, w in self.weight.items()]
        return self.spark.createDataFrame(rows, ", ".join([*(f"{c} string" for c in self.levels), "weight double, wanted double, capacity double, budget double"]))

    def selection(self) -> DataFrame:
        """``(doc_id, source, tokens, copies)`` of every record used, at most ``max_repeats`` times.

        A leaf's last, partial epoch takes records as long as their middle lies within the budget.
        """
        largest = max((docs for _, docs in self.stock.values()), default=1)
        slices = max(1, -(-largest // SLICE))
        plan = []
        for path, amount in self.budget.items():
            tokens = self.stock[path][0]
            epochs = min(int(amount // tokens), self.targets[path[-1]][1])
            plan.append((*path, epochs, amount - epochs * tokens if epochs < self.targets[path[-1]][1] else 0.0))
        names = ", ".join(f"{c} string" for c in self.levels)
        leaf = F.broadcast(self.spark.createDataFrame(plan, f"{names}, epochs int, rest double"))  # at most MAX_LEAVES rows
        key = F.xxhash64(F.lit(self.seed), F.col("epochs"), F.col("doc_id"))
        ordered = self.sized.join(leaf, list(self.levels)).withColumn("key", key).withColumn("slice", F.pmod(F.shiftrightunsigned("key", 20), F.lit(slices)))
        sums = ordered.groupBy(*self.levels, "slice").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
        base = F.coalesce(F.sum("sum").over(W.partitionBy(*self.levels).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cut = Table(sums.withColumn("base", base).filter("base <= rest AND base + sum > rest").select(*self.levels, F.col("slice").alias("cut"), "base"), "cuts")
        edge = ordered.join(F.broadcast(cut.df), list(self.levels), "left")  # at most one row a leaf
        inside = edge.filter("slice = cut").withColumn("run", F.sum("tokens").over(W.partitionBy(*self.levels).orderBy("key", "doc_id")))
        picked = inside.withColumn("extra", (F.col("base") + F.col("run") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
        others = edge.filter("cut IS NULL OR slice <> cut").withColumn("extra", (F.col("slice") < F.coalesce("cut", F.when(F.col("rest") > 0, slices).otherwise(0))).cast("int"))
        columns = ["doc_id", *self.levels, "tokens", (F.col("epochs") + F.col("extra")).alias("copies")]
        return picked.select(columns).unionByName(others.select(columns)).filter("copies > 0")

    def shares(self) -> DataFrame:
        """``(source, target_share, max_repeats, docs, copies, most_copies, tokens, share)`` reached, one row per source with a target."""
        wanted = self.spark.createDataFrame([(s, float(w), int(m)) for s, (w, m) in sorted(self.targets.items())], "source string, target_share double, max_repeats int")
        got = self.selection().groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.max("copies").cast("bigint").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
        rows = wanted.join(got, "source", "left").select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "copies", "most_copies", "tokens")))
        return rows.withColumn("share", F.coalesce(F.col("tokens") / F.sum("tokens").over(W.partitionBy()), F.lit(0.0)))  # one row a target
