"""Items that appear together, as an incremental table of pair counts.

Changed baskets emit signed deltas of pairs and of single items, which are summed before
the shuffle and merged into hash-bucketed counts; scores are computed from the counts.

Long baskets: a pair wanted at least ``min_count`` times appears in a basket outside any
``min_count - 1`` chosen ones. So the largest baskets, up to that number, emit no pairs:
each has a membership counter in the item table, and the scoring adds the baskets both
items are members of. Any further long basket is cut into blocks of items, whose pairs
are made by separate tasks. Every count stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.storage import BucketStore, Table, scratch

#: Baskets of more items than this are long.
LONG = 1000
#: More long baskets than this are joined by a shuffle, not a broadcast.
FEW = 10_000
#: Items beyond this number, or of more characters, are joined to the pairs by a shuffle, not a broadcast.
FEW_ITEMS, FEW_ITEM_CHARS = 200_000, 1 << 23


def memberships(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct ``(basket, item)``; rows without either are left out."""
    return rows.select(norm_key(basket).alias("basket"), norm_key(item).alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL").distinct()


class PairCounts:
    """Persistent pair, item and basket counts.

    Items are counted under a 64-bit hash; ``collided`` tells whether two items share one,
    in which case ``hashed=False`` counts them by name.
    """

    def __init__(self, spark, path: str | None = None, min_count: int = 5, hashed: bool = True, buckets: int | None = None):
        root = path or scratch(spark, "pairs")
        kind = "bigint" if hashed else "string"
        self.spark, self.min_count, self.hashed = spark, min_count, hashed
        self.slots = [f"long{k}" for k in range(max(0, min_count - 1))]
        self.pairs = BucketStore(spark, f"{root}/pairs", {"a": kind, "b": kind}, ["n"], buckets)
        self.items = BucketStore(spark, f"{root}/items", {"code": kind, "item": "string"}, ["n", *self.slots], buckets)
        self.held = BucketStore(spark, f"{root}/long", {"basket": "string"}, ["slot"], 1)

    def apply(self, members: DataFrame, sign: int = 1) -> "PairCounts":
        """Add (+1) or take back (-1) whole baskets, given as distinct ``(basket, item)``.

        A changed basket is taken back as it was and added as it is. No basket, no change.
        """
        code = F.xxhash64("item") if self.hashed else F.col("item")
        staged = Table(members.select("basket", "item", code.alias("code")), "members")
        rows = staged.df
        whole = rows.groupBy("basket").agg(F.count("*").alias("size"))
        counted = Observation()
        sizes = Table(whole.observe(counted, F.count("*").alias("baskets")).filter(F.col("size") > LONG), "long", long=F.count("*"))
        taken = {r["basket"]: r["slot"] for r in self.held.read().collect()}  # at most min_count - 1
        n_long = sizes.seen["long"]
        if n_long and sign > 0:
            free = [s for s in range(1, len(self.slots) + 1) if s not in taken.values()]
            largest = sizes.df.orderBy(F.desc("size"), "basket").limit(len(free)).collect()
            new = {r["basket"]: s for r, s in zip(largest, free)}
        else:
            new = {b: s for b, s in taken.items()}
        one = F.lit(sign).cast("bigint")
        in_slot = F.create_map(*(x for b, s in new.items() for x in (F.lit(b), F.lit(s))))[F.col("basket")] if new else F.lit(None).cast("int")
        marks = [F.sum(F.when(F.col("slot") == k + 1, one).otherwise(0)).alias(c) for k, c in enumerate(self.slots)]
        self.items.apply(rows.withColumn("slot", in_slot).groupBy("code", "item").agg((F.count("*") * sign).alias("n"), *marks).unionByName(self._baskets(sign * counted.get["baskets"])))
        rest = rows.withColumn("slot", in_slot).filter("slot IS NULL").drop("slot") if new else rows
        self.pairs.apply(self._pairs(rest, sizes.df, n_long, one))
        if new:
            present = [r[0] for r in rows.filter(F.col("basket").isin(list(new))).select("basket").distinct().collect()]
            moved = [(b, sign * new[b]) for b in present]
            if moved:
                self.held.apply(self.spark.createDataFrame(moved, "basket string, slot bigint"))
        staged.drop()
        sizes.drop()
        return self

    def _baskets(self, n: int) -> DataFrame:
        """The number of baskets, as the count of the null item."""
        return self.spark.createDataFrame([(None, None, n, *([0] * len(self.slots)))], self.items.schema)

    def _pairs(self, rows: DataFrame, sizes: DataFrame, n_long: int, one) -> DataFrame:
        if n_long:
            cut = sizes.select("basket", F.ceil(F.col("size") / LONG).alias("blocks"))
            rows = rows.join(F.broadcast(cut) if n_long <= FEW else cut, "basket", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("code"), F.col("blocks"))))
            blocks = rows.filter("block IS NOT NULL").groupBy("basket", "block", "blocks").agg(F.collect_list("code").alias("codes"))
            rows = rows.filter("block IS NULL")
        short = rows.groupBy("basket").agg(F.array_sort(F.collect_list("code")).alias("codes"))
        at = short.filter(F.size("codes") > 1).select("codes", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("i"))
        pairs = at.select(F.element_at("codes", F.col("i")).alias("a"), F.explode(F.slice("codes", F.col("i") + 1, F.size("codes"))).alias("b"))
        if n_long:
            pairs = pairs.unionByName(block_pairs(blocks, ["basket"]).select("a", "b"))
        return pairs.groupBy("a", "b").agg((F.count("*") * one).alias("n"))

    @property
    def collided(self) -> bool:
        return self.hashed and bool(self.items.read().filter("item IS NOT NULL").groupBy("code").count().filter("count > 1").limit(1).count())

    @property
    def baskets(self) -> int:
        row = self.items.read().filter("item IS NULL").select("n").first()
        return row[0] if row else 0

    def _few(self) -> bool:
        held = self.items.read().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("chars")).first()
        return held["n"] <= FEW_ITEMS and held["chars"] <= FEW_ITEM_CHARS

    def counts(self, touched: DataFrame | None = None) -> DataFrame:
        """``(item_a, item_b, n, n_a, n_b)`` of the pairs in at least ``min_count`` baskets, of all items or
        of those pairs that hold an item of ``touched(item)``, found before anything is joined to them."""
        items = self.items.read().filter("item IS NOT NULL")
        slots = self.slots if self.held.places else []
        pairs = self.pairs.read().filter(F.col("n") >= self.min_count - len(slots))
        few = self._few()
        if touched is not None:
            names = touched.select(norm_key("item").alias("item")).distinct()
            codes = Table(items.join(names, "item", "left_semi").select("code"), "touched").df
            first, second = codes.select(F.col("code").alias("a")), codes.select(F.col("code").alias("b"))
            pairs = pairs.join(first, "a", "left_semi").unionByName(pairs.join(second, "b", "left_semi").join(first, "a", "left_anti"))

        def side(which: str) -> DataFrame:
            own = items.select(F.col("code").alias(which), F.col("item").alias(f"item_{which}"), F.col("n").alias(f"n_{which}"), *(F.col(c).alias(f"{c}_{which}") for c in slots))
            return F.broadcast(own) if few else own

        both = pairs.join(side("a"), "a").join(side("b"), "b")
        n = F.col("n")
        for c in slots:
            n = n + F.col(f"{c}_a") * F.col(f"{c}_b")
        kept = both.withColumn("n", n).filter(F.col("n") >= self.min_count)
        swap = F.col("item_a") > F.col("item_b")
        return kept.select(F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), "n", F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"))

    def scores(self, min_lift: float = 0.0, counts: DataFrame | None = None) -> DataFrame:
        """``(item_a, item_b, n, n_a, n_b, lift)`` of the pairs in at least ``min_count`` baskets.

        ``lift`` is n * N / (n_a * n_b). ``counts`` are pair counts taken before, as those of
        ``PairScores``. Ties and order: the smaller name is item_a.
        """
        whole = F.lit(float(self.baskets))
        scored = (self.counts() if counts is None else counts).withColumn("lift", F.col("n") * whole / (F.col("n_a") * F.col("n_b")))
        return scored.filter(F.col("n") * whole >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))


class PairScores:
    """The scored pairs of a ``PairCounts`` as a written table, of which a change recomputes what it affects.

    A changed basket affects the pairs of its items. The number of baskets, which enters every
    lift, is not part of the table and comes in when it is read.
    """

    def __init__(self, counts: PairCounts):
        self.of, self.table = counts, Table(counts.counts(), "scores")

    def refresh(self, touched: DataFrame) -> "PairScores":
        """Recompute the pairs that hold an item of ``touched(item)``."""
        names = Table(touched.select(norm_key("item").alias("item")).distinct(), "names").df
        kept = self.table.df
        for c in ("item_a", "item_b"):
            kept = kept.join(names.withColumnRenamed("item", c), c, "left_anti")
        new = Table(kept.select(self.table.df.columns).unionByName(self.of.counts(names)), "scores")
        self.table.drop()
        self.table = new
        return self

    def read(self, min_lift: float = 0.0) -> DataFrame:
        return self.of.scores(min_lift, self.table.df)


def block_pairs(blocks: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, a, b)``, a < b, of all pairs of codes within a group, from ``(*group, block, blocks, codes)``.

    Each pair of blocks is a row of its own before any codes are joined to it, so the pairs of
    one large group are made by many tasks.
    """
    firsts = blocks.select(*group, "block", F.explode(F.sequence(F.col("block").cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("block2"), F.col("codes").alias("one"))
    both = firsts.join(blocks.select(*group, F.col("block").cast("bigint").alias("block2"), F.col("codes").alias("two")), [*group, "block2"])
    each = both.select(*group, "block", "block2", F.explode("one").alias("x"), "two").select(*group, "block", "block2", "x", F.explode("two").alias("y"))
    return each.filter("block < block2 OR x < y").select(*group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def count_pairs(rows: DataFrame, basket: str, item: str, min_count: int = 5) -> PairCounts:
    """Counts of all baskets of ``rows``, by hash, or by name should two items share a hash."""
    members = memberships(rows, basket, item)
    counts = PairCounts(rows.sparkSession, min_count=min_count).apply(members)
    return PairCounts(rows.sparkSession, min_count=min_count, hashed=False).apply(members) if counts.collided else counts
