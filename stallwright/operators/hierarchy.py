"""Parent-child links to whole hierarchies, as nested-set ranges.

1. Upward, subtree sizes: a node knows its ancestor 2^k steps up and the number of its
   descendants nearer than 2^k; the sums of the nodes whose 2^k-th ancestor it is double
   that reach. Nodes that never reach a root are on a cycle or below one.
2. Siblings get preorder ranges by prefix sums of the sizes.
3. Downward, a node's position is the sum of the offsets along its ancestors, again by
   doubling.
4. Ancestors are then the ranges that enclose a position: nodes are cut into blocks of
   positions, each range is copied to the later blocks it reaches into, and each block is
   read in order of position, level by level, which yields root, depth and path.

Steps 1 to 3 take a number of rounds that grows with the logarithm of the depth. Links that
fit one task (``ONE_TASK`` nodes, counted while they are written) go through these rounds as
numpy arrays in that task; more go through them as joins, where each round writes a table to
the shared folder, so plans stay flat and no round depends on an executor's memory. There,
wide families are numbered in blocks, hot keys are pre-aggregated, and adaptive execution
splits their side of the joins, in which the other side is unique. Step 4 is the same for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.storage import Table, materialize

BLOCK = 8192
#: Links are resolved in one task up to so many nodes and characters of their keys.
ONE_TASK, ONE_TASK_CHARS = 1 << 20, 1 << 26
#: Children of one parent are numbered in blocks of about so many.
FAMILY = 50_000
#: More wide families than this are joined by a shuffle, not a broadcast.
MAX_BROADCAST = 10_000
#: Rows, and bytes of paths, sent on at once.
OUT_ROWS, OUT_BYTES = 1 << 14, 1 << 23
_RANGES = pa.schema([("slug", pa.string()), ("parent", pa.string()), ("lo", pa.int64()), ("size", pa.int64()), ("depth", pa.int64()), ("cycle", pa.string())])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slug, parent, lo, size, depth, cycle)`` of all nodes; ``cycle``, the smallest slug on it, is set for those caught in one."""
    links = pa.Table.from_batches(list(batches), pa.schema([("slug", pa.string()), ("parent", pa.string())])).combine_chunks().sort_by("slug")
    if not links.num_rows:
        return
    slugs = links["slug"].combine_chunks()
    n = len(slugs)
    above = np.append(np.asarray(pc.fill_null(pc.index_in(links["parent"].combine_chunks(), value_set=slugs), n)).astype(np.int64), n)  # n stands for no parent
    size, depth, jump = np.ones(n, np.int64), (above < n).astype(np.int64), above
    for _ in range(n.bit_length() + 1):
        going = jump[:n] < n
        if not going.any():
            break
        gain = np.bincount(jump[:n][going], weights=size[going], minlength=n).astype(np.int64)
        size, depth, jump = size + gain, depth + depth[jump], jump[jump]
    caught = jump[:n] < n
    above[:n][caught] = n
    family = np.argsort(above[:n], kind="stable")  # by parent, then by slug
    family = family[~caught[family]]
    own = size[family]
    first = np.flatnonzero(np.diff(above[family], prepend=-1))
    run = np.cumsum(own) - own
    lo = np.zeros(n + 1, np.int64)
    lo[family] = run - np.repeat(run[first], np.diff(np.append(first, len(family)))) + (above[family] < n)
    jump = above
    while (jump[:n] < n).any():
        lo, jump = lo + lo[jump], jump[jump]
    cycle = np.full(n, -1, np.int64)
    if caught.any():
        jump = np.asarray(pc.fill_null(pc.index_in(links["parent"].combine_chunks(), value_set=slugs), n)).astype(np.int64)
        least = np.arange(n)
        at = np.flatnonzero(caught)
        for _ in range(len(at).bit_length()):  # 2^rounds steps go past every tail and round every cycle
            least[at], jump[at] = np.minimum(least[at], least[jump[at]]), jump[jump[at]]
        cycle[at] = least[jump[at]]
    parent = pa.array(above[:n], mask=above[:n] == n)
    whole = pa.table([slugs, slugs.take(parent), pa.array(lo[:n]), pa.array(size), pa.array(depth[:n]), slugs.take(pa.array(cycle, mask=cycle < 0))], schema=_RANGES)
    yield from whole.to_batches(OUT_ROWS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = np.asarray(batch.column("block"))
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for k, (begin, end) in enumerate(zip(cuts, cuts[1:])):
            if begin == end:
                continue
            if held and held[0].column("block")[0].as_py() != int(block[begin]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _levels(depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth the rows of a block that have it, and the place of each one's parent among the rows of the depth before."""
    order = np.argsort(depth, kind="stable")
    ends = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    last = order[: ends[1]]
    yield last, np.zeros(len(last), np.int64)
    for d in range(1, len(ends) - 1):
        rows = order[ends[d] : ends[d + 1]]
        yield rows, np.searchsorted(last, rows) - 1
        last = rows


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("slug", pa.string()), ("root", pa.string()), ("path", pa.string()), ("depth", pa.int64())])
    for block in _blocks(batches):
        slugs, own, depth = block["slug"].combine_chunks(), np.asarray(block["own"]), np.asarray(block["depth"])
        out, waiting = [], 0
        roots = paths = slugs
        for d, (rows, parent) in enumerate(_levels(depth)):
            names = slugs.take(pa.array(rows))
            if d:
                up = pa.array(parent)
                roots, paths = roots.take(up), pc.binary_join_element_wise(paths.take(up), names, "/")
            else:
                roots = paths = names
            mine = pa.array(own[rows])
            part = pa.RecordBatch.from_arrays([names.filter(mine), roots.filter(mine), paths.filter(mine), pa.array(depth[rows]).filter(mine)], schema=schema)
            out.append(part)
            waiting += part.nbytes
            if waiting > OUT_BYTES:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, waiting = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ancestor", pa.string()), ("descendant", pa.string()), ("distance", pa.int64())])
    for block in _blocks(batches):
        slugs, own, depth = block["slug"].combine_chunks(), np.asarray(block["own"]), np.asarray(block["depth"])
        above = np.full(len(slugs), -1, np.int64)
        last = np.zeros(0, np.int64)
        for rows, parent in _levels(depth):
            if len(last):
                above[rows] = last[parent]
            last = rows
        low, high, distance = np.flatnonzero(own), above[own], 0
        while True:
            there = high >= 0
            low, high, distance = low[there], high[there], distance + 1
            if not len(low):
                break
            for k in range(0, len(low), OUT_ROWS):
                part = slice(k, k + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([slugs.take(pa.array(high[part])), slugs.take(pa.array(low[part])), pa.array(np.full(len(low[part]), distance))], schema=schema)
            high = above[high]


class Hierarchy:
    """The resolved hierarchy of ``(slug, parent)`` rows.

    Keys compare as everywhere; rows without slug are left out; repeated rows are one node,
    with the smallest parent they name; a node whose parent is null, blank or unknown is a
    root. An empty table gives an empty hierarchy. Other columns are ignored.
    """

    def __init__(self, rows: DataFrame, slug: str = "slug", parent: str = "parent"):
        spark = self.spark = rows.sparkSession
        named = rows.select(norm_key(slug).alias("slug"), norm_key(parent).alias("parent")).filter("slug IS NOT NULL").groupBy("slug").agg(F.min("parent").alias("parent"))
        base = Table(named, "nodes", nodes=F.count("*"), chars=F.coalesce(F.sum(F.length("slug") + F.coalesce(F.length("parent"), F.lit(0))), F.lit(0)))
        if base.seen["nodes"] <= ONE_TASK and base.seen["chars"] <= ONE_TASK_CHARS:
            found = Table(base.df.coalesce(1).mapInArrow(_resolve, "slug string, parent string, lo bigint, size bigint, depth bigint, cycle string"), "ranges", caught=F.count("cycle"))
            base.drop()
            self.ranges = found.df.filter("cycle IS NULL").drop("cycle")
            self.n_caught, self._cycles = found.seen["caught"], found.df.filter("cycle IS NOT NULL").select("slug", "cycle")
            return
        self._cycles = None
        known = base.df.select(F.col("slug").alias("parent"), F.lit(True).alias("known"))
        self.nodes = materialize(base.df.join(known, "parent", "left").select("slug", F.when(F.col("known"), F.col("parent")).alias("parent")), "nodes")
        base.drop()
        self._climb()
        self._place()

    def _climb(self) -> None:
        """Sizes and depths; self.jumps keeps (slug, jump) of each round for the way down."""
        state = Table(self.nodes.select("slug", F.col("parent").alias("jump"), F.lit(1).cast("bigint").alias("size"), F.col("parent").isNotNull().cast("bigint").alias("depth")), "climb", active=F.count("jump"))
        self.jumps, left = [state], None
        while True:
            active = state.seen["active"]
            if not active or active == left:
                break
            left = active
            up = state.df.select(F.col("slug").alias("jump"), F.col("jump").alias("far"), F.col("depth").alias("more"))
            gained = state.df.filter("jump IS NOT NULL").groupBy(F.col("jump").alias("slug")).agg(F.sum("size").alias("gain"))
            moved = state.df.join(up, "jump", "left").select("slug", F.col("far").alias("jump"), "size", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
            state = Table(moved.join(gained, "slug", "left").select("slug", "jump", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), "depth"), "climb", active=F.count("jump"))
            self.jumps.append(state)
        self.caught = state.df.filter("jump IS NOT NULL").select("slug")
        self.sized = state.df.filter("jump IS NULL").select("slug", "size", "depth")
        self.n_caught = active

    def _place(self) -> None:
        """Preorder positions: lo for each node of a tree, its subtree being [lo, lo + size)."""
        members = Table(self.nodes.join(self.sized, "slug").select("slug", "parent", "size", "depth"), "members")
        families = members.df.groupBy(F.col("parent").alias("family")).agg(F.count("*").alias("children")).filter(F.col("children") > FAMILY)
        few = families.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        wide = F.broadcast(families) if few else families
        part = F.when(F.col("children").isNotNull(), F.pmod(F.xxhash64("slug"), F.ceil(F.col("children") / FAMILY))).otherwise(F.lit(0)).cast("bigint")
        salted = members.df.join(wide, F.col("parent").eqNullSafe(F.col("family")), "left").select("slug", "parent", "size", part.alias("part"))
        block = W.partitionBy("parent", "part").orderBy("slug")
        inside = Table(salted.withColumn("before", F.sum("size").over(block) - F.col("size")), "siblings")
        parts = inside.df.groupBy("parent", "part").agg(F.sum("size").alias("total"))
        starts = parts.withColumn("start", F.sum("total").over(W.partitionBy("parent").orderBy("part")) - F.col("total")).select(F.col("parent").alias("p"), F.col("part").alias("q"), "start").filter("q > 0")
        offset = F.col("before") + F.coalesce("start", F.lit(0)) + F.col("parent").isNotNull().cast("bigint")
        state = Table(inside.df.join(starts, F.col("parent").eqNullSafe(F.col("p")) & (F.col("part") == F.col("q")), "left").select("slug", offset.alias("lo")), "offsets")
        for held in self.jumps[:-1]:
            steps = held.df.filter("jump IS NOT NULL")
            up = state.df.select(F.col("slug").alias("jump"), F.col("lo").alias("more"))
            gains = steps.join(up, "jump").select("slug", "more")
            new = Table(state.df.join(gains, "slug", "left").select("slug", (F.col("lo") + F.coalesce("more", F.lit(0))).alias("lo")), "offsets")
            state.drop()
            state = new
        for held in self.jumps[:-1]:
            held.drop()
        inside.drop()
        #: (slug, parent, lo, size, depth) of the nodes that lead to a root.
        self.ranges = materialize(members.df.join(state.df, "slug").select("slug", "parent", "lo", "size", "depth"), "ranges")
        members.drop()
        state.drop()

    def _scan(self, read, schema: str) -> DataFrame:
        first = F.floor(F.col("lo") / BLOCK)
        last = F.floor((F.col("lo") + F.col("size") - 1) / BLOCK)
        copies = self.ranges.select("slug", "lo", "depth", first.alias("at"), F.explode(F.sequence(first, last)).alias("block"))
        ordered = copies.repartition("block").sortWithinPartitions("block", "lo")
        return ordered.select("slug", "depth", (F.col("at") == F.col("block")).alias("own"), "block").mapInArrow(read, schema)

    def tree(self) -> DataFrame:
        """``(slug, root, path, depth)`` of every node that leads to a root."""
        return self._scan(_places, "slug string, root string, path string, depth bigint")

    def descendants(self) -> DataFrame:
        """``(ancestor, descendant, distance)`` of every node below another."""
        return self._scan(_pairs, "ancestor string, descendant string, distance bigint")

    def cycles(self) -> DataFrame:
        """``(slug, cycle)`` of the nodes on a cycle or below one; ``cycle`` is the smallest slug on it."""
        if self._cycles is not None:
            return self._cycles
        nodes = self.nodes.join(self.caught, "slug", "left_semi")
        state = Table(nodes.select("slug", F.col("parent").alias("jump"), F.col("slug").alias("least")), "cycles")
        for _ in range(max(1, self.n_caught.bit_length())):  # 2^rounds steps go past every tail and round every cycle
            far = state.df.select(F.col("slug").alias("jump"), F.col("jump").alias("next"), F.col("least").alias("other"))
            new = Table(state.df.join(far, "jump").select("slug", F.col("next").alias("jump"), F.least("least", "other").alias("least")), "cycles")
            state.drop()
            state = new
        landed = state.df.select(F.col("slug").alias("jump"), F.col("least").alias("cycle"))
        return state.df.join(landed, "jump").select("slug", "cycle")


def resolve_hierarchy(rows: DataFrame) -> DataFrame:
    """``(slug, root, path, depth)`` of every node once; on or below a cycle, root is null, path the smallest slug on the cycle and depth -1."""
    h = Hierarchy(rows)
    whole = h.tree()
    if not h.n_caught:
        return whole
    return whole.unionByName(h.cycles().select("slug", F.lit(None).cast("string").alias("root"), F.col("cycle").alias("path"), F.lit(-1).cast("bigint").alias("depth")))
