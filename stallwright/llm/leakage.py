"""Evaluation texts leaking into training text, by suffix arrays over shards of the corpus.

Each task cuts its documents into shards of a bounded number of words and builds the suffix
array of each shard; every suffix of every test item is then binary-searched in it, all of
them at once in numpy. Only stretches of ``min_words`` words that the test items know can
hold a match, so all other words are left out of the arrays without loss. A stretch longer
than a shard goes into several that overlap by the longest test item, so no match is cut.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwright.llm.skeleton import consistent

#: Words of one suffix array.
SHARD_WORDS = 1 << 20
#: The test set goes to every worker, so it is bounded; a larger one is an error, never a cut.
MAX_ITEMS, MAX_ITEM_CHARS = 200_000, 64_000_000
#: (test suffix, position) pairs compared at once, and words of them at a time.
STEP, CHUNK = 1 << 15, 16
_WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id bigint, item_id bigint, words int, doc_word bigint, item_word int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("doc_word", pa.int64()), ("item_word", pa.int32())])


def words(text: str) -> Iterator[str]:
    """Runs of letters and digits of the consistent form, in lower case."""
    return (m.group() for m in _WORD.finditer(consistent(text).lower()))


class TestSet:
    """Test items as word numbers, one after the other with -2 between them, and where their suffixes of at least ``min_words`` words begin."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        codes, begins = array("i"), [0]
        for _, text in items:
            codes.extend(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text))
            codes.append(-2)
            begins.append(len(codes))
        self.codes = np.append(np.frombuffer(codes, np.int32) if len(codes) else np.zeros(0, np.int32), np.full(CHUNK, -2, np.int32))
        first = np.array(begins, np.int64)
        counts = np.diff(first) - 1
        self.width = max(int(counts.max(initial=0)), min_words)
        fits = np.maximum(counts - min_words + 1, 0)  # suffixes long enough
        #: Of each suffix its place in ``codes``, its item and its first word in it.
        self.start = (np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)).astype(np.int32)
        self.suffixes = np.repeat(first[:-1], fits) + self.start
        self.owner = np.repeat(np.array([i for i, _ in items], np.int64), fits)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` that hold a word, ordered by their first ``depth`` words or more; -1 separates stretches."""
    rank = text.astype(np.int64) + 2  # 0 is what lies past the end
    length, reach = len(rank), 1
    while length and reach < depth:
        ahead = np.zeros(length, np.int64)
        ahead[: length - reach] = rank[reach:] if reach < length else 0
        values, new = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
        rank, reach = new.astype(np.int64) + 1, 2 * reach
        if len(values) == length:
            break
    order = np.argsort(rank, kind="stable")
    return order[text[order] >= 0]


def _compare(text: np.ndarray, positions: np.ndarray, test: TestSet, suffixes: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number of common first words of each place in ``text`` and each test suffix, at most ``most``, and
    whether the place then goes on with the smaller word. Items end in -2, stretches in -1, so none runs into the next."""
    common, less = np.zeros(len(positions), np.int32), np.zeros(len(positions), bool)
    open_, done, span = np.arange(len(positions)), 0, np.arange(CHUNK)
    while open_.size:
        have, want = text[positions[open_, None] + done + span], test.codes[suffixes[open_, None] + done + span]
        differ = have != want
        first, at = differ.argmax(1), np.arange(len(open_))
        found = differ[at, first]
        common[open_] += np.where(found, first, CHUNK).astype(np.int32)
        less[open_[found]] = have[at[found], first[found]] < want[at[found], first[found]]
        open_ = open_[~found]
        done += CHUNK
        if most is not None and done >= most:
            break
    if most is not None:
        less &= common < most
        np.minimum(common, most, out=common)
    return common, less


def _insertion(text: np.ndarray, order: np.ndarray, test: TestSet, wanted: np.ndarray, most: int | None = None, right: bool = False) -> np.ndarray:
    """For each wanted test suffix, how many suffixes of ``text`` sort before it; of its first ``most`` words, with those that equal them if ``right``."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not open_.size:
            return low
        middle = (low[open_] + high[open_]) // 2
        after = np.empty(len(open_), bool)
        for k in range(0, len(open_), STEP):
            part = slice(k, k + STEP)
            common, less = _compare(text, order[middle[part]], test, wanted[open_[part]], most)
            after[part] = less | (common == most) if right else less
        low[open_[after]] = middle[after] + 1
        high[open_[~after]] = middle[~after]


def longest_matches(text: np.ndarray, order: np.ndarray, test: TestSet) -> np.ndarray:
    """The length of the longest match of every test suffix, from the neighbours of its place in the array."""
    place = _insertion(text, order, test, test.suffixes)
    best = np.zeros(len(place), np.int32)
    for near in (place - 1, place):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        for k in range(0, len(ok), STEP):
            part = ok[k : k + STEP]
            best[part] = np.maximum(best[part], _compare(text, order[near[part]], test, test.suffixes[part])[0])
    return best


class _Shard:
    def __init__(self, test: TestSet):
        self.test, self.parts, self.docs, self.offsets, self.size = test, [], [], [], 0

    def add(self, doc: int, offset: int, codes: np.ndarray) -> None:
        self.parts.append(codes)
        self.docs.append(doc)
        self.offsets.append(offset)
        self.size += len(codes) + 1

    def search(self) -> pa.RecordBatch | None:
        """The longest match of each document and item in this shard."""
        if not self.parts or not len(self.test.owner):
            return None
        test, gap = self.test, np.full(1, -1, np.int32)
        text = np.concatenate([x for p in self.parts for x in (p, gap)] + [np.full(CHUNK, -1, np.int32)])
        starts = np.cumsum([0, *(len(p) + 1 for p in self.parts[:-1])])
        order = suffix_array(text, test.width)
        hit = np.flatnonzero(longest_matches(text, order, test) >= test.min_words)
        if not hit.size:
            return None
        low, high = (_insertion(text, order, test, test.suffixes[hit], test.min_words, right) for right in (False, True))
        docs, offsets = np.array(self.docs, np.int64), np.array(self.offsets, np.int64)
        best: list[tuple[np.ndarray, ...]] = []

        def keep(suffix: np.ndarray, position: np.ndarray) -> None:
            length = _compare(text, position, test, test.suffixes[suffix])[0]
            part = np.searchsorted(starts, position, "right") - 1
            best.append((docs[part], test.owner[suffix], length, offsets[part] + position - starts[part], test.start[suffix]))
            if len(best) > 64:
                best[:] = [_longest(best)]

        counts = high - low
        ends = np.cumsum(counts)
        for k in range(0, int(ends[-1]), STEP):
            flat = np.arange(k, min(k + STEP, int(ends[-1])))
            which = np.searchsorted(ends, flat, "right")
            keep(hit[which], order[low[which] + flat - (ends[which] - counts[which])])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _longest(best)], schema=_ARROW)


def _longest(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    doc, item, length, at, start = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, at, -length, item, doc))
    doc, item, length, at, start = doc[order], item[order], length[order], at[order], start[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[first], item[first], length[first], at[first], start[first]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value  # read once a worker
        min_words = test.min_words
        get, overlap = test.vocabulary.get, test.width - 1
        shard = _Shard(test)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = np.fromiter((get(w, -1) for w in words(text.as_py())), np.int32)
                known = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).astype(np.int8)))
                for begin, end in zip(known[::2].tolist(), known[1::2].tolist()):
                    if end - begin < min_words:
                        continue
                    for k in range(begin, end, SHARD_WORDS):
                        stop = min(end, k + SHARD_WORDS + overlap)
                        if stop - k >= min_words:
                            shard.add(doc, k, codes[k:stop])
                        if shard.size >= SHARD_WORDS:
                            if (found := shard.search()) is not None:
                                yield found
                            shard = _Shard(test)
        if (found := shard.search()) is not None:
            yield found

    return run


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, words, doc_word, item_word)``: each document and item that share at
    least ``min_words`` consecutive words, with their longest common passage and where it begins.

    Of equally long passages the first in the document, then in the item, is given. Missing
    and blank texts and items shorter than ``min_words`` words (``short_items``) leak nothing;
    repeated rows of a document are one; empty tables give no rows.
    """
    rows = items.select(F.col("item_id").cast("bigint"), F.col("item_text")).filter("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    held = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()
    if held[0] > MAX_ITEMS or held[1] > MAX_ITEM_CHARS:
        raise ValueError(f"the test set has {held[0]} items of {held[1]} characters; it goes to every worker, so split it")
    shared = documents.sparkSession.sparkContext.broadcast(TestSet([(r[0], r[1]) for r in rows.orderBy("item_id", "item_text").collect()], min_words))  # within the bounds just checked
    corpus = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = corpus.mapInArrow(_search(shared), SCHEMA)
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.words", (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))


def short_items(items: DataFrame, min_words: int = 10) -> DataFrame:
    """``(item_id, words)`` of the items that can't be sought, as they have fewer words; those without text have none."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sum(1 for _ in words(t)) if t is not None else 0)

    return items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("bigint"), count("item_text").alias("words")).filter(F.col("words") < min_words).distinct()


def without_leaks(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold none of the found passages."""
    return documents.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
