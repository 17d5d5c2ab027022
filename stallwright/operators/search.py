"""A field-weighted inverted index as DataFrames, and batches of queries ranked over it.

The index is three tables: postings (product, field, term, tf), documents (length and
nudges) and vocabulary (term, df); ``index`` stores them. A batch of queries is expanded against the vocabulary
(exact; the last word by prefix; a word without either by few edits), joined to the postings
on the term, and summed per query and product. A hot term is one key of that join, whose
posting side adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions.text import damerau_levenshtein, dice, gram_dice, jaro_winkler, jaro_winkler_similarity, ngrams, protected, tokens
from stallwright.operators.attributes import MAX_OPTIONS
from stallwright.storage import default_buckets

# Field weights and BM25 parameters.
FIELD_WEIGHTS = {"name": 4.0, "brand_name": 2.5, "category_path": 2.5, "tag_text": 1.6, "attribute_text": 1.6, "sku_text": 1.4, "description_text": 1.0}
K1, B = 1.2, 0.75
POPULARITY_NUDGE, RATING_NUDGE = 0.001, 0.01
# Expansions of one query word, words of one query.
MAX_PREFIX, MAX_FUZZY, MAX_WORDS, MIN_FUZZY_LENGTH, LONG_WORD = 32, 16, 8, 4, 7
# Values compared at once; letters, digits and the hyphen are of different classes.
MATCH_BLOCK, LETTER_CLASSES = 500, 79
# Upper ends of the price bands, in minor units.
PRICE_BANDS = [100_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000]


def postings(catalog: DataFrame) -> DataFrame:
    """``(product_id, field, term, tf)``; null and empty fields have none."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in FIELD_WEIGHTS))
    each = catalog.select("product_id", F.explode(fields).alias("f")).select("product_id", "f.field", F.explode("f.terms").alias("term"))
    return each.groupBy("product_id", "field", "term").agg(F.count("*").alias("tf"))


def nudge():
    """What a product's popularity and rating add to any of its scores."""
    rating = F.coalesce(F.nanvl("rating_average", F.lit(None).cast("double")), F.lit(0.0))
    return F.least(F.coalesce("popularity", F.lit(0.0)), F.lit(100.0)) * POPULARITY_NUDGE + F.greatest(F.lit(0.0), F.least(rating, F.lit(5.0))) * RATING_NUDGE


def documents(catalog: DataFrame, posted: DataFrame) -> DataFrame:
    """``(product_id, length, nudge)``; a product without words has length 0."""
    lengths = posted.groupBy("product_id").agg(F.sum("tf").alias("length"))
    return catalog.select("product_id", nudge().alias("nudge")).join(lengths, "product_id", "left").select("product_id", F.coalesce("length", F.lit(0)).alias("length"), "nudge")


def vocabulary(posted: DataFrame) -> DataFrame:
    """``(term, df, tf)``: the products a term is in, and how often it is posted."""
    per = posted.groupBy("term", "product_id").agg(F.sum("tf").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def complete_prefix(prefixes: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """``(prefix, term, df, rank)``: the terms that begin with each prefix, the most frequent first."""
    found = _by_prefix(prefixes.select("prefix").distinct(), words)
    rank = F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("df"), "term"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _by_prefix(prefixes: DataFrame, words: DataFrame) -> DataFrame:
    """An equi-join on every prefix of every term, in place of a range join."""
    cut = words.select("term", "df", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("k")).select("term", "df", F.substring(F.col("term"), F.lit(1), F.col("k")).alias("prefix"))
    return cut.join(prefixes, "prefix")


def _blocks(term: str, edits: int):
    """Keys of which two terms that few edits apart share one: each term with up to so many letters left out, and itself."""
    size = F.length(term)

    def without(forms):
        return F.flatten(F.transform(forms, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, size)))))

    forms = last = F.array(F.col(term))
    for _ in range(edits):
        last = F.array_distinct(without(last))
        forms = F.concat(forms, last)
    return F.array_distinct(forms)


def edits_for(word: Column, most: int) -> Column:
    """The edits that a word may be off: none below four letters, one below seven, then two, never more than ``most``."""
    size = F.length(word)
    return F.when(size < MIN_FUZZY_LENGTH, 0).when(size < LONG_WORD, F.least(F.lit(1), F.lit(most))).otherwise(F.least(F.lit(2), F.lit(most)))


def near_terms(wanted: DataFrame, words: DataFrame, edits: int = 1) -> DataFrame:
    """``(word, term, df, distance)``: terms at most ``edits`` (one or two) from each ``word``; two edits only for words of seven letters or more.

    Blocking is lossless: two words k insertions, deletions, substitutions or swaps of
    neighbours apart share a form with up to k letters left out of each.
    """
    each = wanted.select("word").distinct()

    def near(own: DataFrame, terms: DataFrame, k: int) -> DataFrame:
        pairs = own.withColumn("block", F.explode(_blocks("word", k))).join(terms.select("term", "df").withColumn("block", F.explode(_blocks("term", k))), "block")
        close = pairs.select("word", "term", "df").distinct().filter((F.abs(F.length("word") - F.length("term")) <= k) & (F.levenshtein("word", "term", 2 * k) >= 0))  # a swap counts twice there
        return close.withColumn("distance", damerau_levenshtein("word", "term")).filter(F.col("distance") <= k)

    if edits < 2:
        return near(each, words, 1)
    long = F.length("word") >= LONG_WORD
    return near(each.filter(~long), words, 1).unionByName(near(each.filter(long), words.filter(F.length("term") >= LONG_WORD - 2), 2))


def fuzzy_terms(wanted: DataFrame, words: DataFrame, limit: int = MAX_FUZZY, edits: int = 1) -> DataFrame:
    """``(word, term, df, distance, rank)``: the nearest ``limit`` terms of each ``word``, then the most frequent."""
    rank = F.row_number().over(W.partitionBy("word").orderBy("distance", F.desc("df"), "term"))
    return near_terms(wanted, words, edits).withColumn("rank", rank).filter(F.col("rank") <= limit)


def correction_confidence() -> Column:
    """How sure it is that ``term``, ``distance`` edits from ``word`` and in ``df`` products, was meant."""
    return F.round(F.least(F.lit(1.0), F.lit(0.6) * F.greatest(F.lit(0.0), 1 - F.col("distance") / F.length("word")) + F.lit(0.4) * F.least(F.lit(1.0), F.log10(F.col("df") + 1) / 3)), 3)


def spell_corrections(wanted: DataFrame, words: DataFrame, edits: int = 1, least: float = 0.55) -> DataFrame:
    """``(word, term, distance, similarity, confidence)``: the best correction of each word that is no term.

    Numbers, words that end in a digit, and those of one or two letters are left alone. The
    nearest term wins, then the most similar to three places (by Jaro-Winkler or trigrams, at
    least ``least``), then the most frequent, then the first.
    """
    unknown = wanted.select("word").distinct().filter((edits_for(F.col("word"), edits) > 0) & ~protected(F.col("word"))).join(words.select(F.col("term").alias("word")), "word", "left_anti")
    alike = F.greatest(jaro_winkler("word", "term"), dice(ngrams(F.col("word")), ngrams(F.col("term"))))
    found = near_terms(unknown, words, edits).filter(F.col("distance") <= edits_for(F.col("word"), edits)).withColumn("similarity", F.round(alike, 3)).filter(F.col("similarity") >= least)
    rank = F.row_number().over(W.partitionBy("word").orderBy("distance", F.desc("similarity"), F.desc("df"), "term"))
    return found.withColumn("rank", rank).filter("rank = 1").select("word", "term", "distance", "similarity", correction_confidence().alias("confidence"))


def expand(queries: DataFrame, words: DataFrame, edits: int = 1) -> DataFrame:
    """``(query, at, n, term, df, fuzzy, near)``: the terms that each word of each query stands for, and how near (1: it is the word or begins with it).

    ``queries`` has the text, or also its ``words`` in an array.
    """
    own = F.slice("words", 1, MAX_WORDS) if "words" in queries.columns else tokens(F.col("query"), MAX_WORDS)
    split = queries.select("query", own.alias("words")).filter(F.size("words") > 0)
    each = split.select("query", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    exact = each.join(words.select(F.col("term").alias("word"), "df"), "word").select("query", "at", "n", "word", F.col("word").alias("term"), "df")
    last = each.filter("at = n - 1")
    begun = _by_prefix(last.select(F.col("word").alias("prefix")).distinct(), words)
    begun = begun.withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy("term"))).filter(F.col("rank") <= MAX_PREFIX)
    prefixed = last.join(begun.withColumnRenamed("prefix", "word"), "word").select("query", "at", "n", "word", "term", "df")
    known = exact.unionByName(prefixed).distinct()
    lost = each.join(known.select("query", "at").distinct(), ["query", "at"], "left_anti").filter(F.length("word") >= MIN_FUZZY_LENGTH)
    fuzzy = lost.join(fuzzy_terms(lost, words, MAX_FUZZY, edits), "word").select("query", "at", "n", "term", "df", F.lit(True).alias("fuzzy"), (1 - F.col("distance") / F.greatest(F.length("word"), F.length("term"))).alias("near"))
    return known.select("query", "at", "n", "term", "df", F.lit(False).alias("fuzzy"), F.lit(1.0).alias("near")).unionByName(fuzzy)


class _Letters:
    """Of each text the length, how many letters of each class it has, and its first four letters."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], dtype=np.int32)
        self.counts = np.zeros((LETTER_CLASSES, len(texts)), dtype=np.int32)
        self.first = np.zeros((4, len(texts)), dtype=np.int32)
        for k, t in enumerate(texts):
            for c in t:
                self.counts[ord(c) % LETTER_CLASSES, k] += 1
            self.first[: min(4, len(t)), k] = [ord(c) for c in t[:4]]

    def near(self, other: "_Letters", least: float) -> list[tuple[int, int]]:
        """The pairs that can reach ``least``: no more letters match, and no more trigrams agree, than letters are common."""
        common = np.zeros((len(self.texts), len(other.texts)), dtype=np.int32)
        for x, y in zip(self.counts, other.counts):
            if x.any() and y.any():
                common += np.minimum(x[:, None], y)
        same = np.ones(common.shape, dtype=bool)
        prefix = np.zeros(common.shape, dtype=np.int32)
        for x, y in zip(self.first, other.first):
            same &= x[:, None] == y
            prefix += same
        a, b = self.size[:, None], other.size
        jaro = (common / a + common / b + 1) / 3
        most = np.maximum(jaro + 0.1 * prefix * (1 - jaro), 2 * common / np.maximum(a + b - 4, 1))
        return list(zip(*(x.tolist() for x in np.nonzero(most >= least - 1e-6))))


def match_attributes(values: DataFrame, wanted: DataFrame, least: float = 0.6, limit: int = 5) -> DataFrame:
    """``(wanted, value, similarity)``: values like each wanted one, by the larger of Jaro-Winkler and trigram Dice.

    If both sides have a ``key``, only values of the same attribute are compared, and the
    result has it too. Each distinct wanted value meets every distinct value of its key, in
    blocks of the array of values that every task has; a pair isn't scored only if its common
    letters rule out ``least``.
    """
    spark, keyed = wanted.sparkSession, "key" in values.columns and "key" in wanted.columns

    def clean(df, c):
        key = F.coalesce("key", F.lit("")) if keyed else F.lit("")
        return df.select(key.alias("key"), F.lower(c).alias(c)).filter(F.length(c) > 0).distinct()

    held = clean(values, "value").limit(MAX_OPTIONS + 1).collect()
    if len(held) > MAX_OPTIONS:
        raise ValueError(f"more than {MAX_OPTIONS} values")
    by_key: dict[str, list[str]] = {}
    for r in held:
        by_key.setdefault(r["key"], []).append(r["value"])
    shared = spark.sparkContext.broadcast(by_key)  # at most MAX_OPTIONS

    def compare(batches):
        blocks = {k: [_Letters(v[i : i + MATCH_BLOCK]) for i in range(0, len(v), MATCH_BLOCK)] for k, v in shared.value.items()}
        for batch in batches:
            for key, rows in batch.groupby("key", sort=False):
                texts = rows["wanted"].tolist()
                for k in range(0, len(texts), MATCH_BLOCK):
                    left = _Letters(texts[k : k + MATCH_BLOCK])
                    for right in blocks.get(key, []):
                        pairs = [(left.texts[i], right.texts[j]) for i, j in left.near(right, least)]
                        scores = [max(jaro_winkler_similarity(x, y), gram_dice(x, y)) for x, y in pairs]
                        yield pd.DataFrame({"key": [key] * len(pairs), "wanted": [x for x, _ in pairs], "value": [y for _, y in pairs], "similarity": scores}).astype({"key": object, "wanted": object, "value": object, "similarity": "float64"})

    each = clean(wanted, "wanted").repartition(default_buckets(spark))  # few bytes but many pairs; by the key it would fall together with the exchange before, which is coalesced
    near = each.mapInPandas(compare, "key string, wanted string, value string, similarity double")
    scored = near.withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= least)
    rank = F.row_number().over(W.partitionBy("key", "wanted").orderBy(F.desc("similarity"), "value"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank", *([] if keyed else ["key"]))


def price_facet(catalog: DataFrame) -> DataFrame:
    """``(band, products, low, high)`` over half-open price bands; empty bands and null prices are left out."""
    band = F.lit(0)
    for end in PRICE_BANDS:
        band = band + (F.col("price_paise") >= end).cast("int")
    return catalog.filter("price_paise IS NOT NULL").groupBy(band.alias("band")).agg(F.count("*").alias("products"), F.min("price_paise").alias("low"), F.max("price_paise").alias("high"))


def value_facets(catalog: DataFrame, most: int = 50) -> DataFrame:
    """``(axis, value, products)``: brands, categories and attribute words, the most frequent ``most`` of each axis."""
    words = F.transform(F.array_distinct(tokens(F.col("attribute_text"))), lambda w: F.struct(F.when(w.rlike("(gb|tb)$"), "storage").otherwise("attribute").alias("axis"), w.alias("value")))
    pairs = F.concat(F.array(F.struct(F.lit("brand").alias("axis"), F.col("brand_name").alias("value")), F.struct(F.lit("category").alias("axis"), F.col("category_path").alias("value"))), words)
    counts = catalog.select(F.explode(pairs).alias("p")).select("p.*").filter("value IS NOT NULL").groupBy("axis", "value").agg(F.count("*").alias("products")).filter("products > 1")
    rank = F.row_number().over(W.partitionBy("axis").orderBy(F.desc("products"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most)


def page_after(catalog: DataFrame, order: str, cursor: tuple | None = None, size: int = 24) -> DataFrame:
    """Keyset paging: the ``size`` rows after ``(value, product_id)``, by ``order`` descending, nulls last."""
    rows = catalog
    if cursor is not None:
        value, key = cursor
        rows = rows.filter(F.col(order).isNull() & (F.col("product_id") > key) if value is None else (F.col(order) < value) | F.col(order).isNull() | ((F.col(order) == value) & (F.col("product_id") > key)))
    return rows.orderBy(F.col(order).desc_nulls_last(), "product_id").limit(size)


def rebuild_vocabulary(catalog: DataFrame, logs: DataFrame) -> DataFrame:
    """``(term, source, weight)``: words of the catalog and of successful queries; a word from several sources keeps the first named one."""
    sources = {"brand_name": ("BRAND", 50), "category_path": ("CATEGORY", 30), "tag_text": ("TAG", 6), "attribute_text": ("ATTRIBUTE", 2), "name": ("PRODUCT", 1)}
    parts = F.array(*(F.struct(F.lit(k).alias("priority"), F.lit(source).alias("source"), F.lit(weight).alias("weight"), F.array_distinct(tokens(F.col(c))).alias("terms")) for k, (c, (source, weight)) in enumerate(sources.items())))
    words = catalog.select(F.explode(parts).alias("p")).select("p.priority", "p.source", "p.weight", F.explode("p.terms").alias("term"))
    queries = logs.filter("result_count > 0 AND query IS NOT NULL").groupBy("query").agg(F.count("*").alias("n")).filter("n >= 3")
    observed = queries.select(F.lit(len(sources)).alias("priority"), F.lit("QUERY").alias("source"), F.lit(1).alias("weight"), F.explode(F.filter(F.array_distinct(tokens(F.col("query"))), lambda w: F.length(w) >= 3)).alias("term"))
    return words.unionByName(observed).groupBy("term").agg(F.min_by("source", "priority").alias("source"), F.sum("weight").alias("weight"))


def suggestions(catalog: DataFrame, logs: DataFrame) -> DataFrame:
    """``(term, kind, weight)``: all brands, categories, products and successful queries, the heaviest kind of each term."""
    kind = lambda rows, name, text, weight: rows.select(F.lower(F.trim(text)).alias("term"), F.lit(name).alias("kind"), weight.cast("double").alias("weight"))
    popular = F.least(F.lit(600.0), 6 * F.coalesce("popularity", F.lit(0.0)))
    queries = logs.filter("result_count > 0 AND query IS NOT NULL").groupBy("query").agg(F.count("*").alias("n"))
    rows = kind(catalog, "PRODUCT", F.col("name"), popular).unionByName(kind(catalog, "BRAND", F.col("brand_name"), F.lit(500))).unionByName(kind(catalog, "CATEGORY", F.element_at(F.split("category_path", "/"), -1), F.lit(450)))
    rows = rows.unionByName(kind(queries, "QUERY", F.col("query"), F.least(F.lit(1000), 10 * F.col("n"))))
    best = rows.filter("term <> ''").groupBy("term").agg(F.max(F.struct("weight", "kind")).alias("b"))
    return best.select("term", "b.kind", F.round("b.weight", 4).alias("weight"))
