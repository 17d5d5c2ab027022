"""Frequency of every distinct term, kept by signed deltas.

Only added, changed and deleted records are tokenised. Their terms become signed
occurrence and record-count changes, summed before the shuffle and merged into
hash-partitioned counts. The number of records itself is the count of the null term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwright.functions.keys import norm_key
from stallwright.storage import BucketStore, scratch

#: A word is a longest run of ASCII letters and digits.
WORD = "[A-Za-z0-9]+"
#: A record of more texts than this and than this share of all is hot; there can't be more than 1 / share.
HOT_TEXTS, HOT_SHARE = 100_000, 0.001


def records(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(record_id, text)``: the field texts of each record, marked with their field; a record without text has one null.

    Rows without key are no records. Null fields add nothing, and repeated rows, which may
    be among them, count once.
    """
    texts = F.array_compact(F.array(*(F.concat(F.lit(f"{f}\x00"), F.col(f)) for f in fields)))
    own = rows.select(norm_key(key).alias("record_id"), texts.alias("texts")).filter("record_id IS NOT NULL")
    return own.select("record_id", F.explode_outer("texts").alias("text"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(record_id, text, sign)`` of the records that were added, changed or deleted between two states, whole as they were and as they are; unchanged records give nothing."""
    both = before.withColumn("was", F.lit(True)).unionByName(after.withColumn("was", F.lit(False)))
    texts = both.groupBy("record_id", "text").agg(F.bool_or("was").alias("was"), F.bool_or(~F.col("was")).alias("now"))
    ids = texts.filter("was <> now").select("record_id").distinct()
    sides = F.array_compact(F.array(F.when(F.col("was"), F.lit(-1)), F.when(F.col("now"), F.lit(1))))
    return texts.join(ids, "record_id", "left_semi").select("record_id", "text", F.explode(sides).alias("sign"))


def _hot_records(changed: DataFrame) -> list[str]:
    """The ids of records so large that one task should not count them; a sketch of bounded size finds every one of that share."""
    seen = changed.select("record_id").agg(F.count("*").alias("n"), F.expr(f"approx_top_k(record_id, {int(1 / HOT_SHARE)}, {int(20 / HOT_SHARE)})").alias("top")).first()
    least = max(HOT_TEXTS, seen["n"] * HOT_SHARE)
    return [t["item"] for t in seen["top"] or [] if t["count"] > least]


def term_deltas(changed: DataFrame) -> DataFrame:
    """``(term, occurrences, records)`` from ``(record_id, text, sign)``.

    A record's texts meet in one task, which counts its terms there, so what crosses the wire
    is the texts once and one row a term and task. Hot records, which would be too much for
    one task, are spread by text and again by term instead. The null term counts the records.
    """
    words = F.transform(F.regexp_extract_all(F.regexp_replace("text", "^[^\x00]*\x00", ""), F.lit(f"({WORD})"), 1), lambda w: F.lower(w))
    terms = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(words, F.array()))

    def counted(rows: DataFrame) -> DataFrame:
        each = rows.select("record_id", "text", "sign").distinct().select("record_id", "sign", F.explode(terms).alias("term"))
        return each.groupBy("record_id", "sign", "term").agg(F.count("term").alias("n"))

    hot = _hot_records(changed)
    if hot:
        held = counted(changed.filter(~F.col("record_id").isin(hot)).repartition("record_id")).unionByName(counted(changed.filter(F.col("record_id").isin(hot))))
    else:
        held = counted(changed.repartition("record_id"))
    return held.groupBy("term").agg(F.sum(F.col("n") * F.col("sign")).alias("occurrences"), F.sum(F.col("sign").cast("bigint")).alias("records"))


class TermCounts:
    """Persistent counts of every term; state below ``path``."""

    def __init__(self, spark, path: str | None = None, buckets: int | None = None):
        self.store = BucketStore(spark, path or scratch(spark, "terms"), {"term": "string"}, ["occurrences", "records"], buckets)

    def apply(self, changed: DataFrame) -> "TermCounts":
        self.store.apply(term_deltas(changed))
        return self

    def add(self, added: DataFrame) -> "TermCounts":
        return self.apply(added.withColumn("sign", F.lit(1)))

    @property
    def size(self) -> int:
        row = self.store.read().filter("term IS NULL").select("records").first()
        return row[0] if row else 0

    def counts(self) -> DataFrame:
        """``(term, occurrences, records)``."""
        return self.store.read().filter("term IS NOT NULL")


def banded(counts: TermCounts, vocabulary: DataFrame, term: str = "term", rare: int = 2, common: float = 0.1) -> DataFrame:
    """``(term, occurrences, records, band)`` of each distinct vocabulary term.

    ``rare``: in at most ``rare`` records, none included; ``common``: in more than the share
    ``common`` of all; else null. Blank and null terms are left out.
    """
    terms = vocabulary.select(norm_key(term).alias("term")).filter("term IS NOT NULL").distinct()
    found = terms.join(counts.counts(), "term", "left")
    n = F.coalesce("records", F.lit(0))
    band = F.when(n <= rare, "rare").when(n > F.lit(common) * F.lit(counts.size), "common")
    return found.select("term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), n.alias("records"), band.alias("band"))
