"""Queries of the llm operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwright.llm.leakage import leaks, without_leaks
from stallwright.llm.mixture import Mixture, sized_documents, tempered
from stallwright.llm.pairs import PairCounts, PairScores, count_pairs, memberships
from stallwright.llm.skeleton import consistent_texts, look_classes, lookalike_pairs
from stallwright.llm.vocabulary import TermCounts, banded, changes, records
from stallwright.sources.tables import table
from stallwright.storage import materialize

FIELDS = ["name", "attribute_text", "tag_text"]
#: Where the incremental queries cut the tables into a first load and later changes.
CUT = "2025-11-20"


def _products(spark: SparkSession, d: str) -> DataFrame:
    return records(table(spark, d, "product_search_index"), "product_id", FIELDS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    counts = TermCounts(spark).add(_products(spark, d))
    return banded(counts, table(spark, d, "search_vocabulary")).filter("band IS NOT NULL").select("term", "band")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms of the catalog: a first load, then the changes up to now."""
    rows = table(spark, d, "product_search_index")
    before = records(rows.filter(F.col("indexed_at") < CUT), "product_id", FIELDS)
    counts = TermCounts(spark).add(before)
    return counts.apply(changes(before, records(rows, "product_id", FIELDS))).counts()


def p1_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary's terms with fresh counts and band."""
    return banded(TermCounts(spark).add(_products(spark, d)), table(spark, d, "search_vocabulary"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    counts = count_pairs(table(spark, d, "analytics_events"), "session_id", "product_id", 5)
    return counts.scores(8.0).select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """Pair scores after a first load and the changed sessions since."""
    events = table(spark, d, "analytics_events")
    now, then = memberships(events, "session_id", "product_id"), memberships(events.filter(F.col("created_at") < CUT), "session_id", "product_id")
    changed = now.join(then, ["basket", "item"], "left_anti").select("basket").distinct()
    was, new = then.join(changed, "basket", "left_semi"), now.join(changed, "basket", "left_semi")
    counts = PairCounts(spark, min_count=5).apply(then)
    scores = PairScores(counts)
    counts.apply(was, -1).apply(new)
    return scores.refresh(was.unionByName(new)).read().select("item_a", "item_b", "n", "n_a", "n_b", "lift")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, with the number of documents and the longest passage."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("words"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay in the corpus."""
    documents = table(spark, d, "documents")
    return without_leaks(documents, leaks(documents, table(spark, d, "eval_items"))).select("doc_id", "source", "lang")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents in all, those with a leak and those kept, which must add up, and the leaks still in what is kept: none."""
    documents, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    found = materialize(leaks(documents, items), "leaks")
    kept = without_leaks(documents, found)
    whole = documents.agg(F.count("*").alias("documents")).crossJoin(found.agg(F.count_distinct("doc_id").alias("leaking"))).crossJoin(kept.agg(F.count("*").alias("kept"))).crossJoin(leaks(kept, items).agg(F.count("*").alias("left")))  # one row each
    return whole.select("documents", (F.col("leaking") + F.col("kept")).alias("accounted"), "left")


def _mixture(spark: SparkSession, d: str, **how) -> Mixture:
    """Each source gives its target; within it, languages weigh the square root of their tokens, so small ones come up short and their siblings take the rest."""
    sized = materialize(sized_documents(table(spark, d, "documents")), "documents")
    return Mixture(sized, table(spark, d, "mix_targets"), weights={"language": tempered(sized, "language")}, **how)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).selection()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p9_budgets(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).budget_table()


def p9_fixed_size(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mixture as large as the corpus: sources that can't give theirs are short, and the others take the rest."""
    sized = materialize(sized_documents(table(spark, d, "documents")), "documents")
    whole = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return Mixture(sized, table(spark, d, "mix_targets"), weights={"language": tempered(sized, "language")}, total=float(whole)).shares()


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """``(source, reached, within_cap, siblings_filled)`` of each source with records: its share is its target but for half a record a
    leaf, no record is used more often than allowed, and where a language is short the others of the source take its part."""
    mix = _mixture(spark, d)
    largest = mix.sized.groupBy("source").agg(F.max("tokens").alias("largest"))
    leaves = mix.budget_table().groupBy("source").agg(F.count("*").alias("leaves"), F.sum("wanted").alias("wanted"), F.sum("budget").alias("budget"))
    rows = mix.shares().join(largest, "source").join(leaves, "source")
    reached = F.abs(F.col("tokens") - F.col("wanted")) <= F.col("leaves") * F.col("largest") / 2 + 1
    return rows.select("source", reached.alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("wanted") - F.col("budget")) < 1).alias("siblings_filled"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_classes(table(spark, d, "documents"))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    return consistent_texts(table(spark, d, "documents"))


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts with something to see before and after they are brought to one form, and those that a second time would change: none."""
    documents = table(spark, d, "documents")
    once = materialize(consistent_texts(documents), "once")
    again = consistent_texts(once).withColumnRenamed("text", "again")
    seen = F.count_if(F.col("text").rlike(r"[\p{L}\p{N}]"))
    changed = once.join(again, "doc_id").agg(F.count_if(F.col("text") != F.col("again")).alias("changed"))
    return documents.agg(seen.alias("texts")).crossJoin(once.agg(seen.alias("same"))).crossJoin(changed)  # one row each


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_vocabulary, p2_found, p2_changes, p8_found, p8_passages, p8_items, p8_clean, p8_checks, p9_mixture, p9_shares, p9_budgets, p9_fixed_size, p9_checks, p10_found, p10_classes, p10_texts, p10_checks)}

_KEY = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '')".format
_TERMS = f"""WITH fields AS (
  SELECT DISTINCT {_KEY('product_id')} AS product_id, unnest([name, attribute_text, tag_text]) AS txt, unnest([1, 2, 3]) AS f FROM product_search_index WHERE {_KEY('product_id')} IS NOT NULL),
 words AS (SELECT product_id, lower(unnest(regexp_extract_all(txt, '[A-Za-z0-9]+'))) AS term FROM fields),
 counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT product_id) AS records FROM words GROUP BY 1)
"""
_BANDS = _TERMS + f""", voc AS (SELECT DISTINCT {_KEY('term')} AS term FROM search_vocabulary WHERE {_KEY('term')} IS NOT NULL),
 bands AS (SELECT term, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records,
  CASE WHEN coalesce(records, 0) <= 2 THEN 'rare' WHEN records * 10 > (SELECT count(DISTINCT product_id) FROM fields) THEN 'common' END AS band FROM voc LEFT JOIN counts USING (term))
"""
_PAIRS = f"""WITH m AS (SELECT DISTINCT {_KEY('session_id')} AS s, {_KEY('product_id')} AS p FROM analytics_events WHERE {_KEY('session_id')} IS NOT NULL AND {_KEY('product_id')} IS NOT NULL),
 one AS (SELECT p, count(*) AS n FROM m GROUP BY 1),
 two AS (SELECT a.p AS item_a, b.p AS item_b, count(*) AS n FROM m a JOIN m b ON a.s = b.s AND a.p < b.p GROUP BY ALL HAVING count(*) >= 5),
 scored AS (SELECT item_a, item_b, two.n, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT s) FROM m) AS total FROM two JOIN one x ON x.p = item_a JOIN one y ON y.p = item_b)
"""

ORACLE = {
    "p1_found": _BANDS + "SELECT term, band FROM bands WHERE band IS NOT NULL",
    "p1_terms": _TERMS + "SELECT * FROM counts",
    "p1_vocabulary": _BANDS + "SELECT * FROM bands",
    "p2_found": _PAIRS + "SELECT item_a AS product_a, item_b AS product_b FROM scored WHERE n * total >= 8 * n_a * n_b",
    "p8_checks": 'SELECT count(*) AS documents, count(*) AS accounted, 0::BIGINT AS "left" FROM documents',
    "p10_checks": r"SELECT count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) AS texts, count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) AS same, 0::BIGINT AS changed FROM documents",
    "p9_checks": f"""WITH held AS (SELECT DISTINCT translate({_KEY('source')}, ' -', '__') AS source FROM documents WHERE length(text) > 0)
 SELECT translate({_KEY('m.source')}, ' -', '__') AS source, true AS reached, true AS within_cap, true AS siblings_filled FROM mix_targets m JOIN held ON held.source = translate({_KEY('m.source')}, ' -', '__') WHERE target_share > 0""",
    "p2_changes": _PAIRS + "SELECT item_a, item_b, n, n_a, n_b, n * total::DOUBLE / (n_a * n_b) AS lift FROM scored",
}
