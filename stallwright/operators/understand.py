"""Understanding query texts: words, price limits, synonyms, entities of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwright.functions.text import collapsed, identifier, tokens
from stallwright.operators.search import spell_corrections
from stallwright.storage import materialize

# Words without meaning for a search; plural and short forms; comparators; suffixes of amounts.
STOP_WORDS = ["the", "a", "an", "and", "or", "for", "with", "in", "on", "of", "to", "is", "are", "best", "good", "cheap", "buy", "new", "online", "price", "prices", "rate", "rates"]
SHORT_FORMS = {"mobiles": "mobile", "phones": "phone", "laptops": "laptop", "tvs": "tv", "television": "tv", "headphones": "headphone", "earphones": "earphone", "sneakers": "sneaker", "shoes": "shoe", "shirts": "shirt", "tshirts": "tshirt", "watches": "watch"}
MAX_PRICE, MIN_PRICE = "under|below|upto|up to|less than|max|maximum|cheaper than", "above|over|more than|min|minimum|greater than|atleast"
SUFFIXES = {"k": 1_000, "l": 100_000, "lakh": 100_000, "lakhs": 100_000, "cr": 10_000_000, "crore": 10_000_000, "crores": 10_000_000}
# Synonyms, with whether they hold both ways.
SYNONYMS = [
    ("cell phone", "smartphone", True), ("mobile phone", "smartphone", True), ("cellphone", "smartphone", True), ("handset", "smartphone", False), ("tv", "television", True),
    ("sneakers", "sneaker", True), ("sneaker", "shoe", False), ("laptop computer", "laptop", True), ("notebook", "laptop", False), ("headphone", "headphones", True),
    ("earbud", "earphone", False), ("tshirt", "t-shirt", True), ("tee", "t-shirt", False), ("trouser", "pant", True), ("jumper", "hoodie", False),
    ("back cover", "phone case", False), ("phone cover", "phone case", False), ("mobile case", "phone case", False), ("protector", "screen protector", False),
]
PHRASE, APPLY = 4, 0.6
_AMOUNT = r"((?:₹|rs\.?|inr)?\s*[0-9][0-9,]*(?:\.[0-9]{1,2})?(?:\s*(?:k|l|lakhs?|cr|crores?))?)\b"


def amount_minor(text: Column) -> Column:
    """An amount such as ``1.5k`` or ``rs 2,000`` in minor units; null if it isn't one."""
    number = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1), ",", "")
    times = F.coalesce(F.create_map(*(x for k, v in SUFFIXES.items() for x in (F.lit(k), F.lit(v))))[F.regexp_extract(text, r"([a-z]+)\s*$", 1)], F.lit(1))
    return (number.try_cast("decimal(18,2)") * times * 100).cast("bigint")


def price_limits(query: Column) -> tuple[Column, Column]:
    """``(least, most)`` in minor units of phrases such as ``under 500``, ``over 2k``, ``between 5 and 9``, ``5 to 9``; null if unsaid, swapped if the wrong way round."""
    text = F.lower(query)
    found = lambda pattern, group=1: amount_minor(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))
    span = rf"(?:between\s+)?{_AMOUNT}\s+(?:to|and)\s+{_AMOUNT}"
    least = F.coalesce(found(span, 1), found(rf"\b(?:{MIN_PRICE})\s+{_AMOUNT}"))
    most = F.coalesce(found(span, 2), found(rf"\b(?:{MAX_PRICE})\s+{_AMOUNT}"))
    return F.when(least > most, most).otherwise(least), F.when(least > most, least).otherwise(most)


def search_words(query: Column) -> Column:
    """The words that carry meaning: without price phrases and stop words, long runs of a letter cut to two, plurals folded. All words if none would be left."""
    text = F.regexp_replace(F.lower(query), rf"(?:\b(?:{MAX_PRICE}|{MIN_PRICE}|between)\s+{_AMOUNT})(?:\s+(?:to|and)\s+{_AMOUNT})?", " ")
    short = F.create_map(*(F.lit(x) for pair in SHORT_FORMS.items() for x in pair))
    clean = lambda c: F.transform(tokens(c), collapsed)
    kept = F.filter(clean(text), lambda w: ~w.isin(STOP_WORDS))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(clean(query)), lambda w: F.coalesce(short[w], w))


def synonym_table(spark: SparkSession, pairs=SYNONYMS) -> DataFrame:
    """``(term, means)``, both ways where a pair holds both ways."""
    both = sorted({(a, b) for a, b, _ in pairs} | {(b, a) for a, b, two in pairs if two})
    return spark.createDataFrame(both, "term string, means string")


def expand_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(query, phrase, means)``: the synonyms of every phrase of up to PHRASE words of each query."""
    return _phrases(queries).join(synonyms, F.col("phrase") == F.col("term")).select("query", "phrase", "means").distinct()


def _phrases(queries: DataFrame) -> DataFrame:
    """All runs of up to PHRASE words; ``queries`` has the text, or also its ``words``."""
    own = F.col("words") if "words" in queries.columns else search_words(F.col("query"))
    words = queries.select("query", own.alias("words")).filter(F.size("words") > 0)
    at = words.select("query", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("start"))
    spans = at.select("query", "words", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(PHRASE), F.size("words") - F.col("start") + 1))).alias("size"))
    return spans.select("query", F.size("words").alias("n"), "start", "size", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("phrase"))


def lexicon(catalog: DataFrame, options: DataFrame) -> DataFrame:
    """``(term, kind, value, products, ambiguity)``: names of brands, categories and attribute values; ambiguity counts the meanings of a term."""
    brands = catalog.groupBy(F.col("brand_name").alias("value")).agg(F.count("*").alias("products")).select(F.lit("BRAND").alias("kind"), "value", "products")
    last = F.element_at(F.split("category_path", "/"), -1)
    categories = catalog.groupBy(last.alias("value")).agg(F.count("*").alias("products")).select(F.lit("CATEGORY").alias("kind"), "value", "products")
    held = catalog.select(F.explode(F.array_distinct(tokens(F.col("attribute_text")))).alias("value")).groupBy("value").agg(F.count("*").alias("products"))
    attributes = options.select(F.lower(F.trim("slug")).alias("value")).distinct().join(held, "value", "left").select(F.lit("ATTRIBUTE").alias("kind"), "value", F.coalesce("products", F.lit(0)).alias("products"))
    term = F.array_join(tokens(F.regexp_replace("value", r"-[0-9]+$", "")), " ")
    entries = brands.unionByName(categories).unionByName(attributes).filter("value IS NOT NULL").withColumn("term", term).filter("term <> ''")
    merged = entries.groupBy("term", "kind", "value").agg(F.max("products").alias("products"))
    return merged.withColumn("ambiguity", F.count("*").over(W.partitionBy("term")))


def extract_entities(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """``(query, phrase, start, size, kind, value, confidence)``: what the phrases of each query name.

    The longest phrase first, then the earlier; a phrase with one meaning and confidence of at
    least APPLY takes its words, which no later phrase may use. The choice is a fold over the
    few spans of a query, in the JVM.
    """
    doubt = F.least(F.lit(1.0), F.log10(F.col("products") + 1) / 3)
    confidence = F.round(F.least(F.lit(1.0), (F.lit(0.6) / F.col("ambiguity") + F.lit(0.4) * doubt) * F.when(F.col("n") <= 2, 1.0).otherwise(0.85)), 3)
    found = _phrases(queries).join(entries, F.col("phrase") == F.col("term")).withColumn("confidence", confidence)
    span = F.struct((-F.col("size")).alias("o"), "start", "size", "phrase", F.array_sort(F.collect_list(F.struct("kind", "value", "confidence"))).alias("meanings"), F.max((F.col("ambiguity") == 1) & (F.col("confidence") >= APPLY)).alias("takes"))
    spans = found.groupBy("query", "start", "size", "phrase").agg(span.alias("span")).groupBy("query").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    bits = lambda s: F.aggregate(F.sequence(s["start"], s["start"] + s["size"] - 1), F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(F.pow(F.lit(2.0), i).cast("bigint")))
    start = F.struct(F.lit(0).cast("bigint").alias("mask"), F.filter(F.col("spans"), lambda s: F.lit(False)).alias("kept"))

    def step(state: Column, s: Column) -> Column:
        free = state["mask"].bitwiseAND(bits(s)) == 0
        mask = F.when(free & s["takes"], state["mask"].bitwiseOR(bits(s))).otherwise(state["mask"])
        return F.struct(mask.alias("mask"), F.when(free, F.concat(state["kept"], F.array(s))).otherwise(state["kept"]).alias("kept"))

    kept = spans.select("query", F.explode(F.aggregate("spans", start, step, lambda s: s["kept"])).alias("s"))
    return kept.select("query", "s.phrase", "s.start", "s.size", F.explode("s.meanings").alias("m")).select("query", "phrase", "start", "size", "m.kind", "m.value", "m.confidence")


# Words that name whom something is for.
GENDERS = {"men": "men", "mens": "men", "men's": "men", "man": "men", "male": "men", "women": "women", "womens": "women", "women's": "women", "woman": "women", "female": "women", "unisex": "unisex", "boys": "boys", "girls": "girls", "kids": "kids", "baby": "baby"}


def gender(word: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in GENDERS.items() for x in pair))[F.lower(word)]


def intent(code: Column, words: Column, brands: Column, categories: Column) -> Column:
    """NAVIGATIONAL, BRAND, CATEGORY, PRODUCT or BROAD, from whether it is a code, the number of words and of brands and categories named."""
    brand, category = brands > 0, categories > 0
    return F.when(code, "NAVIGATIONAL").when(words == 0, "BROAD").when(brand & ~category & (words <= 2), "BRAND").when(category, "CATEGORY").when(brand, "BRAND").when(words >= 3, "PRODUCT").otherwise("BROAD")


def intents(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``(query, intent)``."""
    named = entities.groupBy("query").agg(F.count_if(F.col("kind") == "BRAND").alias("brands"), F.count_if(F.col("kind") == "CATEGORY").alias("categories"))
    rows = queries.select("query").distinct().join(named, "query", "left")
    return rows.select("query", intent(identifier(F.col("query")), F.size(search_words(F.col("query"))), F.coalesce("brands", F.lit(0)), F.coalesce("categories", F.lit(0))).alias("intent"))


def plan_queries(queries: DataFrame, vocabulary: DataFrame, synonyms: DataFrame, entries: DataFrame, edits: int = 2, apply: float = 0.62) -> DataFrame:
    """One row per query of what it asks for.

    ``query``, ``code`` (it is a bare identifier), ``least`` and ``most`` (price), ``words``
    (meaningful, with corrections of confidence ``apply`` or more in place), ``corrected`` and
    ``suggested`` (``word>term``, those below it), ``canonical``, ``groups`` (each word with its
    synonyms' words), ``brand``, ``category``, ``attributes`` (what it names with a confidence
    of at least APPLY), ``genders`` and ``intent``. An identifier is its only word and is never
    corrected; a query without words has empty lists.
    """
    least, most = price_limits(F.col("query"))
    code = identifier(F.col("query"))
    base = materialize(queries.select("query").filter("query IS NOT NULL").distinct().select("query", code.alias("code"), F.when(~code, least).alias("least"), F.when(~code, most).alias("most"), F.when(code, F.array(F.lower("query"))).otherwise(search_words(F.col("query"))).alias("said")), "queries")
    each = base.select("query", "code", F.posexplode("said").alias("at", "word"))
    better = materialize(spell_corrections(each.filter("NOT code").select("word"), vocabulary, edits), "corrections")
    fixed = each.join(better, "word", "left").withColumn("sure", F.coalesce(F.col("confidence") >= apply, F.lit(False)) & ~F.col("code"))
    note = F.concat("word", F.lit(">"), "term")
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("at", value.alias("v"))))), lambda x: x["v"])
    own = fixed.groupBy("query").agg(ordered(F.when(F.col("sure"), F.col("term")).otherwise(F.col("word"))).alias("words"), ordered(F.when(F.col("sure"), note)).alias("corrected"), ordered(F.when(~F.col("sure") & ~F.col("code"), note)).alias("suggested"))
    words = materialize(base.drop("said").join(own, "query", "left").select("query", "code", "least", "most", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("words", "corrected", "suggested"))), "words")
    means = synonyms.select("term", F.explode(tokens(F.col("means"))).alias("m")).groupBy(F.col("term").alias("word")).agg(F.array_sort(F.collect_set("m")).alias("also"))
    groups = words.select("query", F.posexplode("words").alias("at", "word")).join(means, "word", "left").groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.array_distinct(F.concat(F.array("word"), F.coalesce("also", F.array().cast("array<string>")))).alias("g")))), lambda x: x["g"]).alias("groups"))
    named = extract_entities(words.filter("NOT code").select("query", "words"), entries).filter(F.col("confidence") >= APPLY)
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("start", "value"))).getField("value")
    found = named.groupBy("query").agg(first("BRAND").alias("brand"), first("CATEGORY").alias("category"), F.array_sort(F.collect_set(F.when(F.col("kind") == "ATTRIBUTE", F.col("value")))).alias("attributes"), F.count_if(F.col("kind") == "BRAND").alias("brands"), F.count_if(F.col("kind") == "CATEGORY").alias("categories"))
    rows = words.join(groups, "query", "left").join(found, "query", "left")
    return rows.select(
        "query", "code", "least", "most", "words", "corrected", "suggested", F.array_join(F.array_sort(F.array_distinct("words")), " ").alias("canonical"), F.coalesce("groups", F.array().cast("array<array<string>>")).alias("groups"),
        "brand", "category", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"), F.array_sort(F.array_distinct(F.array_compact(F.transform("words", gender)))).alias("genders"),
        intent(F.col("code"), F.size("words"), F.coalesce("brands", F.lit(0)), F.coalesce("categories", F.lit(0))).alias("intent"),
    )
