"""Text as Column expressions, and edit distances as pandas UDFs (Spark has no transposition-aware one)."""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by decomposition."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.lower(F.regexp_replace(F.translate(text, *fold_table()), r"[\x{300}-\x{36f}]", ""))


def tokens(text: Column, most: int | None = None) -> Column:
    """Runs of letters and digits of the folded text; null gives none."""
    words = F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return words if most is None else F.slice(words, 1, most)


def canonical(text: Column) -> Column:
    """Sorted distinct tokens, the same for every order and spelling of a query."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(text))), " ")


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams; a shorter text is one gram."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(grams)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets; null if both are empty."""
    return F.try_divide(F.lit(2.0) * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def osa_distance(a: str, b: str) -> int:
    """Edits, including swaps of neighbours, none of which overlap (optimal string alignment)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def jaro_winkler_similarity(a: str, b: str) -> float:
    """Jaro similarity raised by up to four common first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                matched.append(x)
                break
    if not matched:
        return 0.0
    other = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(matched, other)) // 2
    m = len(matched)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def gram_dice(a: str, b: str, n: int = 3) -> float:
    """Dice on multisets of n-grams; texts shorter than n are compared as a whole."""
    if min(len(a), len(b)) < n:
        return float(a == b)
    x, y = (Counter(t[k : k + n] for k in range(len(t) - n + 1)) for t in (a, b))
    return 2 * (x & y).total() / (x.total() + y.total())


def common_subsequence(a: str, b: str) -> int:
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[j - 1]))
        last = row
    return last[-1]


def _pairwise(function, kind: T.DataType):
    @F.pandas_udf(kind)
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="object")

    return apply


damerau_levenshtein = _pairwise(osa_distance, T.IntegerType())
jaro_winkler = _pairwise(jaro_winkler_similarity, T.DoubleType())
ngram_similarity = _pairwise(gram_dice, T.DoubleType())
word_similarity = _pairwise(lambda needle, hay: max((gram_dice(needle, w) for w in hay.split()), default=0.0), T.DoubleType())
lcs_length = _pairwise(common_subsequence, T.IntegerType())


def fnv1a(text: Column) -> Column:
    """FNV-1a 32 bit over the UTF-16 units of a text, as a long."""
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)) % F.lit(4294967296)
    code = lambda c: F.ascii(c).cast("bigint")
    units = F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(code(c) < 65536, F.array(code(c))).otherwise(F.array(F.lit(55296) + F.shiftright(code(c) - 65536, 10), F.lit(56320) + (code(c) - 65536) % 1024))))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"), step)


def hmac_sha256(text: Column, secret: str) -> Column:
    """HMAC-SHA256 as hex, from two nested hashes; a null text stays null."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def sanitized(text: Column, most: int = 80) -> Column:
    """Control characters as blanks, runs of blanks as one, trimmed and cut to ``most`` characters; null gives the empty text."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    return F.substring(clean, 1, most)


def plain(text: Column, most: int = 180) -> Column:
    """A text without markup and character references."""
    return sanitized(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"(?i)&(?:#[0-9]+|#x[0-9a-f]+|\w+);", " "), most)


def slug(text: Column, most: int = 80) -> Column:
    """A name as a slug of at most ``most`` characters; ``product`` if nothing is left."""
    parts = F.regexp_replace(F.regexp_replace(fold(text), "&", " and "), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(parts, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("product"))


def value_key(text: Column) -> Column:
    """The key of an attribute value: trimmed, runs of blanks as one, in lower case."""
    return F.lower(F.regexp_replace(F.btrim(text), r"\s+", " "))


def value_label(text: Column, most: int = 60) -> Column:
    """The shown form of an attribute value: without control characters, runs of blanks as one."""
    return F.substring(F.btrim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""), r"\s+", " ")), 1, most)


def sku_fragment(keys: Column, most: int = 40) -> Column:
    """The letters and digits of each value key in upper case, joined by hyphens."""
    parts = F.filter(F.transform(keys, lambda k: F.regexp_replace(F.upper(k), "[^A-Z0-9]+", "")), lambda k: k != "")
    return F.substring(F.array_join(parts, "-"), 1, most)


def derived_sku(prefix: Column, keys: Column) -> Column:
    """The same sku for the same product and values, whenever it is made."""
    head = F.coalesce(F.nullif(F.substring(F.regexp_replace(F.upper(prefix), "[^A-Z0-9]", ""), 1, 20), F.lit("")), F.lit("SKU"))
    tail = sku_fragment(keys)
    return F.when(tail == "", head).otherwise(F.substring(F.concat(head, F.lit("-"), tail), 1, 64))


def searchable(text: Column) -> Column:
    return F.length(sanitized(text)) >= 2


def collapsed(word: Column) -> Column:
    """Runs of three and more of a letter as two."""
    return F.regexp_replace(word, r"(.)\1{2,}", "$1$1")


def protected(word: Column) -> Column:
    """Whether a word is none to correct: a number, letters that end in a digit, or two letters at most."""
    return word.rlike("^[0-9]+$") | (word.rlike("[a-z]") & word.rlike("[0-9]$")) | (F.length(word) <= 2)


def identifier(text: Column) -> Column:
    """Whether a query is a bare code: no blank, a digit, and a barcode or a run of letters, digits, hyphens and underscores."""
    clean = F.btrim(text)
    return clean.rlike("[0-9]") & (clean.rlike("^[0-9]{8,14}$") | clean.rlike("^[A-Za-z0-9][A-Za-z0-9_-]{4,63}$"))


def overlap(query: Column, text: Column) -> Column:
    """The share of a query's distinct words that a word of the text begins with."""
    wanted, held = F.array_distinct(tokens(query)), tokens(text)
    hits = F.size(F.filter(wanted, lambda w: F.exists(held, lambda t: F.startswith(t, w))))
    return F.when((F.size(wanted) == 0) | (F.size(held) == 0), F.lit(0.0)).otherwise(hits / F.size(wanted))


# What the names of programs contain.
PROGRAMS = ["bot", "crawler", "spider", "curl", "wget", "python-requests", "httpclient", "scrapy", "headlesschrome", "phantomjs", "lighthouse"]


def by_program(agent: Column) -> Column:
    """Whether a request was a program's; without a name it was."""
    return F.coalesce(agent == "", F.lit(True)) | F.lower(agent).rlike("|".join(PROGRAMS))


def safe_url(url: Column) -> Column:
    """Whether an address is one of this site, or https without blanks; backslashes never are."""
    plain_ = F.instr(url, "\\") == 0
    own = F.startswith(url, F.lit("/")) & ~F.startswith(url, F.lit("//")) & (F.instr(url, "://") == 0)
    return plain_ & (own | (F.startswith(url, F.lit("https://")) & (F.instr(url, " ") == 0)))


def labelled_lines(text: Column) -> Column:
    """``label: value`` lines as an array of pairs; other lines are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.instr(x, ":") > 1)
    return F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)).alias("label"), F.btrim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))


def register(spark) -> None:
    """Make the distances callable from SQL."""
    for name, udf in (("damerau_levenshtein", damerau_levenshtein), ("jaro_winkler", jaro_winkler), ("ngram_similarity", ngram_similarity), ("word_similarity", word_similarity), ("lcs_length", lcs_length)):
        spark.udf.register(name, udf)
