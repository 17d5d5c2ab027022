"""Visually identical text with different characters, by a confusables skeleton.

Decompose, replace every character by its prototype, decompose again. Prototypes come from
rules over the character database (width forms, joined letters, kinds of space, invisible
characters) and from a table of letters of one shape. Case, digits and visible accents
stay apart.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwright.llm.pairs import block_pairs
from stallwright.storage import materialize

# Letters of Latin, Greek and Cyrillic of the same shape, each with its prototype; the prototypes are Latin where there is such a letter.
SAME_SHAPE = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G", "Һ": "h", "Ѵ": "V", "Ӕ": "Æ", "Ә": "Ə", "Ө": "Ɵ", "Ѳ": "Ɵ", "Ӡ": "Ʒ", "Ԑ": "Ɛ",
    "Г": "Γ", "Л": "Λ", "П": "Π", "Ф": "Φ", "Ѱ": "Ψ",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    "ѵ": "v", "ӕ": "æ", "ә": "ə", "ө": "ɵ", "ѳ": "ɵ", "ӡ": "ʒ", "ԑ": "ɛ", "з": "ɜ", "ћ": "ħ", "в": "ʙ", "н": "ʜ", "м": "ᴍ", "т": "ᴛ", "я": "ᴙ", "ԍ": "ɢ", "к": "ĸ",
    "ф": "φ", "ѱ": "ψ", "ѡ": "ω",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J", "Ϝ": "F", "Ϻ": "M", "Ϸ": "Þ", "Ͻ": "Ɔ",
    # Greek small letters
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j", "κ": "ĸ", "ε": "ɛ", "τ": "ᴛ", "ϸ": "þ", "ͻ": "ɔ",
    # Latin letters
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɣ": "y", "ʏ": "y", "ʋ": "u", "ǝ": "ə", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ᴋ": "ĸ", "Đ": "Ð", "Ɖ": "Ð", "Ʃ": "Σ", "ɸ": "φ", "µ": "μ", "ß": "β",
}
# Marks of the same shape, which count only where asked for.
SAME_MARKS = {"‐": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "’": "'", "‘": "'", "‛": "'", "ʼ": "'", "′": "'", "ʹ": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "…": "...", "·": "•", "∑": "Σ", "∏": "Π", "∆": "Δ"}
#: Format characters that are visible, and invisible ones of other categories.
VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Texts of one look are paired in blocks of about so many.
LONG = 1000
_CONTROLS = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


class Prototypes(dict):
    """What each character of decomposed text looks like, found when first met; empty for an invisible one.

    Forms of another width or font, letters that must not break and joined letters are their
    plain ones by the character database; ``shapes`` names further pairs, and goes before the rest.
    """

    def __init__(self, shapes: dict[str, str]):
        super().__init__()
        self.shapes = shapes

    def of(self, char: str) -> str:
        code, kind = ord(char), unicodedata.category(char)
        if char in self.shapes:
            return self.shapes[char]
        if code in INVISIBLE or kind == "Cf" and code not in VISIBLE_FORMATS or kind == "Cc" and char not in "\t\n\v\f\r\x85":
            return ""
        if kind == "Zs":
            return " "
        tag, *parts = unicodedata.decomposition(char).split() or [""]
        plain = "".join(chr(int(p, 16)) for p in parts) if tag.startswith("<") else ""
        joined = tag == "<compat>" and len(plain) > 1 and plain.isalpha()
        if tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or joined:
            return "".join(self.of(c) for c in unicodedata.normalize("NFD", plain))
        return char

    def __missing__(self, code: int) -> str:
        self[code] = found = self.of(chr(code))
        return found


LETTERS, LETTERS_AND_MARKS = Prototypes(SAME_SHAPE), Prototypes(SAME_SHAPE | SAME_MARKS)


def skeleton(text: str, prototypes: Prototypes = LETTERS) -> str:
    """The skeleton of a text; texts that look the same have the same one."""
    if text.isascii():
        return _CONTROLS.sub("", text)
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes))


def consistent(text: str, prototypes: Prototypes = LETTERS) -> str:
    """The consistent form of a text: its skeleton with accents composed again."""
    return unicodedata.normalize("NFC", skeleton(text, prototypes))


def _map_texts(make, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(make(batch), schema=schema)

    return run


def consistent_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` with every text in its consistent form; a null text stays null."""

    def make(batch):
        return [batch.column(0), pa.array([t if t is None else consistent(t) for t in batch.column(1).to_pylist()], pa.string())]

    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_map_texts(make, pa.schema([("doc_id", pa.int64()), ("text", pa.string())])), "doc_id bigint, text string")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", marks: bool = False, shapes: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, look, exact)``: SHA-256 of the skeleton and of the text, of texts that are neither missing nor blank (to the eye).

    ``marks`` lets dashes, quotes and other marks of one shape count as one too; ``shapes``
    adds pairs of characters, as of further scripts.
    """
    prototypes = Prototypes(SAME_SHAPE | (SAME_MARKS if marks else {}) | (shapes or {}))

    def make(batch):
        ids, looks, exacts = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (s := skeleton(t, prototypes)).strip():
                ids.append(i)
                looks.append(hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest())
                exacts.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest())
        return [pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(exacts, pa.binary())]

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_map_texts(make, pa.schema([("doc_id", pa.int64()), ("look", pa.binary()), ("exact", pa.binary())])), "doc_id bigint, look binary, exact binary")


def look_classes(documents: DataFrame, **how) -> DataFrame:
    """``(doc_id, class_id, n_docs, n_texts)``, one row per document that has text: the smallest doc_id
    whose text looks the same, and the documents and different texts of that class."""
    prints = fingerprints(documents, **how)
    texts = prints.groupBy("look", "exact").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"))
    classes = texts.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("docs").alias("n_docs"), F.count("*").alias("n_texts"))
    return prints.select("doc_id", "look").join(classes, "look").select("doc_id", "class_id", "n_docs", "n_texts").distinct()


def lookalike_pairs(documents: DataFrame, **how) -> DataFrame:
    """``(doc_a, doc_b)``: documents whose texts differ as strings and look the same.

    Exact copies are one text, standing for its smallest doc_id (``look_classes`` has the
    membership), so a text copied a million times gives no more pairs than one. The texts of
    one look are paired in blocks, so that no look's pairs are one task's. Missing and blank
    texts give none; neither do repeated rows. ``how`` goes to ``fingerprints``.
    """
    texts = materialize(fingerprints(documents, **how).groupBy("look", "exact").agg(F.min("doc_id").alias("doc")).select("look", "doc"), "looks")
    several = texts.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look", F.ceil(F.col("n") / LONG).alias("blocks"))
    kept = texts.join(several, "look").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    blocks = kept.groupBy("look", "block", "blocks").agg(F.collect_list("doc").alias("codes"))
    return block_pairs(blocks, ["look"]).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
