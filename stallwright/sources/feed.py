"""Catalog feeds as CSV or TSV: reading, naming of columns, validation of rows, duplicates."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The header names that each column goes by.
HEADERS = {
    "name": ["name", "product name", "title", "product title", "item name", "product"],
    "sku": ["sku", "item number", "item no", "product sku", "article number", "article no", "code", "product code"],
    "price": ["price", "unit price", "base price", "regular price", "mrp", "retail price", "list price"],
    "sale_price": ["sale price", "saleprice", "discounted price", "offer price", "special price", "selling price"],
    "stock": ["stock", "stock quantity", "quantity", "qty", "inventory", "available stock", "stock qty"],
    "image_url": ["image", "image url", "image_url", "main image", "primary image", "photo", "photo url"],
    "email": ["email", "e-mail", "contact email", "supplier email"],
}
AMOUNT = r"^[₹$€£]?\s*[0-9][0-9,]*(\.[0-9]{1,2})?$"


def read_feed(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """The rows of a quoted feed with a header; unknown columns are kept, missing ones are null."""
    raw = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return map_columns(raw)


# The most bytes of a row, of a bare and of a quoted field, and the most columns.
MAX_ROW, MAX_BARE, MAX_QUOTED, MAX_COLUMNS = 256 * 1024, 16 * 1024, 64 * 1024, 256


def feed_rows(text: str, delimiter: str = ",") -> Iterator[tuple[int, list[str], str | None]]:
    """``(line, fields, issue)`` of every row of a feed, its first line counting from 1.

    A doubled quote stands for one; a quoted field may hold delimiters and line ends, and what
    follows its closing quote belongs to it; blank lines are no rows. A row beyond a limit has
    the issue ROW_TOO_LARGE, one that ends inside quotes UNCLOSED_QUOTE.
    """
    token = re.compile(r'"|\r\n|\n|\r|' + re.escape(delimiter))
    fields: list[str] = []
    parts: list[str] = []
    line = start = 1
    at, quoted, was_quoted = 0, False, False

    def row(issue: str | None = None):
        large = sum(map(len, fields)) > MAX_ROW or len(fields) > MAX_COLUMNS or any(len(f) > MAX_QUOTED for f in fields)
        return start, list(fields), issue or ("ROW_TOO_LARGE" if large else None)

    def close() -> None:
        nonlocal was_quoted
        fields.append("".join(parts))
        parts.clear()
        was_quoted = False

    for m in token.finditer(text):
        if m.start() < at:
            continue
        mark, begin = m.group(), m.start()
        parts.append(text[at:begin])
        at = m.end()
        if quoted:
            if mark == '"':
                if text.startswith('"', at):
                    parts.append('"')
                    at += 1
                else:
                    quoted = False
            else:
                parts.append(mark)
                line += mark != delimiter
        elif mark == '"':
            if not was_quoted and not "".join(parts):
                quoted = was_quoted = True
            else:
                parts.append('"')
        elif mark == delimiter:
            close()
        else:
            blank = not fields and not was_quoted and not "".join(parts)
            close()
            if not blank:
                yield row()
            fields.clear()
            line += 1
            start = line
    parts.append(text[at:])
    if fields or was_quoted or "".join(parts):
        close()
        yield row("UNCLOSED_QUOTE" if quoted else None)


def read_feed_exact(spark: SparkSession, path: str, delimiter: str = ",", max_bytes: int = 256 << 20) -> DataFrame:
    """``(file, line, fields, issue)`` of every row after the header of each file, with the line it begins in.

    Files are read whole, each by one task, as quotes may span lines; a file beyond
    ``max_bytes`` is an error. A row of another width than the header's has the issue
    FIELD_COUNT_MISMATCH. ``read_feed`` splits large files instead, and knows no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = feed_rows(content.as_py().decode("utf-8-sig", "replace"), delimiter)
                header = next(rows, None)
                while header is not None and (part := list(itertools.islice(rows, 4096))):
                    issues = [i or (None if len(f) == len(header[1]) else "FIELD_COUNT_MISMATCH") for _, f, i in part]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([n for n, _, _ in part], pa.int64()), pa.array([f for _, f, _ in part], pa.list_(pa.string())), pa.array(issues, pa.string())], names=["file", "line", "fields", "issue"])

    files = spark.read.format("binaryFile").load(path)
    small = files.select("path", F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("feed too large: "), "path"))).alias("content"))
    return small.mapInArrow(run, "file string, line bigint, fields array<string>, issue string")


def read_synonyms(lines: DataFrame) -> DataFrame:
    """``(line, term, means, both_ways, error)`` of the text ``lines(line, text)`` of a synonym list.

    ``a, b`` and ``a = b`` hold both ways, ``a -> b`` and ``a => b`` one; ``#`` begins a comment;
    blank lines are left out. A line without two terms, or with the same twice, has an error.
    """
    text = F.btrim(F.regexp_replace("text", "#.*$", ""))
    parts = F.filter(F.transform(F.split(text, r"->|=>|=|,"), lambda x: F.lower(F.btrim(x))), lambda x: x != "")
    rows = lines.select("line", text.alias("text"), parts.alias("p")).filter("text <> ''")
    error = F.when(F.size("p") < 2, "two terms are needed").when(F.col("p")[0] == F.col("p")[1], "a term can't stand for itself")
    return rows.select("line", F.element_at("p", 1).alias("term"), F.try_element_at("p", F.lit(2)).alias("means"), ~F.col("text").rlike("->|=>"), error.alias("error")).toDF("line", "term", "means", "both_ways", "error")


def map_columns(raw: DataFrame) -> DataFrame:
    alias = {name: column for column, names in HEADERS.items() for name in names}
    chosen: dict[str, str] = {}
    for c in raw.columns:
        column = alias.get(c.strip("﻿ \t").lower())
        if column and column not in chosen:
            chosen[column] = c
    kept = [c for c in raw.columns if c not in chosen.values() and c.strip("﻿ \t").lower() not in HEADERS]
    return raw.select(*(F.col(f"`{chosen[c]}`").alias(c) if c in chosen else F.lit(None).cast("string").alias(c) for c in HEADERS), *(F.col(f"`{c}`") for c in kept))


def amount_minor(text: str | Column) -> Column:
    """An amount in minor units, null if it isn't one."""
    text = F.btrim(F.col(text) if isinstance(text, str) else text)
    plain = F.regexp_replace(text, r"[₹$€£,\s]", "")
    return F.when(text.rlike(AMOUNT), (plain.try_cast("decimal(18,2)") * 100).cast("bigint"))


def validate(rows: DataFrame) -> DataFrame:
    """``rows`` with the normal ``sku``, ``price_minor`` and ``issues``, all that is wrong with each row, in fixed order."""
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    sku = F.upper(F.btrim("sku"))
    whole = r"^[0-9][0-9,]*$"
    checks = [
        (blank("name"), "name_missing"),
        (blank("sku"), "sku_missing"),
        (~blank("sku") & ~sku.rlike("^[A-Z0-9_-]{3,64}$"), "sku_invalid"),
        (blank("price"), "price_missing"),
        (~blank("price") & amount_minor("price").isNull(), "price_invalid"),
        (~blank("sale_price") & amount_minor("sale_price").isNull(), "sale_price_invalid"),
        (amount_minor("sale_price") > amount_minor("price"), "sale_price_above_price"),
        (~blank("stock") & ~F.btrim("stock").rlike(whole), "stock_invalid"),
        (~blank("image_url") & ~F.btrim("image_url").rlike(r"^https?://[^\s/.]+\.[^\s]+$"), "image_url_invalid"),
        (~blank("email") & ~F.btrim("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email_invalid"),
    ]
    issues = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in checks)))
    return rows.withColumn("issues", issues).withColumn("price_minor", amount_minor("price")).withColumn("sku", F.nullif(sku, F.lit("")))


def mark_duplicates(rows: DataFrame, order: str) -> DataFrame:
    """``duplicate``: whether an earlier row, by the unique ``order``, has the same sku; rows without sku are none.

    The first row of each sku comes from an aggregate, so a sku repeated very often isn't one task's.
    """
    first = rows.filter("sku IS NOT NULL").groupBy("sku").agg(F.min(order).alias("_first"))
    return rows.join(first, "sku", "left").withColumn("duplicate", F.col("_first").isNotNull() & (F.col(order) > F.col("_first"))).drop("_first")
