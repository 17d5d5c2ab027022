"""Attribute-value rows into one wide, typed row per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwright.functions.keys import BLANKS, norm_key

#: Definitions become columns and options are broadcast, so both are bounded; more are an error, never a cut.
MAX_DEFINITIONS = 5000
MAX_OPTIONS = 200_000
TYPES = {"COLOR": "string", "ENUM": "string", "NUMBER": "decimal(38,10)", "BOOLEAN": "boolean", "TEXT": "string"}


def _loose(column: str):
    """Trimmed, lower case, runs of blanks, hyphens and underscores as one blank."""
    return F.regexp_replace(F.lower(F.btrim(F.col(column), F.lit(BLANKS))), r"[\s_-]+", " ")


def _bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    rows = df.limit(most + 1).count()
    if rows > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)


def resolved_values(rows: DataFrame, definitions: DataFrame, options: DataFrame) -> DataFrame:
    """``(entity_id, definition_id, raw, value)``, one per row that names an entity and a known definition.

    ``value`` is the text form of the readable value, null where the row can't be read. Rows
    without entity or definition, or naming an unknown definition, are left out.
    """
    kinds = definitions.select(norm_key("id").alias("definition_id"), F.upper(F.trim("value_type")).alias("value_type"), norm_key("unit").alias("unit")).filter("definition_id IS NOT NULL").groupBy("definition_id").agg(F.min("value_type").alias("value_type"), F.min("unit").alias("unit"))
    chosen = options.select(norm_key("id").alias("option_id"), norm_key("definition_id").alias("definition_id"), norm_key("slug").alias("slug"))
    by_id = chosen.filter("option_id IS NOT NULL AND slug IS NOT NULL").groupBy("option_id", "definition_id").agg(F.min("slug").alias("slug_by_id"))
    names = options.select(norm_key("definition_id").alias("definition_id"), norm_key("slug").alias("slug"), F.explode(F.array(_loose("slug"), _loose("label"))).alias("loose"))
    by_name = names.filter("slug IS NOT NULL AND loose <> ''").groupBy("definition_id", "loose").agg(F.min("slug").alias("slug_by_name"))
    base = rows.select(norm_key("variant_id").alias("entity_id"), norm_key("definition_id").alias("definition_id"), norm_key("option_id").alias("option_id"), F.col("value_text").alias("raw"))
    joined = (
        base.filter("entity_id IS NOT NULL AND definition_id IS NOT NULL")
        .withColumn("loose", _loose("raw"))
        .join(_bounded(kinds, MAX_DEFINITIONS, "definitions"), "definition_id")
        .join(_bounded(by_id, MAX_OPTIONS, "options"), ["option_id", "definition_id"], "left")
        .join(_bounded(by_name, 2 * MAX_OPTIONS, "option names"), ["definition_id", "loose"], "left")
    )
    text = F.lower(F.btrim("raw", F.lit(BLANKS)))
    bare = F.when(F.col("unit").isNotNull() & F.endswith(text, F.col("unit")), F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length("unit")))).otherwise(text)
    digits = F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare)
    whole = F.regexp_extract(digits, r"^0*([0-9]+)", 1)
    part = F.regexp_extract(digits, r"\.([0-9]*?)0*$", 1)
    number = F.when(digits.isNull(), F.lit(None)).when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    truth = F.when(text.isin("yes", "y", "true", "1"), "true").when(text.isin("no", "n", "false", "0"), "false")
    prose = F.nullif(F.regexp_replace(text, r"\s+", " "), F.lit(""))
    value = F.when(F.col("value_type").isin("COLOR", "ENUM"), F.coalesce("slug_by_id", "slug_by_name")).when(F.col("value_type") == "NUMBER", number).when(F.col("value_type") == "BOOLEAN", truth).when(F.col("value_type") == "TEXT", prose)
    return joined.select("entity_id", "definition_id", "raw", value.alias("value"))


def attribute_failures(rows: DataFrame, definitions: DataFrame, options: DataFrame) -> DataFrame:
    """``(variant_id, definition_id, raw, n, reason)``: every text that could not be read (``unreadable``), with
    the number of its rows, and those of rows that name a definition which isn't there (``unknown``)."""
    unread = resolved_values(rows, definitions, options).filter("value IS NULL").withColumn("reason", F.lit("unreadable"))
    known = definitions.select(norm_key("id").alias("definition_id")).filter("definition_id IS NOT NULL").distinct()
    named = rows.select(norm_key("variant_id").alias("entity_id"), norm_key("definition_id").alias("definition_id"), F.col("value_text").alias("raw")).filter("entity_id IS NOT NULL AND definition_id IS NOT NULL")
    lost = named.join(_bounded(known, MAX_DEFINITIONS, "definitions"), "definition_id", "left_anti").withColumn("reason", F.lit("unknown"))
    both = unread.select("entity_id", "definition_id", "raw", "reason").unionByName(lost)
    return both.groupBy(F.col("entity_id").alias("variant_id"), "definition_id", "raw", "reason").agg(F.count("*").alias("n"))


def wide_attributes(rows: DataFrame, definitions: DataFrame, options: DataFrame) -> DataFrame:
    """One row per entity: ``variant_id``, a typed column ``a_<code>`` per definition, ``cells``
    (definition id to the text of its value), ``conflicts`` (the definitions whose readable
    rows contradict each other) and ``failures`` (definition id to its unreadable rows and
    values that don't fit the column's type; ``attribute_failures`` lists their texts).

    The resolved pairs are first reduced to one row per entity and definition, before the
    shuffle too, so memory doesn't depend on how often an entity is repeated; then each
    entity's pairs become a key-value map, from which the known keys are projected. A cell
    is filled if its readable values agree. Repeated rows change nothing but the failure
    counts; an entity without readable value has a row of nulls; empty tables give no rows.
    """
    known = definitions.select(norm_key("id").alias("id"), F.lower(F.trim("code")).alias("code"), F.upper(F.trim("value_type")).alias("value_type")).filter("id IS NOT NULL").groupBy("id").agg(F.min("code").alias("code"), F.min("value_type").alias("value_type")).limit(MAX_DEFINITIONS + 1).collect()
    if len(known) > MAX_DEFINITIONS:
        raise ValueError(f"more than {MAX_DEFINITIONS} definitions")
    pairs = resolved_values(rows, definitions, options)
    cells = pairs.groupBy("entity_id", "definition_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value").isNull()).alias("unread"))
    entities = cells.groupBy("entity_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("low") == F.col("high"), F.struct("definition_id", F.col("low").alias("value"))))).alias("cells"),
        F.array_sort(F.collect_list(F.when(F.col("low") < F.col("high"), F.col("definition_id")))).alias("conflicts"),
        F.map_from_entries(F.collect_list(F.when(F.col("unread") > 0, F.struct("definition_id", "unread")))).alias("unread"),
    )
    columns, misfit, used = [], [], set()
    for d in sorted(known, key=lambda r: (r["code"] or "", r["id"])):
        text, kind = F.col("cells")[d["id"]], TYPES.get(d["value_type"], "string")
        name = f"a_{d['code'] or d['id']}"
        name = name if name not in used else f"{name}_{d['id']}"
        used.add(name)
        columns.append(text.try_cast(kind).alias(name))
        if kind != "string":
            misfit.append(F.when(text.isNotNull() & text.try_cast(kind).isNull(), F.struct(F.lit(d["id"]).alias("k"), F.lit(1).cast("bigint").alias("n"))))
    failures = F.col("unread")
    if misfit:
        failures = F.map_zip_with("unread", F.map_from_entries(F.filter(F.array(*misfit), lambda x: x.isNotNull())), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return entities.select(F.col("entity_id").alias("variant_id"), *columns, "cells", "conflicts", failures.alias("failures"))


def filled_cells(wide: DataFrame) -> DataFrame:
    """``(variant_id, definition_id, value)`` of the filled cells of a wide table."""
    return wide.select("variant_id", F.explode("cells").alias("definition_id", "value"))
