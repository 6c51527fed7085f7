"""Finding, masking and hashing sensitive values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import fixed_values as fv

_NAMES = "|".join(fv.SENSITIVE_NAMES)


def sensitive_words(text: Column) -> Column:
    """Distinct sensitive column names standing as whole words in ``text``, sorted.

    An underscore is part of a word, so ``customer_pan`` does not count as ``pan``.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\b(?:{_NAMES})\b"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def classify_columns(catalog: DataFrame, column: str = "column_name", guidance: bool = True) -> DataFrame:
    """Flag catalog rows whose column name is sensitive; ``guidance`` adds the written-only names."""
    names = fv.SENSITIVE_NAMES + (fv.GUIDANCE_NAMES if guidance else ())
    return catalog.withColumn("sensitive", F.lower(column).rlike(rf"\b(?:{'|'.join(names)})\b"))


def value_counts(text: Column, bounded: bool = False) -> Column:
    """Occurrences of every value kind as ``array<struct<kind,hits>>``.

    Unbounded patterns also fire inside longer numbers (a card holds a phone number);
    ``bounded`` asks for word boundaries, so a number counts for its own kind only.
    """
    kinds = []
    for kind, pattern in fv.VALUE_PATTERNS.items():
        wanted = rf"\b{pattern}\b" if bounded else pattern
        kinds.append(F.struct(F.lit(kind).alias("kind"), F.regexp_count(text, F.lit(wanted)).alias("hits")))
    return F.array(*kinds)


def mask_pan(value: Column) -> Column:
    return F.regexp_replace(value, fv.PAN_PREFIX, fv.PAN_MASK)


def mask_email(value: Column) -> Column:
    return F.regexp_replace(value, fv.EMAIL_LOCAL_PART, fv.TEXT_MASK)


def mask_phone(value: Column) -> Column:
    return F.concat(F.lit(fv.TEXT_MASK), F.substring(value, -4, 4))


def mask_card(value: Column) -> Column:
    return F.concat(F.lit(fv.CARD_MASK), F.substring(value, -4, 4))


def mask_text(text: Column) -> Column:
    """Masks for values inside running text, longest number kind first."""
    out = F.regexp_replace(text, r"[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", fv.TEXT_MASK + "@$1")
    out = F.regexp_replace(out, r"[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?([0-9]{4})", fv.CARD_MASK + "$1")
    out = F.regexp_replace(out, r"[2-9][0-9]{7}([0-9]{4})", "********$1")
    out = F.regexp_replace(out, r"[6-9][0-9]{5}([0-9]{4})", fv.TEXT_MASK + "$1")
    return mask_pan(out)


def hash_id(value: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def key_profile(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Row, null, distinct and orphan counts of a join key.

    Rows are first counted per key, so a key holding much of the table is one row by the
    time it meets the parents.
    """
    per_key = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parents.select(F.col(parent_key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    joined = per_key.join(known, "_k", "left")
    lost = F.col("_k").isNotNull() & F.col("_known").isNull()
    return joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0)).alias("null_rows"),
        F.count("_k").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(lost, F.col("_n"))), F.lit(0)).alias("orphan_rows"),
    )
