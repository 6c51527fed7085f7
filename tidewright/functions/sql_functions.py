"""Masks and labels as SQL functions, for jobs written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewright.functions import fixed_values as fv

FUNCTIONS = {
    "mask_pan": f"regexp_replace(value, r'{fv.PAN_PREFIX}', '{fv.PAN_MASK}')",
    "mask_email": f"regexp_replace(value, r'{fv.EMAIL_LOCAL_PART}', '{fv.TEXT_MASK}')",
    "mask_phone": f"concat('{fv.TEXT_MASK}', substring(value, -4, 4))",
    "mask_card": f"concat('{fv.CARD_MASK}', substring(value, -4, 4))",
    "hash_id": "sha2(value, 256)",
    "flag_label": "CASE WHEN coalesce(value, '') = '' THEN 'UNKNOWN' ELSE upper(split_part(value, ' ', 1)) END",
}


def register(spark: SparkSession) -> None:
    """Create the functions for this session; the optimizer inlines them into the query."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS STRING RETURN {body}")
