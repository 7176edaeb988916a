"""The scalar operators as SQL functions, so that ``spark.sql`` can use them natively."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "deid_normalize_ws(t STRING) RETURNS STRING": r"regexp_replace(regexp_replace(t, '(?U)\\s+', ' '), '^ | $', '')",
    "deid_replace(entity_type STRING) RETURNS STRING": "CASE WHEN entity_type = 'USER_ADDED' THEN '[REDACTED]' ELSE concat('<', entity_type, '>') END",
    "deid_mask(v STRING, masking_char STRING, n INT, from_end BOOLEAN) RETURNS STRING": (
        "CASE WHEN from_end THEN concat(substring(v, 1, length(v) - least(n, length(v))), repeat(masking_char, least(n, length(v)))) "
        "ELSE concat(repeat(masking_char, least(n, length(v))), substring(v, least(n, length(v)) + 1)) END"
    ),
    "deid_hash(v STRING, salt STRING) RETURNS STRING": "sha2(concat(salt, v), 256)",
    "deid_id(entity_type STRING, original STRING, place STRING) RETURNS STRING": "substr(sha1(concat(entity_type, char(0), original, char(0), place)), 1, 12)",
    "deid_luhn(v STRING) RETURNS BOOLEAN": "length(regexp_replace(v, '[^0-9]', '')) BETWEEN 12 AND 19 AND luhn_check(regexp_replace(v, '[^0-9]', ''))",
}


def register(spark: SparkSession) -> None:
    """Make deid_* functions known to the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
