"""Printed order codes ``MMDDYY-FF-T-N...-P[/R]``: the strict parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the printed form of a code.
CODE_PATTERN = r"^(\d{6})-([A-Z]{2})-([A-Z])-(\d+)-(\d+)(?:/(\d+))?$"
_TRIM = r"^\s+|\s+$"


def parse_code(code: Column, strip: bool = True) -> Column:
    """Strict parse of a code into a struct; null where the text is no code.

    ``strip`` removes outer ASCII white space first (two of the decoder back-ends do, one does not). The order number keeps
    its zeros; position and revision are BIGINT, null if they overflow; the revision is 0 when absent.
    """
    text = F.regexp_replace(code, _TRIM, "") if strip else code
    part = lambda i: F.regexp_extract(text, CODE_PATTERN, i)
    return F.when(
        text.rlike(CODE_PATTERN),
        F.struct(
            part(1).alias("date_code"),
            part(2).alias("facility"),
            part(3).alias("order_type"),
            part(4).alias("order_number"),
            part(5).try_cast("bigint").alias("position"),
            F.coalesce(F.nullif(part(6), F.lit("")), F.lit("0")).try_cast("bigint").alias("revision_count"),
        ),
    )
