"""CSV cells that spreadsheets will not run as formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_cell(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    text = F.coalesce(c.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.regexp_replace(guarded, '"', '""'), F.lit('"'))
    return F.when(guarded.rlike('[",\n\r]'), quoted).otherwise(guarded)


def csv_line(*columns: Column | str) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in columns])
