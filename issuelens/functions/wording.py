"""Words of prose, as a text with a blank around each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_of(text: Column) -> Column:
    """Words, numbers, signs of the rupee, quotes and brackets in lower case, a blank around each."""
    parts = F.regexp_extract_all(F.lower(F.translate(text, "“”", '""')), F.lit(r'[a-z]+|\d[\d,]*(?:\.\d+)?%?|[₹`()"]'), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" "))
