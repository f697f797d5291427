"""White space at the ends of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c\u00a0"


def strip(text: Column) -> Column:
    """Spaces, tabs, line ends and no-break spaces cut off at both ends."""
    return F.trim(text, F.lit(WHITE))
