"""Rounding of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(c: Column, digits: int) -> Column:
    """Round the binary value itself, ties to even. ``round`` works on the
    shortest decimal form, so 0.04835 (a little less in binary) would go up."""
    exact = F.call_function("format_number", c, F.lit("0." + "0" * digits)).cast("double")
    # Java takes the one value that is just a 5 after the last digit for a tie.
    lone_five = float(f"5e-{digits + 1}")
    return F.when(c == lone_five, F.lit(round(lone_five, digits))).otherwise(exact)
