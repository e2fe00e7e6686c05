"""Rules as columns: reasons, first failures, envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; unknown (null) ones don't."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


def first_failing(rules: dict[str, Column]) -> Column:
    """The first rule that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, c in reversed(rules.items()):
        out = F.when(F.coalesce(c, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def outside(name: str, value: Column, low: Column, high: Column) -> dict[str, Column]:
    """The three reasons a measured value can give: missing, below and above its envelope."""
    return {f"{name}_missing": value.isNull(), f"{name}_low": value < low, f"{name}_high": value > high}
