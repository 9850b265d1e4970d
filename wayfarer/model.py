"""Column sets of the engine's tables, and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACK = ["observation", "track"]
STEP = [*TRACK, "offset_m"]


def step_key(rows: DataFrame) -> list[str]:
    """The columns that tell walks apart: STEP, and step_length where a table holds walks of several lengths."""
    return [*TRACK, "step_length", "offset_m"] if "step_length" in rows.columns else STEP


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if lacking := [n for n in names if n not in df.columns]:
        raise MissingColumns(f"missing {lacking}; there are {df.columns}")
    return df


def finite(name: str) -> Column:
    """The value, null where it is NaN or infinite."""
    c = F.col(name).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for results; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
