"""Control over where and how widely Spark evaluates columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def other_columns(df: DataFrame, *without: str) -> list[str]:
    """Quoted names of all columns but some, safe for names with dots."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns if c not in without]


def pin(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with ``columns`` computed at this point of the plan.

    Catalyst pushes filters (also those it infers below an ``explode``) through
    projections, and merges projections that hold Python UDFs; both repeat the
    expressions behind ``columns``. A one-row ``inline`` is a plan node of its
    own, which neither crosses.
    """
    others = other_columns(df, *columns)
    return df.select(*others, F.inline(F.array(F.struct(*columns))))
