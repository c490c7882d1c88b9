"""Check that a run left its source files alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the warning text.
CHANGED_WARNING = "Original file metadata changed unexpectedly during sanitization"


def source_integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join of two listings ``(path, modificationTime, length)``.

    One row per path with ``changed`` and the warning, if any. A file that only
    one listing holds counts as changed.
    """
    b = before.select("path", F.struct("modificationTime", "length").alias("b"))
    a = after.select("path", F.struct("modificationTime", "length").alias("a"))
    changed = ~F.col("b").eqNullSafe(F.col("a"))
    return b.join(a, "path", "full_outer").select(
        "path", changed.alias("changed"), F.when(changed, F.lit(CHANGED_WARNING)).alias("warning")
    )
