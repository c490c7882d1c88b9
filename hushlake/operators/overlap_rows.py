"""Overlap resolution over hits as rows, for documents whose hits are more than a row should hold.

Sorted by range over documents and places, the hits of one document lie in as many parts as they
need. A running maximum of ends, from the parts before and then inside each part, shows where a
component of overlapping spans begins; a running count of beginnings numbers the components. The
greedy choice then runs inside each component: single hits stay as they are, the others are
gathered by component, so what a task holds is one chain of overlapping spans, not a document.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions.pin import other_columns
from hushlake.operators.numbering import null_safe_join
from hushlake.sources.scratch import written

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def greedy(spans: list[tuple[int, int]]) -> list[int]:
    """Places of the spans that stay: longer ones first, then earlier, then as they are given."""
    kept: list[tuple[int, int]] = []
    chosen = []
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0] - spans[i][1], spans[i][0], i)):
        start, end = spans[i]
        # kept spans are disjoint, so of those that begin before this one ends the last reaches furthest
        before = bisect_left(kept, (end,))
        if not before or kept[before - 1][1] <= start:
            insort(kept, spans[i])
            chosen.append(i)
    return sorted(chosen)


def _greedy(starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = zip(starts.to_pylist(), ends.to_pylist(), strict=True)
    return pa.array([greedy(list(zip(s, e, strict=True))) for s, e in rows], pa.list_(pa.int32()))


def resolve_overlap_rows(
    hits: DataFrame, keys: list[str], start: str = "start", end: str = "end", rank: str = "rank"
) -> DataFrame:
    """The rows of ``hits`` that stay, with all their columns; ``keys`` name a document.

    Longer spans go first, then earlier ones, then lower ``rank``, then the other columns in
    order; of rows that are equal in all one stays. Touching spans do not overlap. Null keys are a
    document like any other; rows without a start or an end are left out. The rows are written to
    the scratch folder, so they must not hold raw values. A gathered component is one chain of
    overlapping spans, whose members a task holds together.
    """
    names = [c for c in hits.columns if c not in (*keys, start, end, rank)]
    whole = hits.where(F.col(f"`{start}`").isNotNull() & F.col(f"`{end}`").isNotNull())
    tied = [start, end, rank, *names]
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written: the bounds of a range are sampled, and must be the same for every use
    ranged = written(
        whole.repartitionByRange(parts, *keys, start, end, rank).withColumn("__part", F.spark_partition_id()),
        "overlap-hits",
    )
    s, e = F.col(f"`{start}`"), F.col(f"`{end}`")
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    reaches = (
        ranged.groupBy(*keys, "__part").agg(F.max(e).alias("__max"))
        .withColumn("__reach", F.max("__max").over(earlier)).drop("__max")
    )
    in_part = Window.partitionBy(*keys, "__part").orderBy(*[f"`{c}`" for c in tied])
    before = in_part.rowsBetween(Window.unboundedPreceding, -1)
    # greatest passes over nulls: a document's first hit has nothing before it
    reach = F.greatest("__reach", F.max(e).over(before))
    headed = null_safe_join(ranged, reaches, [*keys, "__part"]).withColumn(
        "__head", F.coalesce((s >= reach).cast("long"), F.lit(1))
    ).withColumn("__in_part", F.sum("__head").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
    bases = (
        headed.groupBy(*keys, "__part").agg(F.max("__in_part").alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    )
    numbered = null_safe_join(headed, bases, [*keys, "__part"]).withColumn(
        "__component", F.col("__base") + F.col("__in_part")
    )
    gathered = numbered.groupBy(*keys, "__component").agg(
        F.sort_array(F.collect_list(F.struct(*[f"`{c}`" for c in tied]))).alias("__items")
    )
    chosen = F.arrow_udf(_greedy, "array<int>")(F.col(f"__items.`{start}`"), F.col(f"__items.`{end}`"))
    # components of one hit, which are most, do not go through Python
    single = gathered.where("size(__items) = 1").select(*keys, F.col("__items")[0].alias("__item"))
    several = gathered.where("size(__items) > 1").withColumn("__chosen", chosen)
    stay = several.select(*keys, F.explode(F.expr("transform(__chosen, i -> get(__items, i))")).alias("__item"))
    return single.unionByName(stay).select(*keys, "__item.*").select(*other_columns(hits))
