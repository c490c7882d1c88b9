"""Stable placeholder numbers.

Within one session the same (category, value) always gets the same number, and
numbers of a category follow first appearance. ``number_in_row`` serves sessions
that lie in one row (a document and its leaves) without a shuffle;
``number_sessions`` serves sessions that span rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions.arrays import empty_array, fold_emit, let, struct
from hushlake.sources.scratch import written

NUMBER = "struct<leaf:int,start:int,end:int,number:int>"
_FIRST = "struct<category:string,first_leaf:int,first_start:int,leaf:int,start:int,end:int>"


def number_in_row(items: str) -> str:
    """Numbers for ``array<struct<leaf,start,end,category,value>>``, in order of
    ``(leaf, start, end)``.

    Where no category occurs twice, every number is 1. Otherwise sorting replaces
    lookups, so the cost is n log n: equal values become
    neighbours and learn where their value first appears; sorting by that place
    turns numbering into counting.
    """
    by_value = struct(
        category="nh.category", value="nh.value", leaf="nh.leaf", start="nh.start", end="nh.end"
    )

    def same_value(st: str, h: str) -> str:
        return f"({st}.category = {h}.category AND {st}.value = {h}.value)"

    def first(st: str, h: str, field: str) -> str:
        return f"CASE WHEN {same_value(st, h)} THEN {st}.{field} ELSE {h}.{field} END"

    firsts = fold_emit(
        f"sort_array(transform(nitems, nh -> {by_value}))",
        struct(category="''", value="''", leaf="-1", start="-1"),
        lambda st, h: struct(
            category=f"{h}.category",
            value=f"{h}.value",
            leaf=first(st, h, "leaf"),
            start=first(st, h, "start"),
        ),
        lambda st, h: "array("
        + struct(
            category=f"{h}.category",
            first_leaf=first(st, h, "leaf"),
            first_start=first(st, h, "start"),
            leaf=f"{h}.leaf",
            start=f"{h}.start",
            end=f"{h}.end",
        )
        + ")",
        _FIRST,
    )

    def next_number(st: str, h: str) -> str:
        return f"""CASE WHEN {st}.category <> {h}.category THEN 1
            WHEN {st}.leaf = {h}.first_leaf AND {st}.start = {h}.first_start THEN {st}.number
            ELSE {st}.number + 1 END"""

    numbers = fold_emit(
        f"sort_array({firsts}.out)",
        struct(category="''", leaf="-1", start="-1", number="0"),
        lambda st, h: struct(
            category=f"{h}.category",
            leaf=f"{h}.first_leaf",
            start=f"{h}.first_start",
            number=next_number(st, h),
        ),
        lambda st, h: "array("
        + struct(
            leaf=f"{h}.leaf", start=f"{h}.start", end=f"{h}.end", number=next_number(st, h)
        )
        + ")",
        NUMBER,
    )
    single = struct(leaf="nh.leaf", start="nh.start", end="nh.end", number="1")
    numbered = f"""CASE WHEN size(nitems) < 1 THEN {empty_array(NUMBER)}
        WHEN size(array_distinct(transform(nitems, nh -> nh.category))) = size(nitems)
            THEN transform(nitems, nh -> {single})
        ELSE sort_array({numbers}.out) END"""
    return let("nitems", items, numbered)


def number_sessions(
    hits: DataFrame,
    session: list[str],
    order: str,
    start: str = "start",
    category: str = "category",
    value: str = "value",
) -> DataFrame:
    """One row ``(session, category, value, number)`` per distinct value.

    ``order`` is a whole-number column that places rows within their session; its
    values may be sparse or shared. Distinct values are found first (a partial
    aggregate, spread by value) and sorted by range over sessions, categories and
    first places, so a session of any size lies in as many parts as it needs. Numbers
    count within a part, from the counts of the parts before. Null keys are keys.
    """
    keys = [*session, category]
    firsts = hits.groupBy(*keys, value).agg(
        F.min(F.struct(F.col(order).alias("row"), F.col(start).alias("at"))).alias("first")
    )
    # written: the bounds of a range are sampled, and must be the same for both uses
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(
        firsts.repartitionByRange(parts, *keys, "first", value).withColumn("part", F.spark_partition_id()),
        "session-values",
    )
    # the value breaks ties, so that a recomputed task gives the same numbers
    in_part = Window.partitionBy(*keys, "part").orderBy("first", value)
    ranked = ranged.withColumn("in_part", F.row_number().over(in_part))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy(*keys, "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    return null_safe_join(ranked, bases, [*keys, "part"]).select(
        *keys, value, (F.col("base") + F.col("in_part")).cast("int").alias("number")
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where nulls are equal too; the keys come from the left."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"__right_{n}") for n, k in enumerate(keys)],
        *[f"`{c}`" for c in right.columns if c not in keys],
    )
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__right_{n}")) for n, k in enumerate(keys)]
    return left.join(renamed, reduce(and_, same), how).drop(*[f"__right_{n}" for n in range(len(keys))])
