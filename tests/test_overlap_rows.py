"""Overlaps of hits as rows against a plain greedy choice."""

import random

from pyspark.sql import functions as F

from hushlake.operators.overlap_rows import greedy, resolve_overlap_rows

SCHEMA = "doc string, start int, end int, rank int, name string"


def plain(rows):
    kept = []
    for r in sorted(set(rows), key=lambda r: (r[1] - r[2], r[1], r[3], r[4])):
        if not any(k[0] == r[0] and k[1] < r[2] and k[2] > r[1] for k in kept):
            kept.append(r)
    return sorted(kept, key=repr)


def test_greedy_equals_plain():
    rng = random.Random(1)
    for _ in range(500):
        spans = []
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(20)
            spans.append((at, at + rng.randrange(0, 8)))
        spans.sort()
        want = plain([("", s, e, i, "") for i, (s, e) in enumerate(spans)])
        got = [("", *spans[i], i, "") for i in greedy(spans)]
        assert sorted(got, key=repr) == want


def test_one_document_in_several_tasks(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(2500):
        doc = rng.choice(["long"] * 8 + [None, ""])
        at = rng.randrange(9000)
        rows.append((doc, at, at + rng.choice([0, 1, 2, 5, 5, 9, 30]), rng.randrange(3), rng.choice("ab")))
    rows += [("long", 3000, 3800, 1, "a"), rows[0], ("chain", 0, 4, 1, "a")]
    rows += [("chain", k, k + 4, k % 3, "a") for k in range(1, 2000)]  # one component, over all parts
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    ranged = df.repartitionByRange(8, "doc", "start", "end", "rank")
    assert ranged.where("doc = 'long'").select(F.spark_partition_id()).distinct().count() > 2
    got = sorted((tuple(r) for r in resolve_overlap_rows(df, ["doc"]).collect()), key=repr)
    assert got == plain(rows)


def test_defined_cases(spark):
    rows = [("a", None, 3, 1, "x"), ("a", 1, None, 1, "x"), ("a", 0, 3, None, "x"), ("a", 0, 3, None, "x"), ("a", 3, 5, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in resolve_overlap_rows(df, ["doc"]).select("start", "end").collect())
    assert got == [(0, 3), (3, 5)]
    assert resolve_overlap_rows(df.limit(0), ["doc"]).count() == 0
