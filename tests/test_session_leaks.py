"""Leaks over the rows of a session against a plain search."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushlake import CustomRule, SanitizeConfig
from hushlake.operators import session_leaks

RULE = CustomRule("told", r"(?<=<)[^<>]+(?=>)")
CONFIG = SanitizeConfig(mode="secrets_only", enable_categories=("CUSTOM",), custom_rules=(RULE,))


def check(spark, rows, config=CONFIG):
    df = spark.createDataFrame(rows, "s string, k int, text string, content string").repartition(3)
    return session_leaks.session_leak_check(df, ["s"], ["k"], config=config, with_fixed=True)


@given(st.text("ab", min_size=1, max_size=40), st.text("abcé", max_size=30), st.text("abcé", max_size=30))
@settings(max_examples=300, deadline=None)
def test_a_text_lists_the_gram_of_every_value_it_holds(value, before, after):
    seed = session_leaks.seed_of(value)
    _, letters, window = session_leaks.SIZES[seed["size"]]
    h = session_leaks.gram_hashes(before + value + after, letters)
    place = len(before) + seed["at"]
    assert place in session_leaks.least_of_windows(h, window) and h[place] == seed["gram"]


def test_equals_a_plain_search(spark):
    rng = random.Random(3)
    letters = "abcdé😀 "
    rows, masked = [], {}
    for k in range(300):
        s = rng.choice(["one", "two", None, ""]) if k % 3 else "one"
        value = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 30]))) if k % 5 else None
        prose = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        if rng.random() < 0.4 and masked.get(s):
            prose += rng.choice(sorted(masked[s])) + "x"
        if value:
            masked.setdefault(s, set()).add(value)
        rows.append((s, k, f"<{value}>" if value else "x", prose))
    rows += [rows[7], ("one", 1000, None, None), ("two", 1001, "", "")]
    want = {}
    for s, k, _, content in rows:
        n = sum(v in (content or "") for v in masked.get(s, ()))
        if n:
            want[s, k] = n
    got = check(spark, rows).collect()
    assert len(got) == len(want) > 100
    assert {(r.s, r.k): r.leaked_values for r in got} == want


def test_other_sessions_and_empty_tables(spark):
    rows = [("a", 1, "<hunter2hunter2hunter2>", "[X]"), ("b", 2, "none", "hunter2hunter2hunter2"), ("a", 5, "none", "so hunter2hunter2hunter2")]
    assert [(r.s, r.k, r.leaked_values) for r in check(spark, rows).collect()] == [("a", 5, 1)]
    assert check(spark, rows[1:2]).count() == 0
    assert check(spark, rows).limit(0).count() == 0
    df = spark.createDataFrame([], "s string, k int, text string, content string")
    assert session_leaks.session_leak_check(df, ["s"], ["k"], config=CONFIG, with_fixed=True).count() == 0


def test_one_session_holds_most_rows(spark):
    rows = spark.range(6000).select(
        F.lit("hot").alias("s"), F.col("id").cast("int").alias("k"),
        F.concat(F.lit("<value-of-"), F.md5(F.col("id").cast("string")), F.lit(">")).alias("text"),
        F.concat(F.lit("see value-of-"), F.md5(((F.col("id") * 7) % 6000).cast("string")), F.lit(" value-of-none")).alias("content"),
    )
    got = session_leaks.session_leak_check(rows, ["s"], ["k"], config=CONFIG, with_fixed=True)
    assert got.agg(F.count("*"), F.sum("leaked_values")).first()[:] == (6000, 6000)
