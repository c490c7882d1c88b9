"""JSON scanned in the JVM against Python's reader and printer."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from hushlake import sanitize_structured
from hushlake.functions import json_text
from hushlake.functions.pin import pin

GOOD = [
    "{}", "[]", " [ ] ", '""', "0", "-0", "true", " null\n", "[NaN, -Infinity, 1e5, -2.50E-3]", '{"a": {"b": [{}, [], [[]]]}, "c": "d"}',
    '{"a":1,"a":2}', '["\\u00e9\\n\\"\\\\", "\\\\\\"", "\\/", "\\ud83d\\ude00"]', '{"\\u0041\\t": "x"}', '[{"a":[1,{"b":null}]},"",[""]]',
    '["\u007f", "\u2028é日", "a\\u0000b\\u001f"]', "[" * 300 + "]" * 300, '["v", "s", ":", "{", "[1,2", "a,b"]',
    '["\ue000", "\\"\ue000\ue001"]', '{"v":"v"}', "123456789012345678901234567890", '["' + "\\n" * 30_000 + '"]',
]
BAD = [
    "", " ", "[1,]", "{1: 2}", '{"a" 1}', "[1 2]", "[", '{"a": 1', "01", "[1]]", "tru", '{"a": 1,}', "[}", '{"a":}', '{"a"}', "1,2", "[1],2",
    '"a" "b"', "v", "s", "[v]", '["a\nb"]', '["\\x"]', '["\\u12g4"]', '["\\ud800"]', '["\\udc00\\ud800"]', "\ufeff{}", "{]", "[{]}", "[:]", '["a":1]',
    "{,}", "[,]", "-", "1.", ".5", "+1", "1e", "'a'", '"a', "nulll", "-NaN", "[1-2]", "\u00a0[]", '{"a":"b":"c"}', '{"a","b"}', "]", "]["
]


def written(spark, texts):
    """As ``scanned``, the values found once for each text."""
    df = pin(spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("s", F.expr(json_text.scan("t"))), "s")
    df = pin(df.withColumn("v", F.expr(json_text.values("s"))), "v").withColumn("same", F.expr(json_text.render("s", "v")))
    return sorted(df.collect(), key=lambda r: r.id)


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = df.withColumn("s", F.expr(json_text.scan("t"))).withColumn("same", F.expr(json_text.render("s", json_text.values("s"))))
    return [r for r in sorted(out.collect(), key=lambda r: r.id)]


def as_python(text):
    """The text as Python prints it, but with numbers as written and repeated keys kept."""
    def pairs(items):
        return {f"{k}\0{n}": v for n, (k, v) in enumerate(items)}

    tree = json.loads(text, parse_float=lambda s: f"\0{s}", parse_int=lambda s: f"\0{s}", object_pairs_hook=pairs)
    lines = json.dumps(tree, indent=2, ensure_ascii=False)
    return re.sub(r'\\u0000\d+"(?=: )', '"', re.sub(r'"\\u0000([-+.0-9eE]+)"', r"\1", lines))


def test_well_formed_documents_are_printed(spark):
    for row, text in zip(scanned(spark, GOOD), GOOD, strict=True):
        assert row.s.ok, text
        if "\\u0000b" not in text:
            assert row.same == as_python(text), text
        assert json.loads(row.same, strict=False) == json.loads(text) or "NaN" in text


def test_others_are_not(spark):
    for text in BAD:
        with pytest.raises(ValueError):
            json.dumps(json.loads(text), ensure_ascii=False).encode()  # lone surrogates are read, and cannot be written
    assert [r.s.ok for r in scanned(spark, BAD)] == [False] * len(BAD)
    assert scanned(spark, [None, "1"])[0].s is None


def test_random_documents_and_damaged_ones(spark):
    rng = random.Random(6)

    def tree(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [tree(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {rng.choice(["k", "", 'q"', "\\", "é\n"]) + str(n): tree(depth - 1) for n in range(rng.randrange(4))}
        return rng.choice([None, True, 12, -7, "", 'a "b" \\ c', "{[,:]}", "tab\t\u0001", "日本"])

    texts = []
    for _ in range(150):
        text = json.dumps(tree(5), indent=rng.choice([None, 1, 4]), ensure_ascii=rng.random() < 0.5)
        texts.append(text)
        at = rng.randrange(len(text))
        texts.append(text[:at] + rng.choice(["", '"', ",", "]", "}", "{", "\\", ":", " ", "1", "v"]) + text[at + rng.randrange(2) :])
    for row, text in zip(scanned(spark, texts), texts, strict=True):
        try:
            tree = json.loads(text)
            json.dumps(tree, ensure_ascii=False).encode()
        except ValueError:
            assert not row.s.ok, text
        else:
            assert row.s.ok, text
            assert json.loads(row.same) == tree


def plain_test(text):
    """Whether a text of brackets, strings without escapes and whole numbers is JSON; by a stack, as Python's reader has none."""
    tokens = re.findall(r'"[^"]*"|\d+|.', text)
    after, stack = "value", []
    for t in tokens:
        if t in "{[" and after in ("value", "first"):
            stack.append(t)
            after = "first" if t == "[" else "first key"
            continue
        if t == "," and after == "end" and stack:
            after = "value" if stack[-1] == "[" else "key"
        elif t == ":" and after == "colon":
            after = "value"
        elif t[0] == '"' and after in ("key", "first key"):
            after = "colon"
        elif t in "}]" and after in ("end", "first" if t == "]" else "first key") and stack and stack[-1] + t in ("{}", "[]"):
            stack.pop()
            after = "end"
        elif t not in "{}[],:" and after in ("value", "first"):
            after = "end"
        else:
            return False
    return after == "end" and not stack


def deep_text(rng, levels, branches):
    """Containers in containers with other members before and after, and chains beside chains."""
    before, after = [], []
    for _ in range(levels):
        side = lambda key: [f'{key}{rng.choice(["1", "[]", "{}", chr(34) + "s" + chr(34)])}' for _ in range(rng.choice([0, 0, 0, 1, 2]))]
        key = rng.choice(["", '"k":'])
        left, right = side(key), side(key)
        if branches and rng.random() < 3 / levels:
            (left if rng.random() < 0.5 else right).append(key + deep_text(rng, levels, branches - 1))
        before.append("[{"[bool(key)] + "".join(f"{x}," for x in left) + key)
        after.append("".join(f",{x}" for x in right) + "]}"[bool(key)])
    return "".join(before) + rng.choice(["1", "[]", '{"k":[2]}']) + "".join(reversed(after))


def test_deep_documents_and_damaged_ones(spark):
    rng = random.Random(41)
    texts = [deep_text(rng, rng.choice([3, 40, 899, 900, 901, 902, 3000]), rng.randrange(3)) for _ in range(60)]
    texts += ["[" * n + "]" * n for n in (899, 900, 901, 902)] + ["[" * 30_000 + x + "]" * 30_000 for x in ("1", "1,2", "{1}", "}", '"k":1', "[],")]
    for text in texts[:60]:
        at = rng.randrange(len(text))
        texts.append(text[:at] + rng.choice(["", '"', ",", "]", "}", "{", "[", ":", "1", "[]", '"k":']) + text[at + rng.randrange(2) :])
    wrong = 0
    for row, text in zip(written(spark, texts), texts, strict=True):
        assert row.s.ok == plain_test(text), text[:300]
        wrong += not row.s.ok
        if row.s.ok:
            depth = most = 0
            for c in text:
                depth += (c in "[{") - (c in "]}")
                most = max(most, depth)
            assert re.sub(r"\s", "", row.same) == text and ("\n" in row.same) == (0 < most <= json_text.DEEP and text != "[]")
    assert 30 < wrong < 70


def test_tokens_are_no_array_elements(spark):
    """A document of 1,200,000 tokens is held as a string; what is one array element each is only its strings."""
    text = '["a",' + "[" * 600_000 + "]" * 600_000 + "]"
    (row,) = written(spark, [text])
    assert row.s.ok and row.same == text.replace(",", ", ")
    assert max(len(v) for v in row.s if isinstance(v, list)) == 1


def test_values_are_redacted_and_keys_kept(spark):
    text = '{"a@b.com": "c@d.com", "n": 4111111111111111, "f": 1.50, "l": ["x\\ny@z.org", "c@d.com", {"e": "é \\"q@r.com\\""}]}'
    df = spark.createDataFrame([(1, text), (2, '{"bad": "a@b.com"'), (3, None), (4, "[]")], "path int, t string")
    out = sanitize_structured(df, "t", "json", mode="pii")
    rows = {r.path: r for r in out.collect()}
    assert rows[1].content == json.dumps(json.loads(text), indent=2, ensure_ascii=False).replace("1.5", "1.50").replace(
        '"c@d.com"', '"[EMAIL_001]"'
    ).replace("y@z.org", "[EMAIL_002]").replace("q@r.com", "[EMAIL_003]")
    assert rows[1].detection_count == 4 and [d.leaf_ord for d in rows[1].detections] == [0, 1, 2, 3]
    assert rows[2].content == '{"bad": "[EMAIL_001]"' and rows[2].warnings == ["Malformed JSON; sanitized as plain text"]
    assert rows[4].content == "[]" and rows[4].warnings == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
