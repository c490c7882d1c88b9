"""Nulls, long and repeated rows, clashing columns and empty tables, with the values that the docstrings state."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.llm import html_text, licenses, packing, quality, secrets, toxicity, url_filter

WORDS = [f"{a}{b}{c}" for a in ("lo", "mi", "ta", "re") for b in ("na", "ku", "si", "vo") for c in ("", "t", "ra", "ne")]
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(31)
    base = prose(rng, 80)
    long = prose(rng, 40_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, base), (7, base), (7, base),
        (9, f"{long} token = 'a1B2c3D4e5F6g7H8' cc by {long}"), (10, "é" * 50), (None, None), (11, " x y"),
    ]


@pytest.fixture(scope="module")
def odd_docs(spark, odd_rows):
    """The odd rows beside columns whose names operators use themselves."""
    rows = [(i, t, f"s{k % 2}" if k % 3 else None, len(t or ""), k, "x") for k, (i, t) in enumerate(odd_rows)]
    names = "doc_id long, text string, source string, n_chars long, text_key long, votes string"
    docs = spark.createDataFrame(rows, names)
    for name in ("id", "row", "hits", "spans", "labels", "live_values", "new_text", "fold", "node", "owner"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_secrets_of_odd_rows(odd_docs, odd_rows):
    got = secrets.scan_secrets(odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    for r in got:
        if r.doc_id == 9:
            start = odd_rows[8][1].index("token")
            end = odd_rows[8][1].index("H8'") + 2
            assert r.base_sha256 == hashlib.sha256(f"assign:{start}:{end}".encode()).hexdigest() and r.n_assign == 1
        else:
            assert (r.n_assign, r.n_access, r.n_hex, r.spans, r.base_sha256) == (0, 0, 0, "", EMPTY_HASH)
    masked = secrets.redact_secrets(odd_docs)
    assert masked.columns == odd_docs.columns
    expected = [(i, t.replace("a1B2c3D4e5F6g7H8", secrets.MASK) if t else t) for i, t in odd_rows]
    rows = masked.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(expected)
    assert all(r.n_chars == len(r.text or "") and r.owner == "clash" for r in rows)
    assert secrets.redact_secrets(odd_docs.limit(0)).count() == 0


def test_quality_of_odd_rows(odd_docs, odd_rows):
    got = quality.quality(odd_docs).collect()
    texts = Counter((i, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t in odd_rows)
    assert Counter((r.doc_id, r.n_words) for r in got) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        if not r.n_words:
            assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) == (0, 0, 0, 0, False)
    by = {r.doc_id: r for r in got}
    assert by[10].word_chars == 50 and by[11].n_words == 1 and by[11].word_chars == 4


def test_quality_verdicts_follow_plain_expectation_maximisation(spark):
    """``kept`` against the textbook algorithm over documents, a vote at a time."""
    rng = random.Random(32)
    rows = []
    for k in range(160):
        words = prose(rng, rng.randrange(15, 90)).split()
        if k % 3 == 0:
            words = [w.upper() + rng.choice(["#", "|", "12345"]) for w in words]
        if k % 4 == 0:
            words = [w + "." if j % 9 == 8 else w for j, w in enumerate(words)]
        rows.append((k, " ".join(words)))
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(quality.RULES)
    cast = [[r.votes // 3 ** (n - 1 - j) % 3 for j in range(n)] for r in got]
    share_good = [(sum(v == quality.GOOD for v in c) + 1) / (sum(v == quality.GOOD for v in c) + 2 * sum(v == quality.BAD for v in c) + 2) for c in cast]
    favoured = {1: {quality.GOOD: 4.0}, 0: {quality.BAD: 4.0}}
    for _ in range(200):
        odds = []
        total = {1: sum(share_good), 0: len(cast) - sum(share_good)}
        seen = {(c, j, v): favoured[c].get(v, 1.0) for c in (0, 1) for j in range(n) for v in range(3)}
        for votes, p in zip(cast, share_good, strict=True):
            for j, v in enumerate(votes):
                seen[1, j, v] += p
                seen[0, j, v] += 1 - p
        size = {(c, j): sum(seen[c, j, v] for v in range(3)) for c in (0, 1) for j in range(n)}
        prior = (total[1] + 1) / (len(cast) + 2)
        for votes in cast:
            log = math.log(prior / (1 - prior))
            log += sum(math.log(seen[1, j, v] / size[1, j] / (seen[0, j, v] / size[0, j])) for j, v in enumerate(votes))
            odds.append(1 / (1 + math.exp(-log)))
        if max(abs(a - b) for a, b in zip(odds, share_good, strict=True)) < 1e-9:
            break
        share_good = odds
    for r, p in zip(got, odds, strict=True):
        assert abs(r.quality - p) < 1e-6
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_licenses_of_odd_rows(odd_docs, odd_rows):
    got = licenses.scan_licenses(odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    for r in got:
        if r.doc_id == 9:
            words = re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", odd_rows[8][1].lower())
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), 1, words.index("cc"), words.index("cc"))
            assert (r.base_labels, r.labels, r.score) == ("cc-by", "cc-by", 1.0)
        else:
            assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (0, None, None, "", "", 0.0)


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows):
    rng = random.Random(33)
    train = [(1000 + k, prose(rng, 40) + (" vilezq" if k % 2 else ""), "s", 0, 0, "x") for k in range(200)]
    labels = spark.createDataFrame([(i, int("vilezq" in t)) for i, t, *_ in train] + [(1, 1), (7, 0), (None, 1)], "doc_id long, toxic int")
    docs = odd_docs.unionByName(spark.createDataFrame(train, "doc_id long, text string, source string, n_chars long, text_key long, votes string"), True)
    got = toxicity.toxicity_scores(docs, labels).filter("doc_id is null or doc_id < 1000").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    blank = {round(r.score, 12) for r in got if r.doc_id in (1, 2)}
    assert len(blank) == 1 and len({round(r.score, 12) for r in got if r.doc_id == 7}) == 1
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_packing_of_rows_without_id(odd_docs, odd_rows):
    pieces = packing.pack_documents(odd_docs, with_ids=True).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in odd_rows if i is None)
    assert Counter(bytes(p.ids) for p in pieces if p.doc_id is None) == want


def test_pages_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [
        (1, "http://a.org/1", None), (2, None, ""), (3, "", f"<p>{long}</p>"), (4, "http://a.org/4", "<p>x</p>"),
        (4, "http://a.org/4", "<p>x</p>"), (None, "nohost", "<article>a <b>b</b> &amp; c</article>"),
        (5, "http://a.org/5", "<div>" * 5_000 + "deep"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "row", "blocks", "nodes", "page", "cut", "node"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = html_text.extract_text(pages).collect()
    want = [(1, ""), (2, ""), (3, long), (4, "x"), (4, "x"), (None, "a b & c"), (5, "deep")]
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter((i, t, len(t)) for i, t in want)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_urls_of_odd_rows(spark):
    rows = [(k, f"http://{('a.example.net', 'x.example.com')[k % 2]}/{('en', 'de')[k % 2]}/{k}") for k in range(80)]
    rows += [(100, "http://h.org/" + "a/" * 50_000), (101, None), (101, None), (None, "http://b.org/fr/x"), (102, "http://other.test")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("fold", "label", "suffix", "features", "rule", "verdict", "host", "path", "suffix_rate"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = url_filter.judge_urls(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, _ in rows)
    by = {r.page_id: r for r in got}
    assert by[100].host == "h.org" and len(by[100].path) == 100_001 and by[100].rule is None
    assert (by[101].host, by[101].path, by[101].rule) == ("", "", None) and by[None].rule == "org/fr/"
    assert all(r.verdict in ("allow", "block") for r in got)
