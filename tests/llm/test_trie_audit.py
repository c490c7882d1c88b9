"""The prefix trie and the filter audit against plain versions, and their defined cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hushlake.llm import filter_audit, prefix_trie

CLASH = "path string, sizes long, source string, node_key long, chunk long, depth string, ends string"


def conversations(spark, rows):
    rows = [(*r, "p", 1, "s", 2, 3, "d", "e") for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, " + CLASH).repartition(4)


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [said for *_, said in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = set()
    for node, convs in members.items():
        below = [p for p in members if p[: len(node)] == node]
        children = [p for p in below if len(p) == len(node) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if rebuilt[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


def trie_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 13)):
            text = rng.choice(["hello", "hello", "yes", "né", "", None, "long " * 20])
            rows.append((c, t if rng.random() < 0.95 else None, ("user", "assistant", None)[t % 3], text))
    # a family of long copies, and a path that ends at the root
    for c in (200, 205, 210, 215, 221):
        rows += [(c, t, "user", f"turn {t}") for t in range(30)]
    rows += [(301, 0, "user", "gone with its head")]
    rows += [rows[0], (None, 1, "user", "no conversation"), (7, 2**40, "user", "late")]
    return rows


@pytest.mark.parametrize("records", [10_000, 7, 1])
def test_trie_matches_brute_force(spark, records):
    """However the sorted paths are cut into chunks, the nodes are the same."""
    rows = trie_rows(5, 60)
    expected, n_nodes = brute_trie(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = [tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == n_nodes
    assert set(got) == expected


def test_trie_of_one_hot_conversation(spark):
    """A path of most conversations lies in many chunks; its ids are hashed in order."""
    rows = [(c, t, "user", f"same {t}") for c in range(120) for t in range(10)] + [(5 * c, 99, "user", str(c % 3)) for c in range(12)]
    expected, _ = brute_trie(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected


def test_trie_of_nothing(spark):
    empty = conversations(spark, [(1, 1, "user", "x")]).limit(0)
    out = prefix_trie.prefix_trie(empty)
    assert out.count() == 0 and out.columns == list(prefix_trie.RESULT)
    alone = prefix_trie.prefix_trie(conversations(spark, [(4, None, None, None)])).collect()
    h = zlib.crc32(b"4") % 9
    assert len(alone) == (1 if h else 2)


def brute_audit(docs, labels):
    quality, toxic = defaultdict(bool), defaultdict(bool)
    for i, q, t in labels:
        quality[i] |= q == 1
        toxic[i] |= t == 1
    parts = defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        parts[lang or ""].append((fails, i is not None and quality[i], i is not None and toxic[i]))
    out = set()
    for part, held in parts.items():
        rows, shapley = [], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                failing = sum(r[0][f] for r in held)
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in held)
                shapley[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), unique,
                             sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out |= {(*r[:-1], shapley[r[-1]]) for r in rows}
    return out


def audit_documents(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs = [(1, None, "en"), (2, "", None), (3, "", "de"), (None, "", "en"), (None, "none", ""), (9, "$", "xx"), (9, "$", "xx"), (9, "other", "en")]
    for i in range(10, 150):
        text = " ".join(rng.choice(words[: rng.choice([30, 400])]) for _ in range(rng.choice([5, 99, 100, 140, 3000])))
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.3:
            text += rng.choice([" #", "$", " a|b", "é&"])
        docs.append((i, text, rng.choice(["en", "de", "fr"])))
        if rng.random() < 0.4:
            docs.append((rng.randrange(500), text, rng.choice(["en", "de"])))
    labels = [(rng.randrange(200), rng.randrange(2), rng.randrange(2)) for _ in range(150)] + [(None, 1, 1), (20, None, None)]
    return docs, labels


def test_audit_matches_brute_force(spark):
    docs, labels = audit_documents(3)
    frame = spark.createDataFrame([(*d, "m", 7, 1, 2) for d in docs], "doc_id long, text string, lang string, mask string, n long, good long, part int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(frame.repartition(5), marks).collect()
    assert len(got) == 600 * len({d[2] or "" for d in docs})
    assert {tuple(r) for r in got} == brute_audit(docs, labels)
    assert filter_audit.audit_filters(frame.limit(0), marks).count() == 0
    assert filter_audit.audit_filters(frame, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_gray_walk_states():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 50, (32, 3))
    states = filter_audit.survivors(cells)
    for active in range(32):
        assert (states[active] == cells[[m for m in range(32) if not m & active]].sum(axis=0)).all()
