"""SimHash fingerprints and their links against plain versions, and the defined cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from hushlake.llm import simhash

CLASH = "fp long, key string, cut long, least string, component string, fingerprint string"


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    """Smallest id reachable, of ``{id: fingerprint}``."""
    ids = sorted(prints)
    least = {i: i for i in ids}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "l", "c", "f") for r in rows], "doc_id long, text string, " + CLASH).repartition(4)


def test_xxh64_of_spans():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    start = np.array([rng.randrange(2900) for _ in range(400)] + [0, 0, 3000])
    end = np.array([s + rng.randrange(100) for s in start[:400].tolist()] + [3000, 0, 3000])
    got = simhash.xxh64_spans(np.frombuffer(raw, np.uint8), start, end).tolist()
    assert got == [xxhash.xxh64_intdigest(raw[a:b], seed=42) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


@pytest.mark.parametrize("size", [1 << 16, 7])
def test_fingerprints_match_plain_version(monkeypatch, size):
    monkeypatch.setattr(simhash, "SLICE", size)
    rng = random.Random(2)
    words = ["the", "Blue", "grün", "x" * 40, "日本", " ", "a,b"]
    texts = [None, "", " \n", "One", "one  TWO\tthree", "a b c d", "a b c d e"]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints(pa.array([], pa.string())).tolist() == []


def test_a_segment_differs_in_one_bit_at_most():
    """Any four bits, at every cut: some variant of both fingerprints is equal."""
    rng = random.Random(3)
    for cut in [(), (0,), (2,), (1, 2), (2, 0)]:
        bits = simhash.bits_left(cut)
        variants = simhash.deletion_variants(bits)
        assert sorted(b for _, b, _ in variants) == bits
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(bits, 4))
            assert any(not flips & mask & (1 << 64) - 1 for _, _, mask in variants)


@pytest.mark.parametrize(("bucket", "tile"), [(128, 1024), (3, 8)])
def test_links_match_brute_force(spark, monkeypatch, bucket, tile):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(4)
    prints = set()
    for _ in range(20):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 7])):
            prints.add(at)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                at ^= 1 << b
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(16)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)).collect()
    for r in links:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert a != b
    expected = components_of({p: p % (1 << 64) for p in signed})
    up = {p: p for p in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        up[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    assert {p: root(p) for p in signed} == expected


def test_simhash_of_documents(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "long " * 40_000)]
    for k in range(30):
        text = [rng.choice(words) for _ in range(400)]
        for j in range(rng.choice([1, 4])):
            rows.append((100 - k * 4 - j if k < 10 else 1000 + 4 * k + j, " ".join(text)))
            text[rng.randrange(400)] = "changed"
    got = simhash.simhash_components(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    least = components_of(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {(i, f"{p:016x}", least[i]) for i, p in prints.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.simhash_components(documents(spark, rows).limit(0)).count() == 0
