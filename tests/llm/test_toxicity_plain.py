"""The toxicity scores against a plain Kneser-Ney model of tuples and dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from hushlake.llm import toxicity

WORDS = [f"{a}{b}{c}" for a in ("lo", "mi", "ta", "re") for b in ("na", "ku", "si", "vo") for c in ("", "t", "ra", "né")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def symbols(text):
    out = []
    for b in (text or "").encode():
        if b >= 0xC0:
            continue
        s = 27 + b % 5 if b >= 0x80 else ord(chr(b).lower()) - 96 if chr(b).isalpha() else 0
        out.append(s)
    return [s for k, s in enumerate(out) if s or k and out[k - 1]]


def grams(text):
    s = [0, 0, 0, *symbols(text)]
    return [tuple(s[k : k + 4]) for k in range(len(s) - 3)]


def interpolated(counts, lower):
    """P(last symbol | the rest) from ``counts`` of tuples, discounted, over ``lower``."""
    total, kinds = Counter(), Counter()
    for gram, n in counts.items():
        total[gram[:-1]] += n
        kinds[gram[:-1]] += 1

    def p(gram):
        n = total[gram[:-1]]
        if not n:
            return lower(gram[1:])
        return max(counts.get(gram, 0) - 0.75, 0) / n + 0.75 * kinds[gram[:-1]] / n * lower(gram[1:])

    return p


def plain_model(rows):
    counts = [Counter(), Counter()]
    for text, toxic in rows:
        counts[toxic].update(grams(text))
    if not counts[0] or not counts[1]:
        return lambda text: 0.0
    shared = lambda gram: 1 / 32
    for order in (1, 2, 3):
        befores = defaultdict(set)
        for gram in counts[0] | counts[1]:
            befores[gram[-order:]].add(gram[-order - 1])
        shared = interpolated({g: len(b) for g, b in befores.items()}, shared)
    ordinary, toxic = (interpolated(c, shared) for c in counts)

    def ratio(text):
        kinds = set(grams(text))
        return sum(math.log(toxic(g) / ordinary(g)) for g in kinds) / (len(kinds) + toxicity.LENGTH_PRIOR)

    return ratio


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def plain_scores(rows, labels):
    texts = dict(rows)
    known = [(i, texts[i], t) for i, t in labels.items() if fold(i) and i in texts]
    early = plain_model([(x, t) for i, x, t in known if fold(i) != 1])
    held = [(early(x), t) for i, x, t in known if fold(i) == 1]
    slope, intercept = toxicity.calibrate(np.array([r for r, _ in held]), np.array([t for _, t in held]))
    ratio = plain_model([(x, t) for _, x, t in known])
    return {i: 1 / (1 + math.exp(-(slope * ratio(x) + intercept))) for i, x in rows}


def corpus(seed):
    rng = random.Random(seed)
    rows, labels = [], {}
    for i in range(240):
        text = prose(rng, rng.randrange(20, 60)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(5):
                text[rng.randrange(len(text))] = rng.choice(["zqxwyrd", "Vlkgrym!", "wpjfoul"])
        rows.append((i, " ".join(text)))
        if i % 7:
            labels[i] = int(bad)
    return rows + [(900, None), (901, ""), (902, "123 456"), (903, "Жзи ёü")], labels


def test_scores_equal_a_plain_model(spark):
    rows, labels = corpus(41)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    want = plain_scores(rows, labels)
    assert len(got) == len(rows)
    assert max(abs(r.score - want[r.doc_id]) for r in got) < 1e-4
    caught = [r.predicted for r in got if r.held_out and r.doc_id < 240 and r.doc_id % 4 == 0]
    assert sum(caught) / len(caught) > 0.9


def test_pipeline_stage_drops_what_the_plain_model_rejects(spark, tmp_path):
    rows, labels = corpus(42)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    want = plain_scores(rows, labels)
    sure = {i for i, p in want.items() if abs(p - 0.5) > 1e-3}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} & sure == {i for i, p in want.items() if p < 0.5} & sure
