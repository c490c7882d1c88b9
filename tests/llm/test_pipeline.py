"""The five stages on a small corpus of planted cases."""

import random
from collections import defaultdict

import corpus_pipeline

WORDS = [f"{a}{b}{c}" for a in ("lo", "mi", "ta", "re") for b in ("na", "ku", "si", "vo") for c in ("", "t", "ra", "ne")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def test_planted_cases_meet_their_stage(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, prose(rng, 80), f"s{k % 4}") for k in range(60)]
    rows += [(100 + k, rows[k][1], "copy") for k in range(5)]
    rows += [(110 + k, rows[k][1].replace(rows[k][1].split()[40], "changed", 1), "near") for k in range(10, 14)]
    item = prose(rng, 30)
    rows += [(200 + k, f"{prose(rng, 20)} {item} {prose(rng, 20)}", "leak") for k in range(3)]
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows += [(300, f'{prose(rng, 30)} token = "{secret}" {prose(rng, 30)}', "one"), (301, prose(rng, 4000), "long")]
    # one id with two texts, a row that stands twice, and rows without text or id
    rows += [(400, prose(rng, 50), "a"), (400, prose(rng, 50), "a"), (401, None, "a"), (402, "", "a"), (None, prose(rng, 50), "a"), rows[7]]
    docs = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(k, 1, 0) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    gone = {100 + k for k in range(5)} | {110 + k for k in range(10, 14)} | {200, 201, 202}
    assert {r.doc_id for r in pieces} == {i for i, _, _ in rows} - gone
    lengths = defaultdict(list)
    for r in pieces:
        lengths[r.doc_id].append((r.piece, r.start, r.length))
    assert len(lengths[400]) == 2 and len(lengths[7]) == 1 and len(lengths[301]) > 3
    long = sorted(lengths[301])
    assert [s for _, s, _ in long] == [sum(n for _, _, n in long[:k]) for k in range(len(long))]
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024
    masked = corpus_pipeline.secret_scan(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    assert len(masked) == len(rows) and not any(secret in (r.text or "") for r in masked)
    assert corpus_pipeline.STAGES[0][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
