"""Sessions over micro-batches against the batch operator and a plain count."""

from pyspark.sql import functions as F

from hushlake import SanitizeConfig, sanitize_sessions
from hushlake.streaming.redaction import read_document_stream
from hushlake.streaming.sessions import sanitize_session_stream

CONFIG = SanitizeConfig(mode="pii", enable_categories=("EMAIL", "PASSWORD"), max_text_length=200)
SCHEMA = "s string, k int, text string, note string"


def run(spark, root, pieces, schema=SCHEMA):
    """Each piece is one run; the checkpoint carries the numbers over."""
    for piece in pieces:
        spark.createDataFrame(piece, schema).coalesce(2).write.mode("append").parquet(f"{root}/in")
        stream = read_document_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema)
        sanitize_session_stream(
            stream, f"{root}/out", f"{root}/mark", "text", ["s"], "k", ["note"], config=CONFIG
        ).awaitTermination()
    return spark.read.parquet(f"{root}/out")


def test_three_pieces_are_numbered_as_one_table(spark, tmp_path):
    rows = []
    for k in range(30):
        for s in ("one", None, ""):
            mails = " and ".join(f"u{(k * j) % 11}@x.example.com" for j in (3, 5, k % 3))
            rows.append((s, k, f'mail {mails}; password: "hunter{k % 4}secret"' if k % 7 else None, f"n{k}"))
    rows += [("one", 29, "x" * 300, "long"), ("one", 29, "", "empty"), rows[4], rows[4]]
    pieces = [[r for r in rows if r[1] // 10 == p] for p in range(3)]
    got = run(spark, tmp_path, pieces)
    batch = sanitize_sessions(spark.createDataFrame(rows, SCHEMA), "text", ["s"], "k", config=CONFIG)
    assert got.columns == ["s", "k", "note", "content", "detections", "detection_count", "error"]
    names = ["s", "k", "note", "content", "detections", "detection_count", "error"]
    key = lambda r: repr(r)
    assert sorted(map(key, got.select(names).collect())) == sorted(map(key, batch.select(names).collect()))


def test_late_rows_keep_known_numbers(spark, tmp_path):
    first = [("a", 5, "to p@x.example.com", ""), ("a", 4, "to q@x.example.com", "")]
    late = [("a", 1, "to r@x.example.com and p@x.example.com", ""), ("b", 1, "to p@x.example.com", "")]
    got = {(r.s, r.k): r.content for r in run(spark, tmp_path, [first, late]).collect()}
    assert got == {
        ("a", 4): "to [EMAIL_001]", ("a", 5): "to [EMAIL_002]",
        ("a", 1): "to [EMAIL_003] and [EMAIL_002]", ("b", 1): "to [EMAIL_001]",
    }


def test_state_holds_no_value(spark, tmp_path):
    run(spark, tmp_path, [[("a", 1, "to someone.unusual@x.example.com", "")]])
    held = b"".join(p.read_bytes() for p in (tmp_path / "mark").rglob("*") if p.is_file())
    assert held and b"someone.unusual" not in held
