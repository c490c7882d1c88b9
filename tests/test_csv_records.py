"""Records of CSV files that lie in many byte ranges, against one reader of the whole text."""

import csv
import io
import random

import pytest

from hushlake import sanitize_structured
from hushlake.sources import csv_records


def plain_end(line, inside):
    """The state after a line, read character by character."""
    state = "quoted" if inside else "start"
    for c in line:
        if state == "start":
            state = {'"': "quoted", ",": "start"}.get(c, "field")
        elif state == "field":
            state = "start" if c == "," else "field"
        elif state == "quoted":
            state = "quote" if c == '"' else "quoted"
        else:
            state = {'"': "quoted", ",": "start"}.get(c, "field")
    return state == "quoted"


def test_lines_end_as_a_reader_ends_them():
    rng = random.Random(1)
    for _ in range(4000):
        line = "".join(rng.choice('a",, "') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            assert csv_records.ends_inside(line, inside) == plain_end(line, inside), (line, inside)


def made_csv(seed, n):
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "mail", "note"])
    for k in range(n):
        note = rng.choice(["plain", 'say "hi"', "two\nlines, one, comma", '"', "", "\n\n", f"see u{rng.randrange(9)}@b.com\nend", '5" pipe'])
        writer.writerow([k, f"u{rng.randrange(30)}@b.com", note][: rng.choice([1, 2, 3, 3])])
        if rng.random() < 0.05:
            out.write(rng.choice(["\n", 'loose 5" quote,x "y" z\n', 'a,"b"c,"d\ne" f\n']))
    return out.getvalue()


@pytest.mark.parametrize("size", ["64", "301", "100000"])
def test_ranges_give_the_records_of_the_whole_file(spark, tmp_path, size):
    texts = {f"f{k}.csv": made_csv(k, n) for k, n in enumerate((120, 1, 40))}
    texts["lone.csv"] = '"' + "x\n" * 200 + 'a@b.com","c"\nlast,row\n'
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    conf = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        lines = csv_records.csv_lines(spark, str(tmp_path))
        found = csv_records.csv_records(lines).collect()
        done = csv_records.sanitize_csv_records(lines, mode="pii").collect()
        parts = lines.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert parts > 40 if size == "64" else parts >= 1
    for name, text in texts.items():
        records = sorted((r.record, r.text) for r in found if r.path.endswith(name))
        assert [next(csv.reader(io.StringIO(t)), []) for _, t in records] == list(csv.reader(io.StringIO(text)))
        whole = sanitize_structured(spark.createDataFrame([(1, text)], "path int, t string"), "t", "csv", mode="pii").first()
        rows = sorted((r.record, r.content, r.detection_count, r.error) for r in done if r.path.endswith(name))
        assert "".join(c + "\r\n" for _, c, _, _ in rows) == whole.content
        assert sum(n for _, _, n, _ in rows) == whole.detection_count and not any(e for *_, e in rows)


def test_empty_files_and_odd_ends(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "b.csv").write_bytes(b'a,"x\r\ny"\rlast\xff,"open\nto the end')
    rows = sorted((r.path.rsplit("/", 1)[1], r.text) for r in csv_records.csv_records(csv_records.csv_lines(spark, str(tmp_path))).collect())
    assert rows == [("b.csv", 'a,"x\ny"'), ("b.csv", 'last�,"open\nto the end')]
