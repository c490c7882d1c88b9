"""Files, structured documents, nested columns, sessions, pages, reports."""

import datetime as dt
import io
import json
import os
import random
import time
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from hushlake import (
    CustomRule,
    SanitizeConfig,
    sanitize_declared,
    sanitize_files,
    sanitize_nested,
    sanitize_sessions,
    sanitize_stream,
    sanitize_structured,
    sanitize_table,
)
from hushlake.operators import report
from hushlake.operators.admission import admit, doc_extension
from hushlake.operators.integrity import source_integrity
from hushlake.operators.media import media_policy
from hushlake.operators.numbering import number_sessions
from hushlake.operators.pages import assemble_pages
from hushlake.sources.files import list_files, requested_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def docx(*paragraphs, media=False):
    body = "".join(
        "<w:p>" + "".join(f"<w:r><w:t>{run}</w:t></w:r>" for run in runs) + "</w:p>"
        for runs in paragraphs
    )
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if media:
            archive.writestr("word/media/image1.png", "x")
    return buffer.getvalue()


def xlsx(shared, sheets):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        items = "".join(f"<si><t>{s}</t></si>" for s in shared)
        archive.writestr("xl/sharedStrings.xml", f"<sst {S}>{items}</sst>")
        for n, cells in sheets.items():
            archive.writestr(
                f"xl/worksheets/sheet{n}.xml",
                f"<worksheet {S}><sheetData><row>{cells}</row></sheetData></worksheet>",
            )
    return buffer.getvalue()


FILES = {
    "a.txt": b"mail a@b.com\r\nagain a@b.com\rbad \xff byte",
    "B.MD": b"c@d.com",
    "data.json": json.dumps({"b": "a@b.com", "a": ["c@d.com", 7, None, {"z": "a@b.com"}]}).encode(),
    "bad.json": b'{"b": "a@b.com"',
    "bom.json": b'\xef\xbb\xbf{"b": "a@b.com"}',
    "deep.json": b"[" * 100000 + b'"a@b.com"' + b"]" * 100000,
    "c.yaml": b"mail: user@example.com\nid: 1\nwhen: 2020-01-01\n",
    "bomb.yml": b"a: &a ['x@y.com','x']\nb: &b [*a,*a,*a,*a,*a,*a,*a,*a]\nc: &c [*b,*b,*b,*b,*b,*b,*b,*b]\n"
                b"d: &d [*c,*c,*c,*c,*c,*c,*c,*c]\ne: [*d,*d,*d,*d,*d,*d,*d,*d]\n",
    "bad.yaml": b"a: [b@c.com",
    "x.xml": b"<u m='q@r.com' n='a@b.com'>t@u.com<e>a@b.com</e>tail@x.com<f/></u>",
    "bad.xml": b"<u>a@b.com",
    "t.csv": b'email,id\na@b.com,1\n"x, c@d.com",2,extra\n',
    "d.docx": docx(["Mail a@", "b.com "], ["  "], ["two"], media=True),
    "plain.docx": docx(["a@b.com"]),
    "broken.docx": b"not a zip",
    "s.xlsx": xlsx(["a@b.com"], {
        2: '<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>9</v></c>',
        10: '<c r="A1"><f>SUM(B1)</f><v>3</v></c><c><v>q</v></c><c r="C1"/>',
    }),
    "a.zip": b"PK", "x.tar.gz": b"z", "y.TGZ": b"z", "x.bin": b"\0\1", "noext": b"x", "p.pdf": b"%PDF",
    "i.png": b"png", "big.txt": b"a@b.com " * 20000,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    for name, body in FILES.items():
        (path / name).write_bytes(body)
    return path


@pytest.fixture(scope="module")
def results(spark, folder):
    before = {n: (folder / n).read_bytes() for n in FILES}
    cfg = SanitizeConfig(mode="pii", max_file_size_mb=0.12, max_text_length=100_000)
    listing = list_files(spark, str(folder)).cache()
    listing.count()
    # deep.json is over the size limit above: give it its own run below
    rows = {os.path.basename(r.path): r for r in sanitize_files(spark, str(folder), config=cfg).collect()}
    assert {n: (folder / n).read_bytes() for n in FILES} == before
    assert source_integrity(listing, list_files(spark, str(folder))).where("changed").count() == 0
    return rows


def test_every_file_gives_one_row(results):
    assert set(results) == set(FILES)
    assert all(r.file_name == n for n, r in results.items())


@pytest.mark.parametrize(
    "name, content",
    [
        ("a.txt", "mail [EMAIL_001]\nagain [EMAIL_001]\nbad \ufffd byte"),
        ("B.MD", "[EMAIL_001]"),
        ("bad.json", '{"b": "[EMAIL_001]"'),
        ("bom.json", '\ufeff{"b": "[EMAIL_001]"}'),
        ("c.yaml", "mail: '[EMAIL_001]'\nid: 1\nwhen: 2020-01-01\n"),
        ("bad.yaml", "a: [[EMAIL_001]"),
        ("x.xml", '<u m="[EMAIL_002]" n="[EMAIL_003]">[EMAIL_001]<e>[EMAIL_003]</e>[EMAIL_004]<f /></u>'),
        ("bad.xml", "<u>[EMAIL_001]"),
        ("t.csv", 'email,id\r\n[EMAIL_001],1\r\n"x, [EMAIL_002]",2,extra\r\n'),
        ("d.docx", "Mail [EMAIL_001]\n\ntwo\n\n[UNSANITIZED_IMAGE_CONTENT] embedded images were not OCR'd"),
        ("plain.docx", "[EMAIL_001]"),
        ("s.xlsx", "## Sheet 1\nA1:=SUM(B1) | q | C1:\n## Sheet 2\nA1:[EMAIL_001] | B1:9"),
    ],
)
def test_content(results, name, content):
    assert results[name].sanitized and results[name].content == content


def test_json_keeps_structure(results):
    assert json.loads(results["data.json"].content) == {
        "b": "[EMAIL_001]", "a": ["[EMAIL_002]", 7, None, {"z": "[EMAIL_001]"}]
    }
    assert results["data.json"].metadata.content_type == "json"


@pytest.mark.parametrize(
    "name, warning",
    [
        ("bad.json", "Malformed JSON; sanitized as plain text"),
        ("bom.json", "Malformed JSON; sanitized as plain text"),
        ("bad.yaml", "Malformed YAML; sanitized as plain text"),
        ("bad.xml", "Malformed XML; sanitized as plain text"),
        ("d.docx", "[UNSANITIZED_IMAGE_CONTENT] embedded images were not OCR'd"),
    ],
)
def test_warnings(results, name, warning):  # an alias bomb is walked as it is written: no warning
    assert results[name].warnings == [warning] and results["bomb.yml"].warnings == []
    assert "@" not in results[name].content


@pytest.mark.parametrize(
    "name, error",
    [
        ("a.zip", "ArchiveNotSupportedError"), ("x.tar.gz", "ArchiveNotSupportedError"),
        ("y.TGZ", "ArchiveNotSupportedError"), ("x.bin", "UnsupportedFormatError"),
        ("noext", "UnsupportedFormatError"), ("p.pdf", "UnsupportedFormatError"),
        ("i.png", "UnsupportedFormatError"), ("broken.docx", "CorruptDocumentError"),
        ("big.txt", "FileTooLargeError"), ("deep.json", "FileTooLargeError"),
    ],
)
def test_fail_closed(results, name, error):
    row = results[name]
    assert (row.sanitized, row.content, row.detections) == (False, "", [])
    assert row.metadata.error == error and len(row.warnings) == 1


def test_deep_documents_are_walked(spark):
    deep = "[" * 100000 + '{"k": [1.50, "a@b.com", {}, []]}' + "]" * 100000
    xml = "<a>" * 5000 + "a@b.com" + "</a>" * 5000
    df = spark.createDataFrame([("json", deep), ("xml", xml), ("json", "[" * 100000 + "]" * 99999)], "path string, t string")
    json_row, xml_row, bad = sanitize_structured(df.coalesce(1), "t", F.col("path"), mode="pii").collect()
    assert json_row.content == deep.replace("1.50", "1.5").replace("a@b.com", "[EMAIL_001]") and json_row.warnings == []
    assert xml_row.content == xml.replace("a@b.com", "[EMAIL_001]") and xml_row.warnings == []
    assert bad.warnings == ["Malformed JSON; sanitized as plain text"]


def test_deep_json_reader_agrees():
    from hushlake.sources.structured import _dump_deep_json, _load_deep_json

    for text in ('{"a": [1, -2.5e3, true, null, "x\\u00e9\\n", {}], "b": {"c": []}, "a": 0}', " [ ] ", '"s"', "-0", "[NaN]", "{}"):
        assert str(_load_deep_json(text)) == str(json.loads(text))
        assert "".join(_dump_deep_json(json.loads(text))) == json.dumps(json.loads(text), ensure_ascii=False)
    for text in ("", "[1,]", "{1: 2}", '{"a" 1}', "[1 2]", "[", '{"a": 1', "01", "[1]]", "tru", '{"a": 1,}'):
        with pytest.raises(ValueError):
            _load_deep_json(text)


def test_yaml_anchors_are_shared(spark):
    text = "base: &b\n" + "".join(f"  k{i}: v{i} a{i}@b.com\n" for i in range(40)) + "".join(f"r{i}: *b\n" for i in range(30))
    df = spark.createDataFrame([("k", text)], "path string, t string")
    row = sanitize_structured(df, "t", "yaml", mode="pii").first()
    tree = yaml.safe_load(row.content)
    assert row.warnings == [] and tree["r29"] == tree["base"] and tree["base"]["k39"] == "v39 [EMAIL_040]"


def test_plain_yaml_is_read_and_written_as_by_python():
    from hushlake.sources import structured

    parts = ["a", "x@y.com", "1", "1.50", "true", "~", "2020-01-01", ": ", ":", ":\n", "- ", "-", "\n", "\n  ", "\n    ", " ", "'", "''", '"',
             "\\x41", "#", " # c", "---\n", "...\n", ",", "key", "<<: ", "1_000", "12:30", "\n- ", "\n  - ", "k: v\n", "k: 'v'\n", "long " * 30]
    rnd = random.Random(3)
    values = ["[EMAIL_001]", "x [CARD_002], y", "", "plain", "1", "yes", "a: b", "{x}", "%", "two\nlines", "\u00e9", "w " * 60]

    def with_python(text, visit):
        tree = structured._rewrite_tree(yaml.load(text, Loader=yaml.SafeLoader), visit)
        return yaml.dump(tree, Dumper=yaml.SafeDumper, sort_keys=False, allow_unicode=True)

    def outcome(run, text):
        try:
            return run(text, lambda path, kind, value: values[len(value) % len(values)])
        except Exception:
            return "error"

    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    assert sum(map(structured._plain_yaml, texts)) > 2000
    for text in [*texts, "a: &x [1]\nb: *x\n", "- " * 300 + "a\n", "just text\n", "'': a\nb: c\n"]:
        assert outcome(lambda t, v: structured.rewrite("yaml", t, v), text) == outcome(with_python, text), text


def test_plain_yaml_is_fast():
    from hushlake.sources import structured

    text = "mail: user1@building.example.com\nid: 5\nmore:\n- other5@example.org\n- plain\n"
    start = time.process_time()
    for _ in range(300):
        structured.rewrite("yaml", text, lambda path, kind, value: "[EMAIL_001]")
    ours = time.process_time() - start
    start = time.process_time()
    for _ in range(300):
        yaml.dump(yaml.load(text, Loader=yaml.SafeLoader), Dumper=yaml.SafeDumper)
    assert ours < 0.6 * (time.process_time() - start)


def test_sessions_fail_closed_on_null_keys(spark):
    rows = [(None, 1, "x a@b.com"), ("s", None, "y a@b.com"), (None, None, "z"), ("s", 2, "c@d.com a@b.com")]
    df = spark.createDataFrame(rows, "s string, t int, text string")
    got = sorted(r.content for r in sanitize_sessions(df, "text", ["s"], "t", mode="pii").collect())
    assert got == ["[EMAIL_002] [EMAIL_001]", "x [EMAIL_001]", "y [EMAIL_001]", "z"]


def test_every_private_use_character(spark):
    """No text can switch redaction off."""
    every = "".join(map(chr, range(0xE000, 0xF900)))
    runs = "\ue000" * 5 + "\ue001" + "\ue000"
    texts = [every + " a@b.com", runs + "a@b.com" + runs, runs + " a@b.com\ue000", "\ue001a@b.com\ue000"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = sanitize_table(df, mode="pii").orderBy("id").collect()
    assert [r.content for r in rows] == [t.replace("a@b.com", "[EMAIL_001]") for t in texts]
    assert [r.detections[0].start for r in rows] == [t.index("a@b.com") for t in texts]
    sessions = sanitize_sessions(df.withColumn("s", F.lit(1)), "text", ["s"], "id", mode="pii").orderBy("id").collect()
    assert [r.content for r in sessions] == [r.content for r in rows]


def test_declared_keeps_what_the_schema_does_not_name(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("m", T.StringType()), T.StructField("n", T.StringType())])
    texts = ['{"m": "a@b.com", "extra": "keep me"}', '{"m": "a@b.com"}', '{"m": "a@b.com", "n": null}', '{"m": {"x": 1}, "n": "c"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r for r in sanitize_declared(df, "t", schema, "json", mode="pii").collect()}
    assert "keep me" in got[0].content and "[EMAIL_001]" in got[0].content and len(got[0].warnings) == 1
    assert json.loads(got[1].content) == {"m": "[EMAIL_001]", "n": None} and got[1].warnings == []
    assert json.loads(got[2].content) == {"m": "[EMAIL_001]", "n": None}
    xml = ["<doc><m>a@b.com</m><n>x</n></doc>", "<doc><m>a@b.com</m><q>x</q></doc>", '<doc k="1"><m>a@b.com</m></doc>']
    df = spark.createDataFrame(list(enumerate(xml)), "id int, t string")
    got = {r.id: r for r in sanitize_declared(df, "t", schema, "xml", mode="pii").collect()}
    assert "".join(got[0].content.split()) == "<doc><m>[EMAIL_001]</m><n>x</n></doc>" and got[0].warnings == []
    assert got[1].content == "<doc><m>[EMAIL_001]</m><q>x</q></doc>" and got[2].content.startswith('<doc k="1">')


def test_leak_check_is_near_linear(spark):
    text = " ".join(f"user{i}@example.com" for i in range(20_000))
    df = spark.createDataFrame([(1, text, text[:400_000]), (2, "a@b.com", "[EMAIL_001]"), (3, "a@b.com", None)], "id int, text string, content string")
    started = time.monotonic()
    rows = report.leak_check(df, ["id"], mode="pii").collect()
    expected = sum(value in text[:400_000] for value in text.split())
    assert [tuple(r) for r in rows] == [(1, "EMAIL", expected)]
    assert time.monotonic() - started < 60


def test_metrics_count_documents_of_several_rows(spark):
    df = spark.createDataFrame([("s", 1, "a@b.com"), ("s", 2, "a@b.com c@d.com"), ("t", 1, "x")], "s string, t int, text string")
    res = sanitize_sessions(df, "text", ["s"], "t", mode="pii")
    assert [tuple(r) for r in report.category_metrics(res, "s").collect()] == [("EMAIL", 3, 1, 2)]


def test_files_off(spark, folder):
    rows = {r.file_name: r for r in sanitize_files(spark, str(folder), mode="off").collect()}
    assert rows["a.zip"].content == "PK" and not rows["a.txt"].sanitized
    assert rows["a.txt"].warnings == ["mode=off; no document sanitization applied"]


def test_extension_and_gate_order(spark):
    names = ["a.tar.gz", "a.TGZ", ".env", "A.TXT", "e.", "x.y.Json", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.e for r in df.select("n", doc_extension(F.col("n")).alias("e")).collect()}
    assert got == {"a.tar.gz": ".tar.gz", "a.TGZ": ".tgz", ".env": "", "A.TXT": ".txt", "e.": "",
                   "x.y.Json": ".json", "plain": ""}
    asked = spark.createDataFrame([("d/gone.txt",), ("d/huge.zip",), ("d/edge.txt",)], "path string")
    listing = spark.createDataFrame([("d/huge.zip", 1048577), ("d/edge.txt", 1048576)], "path string, length long")
    gated = admit(requested_files(asked, listing), SanitizeConfig(max_file_size_mb=1), exists="exists")
    assert {r.path: r.error for r in gated.collect()} == {
        "d/gone.txt": "FileNotFoundError", "d/huge.zip": "FileTooLargeError", "d/edge.txt": None
    }


def test_integrity_sees_changes(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "path string, modificationTime timestamp, length long"
    before = spark.createDataFrame([("same", t, 1), ("grown", t, 1), ("gone", t, 1)], schema)
    after = spark.createDataFrame([("same", t, 1), ("grown", t, 2), ("new", t, 1)], schema)
    got = {r.path: r.changed for r in source_integrity(before, after).collect()}
    assert got == {"same": False, "grown": True, "gone": True, "new": True}


def test_nested_walk(spark):
    record = (
        "a@b.com", 5, ["c@d.com", None, "a@b.com"], {"x@y.com": "e@f.com"},
        [("g@h.com", 1, ["c@d.com"]), (None, 2, None), ("z@h.com", 3, ["q@d.com", "c@d.com"])],
        [["k@l.com"], [], ["a@b.com", "m@n.com"]],
    )
    schema = (
        "id int, r struct<email:string,id:int,tags:array<string>,attrs:map<string,string>,"
        "deep:array<struct<a:string,n:int,b:array<string>>>,grid:array<array<string>>>"
    )
    df = spark.createDataFrame([(1, record), (2, None)], schema)
    one, two = sorted(sanitize_nested(df, "r", mode="pii").collect(), key=lambda r: r.id)
    e = "[EMAIL_%03d]"
    assert one.r.email == e % 1 and one.r.id == 5
    assert one.r.tags == [e % 2, None, e % 1]
    assert one.r.attrs == {"x@y.com": e % 3}
    assert [(d.a, d.n, d.b) for d in one.r.deep] == [
        (e % 4, 1, [e % 2]), (None, 2, None), (e % 5, 3, [e % 6, e % 2])
    ]
    assert one.r.grid == [[e % 7], [], [e % 1, e % 8]]
    assert two.r is None and one.detection_count == 12


def test_awkward_column_names(spark):
    df = spark.sql("select 1 `a.b`, 2 `c``d`, 'x a@b.com' ctx, named_struct('we0', 'c@d.com') wout")
    row = sanitize_nested(sanitize_table(df, "ctx", mode="pii").drop("detections", "detection_count", "categories"), "wout").first()
    assert (row["a.b"], row["c`d"], row.content, row.wout.we0) == (1, 2, "x [EMAIL_001]", "[EMAIL_001]")


def test_nested_without_strings(spark):
    df = spark.sql("select named_struct('k', 69, 'x', array(1, 2)) r")
    assert sanitize_nested(df, "r", mode="strict").first().r.asDict() == {"k": 69, "x": [1, 2]}


def test_sessions_match_brute_force(spark):
    rng = random.Random(2)
    rows, value = [], {}
    for session in range(3):
        for turn in range(300 if session == 0 else 40):
            users = [rng.randint(0, 60) for _ in range(rng.randint(0, 4))]
            rows.append((session, turn, " , ".join(f"u{u}@x.com" for u in users)))
            value[session, turn] = users
    df = spark.createDataFrame(rows, "s int, t int, text string")
    got = {(r.s, r.t): r for r in sanitize_sessions(df, "text", ["s"], "t", "pii").collect()}
    assert len(got) == len(rows)
    for session in range(3):
        seen = []
        for turn in sorted(t for s, t in value if s == session):
            for u in value[session, turn]:
                if u not in seen:
                    seen.append(u)
            want = " , ".join(f"[EMAIL_{seen.index(u) + 1:03d}]" for u in value[session, turn])
            assert got[session, turn].content == want


def test_sessions_with_shared_order(spark):
    rows = [("s", 1, "a@b.com"), ("s", 1, "x a@b.com c@d.com"), ("s", 1, "a@b.com"), ("s", 2, None)]
    df = spark.createDataFrame(rows, "s string, t int, text string")
    cfg = SanitizeConfig(custom_rules=(CustomRule("x", r"\bx\b", "[X]"),))
    got = sorted(str(r.content) for r in sanitize_sessions(df, "text", ["s"], "t", config=cfg).collect())
    assert got == ["None", "[EMAIL_001]", "[EMAIL_001]", "[X] [EMAIL_001] [EMAIL_002]"]


@pytest.mark.parametrize("step", [0, 1, 86_400_000_000])
def test_numbering_is_independent_of_order_values(spark, step):
    """Shared, dense and sparse order values; a null session is a session."""
    rng = random.Random(9)
    hits = [(None, i * step, i, "C", f"v{rng.randint(0, 200)}") for i in range(500)]
    df = spark.createDataFrame(hits, "s string, row long, start int, category string, value string")
    got = {r.value: r.number for r in number_sessions(df, ["s"], "row").collect()}
    first = list(dict.fromkeys(h[4] for h in hits))
    assert got == {v: i + 1 for i, v in enumerate(first)}


def test_pages_match_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc in range(6):
        texts, warnings, image = [], [], False
        for page in range(1, 700 if doc == 0 else 12):
            text = rng.choice(["", "  \n", f"page {page} of {doc}", "x" * 30])
            has_image, failed = rng.random() < 0.2, rng.random() < 0.1
            rows.append((doc, page, text, has_image, failed))
            if failed:
                text = ""
                warnings.append(f"Failed to extract text from PDF page {page}")
            if text.strip():
                texts.append(text)
            if has_image:
                warnings.append("[UNSANITIZED_IMAGE_CONTENT] PDF may contain embedded images")
                image = True
        body = "\n\n".join(texts) + ("\n\n[UNSANITIZED_IMAGE_CONTENT]" if image else "")
        want[doc] = (body, list(dict.fromkeys(warnings)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc int, page_no int, text string, has_images boolean, failed boolean")
    limit = len(want[0][0]) - 1  # the long document is one character over
    got = {r.doc: r for r in assemble_pages(df, "doc", SanitizeConfig(max_text_length=limit)).collect()}
    assert got[0].error == "FileTooLargeError" and got[0].text == ""
    for doc in range(1, 6):
        assert (got[doc].text, got[doc].warnings) == want[doc] and got[doc].error is None
    whole = assemble_pages(df, "doc", SanitizeConfig(max_text_length=limit + 1)).where("doc = 0").first()
    assert (whole.text, whole.warnings) == want[0]


def test_media_policy(spark):
    df = spark.createDataFrame(
        [(m, e, t) for m in ("off", "secrets_only", "pii", "strict") for e, t in
         ((".png", "hi"), (".png", " \n"), (".png", None), (".gif", "x"))],
        "mode string, ext string, extracted_text string",
    )
    rows = media_policy(df, F.col("mode")).collect()
    assert len(rows) == 16
    by = {(r.mode, r.ext, r.text, r.error): r for r in rows}
    strict = by["strict", ".png", "hi", None]
    assert strict.block_original_bytes and len(strict.warnings) == 2
    assert len(by["strict", ".png", "[UNSANITIZED_IMAGE_CONTENT]", None].warnings) == 3
    assert by["secrets_only", ".png", "hi", None].warnings == []
    assert not by["secrets_only", ".png", "hi", None].block_original_bytes
    assert by["pii", ".png", "", "UnsupportedFormatError"].warnings


def test_reports_hold_no_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "to secret.person@example.com"), (2, "none"), (3, "x" * 50)], "id int, text string")
    res = sanitize_table(df, mode="pii", config={"max_text_length": 40})
    audit = {r.id: (r.file, r.mode, r.detections, r.categories) for r in report.audit_table(res, ["id"]).collect()}
    assert audit == {1: ("(text)", "pii", 1, "EMAIL"), 2: ("(text)", "pii", 0, "none"), 3: ("(text)", "pii", 0, "none")}
    assert [r.id for r in report.warning_rows(res, ["id"]).collect()] == [3]
    report.write_payload(res, str(tmp_path / "payload"), ["id"])
    report.write_detections(res, str(tmp_path / "detections"), ["id"])
    written = spark.read.json(str(tmp_path / "payload"))
    assert written.count() == 3 and "secret.person" not in str(written.collect())
    assert spark.read.parquet(str(tmp_path / "detections")).count() == 1
    both = res.join(df, "id")
    assert report.leak_check(both, ["id"], mode="pii").count() == 0
    counts = {r.category: r.hits for r in report.catalogue_with_metrics(spark, report.category_metrics(res, "id")).collect()}
    assert len(counts) == 16 and counts["EMAIL"] == 1 and sum(counts.values()) == 1


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sanitize_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), mode="pii")
    query.awaitTermination()
    got = {r.doc_id: r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.doc_id: r.content for r in sanitize_table(docs, mode="pii").collect()}
    assert got == want and any("[EMAIL_001]" in v for v in got.values())


@pytest.mark.parametrize("folder", [True, False])
def test_stream_reads_a_table_of_one_or_many_files(spark, tmp_path, folder):
    from hushlake.plans.queries import QUERIES

    rows = [(n, f"to a{n}@b.com") for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3 if folder else 1)
    docs.write.parquet(str(tmp_path / "other.parquet"))
    if folder:
        docs.write.parquet(str(tmp_path / "documents.parquet"))
    else:
        next((tmp_path / "other.parquet").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got = QUERIES["stream_sanitize"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.content) for r in got) == [(n, "to [EMAIL_001]") for n in range(6)]


def test_sql_functions(spark):
    from hushlake.functions.validators import register_sql_functions

    register_sql_functions(spark)
    row = spark.sql(
        """select luhn_valid('4111 1111 1111 1111') a, luhn_valid('4111111111111112') b,
        iban_valid('GB82 WEST 1234 5698 7654 32') c, iban_valid('GB83WEST12345698765432') d,
        mykad_valid('900101-14-5678') e, mykad_valid('901301-14-5678') f, iban_valid('x') g,
        placeholder_token('EMAIL', 7) h, placeholder_token('EMAIL', 1234) i"""
    ).first()
    assert tuple(row) == (True, False, True, False, True, False, False, "[EMAIL_007]", "[EMAIL_1234]")


def test_files_spark_passes_over(spark, tmp_path):
    (tmp_path / "_sub").mkdir()
    for name, body in {"a.txt": "a@b.com", "_a.txt": "a@b.com", ".b.txt": "x", "empty.txt": "", "_sub/c.json": "{}", "_none.md": "", "e.docx": ""}.items():
        (tmp_path / name).write_text(body)
    found = sanitize_files(spark, str(tmp_path), mode="pii").collect()
    rows = {r.path.rsplit("/", 1)[1]: r for r in found}
    assert rows["a.txt"].content == "[EMAIL_001]" and len(rows) == len(found) == 7
    assert sanitize_files(spark, str(tmp_path), mode="off").count() == 7
    assert {n for n, r in rows.items() if r.metadata.error == "HiddenFileError"} == {"_a.txt", ".b.txt", "c.json"}
    assert rows["empty.txt"].content == "" and rows["empty.txt"].sanitized and rows["_none.md"].sanitized
    assert rows["e.docx"].metadata.error == "CorruptDocumentError"


def test_every_call_gives_result_rows(spark):
    from hushlake import as_results
    from hushlake.operators.redact import RESULT_COLUMNS

    df = spark.createDataFrame([("s", 1, "a@b.com"), ("s", None, "x")], "s string, t int, text string")
    sessions = as_results(sanitize_sessions(df, "text", ["s"], "t", mode="pii"), "pii")
    assert sessions.columns == ["s", "t", *RESULT_COLUMNS]
    assert sorted(tuple(r)[1:] for r in report.audit_table(sessions).collect()) == [("pii", 0, "none"), ("pii", 1, "EMAIL")]
    nested = sanitize_nested(df.select(F.struct("text").alias("doc")), "doc", mode="pii")
    rows = as_results(nested, "pii", "doc").collect()
    assert [(r.content, r.sanitized, r.categories) for r in rows] == [('{"text":"[EMAIL_001]"}', True, ["EMAIL"]), ('{"text":"x"}', True, [])]


def test_tree_is_listed_by_tasks(spark, tmp_path):
    from hushlake.sources import listing

    names = ["a.txt", "d/b c.txt", "d/_x=1/c.md", "d/_y/e/f.json", ".g/h", "d/e/.i", "_metadata/j", "k._COPYING_", "d/e/é%20.log", "empty"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty" else name)
    (tmp_path / "no_files").mkdir()
    read = {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).collect()}
    found = listing.list_tree(spark, str(tmp_path)).collect()
    assert {r.path for r in found if not r.hidden and r.length} == read
    assert {r.path for r in found} == {f"file:{tmp_path}/{n}" for n in names}
    assert {r.path: r.length for r in found} == {f"file:{tmp_path}/{n}": (tmp_path / n).stat().st_size for n in names}
    hidden = {r.path.removeprefix(f"file:{tmp_path}/") for r in found if r.hidden}
    assert hidden == {"d/_y/e/f.json", ".g/h", "d/e/.i", "k._COPYING_"}
    walked = listing._walked(spark, [(f"file:{tmp_path}", False)])
    key = ("path", "length", "modificationTime", "hidden")
    assert sorted(walked.select(*key).collect()) == sorted(listing.list_tree(spark, str(tmp_path)).select(*key).collect())
    one = listing.list_tree(spark, [str(tmp_path / "a.txt"), str(tmp_path / "d" / "e*")])
    assert {r.path.rsplit("/", 1)[1] for r in one.collect()} == {"a.txt", ".i", "é%20.log"}
    assert listing.list_tree(spark, str(tmp_path / "no_files")).count() == 0


def test_workbook_parts_are_not_kept_whole():
    """What a reader holds does not grow with the rows of a sheet."""
    import tracemalloc

    from hushlake.sources.workbooks import _read_cells

    def peak(rows):
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as archive:
            body = "".join(f'<row><c r="A{n}"><v>{n}</v></c></row><row/>' for n in range(rows))
            archive.writestr("xl/worksheets/sheet1.xml", f"<worksheet {S}><sheetData>{body}</sheetData></worksheet>")
        del body
        tracemalloc.start()
        assert sum(1 for _ in _read_cells(made.getvalue())) == rows + 1
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return held

    peak(10)
    assert peak(20_000) < 2 * peak(5_000)


def test_pieces_hold_little_beside_the_document():
    import tracemalloc

    import pyarrow as pa

    from hushlake.sources.structured import _pieces

    n = 20_000
    text = "<all>" + "".join(f'<c id="{k}">&lt;a{k}@b.com&gt;</c>tail &amp;' for k in range(n)) + "</all>"
    for kind, doc in (("xml", text), ("json", json.dumps([{"id": k, "mail": f"to a{k}@b.com"} for k in range(n)]))):
        columns = pa.array([kind, "json", None]), pa.array([doc, "{", None])
        tracemalloc.start()
        out = _pieces(*columns)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out.is_valid().to_pylist() == [True, False, False]
        pieces = out[0].as_py()
        assert pieces[-1] == dict(pieces[-1], slot=None, path=None, place=len(pieces) - 1)
        assert len(pieces) == (3 * n if kind == "xml" else n) + 1
        assert peak < 1000 * n, (kind, peak)


def test_files_are_opened_by_tasks(spark, tmp_path):
    """No scan plans the files of a tree, in a batch or in a stream; contents come as they are."""
    import gzip

    from hushlake.sources.listing import list_tree, read_listed
    from hushlake.streaming.redaction import read_tables, sanitize_file_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(30):
        (folder / f"{n}.txt").write_text(f"to a{n}@b.com")
    (folder / "x.json.gz").write_bytes(gzip.compress(b"{}"))
    (folder / "gone.txt").symlink_to(tmp_path / "nothing")
    listed = list_tree(spark, str(folder)).where("length > 0")
    got = {os.path.basename(r.path): bytes(r.content) for r in read_listed(listed).collect()}
    assert len(got) == 31 and got["x.json.gz"] == (folder / "x.json.gz").read_bytes() and got["7.txt"] == b"to a7@b.com"
    out = sanitize_files(spark, str(folder), mode="pii")
    assert "binaryFile" not in out._jdf.queryExecution().toString()
    assert sum(r.content == "to [EMAIL_001]" for r in out.collect()) == 30
    assert sanitize_files(spark, [str(folder), f"{folder}/3.txt"], mode="pii").where("path like '%/3.txt'").count() == 1
    (folder / "gone.txt").unlink()
    for more in (0, 3):
        for n in range(more):
            (folder / f"late{n}.txt").write_text("to a@b.com")
        query = sanitize_file_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), mode="pii", files_per_trigger=20)
        query.awaitTermination()
        assert all("listed" in str(p["sources"]) for p in query.recentProgress)
        assert read_tables(spark, str(tmp_path / "out"))[0].count() == 31 + more


def test_files_written_by_tasks(spark, tmp_path):
    from hushlake.sources.listing import write_files

    rows = [("x/a.bin", b"\x00\xff"), ("x/y/b.txt", None), ("c", b"c")]
    files = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    for _ in range(2):
        assert sorted((r.path, r.length) for r in write_files(files, str(tmp_path)).collect()) == sorted(
            (f"{tmp_path}/{p}", len(c or b"")) for p, c in rows
        )
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {p: c or b"" for p, c in rows}
    with pytest.raises(Exception, match="below the root"):
        write_files(spark.createDataFrame([("../out", b"x")], "path string, content binary"), str(tmp_path)).collect()


def test_office_files_as_lines(spark):
    from hushlake.sources.workbooks import letter_lines, sanitize_lines, workbook_lines

    shared = [f"s{i}@b.com" for i in range(9000)]
    cells = lambda n: "".join(f'<c r="A{n}" t="s"><v>{n}</v></c><c><v>{n}</v></c>' for _ in range(2))
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as archive:
        archive.writestr("xl/sharedStrings.xml", f"<sst {S}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        rows = "".join(f"<row>{cells(n)}</row>" for n in range(9000))
        archive.writestr("xl/worksheets/sheet1.xml", f"<worksheet {S}><sheetData>{rows}<row/></sheetData></worksheet>")
        archive.writestr("xl/worksheets/sheet10.xml", f"<worksheet {S}><sheetData/></worksheet>")
    small = xlsx(["a@b.com", "last@b.com"], {1: '<c t="s"><v>7</v></c><c t="s"><v>-1</v></c><c t="s"><v>x</v></c><c r="D1"><f>A1</f><v>3</v></c><c/>'})
    letter = docx(["  mail ", "a@b.com "], [" ", "\t"], ["again a@b.com"], media=True)
    rows = [("big", big.getvalue()), ("small", small), ("cut", small[: len(small) // 2]), ("none", None)]
    books = spark.createDataFrame(rows, "path string, content binary").repartition(2)
    lines = sorted((r.path, r.line, r.text, r.error) for r in workbook_lines(books).collect())
    assert [x for x in lines if x[0] == "small"] == [("small", 0, "## Sheet 1", None), ("small", 1, "7 | last@b.com | x | D1:=A1 | ", None)]
    assert [(x[0], x[2], bool(x[3])) for x in lines if x[0] in ("cut", "none")] == [("cut", "", True), ("none", "", True)]
    held = [x for x in lines if x[0] == "big"]
    assert len(held) == 9002 and held[8999 + 1][2] == "A8999:s8999@b.com | 8999 | A8999:s8999@b.com | 8999" and held[-1][2] == "## Sheet 2"
    out = {(r.path, r.line): r for r in sanitize_lines(workbook_lines(books.where("path <> 'big'")), mode="pii").collect()}
    assert out["small", 1].content == "7 | [EMAIL_001] | x | D1:=A1 | " and out["cut", 0].error == "CorruptDocumentError"
    letters = spark.createDataFrame([("l", letter), ("bad", b"PK")], "path string, content binary")
    found = sorted((r.path, r.line, r.content, r.error) for r in sanitize_lines(letter_lines(letters), mode="pii").collect())
    assert found == [
        ("bad", 0, "", "CorruptDocumentError"), ("l", 0, "mail [EMAIL_001]", None), ("l", 2, "again [EMAIL_001]", None),
        ("l", 3, "[UNSANITIZED_IMAGE_CONTENT] embedded images were not OCR'd", None),
    ]


def test_documents_are_rebuilt_from_their_leaves(spark):
    from hushlake.operators.structured import sanitize_leaves

    texts = {
        "json": json.dumps({"k\n": [f"u{i % 400}@b.com \"q\" \\ \n\u0001é" for i in range(1500)], "n": [1, 2.5, None], "0": "", "e": {}}),
        "xml": "<a b='x@y.org &quot;&#10;'>t &amp; x@y.org<c/> tail &lt;z@y.org&gt;<d>p</d></a>",
        "csv": 'h,i\n"a@b.com, ""q""",2\n\nsolo\n""\n"two\nlines",\n',
        "yaml": "a: x@y.org\nb: 1\n",
        "bad": '{"a": "x@y.org"',
    }
    rows = [(k, "json" if k == "bad" else k, t) for k, t in texts.items()] + [("null", "json", None)]
    docs = spark.createDataFrame(rows, "path string, kind string, t string")
    whole = {r.path: r for r in sanitize_structured(docs.where("kind <> 'yaml'"), "t", F.col("kind"), mode="pii").collect()}
    got = {r.path: r for r in sanitize_leaves(docs, "t", F.col("kind"), ["path"], mode="pii").collect()}
    for key in ("json", "xml", "csv", "bad"):
        assert got[key].content == whole[key].content and got[key].detection_count == whole[key].detection_count, key
    assert {k for k, r in got.items() if r.fell_back} == {"bad", "yaml", "null"}
    assert got["yaml"].content == "a: [EMAIL_001]\nb: 1\n" and got["null"].content == ""
    assert "[EMAIL_400]" in got["json"].content


def test_a_batch_that_is_played_again_adds_nothing(spark, tmp_path):
    from hushlake.streaming.redaction import read_tables, sanitize_file_stream, stream_tables, write_batch

    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", b"a@b.com and c@d.com"), ("b.json", b'{"k": "a@b.com"}'), ("c.zip", b"PK")):
        (tmp_path / "in" / name).write_bytes(data)

    def run():
        sanitize_file_stream(spark, str(tmp_path / "in"), root, checkpoint, mode="pii", files_per_trigger=1).awaitTermination()
        return [sorted(t.drop("batch_id").collect()) for t in read_tables(spark, root)]

    first = run()
    assert [len(t) for t in first] == [3, 3]
    assert run() == first  # nothing is new
    for batch in (0, 2):  # as after a failure between the tables and the checkpoint
        again = spark.read.parquet(f"{root}/results/batch_id={batch}")
        write_batch(spark.createDataFrame(again.collect(), again.schema), batch, root, ["path"])
    assert [sorted(t.drop("batch_id").collect()) for t in read_tables(spark, root)] == first
    (tmp_path / "in" / "d.md").write_text("later e@f.org")
    results, detections = run()
    assert len(results) == 4 and len(detections) == 4
    docs = spark.readStream.schema("text string").format("text").load(str(tmp_path / "in"))
    from hushlake import sanitize_table

    query = stream_tables(
        docs.withColumnRenamed("value", "text"), lambda b: sanitize_table(b.withColumn("n", F.lit(1)), mode="pii"),
        str(tmp_path / "other"), str(tmp_path / "c2"), ["n"], sink="json",
    )
    query.awaitTermination()
    assert read_tables(spark, str(tmp_path / "other"), "json")[1].count() == 4
