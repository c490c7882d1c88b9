"""Corpora planted in SQL from the given tables.

The same SQL text runs in Spark and in DuckDB; only the table reference differs.
Each corpus keeps the planted values as columns beside the text, so that an
expected result can be composed without any pattern.
"""

from __future__ import annotations

import io
import sys
import zipfile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A given table. One of fewer files than cores is dealt out after pruning: redaction
    is CPU work, and a small file has one row group."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, few = spark.sparkContext.defaultParallelism, len(df.inputFiles())
    df = df.select(*columns) if columns else df
    return df.repartition(cores * 2) if few < cores else df


def planted(spark: SparkSession, sf_dir: str, sql: str, base: str) -> DataFrame:
    """A planted corpus with its values; ``sql`` was built over ``{base}``."""
    return spark.sql(sql, base=table(spark, sf_dir, base, BASE_COLUMNS[base]))


BASE_COLUMNS = {"customer": ["c_custkey", "c_mktsegment"], "orders": ["o_orderkey"]}


def _z(expr: str, width: int) -> str:
    return f"lpad(cast({expr} as string), {width}, '0')"


def pii_sql(customer: str = "customer") -> str:
    k = "c_custkey"
    return f"""
    SELECT doc_id, mykad, email, phone, card, iban, person,
        concat('IC ', mykad, '; mail ', email, ' and ', email, '; call ', phone,
               '; card ', card, '; pay ', iban, '; from ', person) AS text
    FROM (SELECT {k} AS doc_id,
        concat({_z(f'{k}%100', 2)}, {_z(f'{k}%15', 2)}, {_z(f'{k}%33', 2)}, '-',
               {_z(f'{k}%100', 2)}, '-', {_z(f'{k}%10000', 4)}) AS mykad,
        concat('user', cast({k}%50 as string), '@', lower(c_mktsegment), '.example.com') AS email,
        concat('+60 1', cast({k}%10 as string), '-', {_z(f'{k}%1000', 3)}, ' ',
               {_z(f'{k}*7%10000', 4)}) AS phone,
        concat('4', {_z(f'{k}*7919+104729', 15)}) AS card,
        concat('GB', {_z(f'{k}%97', 2)}, 'WEST', {_z(f'{k}*31+12345698765432', 14)}) AS iban,
        CASE {k}%4 WHEN 0 THEN 'AHMAD BIN ALI' WHEN 1 THEN 'Siti Nur BINTI Omar'
            WHEN 2 THEN 'Kumar A/L Raju' ELSE 'Alice Tan' END AS person
        FROM {customer}) planted_pii"""


def secrets_sql(customer: str = "customer") -> str:
    k = "c_custkey"
    hashed = "md5(cast({} as string))"
    m, m1, m2 = (hashed.format(e) for e in (k, f"{k}+1", f"{k}+2"))
    return f"""
    SELECT doc_id, api_key, jwt, password, bearer, db_url, private_key,
        concat('key=', api_key, '; token ', jwt, '; password: "', password,
               '"; Authorization: Bearer ', bearer, ' ', db_url, ' ', private_key) AS text
    FROM (SELECT {k} AS doc_id,
        concat('sk-', {m}) AS api_key,
        concat('eyJ', {m}, '.', {m1}, '.', {m2}) AS jwt,
        substr({m}, 1, 4 + cast({k}%6 as int)) AS password,
        concat({m}, ';') AS bearer,
        concat('postgres://app:', {m}, '@db', cast({k}%9 as string), '.example.com:5432/app')
            AS db_url,
        concat('-----BEGIN RSA PRIVATE KEY----- ', {m}, ' -----END RSA PRIVATE KEY-----')
            AS private_key
        FROM {customer}) planted_secrets"""


def confidential_sql(orders: str = "orders") -> str:
    o = "o_orderkey"
    return f"""
    SELECT doc_id, amount, account, url, ref,
        concat('Salary ', amount, '; acct #', account, '; see ', url, ' ref ', ref) AS text
    FROM (SELECT {o} AS doc_id,
        concat('RM ', cast({o}%900+100 as string), ',', {_z(f'{o}%1000', 3)}, '.',
               {_z(f'{o}%100', 2)}) AS amount,
        {_z(o, 10)} AS account,
        concat('http://10.0.', cast({o}%256 as string), '.1:8080/x;') AS url,
        {_z(f'{o}*13', 12)} AS ref
        FROM {orders}) planted_confidential"""


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``doc_id, text`` of one planted corpus."""
    source = {
        "pii": (pii_sql, "customer"),
        "secrets": (secrets_sql, "customer"),
        "confidential": (confidential_sql, "orders"),
    }
    build, base = source[name]
    return planted(spark, sf_dir, build("{base}"), base).select("doc_id", "text")


def all_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three planted corpora under one another."""
    names = ("pii", "secrets", "confidential")
    first, *rest = (corpus(spark, sf_dir, n) for n in names)
    for part in rest:
        first = first.unionByName(part)
    return first


def _office(ext: str, first: str, second: str, number: str) -> bytes | None:
    """A letter with a picture, its first address cut over two runs; a workbook of three cells."""
    if ext not in (".docx", ".xlsx"):
        return None
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        if ext == ".docx":
            w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
            run = "<w:r><w:t>{}</w:t></w:r>"
            runs = run.format(f"write to {first[:3]}") + run.format(first[3:])
            archive.writestr(
                "word/document.xml",
                f"<w:document {w}><w:body><w:p>{runs}</w:p><w:p/><w:p>{run.format(second)}</w:p></w:body></w:document>",
            )
            archive.writestr("word/media/image1.png", "x")
        else:
            s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
            archive.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>{first}</t></si></sst>")
            archive.writestr(
                "xl/worksheets/sheet1.xml",
                f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>SUM(A2)</f><v>1</v></c></row>'
                f'<row><c r="A2"><v>{number}</v></c></row></sheetData></worksheet>',
            )
    return made.getvalue()


def office_files(ext: Column, texts: Column) -> Column:
    """The bytes of a DOCX or XLSX file that holds two addresses and a number; null for other types."""

    def build(ext: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_office(e, *t) for e, t in zip(ext.to_pylist(), texts.to_pylist(), strict=True)], pa.binary())

    return F.arrow_udf(build, "binary")(ext, texts)


#: rows of a workbook that are written at a time
ROWS = 10_000


def _workbook(numbers: pa.Array, mails: pa.Array) -> bytes:
    """A sheet with a row per number: an address from the shared strings, a formula, an index that
    names nothing; a second sheet whose cell names the last string from the end."""
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as archive:
        with archive.open("xl/sharedStrings.xml", "w", force_zip64=True) as part:
            part.write(f"<sst {s}>".encode())
            for at in range(0, len(mails), ROWS):
                part.write("".join(f"<si><t>{m}</t></si>" for m in mails.slice(at, ROWS).to_pylist()).encode())
            part.write(b"</sst>")
        with archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
            part.write(f"<worksheet {s}><sheetData>".encode())
            for at in range(0, len(numbers), ROWS):
                rows = "".join(
                    f'<row><c r="A{n}" t="s"><v>{i}</v></c><c r="B{n}"><f>SUM(C1)</f></c><c t="s"><v>99999999</v></c></row><row/>'
                    for i, n in enumerate(numbers.slice(at, ROWS).to_pylist(), at)
                )
                part.write(rows.encode())
            part.write(b"</sheetData></worksheet>")
        last = '<row><c r="A1" t="s"><v>-1</v></c></row>'
        archive.writestr("xl/worksheets/sheet2.xml", f"<worksheet {s}><sheetData>{last}</sheetData></worksheet>")
    return made.getvalue()


def workbooks(numbers: Column, mails: Column) -> Column:
    """The bytes of a workbook for arrays of numbers and addresses."""

    def build(numbers: pa.Array, mails: pa.Array) -> pa.Array:
        return pa.array([_workbook(numbers[k].values, mails[k].values) for k in range(len(numbers))], pa.binary())

    return F.arrow_udf(build, "binary")(numbers, mails)
