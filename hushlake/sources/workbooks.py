"""Workbooks and letters as tables of lines, for files whose text is too large for one row.

A reader streams a container into rows: the cells of sheets, the shared strings, paragraphs. It
holds one row of a sheet at a time, whatever the file has. Shared strings are looked up by a
join on file and index, and lines are put together row by row, so the cells of one workbook lie
in as many tasks as they need. Lines are redacted as a session of their file.

Defined cases: a container that cannot be read gives one line with an ``error`` and no others; a
null content counts as one. A sheet without cells is its heading; empty rows and blank
paragraphs give no line.
"""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.operators.redact import Settings
from hushlake.operators.sessions import sanitize_sessions
from hushlake.sources.office import (
    _SHEET,
    _SHEET_PART,
    DOCX_MEDIA_WARNING,
    _docx_parts,
    _elements,
    _runs,
    _sheet_rows,
)

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows that a reader hands over at a time
BATCH = 4096
STRINGS = "xl/sharedStrings.xml"
CELLS = pa.schema(
    [
        ("path", pa.string()), ("sheet", pa.int64()), ("row_ord", pa.int64()), ("cell_ord", pa.int64()), ("ref", pa.string()),
        ("t", pa.string()), ("v", pa.string()), ("f", pa.string()), ("n_shared", pa.int64()), ("error", pa.string()),
    ]
)
SHARED = pa.schema([("path", pa.string()), ("idx", pa.int64()), ("text", pa.string()), ("error", pa.string())])
PARAGRAPHS = pa.schema([("path", pa.string()), ("line", pa.int64()), ("text", pa.string()), ("error", pa.string())])


def _shared(archive: zipfile.ZipFile) -> Iterator[str]:
    if STRINGS in archive.namelist():
        for item in _elements(archive, STRINGS, {_SHEET + "si"}):
            yield "".join(_runs(item, _SHEET + "t"))


def _read_shared(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for idx, text in enumerate(_shared(archive)):
            yield idx, text, None


def _read_cells(data: bytes) -> Iterator[tuple]:
    """The cells of all sheets, in the order of their parts' names; a heading (row -1) for each."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        n_shared = sum(1 for _ in _shared(archive))
        for sheet, part in enumerate(sorted(filter(_SHEET_PART.match, archive.namelist()))):
            yield sheet, -1, -1, None, None, None, None, n_shared, None
            for row_ord, cells in enumerate(_sheet_rows(archive, part)):
                for cell_ord, cell in enumerate(cells):
                    yield sheet, row_ord, cell_ord, cell["ref"], cell["t"], cell["v"], cell["f"], n_shared, None


def _read_paragraphs(data: bytes) -> Iterator[tuple]:
    parts = _docx_parts(data)
    for line, runs in enumerate(parts["paragraphs"]):
        yield line, "".join(runs), None
    if parts["has_media"]:
        yield len(parts["paragraphs"]), DOCX_MEDIA_WARNING, None


def _streamed(files: DataFrame, read: Callable[[bytes], Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    """The rows of every file's reader. A file is read through once before its first row is
    handed over, so one that breaks off gives its error alone."""
    nothing = (None,) * (len(schema) - 2)

    def rows(path: str | None, data: bytes | None) -> Iterator[tuple]:
        try:
            for _ in read(data):
                pass
        except Exception as exc:  # one bad container must not fail the job
            yield (path, *nothing, type(exc).__name__)
            return
        for row in read(data):
            yield (path, *row)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for n in range(len(batch)):
                for row in rows(batch.column("path")[n].as_py(), batch.column("content")[n].as_py()):
                    held.append(row)
                    if len(held) == BATCH:
                        yield batch_of(held)
                        held = []
            yield batch_of(held)

    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, ddl)


def workbook_cells(files: DataFrame) -> DataFrame:
    """``path, sheet, row_ord, cell_ord, ref, t, v, f, n_shared, error`` of XLSX files ``(path, content)``."""
    return _streamed(files, _read_cells, CELLS)


def shared_strings(files: DataFrame) -> DataFrame:
    """``path, idx, text, error``: the strings that cells name by their index."""
    return _streamed(files, _read_shared, SHARED)


def cell_lines(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """``path, line, text, error``: a heading per sheet, then a line per row of cells.

    ``line`` places lines within their file. A formula wins over its value; an index that is no
    index gives the raw value, a negative one counts from the end.
    """
    index = F.expr("if(t = 's', try_cast(trim(v) as int), null)")
    placed = cells.withColumn("__idx", F.when(index < 0, F.col("n_shared") + index).otherwise(index))
    names = shared.where("error is null").select(F.col("path").alias("__path"), F.col("idx").alias("__at"), F.col("text").alias("__text"))
    # lookups only: other cells take no part in the join, and a null index meets nothing
    found = placed.join(names, F.expr("path = __path and __idx = __at"), "left")
    value = F.expr(
        """CASE WHEN f <> '' THEN concat('=', f) WHEN v IS NULL THEN '' WHEN t = 's' THEN coalesce(__text, v) ELSE v END"""
    )
    shown = F.when(F.col("ref") != "", F.concat("ref", F.lit(":"), value)).otherwise(value)
    rows = found.where("cell_ord >= 0").groupBy("path", "sheet", "row_ord").agg(
        F.sort_array(F.collect_list(F.struct("cell_ord", shown.alias("text")))).alias("row")
    )
    line = F.expr("sheet * 4294967296 + row_ord + 1").alias("line")
    none = F.lit(None).cast("string").alias("error")
    bodies = rows.select("path", line, F.expr("array_join(transform(row, c -> c.text), ' | ')").alias("text"), none)
    headings = cells.where("row_ord = -1").select(
        "path", line, F.concat(F.lit("## Sheet "), (F.col("sheet") + 1).cast("string")).alias("text"), none
    )
    broken = cells.where("error is not null").select("path", F.lit(0).cast("long").alias("line"), F.lit("").alias("text"), "error")
    return bodies.unionByName(headings).unionByName(broken)


def workbook_lines(files: DataFrame) -> DataFrame:
    """The lines of XLSX files ``(path, content)``."""
    return cell_lines(workbook_cells(files), shared_strings(files))


def letter_lines(files: DataFrame) -> DataFrame:
    """The paragraphs of DOCX files ``(path, content)`` that are not blank, trimmed, and a line
    that warns of pictures."""
    found = _streamed(files, _read_paragraphs, PARAGRAPHS)
    trimmed = F.regexp_replace("text", r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    return found.select(
        "path", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce(trimmed, F.lit("")).alias("text"), "error"
    ).where("text <> '' or error is not null")


def sanitize_lines(lines: DataFrame, mode: str | None = None, config: Settings = None) -> DataFrame:
    """Redact lines as one session per file: ``path, line, content, detections, detection_count, error``."""
    read = lines.withColumnRenamed("error", "__read_error")
    out = sanitize_sessions(read, "text", ["path"], "line", mode, config)
    return out.withColumn("error", F.coalesce("error", F.when(F.col("__read_error").isNotNull(), F.lit("CorruptDocumentError")))).drop(
        "__read_error"
    )
