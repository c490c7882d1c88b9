"""Records of CSV files that are too large for one task.

A quoted field may hold line ends, so where a record begins depends on all quotes before it. Each
byte range of a file is read by a task of its own, which finds for both cases, whether it begins
inside of quotes or not, how it ends and where its last record begins. A range is then a function
of two states; a running composition over the ranges of a file (one row each) gives the state in
which each range begins, and the ranges cut their lines into records in parallel. Records over
the border of ranges are put together from their parts.

Quotes are those of a lenient reader: one that does not stand at the beginning of a field is an
ordinary character.

Defined cases: all line ends count as one; an empty line is a record without cells; a quote that
is never closed ends with its file; bytes that are no UTF-8 become U+FFFD. An empty file has no
records.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushlake.operators.redact import Settings
from hushlake.operators.sessions import sanitize_sessions

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows that a task hands over at a time
BATCH = 4096
#: cells that a record may have: places of cells are places of records times this
CELLS = 1 << 16


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside of quotes, by whether it begins there."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            at = quote + 1
            if line[at : at + 1] == '"':
                at += 1
                continue
            inside = False
        elif line[at : at + 1] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False


def csv_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """``path, block, line``: the lines of CSV files, each range of a file in order in one task."""
    lines = spark.read.options(**options).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"),
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, str]]:
    """Path, range, number in the range and text of each line of a task."""
    now, n = None, 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("path", "block", "line"))
        for path, block, line in zip(*columns, strict=True):
            n = n + 1 if (path, block) == now else 0
            now = (path, block)
            yield path, block, n, line


def _block_functions(lines: DataFrame) -> DataFrame:
    """``path, block, end0, end1, open0, open1``: how a range ends, and the number of the line in
    which its last record begins, for ranges that begin outside and inside of quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, opened, done = None, [False, True], [None, None], []
        for path, block, n, line in _ranges(batches):
            if (path, block) != now:
                if now:
                    done.append((*now, *state, *opened))
                now, state, opened = (path, block), [False, True], [None, None]
            for k in (0, 1):
                if not state[k]:
                    opened[k] = n
                state[k] = ends_inside(line, state[k])
        if now:
            done.append((*now, *state, *opened))
        columns = list(zip(*done, strict=True)) or [()] * 6
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "block", "end0", "end1", "open0", "open1"]
        )

    return lines.mapInArrow(run, "path string, block long, end0 boolean, end1 boolean, open0 long, open1 long")


def _place(block: Column, n: Column) -> Column:
    """A number that orders the lines of a file: a range has at most one line more than bytes."""
    return 2 * block + n


def block_states(functions: DataFrame) -> DataFrame:
    """``path, block, inside, record``: whether a range begins inside of quotes, and the place of the
    record that is open there."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block")
    # a range that turns the state over is a step; one that sets it makes steps before it forgotten
    turns = F.sum(F.expr("if(end0 and not end1, 1, 0)"))
    marked = functions.withColumn("turned", turns.over(upto) % 2)
    fixed = F.last(F.expr("if(end0 = end1, if(end0, 1, 0) + turned, null)"), ignorenulls=True).over(before)
    state = (F.coalesce(fixed, F.lit(0)) + F.coalesce(F.sum(F.expr("if(end0 and not end1, 1, 0)")).over(before), F.lit(0))) % 2 == 1
    known = marked.withColumn("inside", state)
    last = F.when(F.col("inside"), F.col("open1")).otherwise(F.col("open0"))
    placed = known.withColumn("__open", F.when(last.isNotNull(), _place(F.col("block"), last)))
    return placed.select("path", "block", "inside", F.last("__open", ignorenulls=True).over(before).alias("record"))


def _cut(lines: DataFrame, states: DataFrame) -> DataFrame:
    """``path, record, place, text, whole`` of records, and of their parts where a border cuts them."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in _ranges(batches):
            held.append(row)
            if len(held) == BATCH:
                yield lines_of(held)
                held = []
        yield lines_of(held)

    def lines_of(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "block", "n", "line"])

    rows = lines.mapInArrow(numbered, "path string, block long, n long, line string")
    none = F.lit(None)
    # a range's state comes first among its lines: one shuffle, and no join that could split a range
    both = rows.select("*", none.cast("boolean").alias("inside"), none.cast("long").alias("record")).unionByName(
        states.select("path", "block", F.lit(-1).cast("long").alias("n"), none.cast("string").alias("line"), "inside", "record")
    )
    ordered = both.repartition("path", "block").sortWithinPartitions("path", "block", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        path = record = first = None
        inside, cut, text = False, False, []

        def finish(whole: bool) -> None:
            if text:
                out.append((path, record, first, "\n".join(text), whole))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "block", "n", "line", "inside", "record"))
            for row_path, block, n, line, begins_inside, open_record in zip(*columns, strict=True):
                if n < 0:
                    finish(not inside and not cut)
                    path, text, inside, cut = row_path, [], begins_inside, begins_inside
                    record = first = open_record
                    continue
                place = 2 * block + n
                if not inside:
                    finish(not cut)
                    record, first, text, cut = place, place, [], False
                elif not text:
                    first = place
                text.append(line)
                inside = ends_inside(line, inside)
                if len(out) >= BATCH:
                    yield records_of(out)
                    out.clear()
        finish(not inside and not cut)
        yield records_of(out)

    def records_of(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "record", "place", "text", "whole"])

    return ordered.mapInArrow(run, "path string, record long, place long, text string, whole boolean")


def csv_records(lines: DataFrame) -> DataFrame:
    """``path, record, text``: the records of ``csv_lines``; ``record`` orders them in their file."""
    cut = _cut(lines, block_states(_block_functions(lines)))
    parts = cut.where("not whole").groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("parts"))
    joined = parts.select("path", "record", F.expr("array_join(transform(parts, p -> p.text), '\\n')").alias("text"))
    return cut.where("whole").select("path", "record", "text").unionByName(joined)


def _cells(texts: pa.Array) -> pa.Array:
    csv.field_size_limit(sys.maxsize)
    return pa.array([None if t is None else next(csv.reader(io.StringIO(t)), []) for t in texts.to_pylist()], pa.list_(pa.string()))


def _written(cells: str) -> str:
    """A record as a CSV printer writes it: quotes only where they are needed."""
    quoted = "concat('\"', replace(c, '\"', '\"\"'), '\"')"
    cell = f"CASE WHEN c RLIKE '[\",\\r\\n]' OR (c = '' AND size({cells}) = 1) THEN {quoted} ELSE c END"
    return f"array_join(transform({cells}, c -> {cell}), ',')"


def sanitize_csv_records(lines: DataFrame, mode: str | None = None, config: Settings = None) -> DataFrame:
    """Redact CSV files record by record, each file one session: ``path, record, content,
    detection_count, error``. The records in order are what a redaction of the whole text gives."""
    records = csv_records(lines).withColumn("cells", F.arrow_udf(_cells, "array<string>")("text"))
    cells = records.select("path", "record", F.posexplode_outer("cells").alias("__at", "text")).select(
        "path", "record", (F.col("record") * CELLS + F.coalesce("__at", F.lit(0))).alias("place"),
        F.col("__at").isNotNull().alias("cell"), F.coalesce("text", F.lit("")).alias("text"),
    )
    done = sanitize_sessions(cells, "text", ["path"], "place", mode, config)
    rows = done.groupBy("path", "record").agg(
        F.expr("transform(sort_array(collect_list(struct(place, cell, content))), x -> if(x.cell, x.content, null))").alias("cells"),
        F.sum("detection_count").cast("long").alias("detection_count"),
        F.max("error").alias("error"),
    ).withColumn("cells", F.array_compact("cells"))
    return rows.select(
        "path", "record", F.when(F.col("error").isNull(), F.expr(_written("cells"))).otherwise(F.lit("")).alias("content"),
        "detection_count", "error",
    )
