"""Redaction of streams.

A session lives within one document, so a stream needs no state, watermark or
shuffle: it is the batch projection on ``readStream``, written in append mode.

``stream_tables`` writes results and detections of every micro-batch. The batch's id is the
name of its folder in both tables and marks the transaction: a batch that is played again after
a failure replaces what it wrote before, so nothing stands twice. Detections are read from the
written results, so the detectors run once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hushlake.operators import report
from hushlake.operators.redact import Settings, sanitize_table
from hushlake.sources.files import sanitize_file_rows
from hushlake.sources.listing import list_tree, read_listed, tasks_read
from hushlake.sources.scratch import written

#: characters with a meaning in a pattern of file names
_GLOB = re.compile(r"[\\*?\[\]{},^]")
#: names in one part of the listing of a stream
PART_FILES = 50_000
LISTED = "path string, modificationTime timestamp, length bigint"
FILE_ROWS = "path string, modificationTime timestamp, length bigint, content binary"


def read_document_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    file_glob: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files below ``path`` whose name matches ``file_glob``, as a stream. A path that names
    one file is that file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(where):
        path, file_glob = where.getParent().toString(), _GLOB.sub(r"\\\g<0>", where.getName())
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def sanitize_stream(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    text_col: str = "text",
    mode: str | None = None,
    config: Settings = None,
) -> StreamingQuery:
    """Redact everything the stream holds now and append it to a parquet sink.

    The checkpoint makes the run restartable without repeated rows.
    """
    return (
        sanitize_table(stream, text_col, mode, config)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
        .trigger(availableNow=True)
        .start()
    )


def read_file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files of all types below ``path`` as a stream of ``binaryFile`` rows; files that are added
    while it runs come with later micro-batches."""
    reader = spark.readStream.format("binaryFile").schema(FILE_ROWS).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def listed_stream(spark: SparkSession, path: str, listed: str, files_per_trigger: int | None = None) -> DataFrame:
    """``path, modificationTime, length`` of the files below ``path`` as a stream.

    The tree is listed by tasks, and names that the folder ``listed`` does not hold yet are added to
    it, in parts of at most ``files_per_trigger``: the driver sees parts, not files.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(listed)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    names = list_tree(spark, path).where("not hidden and length > 0").select("path", "modificationTime", "length")
    known = spark.read.schema(LISTED).parquet(listed).select("path")
    added = written(names.join(known, "path", "left_anti"), "added")
    if n := added.count():
        most = files_per_trigger or PART_FILES
        added.repartition(-(-n // PART_FILES)).write.option("maxRecordsPerFile", most).mode("append").parquet(listed)
    return read_document_stream(spark, listed, spark.read.schema(LISTED).parquet(listed).schema, files_per_trigger=1 if files_per_trigger else None)


def write_batch(results: DataFrame, batch_id: int, root: str, keys: list[str], sink: str = "parquet") -> None:
    """Results and detections of one micro-batch, in a folder each that its id names."""
    spark = results.sparkSession
    done = f"{root.rstrip('/')}/results/batch_id={batch_id}"
    results.write.format(sink).mode("overwrite").save(done)
    written = spark.read.format(sink).schema(results.schema).load(done)
    found = report.detections_table(written, keys)
    found.write.format(sink).mode("overwrite").save(f"{root.rstrip('/')}/detections/batch_id={batch_id}")


def stream_tables(
    stream: DataFrame,
    redact: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    keys: list[str],
    sink: str = "parquet",
    every: str | None = None,
) -> StreamingQuery:
    """Redact a stream into the tables ``results`` and ``detections`` below ``root``.

    ``redact`` gives the result rows of a micro-batch, ``keys`` name its documents in the
    detections. Runs over all that the stream holds now, or on ``every`` interval for as long
    as it is not stopped. The same root and checkpoint go on where a run ended.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(redact(batch), batch_id, root, keys, sink)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sanitize_file_stream(
    spark: SparkSession,
    path: str,
    root: str,
    checkpoint: str,
    mode: str | None = None,
    config: Settings = None,
    files_per_trigger: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Redact the files below ``path``, and those that are added, by type: what
    ``sanitize_file_rows`` gives for them in one batch.

    Without ``every`` the files are listed and opened by tasks; their names are kept beside the
    checkpoint. A run on an interval, and a store that only Hadoop's client opens, use Spark's
    file source, whose driver holds all names.
    """
    if every or not tasks_read(spark, path):
        stream = read_file_stream(spark, path, files_per_trigger)
        return stream_tables(stream, lambda b: sanitize_file_rows(b, mode, config), root, checkpoint, ["path"], every=every)
    names = listed_stream(spark, path, f"{checkpoint.rstrip('/')}/listed", files_per_trigger)
    return stream_tables(names, lambda b: sanitize_file_rows(read_listed(b), mode, config), root, checkpoint, ["path"])


def read_tables(spark: SparkSession, root: str, sink: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """``results`` and ``detections`` of a stream, with the ``batch_id`` of each row."""
    return tuple(spark.read.format(sink).load(f"{root.rstrip('/')}/{name}") for name in ("results", "detections"))
