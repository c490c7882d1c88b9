"""File corpora: scan, decode, extract, redact. One file is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.config import SanitizeConfig
from hushlake.functions.arrays import empty_array
from hushlake.operators.admission import (
    IMAGE_EXTENSIONS,
    OFFICE_EXTENSIONS,
    PDF_EXTENSIONS,
    PLAIN_EXTENSIONS,
    STRUCTURED_EXTENSIONS,
    SUPPORTED_EXTENSIONS,
    admit,
    content_type,
    doc_extension,
    extension_glob,
    file_name,
    unsupported_without_text,
)
from hushlake.operators.redact import Settings, no_detections, result_columns
from hushlake.operators.structured import redact_documents
from hushlake.sources.listing import list_tree, read_listed, tasks_read
from hushlake.sources.office import docx_parts, docx_text, docx_warnings, xlsx_parts, xlsx_text


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Path, time and size of every file below ``path`` that Spark's readers hand out."""
    listing = list_tree(spark, path).where("not hidden and length > 0")
    return listing.select("path", "modificationTime", "length")


def read_admissible(
    spark: SparkSession,
    path: str | list[str],
    config: SanitizeConfig,
    extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS,
) -> DataFrame:
    """Files of some types within the size limit, with contents. Both tests reach
    the scan, so larger or foreign files are never opened."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", extension_glob(extensions))
        .load(path)
        .where(F.col("length") <= config.max_file_bytes)
    )


def decode_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for bad bytes and ``\\n`` for every line end."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))


def extract_documents(files: DataFrame, office: bool = True) -> DataFrame:
    """Add ``text, content_type, extract_warnings, extract_error`` to admitted
    files that hold ``content`` and ``ext``. Without ``office`` no file is
    unpacked, and the plan has no Python step."""
    ext = F.col("ext")
    no_text = ext.isin(*PDF_EXTENSIONS, *IMAGE_EXTENSIONS)
    text = F.when(~no_text, decode_text(F.col("content")))
    warnings = F.expr(empty_array("string"))
    bad = F.lit(None).cast("string")
    if office:
        files = files.withColumn(
            "__docx", docx_parts(F.when(ext == ".docx", F.col("content")))
        ).withColumn("__xlsx", xlsx_parts(F.when(ext == ".xlsx", F.col("content"))))
        text = (
            F.when(ext == ".docx", docx_text("__docx.paragraphs", "__docx.has_media"))
            .when(ext == ".xlsx", xlsx_text("__xlsx.shared", "__xlsx.sheets"))
            .otherwise(text)
        )
        warnings = F.when(ext == ".docx", docx_warnings("__docx.has_media")).otherwise(warnings)
        bad = F.coalesce(F.col("__docx.error"), F.col("__xlsx.error"))
    return (
        files.withColumn("content_type", content_type(ext))
        .withColumn("text", text)
        .withColumn("extract_warnings", warnings)
        .withColumn("__bad", bad)
        .withColumn(
            "extract_error",
            F.when(F.col("__bad").isNotNull(), F.lit("CorruptDocumentError")).when(
                no_text, F.lit("UnsupportedFormatError")
            ),
        )
        .withColumn(
            "extract_message",
            F.when(
                F.col("__bad").isNotNull(),
                F.concat(F.lit("Cannot unpack document: "), F.col("__bad")),
            ).when(no_text, unsupported_without_text(ext)),
        )
        .drop("__docx", "__xlsx", "__bad", "content")
    )


def sanitize_file_rows(
    files: DataFrame,
    mode: str | None = None,
    config: Settings = None,
    structured: bool = True,
    office: bool = True,
) -> DataFrame:
    """Redact rows shaped like the ``binaryFile`` source: path, length, content.

    Every input row gives one result row; rejected ones fail closed. ``structured``
    and ``office`` may be off if the input holds no such files.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    if cfg.mode == "off":
        cols = result_columns(
            F.coalesce(decode_text(F.col("content")), F.lit("")),
            no_detections(),
            F.array(F.lit("mode=off; no document sanitization applied")),
            F.lit(None).cast("string"),
            "off",
            file_name(F.col("path")),
        )
        return files.select("path", *[c.alias(n) for n, c in cols.items()])
    gated = admit(files, cfg)
    opened = gated.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
    docs = extract_documents(opened, office)
    docs = docs.withColumn("error", F.coalesce("error", "extract_error")).withColumn(
        "message", F.coalesce("message", "extract_message")
    )
    return redact_documents(docs, cfg, structured)


def _hidden_rows(hidden: DataFrame, cfg: SanitizeConfig) -> DataFrame:
    """Results of files that Spark's readers do not open: they fail closed."""
    named = hidden.withColumn("file", file_name(F.col("path")))
    lost = result_columns(
        F.lit(""),
        no_detections(),
        F.array(F.concat(F.lit("Hidden file was not read: "), "file")),
        F.lit("HiddenFileError"),
        cfg.mode,
        F.col("file"),
    )
    return named.select("path", *[c.alias(n) for n, c in lost.items()])


def sanitize_files(
    spark: SparkSession,
    path: str | list[str],
    mode: str | None = None,
    config: Settings = None,
) -> DataFrame:
    """Redact all files below ``path``.

    The tree is listed by tasks into a table. Files that cannot be processed come from that
    table and are reported without being read; empty files give empty results; hidden files,
    which Spark does not open, give a row that fails closed. The others are opened once, by the
    tasks that redact them, from the table; plain texts meet no other Python step. Stores that only
    Hadoop's client opens are read by Spark's source instead.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    listing = list_tree(spark, path)
    near = tasks_read(spark, path)
    hidden = _hidden_rows(listing.where("hidden and length > 0"), cfg)
    empty = listing.where("length = 0").select("path", "length", F.lit(b"").alias("content"))
    shown = listing.where("not hidden and length > 0")
    # overlapping paths name a file more than once
    once = shown if isinstance(path, str) else shown.dropDuplicates(["path"])
    if cfg.mode == "off":
        everything = read_listed(once) if near else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows = everything.select("path", "length", "content").unionByName(empty)
        return sanitize_file_rows(rows, config=cfg).unionByName(hidden)
    admitted = admit(shown, cfg)
    textless = F.col("ext").isin(*PDF_EXTENSIONS, *IMAGE_EXTENSIONS)
    unread = admitted.where(F.col("error").isNotNull() | textless).select(
        "path", "length", F.lit(None).cast("binary").alias("content")
    )
    parsed = (*STRUCTURED_EXTENSIONS, *OFFICE_EXTENSIONS)
    parsed_empty = doc_extension(file_name(F.col("path"))).isin(*parsed)

    def read(extensions: tuple[str, ...]) -> DataFrame:
        if near:
            return read_listed(admit(once, cfg).where(F.col("error").isNull() & F.col("ext").isin(*extensions)))
        return read_admissible(spark, path, cfg, extensions).select("path", "length", "content")

    plain = unread.unionByName(empty.where(~parsed_empty)).unionByName(read(PLAIN_EXTENSIONS))
    others = empty.where(parsed_empty).unionByName(read(parsed))
    return (
        sanitize_file_rows(plain, config=cfg, structured=False, office=False)
        .unionByName(sanitize_file_rows(others, config=cfg))
        .unionByName(hidden)
    )


def requested_files(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Left-join requested paths to a listing; ``exists`` is false if missing."""
    return paths.join(
        listing.withColumn("exists", F.lit(True)), "path", "left"
    ).withColumn("exists", F.coalesce("exists", F.lit(False)))
