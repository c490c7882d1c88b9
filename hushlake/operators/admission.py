"""Which files may be processed at all. A rejected row fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.config import SanitizeConfig

# --- Fixed values: extension families and messages --------------------------
PLAIN_EXTENSIONS = (".txt", ".md", ".log")
STRUCTURED_EXTENSIONS = {
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".xml": "xml",
    ".csv": "csv",
}
OFFICE_EXTENSIONS = (".docx", ".xlsx")
PDF_EXTENSIONS = (".pdf",)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp")
ARCHIVE_EXTENSIONS = (".zip", ".tar", ".gz", ".tgz", ".tar.gz", ".7z", ".rar")
ARCHIVE_MESSAGE = "Archives (.zip/.tar/.gz) are not supported in v1; extract files first"
# --- End of fixed values ----------------------------------------------------

SUPPORTED_EXTENSIONS = (
    *PLAIN_EXTENSIONS,
    *STRUCTURED_EXTENSIONS,
    *OFFICE_EXTENSIONS,
    *PDF_EXTENSIONS,
    *IMAGE_EXTENSIONS,
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def doc_extension(name: Column) -> Column:
    """Lower-cased last suffix; ``.tar.gz`` is one; a dotfile has none."""
    lower = F.lower(name)
    return F.when(lower.endswith(".tar.gz"), F.lit(".tar.gz")).otherwise(
        F.regexp_extract(lower, r"(?s)^.+(\.[^.]+)$", 1)
    )


def content_type(ext: Column) -> Column:
    kind = F.lit("text")
    for suffix, name in STRUCTURED_EXTENSIONS.items():
        kind = F.when(ext == suffix, F.lit(name)).otherwise(kind)
    return kind


def admission_error(exists: Column, size: Column, ext: Column, cfg: SanitizeConfig) -> Column:
    """Name of the first check that fails, else null. The order is fixed."""
    return (
        F.when(~exists, F.lit("FileNotFoundError"))
        .when(size > cfg.max_file_bytes, F.lit("FileTooLargeError"))
        .when(ext.isin(*ARCHIVE_EXTENSIONS), F.lit("ArchiveNotSupportedError"))
        .when(~ext.isin(*SUPPORTED_EXTENSIONS), F.lit("UnsupportedFormatError"))
    )


def admission_message(error: Column, path: Column, ext: Column, cfg: SanitizeConfig) -> Column:
    return (
        F.when(error == "FileNotFoundError", F.concat(F.lit("Not a file: "), path))
        .when(
            error == "FileTooLargeError",
            F.lit(f"File exceeds max_file_size_mb={cfg.max_file_size_mb}"),
        )
        .when(error == "ArchiveNotSupportedError", F.lit(ARCHIVE_MESSAGE))
        .when(
            error == "UnsupportedFormatError",
            F.concat(
                F.lit("Unsupported format '"),
                ext,
                F.lit("'; refuse to send raw contents (fail closed)"),
            ),
        )
    )


def admit(
    files: DataFrame,
    config: SanitizeConfig,
    path: str = "path",
    size: str = "length",
    exists: str | None = None,
) -> DataFrame:
    """Add ``file_name, ext, error, message`` to a file listing."""
    present = F.lit(True) if exists is None else F.col(exists)
    return (
        files.withColumn("file_name", file_name(F.col(path)))
        .withColumn("ext", doc_extension(F.col("file_name")))
        .withColumn("error", admission_error(present, F.col(size), F.col("ext"), config))
        .withColumn(
            "message", admission_message(F.col("error"), F.col(path), F.col("ext"), config)
        )
    )


def extension_glob(extensions: tuple[str, ...]) -> str:
    """A case-insensitive file glob for ``pathGlobFilter``."""
    def either_case(ext: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*{" + ",".join(either_case(e) for e in extensions) + "}"


def text_length_gate(df: DataFrame, text_col: str, config: SanitizeConfig) -> DataFrame:
    """Add ``n_chars`` and ``admitted``: texts over the limit are not admitted."""
    return df.withColumn("n_chars", F.length(text_col)).withColumn(
        "admitted", F.col("n_chars") <= config.max_text_length
    )


def unsupported_without_text(ext: Column) -> Column:
    """Message for a supported format whose text has to come from a table."""
    return F.concat(
        F.lit("No extracted text for "), ext, F.lit("; refusing to send original bytes")
    )


