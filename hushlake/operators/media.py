"""Policy for images whose text was extracted elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.dialect import SPACE
from hushlake.functions.pin import other_columns
from hushlake.operators.admission import IMAGE_EXTENSIONS

# --- Fixed values -----------------------------------------------------------
IMAGE_MARKER = "[UNSANITIZED_IMAGE_CONTENT]"
BLOCK_WARNING = "Original image bytes must not be sent to the model in this mode"
STRICT_WARNING = "strict mode: do not forward original image bytes even if OCR is clean"
BLANK_WARNING = "OCR produced no text; image content not safely sanitizable"
BLOCKING_MODES = ("pii", "confidential", "strict")
# --- End of fixed values ----------------------------------------------------


def is_blank(text: Column) -> Column:
    return text.rlike(rf"^{SPACE}*\z")


def media_policy(
    df: DataFrame, mode: str | Column, ext_col: str = "ext", text_col: str = "extracted_text"
) -> DataFrame:
    """Add ``text, warnings, block_original_bytes, error`` to image rows.

    Null text means that nothing extracted it: the row fails closed. Blank text
    is replaced by a marker.
    """
    mode_col = F.lit(mode) if isinstance(mode, str) else mode
    text = F.col(text_col)
    blocked = mode_col.isin(*BLOCKING_MODES)
    readable = F.col(ext_col).isin(*IMAGE_EXTENSIONS) & text.isNotNull()
    warnings = F.array_compact(
        F.array(
            F.when(blocked, F.lit(BLOCK_WARNING)),
            F.when(mode_col == "strict", F.lit(STRICT_WARNING)),
            F.when(is_blank(text), F.lit(BLANK_WARNING)),
        )
    )
    missing = F.concat(F.lit("No extracted text for image format "), F.col(ext_col))
    return df.select(
        *other_columns(df, text_col),
        F.when(readable & is_blank(text), F.lit(IMAGE_MARKER))
        .when(readable, text)
        .otherwise(F.lit(""))
        .alias("text"),
        F.when(readable, warnings).otherwise(F.array(missing)).alias("warnings"),
        (blocked & readable).alias("block_original_bytes"),
        F.when(~readable, F.lit("UnsupportedFormatError")).alias("error"),
    )
