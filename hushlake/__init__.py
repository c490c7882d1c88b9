"""Find and redact sensitive data in tables of documents, on Spark."""

from hushlake.config import CustomRule, SanitizeConfig
from hushlake.operators.admission import admit
from hushlake.operators.nested import sanitize_nested
from hushlake.operators.redact import as_results, sanitize_table
from hushlake.operators.sessions import sanitize_sessions
from hushlake.operators.structured import leaf_table, sanitize_declared, sanitize_structured
from hushlake.sources.files import sanitize_file_rows, sanitize_files
from hushlake.streaming.redaction import sanitize_stream

__all__ = [
    "CustomRule",
    "SanitizeConfig",
    "admit",
    "as_results",
    "leaf_table",
    "sanitize_declared",
    "sanitize_file_rows",
    "sanitize_files",
    "sanitize_nested",
    "sanitize_sessions",
    "sanitize_stream",
    "sanitize_structured",
    "sanitize_table",
]
