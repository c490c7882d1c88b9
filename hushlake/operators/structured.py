"""Redaction of documents by content type.

A structured document is one row: its leaves are parsed into an array, redacted
in one session and rendered back. Plain text, and documents that do not parse,
are a single leaf. Only structured texts are sent to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hushlake.config import SanitizeConfig
from hushlake.functions import json_text
from hushlake.functions.arrays import empty_array, literal
from hushlake.functions.pin import other_columns, pin
from hushlake.operators.nested import sanitize_nested
from hushlake.operators.redact import (
    Settings,
    result_columns,
    with_detections,
    with_leaf_detections,
)
from hushlake.operators.sessions import sanitize_sessions
from hushlake.rules import Rule, selected_rules
from hushlake.sources.structured import (
    FALLBACK_WARNINGS,
    YAML_MISSING_WARNING,
    leaf_pieces,
    leaf_rows,
    parse_leaves,
    render_leaves,
    yaml_available,
)


def fallback_warning(kind: Column) -> Column:
    warning = F.lit(None).cast("string")
    for name, text in FALLBACK_WARNINGS.items():
        if name == "yaml" and not yaml_available():
            text = YAML_MISSING_WARNING
        warning = F.when(kind == name, F.lit(text)).otherwise(warning)
    return warning


def redact_documents(
    docs: DataFrame, cfg: SanitizeConfig, structured: bool | str = True
) -> DataFrame:
    """``docs`` has path, file_name, content_type, text, extract_warnings, and
    error/message of rows rejected before. With ``structured`` off every text is
    taken as plain, with ``"json"`` every text as JSON; then the plan has no Python step."""
    kind = F.col("content_type")
    too_long = F.col("error").isNull() & (F.length("text") > F.lit(cfg.max_text_length))
    gated = (
        docs.withColumn("__long", F.coalesce(too_long, F.lit(False)))
        .withColumn(
            "message",
            F.when(
                F.col("__long"),
                F.lit(f"Extracted text exceeds max_text_length={cfg.max_text_length}"),
            ).otherwise(F.col("message")),
        )
        .withColumn(
            "error", F.when(F.col("__long"), F.lit("FileTooLargeError")).otherwise(F.col("error"))
        )
        .withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
        .withColumn("__kind", F.when(kind != "text", kind))
    )
    work = {True: _by_leaves, False: _as_plain, "json": _by_json_tokens}[structured]
    worked = work(gated, selected_rules(cfg))
    warnings = F.when(
        F.col("error").isNotNull(), F.array_compact(F.array(F.col("message")))
    ).otherwise(
        F.concat(
            F.coalesce(F.col("extract_warnings"), F.expr(empty_array("string"))),
            F.array_compact(F.array(F.when(F.col("__fell_back"), fallback_warning(kind)))),
        )
    )
    cols = result_columns(
        F.col("__content"),
        F.col("__detections"),
        warnings,
        F.col("error"),
        cfg.mode,
        F.col("file_name"),
        kind,
        F.lit(False),
    )
    return worked.select("path", *[c.alias(n) for n, c in cols.items()])


def _as_plain(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``__content, __detections, __fell_back`` without parsing."""
    plain = with_detections(docs, F.col("text"), rules, "__content", "__detections")
    return plain.withColumn("__fell_back", F.lit(False))


def _by_leaves(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same through the leaves of structured documents."""
    docs = docs.withColumn("__tree", F.when(F.col("__kind").isNotNull(), F.col("text")))
    docs = pin(docs, "text", "__kind", "__tree", "error", "message").withColumn(
        "__parsed", parse_leaves(F.col("__kind"), F.col("__tree"))
    )
    parsed = F.col("__parsed").isNotNull()
    worked = with_leaf_detections(
        docs,
        F.coalesce(F.col("__parsed"), F.array(F.col("text"))),
        rules,
        "__leaves_out",
        "__detections",
    ).withColumn(
        "__rendered",
        render_leaves(
            F.when(parsed, F.col("__kind")),
            F.when(parsed, F.col("__tree")),
            F.when(parsed, F.col("__leaves_out")),
        ),
    )
    content = F.when(parsed, F.col("__rendered")).otherwise(
        F.get(F.col("__leaves_out"), F.lit(0))
    )
    return worked.withColumn("__content", content).withColumn(
        "__fell_back", F.col("__kind").isNotNull() & ~parsed
    )


def _by_json_tokens(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same for JSON texts, scanned and written in the JVM."""
    scanned = pin(pin(docs, "text", "error", "message").withColumn("__scan", F.expr(json_text.scan("text"))), "__scan")
    parsed = F.coalesce(F.col("__scan.ok"), F.lit(False))
    worked = with_leaf_detections(
        scanned,
        F.when(parsed, F.expr(json_text.values("__scan"))).otherwise(F.array(F.col("text"))),
        rules,
        "__leaves_out",
        "__detections",
    )
    content = F.when(parsed, F.expr(json_text.render("__scan", "__leaves_out"))).otherwise(
        F.get(F.col("__leaves_out"), F.lit(0))
    )
    return worked.withColumn("__content", content).withColumn("__fell_back", F.col("__kind").isNotNull() & ~parsed)


def sanitize_structured(
    df: DataFrame,
    text_col: str,
    content_type: str | Column,
    mode: str | None = None,
    config: Settings = None,
    key: str = "path",
) -> DataFrame:
    """Redact JSON, YAML, XML or CSV documents held in a text column.

    Given the type ``"json"``, and no column of types, all work is done in the JVM: numbers stay as
    they are written and repeated keys stay both.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    kind = F.lit(content_type) if isinstance(content_type, str) else content_type
    null = F.lit(None).cast("string")
    docs = df.select(
        F.col(key).alias("path"),
        F.lit("").alias("file_name"),
        kind.alias("content_type"),
        F.col(text_col).alias("text"),
        F.expr(empty_array("string")).alias("extract_warnings"),
        null.alias("error"),
        null.alias("message"),
    )
    structured = content_type if isinstance(content_type, str) and content_type == "json" else True
    return redact_documents(docs, cfg, structured).withColumnRenamed("path", key)


_READERS = {"json": F.from_json, "xml": F.from_xml, "csv": F.from_csv}
_WRITERS = {"json": F.to_json, "xml": F.to_xml, "csv": F.to_csv}
_CORRUPT = "__corrupt"


#: The name of the first element.
_ROOT = r"(?s)^\s*(?:<[?!][^>]*>\s*)*<([^\s/>]+)"
#: Things that hold values: keys whose value is not null, and elements and attributes.
_HOLDERS = {"json": r'"(?:[^"\\]|\\.)*+"\s*:(?!\s*null\b)', "xml": r"<[^\s/!?>]+|[\s][\w:.-]+\s*=\s*[\"']"}


def _holds_more(text: Column, fields: Column, content_type: str) -> Column:
    """Whether a text holds more values than what was read from it with the schema."""
    if content_type not in _HOLDERS:
        return F.lit(False)  # rows of CSV that do not fit are corrupt records
    written = F.to_json(fields) if content_type == "json" else F.to_xml(fields, {"rowTag": "ROW"})
    count = lambda c: F.regexp_count(c, F.lit(_HOLDERS[content_type]))
    return F.coalesce(count(text) > count(written), F.lit(False))


def sanitize_declared(
    df: DataFrame,
    text_col: str,
    schema: StructType,
    content_type: str,
    mode: str | None = None,
    config: Settings = None,
) -> DataFrame:
    """Redact JSON, XML or single-row CSV texts of a declared schema, in the JVM.

    Fields are visited in the order of ``schema``; those not declared as strings stay
    as they are. A text that does not fit the schema, or that holds anything the
    schema does not name, is redacted as plain text, with a warning, so that nothing
    of it is lost. XML keeps its root tag. The text column is replaced
    by ``content``, ``warnings``, ``detections``, ``detection_count``,
    ``categories`` and ``error``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    with_corrupt = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    reader = _READERS[content_type]
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_corrupt)
    tree = reader(F.col(text_col), declared, options)
    others = other_columns(df, text_col)
    parsed = pin(df.withColumn("__parsed", tree), "__parsed")
    fields = F.struct(*[F.col(f"__parsed.`{f.name}`") for f in schema])
    bad = F.col(text_col).isNotNull() & (
        F.col("__parsed").isNull()
        | F.col(f"__parsed.{_CORRUPT}").isNotNull()
        | _holds_more(F.col(text_col), fields, content_type)
    )
    both = F.struct(
        F.when(~bad, fields).alias("tree"),
        F.when(bad, F.col(text_col)).alias("plain"),
    )
    root = F.regexp_extract(F.col(text_col), _ROOT, 1) if content_type == "xml" else F.lit("")
    done = sanitize_nested(
        parsed.select(*others, both.alias("__doc"), root.alias("__root")), "__doc", mode, config
    )
    # null fields are kept; to_csv always writes them
    keep_nulls = {"json": {"ignoreNullFields": "false"}, "xml": {"rowTag": "ROW"}, "csv": {}}
    written = _WRITERS[content_type](F.col("__doc.tree"), keep_nulls[content_type])
    if content_type == "xml":
        inner = F.regexp_replace(written, r"(?s)^<ROW>(.*)</ROW>$|^<ROW/>$", "$1")
        written = F.concat(F.lit("<"), "__root", F.lit(">"), inner, F.lit("</"), "__root", F.lit(">"))
    fell_back = F.col("__doc.plain").isNotNull()
    return done.select(
        *others,
        F.when(F.col("error").isNotNull(), F.lit(""))
        .when(fell_back, F.col("__doc.plain"))
        .otherwise(written)
        .alias("content"),
        F.array_compact(
            F.array(F.when(fell_back, F.lit(FALLBACK_WARNINGS[content_type])))
        ).alias("warnings"),
        "detections",
        "detection_count",
        "categories",
        "error",
    )


def leaf_table(docs: DataFrame, text_col: str, content_type: Column) -> DataFrame:
    """One row per string leaf: other columns, leaf_ord, path, kind, value."""
    others = other_columns(docs, text_col)
    return (
        docs.withColumn("__leaf", leaf_rows(content_type, F.col(text_col)))
        .select(*others, F.posexplode("__leaf").alias("leaf_ord", "leaf"))
        .select(*others, "leaf_ord", "leaf.path", "leaf.kind", "leaf.value")
    )


# Pieces joined in one step; a document is put together from runs of this many.
RUN_PIECES = 256


def _slot_text(slot: str, text: str) -> str:
    """A redacted leaf as it is written in its place of a document."""

    def swapped(pairs: tuple[tuple[str, str], ...]) -> str:
        out = text
        for old, new in pairs:
            out = f"replace({out}, {literal(old)}, {literal(new)})"
        return out

    cdata = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    attribute = (*cdata, ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;"))
    quoted = f"""concat('"', replace({text}, '"', '""'), '"')"""
    needs = f"({text} RLIKE {literal('[\",\r\n]')} OR ({slot} = 'only' AND {text} = ''))"
    return f"""CASE {slot} WHEN 'json' THEN {json_text.escaped(text)} WHEN 'xml' THEN {swapped(cdata)}
        WHEN 'attribute' THEN {swapped(attribute)} WHEN 'csv' THEN if({needs}, {quoted}, {text})
        WHEN 'only' THEN if({needs}, {quoted}, {text}) WHEN 'plain' THEN {text} ELSE '' END"""


def document_pieces(docs: DataFrame, text_col: str, content_type: Column) -> DataFrame:
    """One row per leaf, in order, and one for the end: other columns, ``piece_ord, leaf_ord,
    before, slot, leaf_path, leaf_kind, leaf_value``. ``before`` is what the printed document has in
    front of the leaf, so the rows are leaf table and template in one. A document that does not parse, and a
    YAML document, is a single ``plain`` leaf; a null one too."""
    others = other_columns(docs, text_col)
    cut = pin(docs.withColumn("__pieces", leaf_pieces(content_type, F.col(text_col))), "__pieces")
    plain = "array(named_struct('place', 0, 'before', '', 'slot', 'plain', 'path', string(null), 'kind', string(null), 'value', `{}`))"
    pieces = F.coalesce("__pieces", F.expr(plain.format(text_col.replace("`", "``"))))
    return cut.select(*others, F.posexplode(pieces).alias("piece_ord", "piece")).select(
        *others, "piece_ord", F.col("piece.place").alias("leaf_ord"), "piece.before", "piece.slot",
        *[F.col(f"piece.{name}").alias(f"leaf_{name}") for name in ("path", "kind", "value")],
    )


def rebuild_documents(pieces: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys, content, detection_count, fell_back, error``: documents out of their redacted pieces.

    Pieces are joined in runs, and runs to the document; null keys are keys like others. A
    document of which a piece has an error is empty.
    """
    shown = F.concat("before", F.expr(_slot_text("slot", f"coalesce(`{content}`, '')")))
    rows = pieces.select(
        *keys, "piece_ord", shown.alias("shown"), "detection_count", "error", (F.col("slot") == "plain").alias("plain")
    )
    counted = (F.sum("detection_count").alias("detection_count"), F.max("error").alias("error"), F.max("plain").alias("plain"))
    runs = rows.groupBy(*keys, F.expr(f"piece_ord div {RUN_PIECES}").alias("run")).agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(piece_ord, shown))), x -> x.shown), '')").alias("shown"), *counted
    )
    done = runs.groupBy(*keys).agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(run, shown))), x -> x.shown), '')").alias("shown"), *counted
    )
    return done.select(
        *keys, F.when(F.col("error").isNull(), F.col("shown")).otherwise(F.lit("")).alias("content"),
        F.col("detection_count").cast("long").alias("detection_count"), F.coalesce("plain", F.lit(False)).alias("fell_back"), "error",
    )


def sanitize_leaves(
    docs: DataFrame, text_col: str, content_type: str | Column, keys: list[str], mode: str | None = None, config: Settings = None
) -> DataFrame:
    """Redact structured documents leaf by leaf, over several tasks, and put them together again.

    ``keys`` tell documents apart. For documents of very many leaves: a parse is all that one
    task does for a document, and the result is that of ``sanitize_structured``. An XML element
    whose text is replaced by nothing keeps its end tag.
    """
    kind = F.lit(content_type) if isinstance(content_type, str) else content_type
    named = docs.select(*keys, F.col(text_col).alias("__text"), kind.alias("__type"))
    pieces = document_pieces(named, "__text", F.col("__type"))
    return rebuild_documents(sanitize_sessions(pieces, "leaf_value", keys, "leaf_ord", mode, config), keys)
