"""Placeholder sessions over the micro-batches of a stream.

A conversation that arrives piece by piece is numbered as if it were one table: the state of a
session maps the hash of each value to its number, per category, and outlives micro-batches and
restarts. Values themselves are never in the state. Hits are found by the JVM before the rows
are grouped, and texts are put together after it; the stateful step hands out numbers only.

Rows of one session in one micro-batch are numbered in their order, so a stream whose
micro-batches follow that order gives what ``sanitize_sessions`` gives. A row that comes late
keeps the numbers its values have, and new values take the next ones. A task holds the rows of
one session in one micro-batch, which the source's limits bound; the state itself, a map that
may be larger than memory, lies in RocksDB.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hushlake.config import SanitizeConfig
from hushlake.functions.arrays import struct
from hushlake.functions.pin import pin
from hushlake.functions.validators import placeholder_sql
from hushlake.operators.redact import Settings, admitted_text, no_detections
from hushlake.operators.sessions import found_hits
from hushlake.operators.splice import splice
from hushlake.rules import selected_rules

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionNumbers(StatefulProcessor):
    """Gives every hit of a row its number; ``numbers`` is parallel to ``hits``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "category string, value string", "number int")
        self.counts = handle.getMapState("counts", "category string", "number int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = list(rows)
        firsts: dict[tuple[str, str], tuple] = {}
        for row in held:
            for hit in row["hits"]:
                if hit["fixed"] is None:
                    place = (row["__order"] is not None, row["__order"] or 0, hit["start"])
                    value = (hit["category"], hit["value"])
                    firsts[value] = min(place, firsts.get(value, place))
        known: dict[tuple[str, str], int] = {}
        counts: dict[str, int] = {}
        for value in sorted(firsts, key=lambda v: (firsts[v], v[1])):
            category = value[0]
            if self.numbers.containsKey(value):
                known[value] = self.numbers.getValue(value)[0]
                continue
            if category not in counts:
                seen = self.counts.containsKey((category,))
                counts[category] = self.counts.getValue((category,))[0] if seen else 0
            counts[category] += 1
            known[value] = counts[category]
            self.numbers.updateValue(value, (known[value],))
        for category, n in counts.items():
            self.counts.updateValue((category,), (n,))
        for row in held:
            given = [None if h["fixed"] is not None else known[h["category"], h["value"]] for h in row["hits"]]
            yield Row(**{**row.asDict(recursive=False), "numbers": given})

    def close(self) -> None:
        pass


def session_stream(
    stream: DataFrame,
    text_col: str,
    session: list[str],
    order: str,
    keys: list[str] | None = None,
    mode: str | None = None,
    config: Settings = None,
) -> DataFrame:
    """``session``, ``order`` and ``keys`` of every row with its ``content``, ``detections``,
    ``detection_count`` and ``error``, as a stream; other columns are left out.

    ``order`` is a whole number. Null keys and orders are like any other, null texts give null
    contents, and rows over a length limit an empty text and ``error``. The stream must run with
    the RocksDB state store, which ``sanitize_session_stream`` sees to.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    names = list(dict.fromkeys([*session, order, *(keys or [])]))
    too_long = F.coalesce(F.length(text_col) > F.lit(cfg.max_text_length), F.lit(False))
    base = stream.select(
        *names,
        F.sha2(F.to_json(F.struct(*session), {"ignoreNullFields": "false"}), 256).alias("__session"),
        F.col(order).cast("long").alias("__order"),
        admitted_text(F.col(text_col), cfg).alias("__given"),
        F.when(too_long, F.lit("FileTooLargeError")).alias("error"),
    )
    carried = ["__session", "__order", *names, "__given", "error"]
    found = pin(found_hits(base, "__given", carried, selected_rules(cfg)), "hits")
    schema = T.StructType([*found.schema.fields, T.StructField("numbers", T.ArrayType(T.IntegerType()))])
    numbered = found.groupBy("__session").transformWithState(SessionNumbers(), schema, "Append", "None")
    fields = struct(
        leaf_ord="0",
        category="z.hits.category",
        start="z.hits.start",
        end="z.hits.end",
        confidence="z.hits.confidence",
        placeholder=f"coalesce(z.hits.fixed, {placeholder_sql('z.hits.category', 'z.numbers')})",
    )
    detection = F.expr(f"transform(arrays_zip(hits, numbers), z -> {fields})")
    marked = numbered.withColumn("detections", F.coalesce(detection, no_detections()))
    return marked.select(
        *names,
        F.when(F.col("error").isNotNull(), F.lit("")).otherwise(F.expr(splice("__given", "detections"))).alias("content"),
        "detections",
        F.size("detections").alias("detection_count"),
        "error",
    )


def sanitize_session_stream(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    text_col: str,
    session: list[str],
    order: str,
    keys: list[str] | None = None,
    mode: str | None = None,
    config: Settings = None,
    every: str | None = None,
) -> StreamingQuery:
    """Redact a stream of sessions into a parquet sink: all that it holds now, or on ``every``
    interval. The same checkpoint goes on with the numbers of earlier runs.

    Sets the session's state store to RocksDB for this and later queries.
    """
    stream.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    writer = (
        session_stream(stream, text_col, session, order, keys, mode, config)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
