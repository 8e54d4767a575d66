"""Structured Streaming: files that land in a folder, and messages whose fragments arrive in pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenframe.sources.part10 import decode_files

#: The state store that keyed processors need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landing_zone(spark: SparkSession, path: str, glob: str | None = None, max_files: int = 1000, **options) -> DataFrame:
    """A stream of decoded files below a path, as sources.part10.decode_files gives them."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return decode_files(reader.schema(schema).load(path), "path", "content", **options)


class Reassembler(StatefulProcessor):
    """Keeps the pieces of a message until its last fragment; messages of one key come out in order.

    Fragments of a batch are sorted by seq. A key whose timer runs out gives up its pieces, as a response timeout does.
    """

    def __init__(self, timeout_ms: int | None = None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "data binary")
        self.done = handle.getValueState("done", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return
        if self.timeout_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        pieces = [bytes(p[0]) for p in self.pieces.get()] if self.pieces.exists() else []
        n = self.done.get()[0] if self.done.exists() else 0
        out = []
        for row in pd.concat(frames).sort_values("seq").itertuples(index=False):
            pieces.append(bytes(row.data))
            if row.last:
                out.append({"assoc_id": key[0], "context": key[1], "command": key[2], "message": n, "complete": True, "data": b"".join(pieces)})
                pieces, n = [], n + 1
        if pieces:
            self.pieces.put([(p,) for p in pieces])
            if self.timeout_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        else:
            self.pieces.clear()
        self.done.update((n,))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pieces = [bytes(p[0]) for p in self.pieces.get()] if self.pieces.exists() else []
        self.pieces.clear()
        n = self.done.get()[0] if self.done.exists() else 0
        self.done.update((n + 1,))
        if pieces:
            yield pd.DataFrame([{"assoc_id": key[0], "context": key[1], "command": key[2], "message": n, "complete": False, "data": b"".join(pieces)}])

    def close(self) -> None:
        pass


MESSAGES = "assoc_id string, context int, command boolean, message long, complete boolean, data binary"


def reassemble_stream(fragments: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Messages of a stream of (assoc_id, context, command, seq, last, data); needs STATE_STORE as state store provider."""
    keyed = fragments.groupBy("assoc_id", "context", "command")
    return keyed.transformWithStateInPandas(Reassembler(timeout_ms), MESSAGES, "append", "ProcessingTime" if timeout_ms is not None else "None")


def for_each_message(messages: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that gives each micro-batch of messages and its number to handler; a batch may come again after a failure,
    so handlers should write by its number."""
    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handler).start()
