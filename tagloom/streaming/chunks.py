"""Documents that arrive in chunks: keyed state holds each one's lexer from chunk to chunk.

Chunks are ``(doc_id, seq, chunk, is_last)``: bytes, cut anywhere, numbered from 0. Their events equal those of the whole
document. Chunks that come ahead of their turn wait in the state. Of a finished document the state keeps a mark, so that a
late copy of one of its chunks begins nothing anew; all goes after ``idle_ms`` without a chunk, if that is set. Time is the
clock's, or the chunks' own (``event_time``): then the state of a document, finished or not, goes when the watermark has
passed its latest chunk by ``idle_ms``, and chunks behind the watermark give nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.udtf import payload_columns, payload_fields
from ..operators.lexer import Lexer
from ..schema import mask_of

DONE = -1  # the number of the next chunk of a document that has ended


class ChunkProcessor(StatefulProcessor):
    """A lexer a document; ``waiting`` maps numbers of chunks that came early to their bytes."""

    def __init__(self, mask: int, key: str, idle_ms: int | None, payload: str = "full", compat: bool = False, event_time: str | None = None):
        self.mask, self.key, self.idle_ms, self.payload, self.compat, self.event_time = mask, key, idle_ms, payload, compat, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lexer = handle.getValueState("lexer", "state binary, next bigint, last bigint")
        self.waiting = handle.getMapState("waiting", "seq bigint", "chunk binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.event_time:
            mark = timerValues.getCurrentWatermarkInMs()
            rows = [part[_millis(part[self.event_time]) > mark] for part in rows]
            rows = [part for part in rows if len(part)]
            if not rows:  # nothing but late chunks
                yield self._frame(key, [])
                return
            self._keep_until(max(int(_millis(part[self.event_time]).max()) for part in rows))
        elif self.idle_ms:
            self._keep_until(timerValues.getCurrentProcessingTimeInMs())
        if self.lexer.exists():
            state, at, last = self.lexer.get()
            if int(at) == DONE:
                for _ in rows:  # copies of chunks that were read
                    pass
                yield self._frame(key, [])
                return
            lexer, at, last = pickle.loads(state), int(at), int(last)
        else:
            lexer, at, last = Lexer(self.mask, self.compat), 0, -1
        for part in rows:
            for seq, chunk, is_last in zip(part["seq"], part["chunk"], part["is_last"]):
                seq = int(seq)
                if seq >= at and not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), (bytes(chunk) if chunk is not None else b"",))
                if is_last:
                    last = seq
        out = []
        while self.waiting.containsKey((at,)):
            out += lexer.write(bytes(self.waiting.getValue((at,))[0]))
            self.waiting.removeKey((at,))
            at += 1
        if last >= 0 and at > last:
            out += lexer.end()
            self.lexer.update((b"", DONE, last))
            self.waiting.clear()
        else:
            self.lexer.update((pickle.dumps(lexer), at, last))
        yield self._frame(key, out)

    def _keep_until(self, latest: int) -> None:
        """The one timer of a document: ``idle_ms`` after its latest chunk."""
        timers = list(self.handle.listTimers())
        due = max([latest + self.idle_ms, *timers]) if self.event_time else latest + self.idle_ms
        for t in timers:
            if t != due:
                self.handle.deleteTimer(t)
        if due not in timers:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.lexer.clear()
        self.waiting.clear()
        yield self._frame(key, [])

    def _frame(self, key, events: list) -> pd.DataFrame:
        frame = pa.Table.from_pydict(payload_columns(events, self.payload)).to_pandas(integer_object_nulls=True)
        frame.insert(0, self.key, [key[0]] * len(events))
        return frame

    def close(self) -> None:
        pass


def _millis(times: pd.Series) -> pd.Series:
    """Milliseconds of timestamps (naive ones are UTC); none for null ones, which are late."""
    stamps = pd.to_datetime(times, utc=True)
    return ((stamps - pd.Timestamp(0, tz="UTC")) // pd.Timedelta(milliseconds=1)).fillna(-1)


def chunked_events(
    chunks: DataFrame, key: str = "doc_id", events=None, idle_ms: int | None = None, payload: str = "full", compat: bool = False, event_time: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Event rows of a stream of chunks (see ``payload_fields``), in append mode. Needs the RocksDB state store.

    With ``event_time``, a timestamp column of the chunks, the watermark is ``delay`` behind the latest and state is kept
    for ``idle_ms`` (0 by default) behind a document's latest chunk, in that time; a lost chunk thus holds up its document
    for that long and no longer. Chunks without a time are late.
    """
    schema = T.StructType([T.StructField(key, chunks.schema[key].dataType), *payload_fields(payload)])
    if event_time:
        idle_ms = idle_ms or 0
        chunks = chunks.withWatermark(event_time, delay)
    slim = chunks.select(key, "seq", "chunk", "is_last", *([event_time] if event_time else []))
    processor = ChunkProcessor(mask_of(events), key, idle_ms, payload, compat, event_time)
    mode = "EventTime" if event_time else "ProcessingTime" if idle_ms else "none"
    return slim.groupBy(key).transformWithStateInPandas(processor, schema, "append", mode)


def cut_documents(df: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """``key, seq, chunk, is_last``: every document cut into chunks of ``size`` bytes, an empty one into one chunk."""
    raw = F.coalesce(F.encode(F.col(content).cast("string"), "UTF-8"), F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / size)).cast("int")
    out = df.select(F.col(key), raw.alias("__raw"), n.alias("__n"))
    out = out.select(key, "__raw", "__n", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("seq"))
    return out.select(key, "seq", F.substring("__raw", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("__n") - 1).alias("is_last"))


def state_size(lexer: Lexer) -> int:
    """Bytes that a document's lexer takes in the state."""
    return len(pickle.dumps(lexer))


__all__ = ["ChunkProcessor", "chunked_events", "cut_documents", "state_size"]
