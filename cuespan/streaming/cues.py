"""Cue clean-up and chunking on a stream (an extension: the source system has no streams).

Both need what comes next: a cue ends where its successor begins, and a chunk is whole when a
segment begins past its window. So a video's state holds its last cue and the segments of
the windows that are still open, no more than a window's length of them; it is the same
whatever micro-batches the cues come in, and so are the rows: those of the batch operators.

A video ends with a row whose ``last`` is true, or, with ``idle``, when nothing has come for so
many seconds (a timer, for queries that go on: it asks for batches without data, so a query
over what is there would not stop); then what is held is handed out and the state is cleared. Cues of a video come in
the order of ``seq`` from batch to batch (inside a batch in any order); one that comes too late,
as its successor has been seen, is left out. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import chunk_id
from ..operators.sequence import LAST_SECONDS

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SEGMENT = "video_id string, seq long, start double, end double, text string"
CHUNK = "video_id string, n long, start_time double, end_time double, text string"


class Cues:
    """The state of one video: ``segments`` come of cues, ``chunks`` of segments."""

    def __init__(self, held: dict | None = None) -> None:
        self.held = held or {"cue": None, "before": "", "open": [], "window": 0, "chunks": 0}

    def segments(self, cues: Iterable[tuple[int, float, str]]) -> Iterator[tuple[int, float, float, str]]:
        for seq, start, text in sorted(cues, key=lambda c: c[0]):
            if self.held["cue"] and seq <= self.held["cue"][0]:
                continue
            yield from self._ended(start)
            self.held["cue"] = [seq, start, text]

    def _ended(self, end: float | None) -> Iterator[tuple[int, float, float, str]]:
        if self.held["cue"]:
            seq, start, text = self.held["cue"]
            if text != self.held["before"]:
                yield seq, start, start + LAST_SECONDS if end is None else end, text
            self.held["before"] = text

    def last_segment(self) -> Iterator[tuple[int, float, float, str]]:
        yield from self._ended(None)
        self.held["cue"] = None

    def chunks(self, segments: Iterable[tuple[int, float, float, str]], window: float, stride: float, last: bool = False) -> Iterator[tuple[int, float, float, str]]:
        held = self.held
        for seq, start, end, text in segments:
            yield from self._closed(lambda at, start=start: at + window <= start, window, stride)
            held["open"].append([seq, start, text])
            held["end"] = end
        if last:
            yield from self._closed(lambda at: at < held.get("end", 0.0), window, stride)

    def _closed(self, past, window: float, stride: float) -> Iterator[tuple[int, float, float, str]]:
        held = self.held
        while held["open"] and past(held["window"] * stride):
            at = held["window"] * stride
            texts = [t for _, s, t in held["open"] if at <= s < at + window]
            if texts:
                yield held["chunks"], at, at + window, " ".join(t for t in texts if t is not None)
                held["chunks"] += 1
            held["window"] += 1
            held["open"] = [x for x in held["open"] if x[1] >= held["window"] * stride]
        while not held["open"] and past(held["window"] * stride) and held["cue"]:  # a silence: nothing to hand out
            held["window"] += 1


class _Processor(StatefulProcessor):
    def __init__(self, shape: str, window: float, stride: float, idle: float | None) -> None:
        self.shape, self.window, self.stride, self.idle = shape, window, stride, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("video", "held string")

    def _rows(self, video: str, cues: Cues, some: Iterable, last: bool) -> pd.DataFrame:
        segments = list(cues.segments(some))
        if last:
            segments += cues.last_segment()
        if self.shape == "segments":
            return pd.DataFrame([(video, *s) for s in segments], columns=["video_id", "seq", "start", "end", "text"])
        chunks = cues.chunks(segments, self.window, self.stride, last)
        return pd.DataFrame([(video, *c) for c in chunks], columns=["video_id", "n", "start_time", "end_time", "text"])

    def _cues(self) -> Cues:
        return Cues(json.loads(self.state.get()[0]) if self.state.exists() else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        last = bool(batch["last"].fillna(False).any())
        batch = batch[batch["seq"].notna()]
        cues = self._cues()
        some = [(int(s), float(t), x) for s, t, x in zip(batch["seq"], batch["start"], batch["text"], strict=True)]
        yield self._rows(key[0], cues, some, last)
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if last:
            self.state.clear()
            return
        self.state.update((json.dumps(cues.held),))
        if self.idle is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._rows(key[0], self._cues(), [], True)
        self.state.clear()

    def close(self) -> None:
        pass


def _transformed(cues: DataFrame, shape: str, schema: str, window: float, stride: float, idle: float | None) -> DataFrame:
    rows = cues.select("video_id", "seq", "start", "text", "last")
    return rows.groupBy("video_id").transformWithStateInPandas(_Processor(shape, window, stride, idle), schema, "Append", "None" if idle is None else "ProcessingTime")


def segment_stream(cues: DataFrame, idle: float | None = None) -> DataFrame:
    """Segments, as ``sequence.segments_of`` makes them, of a stream of (video_id, seq, start,
    text, last); a row without ``seq`` is an end mark only."""
    return _transformed(cues, "segments", SEGMENT, 0.0, 1.0, idle)


def chunk_stream(cues: DataFrame, window: float = 45.0, stride: float = 35.0, idle: float | None = None) -> DataFrame:
    """Chunks, as ``sequence.sliding_chunks`` makes them of these segments, each as soon as its
    window is past."""
    out = _transformed(cues, "chunks", CHUNK, window, stride, idle)
    return out.select(chunk_id(F.col("video_id"), F.col("n")).alias("chunk_id"), "video_id", "start_time", "end_time", "text")
