"""Structured Streaming: the temporal history and the run repair, a video at a time as frames arrive.

A video's frames must arrive in order across batches; within a batch they are sorted.  What is kept
is the last frames (history), or the frame before the open run, its bad frames and the cursor
(repair), so state doesn't grow with the video but with the longest run.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _sorted(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    rows = [(int(r.fn), r.value, int(r.n_frames), bool(r.marked)) for b in batches for r in b.itertuples()]
    return sorted(rows, key=lambda r: r[0])


def history_step(held: list, fn: int, value, depth: int = 4) -> tuple[list, list]:
    """(what to hold, newest first; the row's history): before the first frame it repeats."""
    held = ([value] + (held or [value] * (depth - 1)))[:depth]
    return held, held


def history(frames: DataFrame, depth: int = 4) -> DataFrame:
    """A stream of (video_id, fn, value int, n_frames, marked) -> video_id, fn, h0..h3."""

    def step(key, batches, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else []
        out = []
        for fn, value, _, _ in _sorted(batches):
            held, row = history_step(held, fn, int(value), depth)
            out.append((key[0], fn, *row))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["video_id", "fn", *(f"h{i}" for i in range(depth))])

    columns = ", ".join(f"h{i} int" for i in range(depth))
    return frames.groupBy("video_id").applyInPandasWithState(step, f"video_id string, fn bigint, {columns}", "held string", "append", GroupStateTimeout.NoTimeout)


class Repair:
    """The repair of one video, frame by frame; values are ints."""

    def __init__(self, state: dict | None = None):
        s = state or {}
        self.out, self.before, self.run, self.ended = s.get("out", 0), s.get("before"), s.get("run", []), s.get("ended", False)

    def state(self) -> dict:
        return {"out": self.out, "before": self.before, "run": self.run, "ended": self.ended}

    def _emit(self, value, kind: str) -> tuple:
        row = (self.out, value, kind)
        self.out += 1
        return row

    def push(self, fn: int, value: int, n_frames: int, marked: bool) -> list[tuple]:
        """Rows (out_fn, value, kind) that this frame makes certain."""
        rows = []
        if self.ended:  # the frame b + 1 has come; this is b + 2, taken even if it is marked
            prev = self.before if self.before is not None else value
            n, div = len(self.run) + 1, len(self.run) + 2
            for i in range(n):
                a = i / div
                rows.append(self._emit(int(max(0.0, min(255.0, prev * (1 - a) + value * a))), "blend"))
            self.before = self.run[0]
            self.run, self.ended = [], False
            return rows
        if marked:
            self.run.append(value)
            if fn == n_frames - 1:
                rows += self._hold()
            return rows
        if self.run:
            if fn == n_frames - 1:
                return self._hold() + [self._emit(value, "copy")]
            self.ended = True
            return rows
        self.before = value
        return [self._emit(value, "copy")]

    def _hold(self) -> list[tuple]:
        rows = [self._emit(self.before if self.before is not None else v, "hold") for v in self.run]
        self.run = []
        return rows


def repair(frames: DataFrame) -> DataFrame:
    """A stream of (video_id, fn, value int, n_frames, marked) -> video_id, out_fn, value, kind."""

    def step(key, batches, state: GroupState):
        r = Repair(json.loads(state.get[0]) if state.exists else None)
        out = [(key[0], *row) for fn, value, n, marked in _sorted(batches) for row in r.push(fn, int(value), n, marked)]
        state.update((json.dumps(r.state()),))
        yield pd.DataFrame(out, columns=["video_id", "out_fn", "value", "kind"])

    return frames.groupBy("video_id").applyInPandasWithState(step, "video_id string, out_fn bigint, value int, kind string", "held string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
