"""Reads of one caller in one project counted in windows that begin with a read: the first is an entry of its own, the window's end gives
how many came after it. As a stream, with its state in the state store and event-time timers, and as a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["principal", "project"]
COUNTED = "principal string, project string, start long, further long"
STATE = "start long, further long, times array<long>, counts array<long>"

Window = tuple[int, int] | None


def advance(window: Window, reads: list[tuple[int, int]], length: int) -> tuple[Window, list[tuple[int, int]]]:
    """The open window (its start, reads after its first) after reads in the order of their time (time, number), and windows that ended."""
    ended = []
    for at, n in reads:
        if window and at < window[0] + length:
            window = window[0], window[1] + n
        else:
            if window and window[1]:
                ended.append(window)
            window = at, n - 1
    return window, ended


def _stateful(length: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, further, times, counts = state.get if state.exists else (None, None, [], [])
        window, waiting = (None if start is None else (start, further)), dict(zip(times, counts))
        for pdf in batches:
            for at, n in zip(pdf["at"], pdf["n"]):
                waiting[int(at)] = waiting.get(int(at), 0) + int(n)
        # Until the watermark has passed a read, an earlier one can still come.
        passed = state.getCurrentWatermarkMs() * 1000
        window, ended = advance(window, sorted(x for x in waiting.items() if x[0] < passed), length)
        left = sorted(x for x in waiting.items() if x[0] >= passed)
        if window and window[0] + length <= passed:
            ended += [window] if window[1] else []
            window = None
        if window or left:
            begin, n = window or (None, None)
            state.update((begin, n, [t for t, _ in left], [c for _, c in left]))
            due = min([t for t, _ in left] + ([window[0] + length] if window else []))
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, *w) for w in ended], columns=["principal", "project", "start", "further"])

    return run


def streamed(reads: DataFrame, seconds: int, late: str) -> DataFrame:
    """Ended windows of a stream of reads (`principal, project, occurred_at`) in append mode, whatever order they come in; those later than
    `late` are left out, as are ones with a null key or time. A window is given once, when the watermark has passed its end, so the last
    windows of a stream stay open. State of a key is its window and the distinct times of reads that the watermark has not passed."""
    rows = reads.where("principal is not null and project is not null and occurred_at is not null").withWatermark("occurred_at", late)
    rows = rows.select(*KEY, "occurred_at", F.unix_micros("occurred_at").alias("at"), F.lit(1).cast("long").alias("n"))
    return rows.groupBy(*KEY).applyInPandasWithState(_stateful(seconds * 1_000_000), COUNTED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counted(reads: DataFrame, seconds: int) -> DataFrame:
    """All windows of a table of reads, the last of each key included, in one pass over sorted partitions that holds one window."""
    length = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window = None, None
        for batch in batches:
            out = []
            for principal, project, at, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != (principal, project):
                    if window and window[1]:
                        out.append((*key, *window))
                    key, window = (principal, project), None
                window, ended = advance(window, [(at, n)], length)
                out += [(*key, *w) for w in ended]
            yield _rows(out)
        if window and window[1]:
            yield _rows([(*key, *window)])

    rows = reads.where("principal is not null and project is not null and occurred_at is not null")
    rows = rows.groupBy(*KEY, F.unix_micros("occurred_at").alias("at")).agg(F.count("*").alias("n"))
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInArrow(run, COUNTED)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names, types = ["principal", "project", "start", "further"], [pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
