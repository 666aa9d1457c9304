"""Keyed streams judged in event time: rows wait until their order is certain, and state ends.

The largest event time seen, less `delay`, is the stream's clock. Rows wait in the state of their key until the clock reaches
them, then they are folded in order, whatever order they came in. Rows behind the clock are given out as late and change
nothing. Spark's own watermark stands `keep` behind: nothing older can come, so what a key holds ends once the clock has
passed its last row by that time, and rows that are older still are dropped by Spark.

The work of a key and batch is one read and one write of its waiting rows; a key's state is its rows of the last `delay` and
one value. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """columns: what is kept of a row beside its time; order: those that tell rows of one time apart; state: the value's type;
    step(state, at, row) and idle(state, clock) give (state, rows of the output); wake(state): when idle is due, or None."""

    columns: str
    state: str
    output: str
    step: Callable
    order: tuple[str, ...] = ()
    idle: Callable = lambda state, clock: (state, [])
    wake: Callable = lambda state: None


class Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, keys: list[str], delay_ms: int, keep_ms: int):
        self.fold, self.keys, self.delay, self.keep = fold, keys, delay_ms, keep_ms
        self.names = [c.split()[0] for c in fold.columns.split(",")]
        self.out = [*keys, "late", "at_ms", *(c.split()[0] for c in fold.output.split(","))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at_ms bigint, {self.fold.columns}")
        self.value = handle.getValueState("value", f"newest bigint, {self.fold.state}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, out, new = self._clock(timerValues), [], []
        for f in rows:
            for r in f[["at_ms", *self.names]].itertuples(index=False, name=None):
                r = tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r)
                if r[0] < clock:
                    out.append((*key, True, r[0], *[None] * (len(self.out) - len(key) - 2)))
                else:
                    new.append(r)
        if new:
            self.waiting.appendList(new)
            self._call(min(r[0] for r in new))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = self._clock(timerValues)
        held = [tuple(r) for r in self.waiting.get()]
        newest, *state = self.value.get() if self.value.exists() else (None, *[None] * (self.fold.state.count(",") + 1))
        place = [1 + self.names.index(c) for c in self.fold.order]
        due = sorted((r for r in held if r[0] <= clock), key=lambda r: (r[0], *((r[i] is not None, r[i]) for i in place)))
        rest, out = [r for r in held if r[0] > clock], []
        for r in due:
            state, made = self.fold.step(tuple(state), r[0], dict(zip(self.names, r[1:], strict=True)))
            newest = r[0]
            out += [(*key, False, *x) for x in made]
        state, made = self.fold.idle(tuple(state), clock)
        out += [(*key, False, *x) for x in made]
        if rest:
            self.waiting.put(rest)
        elif held:
            self.waiting.clear()
        wake = self.fold.wake(tuple(state))
        if not rest and wake is None and newest is not None and clock > newest + self.keep:
            self.value.clear()
        elif newest is not None:
            self.value.update((newest, *state))
            self._call(min([*(r[0] for r in rest), *([wake] if wake is not None else []), *([] if rest else [newest + self.keep + 1])]))
        elif rest:
            self._call(min(r[0] for r in rest))
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _clock(self, timer_values) -> int:
        mark = timer_values.getCurrentWatermarkInMs()
        return mark + self.keep - self.delay if mark > 0 else 0

    def _call(self, at: int) -> None:
        """Wake up once the clock has reached `at`: Spark's watermark is then keep - delay behind it."""
        self.handle.registerTimer(max(1, at - self.keep + self.delay))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.out).astype(object)


def ordered(stream: DataFrame, keys: list[str], ts: str, fold: Fold, delay: int, keep: int) -> DataFrame:
    """(keys, late, at, output columns): the fold's output in event time, and late rows with nulls. delay, keep: seconds."""
    if keep < delay:
        raise ValueError("keep is at least delay")
    marked = stream.withWatermark(ts, f"{keep} seconds").withColumn("at_ms", F.unix_millis(ts))
    types = dict(stream.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "late boolean", "at_ms bigint", fold.output])
    out = marked.groupBy(*keys).transformWithStateInPandas(Ordered(fold, keys, 1000 * delay, 1000 * keep), schema, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms")
