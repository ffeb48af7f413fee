"""Versions that come back: a stateful operator that keeps what was sent and tells what changed.

Facts of both versions arrive on one stream, in any order: ``key, side, time, value`` with side ``sent`` or ``returned``.
For each key the state keeps the value sent and its time. When a returned value arrives it is compared with that:
``changed`` or ``unchanged``, told once. A returned value that finds nothing sent waits; a version that is still alone ``patience`` seconds of
event time after its own time expires by timer and is told as ``never_returned`` or ``never_sent``.

State is one small entry a key. Entries are kept by bucket of the key's hash, in Spark's own state store, so a batch exchanges a few messages
with the store for a bucket and not for a key; the checkpoint keeps them, and a restart tells nothing twice. A batch reads and writes the buckets that
its rows fall in, a task holds one of them at a time, and a bucket holds its share (one in ``buckets``) of the keys whose patience has not run out. A bucket's timer
stands at the earliest of its entries. Of values of one side that tie the latest (then the greatest) counts, until the
pair is told; rows that come after that are told as ``again``. Rows with a null key, side or time are left out; null values are
values like any other. An empty stream tells nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TOLD = "key string, outcome string, old string, new string, time timestamp"
#: Times are microseconds, ``due`` (the timer that stands) milliseconds. The arrays go together, an element a key.
STATE = "due long, key array<string>, sent_at array<long>, sent array<string>, returned_at array<long>, returned array<string>, told array<boolean>"
BUCKETS = 1024


class Pairing(StatefulProcessor):
    """The versions of a bucket of keys; a row of output for each outcome."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pairs", STATE)

    def _due(self, held: list) -> int:
        """When a pair that stays as it is expires, in milliseconds."""
        return max(x for x in (held[0], held[2]) if x is not None) // 1000 + self.patience * 1000

    def _load(self) -> tuple[int | None, dict[str, list]]:
        """The timer that stands, and of each key: sent_at, sent, returned_at, returned, told."""
        found = self.state.get()
        return (found[0], {k: list(v) for k, *v in zip(*found[1:], strict=True)}) if found else (None, {})

    def _store(self, due: int | None, pairs: dict[str, list]) -> None:
        """Write the bucket; ``due`` is the timer that still stands."""
        first = min(map(self._due, pairs.values()), default=None)
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if first is not None:
                self.handle.registerTimer(first)
        if pairs:
            self.state.update((first, list(pairs), *map(list, zip(*pairs.values(), strict=True))))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, pairs = self._load()
        out, met = [], set()
        for pdf in rows:
            for k, side, at, value in zip(*(pdf[c].tolist() for c in ("key", "side", "at", "value")), strict=True):
                value = None if value is None or value != value else value
                held = pairs.setdefault(k, [None, None, None, None, False])
                if held[4]:
                    out.append((k, "again", held[1], value, at))
                    continue
                met.add(k)
                i = 0 if side == "sent" else 2
                if held[i] is None or (at, value is not None, value or "") > (held[i], held[i + 1] is not None, held[i + 1] or ""):
                    held[i], held[i + 1] = at, value
        for k in met:
            held = pairs[k]
            if held[0] is not None and held[2] is not None:
                out.append((k, "unchanged" if held[1] == held[3] else "changed", held[1], held[3], held[2]))
                held[4] = True
        if met:
            self._store(due, pairs)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, pairs = self._load()
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        for k, held in list(pairs.items()):
            if self._due(held) < mark:
                if not held[4]:
                    out.append((k, "never_returned" if held[2] is None else "never_sent", held[1], held[3], held[2] if held[0] is None else held[0]))
                del pairs[k]
        self._store(None, pairs)  # the timer that called is gone
        if out:
            yield self._frame(out)

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="int64" if n == "at" else object) for i, n in enumerate(("key", "outcome", "old", "new", "at"))})

    def close(self) -> None:
        pass


def returned(facts: DataFrame, *, patience: int, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Outcomes of a stream of ``key, side, time, value``, as ``key, outcome, old, new, time``; needs the RocksDB state store.

    ``buckets`` stays the same for a checkpoint's whole life.
    """
    key = F.col("key").cast("string")
    known = facts.where("key IS NOT NULL AND time IS NOT NULL AND side IN ('sent', 'returned')")
    known = known.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"), "side", "time", F.unix_micros("time").alias("at"), F.col("value").cast("string").alias("value"))
    told = known.withWatermark("time", delay).groupBy("bucket").transformWithStateInPandas(Pairing(patience), TOLD.replace("time timestamp", "at long"), outputMode="append", timeMode="EventTime")
    return told.select("key", "outcome", "old", "new", F.timestamp_micros("at").alias("time"))
