"""Running persistence over a stream whose days arrive out of order, late or not at all.

State per series: the days that wait for earlier ones, and the run, closed day and newest day so far. A
day is closed once a day ``delay_days`` newer has come; closed days leave in order. A series that has been
idle for ``idle_seconds`` closes what it holds by a timer. Rows that come for a closed day, twice for
one day, or without a day are not dropped in silence: they leave as rows of an own kind.
"""

import datetime as dt

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

OUTPUT = "series string, date date, frac_mhw double, is_mhw boolean, kind string"
#: transformWithState keeps its state in this store; set it before the stream starts.
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY, LATE, REPEATED, UNDATED = "day", "late", "repeated", "undated"


def _closed_days(waiting, run, until, level, days, out):
    """Days up to ``until``, all of them for None, in order; returns (days left, run, last closed day or None)."""
    closed = None
    for date, share in sorted(waiting.items()):
        if until is not None and date > until:
            break
        run = run + 1 if share is not None and share > level else 0
        out.append((date, share, run >= days, DAY))
        closed = date
    return {d: x for d, x in waiting.items() if closed is None or d > closed}, run, closed


def _taken(batches, waiting, closed, out):
    """Add arriving rows to the waiting days; those that have no place leave as rows of their kind."""
    for batch in batches:
        for date, share in zip(batch["date"], batch["frac_mhw"]):
            share = None if pd.isna(share) else float(share)
            if pd.isna(date):
                out.append((None, share, None, UNDATED))
            elif closed is not None and date <= closed:
                out.append((date, share, None, LATE))
            elif date in waiting:
                # of rows of one day the least share counts, whatever their order in the batch
                low, high = sorted((waiting[date], share), key=lambda s: (s is None, s or 0.0))
                waiting[date] = low
                out.append((date, high, None, REPEATED))
            else:
                waiting[date] = share


class OrderedPersistence(StatefulProcessor):
    """List state of the waiting days, value state of what is reached, and a timer per idle series."""

    def __init__(self, level, days, delay_days, idle_seconds):
        self.level, self.days, self.delay = level, days, dt.timedelta(days=delay_days)
        self.idle = None if idle_seconds is None else max(1, int(idle_seconds * 1000))

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "date date, frac_mhw double")
        self.reached = handle.getValueState("reached", "run int, closed date, newest date")

    def close(self):
        pass

    def _pass(self, key, batches, everything):
        run, closed, newest = self.reached.get() if self.reached.exists() else (0, None, None)
        waiting, out = (dict(self.waiting.get()) if self.waiting.exists() else {}), []
        _taken(batches, waiting, closed, out)
        newest = max([*waiting, *([newest] if newest else [])], default=None)
        until = None if everything or newest is None else newest - self.delay
        left, run, last = _closed_days(waiting, run, until, self.level, self.days, out)
        if left:
            self.waiting.put(list(left.items()))
        else:
            self.waiting.clear()
        self.reached.update((run, last or closed, newest))
        table = pd.DataFrame(out, columns=["date", "frac_mhw", "is_mhw", "kind"])
        table.insert(0, "series", key[0])
        return bool(left), table.astype({"frac_mhw": "float64", "is_mhw": "object"})

    def handleInputRows(self, key, rows, timerValues):
        left, table = self._pass(key, rows, False)
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if left:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if len(table):
            yield table

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, table = self._pass(key, (), True)
        if len(table):
            yield table


def with_ordered_persistence(stream, level=0.05, days=5, delay_days=5, idle_seconds=None):
    """``stream`` is (series, date, frac_mhw), days in any order.

    Rows of kind ``day`` are in order per series, with is_mhw; the other kinds have none. The batches of
    a stream decide what is late, so a restart from the checkpoint gives the same rows. The session's state store
    must be the one in STORE. With timers, Spark plans batches without data for ever: run such a stream on an
    interval, or switch spark.sql.streaming.noDataMicroBatches.enabled off to let an availableNow run end.
    """
    processor = OrderedPersistence(level, days, delay_days, idle_seconds)
    timers = "None" if idle_seconds is None else "ProcessingTime"
    return stream.groupBy("series").transformWithStateInPandas(processor, OUTPUT, "append", timers)
