"""Running persistence over a stream of daily rows, with state per series."""

import pandas as pd

OUTPUT = "series string, date date, frac_mhw double, is_mhw boolean"
STATE = "run int, last_date date"


def persistence_updater(level=0.05, days=5):
    """Per series, the length of the current run above ``level``.

    A date is late, and dropped, if it is not after the last one of the micro-batches before. A series'
    rows of one micro-batch come in pieces of any size and order; they are put in order as a whole, which
    one row a day keeps small.
    """

    def update(key, batches, state):
        run, last = state.get if state.exists else (0, None)
        pdf = pd.concat(list(batches)).sort_values("date", kind="stable")
        if last is not None:
            pdf = pdf[pdf["date"] > last]
        flags = []
        for share in pdf["frac_mhw"]:
            run = run + 1 if share is not None and share > level else 0
            flags.append(run >= days)
        if len(pdf):
            last = pdf["date"].iloc[-1]
            yield pd.DataFrame({"series": key[0], "date": pdf["date"], "frac_mhw": pdf["frac_mhw"], "is_mhw": flags})
        if last is not None:
            state.update((run, last))

    return update


def with_running_persistence(stream, level=0.05, days=5):
    """``stream`` is (series, date, frac_mhw) in date order across micro-batches."""
    return stream.groupBy("series").applyInPandasWithState(
        persistence_updater(level, days), OUTPUT, STATE, "append", "NoTimeout"
    )
