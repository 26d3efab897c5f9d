"""A budget guard over a stream of calls: state for each month, reserved before a call is let through."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Guard(StatefulProcessor):
    """A month's calls so far, and those of each of its runs; never more entries than the month's ceiling."""

    def __init__(self, columns: list[str], monthly: int, run_calls: int):
        self.columns, self.monthly, self.run_calls = columns, monthly, run_calls

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.month = handle.getValueState("month", "calls bigint")
        self.runs = handle.getMapState("runs", "run string", "calls bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        calls, before = int(self.month.get()[0]) if self.month.exists() else 0, {}
        reserved, allowed = {}, []
        for run, logged in zip(batch["run"], batch["logged"]):
            if run not in reserved:
                reserved[run] = before[run] = int(self.runs.getValue((run,))[0]) if self.runs.containsKey((run,)) else 0
            ok = reserved[run] < self.run_calls and logged + calls < self.monthly
            calls, reserved[run] = calls + ok, reserved[run] + ok
            allowed.append(ok)
        self.month.update((calls,))
        for run, n in reserved.items():
            if n > before[run]:
                self.runs.updateValue((run,), (n,))
        yield batch.assign(allowed=allowed)[[*self.columns, "allowed"]]

    def close(self) -> None:
        pass


def guarded(calls: DataFrame, monthly: int, run_ceiling: float, unit: float) -> DataFrame:
    """A stream of calls (month, run, seq, logged, ...) with ``allowed``, in the order of seq within a batch.

    ``logged`` is how many calls of the month a ledger had before the stream began. State is kept in the checkpoint, so a
    restarted stream goes on with what is reserved; a batch that is run again starts from the state before it. A batch's
    calls of one month are one task's: each verdict depends on those before it.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema]
    guard = _Guard(calls.columns, monthly, int((run_ceiling + 1e-9) // unit))
    return calls.groupBy("month").transformWithStateInPandas(guard, ", ".join([*fields, "allowed boolean"]), "Append", "None")
