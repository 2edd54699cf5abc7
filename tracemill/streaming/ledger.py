"""A budget ledger as a stateful stream: reservations, settlements and late corrections per ledger.

A reservation is taken if what was spent before, what is exposed now and the
new amount stay within the cap. Exposure falls only when the true cost is
known; a charge above its reservation halts the ledger.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

OUTCOMES = "ledger string, request string, event string, amount double, outcome string, exposure double, spent double"
STATE = "spent double, halted boolean, requests string"


class Ledger:
    """State of one ledger and its reaction to events in order; every event is idempotent."""

    def __init__(self, cap: float, spent: float = 0.0, halted: bool = False, requests: dict[str, list] | None = None):
        self.cap, self.spent, self.halted = cap, spent, halted
        #: request -> [status, reserved, charged]; pending and unresolved ones are exposed.
        self.requests = requests or {}

    @property
    def exposure(self) -> float:
        return sum(r[1] for r in self.requests.values() if r[0] in ("pending", "unresolved"))

    def apply(self, request: str, event: str, amount: float | None) -> str:
        held = self.requests.get(request)
        if event == "reserve":
            if held:
                return "repeated"
            if self.halted or amount is None or amount < 0 or self.spent + self.exposure + amount > self.cap + 1e-12:
                return "refused"
            self.requests[request] = ["pending", amount, None]
            return "reserved"
        if held is None:
            return "unknown"
        if event == "settle":
            if held[0] != "pending":
                return "repeated"
            if amount is None:
                held[0] = "unresolved"
                return "unresolved"
            return self._charge(held, amount)
        if event == "reconcile":
            if held[0] == "billed" and held[2] == amount:
                return "repeated"
            if amount is None:
                return "unknown"
            if held[0] == "billed":
                self.spent -= held[2]
            return self._charge(held, amount)
        return "unknown"

    def _charge(self, held: list, amount: float) -> str:
        held[0], held[2] = "billed", amount
        self.spent += amount
        if amount > held[1] + 1e-12:
            self.halted = True
            return "halted"
        return "billed"


def replay(events: Iterable[tuple[str, str, str, float | None]], cap: float) -> list[tuple]:
    """Outcomes of (ledger, request, event, amount) in order."""
    ledgers: dict[str, Ledger] = {}
    out = []
    for name, request, event, amount in events:
        one = ledgers.setdefault(name, Ledger(cap))
        outcome = one.apply(request, event, amount)
        out.append((name, request, event, amount, outcome, round(one.exposure, 9), round(one.spent, 9)))
    return out


def ledger_stream(events: DataFrame, cap: float) -> DataFrame:
    """Outcomes of a stream of ledger, seq, request, event, amount; per ledger events count in the order of seq within a batch."""
    import json

    names = [x.split()[0] for x in OUTCOMES.split(", ")]

    def run(key, batches, state):
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        spent, halted, requests = state.get if state.exists else (0.0, False, "{}")
        one = Ledger(cap, spent, halted, json.loads(requests))
        out = []
        for request, event, amount in zip(rows.request, rows.event, rows.amount):
            value = None if amount is None or amount != amount else float(amount)
            outcome = one.apply(request, event, value)
            out.append((key[0], request, event, value, outcome, round(one.exposure, 9), round(one.spent, 9)))
        state.update((one.spent, one.halted, json.dumps(one.requests)))
        yield pd.DataFrame(out, columns=names)

    return events.groupBy("ledger").applyInPandasWithState(run, OUTCOMES, STATE, "append", "NoTimeout")


class Breaker:
    """Stops after so many failures in a row or in all."""

    def __init__(self, in_a_row: int, in_all: int):
        self.in_a_row, self.in_all, self.row, self.all = in_a_row, in_all, 0, 0

    def observe(self, failed: bool) -> str | None:
        self.row = self.row + 1 if failed else 0
        self.all += failed
        if self.row >= self.in_a_row:
            return "consecutive"
        return "total" if self.all >= self.in_all else None
