"""Budgets of two sides: a request reserves its worst-case cost, and what it did cost settles the reservation later, late or never.

Whether a request is granted depends on every grant and settlement before it, so a budget is read in order: by time, then number, whatever order
entries arrived in. The batch form streams each budget's sorted entries through one task with a state of open grants, which the cap
on requests bounds; the stream form keeps entries until the watermark has passed them, and the same state by key. Amounts are whole
millionths, so sums are exact.

A grant that is not settled within `patience` is charged in full when that time has passed. Its cost, should it come later, replaces the charge.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Columns of entries: budget, time in microseconds, number, kind (reserve or record), request, amount (worst case or cost; may be null), complete (of a record; null counts as true).
ENTRY = ("at", "number", "kind", "request", "amount", "complete")
_OUT = ["at", "number", "code", "requests", "spent", "reserved", "accounting_complete"]


@dataclass(frozen=True)
class Caps:
    """What a budget allows: requests, cost in millionths, and how long a grant waits, in microseconds."""

    requests: int
    cost: int
    patience: int


class Ledger:
    """State of one budget: open grants (request to amount and time), charges of grants that were not settled in time, and totals."""

    def __init__(self, caps: Caps, text: str | None = None):
        held = json.loads(text) if text else {"requests": 0, "spent": 0, "complete": True, "open": {}, "charged": {}}
        self.caps, self.requests, self.spent, self.complete, self.open, self.charged = caps, held["requests"], held["spent"], held["complete"], held["open"], held["charged"]

    def text(self) -> str:
        return json.dumps({"requests": self.requests, "spent": self.spent, "complete": self.complete, "open": self.open, "charged": self.charged})

    @property
    def reserved(self) -> int:
        return sum(amount for amount, _ in self.open.values())

    def expire(self, now: int) -> None:
        """Grants whose time has passed are charged in full."""
        for request in [r for r, (_, at) in self.open.items() if at + self.caps.patience < now]:
            self.charged[request] = self.open.pop(request)[0]
            self.spent += self.charged[request]

    def reserve(self, at: int, request: str, amount: int | None) -> str:
        if request in self.open or request in self.charged:
            return "duplicate_request"
        if self.requests >= self.caps.requests:
            return "max_requests"
        if not self.complete or not amount:
            return "cost_accounting_incomplete"
        if amount < 0:
            return "invalid_amount"
        if self.spent + self.reserved + amount > self.caps.cost:
            return "max_estimated_cost"
        self.requests += 1
        self.open[request] = (amount, at)
        return "granted"

    def record(self, request: str, cost: int | None, complete: bool) -> str:
        if request not in self.open and request not in self.charged:
            return "no_open_reservation"
        if cost is not None and cost < 0:
            return "invalid_amount"
        late = request in self.charged
        held = self.charged.pop(request) if late else self.open.pop(request)[0]
        self.complete = self.complete and complete and cost is not None and cost <= held
        if cost is None:
            self.spent += held if not late else 0  # what it did cost is not known: the worst case stands
            return "cost_accounting_incomplete"
        self.spent += cost - (held if late else 0)
        if cost > held:
            return "cost_reservation_exceeded"
        return "max_estimated_cost" if self.spent > self.caps.cost else "settled_late" if late else "settled"

    def step(self, entry: dict) -> tuple:
        self.expire(entry["at"])
        amount = None if pd.isna(entry["amount"]) else int(entry["amount"])
        if entry["kind"] == "reserve":
            code = self.reserve(int(entry["at"]), str(entry["request"]), amount)
        elif entry["kind"] == "record":
            complete = entry["complete"]
            code = self.record(str(entry["request"]), amount, True if complete is None or pd.isna(complete) else bool(complete))
        else:
            code = "unknown_entry"
        return entry["at"], entry["number"], code, self.requests, self.spent, self.reserved, self.complete


def settle(entries: DataFrame, budget: str, caps: Caps) -> DataFrame:
    """Every entry's code and the budget's totals after it. Entries of equal time and number are taken in an order of their other columns."""
    ship(entries.sparkSession)
    columns = [budget, *ENTRY]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ledger = (), None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                key = (None if pd.isna(row[budget]) else row[budget],)
                if key != now:
                    now, ledger = key, Ledger(caps)
                out.append((key[0], *ledger.step(row)))
            yield pd.DataFrame(out, columns=[budget, *_OUT]).astype({budget: frame[budget].dtype})

    kind = entries.schema[budget].dataType.simpleString()
    met = entries.select(*columns).repartition(budget).sortWithinPartitions(budget, *ENTRY)
    return met.mapInPandas(run, f"{budget} {kind}, at long, number long, code string, requests long, spent long, reserved long, accounting_complete boolean")


def totals(settled: DataFrame, entries: DataFrame, budget: str) -> DataFrame:
    """Snapshot of every budget after its last entry; counts of codes with map-side combine."""
    last = settled.groupBy(budget).agg(F.max_by(F.struct("requests", "spent", "reserved", "accounting_complete"), F.struct("at", "number")).alias("x"), F.count_if(F.col("code") == "granted").alias("granted"))
    return last.select(budget, "x.*", "granted")


def stream_settle(entries: DataFrame, budget: str, caps: Caps, late: str = "1 hour") -> DataFrame:
    """The same over a stream. `time` is the entries' event time: what is out of order by up to `late` waits for the watermark, then entries are taken in order.

    A timer at each entry's time wakes the budget once the watermark has passed it; entries behind the watermark are dropped, as Spark does.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    ship(entries.sparkSession)

    class Settler(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.ledger = handle.getValueState("ledger", "text string")
            self.waiting = handle.getListState("waiting", "at long, number long, kind string, request string, amount long, complete boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for frame in rows:
                for row in frame.to_dict("records"):
                    kept = [None if pd.isna(row[c]) else row[c] for c in ENTRY]
                    self.waiting.appendValue(tuple(int(v) if c in ("at", "number", "amount") and v is not None else str(v) if c in ("kind", "request") and v is not None else v for c, v in zip(ENTRY, kept, strict=True)))
                    self.handle.registerTimer(int(row["at"]) // 1000 + 1)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
            rows = sorted((dict(zip(ENTRY, row, strict=True)) for row in self.waiting.get()), key=lambda r: tuple((r[c] is not None, r[c]) for c in ENTRY))
            due = [r for r in rows if r["at"] < passed]
            if not due:
                return
            ledger = Ledger(caps, self.ledger.get()[0] if self.ledger.exists() else None)
            out = [(key[0], *ledger.step(r)) for r in due]
            self.ledger.update((ledger.text(),))
            rest = [tuple(r[c] for c in ENTRY) for r in rows if r["at"] >= passed]
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield pd.DataFrame(out, columns=[budget, *_OUT])

        def close(self) -> None:
            pass

    kind = entries.schema[budget].dataType.simpleString()
    schema = f"{budget} {kind}, at long, number long, code string, requests long, spent long, reserved long, accounting_complete boolean"
    marked = entries.withWatermark("time", late)
    return marked.groupBy(budget).transformWithStateInPandas(Settler(), schema, "Append", "eventTime")
