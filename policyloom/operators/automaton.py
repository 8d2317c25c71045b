"""Event logs under a table-driven state machine: every event's state before it, what was counted so far, and the code of what is wrong with it.

One table says what each event does in each state. The batch form reads a log in blocks: an event is a function from the state before to the
state after and an amount, such functions compose, so blocks are folded side by side, then blocks of blocks, and the states come down
again. A log that holds a third of all rows is thus read by many tasks. The stream keeps the same table's state by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .ranges import numbered

BLOCK = 128
_MOVE = "array<struct<to: int, add: bigint>>"

#: Events of a generation log, their fields besides sequence, event and code, and their codes.
FIELDS = {
    "initialize": (),
    "resume": ("completed_count",),
    "provider_stop": ("batch_count",),
    "batch_rejected": ("batch_count",),
    "batch_complete": ("batch_count", "accepted_count"),
}
CODES = {
    "initialize": ("fresh",),
    "resume": ("validated",),
    "provider_stop": ("budget_exceeded", "provider_request"),
    "batch_rejected": ("parse_invalid_batch",),
    "batch_complete": ("gated",),
}
COUNTS = ("batch_count", "accepted_count", "completed_count")

#: The machine: state after each event by state before it. An event that a state does not name is refused with REFUSED and moves like OTHERWISE.
STATES = ("new", "open", "stopped")
NEXT = {
    "new": {"initialize": "open"},
    "open": {"resume": "open", "batch_complete": "open", "batch_rejected": "open", "provider_stop": "stopped"},
    "stopped": {"resume": "open"},
}
OTHERWISE = {"new": {"provider_stop": "stopped", None: "open"}, "open": {None: "open"}, "stopped": {None: "stopped"}}
REFUSED = {"new": "must_begin_with_initialize", "open": "initialize_out_of_order", "stopped": "must_follow_stop"}


def moved(state: str, event: str | None) -> str:
    """State after an event; None for a row that is no event."""
    other = OTHERWISE[state]
    return NEXT[state].get(event) or other.get(event, other[None])


def _composed(items: Column) -> Column:
    """One function for an array of functions, applied in order."""
    same = F.array(*[F.struct(F.lit(s).alias("to"), F.lit(0).cast("long").alias("add")) for s in range(len(STATES))]).cast(_MOVE)
    step = lambda acc, x: F.transform(acc, lambda a: F.struct(F.get(x.move, a.to).to.alias("to"), (a.add + F.get(x.move, a.to).add).alias("add"))).cast(_MOVE)
    return F.aggregate(items, same, step)


def _walked(items: Column, state: Column, total: Column) -> Column:
    """State and amount before each item of an array of functions, in order."""
    kind = "struct<to: int, add: bigint, seen: array<struct<to: int, add: bigint>>>"
    begin = F.struct(state.cast("int").alias("to"), total.cast("long").alias("add"), F.array().cast("array<struct<to: int, add: bigint>>").alias("seen"))

    def step(acc, x):
        move = F.get(x.move, acc.to)
        return F.struct(move.to.alias("to"), (acc.add + move.add).alias("add"), F.concat(acc.seen, F.array(F.struct(acc.to.alias("to"), acc.add.alias("add")))).alias("seen")).cast(kind)

    return F.aggregate(items, begin.cast(kind), step).seen


def states_before(rows: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """Adds state (its number) and counted, both as they stand before each row. rows: idx and n as numbered() gives them, and __move, the row's function."""
    kept = [c for c in rows.columns if c not in ("__move", "n", group)]
    items = F.array_sort(F.collect_list(F.struct("idx", F.col("__move").alias("move"), F.struct(*kept).alias("row")))).alias("items")
    block_of = F.expr(f"idx div {block}")
    levels = [stored(rows.groupBy(F.col(group).alias("__g"), block_of.alias("at")).agg(items), "log-blocks")]
    most = -(-(rows.agg(F.max("n")).first()[0] or 0) // block)
    while most > 1:
        one = levels[-1].select("__g", F.col("at").alias("idx"), _composed(F.col("items")).alias("move"))
        levels.append(stored(one.groupBy("__g", block_of.alias("at")).agg(F.array_sort(F.collect_list(F.struct("idx", "move"))).alias("items")), "log-blocks"))
        most = -(-most // block)
    walked = levels[-1].select("__g", "at", "items", _walked(F.col("items"), F.lit(0), F.lit(0)).alias("seen"))
    for level in reversed(levels[:-1]):
        begin = walked.select(F.col("__g").alias("__h"), F.explode(F.arrays_zip(F.col("items.idx").alias("idx"), F.col("seen").alias("seen"))).alias("x"))
        begin = begin.select("__h", F.col("x.idx").alias("__at"), F.col("x.seen.to").alias("__to"), F.col("x.seen.add").alias("__add"))
        met = level.join(begin, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("at") == F.col("__at")))
        walked = met.select("__g", "at", "items", _walked(F.col("items"), F.col("__to"), F.col("__add")).alias("seen"))
    each = walked.select(F.col("__g").alias(group), F.explode(F.arrays_zip(F.col("items.row").alias("row"), F.col("seen").alias("seen"))).alias("x"))
    return each.select(group, "x.row.*", F.col("x.seen.to").alias("state"), F.col("x.seen.add").alias("counted"))


def local_code(count: Column, batch_size: int) -> tuple[Column, Column]:
    """Codes of one row, in two parts: what makes it no event at all, and which of its counts is out of range. Null counts are absent fields."""
    known = F.col("event").isin(*FIELDS)
    fields = F.lit(False)
    for event, names in FIELDS.items():
        shape = F.lit(True)
        for c in COUNTS:
            shape = shape & (F.col(c).isNotNull() if c in names else F.col(c).isNull())
        fields = fields | ((F.col("event") == event) & F.col("code").isin(*CODES[event]) & shape)
    first = F.when(~F.coalesce(known, F.lit(False)), "event_type").when(~F.coalesce(fields & F.coalesce(F.col("sequence") == F.col("place"), F.lit(False)), F.lit(False)), "event_schema")
    counts = (
        F.when(~F.col("batch_count").between(1, batch_size), "batch_count")
        .when(~F.col("completed_count").between(0, count), "completed_count")
        .when(~F.col("accepted_count").between(0, F.col("batch_count")), "accepted_count")
    )
    return first, counts


def _moves(applies: Column) -> Column:
    """The function of a row: where each state goes, and what it adds if the state takes it."""
    out = []
    for state in STATES:
        to = F.lit(STATES.index(moved(state, None)))
        for event in FIELDS:
            to = F.when(applies & (F.col("event") == event), STATES.index(moved(state, event))).otherwise(to)
        adds = F.when(applies & (F.col("event") == "batch_complete"), F.col("accepted_count")) if "batch_complete" in NEXT[state] else F.lit(0)
        out.append(F.struct(to.cast("int").alias("to"), F.coalesce(adds, F.lit(0)).cast("long").alias("add")))
    return F.array(*out).cast(_MOVE)


def _refusal() -> Column:
    """Code of an event that its state does not take."""
    code = F.lit(None).cast("string")
    for number, state in enumerate(STATES):
        code = F.when((F.col("state") == number) & ~F.col("event").isin(*NEXT[state]), REFUSED[state]).otherwise(code)
    return code


def event_automaton(events: DataFrame, run: str, order: list[str], count: Column, batch_size: int = 4) -> DataFrame:
    """Every event of every log with place (from 1), the state before it, what was accepted before it, and its code, null if it is legal.

    events: sequence, event, code and the three counts. A row that is no event, or has a count out of range, moves nothing; a refused event moves as
    OTHERWISE says; a resume whose count was not reached is coded, but resumes. A log's first code is where a reader that stops at
    the first mistake stops.
    """
    rows = numbered(events, run, order).withColumn("place", F.col("idx") + 1)
    first, counts = local_code(count, batch_size)
    rows = rows.withColumns({"__first": first, "__counts": counts})
    applies = F.col("__first").isNull() & F.col("__counts").isNull()
    seen = states_before(rows.withColumn("__move", _moves(applies)), run)
    reached = F.when((F.col("event") == "resume") & (F.col("completed_count") != F.col("counted")), "completed_unreachable")
    code = F.coalesce(F.col("__first"), F.when(F.col("__first").isNull(), _refusal()), F.col("__counts"), reached)
    names = F.element_at(F.array(*map(F.lit, STATES)), F.col("state") + 1)
    return seen.withColumn("fault", code).withColumn("state", names).drop("__first", "__counts", "idx")


def log_totals(checked: DataFrame, run: str) -> DataFrame:
    """Of each log: its rows, the place and code of the first mistake (null: none), and accepted, attempted and rejected up to it."""
    bad = checked.where("fault is not null").groupBy(run).agg(F.min_by("fault", "place").alias("fault"), F.min("place").alias("fault_place"))
    met = checked.drop("fault").join(bad.withColumnRenamed(run, "__r"), F.col(run).eqNullSafe(F.col("__r")), "left")
    good = F.coalesce(F.col("place") < F.col("fault_place"), F.lit(True))
    took = F.when(good & F.col("event").isin("batch_complete", "batch_rejected"), F.col("batch_count")).otherwise(0)
    won = F.when(good & (F.col("event") == "batch_complete"), F.col("accepted_count")).otherwise(0)
    sums = met.groupBy(run).agg(F.count(F.lit(1)).alias("n_events"), F.first("fault").alias("fault"), F.first("fault_place").alias("fault_place"), F.sum(won).alias("accepted"), F.sum(took).alias("attempted"))
    return sums.withColumn("rejected", F.col("attempted") - F.col("accepted"))


# --- the stream ---------------------------------------------------------------------------------------------------


def _plain(row: dict[str, Any], place: int, state: str, counted: int, count: int, batch_size: int) -> tuple[str | None, str, int]:
    """Code of an event, the state after it and what is counted then: one step of the machine, from the same table."""
    event, values = row["event"], {c: row[c] for c in COUNTS}
    fault, applies = None, True
    if event not in FIELDS:
        fault, applies = "event_type", False
    elif row["sequence"] != place or row["code"] not in CODES[event] or any((values[c] is None) == (c in FIELDS[event]) for c in COUNTS):
        fault, applies = "event_schema", False
    else:
        batch, accepted, done = (values[c] for c in COUNTS)
        if event not in NEXT[state]:
            fault = REFUSED[state]
        wrong = "batch_count" if batch is not None and not 1 <= batch <= batch_size else "completed_count" if done is not None and not 0 <= done <= count else "accepted_count" if accepted is not None and not 0 <= accepted <= batch else None
        applies = wrong is None
        fault = fault or wrong
        if fault is None and event == "resume" and done != counted:
            fault = "completed_unreachable"
    adds = values["accepted_count"] if applies and event == "batch_complete" and event in NEXT[state] else 0
    return fault, moved(state, event if applies else None), counted + adds


def stream_automaton(events: DataFrame, run: str, count: int, batch_size: int = 4) -> DataFrame:
    """The same codes over a stream whose events of a run arrive in order: run, place, state, counted, fault. State by run: place, state and count."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Machine(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.now = handle.getValueState("now", "place long, state string, counted long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            place, state, counted = self.now.get() if self.now.exists() else (0, STATES[0], 0)
            for frame in rows:
                out = []
                for row in frame.to_dict("records"):
                    row = {k: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else int(v) if k in (*COUNTS, "sequence") else v for k, v in row.items()}
                    place += 1
                    fault, after, total = _plain(row, place, state, counted, count, batch_size)
                    out.append((key[0], place, state, counted, fault))
                    state, counted = after, total
                yield pd.DataFrame(out, columns=[run, "place", "state", "counted", "fault"])
            self.now.update((place, state, counted))

        def close(self) -> None:
            pass

    kind = events.schema[run].dataType.simpleString()
    return events.groupBy(run).transformWithStateInPandas(Machine(), f"{run} {kind}, place long, state string, counted long, fault string", "Append", "none")
