"""Event logs, budgets, generation with an index and stored runs against plain replays."""

import random

import pytest
from pyspark.sql import functions as F

from policyloom.operators import automaton, settlement
from policyloom.runtime import scratch_path

LOG = "run long, at long, sequence long, event string, code string, batch_count long, accepted_count long, completed_count long"


def random_log(rnd, run, n):
    """A log that is legal until a mistake, which happens now and then."""
    rows, done, stopped = [], 0, False
    for place in range(1, n + 1):
        event = "initialize" if place == 1 else "resume" if stopped else rnd.choice(["batch_complete"] * 6 + ["batch_rejected", "provider_stop", "resume"])
        batch, accepted, completed = None, None, None
        if event not in ("initialize", "resume"):
            batch = rnd.randrange(1, 5)
        if event == "batch_complete":
            accepted = rnd.randrange(batch + 1)
            done += accepted
        if event == "resume":
            completed = done
        stopped = event == "provider_stop"
        row = [run, place * 10, place, event, rnd.choice(automaton.CODES[event]), batch, accepted, completed]
        if rnd.random() < 0.03:
            row[rnd.randrange(2, 8)] = rnd.choice([None, 0, 3, 99])
        rows.append(tuple(None if isinstance(v, int) and k in (3, 4) else v for k, v in enumerate(row)))
    return rows


def replay(rows, count=500):
    out, place, state, counted = [], 0, "new", 0
    for run, _, sequence, event, code, batch, accepted, completed in rows:
        place += 1
        row = {"sequence": sequence, "event": event, "code": code, "batch_count": batch, "accepted_count": accepted, "completed_count": completed}
        fault, after, total = automaton._plain(row, place, state, counted, count, 4)
        out.append((run, place, state, counted, fault))
        state, counted = after, total
    return out


def test_automaton_equals_a_replay_and_its_stream(spark):
    rnd = random.Random(1)
    logs = [random_log(rnd, run, n) for run, n in [(1, 1), (2, 700), (3, 40), (4, 127), (5, 128), (6, 129), (None, 30)]]
    rows = [r for log in logs for r in log]
    frame = spark.createDataFrame(rows, LOG)
    checked = automaton.event_automaton(frame.repartition(3), "run", ["at"], F.lit(500)).cache()
    got = sorted((tuple(r) for r in checked.select("run", "place", "state", "counted", "fault").collect()), key=str)
    expected = sorted((r for log in logs for r in replay(log)), key=str)
    assert got == expected and len({r[4] for r in got}) > 6
    totals = {r.run: r for r in automaton.log_totals(checked, "run").collect()}
    for log in logs:
        seen = replay(log)
        stop = next((k for k, r in enumerate(seen) if r[4]), len(seen))
        attempted = sum(r[5] for r in log[:stop] if r[3] in ("batch_complete", "batch_rejected"))
        accepted = sum(r[6] for r in log[:stop] if r[3] == "batch_complete")
        total = totals[log[0][0]]
        assert (total.fault, total.accepted, total.attempted, total.rejected) == (seen[stop][4] if stop < len(seen) else None, accepted, attempted, attempted - accepted)
    assert automaton.event_automaton(frame.limit(0), "run", ["at"], F.lit(5)).count() == 0
    path, out = scratch_path(spark, "log"), scratch_path(spark, "log-out")
    for k in range(3):  # three files in order: three batches
        frame.where("run is not null").where(F.col("at") % 3 >= 0).where((F.col("at") / 10 > k * 60) & ((F.col("at") / 10 <= (k + 1) * 60) | F.lit(k == 2))).coalesce(1).sortWithinPartitions("run", "at").write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = automaton.stream_automaton(source, "run", 500).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "log-state")).trigger(availableNow=True).start(out)
    stream.awaitTermination()
    streamed = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    assert streamed == [r for r in expected if r[0] is not None]


# --- budgets ------------------------------------------------------------------------------------------------------

ENTRIES = "budget long, at long, number long, kind string, request string, amount long, complete boolean"
CAPS = settlement.Caps(requests=12, cost=60_000, patience=9_000_000)


def entries_of(rnd, budget, n):
    rows, known = [], []
    for k in range(n):
        at = 1_000_000_000 + k * 1_000_000 + rnd.choice([0, 0, 500_000])
        if rnd.random() < 0.5 or not known:
            known.append(f"r{k}")
            rows.append((budget, at, k, "reserve", rnd.choice([f"r{k}", f"r{k}", f"r{k}", rnd.choice(known)]), rnd.choice([None, 0, -3, *[rnd.randrange(1000, 9000)] * 20]), None))
        else:
            rows.append((budget, at, k, rnd.choice(["record"] * 30 + ["other"]), rnd.choice([known[-1], rnd.choice(known), f"r{k + 1}"]), rnd.choice([None, -1, 20_000, *[rnd.randrange(4000)] * 60]), rnd.choice([None, True, True] * 20 + [False])))
    return rows


def settled(rows):
    ledgers, out = {}, []
    for row in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r)):
        ledger = ledgers.setdefault(row[0], settlement.Ledger(CAPS))
        out.append((row[0], *ledger.step(dict(zip(settlement.ENTRY, row[1:], strict=True)))))
    return sorted(out, key=str)


def test_settlement_by_hand():
    ledger = settlement.Ledger(settlement.Caps(requests=3, cost=100, patience=10))
    step = lambda at, kind, request, amount, complete=True: ledger.step({"at": at, "number": 0, "kind": kind, "request": request, "amount": amount, "complete": complete})[2:6]
    assert step(1, "reserve", "a", 60) == ("granted", 1, 0, 60)
    assert step(2, "reserve", "b", 50) == ("max_estimated_cost", 1, 0, 60)
    assert step(3, "record", "a", 20) == ("settled", 1, 20, 0)
    assert step(4, "reserve", "b", 50) == ("granted", 2, 20, 50)
    assert step(15, "reserve", "c", 40) == ("max_estimated_cost", 2, 70, 0)  # b was charged in full
    assert step(16, "record", "b", 10) == ("settled_late", 2, 30, 0)
    assert step(17, "record", "b", 10) == ("no_open_reservation", 2, 30, 0)
    assert step(18, "reserve", "c", 40) == ("granted", 3, 30, 40)
    assert step(19, "reserve", "d", 1) == ("max_requests", 3, 30, 40)
    assert step(20, "record", "c", 41) == ("cost_reservation_exceeded", 3, 71, 0) and not ledger.complete


def test_settlement_equals_a_replay_and_its_stream(spark):
    rnd = random.Random(4)
    rows = [r for budget, n in [(1, 300), (2, 30), (3, 1), (4, 90), (None, 20)] for r in entries_of(rnd, budget, n)]
    frame = spark.createDataFrame(rows, ENTRIES)
    made = settlement.settle(frame.repartition(5), "budget", CAPS)
    expected = settled(rows)
    assert sorted((tuple(r) for r in made.collect()), key=str) == expected and len({r[3] for r in expected}) > 8
    last = {r.budget: (r.requests, r.spent, r.reserved) for r in settlement.totals(made, frame, "budget").collect()}
    assert last == {b: next(r[4:7] for r in reversed(sorted((r for r in expected if r[0] == b), key=lambda r: (r[1], r[2])))) for b in (1, 2, 3, 4, None)}
    assert settlement.settle(frame.limit(0), "budget", CAPS).count() == 0
    path, out = scratch_path(spark, "entries"), scratch_path(spark, "entries-out")
    known = [r for r in rows if r[0] is not None]
    known.sort(key=lambda r: r[1] + rnd.randrange(20_000_000))  # arrivals are up to 20 s out of order
    for part in (known[:150], known[150:300], known[300:], [(9, 10_000_000_000, 0, "reserve", "x", 1, None)], [(9, 10_000_000_001, 1, "reserve", "y", 1, None)]):
        spark.createDataFrame(part, ENTRIES).withColumn("time", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    made = settlement.stream_settle(source, "budget", CAPS, "30 seconds")
    query = made.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "entries-state")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert sorted((tuple(r) for r in spark.read.parquet(out).where("budget <> 9").collect()), key=str) == [r for r in expected if r[0] is not None]


# --- generation and its commit log --------------------------------------------------------------------------------

WORDS = [f"word{k}" for k in range(400)]


def candidate(ordinal, attempt):
    """Texts in groups of equal and near ones; a later attempt has other words."""
    rnd = random.Random(f"{ordinal % 9}-{attempt if ordinal % 4 else 1}")
    words = [rnd.choice(WORDS) for _ in range(60)]
    if ordinal % 5 == 1:
        words[ordinal % 3] = f"changed{ordinal}"  # near, not equal
    return " ".join(words) if ordinal % 11 else "Überlänge ﬁne " * 9  # a ligature


def plain_run(total, families, attempts, requests):
    """One row after the other, by attempt, then ordinal."""
    import unicodedata

    def grams(text):
        tokens = [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in unicodedata.normalize("NFKC", text).casefold()).split()]
        return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}

    won, last, used, batch_now = [], {}, 0, None
    for attempt in range(1, attempts + 1):
        for ordinal in range(1, total + 1):
            if any(o == ordinal for o, *_ in won):
                continue
            if batch_now != (attempt, (ordinal - 1) // 4):
                if used + 2 > requests:
                    return won, last, used
                used, batch_now = used + 2, (attempt, (ordinal - 1) // 4)
            text = candidate(ordinal, attempt)
            key, mine = " ".join(unicodedata.normalize("NFKC", text).casefold().split()), grams(text)
            near = lambda g: bool(g and mine) and len(g & mine) >= 0.85 * len(g | mine)  # noqa: B023, E731
            if (ordinal - 1) // 4 % 7 == 3 and attempt == 1:
                code = "parse_invalid_batch"
            elif ordinal % 10 == 9:
                code = "gate"
            elif any(k == key for _, _, k, _ in won):
                code = "exact_duplicate"
            elif any(families(o) != families(ordinal) and near(g) for o, _, _, g in won):
                code = "near_duplicate"
            else:
                code = "semantic_mismatch" if ordinal % 8 == 5 and attempt == 1 else "accepted"
            last[ordinal] = (attempt, code)
            if code == "accepted":
                won.append((ordinal, attempt, key, mine))
    return won, last, used


def small_run(spark, requests=None):
    from policyloom.operators import query_run
    from policyloom.runtime import ship

    ship(spark)
    total, families = 45, lambda o: f"f{o % 4}" if o % 6 else "f0"
    plan = spark.createDataFrame([(o, families(o), "p") for o in range(1, total + 1)], "ordinal long, family string, policy_id string")
    texts = spark.createDataFrame([(o, a, candidate(o, a)) for o in range(1, total + 1) for a in (1, 2, 3)], "ordinal long, attempt int, query string")

    def provide(rows):
        valid = ~((F.col("batch") % 7 == 3) & (F.col("attempt") == 1))
        return rows.join(texts, ["ordinal", "attempt"]).select("ordinal", "query", F.lit(None).cast("string").alias("response"), valid.alias("valid"))

    gate = lambda rows: F.when(F.col("ordinal") % 10 == 9, "gate").otherwise("accepted")
    review = lambda rows: rows.select("ordinal", F.when((F.col("ordinal") % 8 == 5) & (F.col("attempt") == 1), "semantic_mismatch").alias("verdict"))
    return plan, query_run.Run(provide, gate, review, None, attempts=2, requests=requests, first_range=24), families, total


def outcomes(plan, log, run):
    from policyloom.operators import query_run

    return {r.ordinal: (r.attempts, r.code) for r in query_run.outcome(plan, log, run.attempts).collect() if r.attempts}


def test_a_killed_run_ends_like_an_unbroken_one_and_like_a_replay(spark):
    from policyloom.operators import query_run
    from policyloom.sources.commits import CommitLog

    plan, run, families, total = small_run(spark, requests=38)
    won, last, used = plain_run(total, families, 2, 38)
    assert {c for _, c in last.values()} >= {"accepted", "gate", "exact_duplicate", "near_duplicate"}
    root = scratch_path(spark, "run")
    kills = ["accepted", "events", "manifest", "staged", "commit"]

    class Killed(Exception):
        pass

    done = []
    for point in kills:

        def after(name, point=point):
            if name == point:
                raise Killed(point)

        log = CommitLog(spark, root, query_run.SCHEMAS, after)
        try:
            query_run.run_queries(plan, run, log)
        except Killed:
            done.append(point)
    assert done[:3] == kills[:3]
    log = CommitLog(spark, root, query_run.SCHEMAS)
    status = query_run.run_queries(plan, run, log)
    assert outcomes(plan, log, run) == last and status["requests"] == used and status["accepted"] == len(won) and log.verify() == []
    assert query_run.run_faults(plan, log, run).where("n > 0").count() == 0
    # The same run again finds nothing to do; a changed table is found.
    version = log.latest()
    assert query_run.run_queries(plan, run, log) == status and log.latest() == version
    spark.createDataFrame([(1, 9, "made up")], query_run.SCHEMAS["refused"]).write.mode("append").parquet(f"{root}/v=1/refused")
    assert log.verify() == [(1, "refused")]
    assert {r.check for r in query_run.run_faults(plan, log, run).where("n > 0").collect()} == {"attempts", "event_totals"}


@pytest.mark.parametrize("total", [1, 45, 4097, 51_282, 3_000_000])
def test_steps_do_not_grow_with_the_plan(total):
    from policyloom.operators import query_run

    for attempt, most in ((1, 3), (2, 1)):
        ranges = query_run.steps_of(total, attempt, 4096)
        assert len(ranges) <= most and ranges[0][0] == 0 and ranges[-1][1] >= total and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_exact_fold_equals_python_on_every_code_point(spark):
    import sys
    import unicodedata

    from policyloom.functions import text as X
    from policyloom.runtime import ship

    ship(spark)
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    rows = [(k, "".join(map(chr, points[k : k + 64])) + "aZ") for k in range(0, len(points), 64)]
    got = spark.createDataFrame(rows, "k int, t string").select("t", X.exact_fold(F.col("t")).alias("f")).collect()
    assert all(r.f == unicodedata.normalize("NFKC", r.t).casefold() for r in got) and len(got) == len(rows)
    plan = spark.createDataFrame([("ASCII only",), (None,)], "t string").select(X.exact_fold(F.col("t")).alias("f"))
    assert [r.f for r in plan.collect()] == ["ascii only", None]


# --- running sums, caps, rankings ---------------------------------------------------------------------------------


def test_running_sums_and_caps(spark):
    import os

    from policyloom.operators import capped
    from policyloom.operators.ranges import running_sums

    rnd = random.Random(6)
    rows = [(rnd.choice([None, 1, 1, 1, 1, 2, 3, k % 7]), k, rnd.choice([None, 0, 1, 2, 3]), rnd.randrange(100)) for k in range(600)]
    frame = spark.createDataFrame(rows, "batch long, at long, requests long, cost long").repartition(7)
    got = {(r.batch, r.at): (r.idx, r.n, r.cost_before) for r in running_sums(frame, "batch", ["at"], ["cost"]).collect()}
    caps = {"records": 250, "requests": 60, "cost": 3000}
    decided = capped.capped(frame, "batch", ["at"], caps).cache()
    reasons = {(r.batch, r.at): r.reason for r in decided.collect()}
    whole = []
    for batch in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == batch), key=lambda r: r[1])
        used, cost = 0, 0
        for k, (_, at, requests, amount) in enumerate(mine):
            assert got[batch, at] == (k, len(mine), cost)
            used, cost = used + (requests or 0), cost + amount
            assert reasons[batch, at] == ("max_records" if k >= 250 else "max_requests" if used > 60 else "max_cost" if cost > 3000 else None)
        if not any(reasons[r[0], r[1]] for r in mine):
            whole += mine
    path = scratch_path(spark, "published")
    outcomes = {r.batch: r for r in capped.publish(decided, "batch", path).collect()}
    published = sorted((tuple(r) for r in spark.read.schema(frame.schema).parquet(path).select(*frame.columns).collect()), key=str)
    assert 0 < len(whole) < len(rows) and published == sorted(whole, key=str)
    assert outcomes[1].published is False and outcomes[1].reason and outcomes[1].done < outcomes[1].n_rows
    none = scratch_path(spark, "nothing")
    capped.publish(decided.where("batch = 1"), "batch", none)
    assert not [p for p in os.listdir(os.path.dirname(none.removeprefix("file:"))) if p.startswith(os.path.basename(none))]
    with pytest.raises(ValueError):
        capped.publish(decided, "batch", path)


def test_allocation_of_a_global_cap(spark):
    from policyloom.operators import capped

    counts = spark.createDataFrame([("a", 5, 10, 1), ("b", 9, 4, 2), ("c", 2, 50, 3), ("d", 7, 7, 4), ("e", 1, 1, 5)], "source string, n long, most long, place long")
    got = {r.source: (r.taken, r.status) for r in capped.allocate(counts, 12).collect()}
    assert got == {"a": (5, "whole"), "b": (4, "whole"), "c": (2, "truncated"), "d": (1, "truncated"), "e": (0, "skipped")}
    rows = spark.createDataFrame([(s, k) for s, n in [("a", 5), ("b", 9), ("c", 2), ("d", 7), ("e", 1)] for k in range(n)], "source string, at long")
    taken = capped.allocated_rows(rows, capped.allocate(counts, 12), ["at"]).collect()
    assert sorted((r.source, r.at, r.idx) for r in taken) == [(s, k, k) for s, n in [("a", 5), ("b", 4), ("c", 2), ("d", 1)] for k in range(n)]


@pytest.mark.parametrize("block", [1 << 21, 150])
def test_ranking_equals_all_counts(spark, block):
    from policyloom.operators import similarity

    rnd = random.Random(8)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(80)]
    text = lambda: " ".join([w for w in common if rnd.random() < 0.8] + rnd.sample(rare, rnd.randrange(9)))
    queries = [(f"q{k}", rnd.choice([text(), text(), "", "unknown words", text() + " unknown"])) for k in range(40)] + [("qn", None)]
    records = [(f"d{k:03}é" if k % 7 else f"D{k}", rnd.choice([text(), text(), text(), ""])) for k in range(120)] + [("dn", None)]
    q, r = spark.createDataFrame(queries, "q string, t string"), spark.createDataFrame(records, "d string, u string")
    got = similarity.overlap_top_k(q, r, "q", F.col("t"), "d", F.col("u"), 4, least=3, block=block).collect()
    expected = []
    for name, asked in queries:
        mine = set((asked or "").split())
        scored = sorted((-len(mine & set((u or "").split())), d.encode(), d) for d, u in records)
        expected += [(name, d, -score, k + 1) for k, (score, _, d) in enumerate([x for x in scored if -x[0] >= 3][:4])]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert similarity.overlap_top_k(q.limit(0), r, "q", F.col("t"), "d", F.col("u"), 4).count() == 0


def test_ranking_of_a_block_holds_what_its_queries_have():
    """Long queries (more common tokens than a byte counts) against plain counts; the memory of a block follows the tokens that queries have, not those of the records."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from policyloom.operators.similarity import best_of_block

    rnd = np.random.default_rng(4)
    lists = lambda sizes, most: pa.array([rnd.choice(most, n, replace=False) for n in sizes], pa.list_(pa.int64()))
    q, r = lists([600, 3, 0, 290, 40], 700), lists(rnd.integers(0, 600, 300), 900)
    queries, records = pa.table({"tokens": q}), pa.table({"rid": [f"{k * 7 % 300:03}" for k in range(300)], "tokens": r})
    got = best_of_block(queries, records, 4, 2)
    expected = []
    for k, mine in enumerate(q.to_pylist()):
        scored = sorted((-len(set(mine) & set(x)), records["rid"][i].as_py(), i) for i, x in enumerate(r.to_pylist()))
        expected += [(k, i, -s) for s, _, i in scored[:4] if s <= -2]
    assert list(zip(*(x.tolist() for x in got), strict=True)) == expected
    many = pa.ListArray.from_arrays(pa.array(range(0, 1_000_001, 200), pa.int32()), pa.array(rnd.integers(10**6, 10**12, 1_000_000)))
    tracemalloc.start()
    best_of_block(queries, pa.table({"rid": list(range(5000)), "tokens": many}), 4, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24e6
